import base64
import hashlib
from collections import defaultdict

import pyarrow.parquet as pq

from lodestrata.llm import warc
from lodestrata.llm.common import shared_path


def verify(got, rows):
    last = {}
    for page_id, html in rows:
        key = (html or "").encode()
        last[key] = max(last.get(key, -1), -1 if page_id is None else page_id)
    want = defaultdict(list)
    for page_id, html in rows:
        data = (html or "").encode()
        revisit = last[data] >= 0 and page_id != last[data]
        want[page_id].append((len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "revisit" if revisit else "response", last[data] if revisit else None))
    have = defaultdict(list)
    for r in got:
        have[r.page_id].append((r.payload_bytes, r.payload_digest, r.record_type, r.refers_to))
    assert {k: sorted(map(repr, v)) for k, v in have.items()} == {k: sorted(map(repr, v)) for k, v in want.items()}


def test_whole_table(spark, sf_dir):
    t = pq.read_table(f"{sf_dir}/pages.parquet").to_pydict()
    verify(warc.op10_warc(spark, sf_dir).collect(), list(zip(t["page_id"], t["html"], strict=True)))


def test_nulls_copies_ties_and_extra_columns(spark):
    rows = [(1, "u", "a"), (2, None, "a"), (3, "x\r\nWARC-Type: evil", ""), (4, "", None), (5, "u", "é" * 100_000), (None, "u", "a"), (None, None, "only"), (2, None, "a"), (7, "u", "\r\n\r\n")]
    df = spark.createDataFrame([(*r, "z", "y") for r in rows], "page_id long, url string, html string, digest string, file string")
    verify(warc.warc_round_trip(df).collect(), [(r[0], r[2]) for r in rows])
    full = warc.warc_round_trip(df).where("page_id = 5").first()
    assert full.html == "é" * 100_000 and full.url == "u"
    assert warc.warc_round_trip(df.limit(0)).count() == 0


def test_threshold_and_selected_ranges(spark):
    df = spark.createDataFrame([(i, f"u{i}", "same" if i % 2 else "x" * i) for i in range(40)], "page_id long, url string, html string")
    folder = shared_path(spark, "warc-test")
    index = warc.write_warc(df, folder, min_revisit_bytes=5)
    assert {r.record_type for r in index.where("url like '%1' or url like '%3'").collect()} == {"response"}
    got = warc.read_warc(index.where("page_id in (3, 4, 17)"), folder, gap=10, most=100).collect()
    assert {(r.page_id, r.url, r.html) for r in got} == {(3, "u3", "same"), (4, "u4", "xxxx"), (17, "u17", "same")}
