import struct
import zlib
from collections import defaultdict

import pyarrow.parquet as pq
import pytest
from tokenizers import Tokenizer

from lodestrata.llm import packing


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(packing.default_paths()[0])


def expected(rows, tokenizer):
    return [(d, tokenizer.encode(t or "", add_special_tokens=False).ids + [0]) for d, t in rows]


def verify(pieces, rows, tokenizer):
    """Every id in exactly one piece; sequences gapless and full, or a power of two."""
    docs = defaultdict(list)
    for p in pieces:
        docs[p.doc_id].append(p)
    want = defaultdict(list)
    for d, ids in expected(rows, tokenizer):
        want[d].append(ids)
    assert set(docs) == set(want)
    for d, lists in want.items():
        if len(lists) > 1:
            assert sum(p.length for p in docs[d]) == sum(map(len, lists))
            continue
        at = 0
        for p in sorted(docs[d], key=lambda p: p.start):
            part = lists[0][p.start : p.start + p.length]
            assert p.start == at and p.length == len(part) > 0 and p.doc_tokens == len(lists[0])
            assert p.ids_crc32 == zlib.crc32(struct.pack(f"<{len(part)}I", *part))
            at += p.length
        assert at == len(lists[0])
    sequences = defaultdict(list)
    for p in pieces:
        sequences[p.sequence_id].append(p)
    padding = 0
    for ps in sequences.values():
        at = 0
        for p in sorted(ps, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= 1024
        padding += 0 if at & (at - 1) == 0 else 1024 - at
    assert padding == 0
    assert sorted(sequences) == list(range(len(sequences)))


def test_whole_table(spark, sf_dir, tokenizer):
    t = pq.read_table(f"{sf_dir}/documents.parquet").to_pydict()
    verify(packing.op1_packing(spark, sf_dir).collect(), list(zip(t["doc_id"], t["text"], strict=True)), tokenizer)


def distances(pieces, shares, least=1024):
    """L1 distance of each full window's shares from the target shares."""
    lens, by_queue = defaultdict(int), defaultdict(lambda: defaultdict(int))
    for p in pieces:
        lens[p.sequence_id] += p.length
        by_queue[p.sequence_id][p.queue] += p.length
    return {s: sum(abs(by_queue[s][q] / 1024 - x) for q, x in shares.items()) for s, n in lens.items() if n == 1024}


def shares_of(pieces):
    by_queue = defaultdict(int)
    for p in pieces:
        by_queue[p.queue] += p.length
    return {q: n / sum(by_queue.values()) for q, n in by_queue.items()}


def test_windows_hold_target_shares(spark, sf_dir):
    pieces = packing.op1_packing(spark, sf_dir).collect()
    off = distances(pieces, shares_of(pieces))
    assert len(off) > 100
    assert sum(off.values()) / len(off) < 0.1  # of all full windows
    early = [x for s, x in off.items() if s <= max(off) * 0.8]
    assert max(early) < 0.1


def test_nulls_repeats_long_texts_and_extra_columns(spark, tokenizer):
    rows = [(1, None, None), (2, "", "a"), (3, "word " * 6000, "a"), (4, "x<|endoftext|>y", "b"), (5, "aa", "b"), (6, "é\U0001f600 " * 50, None)]
    df = spark.createDataFrame([(*r, 7, "q") for r in rows], "doc_id long, text string, source string, n int, queue string")
    verify(packing.pack(df, chunk_tokens=500).collect(), [r[:2] for r in rows], tokenizer)
    assert sum(p.length for p in packing.pack(df.unionByName(df)).collect()) == 2 * sum(len(i) for _, i in expected([r[:2] for r in rows], tokenizer))


def test_weights_and_empty(spark):
    df = spark.createDataFrame([(i, "some words here " * 40, "ab"[i % 2]) for i in range(60)], "doc_id long, text string, source string").coalesce(1)
    pieces = packing.pack(df, weights={"a": 3, "b": 1}, quantum=1).collect()
    early = [p for p in pieces if p.sequence_id < 3]  # before queue a has run dry
    assert abs(sum(p.length for p in early if p.queue == "a") / sum(p.length for p in early) - 0.75) < 0.02
    assert packing.pack(df.limit(0)).count() == 0


def test_round_robin_carries_deficits():
    runs = packing.deficit_round_robin([100] * 4, [100, 300], [0.25, 0.75], [50.0, -50.0], 10)
    assert runs[:2] == [(0, 0, 0, 50), (0, 50, 1, 50)]  # twice its share, not the whole debt at once
    assert runs[2:4] == [(1, 0, 0, 50), (1, 50, 1, 50)]
    assert sum(n for _, _, q, n in runs if q == 0) == 100 and sum(n for *_, n in runs) == 400


def test_input_sorted_by_source(spark, tokenizer, tmp_path):
    rows = [(i, f"word {i} " * 90, q) for i, q in enumerate(["a"] * 300 + ["b"] * 200 + ["c"] * 99 + ["d"])]
    for k in range(6):  # a file of one source for each partition
        spark.createDataFrame(rows[100 * k : 100 * k + 100], "doc_id long, text string, source string").coalesce(1).write.mode("append").parquet(str(tmp_path / "t"))
    df = spark.read.parquet(str(tmp_path / "t"))
    for weights in (None, {"a": 1, "b": 1, "c": 2}):
        pieces = packing.pack(df, chunk_tokens=36_000, weights=weights).collect()
        verify(pieces, [r[:2] for r in rows], tokenizer)
        if weights:  # until the first queue has run dry
            last = sum(p.length for p in pieces if p.queue == "c") * 2 // 1024 * 9 // 10
            off = {s: x for s, x in distances(pieces, {q: n / 4 for q, n in weights.items()}).items() if s < last}
        else:
            off = distances(pieces, shares_of(pieces))
        assert len(off) > 30
        assert sum(off.values()) / len(off) < 0.1


def test_spans_of_chunks(spark, tokenizer, monkeypatch):
    monkeypatch.setattr(packing, "SPAN", 3)
    monkeypatch.setattr(packing, "FEW_PLACES", 0)
    rows = [(i, f"some words {i} " * 40, "abc"[i % 3]) for i in range(120)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    verify(packing.pack(df, chunk_tokens=2_000).collect(), [r[:2] for r in rows], tokenizer)


def test_rare_queues_are_served_in_every_window_they_are_due():
    shares = [0.9, 0.09, 0.0095, 0.0005]
    supply = [int(1024 * 400 * x) for x in shares]
    runs = packing.deficit_round_robin([1024] * 390, supply, shares, [0.0] * 4)
    off = defaultdict(lambda: defaultdict(int))
    for w, _, q, n in runs:
        off[w][q] += n
    assert max(abs(off[w][q] - 1024 * x) for w in range(380) for q, x in enumerate(shares)) < 3
