"""WARC archives, written with an index first and read back by coalesced byte ranges."""

from __future__ import annotations

import base64
import gzip
import hashlib
import re

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.files import open_path
from .common import materialise, slices, until_exit, working_path

INDEX = "page_id long, url string, record_type string, refers_to long, digest string, file string, offset long, length long"
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def _header(value: str) -> str:
    """A header's value on one line."""
    return re.sub(r"[\r\n]+", lambda m: "".join(f"%{ord(c):02X}" for c in m[0]), value)


def record(kind: str, page_id, url, payload: bytes, digest: str, refers_to) -> bytes:
    """One WARC/1.1 record. A revisit keeps the HTTP head, whose Content-Length is the payload's, and drops the payload."""
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = head + payload if kind == "response" else head
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:x-page:{'none' if page_id is None else page_id}>", f"WARC-Date: {DATE}"]
    if url is not None:
        lines.append(f"WARC-Target-URI: {_header(url)}")
    lines.append(f"WARC-Payload-Digest: sha1:{digest}")
    if kind == "revisit":
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <urn:x-page:{refers_to}>"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return ("\r\n".join(lines) + "\r\n\r\n").encode() + block + b"\r\n\r\n"


def parse(raw: bytes) -> tuple[dict[str, str], dict[str, str], bytes]:
    """WARC headers, HTTP headers and payload of one record."""
    end = raw.index(b"\r\n\r\n")
    split = lambda part: {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in part.decode().split("\r\n")[1:])}
    warc = split(raw[:end])
    block = raw[end + 4 : end + 4 + int(warc["content-length"])]
    mid = block.index(b"\r\n\r\n")
    return warc, split(block[:mid]), block[mid + 4 :]


def _writer(folder: str, roll: int):
    def write(batches):
        fs, top = open_path(folder)
        fs.create_dir(top, recursive=True)
        task = TaskContext.get()
        out, name, number, offset = None, "", 0, 0
        schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("digest", pa.string()), ("file", pa.string()), ("offset", pa.int64()), ("length", pa.int64())])
        for batch in slices(batches, 2, 2 << 20):
            rows = []
            for page_id, url, html, refers_to in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                payload = (html or "").encode()
                digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
                kind = "response" if refers_to is None else "revisit"
                raw = gzip.compress(record(kind, page_id, url, payload, digest, refers_to), 4, mtime=0)
                if out is None or offset > roll:
                    if out is not None:
                        out.close()
                    # the attempt's number keeps a second attempt of a task from writing over the first one's file
                    name, number, offset = f"part-{task.partitionId():06d}-{task.taskAttemptId()}-{number:03d}.warc.gz", number + 1, 0
                    out = fs.open_output_stream(f"{top}/{name}", compression=None)
                out.write(raw)
                rows.append((page_id, url, kind, refers_to, digest, name, offset, len(raw)))
                offset += len(raw)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [[]] * 8, schema.types, strict=True)], schema=schema)
        if out is not None:
            out.close()

    return write


def write_warc(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", min_revisit_bytes: int = 0, roll: int = 1 << 30) -> DataFrame:
    """Write a gzip record for each row and return the index: url, digest, file, offset and length of each.

    Of rows whose payloads are equal and at least ``min_revisit_bytes`` long,
    those with the largest id are responses and the others revisit it; repeated
    rows that share that id are all responses. A null id counts as smallest, a
    null payload as empty, a null URL leaves the header out; further columns
    are ignored. Only the 20-byte digests are grouped; a very common payload is
    pre-aggregated in each task, and AQE splits the join that brings its rows
    their response's id.
    """
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))
    key = F.sha1(F.encode(F.coalesce("html", F.lit("")), "UTF-8"))
    repeated = rows.where(F.octet_length(F.coalesce("html", F.lit(""))) >= min_revisit_bytes).groupBy(key.alias("sha")).agg(F.max("page_id").alias("last"), F.count("*").alias("n")).where("n > 1 and last is not null").select("sha", "last")
    marked = rows.withColumn("sha", key).join(repeated, "sha", "left")
    refers = F.when(F.col("last").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("last")), F.col("last"))
    return materialise(marked.select("page_id", "url", "html", refers.alias("refers_to")).mapInArrow(_writer(folder, roll), INDEX), "warc-index")


def _reader(folder: str, gap: int, most: int):
    def read(batches):
        fs, top = open_path(folder)
        schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("html", pa.string())])
        for batch in batches:
            wanted = sorted(zip(*(batch.column(n).to_pylist() for n in ("file", "offset", "length", "page_id", "digest")), strict=True), key=lambda x: x[:2])
            at = 0
            while at < len(wanted):
                end = at + 1
                while end < len(wanted) and wanted[end][0] == wanted[at][0] and wanted[end][1] - (wanted[end - 1][1] + wanted[end - 1][2]) <= gap and wanted[end][1] + wanted[end][2] - wanted[at][1] <= most:
                    end += 1
                base = wanted[at][1]
                with fs.open_input_file(f"{top}/{wanted[at][0]}") as f:
                    held = f.read_at(wanted[end - 1][1] + wanted[end - 1][2] - base, base)
                rows = []
                for _, offset, length, page_id, digest in wanted[at:end]:
                    warc, http, payload = parse(gzip.decompress(held[offset - base : offset - base + length]))
                    kind, refers = warc["warc-type"], warc.get("warc-refers-to")
                    found = warc["warc-payload-digest"].removeprefix("sha1:")
                    if found != digest or kind == "response" and base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest:
                        raise ValueError(f"{wanted[at][0]} at {offset}: the record is not the one indexed")
                    rows.append((page_id, warc.get("warc-target-uri"), int(http["content-length"]), found, kind, int(refers[1:-1].rpartition(":")[2]) if refers else None, payload.decode() if kind == "response" else None))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)
                at = end

    return read


def read_warc(index: DataFrame, folder: str, gap: int = 64 << 10, most: int = 4 << 20) -> DataFrame:
    """Read the records that ``index`` selects, in one read for each run of neighbours.

    The index is sorted by file and offset within range partitions; runs are
    joined over gaps of up to ``gap`` bytes into reads of up to ``most``. Each
    digest is checked against what is read. ``html`` is null for revisits.
    """
    n = max(1, int(index.sparkSession.conf.get("spark.sql.shuffle.partitions", "200")))
    return index.select("page_id", "digest", "file", "offset", "length").repartitionByRange(n, "file", "offset").sortWithinPartitions("file", "offset").mapInArrow(_reader(folder, gap, most), "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, html string")


def warc_round_trip(pages: DataFrame, min_revisit_bytes: int = 0) -> DataFrame:
    """Write ``pages`` to archives in the shared folder and read every record back."""
    spark = pages.sparkSession
    folder = working_path(spark, "warc")
    index = write_warc(pages, folder, min_revisit_bytes=min_revisit_bytes)
    until_exit(spark, folder)
    return read_warc(index, folder)


def op10_warc(spark, sf_dir: str) -> DataFrame:
    out = warc_round_trip(spark.read.parquet(f"{sf_dir}/pages.parquet"))
    return out.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
