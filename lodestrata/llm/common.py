"""Helpers shared by the training-data operators.

Working tables go to the folder that ``spark.checkpoint.dir`` names, the one
place that the driver and every executor can see, so that a lost executor costs
a reread and not the job.
"""

from __future__ import annotations

import contextlib
import ctypes
import gc
import tempfile
import time
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

EDGE_PUNCTUATION = ".,;:!?\"'()[]{}<>*%&$#|-_/\\"


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder. A temporary folder of our own only where driver and executors are one machine."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir is not set: working tables need a folder that every executor can see")
        found = "file://" + tempfile.mkdtemp(prefix="lodestrata-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def shared_path(spark: SparkSession, tag: str) -> str:
    return f"{shared_dir(spark)}/lodestrata/{tag}-{uuid.uuid4().hex}"


@contextlib.contextmanager
def small_batches(spark: SparkSession, size: str = "4m"):
    """Arrow batches of so many bytes at most: their buffers come on top of an executor's heap."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key, None)
    spark.conf.set(key, size)
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


_tables: list[list[str]] = []


def _folder(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def working_path(spark: SparkSession, tag: str) -> str:
    """A new folder's path in the shared folder, which the ``working_tables`` around it delete at their end."""
    path = shared_path(spark, tag)
    for held in _tables:
        held.append(path)
    return path


def until_exit(spark: SparkSession, path: str) -> None:
    """Have what is at ``path`` deleted when the application ends, if nobody does so earlier."""
    fs, where = _folder(spark, path)
    fs.deleteOnExit(where)


def materialise(df: DataFrame, tag: str, codec: str = "zstd") -> DataFrame:
    """Write ``df`` to the shared folder and read it back: this cuts the lineage."""
    path = working_path(df.sparkSession, tag)
    with small_batches(df.sparkSession):
        df.write.option("compression", codec).parquet(path)
    until_exit(df.sparkSession, path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._lodestrata_path = path
    return out


def _delete(spark: SparkSession, path: str) -> None:
    fs, where = _folder(spark, path)
    fs.delete(where, True)
    fs.cancelDeleteOnExit(where)


def release(*frames: DataFrame) -> None:
    """Delete working tables that nothing reads any more."""
    for df in frames:
        path = getattr(df, "_lodestrata_path", None)
        if path:
            _delete(df.sparkSession, path)


def tidy(spark: SparkSession) -> None:
    """Let go of what nothing holds any more: shuffle files of jobs that are done, and the driver's freed memory.

    Spark drops a shuffle's files once the JVM's collector has met it, which an
    idle driver may leave for long. The first round frees what Python held in
    the JVM, and only a second one, a little later, finds the shuffles free.
    """
    _collect(spark)
    time.sleep(0.3)
    _collect(spark)


def _collect(spark: SparkSession) -> None:
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # other C libraries keep what they like
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    spark._jvm.System.gc()


@contextlib.contextmanager
def working_tables(spark: SparkSession, but: int = 0) -> Iterator[None]:
    """Deletes at its end the working tables written within, but for so many of the last: what isn't written out by then must not need them."""
    held: list[str] = []
    _tables.append(held)
    try:
        yield
    finally:
        _tables.remove(held)
        for path in held[: len(held) - but]:
            _delete(spark, path)
        tidy(spark)


def slices(batches, column: int, max_bytes: int = 8 << 20):
    """Cut record batches so that each holds at most ``max_bytes`` of the column, one row at least."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        ends, start = np.cumsum(sizes), 0
        while start < batch.num_rows:
            base = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, base + max_bytes, side="right")))
            yield batch.slice(start, stop - start)
            start = stop
            pa.default_memory_pool().release_unused()  # idle workers' memory counts too


def ascii_words(text: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Words between ASCII white space, A-Z lowered: the flat words and how many each row has."""
    return _words(pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(text, ""))))


def plain_words(text: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Words between ASCII white space, lower case, without punctuation at their edges."""
    parts = pc.ascii_split_whitespace(pc.utf8_lower(pc.fill_null(text, "")))
    return _words(pa.ListArray.from_arrays(parts.offsets, pc.utf8_trim(parts.values, characters=EDGE_PUNCTUATION)))


def _words(parts: pa.ListArray) -> tuple[pa.Array, np.ndarray]:
    flat = parts.flatten()
    offsets = parts.offsets.to_numpy() - parts.offsets[0].as_py() if len(parts) else np.zeros(1, dtype=np.int64)
    kept = pc.greater(pc.binary_length(flat), 0)
    seen = np.concatenate([[0], np.cumsum(kept.to_numpy(zero_copy_only=False))]).astype(np.int64)
    return flat.filter(kept), np.diff(seen[offsets])


def hash_words(words: pa.Array) -> np.ndarray:
    """64-bit hashes of the distinct words of a dictionary."""
    return np.fromiter((xxhash.xxh3_64_intdigest(w) for w in words.to_pylist()), dtype=np.uint64, count=len(words))


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64 over uint64."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def mix_in_place(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x ^= x >> np.uint64(30)
        x *= np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(27)
        x *= np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(31)
    return x


def union_find(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nodes of the edges (a, b) and the smallest node of each one's component, by hooking and pointer jumping."""
    nodes, inverse = np.unique(np.concatenate([a, b]), return_inverse=True)
    u, v = inverse[: len(a)], inverse[len(a) :]
    root = np.arange(len(nodes))
    while True:
        ru, rv = root[u], root[v]
        open_ = ru != rv
        if not open_.any():
            return nodes, nodes[root]
        u, v, ru, rv = u[open_], v[open_], ru[open_], rv[open_]
        np.minimum.at(root, np.maximum(ru, rv), np.minimum(ru, rv))
        while not np.array_equal(jumped := root[root], root):
            root = jumped


def _contract(batches):
    """Replace a task's edges by a star for each of their components, a few million edges at a time."""
    held, many = [], 0

    def stars():
        nodes, roots = union_find(np.concatenate([x for x, _ in held]), np.concatenate([y for _, y in held]))
        far = nodes != roots
        return nodes[far], roots[far]

    for batch in batches:
        held.append((batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_numpy(zero_copy_only=False)))
        many += batch.num_rows
        if many > 2_000_000:
            nodes, roots = stars()
            if len(nodes) > 1_000_000:
                yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(roots)], names=["u", "v"])
                held, many = [], 0
            else:
                held, many = [(nodes, roots)], len(nodes)
    if held:
        nodes, roots = stars()
        yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(roots)], names=["u", "v"])


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Smallest node reachable from each node of ``edges`` (long columns u, v): node, component.

    Large-star and small-star rounds (Kiveris et al. 2014), each after a
    contraction inside the tasks; every round is written to the shared folder.
    A node of high degree never has its neighbours gathered: both stars are
    joins with a node's smallest neighbour, which a partial aggregate finds.
    Returns no row for nodes without an edge.
    """
    current = materialise(edges.select(F.col("u").cast("long"), F.col("v").cast("long")).where("u is not null and v is not null and u <> v").mapInArrow(_contract, "u long, v long").distinct(), "cc")
    for _ in range(max_rounds):
        both = current.select("u", "v").unionByName(current.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        down = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        small_least = down.groupBy("u").agg(F.min("v").alias("m"))
        small = down.join(small_least, "u").select(F.explode(F.array(F.struct(F.col("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.*").where("u <> v")
        following = materialise(small.mapInArrow(_contract, "u long, v long").distinct(), "cc")
        # done when every edge is a spoke of a star whose centre is no other's spoke
        roots = following.select(F.col("v").alias("u")).distinct()
        open_ = following.join(roots, "u", "left_semi").limit(1).count() + following.groupBy("u").agg(F.count("*").alias("n")).where("n > 1").limit(1).count()
        release(current)
        current = following
        if not open_:
            return current.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(current.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
    raise RuntimeError(f"components still open after {max_rounds} rounds")
