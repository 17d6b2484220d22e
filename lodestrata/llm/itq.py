"""Embedding near-duplicates: iterative quantisation, multi-index Hamming tables, exact rerank."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import connected_components, materialise, release, union_find
from .vectors import matrix, pack, unpack

SCHEMA = "vec_id long, label long, x binary"


def _whole(width: int):
    def run(batches):
        for batch in batches:
            ok, x = matrix(batch.column(2), width)
            some = (x != 0).any(1)
            kept = np.zeros(len(ok), dtype=bool)
            kept[np.nonzero(ok)[0][some]] = True
            mask = pa.array(kept)
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(mask), batch.column(1).filter(mask), pa.array(pack(x[some].astype("<f8") + 0.0), pa.binary())], names=["vec_id", "label", "x"])

    return run


def unit(x: np.ndarray) -> np.ndarray:
    """Rows of length 1; scaled first, so that very large or small components don't overflow."""
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def learn_rotations(sample: np.ndarray, rounds: int = 30, seed: int = 5):
    """Endless (mean, projection) pairs: principal axes turned by ITQ (Gong and Lazebnik 2011), each from another random start."""
    mean = sample.mean(0)
    centred = sample - mean
    _, axes = np.linalg.eigh(centred.T @ centred)
    v = centred @ axes
    rng = np.random.default_rng(seed)
    while True:
        r = np.linalg.qr(rng.standard_normal((v.shape[1], v.shape[1])))[0]
        for _ in range(rounds):
            u, _, wt = np.linalg.svd(np.where(v @ r >= 0, 1.0, -1.0).T @ v)
            r = (u @ wt).T
        yield mean, axes @ r


def _signs(y: np.ndarray, rotations) -> np.ndarray:
    return np.concatenate([(y - m) @ p >= 0 for m, p in rotations], axis=1)


def partners(y: np.ndarray, threshold: float, towards: np.ndarray) -> np.ndarray:
    """For each unit vector one at the threshold's cosine from it, on the way to another."""
    side = towards - (towards * y).sum(1, keepdims=True) * y
    side /= np.maximum(np.sqrt((side * side).sum(1, keepdims=True)), 1e-12)
    return threshold * y + math.sqrt(1 - threshold**2) * side


def enough_tables(sample: np.ndarray, bits: int, threshold: float, recall: float, most: int = 1024) -> tuple[list, int]:
    """Rotations and tables by which pairs at the threshold share a key with a chance of ``recall``, as measured on the sample.

    The pairs are sampled vectors and made-up partners at the threshold's
    cosine, in random directions and in those of other samples; the rarer kind
    to meet counts. Where the data share a direction, centred codes part such
    pairs more often, and more tables are taken.
    """
    learnt, rotations = learn_rotations(sample), []
    rng = np.random.default_rng(11)
    y = sample[:2000]
    others = [partners(y, threshold, rng.standard_normal(y.shape)), partners(y, threshold, sample[rng.permutation(len(sample))[: len(y)]])]
    signs, met = [np.zeros((len(y), 0), dtype=bool) for _ in range(3)], [np.zeros(len(y), dtype=bool) for _ in others]
    for tables in range(1, most + 1):
        while signs[0].shape[1] < tables * bits:
            rotations.append(next(learnt))
            signs = [np.concatenate([s, _signs(x, rotations[-1:])], axis=1) for s, x in zip(signs, [y, *others], strict=True)]
        span = slice((tables - 1) * bits, tables * bits)
        for k in range(len(others)):
            met[k] |= (signs[0][:, span] == signs[1 + k][:, span]).all(1)
        if tables >= 4 and min(m.mean() for m in met) >= recall:
            break
    return rotations, tables


def _kinds(bits: int) -> str:
    return "<u2" if bits <= 16 else "<u4"


GRID = 32767  # components of unit vectors as 16-bit integers


def _codes(rotations, bits: int, tables: int, width: int):
    """Each class with its vector on a grid of 16-bit integers and its key in each table."""

    def run(batches):
        for batch in batches:
            x = unpack(batch.column("x"), "<f8", width)
            y = unit(x) if len(x) else x
            signs = _signs(y, rotations)[:, : tables * bits]
            keys = (signs.reshape(len(x), tables, bits) * (1 << np.arange(bits, dtype=np.int64))).sum(2)
            grid = np.round(y * GRID).astype("<i2")
            yield pa.RecordBatch.from_arrays([batch.column("rep"), batch.column("label"), batch.column("copies"), pa.array(pack(grid), pa.binary()), pa.array(pack(keys.astype(_kinds(bits))), pa.binary()), pa.array(list(keys), pa.list_(pa.int64()))], names=["rep", "label", "copies", "grid", "code", "keys"])

    return run


def _compare(width: int, bits: int, tables: int, threshold: float):
    """All pairs of each bucket of a group: counts of links and spanning edges of those surely above the threshold, and the few pairs too close to it for the grid."""
    doubt = math.sqrt(width) / GRID * 1.01 + 1e-5

    def run(_, rows):
        rep, copies = np.asarray(rows.column("rep")), np.asarray(rows.column("copies"))
        side = np.asarray(rows.column("side"))
        table = rows.column("t")[0].as_py()
        y, codes = unpack(rows.column("grid"), "<i2", width).astype(np.float32) / np.float32(GRID), unpack(rows.column("code"), _kinds(bits), tables)
        run_of = np.unique(np.stack([np.asarray(rows.column("label")), np.asarray(rows.column("key"))], 1), axis=0, return_inverse=True)[1].ravel()
        links = np.zeros(len(rep), dtype=np.int64)
        ea, eb, da, db = [], [], [], []
        order = np.argsort(run_of, kind="stable")
        bounds = np.concatenate([[0], np.cumsum(np.bincount(run_of))])
        for a, b in zip(bounds[:-1], bounds[1:], strict=True):
            if b - a < 2:
                continue
            mine = order[a:b]
            # side 0: rows of one chunk, all against all; sides 1 and 2: two chunks of a large bucket
            left, right = (mine, mine) if (side[mine] == 0).all() else (mine[side[mine] == 1], mine[side[mine] == 2])
            for s in range(0, len(left), 1024):
                l = left[s : s + 1024]
                cosines = y[l] @ y[right].T
                i, j = np.nonzero(cosines >= threshold - doubt)
                if left is right:
                    far = i + s < j
                    i, j = i[far], j[far]
                u, v = l[i], right[j]
                # a pair counts in the first table in which it meets
                first = (codes[u] == codes[v]).argmax(1) == table if len(u) else np.zeros(0, dtype=bool)
                sure = cosines[i, j] >= threshold + doubt
                u, v, sure = u[first], v[first], sure[first]
                da.append(rep[u[~sure]])
                db.append(rep[v[~sure]])
                u, v = u[sure], v[sure]
                np.add.at(links, u, copies[v])
                np.add.at(links, v, copies[u])
                if len(u):
                    nodes, roots = union_find(rep[u], rep[v])
                    far = nodes != roots
                    ea.append(nodes[far])
                    eb.append(roots[far])
        some = links > 0
        parts = [(np.concatenate([np.zeros(0, dtype=np.int64), *a]), np.concatenate([np.zeros(0, dtype=np.int64), *b])) for a, b in ((ea, eb), (da, db))]
        parts.append((rep[some], rep[some]))
        n = [len(a) for a, _ in parts]
        columns = [pa.array(np.concatenate([p[k] for p in parts])) for k in (0, 1)]
        counted = np.concatenate([np.zeros(n[0] + n[1], dtype=np.int64), links[some]])
        return pa.table([*columns, pa.array(counted), pa.array(np.repeat(np.array([0, 1, 0], dtype=np.int8), n))], names=["u", "v", "links", "doubt"])

    return run


def _settle(width: int, threshold: float):
    """The pairs whose original vectors have the cosine, in double precision."""

    def run(batches):
        for batch in batches:
            a, b = (unpack(batch.column(c), "<f8", width) for c in ("xu", "xv"))
            close = np.einsum("ij,ij->i", unit(a), unit(b)) >= threshold if len(a) else np.zeros(0, dtype=bool)
            mask = pa.array(close)
            yield pa.RecordBatch.from_arrays([batch.column(c).filter(mask) for c in ("u", "v", "nu", "nv")], names=["u", "v", "nu", "nv"])

    return run


def near_duplicates(vectors: DataFrame, threshold: float = 0.93, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", sample_rows: int = 20_000, bucket_rows: int = 48, chunk_rows: int = 2048, group_rows: int = 4096, recall: float = 0.99) -> DataFrame:
    """Links between vectors of one label at a cosine of ``threshold`` or more: vec_id, n_links, component_id, kept.

    Equal vectors of a label are collapsed first and counted by multiplicity.
    A rotation for balanced binary codes is learnt by ITQ from at most
    ``sample_rows`` vectors (smallest id hashes; a documented bound, for speed:
    every row is indexed). Codes are cut into substrings, each the key of a
    Hamming table; their length grows with the logarithm of the largest label
    so that buckets hold about ``bucket_rows``, and their number is what finds
    ``recall`` of pairs at the threshold, as measured on the sample, and closer
    ones almost surely. Substrings beyond one code's length come from further
    rotations.

    To its buckets a row takes its vector on a grid of 16-bit integers, whose
    error is bounded: pairs surely above the threshold count there, and only
    their spanning edges leave the bucket; the few within the error, 0.0005
    about the threshold at 64 components, go on and are settled by the original
    vectors in double precision. A bucket beyond ``chunk_rows`` is dealt out as
    pairs of chunks, so none is capped; small ones share groups of about
    ``group_rows`` rows, whatever the input's size. A pair counts in the first
    table in which it meets.

    Vectors that are null, empty, zero or hold null or non-finite components,
    and rows with a null label, link with nothing but come back, kept. Shorter
    vectors are filled up with zeros. Rows without an id come back with null
    component, kept. Rows that repeat an id count once, by their smallest label
    and vector. Further columns are ignored.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).cast("long").alias("label"), F.col(vector_col).alias("embedding"))
    width = max(1, int(rows.agg(F.coalesce(F.max(F.size("embedding")), F.lit(0)).alias("w")).first().w))
    usable = rows.where("vec_id is not null and label is not null").mapInArrow(_whole(width), SCHEMA)
    usable = materialise(usable.groupBy("vec_id").agg(F.min(F.struct("label", "x")).alias("m")).select("vec_id", "m.*"), "itq")
    classes = usable.groupBy("label", "x").agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies"))
    classes = materialise(classes, "itq-classes")
    sizes = classes.groupBy("label").count().agg(F.coalesce(F.max("count"), F.lit(0)).alias("largest"), F.coalesce(F.sum("count"), F.lit(0)).alias("rows")).first()
    bits = max(4, min(28, round(math.log2(max(1, sizes.largest) / bucket_rows)) if sizes.largest else 4))
    sample = classes.orderBy(F.xxhash64("rep"), "rep").limit(sample_rows).select("x").collect()
    x = unit(np.stack([np.frombuffer(r.x, dtype="<f8") for r in sample])) if sample else np.eye(width)
    rotations, tables = enough_tables(x, bits, threshold, recall)
    coded = materialise(classes.mapInArrow(_codes(rotations, bits, tables, width), "rep long, label long, copies long, grid binary, code binary, keys array<long>"), "itq-codes")
    counts = coded.select("label", F.posexplode("keys").alias("t", "key")).groupBy("label", "t", "key").count()
    large = materialise(counts.where(F.col("count") > chunk_rows).select("label", "t", "key", F.ceil(F.col("count") / chunk_rows).cast("int").alias("chunks")), "itq-large")
    keyed = coded.select("rep", "label", "copies", "grid", "code", F.posexplode("keys").alias("t", "key"))
    marked = keyed.join(F.broadcast(large) if large.count() <= 20_000 else large, ["label", "t", "key"], "left")
    chunk = F.pmod(F.xxhash64("rep", F.lit(1)), F.col("chunks").cast("long")).cast("int")
    pairs = F.when(F.col("chunks").isNull(), F.array(F.struct(F.lit(-1).alias("a"), F.lit(-1).alias("b"), F.lit(0).alias("side"))))
    pairs = pairs.otherwise(F.transform(F.sequence(F.lit(0), F.col("chunks") - 1), lambda o: F.struct(F.least(F.col("c"), o).alias("a"), F.greatest(F.col("c"), o).alias("b"), F.when(F.col("c") == o, 0).when(F.col("c") < o, 1).otherwise(2).alias("side"))))
    dealt = marked.withColumn("c", chunk).withColumn("p", F.explode(pairs)).select("rep", "label", "copies", "grid", "code", "t", "key", "p.*")
    # small buckets share a group; each pair of chunks of a large one has its own
    group = F.when(F.col("a") < 0, F.pmod(F.xxhash64("label", "key"), F.lit(max(1, -(-int(sizes.rows) // group_rows))).cast("long"))).otherwise(F.lit(-1).cast("long"))
    big = F.when(F.col("a") >= 0, F.xxhash64("label", "key")).otherwise(F.lit(0).cast("long"))
    found = materialise(dealt.withColumn("g", group).withColumn("big", big).groupBy("t", "g", "big", "a", "b").applyInArrow(_compare(width, bits, tables, threshold), "u long, v long, links long, doubt tinyint"), "itq-links")
    side = lambda end: classes.select(F.col("rep").alias(end), F.col("x").alias(f"x{end}"), F.col("copies").alias(f"n{end}"))
    close = found.where("doubt = 1").select("u", "v").join(side("u"), "u").join(side("v"), "v").select("u", "v", "nu", "nv", "xu", "xv")
    close = materialise(close.mapInArrow(_settle(width, threshold), "u long, v long, nu long, nv long"), "itq-settled")
    counted = found.where("links > 0").select(F.col("u").alias("rep"), "links").unionByName(close.select(F.col("u").alias("rep"), F.col("nv").alias("links"))).unionByName(close.select(F.col("v").alias("rep"), F.col("nu").alias("links")))
    direct = counted.groupBy("rep").agg(F.sum("links").alias("links"))
    component = connected_components(found.where("doubt = 0 and u <> v").select("u", "v").unionByName(close.select("u", "v")))
    merged = classes.select("label", "x", "rep", "copies").join(direct, "rep", "left").join(component.withColumnRenamed("node", "rep"), "rep", "left")
    merged = materialise(merged.select("label", "x", F.coalesce("component", "rep").alias("component_id"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links")), "itq-merged")
    release(coded, large, found, close)
    linked = usable.join(merged, ["label", "x"]).select("vec_id", "n_links", "component_id")
    ids = rows.select("vec_id").distinct()
    out = ids.join(linked, "vec_id", "left").select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def op8_near_vectors(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
