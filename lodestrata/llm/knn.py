"""Exact top-k by inner product: a Voronoi kNN join over pivots."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise, release
from .ngrams import expand, squeeze
from .vectors import matrix, pack, unpack

PLACED = "vec_id long, is_query boolean, cell int, far double, qcell int, qfar double, x binary"
WIDE = 640  # digits that hold any sum of products of doubles
NO_ID = np.iinfo(np.int64).max


def _scaled(width: int, scale: float):
    """Whole vectors on the integer grid, with their squared length and largest component."""

    def run(batches):
        for batch in batches:
            ok, x = matrix(batch.column(1), width)
            with np.errstate(over="ignore"):
                x = np.floor(x * scale) + 0.0
                fits = np.isfinite(x).all(1)
                ok[np.nonzero(ok)[0][~fits]] = False
                x = x[fits]
                mask = pa.array(ok)
                yield pa.RecordBatch.from_arrays([batch.column(0).filter(mask).cast(pa.int64()), batch.column(2).filter(mask), pa.array((x * x).sum(1)), pa.array(np.abs(x).max(1, initial=0.0)), pa.array(pack(x.astype("<f8")), pa.binary())], names=["vec_id", "is_query", "n2", "most", "x"])

    return run


def lifted(x: np.ndarray, longest: float) -> np.ndarray:
    """Data vectors with one more component, by which all get the length ``longest``: a larger inner product with a query is then a smaller distance from it."""
    return np.concatenate([x, np.sqrt(np.maximum(longest**2 - (x * x).sum(1), 0.0))[:, None]], axis=1)


def distances(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    d2 = (x * x).sum(1)[:, None] - 2 * x @ pivots.T + (pivots * pivots).sum(1)
    return np.sqrt(np.maximum(d2, 0.0))


def neighbourhoods(pivots: np.ndarray, sizes: np.ndarray, most: int) -> list[list[int]]:
    """Cells in groups of up to ``most`` members or of one cell: halved across the longest axis until they fit."""
    out, todo = [], [np.arange(len(pivots))] if len(pivots) else []
    while todo:
        part = todo.pop()
        if len(part) == 1 or sizes[part].sum() <= most:
            out.append(part.tolist())
            continue
        x = pivots[part] - pivots[part].mean(0)
        order = np.argsort(x @ np.linalg.svd(x, full_matrices=False)[2][0] if np.isfinite(x).all() else part, kind="stable")
        half = int(np.clip(np.searchsorted(np.cumsum(sizes[part[order]]), sizes[part].sum() / 2), 1, len(part) - 1))
        todo += [part[order[:half]], part[order[half:]]]
    return out


def _place(width: int, pivots, longest: float):
    """The cell of each row as data and, for queries, as a query (whose further component is 0)."""

    def run(batches):
        p = pivots.value
        for batch in batches:
            x = unpack(batch.column("x"), "<f8", width)
            far = distances(lifted(x, longest), p)
            qfar = distances(np.concatenate([x, np.zeros((len(x), 1))], axis=1), p)
            cell, qcell, at = far.argmin(1), qfar.argmin(1), np.arange(len(x))
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("is_query"), pa.array(cell, pa.int32()), pa.array(far[at, cell]), pa.array(qcell, pa.int32()), pa.array(qfar[at, qcell]), batch.column("x")], names=["vec_id", "is_query", "cell", "far", "qcell", "qfar", "x"])

    return run


def reaches(k: int, pivots: np.ndarray, near: list[tuple[int, np.ndarray]], queries: list[tuple[int, float]]) -> np.ndarray:
    """For each cell of queries the distance from its pivot beyond which no row can be among the k nearest of any of its queries.

    A query at most r from its pivot has a member of another cell, at f from
    its own, no farther than r + the pivots' distance + f. The (k+1)-th
    smallest of these bounds (one member may be the query itself) is over the
    k-th nearest; a row beyond it by another r can't come in.
    """
    far = np.concatenate([f for _, f in near]) if near else np.zeros(0)
    owner = np.repeat(np.arange(len(near)), [len(f) for _, f in near])
    members = pivots[[c for c, _ in near]]
    out = np.full(len(queries), np.inf)
    if len(far) > k:
        step = max(1, (1 << 21) // len(far))
        for a in range(0, len(queries), step):
            part = queries[a : a + step]
            between = distances(pivots[[c for c, _ in part]], members)
            bound = between[:, owner] + far
            kth = np.partition(bound, k, axis=1)[:, k]
            out[a : a + len(part)] = kth + 2 * np.array([r for _, r in part])
    return out * (1 + 1e-9) + 1e-6


def needed(pivots: np.ndarray, cells: np.ndarray, reach: np.ndarray) -> float:
    """The share of rows within the reach of a cell of queries, read from the pivots, which are rows themselves."""
    return float(np.mean([(distances(pivots[cells[a : a + 256]], pivots) <= reach[a : a + 256, None]).mean() for a in range(0, len(cells), 256)] or [0.0]))


def _replicate(width: int, pivots, longest: float, cells: np.ndarray, reach: np.ndarray, groups: list[np.ndarray], block_rows: int, kind: str):
    """Blocks of the rows that each group of queries needs: those within the reach of one of its cells."""
    all_rows = reach >= 2 * longest  # no two vectors of that length lie farther apart
    near = [None if all_rows[members].any() else members for members in groups]

    def run(batches):
        p = pivots.value[cells]
        number = 0
        for batch in batches:
            ids, blobs = np.asarray(batch.column("vec_id")), unpack(batch.column("x"), "<f8", width)
            for at in range(0, len(ids), block_rows):
                x, mine = blobs[at : at + block_rows], ids[at : at + block_rows]
                need = distances(lifted(x, longest), p) <= reach if any(m is not None for m in near) else None
                out: list[list] = [[], [], [], []]
                whole = None
                for g, members in enumerate(near):
                    wanted = None if members is None else need[:, members].any(1)
                    if wanted is None or wanted.all():
                        whole = whole or (mine.astype("<i8").tobytes(), squeeze(x.astype(kind).ravel()))
                        piece = whole
                    elif wanted.any():
                        piece = mine[wanted].astype("<i8").tobytes(), squeeze(x[wanted].astype(kind).ravel())
                    else:
                        continue
                    for column, value in zip(out, (g, number, *piece), strict=True):
                        column.append(value)
                number += 1
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, (pa.int32(), pa.int64(), pa.binary(), pa.binary()), strict=True)], names=["g", "number", "ids", "xs"])

    return run


def _queries(kind: str):
    """A group's queries as one row: ids and vectors in one piece each."""

    def run(_, rows):
        ids = np.asarray(rows.column("vec_id"), dtype="<i8")
        x = np.frombuffer(b"".join(rows.column("x").to_pylist()), dtype="<f8")
        return pa.table({"g": rows.column("g").slice(0, 1), "qids": pa.array([ids.tobytes()], pa.binary()), "qs": pa.array([squeeze(x.astype(kind))], pa.binary())})

    return run


def products(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Exact inner products of integer-valued vectors: int64, or Python integers where they might not fit."""
    most = np.abs(q).max(initial=0) * np.abs(x).max(initial=0) * q.shape[1]
    if most < 2**53:
        return (q @ x.T).astype(np.int64)  # products and sums are exact
    if most < 2**62:
        return q.astype(np.int64) @ x.astype(np.int64).T
    whole = np.frompyfunc(int, 1, 1)
    return whole(q) @ whole(x).T


def _best(scores, ids, k: int) -> np.ndarray:
    """Places of the k highest scores, ties to the smaller id."""
    if scores.dtype != object and len(scores) > k:
        limit = np.partition(scores, len(scores) - k)[len(scores) - k]
        some = np.nonzero(scores >= limit)[0]
        return some[np.lexsort((ids[some], -scores[some]))][:k]
    return np.array(sorted(range(len(scores)), key=lambda i: (-int(scores[i]), ids[i]))[:k], dtype=np.int64)


def best_of(qi: np.ndarray, q: np.ndarray, xi: np.ndarray, x: np.ndarray, k: int, query_rows: int = 2048, data_rows: int = 2048) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, id, score) of each query's k best rows among x, itself left out; x comes in the order of xi.

    A block of products is looked into only where its largest beats a query's
    k-th best so far; of equal scores the earlier one, of smaller id, stays.
    """
    most = float(np.abs(q).max(initial=0)) * float(np.abs(x).max(initial=0)) * q.shape[1]
    if most >= 2**53:
        out = []
        for a in range(0, len(xi), data_rows):
            score = products(q, x[a : a + data_rows])
            ids = xi[a : a + data_rows]
            for row in range(len(qi)):
                top = _best(score[row], ids, k + 1)  # one may be the query's own
                top = top[ids[top] != qi[row]][:k]
                out.append((np.full(len(top), qi[row]), ids[top], score[row][top].astype(object)))
        return tuple(np.concatenate(c) for c in zip(*out, strict=True)) if out else (qi[:0], xi[:0], np.zeros(0, dtype=object))
    kind = np.float32 if most < 2**24 else np.float64  # products and sums are exact
    x = x.astype(kind)
    cuts = [0, *[c for c in (64, 512) if c < len(xi)]]
    cuts += [*range(cuts[-1] + data_rows, len(xi), data_rows), len(xi)]
    out = []
    for b in range(0, len(qi), query_rows):
        mine, own = q[b : b + query_rows].astype(kind), qi[b : b + query_rows]
        score, ids = np.full((len(own), k), -np.inf), np.full((len(own), k), NO_ID)
        for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
            s = mine @ x[lo:hi].T
            rows = np.nonzero(s.max(1, initial=-np.inf) > score[:, -1])[0]
            r, c = np.nonzero(s[rows] > score[rows, -1].astype(kind)[:, None])
            other = xi[lo + c] != own[rows[r]]
            r, c = r[other], c[other]
            held = np.repeat(np.arange(len(rows)), k)
            owner, found, at = np.concatenate([r, held]), np.concatenate([s[rows[r], c], score[rows].ravel()]), np.concatenate([xi[lo + c], ids[rows].ravel()])
            order = np.lexsort((at, -found, owner))
            owner, found, at = owner[order], found[order], at[order]
            top = np.arange(len(owner)) - np.searchsorted(owner, owner) < k
            score[rows], ids[rows] = found[top].reshape(-1, k), at[top].reshape(-1, k)
        there = np.isfinite(score)
        out.append((np.repeat(own, k).reshape(-1, k)[there], ids[there], score[there].astype(np.int64)))
    return tuple(np.concatenate(c) for c in zip(*out, strict=True)) if out else (qi[:0], xi[:0], np.zeros(0, dtype=np.int64))


def _solve(width: int, k: int, wide: bool, kind: str):
    """A group's queries against a share of the rows that it needs: the k best of each query."""

    def run(_, blocks, asked):
        if not (len(blocks) and len(asked)):
            qs, vs, ss = (np.zeros(0, dtype=np.int64),) * 3
        else:
            q = expand(asked.column("qs")[0].as_py(), kind).reshape(-1, width)
            qi = np.frombuffer(asked.column("qids")[0].as_py(), dtype="<i8")
            xi = np.concatenate([np.frombuffer(i, dtype="<i8") for i in blocks.column("ids").to_pylist()])
            x = np.concatenate([expand(v, kind).reshape(-1, width) for v in blocks.column("xs").to_pylist()])
            order = np.argsort(xi, kind="stable")
            qs, vs, ss = best_of(qi, q, xi[order], x[order], k)
        exact = [str(int(s)) for s in ss] if wide else pa.nulls(len(ss), pa.string())
        # as text, zero-filled and lifted above 0, integers of any size sort as they are
        place = [str(int(s) + 10**WIDE).zfill(WIDE + 1) for s in ss] if wide else pa.nulls(len(ss), pa.string())
        scores = pa.array([int(s) if abs(int(s)) < 2**63 else None for s in ss], pa.int64()) if wide else pa.array(ss, pa.int64())
        return pa.table({"query_id": pa.array(qs, pa.int64()), "vec_id": pa.array(vs, pa.int64()), "score": scores, "exact": pa.array(exact, pa.string()) if wide else exact, "place": pa.array(place, pa.string()) if wide else place})

    return run


def few_pivots(whole: DataFrame, n: int, wanted: int) -> list:
    """The ``wanted`` rows of smallest id hash.

    Every task would send the driver so many; only hashes under a bound that
    holds about as many rows in all are looked at, if enough rows have one.
    """
    hashed = F.xxhash64("vec_id")
    share = (wanted + 8 * math.isqrt(wanted) + 16) / max(1, n)
    if share < 1:
        picked = whole.where(hashed < int(-(2**63) + share * 2**64)).orderBy(hashed, "vec_id").limit(wanted).select("x").collect()
        if len(picked) == wanted:
            return picked
    return whole.orderBy(hashed, "vec_id").limit(wanted).select("x").collect()


def _join(vectors: DataFrame, is_query: Column, k: int, id_col: str, vector_col: str, scale: float, n_pivots: int | None, block_rows: int, query_rows: int):
    """The groups of queries and the blocks they need, each with ``g`` and ``salt``; the width and whether scores may outgrow 64 bits."""
    spark = vectors.sparkSession
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).alias("embedding"), F.coalesce(is_query, F.lit(False)).alias("is_query")).where("vec_id is not null")
    width = max(1, int(rows.agg(F.coalesce(F.max(F.size("embedding")), F.lit(0)).alias("w")).first().w))
    whole = rows.mapInArrow(_scaled(width, scale), "vec_id long, is_query boolean, n2 double, most double, x binary")
    whole = materialise(whole.groupBy("vec_id").agg(F.min(F.struct("x", "n2", "most")).alias("m"), F.max("is_query").alias("is_query")).select("vec_id", "is_query", "m.*"), "knn")
    stats = whole.agg(F.count("*").alias("n"), F.coalesce(F.max("n2"), F.lit(0.0)).alias("n2"), F.coalesce(F.max("most"), F.lit(0.0)).alias("most"), F.coalesce(F.sum(F.col("is_query").cast("long")), F.lit(0)).alias("queries")).first()
    longest, wide = math.sqrt(stats.n2) if math.isfinite(stats.n2) else math.inf, not stats.most < math.sqrt(2**62 / width)
    kind = "<i2" if stats.most < 2**15 else "<f8"
    picked = few_pivots(whole, stats.n, n_pivots or max(8, math.isqrt(max(0, stats.n - 1)) + 1))
    pivots = np.unique(np.stack([np.frombuffer(r.x, dtype="<f8") for r in picked]), axis=0) if picked else np.zeros((1, width))
    if not longest < 1e150:  # squares would overflow: one cell, which nothing is kept from
        pivots, longest = np.zeros((1, width)), 0.0
        held = spark.sparkContext.broadcast(np.zeros((1, width + 1)))
        placed = whole.selectExpr("vec_id", "is_query", "0 as cell", "0.0D as far", "0 as qcell", "0.0D as qfar", "x")
        lift = np.zeros((1, width + 1))
    else:
        lift = lifted(pivots, longest)
        held = spark.sparkContext.broadcast(lift)
        placed = materialise(whole.select("vec_id", "is_query", "x").mapInArrow(_place(width, held, longest), PLACED), "knn-placed")
        release(whole)
    # summaries: a cell's k + 1 smallest distances, and how far its queries lie; both as many as pivots
    ranked = Window.partitionBy("cell").orderBy("far")
    near = placed.select("cell", "far").withColumn("r", F.row_number().over(ranked)).where(F.col("r") <= k + 1).groupBy("cell").agg(F.collect_list("far").alias("near")).orderBy("cell").collect()
    of_queries = placed.where("is_query").groupBy("qcell").agg(F.count("*").alias("n"), F.max("qfar").alias("r")).orderBy("qcell").collect()
    reach = reaches(k, lift, [(r.cell, np.array(r.near)) for r in near], [(r.qcell, r.r) for r in of_queries])
    if not longest:
        reach = np.full(len(of_queries), np.inf)
    cells = np.array([r.qcell for r in of_queries], dtype=np.int64)
    query_rows = max(query_rows, min(8192, stats.queries // 64))
    if not longest or needed(lift, cells, reach) > 0.5:  # most rows go to every group: few groups
        query_rows = max(query_rows, min(65_536, stats.queries // 4))
    groups, parts = [], []
    for members in neighbourhoods(lift[cells], np.array([r.n for r in of_queries], dtype=np.int64), query_rows):
        # a hot cell's queries fill groups of their own
        split = max(1, -(-sum(of_queries[c].n for c in members) // query_rows)) if len(members) == 1 else 1
        parts += [(of_queries[c].qcell, len(groups), split) for c in members]
        groups += [members] * split
    table = F.broadcast(spark.createDataFrame(parts, "qcell int, base int, split int"))  # a row for each pivot at most
    asked = placed.where("is_query").select("vec_id", "qcell", "x").join(table, "qcell").select((F.col("base") + F.pmod(F.xxhash64("vec_id"), F.col("split").cast("long"))).cast("int").alias("g"), "vec_id", "x")
    salts = max(1, min(16, -(-int(stats.n) // (8 * block_rows))), -(-int(stats.n) // (128 * block_rows)))
    asked = asked.groupBy("g").applyInArrow(_queries(kind), "g int, qids binary, qs binary").withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    if longest:
        blocks = placed.select("vec_id", "x").mapInArrow(_replicate(width, held, longest, cells, reach, [np.array(g) for g in groups], block_rows, kind), "g int, number long, ids binary, xs binary")
    else:
        blocks = placed.select("vec_id", "x").mapInArrow(_whole_blocks(width, len(groups), block_rows, kind), "g int, number long, ids binary, xs binary")
    return asked, blocks.withColumn("salt", F.pmod(F.xxhash64("number", F.spark_partition_id()), F.lit(salts).cast("long")).cast("int")).drop("number"), width, wide, kind


def _whole_blocks(width: int, groups: int, block_rows: int, kind: str):
    def run(batches):
        number = 0
        for batch in batches:
            ids, x = np.asarray(batch.column("vec_id")), unpack(batch.column("x"), "<f8", width)
            for at in range(0, len(ids), block_rows):
                piece = ids[at : at + block_rows].astype("<i8").tobytes(), squeeze(x[at : at + block_rows].astype(kind).ravel())
                number += 1
                yield pa.RecordBatch.from_arrays([pa.array(range(groups), pa.int32()), pa.array([number] * groups, pa.int64()), *(pa.array([p] * groups, pa.binary()) for p in piece)], names=["g", "number", "ids", "xs"])

    return run


def share_compared(vectors: DataFrame, is_query: Column, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding", scale: float = 256.0, n_pivots: int | None = None, block_rows: int = 1024, query_rows: int = 512) -> float:
    """The share of all pairs of a query and a row that the join compares."""
    asked, blocks, *_ = _join(vectors, is_query, k, id_col, vector_col, scale, n_pivots, block_rows, query_rows)
    asked = asked.where("salt = 0").groupBy("g").agg(F.sum(F.length("qids") / 8).alias("q"))
    met = blocks.groupBy("g").agg(F.sum(F.length("ids") / 8).alias("n")).join(asked, "g").agg(F.sum(F.col("q") * F.col("n"))).first()[0] or 0.0
    every = vectors.select(F.sum(F.coalesce(is_query, F.lit(False)).cast("long")) * F.count("*")).first()[0]
    return met / max(1, every)


def top_k(vectors: DataFrame, is_query: Column, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding", scale: float = 256.0, n_pivots: int | None = None, block_rows: int = 1024, query_rows: int = 512) -> DataFrame:
    """The k rows of highest integer inner product for each query: query_id, rank, vec_id, score, exact_score.

    Components become floor(scale * x). One more component gives all rows the
    same length, so that the nearest rows are those of highest product. Rows
    and queries are grouped by their nearest pivot; pivots are the rows of
    smallest id hash, as many as the root of the rows. From the summaries of
    all cells, their k + 1 smallest distances and how far their queries lie,
    each cell of queries gets a reach. Cells of queries near each other form
    groups of about ``query_rows``; a row goes to the groups that have it within
    reach of a cell, in blocks, and each block is solved by one matrix product.
    A hot cell's queries are split over several groups, a group's blocks over
    several shares; a share passes on a query's k best. Where bounds prune
    little, groups grow with the queries, up to 65,536, and shares with the
    rows, up to 131,072: the shuffle then holds all rows once for each group
    and all queries once for each share, as 16-bit integers where they fit.

    Vectors that are null, empty or hold null or non-finite components (after
    scaling, too), and rows without an id, take no part; shorter vectors are
    filled up with zeros. Ties go to the smaller id. A query never meets a row
    of its own id; rows that repeat an id count once, by their smallest vector.
    ``score`` is exact, or null beyond 64 bits, where ``exact_score`` has it as
    text; ranks go by the exact one. Further columns are ignored.
    """
    asked, blocks, width, wide, kind = _join(vectors, is_query, k, id_col, vector_col, scale, n_pivots, block_rows, query_rows)
    solved = blocks.groupBy("g", "salt").cogroup(asked.groupBy("g", "salt")).applyInArrow(_solve(width, k, wide, kind), "query_id long, vec_id long, score long, exact string, place string")
    best = Window.partitionBy("query_id").orderBy(F.desc("place" if wide else "score"), "vec_id")
    return solved.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score", F.coalesce("exact", F.col("score").cast("string")).alias("exact_score"))


def op2_knn(spark, sf_dir: str) -> DataFrame:
    return top_k(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 50 == 0)
