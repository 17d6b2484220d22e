"""Near-duplicate documents by ProbMinHash, banding and exact verification."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import connected_components, hash_words, materialise, mix, mix_in_place, plain_words, slices

GOLDEN = 0x9E3779B97F4A7C15
BANDS, ROWS = 25, 5
M = BANDS * ROWS


def shingles(text: pa.Array, width: int = 5) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct word shingles of each row, with counts, and a 128-bit key of each row's word sequence.

    Returns row, hash, count and keys (two columns). A row of fewer words than
    ``width`` has one shingle of all of them; a row without words has none.
    """
    words, lens = plain_words(text)
    coded = words.dictionary_encode()
    h = hash_words(coded.dictionary)[coded.indices.to_numpy(zero_copy_only=False)] if len(words) else np.zeros(0, dtype=np.uint64)
    n = len(h)
    row = np.repeat(np.arange(len(lens)), lens)
    ends = np.cumsum(lens)
    at = np.arange(n) - (ends - lens)[row]
    keys = np.zeros((len(lens), 2), dtype=np.uint64)
    with np.errstate(over="ignore"):
        for c in range(2):
            part = mix(h + mix((at.astype(np.uint64) + np.uint64(c + 1)) * np.uint64(GOLDEN)) + np.uint64(c))
            total = np.concatenate([np.zeros(1, dtype=np.uint64), np.cumsum(part, dtype=np.uint64)])
            keys[:, c] = total[ends] - total[ends - lens]
        acc = h.copy()
        for j in range(1, width):
            following = np.zeros(n, dtype=np.uint64)
            following[: max(0, n - j)] = h[j:]
            inside = at + j < lens[row]
            acc = mix_in_place(acc * np.uint64(31) + np.where(inside, following, np.uint64(j)) + np.uint64(j))
    starts = at + width <= np.maximum(lens[row], width)
    first = at == 0
    use = np.where(lens[row] >= width, starts, first)
    row, acc = row[use], acc[use]
    order = np.lexsort((acc, row))
    row, acc = row[order], acc[order]
    new = np.ones(len(row), dtype=bool)
    new[1:] = (row[1:] != row[:-1]) | (acc[1:] != acc[:-1])
    where = np.nonzero(new)[0]
    return row[where], acc[where], np.diff(np.append(where, len(row))), keys


def prob_minhash(row: np.ndarray, element: np.ndarray, weight: np.ndarray, n_rows: int, m: int = M) -> np.ndarray:
    """ProbMinHash (Ertl 2022, first form) of weighted sets: the winning element of each of m registers, per row.

    Each element arrives by a Poisson process at the rate of its weight, seeded
    by the element alone; an arrival goes to a random register, which keeps the
    earliest. An element stops once its next arrival is later than all of its
    row's registers. All rows advance together, one arrival a round.
    """
    earliest, winner = np.full(n_rows * m, np.inf), np.zeros(n_rows * m, dtype=np.uint64)
    latest = np.full(n_rows, np.inf)
    r, h, w = row, element, weight.astype(np.float64)
    t, step = np.zeros(len(row)), 0
    while len(r):
        step += 1
        with np.errstate(over="ignore"):
            u = mix_in_place(h + np.uint64(step) * np.uint64(GOLDEN))
        t = t - np.log(((u >> np.uint64(11)).astype(np.float64) + 1.0) * 2.0**-53) / w
        live = t <= latest[r]
        r, h, w, t, u = r[live], h[live], w[live], t[live], u[live]
        slot = r * m + (mix_in_place(u) % np.uint64(m)).astype(np.int64)
        np.minimum.at(earliest, slot, t)
        won = t == earliest[slot]
        winner[slot[won]] = h[won]
        rows = np.unique(r) if len(r) < n_rows else slice(None)
        latest[rows] = earliest.reshape(n_rows, m)[rows].max(1)
        live = t < latest[r]
        r, h, w, t = r[live], h[live], w[live], t[live]
    return winner.reshape(n_rows, m)


def probability_jaccard(x: np.ndarray, a: np.ndarray, y: np.ndarray, b: np.ndarray) -> float:
    """Probability Jaccard of two weighted sets: sorted elements and their weights, whose scale is no matter.

    The sum over common d of 1 / sum over all e of max(a_e / a_d, b_e / b_d)
    (Moulton and Jiang 2018). Common elements in order of a / b: from d on the
    first term is the larger, before it the second.
    """
    at = np.minimum(np.searchsorted(y, x), len(y) - 1)
    both = y[at] == x
    p, q = a[both], b[at[both]]
    only_x, only_y = a.sum() - p.sum(), b.sum() - q.sum()
    if (p == q).all():
        return float(p.sum() / max(p.sum() + only_x + only_y, 1e-300))
    order = np.argsort(p / q, kind="stable")
    p, q = p[order], q[order]
    from_here = only_x + np.cumsum(p[::-1])[::-1]
    before = only_y + np.cumsum(q) - q
    return float((1.0 / (from_here / p + before / q)).sum())


def weights(count: np.ndarray) -> np.ndarray:
    """Weight of a shingle by its count in the text, damped: a line repeated often doesn't outweigh all others."""
    return 1.0 + np.log(count)


def _sign(batches):
    for batch in slices(batches, 1, 3 << 20):
        row, element, count, keys = shingles(batch.column(1))
        n = batch.num_rows
        size = np.bincount(row, minlength=n)
        winner = mix(prob_minhash(row, element, weights(count), n))
        bands = np.zeros((n, BANDS), dtype=np.uint64)
        with np.errstate(over="ignore"):
            for j in range(ROWS):
                bands = mix_in_place(bands * np.uint64(31) + winner[:, j::ROWS] + np.arange(BANDS, dtype=np.uint64))
        some = size > 0
        offsets = np.concatenate([[0], np.cumsum(np.where(some, BANDS, 0))])
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(keys[:, 0].view(np.int64)), pa.array(keys[:, 1].view(np.int64)), pa.array(size, pa.int64()), pa.array([x.tobytes() for x in winner.astype(np.uint8)], pa.binary()), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(bands[some].ravel().view(np.int64)))],
            names=["doc_id", "k1", "k2", "n", "sig", "bands"],
        )


def _sets(batches):
    """Each row's shingles, and their counts where one is above 1."""
    for batch in slices(batches, 1, 3 << 20):
        row, element, count, _ = shingles(batch.column(1))
        cuts = np.searchsorted(row, np.arange(batch.num_rows + 1)).tolist()
        count = count.astype("<u4")
        spans = list(zip(cuts[:-1], cuts[1:], strict=True))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([element[a:b].tobytes() for a, b in spans], pa.binary()), pa.array([count[a:b].tobytes() if (count[a:b] > 1).any() else b"" for a, b in spans], pa.binary())], names=["doc_id", "shingles", "counts"])


def _weighted(elements, counts) -> tuple[np.ndarray, np.ndarray]:
    x = np.frombuffer(elements, dtype=np.uint64)
    return x, weights(np.frombuffer(counts, dtype="<u4")) if len(counts) else np.ones(len(x))


def _verify(threshold: float):
    def run(batches):
        for batch in batches:
            kept = []
            for a, m, b, n in zip(*(batch.column(k) for k in ("su", "cu", "sv", "cv")), strict=True):
                kept.append(probability_jaccard(*_weighted(a.as_buffer(), m.as_buffer()), *_weighted(b.as_buffer(), n.as_buffer())) >= threshold - 1e-9)
            mask = pa.array(kept, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(mask), batch.column(1).filter(mask)], names=["u", "v"])

    return run


def _runs(rows):
    """The buckets of a group: positions of the rows to compare, on the left and the right, with a block's signature agreement."""
    side = np.asarray(rows.column("side"))
    bucket = np.unique(np.asarray(rows.column("band")), return_inverse=True)[1].ravel()
    order = np.argsort(bucket, kind="stable")
    bounds = np.concatenate([[0], np.cumsum(np.bincount(bucket))])
    for a, b in zip(bounds[:-1], bounds[1:], strict=True):
        mine = order[a:b]
        yield (mine, mine) if (side[mine] == 0).all() else (mine[side[mine] == 1], mine[side[mine] == 2])


def _agreement(sig: np.ndarray, left: np.ndarray, right: np.ndarray):
    step = max(1, (16 << 20) // max(1, len(right) * M))
    for s in range(0, len(left), step):
        yield left[s : s + step], (sig[left[s : s + step]][:, None, :] == sig[right][None, :, :]).sum(2, dtype=np.int32)


def _signatures(rows) -> np.ndarray:
    return np.frombuffer(b"".join(rows.column("sig").to_pylist()), dtype=np.uint8).reshape(-1, M)


def _propose(least: float, most: int = 2):
    """For each row of a bucket, the few rows of other components whose signatures agree best with its own."""

    def run(_, rows):
        rep, component, sig = np.asarray(rows.column("rep")), np.asarray(rows.column("component")), _signatures(rows)
        us, vs = [np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype=np.int64)]
        for left, right in _runs(rows):
            for l, agree in _agreement(sig, left, right):
                agree[component[l][:, None] == component[right][None, :]] = 0
                best = np.argsort(-agree, axis=1, kind="stable")[:, :most]
                i = np.repeat(np.arange(len(l)), best.shape[1])
                j = best.ravel()
                good = agree[i, j] >= least * M
                us.append(rep[l[i[good]]])
                vs.append(rep[right[j[good]]])
        u, v = np.concatenate(us), np.concatenate(vs)
        pairs = np.unique(np.stack([np.minimum(u, v), np.maximum(u, v)], 1), axis=0)
        return pa.table({"u": pa.array(pairs[:, 0]), "v": pa.array(pairs[:, 1])})

    return run


def _settle(least: float, threshold: float):
    """The links between components within each bucket: every cross pair that agrees enough is verified here, in the first band it shares, until its components are one."""

    def run(_, rows):
        rep, component, sig = np.asarray(rows.column("rep")), np.asarray(rows.column("component")).copy(), _signatures(rows)
        band = np.asarray(rows.column("band"))
        bands = np.asarray(rows.column("bands").combine_chunks().flatten()).reshape(-1, BANDS)
        sets = [_weighted(x, n) for x, n in zip(rows.column("shingles").to_pylist(), rows.column("counts").to_pylist(), strict=True)]
        us, vs = [], []
        for left, right in _runs(rows):
            # the rows outside the largest component look for links; within one chunk pair either side may be the larger
            both = np.concatenate([left, right])
            names, n = np.unique(component[both], return_counts=True)
            outside = left[component[left] != names[n.argmax()]]
            inside, across = (right, None) if left is right else (right, right[component[right] != names[n.argmax()]])
            for seek, pool in ((outside, inside), (across, left)) if across is not None else ((outside, inside),):
                for l, agree in _agreement(sig, seek, pool):
                    for k, x in enumerate(l.tolist()):
                        ys = np.nonzero((agree[k] >= least * M) & (component[pool] != component[x]))[0]
                        ys = pool[ys[np.argsort(-agree[k][ys], kind="stable")]]
                        same = bands[ys] == bands[x]
                        ys = ys[bands[x][same.argmax(1)] == band[x]] if len(ys) else ys
                        mine, own = sets[x]
                        while len(ys):
                            part, ys = ys[:64], ys[64:]
                            theirs = [sets[y] for y in part.tolist()]
                            ends = np.cumsum([0, *(len(e) for e, _ in theirs)])[:-1]
                            flat, w = (np.concatenate(c) for c in zip(*theirs, strict=True))
                            at = np.minimum(np.searchsorted(mine, flat), len(mine) - 1)
                            # no pair is more alike than the share of its common weight
                            common = np.add.reduceat((mine[at] == flat) * w, ends) / np.add.reduceat(w, ends)
                            for k2 in np.nonzero(common >= threshold - 1e-9)[0].tolist():
                                y = int(part[k2])
                                if component[y] != component[x] and probability_jaccard(mine, own, *theirs[k2]) >= threshold - 1e-9:
                                    us.append(rep[x])
                                    vs.append(rep[y])
                                    component[component == component[y]] = component[x]
                            ys = ys[component[ys] != component[x]]
        return pa.table({"u": pa.array(us, pa.int64()), "v": pa.array(vs, pa.int64())})

    return run


def near_duplicates(docs: DataFrame, threshold: float = 0.8, id_col: str = "doc_id", text_col: str = "text", chunk_rows: int = 2048, chunk_bytes: int = 32 << 20, group_rows: int = 512) -> DataFrame:
    """Classes of documents linked by a probability Jaccard of ``threshold`` or more: doc_id, class_id, kept, n_rows.

    Sets are 5-word shingles, each weighted by 1 + ln of how often the text has it.
    ``class_id`` is the smallest id reachable by links, ``kept`` whether it is
    the row's own, ``n_rows`` how many rows share the id. Words are lower-cased,
    split at white space and bared of punctuation at their edges.

    Equal word sequences collapse to the smallest id. ProbMinHash signatures of
    125 registers, each equal in two texts with the chance of their probability
    Jaccard, give 25 bands of 5. Each bucket first proposes a star around its
    smallest id, which the weighted sets verify exactly. Buckets that still hold
    several components go on: first each row's two best agreeing partners in
    other components, then, inside the bucket and without emitting pairs, all
    cross-component pairs whose signatures agree in 0.6 of the registers, over
    five standard errors below the threshold. Pairs within a component need no
    test, so a large group of copies costs its star and not its square. Buckets
    are dealt out as pairs of chunks of at most ``chunk_rows`` rows and
    ``chunk_bytes`` of sets, none is capped; small ones share groups of about
    ``group_rows`` rows, so what a task holds doesn't grow with the input.

    Null and empty texts link with nothing; a text of any length counts whole.
    Rows with a null id come back with a null class, kept. An id on several rows
    has the links of all its texts and comes back once. Further columns are
    ignored.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    some = rows.where("doc_id is not null")
    signed = materialise(some.mapInArrow(_sign, "doc_id long, k1 long, k2 long, n long, sig binary, bands array<long>"), "pmh")
    words = signed.where("n > 0")
    # a table of its own: AQE splits a skewed join only where no aggregate stands between it and the exchange
    members = materialise(words.groupBy("k1", "k2").agg(F.min("doc_id").alias("rep"), F.count("*").alias("many")).where("many > 1").drop("many"), "pmh-members")
    copies = words.select("doc_id", "k1", "k2").join(members, ["k1", "k2"]).where("doc_id <> rep").select(F.col("doc_id").alias("u"), F.col("rep").alias("v"))
    links = materialise(copies, "pmh-copies")
    firsts = words.groupBy("k1", "k2").agg(F.min_by(F.struct("doc_id", "n", "sig", "bands"), "doc_id").alias("r")).select("r.*").withColumnRenamed("doc_id", "rep")
    firsts = materialise(firsts, "pmh-reps")
    banded = firsts.select("rep", "n", F.explode("bands").alias("band"))
    shared = banded.groupBy("band").agg(F.min("rep").alias("centre"), F.count("*").alias("many")).where("many > 1")
    buckets = materialise(banded.join(shared, "band"), "pmh-buckets")
    tested = materialise(buckets.where("rep <> centre").select(F.col("centre").alias("u"), F.col("rep").alias("v")).distinct(), "pmh-pairs")

    # one shuffle of the texts at every size, for all that meet in a bucket
    ends = buckets.select(F.col("rep").alias("doc_id")).distinct()
    sets = materialise(some.join(ends.hint("merge"), "doc_id", "left_semi").mapInArrow(_sets, "doc_id long, shingles binary, counts binary"), "pmh-sets", "lz4")

    def verified(pairs: DataFrame) -> DataFrame:
        right = pairs.join(sets.select(F.col("doc_id").alias("v"), F.col("shingles").alias("sv"), F.col("counts").alias("cv")), "v")
        both = right.join(sets.select(F.col("doc_id").alias("u"), F.col("shingles").alias("su"), F.col("counts").alias("cu")), "u").select("u", "v", "su", "cu", "sv", "cv")
        return materialise(both.mapInArrow(_verify(threshold), "u long, v long"), "pmh-links")

    links = links.unionByName(verified(tested))
    component = materialise(connected_components(links), "pmh-components")
    for last in (False, True):
        placed = buckets.join(component, buckets.rep == component.node, "left").select("rep", "band", "n", F.coalesce("component", "rep").alias("component"))
        many = F.col("many")
        # a few hundred rows a chunk in middling buckets, so that tasks are even; chunk_rows in large ones
        chunks = F.greatest(F.ceil(many / chunk_rows), F.least(F.lit(8), F.ceil(many / (chunk_rows / 8))))
        if last:
            chunks = F.greatest(chunks, F.ceil(12 * F.col("size") / chunk_bytes))
        open_ = placed.groupBy("band").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.count("*").alias("many"), F.sum("n").alias("size")).where("low < high").select("band", chunks.cast("int").alias("chunks"))
        rows_open = materialise(placed.join(open_, "band"), "pmh-open")
        held = rows_open.agg(F.count("*").alias("rows"), F.coalesce(F.sum("n"), F.lit(0)).alias("size")).first()
        if not held.rows:
            break
        full = rows_open.drop("n").join(firsts.drop("n"), "rep")
        if last:
            full = full.join(sets.withColumnRenamed("doc_id", "rep"), "rep")
        else:
            full = full.withColumns({"shingles": F.lit(None).cast("binary"), "counts": F.lit(None).cast("binary")})
        pair = F.transform(F.sequence(F.lit(0), F.col("chunks") - 1), lambda o: F.struct(F.least(F.col("c"), o).alias("a"), F.greatest(F.col("c"), o).alias("b"), F.when(F.col("c") == o, 0).when(F.col("c") < o, 1).otherwise(2).alias("side")))
        dealt = full.withColumn("c", F.pmod(F.xxhash64("rep"), F.col("chunks").cast("long")).cast("int")).withColumn("p", F.explode(pair)).select("rep", "component", "sig", "bands", "shingles", "counts", "band", "chunks", "p.*")
        n = max(4, -(-held.rows // group_rows), -(-12 * held.size // chunk_bytes) if last else 0)
        dealt = dealt.withColumn("g", F.when(F.col("chunks") > 1, F.col("band")).otherwise(F.pmod(F.col("band"), F.lit(n).cast("long")))).groupBy("g", "a", "b")
        if last:
            new = materialise(dealt.applyInArrow(_settle(0.6, threshold), "u long, v long").distinct(), "pmh-last")
        else:
            more = materialise(dealt.applyInArrow(_propose(0.6), "u long, v long").distinct().join(tested, ["u", "v"], "left_anti"), "pmh-more")
            new = verified(more)
        links = links.unionByName(new)
        component = materialise(connected_components(links), "pmh-components")
    out = signed.groupBy("doc_id").agg(F.count("*").alias("n_rows")).join(component, F.col("doc_id") == component.node, "left").select("doc_id", F.coalesce("component", "doc_id").alias("class_id"), "n_rows")
    out = out.unionByName(rows.where("doc_id is null").select("doc_id", F.col("doc_id").alias("class_id"), F.lit(1).cast("long").alias("n_rows")))
    return out.select("doc_id", "class_id", F.col("doc_id").eqNullSafe(F.col("class_id")).alias("kept"), "n_rows")


#: Ids up to which a list of rows to leave out is broadcast: 16 MB of numbers.
FEW_IDS = 2_000_000


def _held(ids: DataFrame) -> DataFrame:
    return F.broadcast(ids) if ids.limit(FEW_IDS + 1).count() <= FEW_IDS else ids


def without_near_duplicates(docs: DataFrame, threshold: float = 0.8) -> DataFrame:
    """One row of each class of near-duplicates, with all its columns as they are: that of the smallest id.

    Rows without an id stand behind those with one, under a number made from
    their text, so copies among them go as well. Rows of one id, equal or not,
    are one class, of which one row stays: the one of smallest text.
    """
    number = F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit(""))).bitwiseAND(F.lit((1 << 62) - 1).cast("long")).bitwiseOR(F.lit(1 << 62).cast("long"))
    key = F.coalesce(F.col("doc_id").cast("long"), number)
    rows = docs.select(key.alias("key"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    classes = materialise(near_duplicates(docs.select(key.alias("doc_id"), F.col("text").cast("string").alias("text")), threshold).select(F.col("doc_id").alias("key"), "kept", "n_rows"), "pmh-classes")
    left = rows.join(_held(classes.where("not kept").select("key")), "key", "left_anti")
    repeated = classes.where("kept and n_rows > 1").select("key")
    if repeated.limit(1).count():
        repeated = _held(repeated)
        one = left.join(repeated, "key", "left_semi").groupBy("key").agg(F.min_by("row", F.struct(F.col("row.text").cast("string"), F.xxhash64("row"))).alias("row"))
        left = left.join(repeated, "key", "left_anti").select("key", "row").unionByName(one.select("key", "row"))
    return left.select(*[F.col("row").getField(c).alias(c) for c in docs.columns])


def op9_near_documents(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
