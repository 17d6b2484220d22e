"""Toxicity by nearest labelled examples: exact TF-IDF cosine over a block-max inverted index."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import plain_words, slices, tidy


PREFIXES = (4, 5)


def terms_of(word: str) -> list[str]:
    """A word's terms: itself and, marked by ^, its first letters, which compounds and inflections share."""
    return [word, *("^" + word[:n] for n in PREFIXES if len(word) >= n)]


def _bags(text: pa.Array, vocabulary: dict[str, int], learn: bool = False) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Each row's known terms with their counts, and the counts of its other terms; ``learn`` makes all terms known."""
    words, lens = plain_words(text)
    coded = words.dictionary_encode()
    names: dict[str, int] = {}
    of_word = np.full((len(coded.dictionary), 1 + len(PREFIXES)), -1, dtype=np.int64)
    for k, word in enumerate(coded.dictionary.to_pylist()):
        for j, term in enumerate(terms_of(word)):
            of_word[k, j] = names.setdefault(term, len(names))
    if learn:
        for t in names:
            vocabulary.setdefault(t, len(vocabulary))
    known = np.fromiter((vocabulary.get(t, -1) for t in names), dtype=np.int64, count=len(names))
    hit = of_word[coded.indices.to_numpy(zero_copy_only=False)]
    row = np.repeat(np.arange(len(lens)), lens)
    pairs, counts = np.unique((row[:, None] * max(1, len(names)) + hit)[hit >= 0], return_counts=True)
    term, cuts = known[pairs % max(1, len(names))], np.searchsorted(pairs, np.arange(len(lens) + 1) * max(1, len(names)))
    out = []
    for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
        there = term[a:b] >= 0
        out.append((term[a:b][there].astype(np.int32), counts[a:b][there].astype(np.int32), counts[a:b][~there].astype(np.int32)))
    return out


class Weights:
    """Weight of each term: its inverse document frequency times how surely it tells the labels apart.

    The second factor is the squared log odds over its variance, z^2, as
    (z^2 / (z^2 + pull))^2, and ``floor`` at least: no term is left out, and
    terms that no example has count in a text's length at the floor.
    """

    def __init__(self, with_one: np.ndarray, with_zero: np.ndarray, ones: int, zeros: int, pull: float = 10.0, floor: float = 0.002):
        n = ones + zeros
        odds = np.log((with_one + 0.5) / (ones + 1)) - np.log((with_zero + 0.5) / (zeros + 1))
        z2 = odds**2 / (1 / (with_one + 0.5) + 1 / (with_zero + 0.5))
        tells = (z2 / (z2 + pull)) ** 2
        self.term = np.log((n + 1) / (with_one + with_zero + 0.5)) * (floor + (1 - floor) * tells)
        self.other = float(np.log((n + 1) / 0.5)) * floor

    def unit(self, terms: np.ndarray, counts: np.ndarray, others: np.ndarray) -> np.ndarray:
        """The known terms' part of the text's unit vector."""
        w = (1 + np.log(counts)) * self.term[terms]
        rest = (1 + np.log(others)) * self.other
        return w / (np.sqrt((w * w).sum() + (rest * rest).sum()) or 1.0)


def _spans(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The numbers of all spans, one span after the other."""
    return np.arange(sizes.sum(), dtype=np.int32) - np.repeat((np.cumsum(sizes) - sizes - starts).astype(np.int32), sizes)


class BlockMaxIndex:
    """Unit vectors in blocks of neighbouring rows.

    A term has postings by block, with its largest weight in each block that
    has it. Terms that ``often`` of all rows have are kept as whole rows of
    weights instead, which one matrix product reads for many queries.
    """

    def __init__(self, vectors: list[tuple[np.ndarray, np.ndarray]], n_terms: int, block: int = 256, often: float = 1 / 12):
        self.block, self.n = block, len(vectors)
        self.blocks = -(-self.n // block)
        rows = np.repeat(np.arange(self.n, dtype=np.int32), [len(t) for t, _ in vectors])
        terms = np.concatenate([np.zeros(0, dtype=np.int32), *(t for t, _ in vectors)])
        weights = np.concatenate([np.zeros(0), *(w for _, w in vectors)])
        frequent = np.bincount(terms, minlength=n_terms) > often * self.n
        self.slot = np.where(frequent, np.cumsum(frequent) - 1, -1)
        self.whole = np.zeros((int(frequent.sum()), self.n))
        of = frequent[terms]
        self.whole[self.slot[terms[of]], rows[of]] = weights[of]
        rows, terms, weights = rows[~of], terms[~of], weights[~of]
        order = np.lexsort((rows, terms))
        rows, self.weights, terms = rows[order], weights[order], terms[order]
        run = terms.astype(np.int64) * max(1, self.blocks) + rows // block
        new = np.nonzero(np.diff(run, prepend=-1))[0]
        self.rows = rows
        self.first = new.astype(np.int32)  # of each (term, block): its first posting, block and largest weight
        self.size = np.diff(np.append(new, len(run))).astype(np.int32)
        self.of_block = (rows[new] // block).astype(np.int32)
        self.most = np.maximum.reduceat(self.weights, new) if len(new) else np.zeros(0)
        self.of_term = np.searchsorted(terms[new], np.arange(n_terms + 1))

    def frequent(self, queries: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        """The frequent terms' part of each query's cosines with all rows."""
        q = np.zeros((len(queries), len(self.whole)))
        for k, (terms, w) in enumerate(queries):
            slot = self.slot[terms]
            q[k, slot[slot >= 0]] = w[slot >= 0]
        return q @ self.whole

    def nearest(self, terms: np.ndarray, w: np.ndarray, k: int, but: int = -1, frequent: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """The k rows of highest cosine above 0, ties to the earlier row.

        A block's bound is its best row by frequent terms plus the largest
        weights of the others. Blocks are scored whose bound reaches the k-th
        row's part by frequent terms: no other block can hold a better row.
        """
        if not len(terms) or not self.n:
            return np.zeros(0, dtype=np.int64), np.zeros(0)
        score = (self.frequent([(terms, w)])[0] if frequent is None else frequent).copy()
        if but >= 0:
            score[but] = 0.0
        start = self.of_term[terms]
        sizes = self.of_term[terms + 1] - start
        run, x = _spans(start, sizes), np.repeat(w, sizes)
        bound = np.maximum.reduceat(score, np.arange(0, self.n, self.block)) + np.bincount(self.of_block[run], weights=x * self.most[run], minlength=self.blocks)

        kth = np.partition(score, self.n - k)[self.n - k] if self.n > k else 0.0
        open_ = (bound >= kth - 1e-12) & (bound > 0)
        if not open_.all():
            mine = open_[self.of_block[run]]
            run, x = run[mine], x[mine]
        size = self.size[run]
        at = _spans(self.first[run], size)
        score += np.bincount(self.rows[at], weights=np.repeat(x, size) * self.weights[at], minlength=self.n)
        if but >= 0:
            score[but] = 0.0
        some = np.nonzero((score > 0) & np.repeat(open_, self.block)[: self.n])[0]
        if len(some) > k:
            limit = np.partition(score[some], len(some) - k)[len(some) - k]
            some = some[score[some] >= limit]
        top = some[np.argsort(-score[some], kind="stable")[:k]]
        return top, score[top]


class Votes:
    """The labelled examples' index with what turns neighbours into a calibrated score."""

    def __init__(self, ids: list, labels: np.ndarray, texts: pa.Array, weight: dict[int, float], k: int):
        self.vocabulary: dict[str, int] = {}
        known = [(t, c) for part in slices([pa.record_batch([texts], names=["text"])], 0, 1 << 20) for t, c, _ in _bags(part.column(0), self.vocabulary, learn=True)]
        rows = lambda label: np.bincount(np.concatenate([np.zeros(0, dtype=np.int32), *(t for (t, _), y in zip(known, labels, strict=True) if y == label)]), minlength=len(self.vocabulary))
        ones = int(labels.sum())
        self.weights, self.k = Weights(rows(1), rows(0), ones, len(labels) - ones), k
        none = np.zeros(0)
        vectors = [(t, self.weights.unit(t, c, none)) for t, c in known]
        # neighbours in order share their strongest terms, so blocks are alike and their bounds tell
        order = sorted(range(len(ids)), key=lambda i: (-labels[i], known[i][0][np.argsort(-vectors[i][1], kind="stable")[:3]].tolist(), ids[i]))
        self.ids, self.y = [ids[i] for i in order], labels[order] if len(order) else labels
        self.w = np.array([weight[v] for v in self.y.tolist()])
        vectors = [vectors[i] for i in order]
        self.index = BlockMaxIndex(vectors, len(self.vocabulary))
        self.prior = float((self.w * self.y).sum() / self.w.sum()) if len(ids) else 0.0
        raw = np.array([self.vote(*near) for near in self._nearest(vectors, itself=True)])
        self.steps = isotonic(raw, self.y, self.w)

    def vote(self, rows, cosines) -> float:
        """Mean label of the neighbours by closeness, with one neighbour's worth of the prior."""
        v = self.w[rows] * cosines / (1.05 - cosines)
        return float(((v * self.y[rows]).sum() + self.prior) / (v.sum() + 1))

    def _nearest(self, vectors, itself: bool = False):
        for a in range(0, len(vectors), 128):
            part = vectors[a : a + 128]
            for i, (v, frequent) in enumerate(zip(part, self.index.frequent(part), strict=True)):
                yield self.index.nearest(*v, self.k, but=a + i if itself else -1, frequent=frequent)

    def scores(self, bags) -> list[tuple[float, list[int]]]:
        out = []
        x, y = self.steps
        for rows, cosines in self._nearest([(t, self.weights.unit(t, c, others)) for t, c, others in bags]):
            raw = self.vote(rows, cosines)
            steady = float(np.interp(raw, x, y)) if len(x) else raw
            out.append((min(1.0, max(0.0, 0.95 * steady + 0.05 * raw)), [self.ids[r] for r in rows[:3].tolist()]))
        return out


def isotonic(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Non-decreasing fit of y on x by pooling adjacent violators: its steps' mean x and mean y."""
    pools: list[list[float]] = []
    for i in np.argsort(x, kind="stable"):
        pools.append([w[i], w[i] * y[i], w[i] * x[i]])
        while len(pools) > 1 and pools[-2][1] * pools[-1][0] >= pools[-1][1] * pools[-2][0]:
            last = pools.pop()
            pools[-1] = [a + b for a, b in zip(pools[-1], last, strict=True)]
    return np.array([p[2] / p[0] for p in pools]), np.array([p[1] / p[0] for p in pools])


def train(docs: DataFrame, labels: DataFrame, folds: int = 5, per_class: tuple[int, int] = (1_000, 2_000), class_bytes: int = 16 << 20, k: int = 24) -> Votes:
    """Learn from labelled rows: of each class (0 and 1) those of smallest id hash, at most ``per_class`` and ``class_bytes`` of text (documented bounds, one row at least).

    Rows whose crc32(doc_id as text) mod ``folds`` is 0 are held out; where an
    id has several labels the larger counts. Every term of these rows is in the
    index.
    """
    fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % folds
    marked = labels.select(F.col("doc_id").cast("long").alias("doc_id"), (F.col("toxic").cast("int") > 0).cast("int").alias("y")).where("doc_id is not null and y is not null").groupBy("doc_id").agg(F.max("y").alias("y")).where(fold != 0)
    totals = {0: 0, 1: 0} | {r.y: r["count"] for r in marked.groupBy("y").count().collect()}
    place = [F.xxhash64("doc_id"), F.col("doc_id")]
    picked = [marked.where(F.col("y") == c).orderBy(*place).limit(per_class[c]) for c in (1, 0)]
    chosen = F.broadcast(picked[0].unionByName(picked[1]))  # at most per_class pairs of numbers
    found = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).join(chosen, "doc_id")
    # an id may be on many rows
    kept = [found.where(F.col("y") == c).orderBy(*place, F.xxhash64("text")).limit(per_class[c]) for c in (1, 0)]
    before = Window.partitionBy("y").orderBy(*place, F.xxhash64("text")).rowsBetween(Window.unboundedPreceding, -1)
    sample = kept[0].unionByName(kept[1]).withColumn("ahead", F.coalesce(F.sum(F.octet_length("text")).over(before), F.lit(0))).where(F.col("ahead") < class_bytes)
    rows = sample.select("doc_id", "y", "text").toArrow().sort_by([("doc_id", "ascending"), ("text", "ascending")])
    y = np.asarray(rows.column("y"), dtype=np.int64)
    weight = {c: totals[c] / max(1, int((y == c).sum())) for c in (0, 1)}
    return Votes(rows.column("doc_id").to_pylist(), y, rows.column("text").combine_chunks(), weight, k)


def _score(votes):
    def run(batches):
        model = votes.value
        for batch in slices(batches, 0, 2 << 20):
            scored = model.scores(_bags(batch.column(0), model.vocabulary))
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array([s for s, _ in scored], pa.float64()), pa.array([near for _, near in scored], pa.list_(pa.int64()))], names=["row", "score", "evidence"])

    return run


def _scored(docs: DataFrame, labels: DataFrame, columns: list[str], folds: int, options: dict) -> DataFrame:
    """``columns`` as one struct ``row``, beside score and evidence: no name can clash."""
    votes = docs.sparkSession.sparkContext.broadcast(train(docs, labels, folds, **options))
    tidy(docs.sparkSession)
    rows = docs.select(F.col("text").cast("string").alias("text"), F.struct(*[F.col(f"`{c}`") for c in columns]).alias("row"))
    return rows.mapInArrow(_score(votes), T.StructType([rows.schema["row"], T.StructField("score", T.DoubleType()), T.StructField("evidence", T.ArrayType(T.LongType()))]))


def score_toxicity(docs: DataFrame, labels: DataFrame, folds: int = 5, **options) -> DataFrame:
    """Score every whole text: doc_id, held_out, score, predicted, evidence.

    ``score`` is the calibrated vote of the k labelled examples of highest
    cosine (isotonic on leave-one-out votes, sampling corrected), ``evidence``
    the ids of the closest three, ``predicted`` whether the score reaches 0.5.
    Vectors hold all terms, by ``Weights``: words in lower case without
    punctuation at their edges, and their first letters. Texts that share no term with an example, null and
    empty ones included, get what no vote gives. Null ids are held out; repeated
    rows give a row each; labels that are null are ignored, of an id's labels
    the larger is taken; without labels every score is 0. Further columns are
    ignored, whatever their names. A text is scored whole at any length. The
    index is broadcast; its size is bounded by the parameters of ``train``.
    """
    out = _scored(docs, labels, ["doc_id"], folds, options).withColumn("doc_id", F.col("row.doc_id"))
    held = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % folds == 0
    return out.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "evidence")


def without_toxic(docs: DataFrame, labels: DataFrame, folds: int = 5, **options) -> DataFrame:
    """The rows of ``docs`` whose score stays below 0.5, with all their columns as they are."""
    out = _scored(docs, labels, docs.columns, folds, options).where("score < 0.5")
    return out.select(*[F.col("row").getField(c).alias(c) for c in docs.columns])


def op5_toxicity(spark, sf_dir: str) -> DataFrame:
    return score_toxicity(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
