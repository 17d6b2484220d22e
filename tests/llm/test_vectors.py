import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from lodestrata.llm import itq, knn


def brute_top(rows, k):
    """rows: (id, components or None, is_query)."""
    good = {}
    for i, v, q in rows:
        if i is not None and v and all(x is not None and np.isfinite(x) for x in v):
            good[i] = ([int(np.floor(256.0 * float(np.float32(x)))) for x in v], q)
    width = max((len(v) for v, _ in good.values()), default=1)
    ids = sorted(good)
    m = np.array([good[i][0] + [0] * (width - len(good[i][0])) for i in ids], dtype=np.int64)
    out = set()
    for n, i in enumerate(ids):
        if good[i][1]:
            best = sorted((-int(s), j) for s, j in zip(m @ m[n], ids, strict=True) if j != i)[:k]
            out |= {(i, r + 1, j, -s) for r, (s, j) in enumerate(best)}
    return out


def got_top(df):
    return {(r.query_id, r.rank, r.vec_id, r.score) for r in df.collect()}


def test_knn_whole_table(spark, sf_dir):
    t = pq.read_table(f"{sf_dir}/embeddings.parquet").to_pydict()
    assert got_top(knn.op2_knn(spark, sf_dir)) == brute_top([(i, v, i % 50 == 0) for i, v in zip(t["vec_id"], t["embedding"], strict=True)], 5)


def test_knn_ties_nulls_hot_vector(spark):
    rng = np.random.default_rng(1)
    rows = [(i, [1.0, 0.5, -0.25] if i % 3 == 0 else [float(x) for x in rng.standard_normal(3)], i % 7 == 0) for i in range(400)]
    rows += [(1000, None, True), (1001, [], True), (1002, [1.0, None, 2.0], True), (1003, [float("nan"), 1.0, 1.0], False), (1004, [float("inf"), 1.0, 1.0], True), (None, [9.0, 9.0, 9.0], True), (1005, [3.0], True), (1006, [0.0, 0.0, 0.0], True)]
    df = spark.createDataFrame([(*r, "c", 1.0) for r in rows], "vec_id long, embedding array<float>, q boolean, cell string, far double")
    assert got_top(knn.top_k(df, F.col("q"), k=5, n_pivots=6, block_rows=16, query_rows=4)) == brute_top(rows, 5)
    assert got_top(knn.top_k(df.where("vec_id < 3"), F.col("q"), k=5)) == brute_top([r for r in rows if r[0] in (0, 1, 2)], 5)
    assert knn.top_k(df.limit(0), F.col("q")).count() == 0


def test_knn_huge_numbers_repeats(spark):
    rows = [(0, [1e10, 3.0], True), (1, [1e10, 1e10], False), (2, [-1e10, 2.0], False), (3, [1.0, 1.0], False), (7, [1e300, 1.0], False), (8, [1e307, 0.0], True), (9, [1e305, -1.0], True), (4, [2.0, 2.0], True)]
    df = spark.createDataFrame([(i, v, q) for i, v, q in [*rows, (4, [2.5, -8.0], False), (3, [1.0, 1.0], False)]], "vec_id long, embedding array<double>, q boolean")
    good = {i: ([int(np.floor(256.0 * x)) for x in v], q) for i, v, q in rows if i != 8}  # 256e307 is beyond a double
    good[4] = (min([512, 512], [640, -2048], key=lambda v: np.array(v, dtype="<f8").tobytes()), True)
    want = {}
    for i, (v, q) in good.items():
        if q:
            ranked = sorted((-sum(a * b for a, b in zip(v, w, strict=True)), j) for j, (w, _) in good.items() if j != i)[:3]
            want |= {(i, r + 1): (j, str(-s)) for r, (s, j) in enumerate(ranked)}
    got = knn.top_k(df, F.col("q"), k=3).collect()
    assert {(r.query_id, r.rank): (r.vec_id, r.exact_score) for r in got} == want
    assert all((r.score is None) == (abs(int(r.exact_score)) >= 2**63) and r.score in (None, int(r.exact_score)) for r in got)


def test_knn_compares_less_of_more_rows(spark):
    rng = np.random.default_rng(8)
    shares = []
    for n in (500, 2000, 8000):
        x = rng.standard_normal((40, 8))[rng.integers(0, 40, n)] * 3 + rng.standard_normal((n, 8)) * 0.05
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        df = spark.createDataFrame([(i, [float(c) for c in v]) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
        shares.append(knn.share_compared(df, F.col("vec_id") % 50 == 0, scale=4096.0, query_rows=8))
        if n == 2000:
            whole = np.floor(4096.0 * x).astype(np.int64)
            score = whole[::50] @ whole.T
            for k, i in enumerate(range(0, n, 50)):
                score[k, i] = -(2**62)
            want = {(50 * k, r + 1, int(j), int(s[j])) for k, s in enumerate(score) for r, j in enumerate(np.lexsort((np.arange(n), -s))[:5])}
            assert got_top(knn.top_k(df, F.col("vec_id") % 50 == 0, scale=4096.0, query_rows=8)) == want
    assert shares[0] > shares[1] > shares[2] and shares[2] < 0.2


def brute_links(rows, threshold):
    good = {i: (l, np.array(v, dtype=np.float64)) for i, v, l in rows if i is not None and l is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)}
    ids = sorted(good)
    links = {i: set() for i, _, _ in rows}
    for n, i in enumerate(ids):
        for j in ids[n + 1 :]:
            (la, a), (lb, b) = good[i], good[j]
            if la == lb and len(a) == len(b) and a @ b / (np.linalg.norm(a) * np.linalg.norm(b)) >= threshold:
                links[i].add(j)
                links[j].add(i)
    out = {}
    for i in links:
        seen, todo = {i}, [i]
        while todo:
            for j in links[todo.pop()]:
                if j not in seen:
                    seen.add(j)
                    todo.append(j)
        out[i] = (len(links[i]), min((x for x in seen if x is not None), default=None))
    return out


def test_itq_whole_table(spark, sf_dir):
    t = pq.read_table(f"{sf_dir}/embeddings.parquet").to_pydict()
    want = brute_links(list(zip(t["vec_id"], t["embedding"], t["label"], strict=True)), 0.93)
    got = {r.vec_id: r for r in itq.op8_near_vectors(spark, sf_dir).collect()}
    assert {i: (r.n_links, r.component_id) for i, r in got.items()} == want
    assert all(r.kept == (r.vec_id == r.component_id) for r in got.values())


@pytest.fixture(scope="module")
def clustered():
    rng = np.random.default_rng(3)
    centres = rng.standard_normal((30, 24))
    rows = []
    for i in range(600):
        c = centres[i % 30] if i % 3 else centres[0]
        v = c * rng.uniform(0.5, 2) + rng.standard_normal(24) * rng.choice([0.0, 0.05, 0.2, 0.3])
        rows.append((i, [float(np.float32(x)) for x in v], int(i % 2)))
    return rows


def test_itq_recall_and_precision(spark, clustered):
    extra = [(900, None, 0), (901, [0.0] * 24, 0), (902, [float("nan")] * 24, 1), (903, clustered[0][1], None), (904, clustered[0][1], clustered[0][2]), (905, [], 1)]
    rows = clustered + extra
    df = spark.createDataFrame([(*r, 5, "x") for r in rows], "vec_id long, embedding array<float>, label int, copies int, rep string")
    got = {r.vec_id: r for r in itq.near_duplicates(df, chunk_rows=20, bucket_rows=4).collect()}
    want = brute_links(rows, 0.93)
    assert set(got) == set(want)
    found, there = sum(r.n_links for r in got.values()), sum(n for n, _ in want.values())
    assert all(got[i].n_links <= n for i, (n, _) in want.items())
    assert found >= 0.97 * there
    assert sum(got[i].component_id == c for i, (_, c) in want.items()) >= 0.97 * len(want)
    for i in (900, 901, 902, 903, 905):
        assert (got[i].n_links, got[i].component_id, got[i].kept) == (0, i, True)
    assert itq.near_duplicates(df.limit(0)).count() == 0


def test_itq_pairs_about_the_threshold(spark):
    """Cosines within the grid's error of the threshold are settled by the vectors themselves."""
    rng = np.random.default_rng(12)
    rows = []
    for i in range(150):
        a = rng.standard_normal(32)
        b = itq.partners(itq.unit(a[None]), 0.93 + float(rng.choice([-1, 1])) * float(rng.choice([1e-9, 1e-5, 1e-4, 1e-2])), rng.standard_normal((1, 32)))[0]
        rows += [(2 * i, a.tolist(), 1), (2 * i + 1, (b * 7).tolist(), 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = {r.vec_id: (r.n_links, r.component_id) for r in itq.near_duplicates(df, bucket_rows=300).collect()}
    want = brute_links(rows, 0.93)
    assert all(got[i][0] <= want[i][0] for i in got)
    assert sum(got[i] == want[i] for i in got) >= 0.98 * len(got)


def test_itq_recall_where_vectors_share_a_direction():
    rng = np.random.default_rng(13)
    far = rng.standard_normal(64)
    far *= 0.9 / np.linalg.norm(far)
    y = itq.unit(far + rng.standard_normal((6000, 64)) * (0.43 / 8))
    few = itq.enough_tables(itq.unit(rng.standard_normal((6000, 64))), 8, 0.93, 0.95)[1]
    rotations, tables = itq.enough_tables(y, 8, 0.93, 0.95)
    assert tables > few  # centred codes part such pairs more often
    fresh = y[3000:5000]
    other = itq.partners(fresh, 0.93, rng.standard_normal(fresh.shape))
    a, b = (itq._signs(v, rotations)[:, : tables * 8].reshape(len(fresh), tables, 8) for v in (fresh, other))
    assert (a == b).all(2).any(1).mean() > 0.9


def test_repeated_ids_give_one_result(spark):
    rows = [(i % 40, [float(x) for x in np.random.default_rng(i).standard_normal(6)], i % 2) for i in range(120)]
    results = []
    for order in (rows, rows[::-1]):
        df = spark.createDataFrame(order, "vec_id long, embedding array<double>, label int").repartition(7)
        results.append((sorted(map(tuple, itq.near_duplicates(df).collect())), sorted(map(tuple, knn.top_k(df, F.col("vec_id") % 4 == 0).collect()))))
    assert results[0] == results[1]


def test_knn_pivots_reach_the_driver_once(spark, monkeypatch):
    """The tasks together send the driver few more rows than the pivots, and those are the rows of smallest id hash."""
    whole = spark.range(0, 40_000, 1, 40).select(F.col("id").alias("vec_id"), F.col("id").cast("string").cast("binary").alias("x"))
    sent = []
    limit = type(whole).limit
    monkeypatch.setattr(type(whole), "limit", lambda self, n: (sent.append(self.groupBy(F.spark_partition_id().alias("p")).count().agg(F.sum(F.least("count", F.lit(n)))).collect()[0][0]), limit(self, n))[1])
    got = [bytes(r.x) for r in knn.few_pivots(whole, 40_000, 200)]
    monkeypatch.undo()
    assert sent == [sent[0]] and sent[0] < 400
    assert got == [bytes(r.x) for r in whole.orderBy(F.xxhash64("vec_id"), "vec_id").limit(200).collect()]
    assert len(knn.few_pivots(whole.where("vec_id < 5"), 40_000, 200)) == 5


@pytest.mark.parametrize("top", [1, 40, 2000, 60_000_000, 2**40])
def test_best_of_equals_brute_force(top):
    """Ties, all equal rows, rising scores and numbers beyond each kind of product."""
    rng = np.random.default_rng(top % 97)
    x = rng.integers(-top, top + 1, (1500, 3)).astype(float)
    x[700:1100] = x[700]
    x[1200:] = np.arange(300)[:, None] * float(max(1, top // 300))
    ids = np.sort(rng.choice(10_000, 1500, replace=False)).astype(np.int64)
    qi, q = ids[::30], x[::30]
    got = list(zip(*(c.tolist() for c in knn.best_of(qi, q, ids, x, 5, 16, 100)), strict=True))
    if top > 2000:  # a row's pieces are joined later
        got = [p for i in qi.tolist() for p in sorted((r for r in got if r[0] == i), key=lambda r: (-r[2], r[1]))[:5]]
    whole = [[int(c) for c in v] for v in x]
    want = [(int(i), j, -s) for i, v in zip(qi, q, strict=True) for s, j in sorted((-sum(int(a) * b for a, b in zip(v, w, strict=True)), int(j)) for j, w in zip(ids, whole, strict=True) if j != i)[:5]]
    assert got == want
