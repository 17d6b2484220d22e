import math
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq

from lodestrata.llm import probminhash as pmh
from lodestrata.llm.common import EDGE_PUNCTUATION, connected_components


def grams(text):
    """5-word shingles, weighted by 1 + ln of their counts."""
    words = [w for w in (x.strip(EDGE_PUNCTUATION) for x in (text or "").lower().split()) if w]
    found = Counter(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else {}
    return {g: 1 + math.log(n) for g, n in found.items()}


def jaccard(s, t):
    """Probability Jaccard as defined, term by term."""
    every = list(s | t)
    x, y = (np.array([m.get(g, 0.0) for g in every]) for m in (s, t))
    return sum(1 / np.maximum(x / x[k], y / y[k]).sum() for k in np.nonzero((x > 0) & (y > 0))[0].tolist())


def brute(rows, threshold=0.8):
    sets = [(i, grams(t)) for i, t in rows if i is not None]
    root = {i: i for i, _ in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    index = {}
    for n, (_, s) in enumerate(sets):
        for g in s:
            index.setdefault(g, []).append(n)
    for n, (i, s) in enumerate(sets):
        near = {m for g in s for m in index[g] if m < n}
        for m in near:
            j, t = sets[m]
            common = s.keys() & t.keys()
            if min(sum(s[g] for g in common) / sum(s.values()), sum(t[g] for g in common) / sum(t.values())) >= threshold - 1e-9 and jaccard(s, t) >= threshold - 1e-9:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {i: find(i) for i in root}


def classes(df):
    out = {r.doc_id: r.class_id for r in df.collect() if r.doc_id is not None}
    return out


def test_whole_table(spark, sf_dir):
    t = pq.read_table(f"{sf_dir}/documents.parquet").to_pydict()
    assert classes(pmh.op9_near_documents(spark, sf_dir)) == brute(list(zip(t["doc_id"], t["text"], strict=True)))


def test_chains_large_groups_nulls(spark):
    rnd = random.Random(4)
    word = lambda: "".join(rnd.choice("abcdefghij") for _ in range(4))
    base = [word() for _ in range(120)]
    rows = []
    for i in range(150):  # copies of one text, each with words of its own: many pairs lie on either side of the threshold
        w = list(base)
        for _ in range(rnd.choice((0, 1, 2, 3))):
            w[rnd.randrange(120)] = word()
        rows.append((i, " ".join(w)))
    rows += [(200, None), (201, ""), (202, " ... "), (203, "One two"), (204, "one TWO."), (205, "one two three"), (206, " ".join(word() for _ in range(40_000))), (None, "one two"), (207, rows[3][1].upper()), (208, "solo text " * 200), (208, rows[5][1])]
    df = spark.createDataFrame([(*r, 3, "r") for r in rows], "doc_id long, text string, n int, rep string")
    got = classes(pmh.near_duplicates(df, chunk_rows=40))
    unique = [r for r in rows if r[0] != 208]
    want = brute(unique)
    assert {i: c for i, c in got.items() if i != 208} == want
    assert got[208] == want[5]
    assert sum(r.kept for r in pmh.near_duplicates(df.limit(1)).collect()) == 1
    assert pmh.near_duplicates(df.limit(0)).count() == 0
    null = [r for r in pmh.near_duplicates(df).collect() if r.doc_id is None]
    assert len(null) == 1 and null[0].kept and null[0].class_id is None


def test_lines_repeated_unequally_often(spark):
    rows = []
    for i in range(40):
        body, line = (" ".join(f"{c}{i}w{k}" for k in range(n)) for c, n in (("b", 100), ("l", 12)))
        rows += [(2 * i, " ".join([body] + [line] * 3)), (2 * i + 1, " ".join([body] + [line] * 30))]
    got = classes(pmh.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")))
    assert got == {i: i - i % 2 for i in range(80)} == brute(rows)


def test_exact_probability_jaccard():
    rng = np.random.default_rng(6)
    for _ in range(200):
        s, t = ({int(k): float(rng.choice([1, 1, 1, 1.7, 2.1, 5])) for k in rng.choice(40, rng.integers(1, 40), replace=False)} for _ in range(2))
        sides = [(np.array(sorted(m), dtype=np.uint64), np.array([m[k] for k in sorted(m)])) for m in (s, t)]
        assert abs(pmh.probability_jaccard(*sides[0], *sides[1]) - jaccard(s, t)) < 1e-12
        assert abs(pmh.probability_jaccard(*sides[0], sides[0][0], 3 * sides[0][1]) - 1) < 1e-12


def test_repeated_lines_near_the_threshold(spark):
    """Copies that differ in how often they repeat a line, on either side of the weighted threshold, not of the plain one."""
    rows = []
    for i in range(60):
        body, line = (" ".join(f"{c}{i}w{k}" for k in range(n)) for c, n in (("b", 60), ("l", 25)))
        rows += [(2 * i, " ".join([body] + [line] * 2)), (2 * i + 1, " ".join([body] + [line] * (2 + i)))]
    want = brute(rows)
    assert 5 < sum(want[2 * i + 1] == 2 * i for i in range(60)) < 50
    assert classes(pmh.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))) == want


def test_rows_that_stay(spark):
    long = " ".join(f"w{k}" for k in range(200))
    rows = [(5, "some text of its own here"), (5, "another text that is not alike at all"), (1, long), (1, long), (2, long + " more"), (None, long), (None, "no id one two three"), (None, "no id one two three"), (9, None), (9, None), (7, ""), (None, None)]
    df = spark.createDataFrame([(*r, "k", 1, "r", True, 2) for r in rows], "doc_id long, text string, key string, n_rows int, row string, kept boolean, gone int")
    out = pmh.without_near_duplicates(df)
    assert out.columns == df.columns
    got = sorted(((r.doc_id or -1, r.text) for r in out.collect()), key=str)
    assert got == sorted([(5, "another text that is not alike at all"), (1, long), (-1, "no id one two three"), (9, None), (7, ""), (-1, None)], key=str)
    assert {tuple(r)[2:] for r in out.collect()} == {("k", 1, "r", True, 2)}
    assert pmh.without_near_duplicates(df.limit(0)).count() == 0


def test_registers_estimate_probability_jaccard():
    a, b = {i: 1 + i % 3 for i in range(300)}, {i: 1 + i % 3 for i in range(60, 360)}
    row = np.repeat([0, 1], [300, 300])
    element = pmh.mix(np.array([*a, *b], dtype=np.uint64) + np.uint64(99))
    sig = pmh.prob_minhash(row, element, np.array([*a.values(), *b.values()]), 2, m=2000)
    keys = set(a) | set(b)
    jp = sum(1 / sum(max(a.get(j, 0) / a[i], b.get(j, 0) / b[i]) for j in keys) for i in set(a) & set(b))
    assert abs((sig[0] == sig[1]).mean() - jp) < 0.05


def test_shingles_of_short_rows():
    row, _, count, keys = pmh.shingles(pa.array(["a b c", "A, b c!", None, "a b c d e f", "x x x x x x x"]))
    assert np.bincount(row, minlength=5).tolist() == [1, 1, 0, 2, 1]
    assert (keys[0] == keys[1]).all() and count[-1] == 3


def test_components_of_long_paths(spark):
    n = 500
    ids = list(range(n))
    random.Random(1).shuffle(ids)
    edges = [(ids[i], ids[i + 1]) for i in range(n - 1) if i % 100 != 99] + [(5, 5), (None, 3)]
    df = spark.createDataFrame(edges, "u long, v long").repartition(16)
    got = {r.node: r.component for r in connected_components(df).collect()}
    for k in range(0, n, 100):
        assert {got[i] for i in ids[k : k + 100]} == {min(ids[k : k + 100])}
