import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq

from lodestrata.llm import ngrams


def brute(rows):
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    held = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 10 == 0
    tokens = [(i, [*re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(lower)), None]) for i, t in rows]
    counts = Counter(w for i, ws in tokens if not held(i) for w in ws)
    n, v = sum(counts.values()), len(counts)
    return sorted((i or -1, held(i), len(ws), sum(counts[w] > 0 for w in ws), n, round(sum(math.log10((counts[w] + 0.1) / (n + 0.1 * (v + 1))) for w in ws), 4)) for i, ws in tokens)


def plain(rows):
    return sorted((r.doc_id or -1, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 4)) for r in rows)


def test_whole_table(spark, sf_dir):
    t = pq.read_table(f"{sf_dir}/documents.parquet").to_pydict()
    got = ngrams.op4_lm_score(spark, sf_dir).collect()
    assert plain(got) == brute(list(zip(t["doc_id"], t["text"], strict=True)))
    held = [r for r in got if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)
    assert all(math.isfinite(r.score) and r.score <= 0 for r in got)


def exact_model(rows, quantised):
    """Scores by a dictionary of bigram and word counts, with the model's smoothing; counts as the filter rounds them or as they are."""
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    texts = [(i, [None, *re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(lower)), None]) for i, t in rows]
    words, pairs = Counter(), Counter()
    for i, ws in texts:
        if zlib.crc32(str(i).encode()) % 10:
            words.update(ws[1:])
            pairs.update(zip(ws[:-1], ws[1:], strict=True))
    many = Counter(words.values())
    model = ngrams.Model(sum(words.values()), len(words), many[1], many[2])
    count = (lambda n: float(ngrams.middle(ngrams.quantise(np.array([n])) * (n > 0))[0])) if quantised else float
    p = lambda a, b: float(model.token(np.array(count(pairs[a, b])), np.array(count(words[a])), model.single(np.array(count(words[b])))))
    return {i: sum(math.log10(p(a, b)) for a, b in zip(ws[:-1], ws[1:], strict=True)) for i, ws in texts}, model, words


def test_scores_against_an_exact_model(spark, sf_dir):
    t = pq.read_table(f"{sf_dir}/documents.parquet").to_pydict()
    rows = list(zip(t["doc_id"], t["text"], strict=True))
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    want, model, words = exact_model(rows, quantised=True)
    exact, *_ = exact_model(rows, quantised=False)
    wide = {r.doc_id: r for r in ngrams.score_texts(docs, bits_each=64).collect()}
    assert np.mean([abs(r.score - want[i]) < 1e-6 * r.n_tokens for i, r in wide.items()]) > 0.8  # no false positive in the text
    assert max(abs(r.score - want[i]) / r.n_tokens for i, r in wide.items()) < 0.01
    plain = {r.doc_id: r for r in ngrams.score_texts(docs).collect()}
    assert np.mean([abs(r.score - exact[i]) / r.n_tokens for i, r in plain.items()]) < 0.08
    # the words' probabilities are a distribution: known ones, and the mass shared by those not seen
    known = sum(model.single(np.array([n], dtype=float))[0] for n in words.values())
    assert abs(known + model.discount * model.kinds / model.tokens - 1) < 1e-9


def test_invented_words_score_below_known_text(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    known = " ".join(next(r.text for r in docs.collect() if r.text and len(r.text.split()) > 300 and zlib.crc32(str(r.doc_id).encode()) % 10).split()[:200])
    invented = " ".join(f"zq{k}xv" for k in range(200))
    held = [i for i in range(10**6, 10**6 + 100) if not zlib.crc32(str(i).encode()) % 10]
    more = spark.createDataFrame([(held[0], known), (held[1], invented)], "doc_id long, text string")
    got = {r.doc_id: r for r in ngrams.score_texts(docs.unionByName(more)).collect()}
    assert got[held[0]].n_tokens == got[held[1]].n_tokens
    assert got[held[1]].score < got[held[0]].score - 200


def test_word_counts_by_groups_of_blocks(spark):
    met = spark.createDataFrame([(b, k, w, b % 3) for b in range(40) for k, w in enumerate(("", "a", f"w{b % 7}"))], "block long, at int, word string, n long")
    key = lambda df: sorted(map(tuple, df.collect()))
    assert key(ngrams._word_counts(met, 40, 6)) == key(ngrams._word_counts(met, 40, 4096))


def test_edge_cases(spark):
    rows = [(1, None), (2, ""), (3, " \x0b A aÉ é a b "), (None, "a"), (10, "a b"), (10, "a b"), (12, "x " * 100_000)]
    df = spark.createDataFrame([(*r, 4, "w") for r in rows], "doc_id long, text string, held int, words string")
    assert plain(ngrams.score_texts(df).collect()) == brute(rows)
    assert ngrams.score_texts(df.limit(0)).count() == 0
    only_held = [(i, "some text") for i in range(200) if zlib.crc32(str(i).encode()) % 10 == 0]
    out = ngrams.score_texts(spark.createDataFrame(only_held, "doc_id long, text string")).collect()
    assert plain(out) == brute(only_held) and {r.score for r in out} == {0.0}


def test_filter_gives_quantised_counts():
    rng = np.random.default_rng(0)
    gram = rng.integers(0, 2**63, 5000, dtype=np.uint64) * np.uint64(2)
    n = rng.integers(1, 5000, 5000)
    bits = 1 << 12
    import pyarrow as pa

    data = np.zeros(ngrams.SEGMENTS * bits // 8, dtype=np.uint8)
    segment = (gram >> ngrams.SEGMENT_SHIFT).astype(np.int64)
    for s in np.unique(segment).tolist():
        mine = segment == s
        rows = pa.table({"segment": pa.array([s], pa.int32()), "grams": pa.array([gram[mine].tobytes()], pa.binary()), "counts": pa.array([ngrams.squeeze(n[mine].astype("<i8"))], pa.binary())})
        bits_of = ngrams._segment(bits)(None, rows).column("bits")[0].as_py()
        data[s * bits // 8 : (s + 1) * bits // 8] = np.frombuffer(bits_of, dtype=np.uint8)
    got = ngrams.LogFrequencyBloom(data, bits).counts(gram)
    level = ngrams.quantise(n)
    want = np.where(level == 1, 1, 2.0 ** (level - 1) / np.log(2))
    assert (got >= want - 1e-9).all() and (np.abs(got - want) < 1e-9).mean() > 0.9
    assert (ngrams.expand(ngrams.squeeze(n.astype('<i8')), '<i8') == n).all()
    assert (ngrams.LogFrequencyBloom(data, bits).counts(rng.integers(0, 2**63, 5000, dtype=np.uint64)) > 0).mean() < 0.1


def test_rare_bigrams_are_kept_apart(spark):
    ids = [i for i in range(2000) if zlib.crc32(str(i).encode()) % 10]
    held = next(i for i in range(2000) if not zlib.crc32(str(i).encode()) % 10)
    other = next(i for i in range(held + 1, 2000) if not zlib.crc32(str(i).encode()) % 10)
    # four rare words, each three times in 600,000 tokens, in two pairs
    rows = [(i, "filler " * 600 + {0: "pale quince", 1: "dim ostrich"}.get(k // 3, "")) for k, i in enumerate(ids[:1000])]
    rows += [(held, "pale quince dim ostrich " * 5), (other, "pale ostrich dim quince " * 5)]
    score = {r.doc_id: r.score for r in ngrams.score_texts(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert score[held] > score[other] + 0.01


def test_false_positives_do_not_rise_with_the_segment():
    import pyarrow as pa

    rng = np.random.default_rng(1)
    for many in (2_000, 1_500_000):
        gram = np.sort(rng.integers(0, 2**63, many, dtype=np.uint64))
        n = np.where(np.arange(many) % 2, 1, 0).astype("<i8")  # every second one is asked for only
        rows = pa.table({"segment": pa.array([7], pa.int32()), "block": pa.array([3]), "grams": pa.array([ngrams.squeeze(np.diff(gram, prepend=np.uint64(0)))], pa.binary()), "counts": pa.array([ngrams.squeeze(n)], pa.binary())})
        out = ngrams._answer()(None, rows)
        level = ngrams.expand(out.column("levels")[0].as_py(), "u1")
        assert (level[n > 0] >= 1).all() and (level[n == 0] > 0).mean() < 0.03
    assert all(8 <= ngrams.bits_for(n) / n <= 16 for n in (1_000, 10**6, 5 * 10**9))


def test_asked_ngrams_take_few_bytes():
    """A block's n-grams come back whole from the pieces of each segment, at under 3.8 bytes each; words come back from one piece."""
    rng = np.random.default_rng(2)
    words, ids = [f"w{k}" for k in range(50_000)] + [ngrams.END], rng.integers(0, 50_001, 400_000).astype("<u4")
    assert [w.decode() for w in ngrams.apart(ngrams.together(words))] == words and ngrams.apart(ngrams.together([""])) == [b""]
    one = lambda x: pa.array([x])
    block = pa.RecordBatch.from_arrays([one(7), one([1, 2]), one([False, True]), one([300_000, 100_000]), one(ngrams.squeeze(ids)), one(ngrams.together(words)), one(ngrams.squeeze(np.ones(50_001, dtype="<i8")))], names=["block", "doc_ids", "held", "lens", "ids", "names", "counts"])
    ((_, _, lens, at, h, _, _),) = ngrams._blocks(block)
    bits = ngrams.hash_bits(300_000)
    want = np.unique(ngrams._of_block(h, at, lens, bits))
    assert bits == 46 and ngrams.hash_bits(1 << 40) == 55 and len(want) > 400_000
    (asked,) = ngrams._ask(8, bits)([block])
    assert sum(map(len, asked.column("grams").to_pylist())) < 3.8 * len(want)
    got, read = [], ngrams.LogFrequencyBloom.levels
    try:
        ngrams.LogFrequencyBloom.levels = lambda self, gram: (got.append(gram), read(self, gram))[1]
        for k in range(8):
            levels = ngrams._answer(8, 8, bits)(None, pa.table(asked.slice(k, 1).to_pydict()))
            assert len(ngrams.expand(levels.column("levels")[0].as_py(), "u1")) == len(got[-1])
    finally:
        ngrams.LogFrequencyBloom.levels = read
    assert np.array_equal(np.concatenate(got), want)
