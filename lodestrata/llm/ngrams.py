"""Language-model scores from a log-frequency Bloom filter of n-gram counts."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import ascii_words, materialise, mix, release, slices, tidy

SEGMENTS, PROBES, BITS_EACH = 1024, 4, 8
TOP_LEVEL = 64  # counts are 64-bit
SEGMENT_TOKENS = 1 << 22
SEGMENT_SHIFT = np.uint64(64 - 10)
END = ""  # the end token: no word is empty
GOLDEN = np.uint64(0x9E3779B97F4A7C15)
BIGRAM, UNIGRAM = np.uint64(0xA24BAED4963EE407), np.uint64(0x9FB21C651E98DF25)
HASH_BITS, SPARE_BITS = 46, 14  # what is sent of a hash, at least and beyond the number of tokens: 1 n-gram in 16,384 meets another at most
BLOCK = "block long, doc_ids array<long>, held array<boolean>, lens array<int>, ids binary, words array<string>, train array<long>, names binary"
COUNTED = "block long, doc_ids array<long>, held array<boolean>, lens array<int>, ids binary, names binary, counts binary"


def squeeze(values: np.ndarray) -> bytes:
    """A column of numbers, byte by byte of each number, compressed."""
    raw = np.ascontiguousarray(np.ascontiguousarray(values).view(np.uint8).reshape(len(values), values.itemsize).T).tobytes()
    return len(values).to_bytes(8, "little") + (pa.compress(raw, "zstd", asbytes=True) if raw else b"")


def expand(blob: bytes, kind: str) -> np.ndarray:
    n, size = int.from_bytes(blob[:8], "little"), np.dtype(kind).itemsize
    raw = pa.decompress(blob[8:], n * size, "zstd", asbytes=True) if n else b""
    return np.ascontiguousarray(np.frombuffer(raw, dtype=np.uint8).reshape(size, n).T).view(kind).ravel()


def together(words: list[str]) -> bytes:
    """A block's words in one compressed piece: none holds white space."""
    raw = "\n".join(words).encode()
    return len(raw).to_bytes(8, "little") + (pa.compress(raw, "zstd", asbytes=True) if raw else b"")


def apart(blob: bytes) -> list[bytes]:
    n = int.from_bytes(blob[:8], "little")
    return (pa.decompress(blob[8:], n, "zstd", asbytes=True) if n else b"").split(b"\n")


def _tokenise(batches):
    """Blocks of whole texts: token ids into the block's own word list, the most frequent first, and each word's count in training rows."""
    task, number = TaskContext.get().partitionId(), 0
    for batch in slices(batches, 1, 6 << 20):
        words, lens = ascii_words(batch.column(1))
        coded = words.dictionary_encode()
        names = pa.concat_arrays([coded.dictionary, pa.array([END])])
        # each text's tokens, then the end token
        ids = np.insert(coded.indices.to_numpy(zero_copy_only=False), np.cumsum(lens), len(names) - 1)
        order = np.argsort(-np.bincount(ids, minlength=len(names)), kind="stable")
        rank = np.empty(len(order), dtype="<u4")
        rank[order] = np.arange(len(order))
        ids, names, lens = rank[ids], names.take(pa.array(order)), lens + 1
        held = batch.column(2).to_numpy(zero_copy_only=False)
        train = np.bincount(ids[~np.repeat(held, lens)], minlength=len(names))
        one = lambda values, kind: pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), pa.array(values, kind))
        yield pa.RecordBatch.from_arrays(
            [pa.array([task * (1 << 24) + number], pa.int64()), one(batch.column(0), pa.int64()), one(held, pa.bool_()), one(lens, pa.int32()), pa.array([squeeze(ids)], pa.binary()), pa.ListArray.from_arrays(pa.array([0, len(names)], pa.int32()), names), one(train, pa.int64()), pa.array([together(names.to_pylist())], pa.binary())],
            names=["block", "doc_ids", "held", "lens", "ids", "words", "train", "names"],
        )
        number += 1
        pa.default_memory_pool().release_unused()


def _gather(batches):
    """(block, at, count, first) rows as one compressed piece for each block and million rows."""
    held, many = [], 0

    def pieces():
        block, at, c = (np.concatenate([x[k] for x in held]) for k in range(3))
        order = np.lexsort((at, block))
        block, at, c = block[order], at[order], c[order]
        cuts = np.concatenate([[0], np.nonzero(np.diff(block))[0] + 1, [len(block)]])
        rows = [(block[a], squeeze(at[a:b]), squeeze(c[a:b])) for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)]
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), (pa.int64(), pa.binary(), pa.binary()), strict=True)], names=["block", "at", "c"])

    for batch in batches:
        block, at, c, first = (batch.column(k).to_numpy(zero_copy_only=False) for k in range(4))
        # the sign tells the block that a word's count comes from
        held.append((block.astype(np.int64), at.astype("<u4"), np.where(first, c, -c).astype("<i8")))
        many += len(block)
        if many > 1_000_000:
            yield pieces()
            held, many = [], 0
    if many:
        yield pieces()


def _counted(key, block, counts):
    """A block with the corpus count of each of its words."""
    at, c = (np.concatenate([expand(x, kind) for x in counts.column(name).to_pylist()]) for name, kind in (("at", "<u4"), ("c", "<i8")))
    kept = block.select(["block", "doc_ids", "held", "lens", "ids", "names"])
    return kept.append_column("counts", pa.array([squeeze(c[np.argsort(at)])], pa.binary()))


class Model:
    """The totals and the smoothing; all counts of n-grams come from the filter.

    A word's discounted frequency leaves ``discount`` of an occurrence of each
    known word over. That mass is shared evenly by the words not seen, whose
    number is Chao's estimate from the words seen once and twice, and large
    enough that a word not seen has half the chance at most of one seen once.
    """

    def __init__(self, tokens: int, kinds: int, once: int = 0, twice: int = 0, prior: float = 300.0, discount: float = 0.5):
        self.tokens, self.kinds, self.prior, self.discount = tokens, kinds, prior, discount
        unseen = max(once * (once - 1) / (2 * (twice + 1)), 2 * discount * kinds / (1 - discount), 1.0)
        self.unseen = discount * kinds / max(1, tokens) / unseen

    def single(self, count: np.ndarray) -> np.ndarray:
        """Probability of a word by its count."""
        return np.where(count > 0, np.maximum(count - self.discount, 0.0) / max(1, self.tokens), self.unseen)

    def token(self, seen: np.ndarray, total: np.ndarray, single: np.ndarray) -> np.ndarray:
        """Probability of a token after its context: the bigram's count smoothed towards the word's probability."""
        return (np.minimum(seen, total) + self.prior * single) / (total + self.prior)


def _blocks(batch):
    """The blocks of a batch: ids of its rows, held, lens, token ids, word hashes, counts and whether a count is this block's to pass on."""
    for docs, held, lens, ids, names, counts in zip(*(batch.column(n).to_pylist() for n in ("doc_ids", "held", "lens", "ids", "names", "counts")), strict=True):
        # words take less room than their hashes, which don't compress
        words = apart(names)
        hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, words), dtype=np.uint64, count=len(words))
        c = expand(counts, "<i8")
        yield docs, np.asarray(held, dtype=bool), np.asarray(lens, dtype=np.int64), expand(ids, "<u4"), hashes, np.abs(c), c > 0


def _before(ids: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """The word before each token; a text's first token follows the end token."""
    before = np.empty_like(ids)
    before[1:] = ids[:-1]
    ends = np.cumsum(lens)
    before[ends - lens] = ids[ends - 1]
    return before


def hash_bits(tokens: int) -> int:
    """Bits of an n-gram's hash that are sent, by the training tokens."""
    return min(64, max(HASH_BITS, tokens.bit_length() + SPARE_BITS))


def _of_block(h, ids, lens, bits: int):
    """The n-grams of a block, as the upper ``bits`` bits of their hashes: each token's bigram, then each word of its list."""
    drop = np.uint64(64 - bits)
    with np.errstate(over="ignore"):
        return np.concatenate([mix(h[_before(ids, lens)] * BIGRAM + h[ids]), mix(h ^ UNIGRAM)]) >> drop << drop


def _ask(segments: int, bits: int):
    """A block's distinct n-grams in order, cut by segment, and how often its training rows have each."""
    shift, drop = np.uint64(65 - segments.bit_length()), np.uint64(64 - bits)

    def run(batches):
        for batch in batches:
            for block, (_, held, lens, ids, h, _, _) in zip(batch.column("block").to_pylist(), _blocks(batch), strict=True):
                train = (~np.repeat(held, lens)).astype(np.float64)
                gram, at = np.unique(_of_block(h, ids, lens, bits), return_inverse=True)
                n = np.bincount(at, weights=np.concatenate([train, np.bincount(ids, weights=train, minlength=len(h))])).astype("<i8")
                cuts = np.searchsorted(gram >> shift, np.arange(segments + 1, dtype=np.uint64))
                rows = [(s, block, squeeze(np.diff(gram[a:b] >> drop, prepend=np.uint64(s) << shift >> drop)), squeeze(n[a:b])) for s, (a, b) in enumerate(zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)) if b > a]
                kinds = (pa.int32(), pa.int64(), pa.binary(), pa.binary())
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=["segment", "block", "grams", "counts"])
                pa.default_memory_pool().release_unused()

    return run


def places(gram: np.ndarray, level: np.ndarray | int, bits: int) -> np.ndarray:
    """Bit places of (n-gram, level) within the n-gram's segment: one row for each probe."""
    with np.errstate(over="ignore"):
        a = mix(gram + np.asarray(level, dtype=np.uint64) * GOLDEN)
        b = mix(a ^ UNIGRAM) | np.uint64(1)
        return np.stack([(a + np.uint64(k) * b) & np.uint64(bits - 1) for k in range(PROBES)])


def quantise(n: np.ndarray) -> np.ndarray:
    """Level of a count: 1 + floor(log2(n))."""
    return np.floor(np.log2(np.maximum(n, 1))).astype(np.int64) + 1


def fill(gram: np.ndarray, level: np.ndarray, bits: int) -> np.ndarray:
    """Bits of a segment: an n-gram of level q is in it once for each level up to q."""
    there = np.zeros(bits, dtype=bool)
    for j in range(1, int(level.max(initial=0)) + 1):
        there[places(gram[level >= j], j, bits).ravel().astype(np.int64)] = True
    return np.packbits(there, bitorder="little")


def _segment(bits: int):
    """A segment's bits from (grams, counts) rows."""

    def run(_, rows):
        gram = np.concatenate([np.frombuffer(x, "<u8") for x in rows.column("grams").to_pylist()])
        gram, at = np.unique(gram, return_inverse=True)
        level = quantise(np.bincount(at, weights=np.concatenate([expand(x, "<i8") for x in rows.column("counts").to_pylist()])))
        return pa.table({"segment": rows.column("segment").slice(0, 1), "bits": pa.array([fill(gram, level, bits).tobytes()], pa.binary())})

    return run


def bits_for(entries: int, each: int = BITS_EACH) -> int:
    """Bits of a segment of so many entries: ``each`` to twice that for each, at every size of the input."""
    return 1 << max(10, int(np.ceil(np.log2(max(1, each * entries)))))


def _answer(each: int = BITS_EACH, segments: int = 0, hashed: int = 64):
    """Fills a segment of the filter and reads it for every block that asks: the levels of the block's n-grams, in their order."""
    drop = np.uint64(64 - hashed)

    def run(_, rows):
        first = np.uint64(rows.column("segment")[0].as_py()) << np.uint64(65 - segments.bit_length()) if segments else np.uint64(0)
        asked = [(np.cumsum(expand(x, "<u8"), dtype=np.uint64) << drop) + first for x in rows.column("grams").to_pylist()]
        gram, at = np.unique(np.concatenate(asked), return_inverse=True)
        n = np.bincount(at, weights=np.concatenate([expand(x, "<i8") for x in rows.column("counts").to_pylist()]))
        level = np.where(n > 0, quantise(n), 0)
        bits = bits_for(int(level.sum()), each)
        read = LogFrequencyBloom(fill(gram, level, bits), bits).levels(gram).astype(np.uint8)
        cuts = np.cumsum([0, *map(len, asked)]).tolist()
        levels = [squeeze(read[at[a:b]]) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
        return pa.table({"block": rows.column("block"), "segment": rows.column("segment"), "levels": pa.array(levels, pa.binary())})

    return run


class LogFrequencyBloom:
    """One segment of the filter, or all 1,024 in a row: probes level after level until one is missing."""

    def __init__(self, data: np.ndarray, bits: int):
        self.data, self.bits = data, bits

    def levels(self, gram: np.ndarray) -> np.ndarray:
        level = np.zeros(len(gram), dtype=np.int64)
        one = 8 * len(self.data) == self.bits
        base = np.zeros(len(gram), dtype=np.int64) if one else (gram >> SEGMENT_SHIFT).astype(np.int64) * (self.bits // 8)
        live = np.arange(len(gram))
        for j in range(1, TOP_LEVEL + 1):
            if not len(live):
                break
            at = places(gram[live], j, self.bits).astype(np.int64)
            there = np.ones(len(live), dtype=bool)
            for row in at:
                there &= (self.data[base[live] + (row >> 3)] >> (row & 7) & 1).astype(bool)
            live = live[there]
            level[live] = j
        return level

    def counts(self, gram: np.ndarray) -> np.ndarray:
        return middle(self.levels(gram))


def middle(level: np.ndarray) -> np.ndarray:
    """The middle of a level's counts, evenly spread over their logarithm."""
    level = level.astype(np.float64)
    return np.where(level == 0, 0.0, np.where(level == 1, 1.0, 2.0 ** (level - 1) / np.log(2)))


def log_probabilities(model: Model, levels, hashes, ids, lens, bits: int | None = None) -> np.ndarray:
    """log10 probability of each token, from the levels of the block's distinct n-grams in their order."""
    if not model.tokens:
        return np.zeros(len(ids))
    _, at = np.unique(_of_block(hashes, ids, lens, bits or hash_bits(model.tokens)), return_inverse=True)
    count = middle(levels)[at]
    seen, words = count[: len(ids)], count[len(ids) :]
    return np.log10(model.token(seen, words[_before(ids, lens)], model.single(words)[ids]))


def _totals(batches):
    """N, V and the words seen once and twice: of the counts that each block passes on."""
    for batch in batches:
        c = np.concatenate([expand(x, "<i8") for x in batch.column("counts").to_pylist()] or [np.zeros(0, dtype="<i8")])
        yield pa.RecordBatch.from_arrays([pa.array([int(x)]) for x in (c[c > 0].sum(), (c > 0).sum(), (c == 1).sum(), (c == 2).sum())], names=["n", "v", "once", "twice"])


def _score(model: Model):
    n, v = model.tokens, model.kinds

    def run(_, block, answers):
        order = np.argsort(answers.column("segment").to_numpy())
        pieces = answers.column("levels").to_pylist()
        levels = np.concatenate([np.zeros(0, np.uint8), *(expand(pieces[k], "u1") for k in order.tolist())])
        ((docs, held, lens, ids, h, c, _),) = _blocks(block)
        row = np.repeat(np.arange(len(lens)), lens)
        base = np.log10((c + 0.1) / (n + 0.1 * (v + 1)))
        total = lambda x: np.bincount(row, weights=x, minlength=len(lens))
        columns = [pa.array(docs, pa.int64()), pa.array(held, pa.bool_()), pa.array(lens, pa.int64()), pa.array(total(c[ids] > 0).astype(np.int64)), pa.array(np.full(len(lens), n), pa.int64()), pa.array(total(base[ids])), pa.array(total(log_probabilities(model, levels, h, ids, lens)))]
        return pa.table(columns, names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    return run


def _word_counts(met: DataFrame, blocks: int, most: int) -> DataFrame:
    """``met`` (block, at, word, n) with each word's count over all blocks and whether the block is the first to hold it.

    Counts run over the rows of a word. Beyond ``most`` blocks they run over
    groups of so many blocks, then over a word's groups, so that the rows of
    the end token or a very common word lie with many tasks and not with one.
    """
    own, first = Window.partitionBy("word"), Window.partitionBy("word").orderBy("block")
    if blocks <= most:
        return met.select("block", "at", F.sum("n").over(own).alias("c"), (F.row_number().over(first) == 1).alias("first"))
    met = met.withColumn("part", F.pmod(F.xxhash64("block"), F.lit(-(-blocks // most)).cast("long")))
    parts = met.groupBy("word", "part").agg(F.sum("n").alias("n"), F.min("block").alias("least"))
    parts = parts.select("word", "part", F.sum("n").over(own).alias("c"), F.min("least").over(own).alias("least"))
    return met.drop("n").join(parts, ["word", "part"]).select("block", "at", "c", (F.col("block") == F.col("least")).alias("first"))


def score_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", folds: int = 10, bits_each: int = BITS_EACH, word_blocks: int = 4096) -> DataFrame:
    """Score every whole text: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Learns from rows whose crc32(doc_id as text) mod ``folds`` is not 0. Words
    are what lies between ASCII white space with A-Z lowered; each text has an
    end token. ``base_score`` uses exact counts, which a join brings to each
    block of texts by its distinct words. ``score`` is the log10 probability by
    a bigram model whose counts sit in a log-frequency Bloom filter (Talbot and
    Osborne 2007): words and bigrams go in once for each level up to
    1 + floor(log2(count)), and are read by probing level after level. Every
    word and bigram of the training rows goes in as itself. A word's count is
    its count as a context, too, since a token follows each but the end token,
    which stands before a text's first token.

    The filter has ``bits_each`` to twice as many bits for each entry at every size of the input. It is
    never in one place: a task holds one hash segment, fills it with the counts
    that all blocks send and reads it for the n-grams that they ask for; the
    number of segments follows the training tokens. A block sends an n-gram
    once, so no word is hot.

    A null text is empty (its end token only), a null id is held out; repeated
    rows count and come back each; an empty table gives no rows. Further
    columns are ignored. Without training rows V and N are 0 and ``score`` is 0.
    """
    spark = docs.sparkSession
    held = F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % folds == 0
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), held.alias("held"))
    blocks = materialise(rows.mapInArrow(_tokenise, BLOCK), "lm")
    met = blocks.select("block", F.posexplode(F.arrays_zip("words", "train")).alias("at", "w")).select("block", "at", F.col("w.words").alias("word"), F.col("w.train").alias("n"))
    found = _word_counts(met, blocks.count(), word_blocks)
    found = materialise(found.mapInArrow(_gather, "block long, at binary, c binary"), "lm-found", "uncompressed")
    tidy(spark)  # the words' shuffle has been read
    counted = blocks.drop("train", "words").groupBy("block").cogroup(found.withColumnRenamed("block", "of").groupBy("of")).applyInArrow(_counted, COUNTED)
    counted = materialise(counted, "lm-counted")
    total = counted.mapInArrow(_totals, "n long, v long, once long, twice long").agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("n", "v", "once", "twice")]).first()
    release(blocks, found)
    tidy(spark)
    model = Model(*map(int, total))
    segments = max(SEGMENTS, 1 << max(0, model.tokens // SEGMENT_TOKENS).bit_length())
    asked = counted.mapInArrow(_ask(segments, hash_bits(model.tokens)), "segment int, block long, grams binary, counts binary")
    levels = asked.groupBy("segment").applyInArrow(_answer(bits_each, segments, hash_bits(model.tokens)), "block long, segment int, levels binary")
    scored = counted.groupBy("block").cogroup(levels.withColumnRenamed("block", "of").groupBy("of"))
    return scored.applyInArrow(_score(model), "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def op4_lm_score(spark, sf_dir: str) -> DataFrame:
    return score_texts(spark.read.parquet(f"{sf_dir}/documents.parquet"))
