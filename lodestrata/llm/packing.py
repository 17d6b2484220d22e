"""Mixture-controlled packing by deficit round-robin over source queues."""

from __future__ import annotations

import base64
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise, slices

END_OF_TEXT = "<|endoftext|>"
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, queue string"


def _tokenizer(path: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


@lru_cache(maxsize=2)
def encoder(json_path: str, ranks_path: str, pattern: str):
    """Text to ids as the tokenizer file defines them.

    The rank file holds the same vocabulary for a faster encoder with equal
    ids; texts with the special token's string, and those the fast encoder
    refuses, go through the tokenizer file itself.
    """
    import tiktoken

    exact = lru_cache(maxsize=1)(lambda: _tokenizer(json_path))  # most tasks never need it
    with open(ranks_path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    fast = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})

    def encode(text: str) -> list[int]:
        if END_OF_TEXT not in text:
            try:
                return fast.encode_ordinary(text)
            except Exception:  # noqa: BLE001  the pattern's engine gives up on some very long runs
                pass
        return exact().encode(text, add_special_tokens=False).ids

    return encode


def _tokenise(paths: tuple[str, str, str], end_id: int):
    """Texts to ids; ``at`` is where a document starts among its task's tokens of the same queue."""

    def run(batches):
        encode, task = encoder(*paths), TaskContext.get().partitionId()
        so_far: dict = {}
        for batch in slices(batches, 1, 2 << 20):
            ids, blobs, counts, starts = batch.column(0), [], [], []
            for text, queue in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                tokens = np.asarray(encode(text or "") + [end_id], dtype=np.uint32)
                blobs.append(tokens.astype(np.uint16).tobytes() if tokens.max() < 65536 else b"\0" + tokens.tobytes())
                counts.append(len(tokens))
                starts.append(so_far.get(queue, 0))
                so_far[queue] = starts[-1] + len(tokens)
            yield pa.RecordBatch.from_arrays([pa.array([task] * len(ids), pa.int64()), batch.column(2), pa.array(starts, pa.int64()), ids, pa.array(counts, pa.int64()), pa.array(blobs, pa.binary())], names=["task", "queue", "at", "doc_id", "n", "ids"])

    return run


#: Rows up to which a table of places by task and queue is broadcast: some 60 MB.
FEW_PLACES = 500_000
SPAN = 1024


def _ids(blob: bytes) -> np.ndarray:
    return np.frombuffer(blob, dtype="<u2").astype("<u4") if len(blob) % 2 == 0 else np.frombuffer(blob, dtype="<u4", offset=1)


def deficit_round_robin(sizes: list[int], supply: list[int], shares: list[float], carried: list[float], quantum: int = 1) -> list[tuple[int, int, int, int]]:
    """Fill windows of the given sizes from queues: (window, offset, queue, tokens).

    Every window adds each waiting queue's share of it to that queue's deficit.
    A queue is served once its deficit reaches ``quantum`` (or all it has left)
    and takes twice its share of a window at most, so that an old debt is paid
    over many windows and leaves each of them mixed. Queues are served in turn,
    each window starting one further on. Room that is left by rounding, debts
    or waiting goes to the queues of the largest deficits, in parts of their
    share, to those below twice their share first. Deficits run on from window to window.
    """
    left, deficit, runs = list(supply), list(carried), []
    active, settled = [q for q, n in enumerate(left) if n], False
    for w, size in enumerate(sizes):
        total = sum(shares[q] for q in active)
        part = {q: size * shares[q] / total if total else size / len(active) for q in active}
        if not settled:  # what queues that have run dry are owed or owe falls to the others
            over = sum(deficit[q] for q in active) / size
            for q in active:
                deficit[q] -= over * part[q]
            settled = True
        for q in active:
            deficit[q] += part[q]
        room, offset, taken = size, 0, {}
        turn = w % len(active)
        for q in active[turn:] + active[:turn]:
            if deficit[q] >= min(quantum, left[q]):
                n = min(left[q], int(deficit[q]), room, max(quantum, int(2 * part[q])))
                if n > 0:
                    taken[q] = n
                    room -= n
        capped = True
        while room:
            most = {q: min(left[q], max(quantum, int(2 * part[q]))) if capped else left[q] for q in active}
            waiting = sorted((q for q in active if most[q] > taken.get(q, 0)), key=lambda q: (taken.get(q, 0) - deficit[q], q))
            capped &= bool(waiting)
            whole, at_once = sum(part[q] for q in waiting), room
            for q in waiting:
                n = min(most[q] - taken.get(q, 0), room, max(1, int(at_once * part[q] / whole) if whole else at_once))
                taken[q] = taken.get(q, 0) + n
                room -= n
                if not room:
                    break
        emptied = False
        for q in sorted(taken):
            runs.append((w, offset, q, taken[q]))
            offset += taken[q]
            left[q] -= taken[q]
            deficit[q] -= taken[q]
            emptied |= not left[q]
        if emptied:
            active, settled = [q for q in active if left[q]], False
    return runs


def _pack(window: int, quantum: int):
    def run(key, rows: pa.Table, state: pa.Table) -> pa.Table:
        (state,) = state.to_pylist()
        rows = rows.sort_by([("doc_id", "ascending"), ("n", "ascending")])
        queues = {x["queue"]: k for k, x in enumerate(state["queues"])}
        docs = [[] for _ in queues]
        names = rows.column("queue").to_pylist()
        for k, name in enumerate(names):
            docs[queues[name]].append(k)
        ids, counts, blobs = rows.column("doc_id").to_pylist(), np.asarray(rows.column("n")), rows.column("ids")
        total = int(counts.sum())
        sizes = [window] * (total // window) + [1 << b for b in range(window.bit_length() - 1, -1, -1) if (total % window) >> b & 1]
        by_queue = [[] for _ in queues]
        for w, offset, q, n in deficit_round_robin(sizes, [int(counts[d].sum()) if d else 0 for d in docs], [x["share"] for x in state["queues"]], [x["carried"] for x in state["queues"]], quantum):
            by_queue[q].append((w, offset, n))
        out: list[list] = [[] for _ in range(8)]
        for name, q in queues.items():
            if not docs[q]:
                continue
            runs = np.asarray(by_queue[q], dtype=np.int64)
            run_ends, doc_ends = np.cumsum(runs[:, 2]), np.cumsum(counts[docs[q]])
            cuts = np.union1d(run_ends, doc_ends)
            starts = np.concatenate([[0], cuts[:-1]])
            r, d = np.searchsorted(run_ends, starts, "right"), np.searchsorted(doc_ends, starts, "right")
            bytes_ = memoryview(np.concatenate([_ids(blobs[k].as_py()) for k in docs[q]])).cast("B")
            out[0] += [ids[docs[q][k]] for k in d.tolist()]
            out[1] += (starts - (doc_ends - counts[docs[q]])[d]).tolist()
            out[2] += (cuts - starts).tolist()
            out[3] += [zlib.crc32(bytes_[4 * a : 4 * b]) for a, b in zip(starts.tolist(), cuts.tolist(), strict=True)]
            out[4] += counts[docs[q]][d].tolist()
            out[5] += (state["first"] + runs[r, 0]).tolist()
            out[6] += (runs[r, 1] + starts - (run_ends - runs[:, 2])[r]).tolist()
            out[7] += [name] * len(cuts)
        return pa.table([pa.array(x, pa.int64()) for x in out[:7]] + [pa.array(out[7], pa.string())], names=[x.split()[0] for x in PIECES.split(", ")])

    return run


def default_paths() -> tuple[str, str, str]:
    import public_tokenizers as P

    return P.path("byte_bpe_50k.json"), P.path("byte_bpe_50k.tiktoken"), P.PATTERN


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", queue_col: str = "source", weights: dict | None = None, window: int = 1024, quantum: int = 1, end_id: int = 0, chunk_tokens: int = 8_000_000, tokenizer: tuple[str, str, str] | None = None) -> DataFrame:
    """Cut documents into pieces and place them in sequences of at most ``window`` tokens.

    ``weights`` maps a queue's name to its target share; without it the target
    is each queue's share of all tokens, so that every window mirrors the
    corpus. Documents are tokenised once; then each goes to the chunk of about
    ``chunk_tokens`` that its place in its own queue falls into when all queues
    run side by side at their target shares, so a chunk holds every queue at
    target however the input is laid out. Places are prefix sums over tasks. A
    chunk is the unit that one task packs. It starts with the deficits that the
    chunks before it leave (what a queue was due so far, less what it has had),
    and its last, partial window is cut into powers of two, so there is no
    padding. Queues of share 0 follow when the others have run dry. Sources may
    number some thousands: a chunk's state names each of them.

    A null text is empty (only the end id), a null queue is a queue of its own,
    a null id is kept; repeated rows are packed once each; an empty table gives
    no pieces. Further columns are ignored. A document is never cut by a
    chunk boundary; the chunk it starts in grows by what is over.
    """
    paths = tokenizer or default_paths()
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), F.col(queue_col).cast("string").alias("queue"))
    tokens = materialise(rows.mapInArrow(_tokenise(paths, end_id), "task long, queue string, at long, doc_id long, n long, ids binary"), "pack")
    counts = materialise(tokens.groupBy("task", "queue").agg(F.sum("n").alias("n")), "pack-tasks")
    share = counts.groupBy("queue").agg(F.sum("n").alias("all"))
    if weights is None:
        share = share.select("queue", F.col("all").cast("double").alias("share"))
    else:
        w = F.lit(0.0)
        for name, x in weights.items():
            w = F.when(F.col("queue").eqNullSafe(F.lit(name)), F.lit(float(x))).otherwise(w)
        share = share.select("queue", w.alias("share"))
    whole = max(share.agg(F.sum("share").alias("whole")).first().whole or 0.0, 1e-300)
    # a queue of share 0 gets a rate of 1 in a second round
    rate = F.when(F.col("share") > 0, F.col("share") / F.lit(whole)).otherwise(F.lit(1.0))
    share = counts.groupBy("queue").agg(F.sum("n").cast("double").alias("all")).alias("c").join(share.alias("s"), F.expr("c.queue <=> s.queue")).select("c.queue", "c.all", (F.col("share") / F.lit(whole)).alias("share"), rate.alias("rate"), (F.col("share") > 0).alias("first"))
    share = materialise(share, "pack-shares")
    queues = share.agg(F.collect_list(F.struct("all", "rate", "first")).alias("queues"))
    before = Window.rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.withColumn("offset", F.coalesce(F.sum("n").over(before.partitionBy("queue").orderBy("task")), F.lit(0)))
    offsets = offsets.alias("o").join(share.alias("s"), F.expr("o.queue <=> s.queue")).select("o.task", F.col("o.queue").alias("of"), "o.offset", "s.rate", "s.first")
    # tokens of all queues that are due when each queue has had its rate for so long
    due = "aggregate(queues, 0D, (a, q) -> a + CASE WHEN q.first = {first} THEN least(q.rate * {time}, q.all) WHEN q.first THEN q.all ELSE 0D END)"
    offsets = F.broadcast(offsets) if counts.count() <= FEW_PLACES else offsets
    placed = tokens.alias("t").join(offsets.alias("o"), F.expr("t.task = o.task AND t.queue <=> o.of")).select("t.queue", "t.doc_id", "t.n", "t.ids", "o.first", F.expr("(o.offset + t.at) / o.rate").alias("time"))
    placed = placed.crossJoin(F.broadcast(queues)).withColumn("chunk", F.floor(F.expr(due.format(first="first", time="time")) / F.lit(chunk_tokens)).cast("long"))
    counts = materialise(placed.groupBy("chunk", "queue").agg(F.sum("n").alias("n"), F.min(F.when(F.col("first"), F.col("time"))).alias("time")), "pack-counts")
    chunks = placed.select("chunk", "queue", "doc_id", "n", "ids")
    sequences = F.expr(f"total div {window} + bit_count(total % {window})")
    totals = counts.groupBy("chunk").agg(F.sum("n").alias("total"), F.min("time").alias("time")).withColumn("sequences", sequences).withColumn("span", F.expr(f"chunk div {SPAN}"))
    # running sums over spans of chunks, then within each: a span of 8 G tokens is one row here
    so_far, first, spans = 0, 0, []
    for r in totals.groupBy("span").agg(F.sum("total").alias("total"), F.sum("sequences").alias("sequences")).orderBy("span").collect():
        spans.append((r.span, so_far, first))
        so_far, first = so_far + r.total, first + r.sequences
    spans = F.broadcast(docs.sparkSession.createDataFrame(spans, "span long, span_total long, span_first long"))
    running = before.partitionBy("span").orderBy("chunk")
    totals = totals.join(spans, "span").crossJoin(F.broadcast(queues)).select("chunk", "time", F.expr(due.format(first="true", time="time")).alias("due"), *[(F.col(f"span_{n}") + F.coalesce(F.sum(c).over(running), F.lit(0))).alias(n if n == "first" else "so_far") for n, c in (("total", "total"), ("first", "sequences"))])
    own = counts.withColumn("had", F.coalesce(F.sum("n").over(before.partitionBy("queue").orderBy("chunk")), F.lit(0)))
    state = own.alias("o").join(share.alias("s"), F.expr("o.queue <=> s.queue")).select("o.chunk", "o.queue", "o.had", "s.share", "s.rate", "s.all", F.col("s.first").alias("weighted")).join(totals, "chunk")
    entry = F.struct("queue", "share", F.expr("CASE WHEN weighted THEN least(rate * time, all) + share * (so_far - due) - had ELSE 0D END").alias("carried"))
    state = state.groupBy("chunk").agg(F.first("first").alias("first"), F.array_sort(F.collect_list(entry)).alias("queues"))
    return chunks.groupBy("chunk").cogroup(state.groupBy("chunk")).applyInArrow(_pack(window, quantum), PIECES)


def op1_packing(spark, sf_dir: str) -> DataFrame:
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"))
