"""Packing documents into sequences whose windows hold the sources in target proportions."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..staging import Staging
from .encoder import encoder
from .text import over_texts, slices, strings

#: Up to so many sources, every task computes the schedule of all queues by itself; beyond, a table of all quanta is
#: sorted, by the same rule.
QUEUES = 256
#: Weights are whole numbers that sum up to about so much for each QUEUES queues; phases are 64ths of a quantum.
WHOLE, GOLDEN = 2**18, 0.6180339887498949

#: Pieces that a worker keeps, and bytes of text that it encodes at a time, by default.
PIECES, TEXT_BYTES = 1_000_000, 4_000_000


class Sequences:
    """The sequences that all tokens fill: whole windows, then powers of two, which need no padding."""

    def __init__(self, total: int, window: int) -> None:
        self.window, (self.full, rest) = window, divmod(total, window)
        tail = [1 << b for b in range(window.bit_length(), -1, -1) if rest >> b & 1]
        self.tail = np.concatenate(([0], np.cumsum(tail, dtype=np.int64))).astype(np.int64) + self.full * window

    def number(self, place: np.ndarray) -> np.ndarray:
        """The sequence that holds each place."""
        return np.where(place < self.full * self.window, place // self.window, self.full + np.searchsorted(self.tail, place, side="right") - 1)

    def begin(self, sequence: np.ndarray) -> np.ndarray:
        return np.where(sequence <= self.full, sequence * self.window, self.tail[np.clip(sequence - self.full, 0, len(self.tail) - 1)])

    def cut(self, place: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(which, offset in it, length, sequence, offset in that) of stretches cut at the ends of sequences."""
        first, last = self.number(place), self.number(place + length - 1)
        times = last - first + 1
        which = np.repeat(np.arange(len(place)), times)
        sequence = np.repeat(first - (np.cumsum(times) - times), times) + np.arange(len(which))
        low, high = np.maximum(place[which], self.begin(sequence)), np.minimum((place + length)[which], self.begin(sequence + 1))
        return which, low - place[which], high - low, sequence, low - self.begin(sequence)


def whole(queues: int) -> int:
    """What the weights of so many queues sum up to, about."""
    return WHOLE * max(1, -(-queues // 256))


def quanta_of(starts: np.ndarray, counts: np.ndarray, quantum: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(document, quantum, place in its queue, length) of the stretches that documents have in each quantum of their queue."""
    low, high = starts // quantum, (starts + counts - 1) // quantum
    times = high - low + 1
    doc = np.repeat(np.arange(len(starts)), times)
    q = np.repeat(low - (np.cumsum(times) - times), times) + np.arange(len(doc))
    begin = np.maximum(q * quantum, starts[doc])
    return doc, q, begin, np.minimum((q + 1) * quantum, (starts + counts)[doc]) - begin


class Schedule:
    """Deficit round-robin over source queues, solved for any point of any queue.

    Each queue earns credit in proportion to its weight for every token that
    the packer places, and serves a quantum of tokens whenever its deficit, the
    credit not yet spent, reaches half a quantum. Deficits carry over from
    window to window; since credit is linear in what has been placed, quantum q
    of a queue of weight w is due at (q + phase) / w, and the tokens placed
    before it follow by counting the quanta of every queue that are due
    earlier. So any partition lays its own documents down without the others,
    with the deficits that a run over all windows would have reached. Queues
    start with deficits of their own (their phases), so that those of equal
    weight do not all serve at once.
    """

    def __init__(self, totals: list[int], weights: list[float] | None, quantum: int, window: int) -> None:
        self.quantum = quantum
        self.totals = np.array(totals, dtype=np.int64)
        self.quanta = -(-self.totals // quantum)
        raw = np.array(totals if weights is None else weights, dtype=np.float64)
        self.weights = np.maximum(1, np.round(raw * (whole(len(raw)) / max(raw.sum(), 1e-300)))).astype(np.int64)
        self.phase = ((np.arange(len(raw)) + 1) * GOLDEN % 1 * 64).astype(np.int64)
        self.sequences = Sequences(int(self.totals.sum()), window)

    def placed_before(self, queue: np.ndarray, q: np.ndarray) -> np.ndarray:
        """Tokens of all queues that come before quantum q of a queue."""
        out = np.empty(len(q), dtype=np.int64)
        others = np.arange(len(self.totals))
        for at in range(0, len(q), 2048):
            part = slice(at, at + 2048)
            mine, w = queue[part, None], self.weights[queue[part]][:, None]
            ahead = (64 * q[part, None] + self.phase[mine]) * self.weights[None, :] - self.phase[None, :] * w
            # a queue before this one goes first where both are due at once
            count = np.where(others[None, :] < mine, ahead // (64 * w) + 1, -(-ahead // (64 * w)))
            count = np.where(others[None, :] == mine, q[part, None], np.maximum(0, count))
            out[part] = np.minimum(self.quantum * np.minimum(count, self.quanta[None, :]), self.totals[None, :]).sum(axis=1)
        return out

    def pieces(self, queue: np.ndarray, starts: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(document, start in it, length, sequence, offset) of the pieces of documents at `starts` of their queues."""
        doc, q, begin, length = quanta_of(starts, counts, self.quantum)
        place = self.placed_before(queue[doc], q) + begin - q * self.quantum
        heads = np.flatnonzero(np.concatenate(([True], (place[1:] != place[:-1] + length[:-1]) | (doc[1:] != doc[:-1]))))
        begin, place, length, doc = (begin - starts[doc])[heads], place[heads], np.add.reduceat(length, heads), doc[heads]
        which, low, length, sequence, offset = self.sequences.cut(place, length)
        return doc[which], begin[which] + low, length, sequence, offset


def tokenized(docs: DataFrame, path: str, id_col: str, source_col: str, text_col: str, end_id: int, pieces: int = PIECES, text_bytes: int = TEXT_BYTES) -> DataFrame:
    """(doc_id, queue, pid, start, n, ids): each document's ids, and where it stands among its partition's of its source."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(path, True, end_id, pieces)
        pid = TaskContext.get().partitionId()
        running: dict[str | None, int] = {}
        for whole in batches:
            for batch in slices(whole, "text", text_bytes):
                ids, begins = coder.encode(strings(batch.column("text")))
                sources = batch.column("source").to_pylist()
                counts = np.diff(begins).tolist()
                starts = []
                for s, n in zip(sources, counts, strict=True):
                    starts.append(running.get(s, 0))
                    running[s] = starts[-1] + n
                cells = ids.astype("<u4")
                blobs = [cells[a:b].tobytes() for a, b in zip(begins[:-1].tolist(), begins[1:].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id"), batch.column("source"), pa.array([pid] * len(counts), pa.int64()), pa.array(starts, pa.int64()), pa.array(counts, pa.int64()), pa.array(blobs, pa.binary())],
                    names=["doc_id", "queue", "pid", "start", "n", "ids"],
                )

    source = F.col(source_col).cast("string")
    queue = F.coalesce(F.concat(F.lit("s"), source), F.lit("n"))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), queue.alias("source"), F.col(text_col).cast("string").alias("text"))
    return over_texts(
        rows, run, "doc_id long, queue string, pid long, start long, n long, ids binary", keep=True
    )


def pack(
    docs: DataFrame,
    tokenizer: str,
    weights: dict[str | None, float] | None = None,
    id_col: str = "doc_id",
    source_col: str = "source",
    text_col: str = "text",
    window: int = 1024,
    quantum: int = 128,
    end_id: int = 0,
    pieces: int = PIECES,
    text_bytes: int = TEXT_BYTES,
) -> DataFrame:
    """One row for each piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    Documents (ids of the whole text, then end_id) queue by source. Deficit
    round-robin over the queues fills every window of `window` tokens to the
    queues' proportions: by `weights` (by source; sources not named weigh as
    much as they hold), by default what each holds. Every source is a queue of
    its own, a null source too, however many there are. Documents are cut where
    a quantum or a window ends, no id is lost or repeated, and the last window's
    rest goes to sequences of powers of two, so that nothing is padded. A null
    text is empty and packs its end id; a null id stays null; repeated rows are
    packed each; very long texts are packed whole; an empty table gives no rows;
    columns other than the three named are not read, whatever their names.
    `pieces` and `text_bytes` bound a worker's memory.
    """
    staging = Staging(docs.sparkSession, "packing")
    rows = staging.write(tokenized(docs, tokenizer, id_col, source_col, text_col, end_id, pieces, text_bytes), "ids")
    held = staging.write(rows.groupBy("queue", "pid").agg(F.sum("n").alias("n")), "held")
    lanes = staging.write(held.groupBy("queue").agg(F.sum("n").alias("total")), "lanes")
    given = {("n" if k is None else f"s{k}"): float(v) for k, v in (weights or {}).items()}
    before = Window.partitionBy("queue").orderBy("pid").rowsBetween(Window.unboundedPreceding, -1)
    bases = staging.write(held.select("queue", "pid", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base")), "bases")
    located = rows.join(bases, ["queue", "pid"]).select("doc_id", "queue", (F.col("base") + F.col("start")).alias("at"), "n", "ids")
    if lanes.count() > QUEUES:
        return _sorted(located, lanes, given, quantum, window, staging)
    totals = {r.queue: r.total for r in lanes.collect()}  # QUEUES rows at most
    queues = sorted(totals)
    share = sum(given.get(q, 0) for q in queues)
    known = sum(totals[q] for q in queues if q in given)
    weigh = [given[q] * known / share if q in given and share else totals[q] for q in queues]
    plan = Schedule([totals[q] for q in queues], weigh, quantum, window)
    names = pa.array(queues, pa.string())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "ids"):
                queue = np.asarray(pc.index_in(batch.column("queue"), value_set=names), dtype=np.int64)
                at, n = (np.asarray(batch.column(c)) for c in ("at", "n"))
                doc, start, length, sequence, offset = plan.pieces(queue, at, n)
                blobs = [memoryview(x.as_buffer()) for x in batch.column("ids")]
                for low in range(0, len(doc), 100_000):
                    d, a, z, s, o = (x[low : low + 100_000] for x in (doc, start, length, sequence, offset))
                    crc = [zlib.crc32(blobs[i][4 * b : 4 * e]) for i, b, e in zip(d.tolist(), a.tolist(), (a + z).tolist(), strict=True)]
                    columns = [batch.column("doc_id").take(pa.array(d)), *map(pa.array, (a, z, np.array(crc, np.int64), n[d], s, o))]
                    yield pa.RecordBatch.from_arrays(columns, names=_COLUMNS)

    return over_texts(located, run, _SCHEMA, keep=True)


_COLUMNS = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
_SCHEMA = ", ".join(f"{c} long" for c in _COLUMNS)


def _sorted(located: DataFrame, lanes: DataFrame, given: dict[str, float], quantum: int, window: int, staging: Staging) -> DataFrame:
    """The same for any number of queues: a table of all quanta, sorted by when they are due, places every quantum.

    Queues have the weights and phases that `Schedule` gives them. Quantum q is
    due at (64 q + phase) / weight, which is compared exactly: by its whole
    part, by the rest over the weight, and where both are equal by queue.
    """
    spark = located.sparkSession
    named = spark.createDataFrame(list(given.items()), "queue string, given double")
    lanes = lanes.join(F.broadcast(named), "queue", "left")  # a row for each weight that the caller gave
    total, known, share = lanes.agg(F.sum("total"), F.sum(F.when(F.col("given").isNotNull(), F.col("total"))), F.sum("given")).first()
    weight = F.when(F.col("given").isNotNull() & F.lit(bool(share)), F.col("given") * F.lit((known or 0) / (share or 1))).otherwise(F.col("total").cast("double"))
    count = lanes.count()
    mass = lanes.agg(F.sum(weight)).first()[0]
    w = F.greatest(F.lit(1), F.bround(weight * F.lit(whole(count) / max(mass or 0.0, 1e-300)), 0).cast("long"))
    lanes = lanes.withColumn("w", w).withColumn("quanta", F.ceil(F.col("total") / quantum).cast("long"))
    lanes = staging.numbered(lanes, [F.col("queue")], "place", "numbered")
    lanes = lanes.withColumn("phase", (((F.col("place") + 1) * F.lit(GOLDEN)) % F.lit(1.0) * 64).cast("long"))
    step = F.greatest(F.ceil(F.col("quanta") / 100_000), F.lit(4096)).cast("long")  # a queue may hold a third of all
    parts = lanes.withColumn("step", step).withColumn("part", F.explode(F.expr("sequence(0L, (quanta - 1) div step)"))).repartition("queue", "part")
    quanta = parts.withColumn("q", F.explode(F.expr("sequence(part * step, least(quanta, (part + 1) * step) - 1)")))
    ahead = 64 * F.col("q") + F.col("phase")
    due = [F.expr("(64 * q + phase) div w").alias("due"), ((ahead % F.col("w")) / F.col("w")).alias("rest")]
    quanta = quanta.select("queue", "place", "q", F.least(F.lit(quantum), F.col("total") - F.col("q") * quantum).cast("long").alias("size"), *due)

    def running(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pid, base = TaskContext.get().partitionId(), 0
        for batch in batches:
            size = np.asarray(batch.column("size"), dtype=np.int64)
            ends = base + np.cumsum(size)
            yield pa.RecordBatch.from_arrays([batch.column("queue"), batch.column("q"), pa.array([pid] * len(size), pa.int64()), pa.array(ends - size), batch.column("size")], names=["queue", "q", "pid", "before", "size"])
            base = int(ends[-1]) if len(ends) else base

    ordered = quanta.repartitionByRange("due", "rest", "place").sortWithinPartitions("due", "rest", "place")
    order = staging.write(ordered.mapInArrow(running, "queue string, q long, pid long, before long, size long"), "order")
    sums = order.groupBy("pid").agg(F.sum("size").alias("held"))
    base = F.coalesce(F.sum("held").over(Window.orderBy("pid").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    bases = staging.write(sums.select("pid", base.alias("base")), "order-bases")  # a row for each partition
    order = order.join(F.broadcast(bases), "pid").select("queue", "q", (F.col("base") + F.col("before")).alias("due_place"))
    plan = Sequences(int(total), window)

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "ids"):
                at, n = (np.asarray(batch.column(c)) for c in ("at", "n"))
                doc, q, begin, length = quanta_of(at, n, quantum)
                start = begin - at[doc]
                blobs = [x.as_buffer() for x in batch.column("ids")]
                for low in range(0, len(doc), 20_000):
                    d, k, b, a, z = (x[low : low + 20_000] for x in (doc, q, begin, start, length))
                    cells = [blobs[i].slice(4 * x, 4 * y).to_pybytes() for i, x, y in zip(d.tolist(), a.tolist(), z.tolist(), strict=True)]
                    take = pa.array(d)
                    yield pa.RecordBatch.from_arrays(
                        [batch.column("doc_id").take(take), batch.column("queue").take(take), pa.array(k), pa.array(b - k * quantum), pa.array(a), pa.array(n[d]), pa.array(cells, pa.binary())],
                        names=["doc_id", "queue", "q", "shift", "start", "n", "ids"],
                    )

    def lay(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            place, start, n = (np.asarray(batch.column(c), dtype=np.int64) for c in ("place", "start", "n"))
            blobs = [memoryview(x.as_buffer()) for x in batch.column("ids")]
            length = np.fromiter(map(len, blobs), dtype=np.int64, count=len(blobs)) // 4
            d, low, z, sequence, offset = plan.cut(place, length)
            crc = [zlib.crc32(blobs[i][4 * b : 4 * e]) for i, b, e in zip(d.tolist(), low.tolist(), (low + z).tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(d)), *map(pa.array, (start[d] + low, z, np.array(crc, np.int64), n[d], sequence, offset))], names=_COLUMNS)

    stretches = over_texts(located, split, "doc_id long, queue string, q long, shift long, start long, n long, ids binary", keep=True)
    placed = stretches.join(order, ["queue", "q"]).select("doc_id", (F.col("due_place") + F.col("shift")).alias("place"), "start", "n", "ids")
    return placed.mapInArrow(lay, _SCHEMA)
