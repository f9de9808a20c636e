"""Vectorised word splitting shared by the operators that read whole texts."""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame

#: Rows of an Arrow batch of texts, at most: what a task and its worker hold of the texts at once.
BATCH_ROWS = 1000
#: Functions that empty what a worker keeps between tasks.
CACHES: list[Callable[[], None]] = []
Task = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]
_BATCH_CONF = "spark.sql.execution.arrow.maxRecordsPerBatch"
#: What separates words: space and the ASCII controls TAB to CR.
WORD = r"[^\x20\x09-\x0D]+"


def strings(column: pa.Array | pa.ChunkedArray) -> pa.Array:
    """The column as one string array without nulls (null: empty text)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return pc.fill_null(column.cast(pa.large_string()), "")


def split_words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All words of all texts in order, and where each text's words begin (one more entry than texts)."""
    lists = pc.ascii_split_whitespace(texts)
    offsets = np.asarray(lists.offsets, dtype=np.int64)
    words = lists.flatten()
    offsets = offsets - offsets[0]
    full = np.asarray(pc.greater(pc.binary_length(words), 0))
    if not full.all():
        offsets = np.concatenate(([0], np.cumsum(full)))[offsets]
        words = words.filter(pa.array(full))
    return words, offsets


def word_ids(words: pa.Array, seed: int = 0) -> np.ndarray:
    """A 64-bit name for each word; each distinct word of the batch is hashed once."""
    if not len(words):
        return np.zeros(0, dtype=np.uint64)
    coded = words.dictionary_encode()
    digest = xxhash.xxh64_intdigest
    names = np.fromiter((digest(w, seed) for w in coded.dictionary.cast(pa.large_binary()).to_pylist()), dtype=np.uint64, count=len(coded.dictionary))
    return names[np.asarray(coded.indices)]


def empty_caches() -> None:
    for empty in CACHES:
        empty()


def give_back() -> None:
    """Returns freed memory to the machine, which a worker that waits for its next task would keep."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def over_texts(rows: DataFrame, run: Task, schema: str, keep: bool = False) -> DataFrame:
    """rows.mapInArrow(run, schema) in batches of at most BATCH_ROWS rows; the session keeps that bound.

    Unless `keep`, a task first empties what earlier ones left in its worker
    for their like (CACHES), so that workers which serve several operators
    hold one's state at a time.
    """
    conf = rows.sparkSession.conf
    if not 0 < int(conf.get(_BATCH_CONF)) <= BATCH_ROWS:
        conf.set(_BATCH_CONF, str(BATCH_ROWS))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if keep:
            yield from run(batches)
            return
        empty_caches()
        yield from run(batches)
        give_back()

    return rows.mapInArrow(task, schema)


def slices(batch: pa.RecordBatch, column: str, most: int = 4_000_000):
    """Cuts a batch into runs of rows of about `most` bytes of text each, so that memory stays bounded.

    The runs are copies: some string kernels misread arrays that begin inside
    their buffers.
    """
    size = np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0), dtype=np.int64)
    at, total = 0, 0
    for i, n in enumerate(size.tolist()):
        if total and total + n > most:
            yield batch.take(pa.array(np.arange(at, i)))
            at, total = i, 0
        total += n
    if at == 0 and batch.num_rows and not any(c.offset for c in batch.columns):
        yield batch
    elif batch.num_rows > at:
        yield batch.take(pa.array(np.arange(at, batch.num_rows)))
