"""Removal of long passages that documents share, found by recompression."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..staging import Staging
from .text import over_texts, slices, split_words, strings, word_ids

BASE = np.uint64(0x9E3779B97F4A7C15)


def rounds(window: int) -> int:
    """Rounds of run and pair naming after which a name depends on some half of a window's words; each triples them."""
    return max(1, round(math.log(max(2, window) / 2, 3)))


def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """A bijection of 64-bit numbers that looks random."""
    x = x + np.uint64((seed * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) % 2**64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Ranges:
    """Hashes of any ranges of a sequence of 64-bit names."""

    def __init__(self, names: np.ndarray, base: np.uint64) -> None:
        n = len(names)
        powers = np.full(n + 1, base, dtype=np.uint64)
        powers[0] = 1
        self.sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(names * np.cumprod(powers)[:n], dtype=np.uint64)))
        powers[1:] = np.uint64(pow(int(base), -1, 2**64))
        self.back = np.cumprod(powers)

    def __call__(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        return mix((self.sums[high] - self.sums[low]) * self.back[low], 7) + mix((high - low).astype(np.uint64), 8)


class Level:
    """The symbols of all documents at one level: names, and the words on which each symbol depends.

    A symbol stands between the same words wherever the words low..high-1
    occur, whatever comes before and after them. At the ends of a document what
    a neighbour decides is unknown, and low or high lies outside the document.
    """

    def __init__(self, name: np.ndarray, low: np.ndarray, high: np.ndarray, doc: np.ndarray, bounds: np.ndarray) -> None:
        self.name, self.low, self.high, self.doc, self.bounds = name, low, high, doc, bounds

    def _reach(self, first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The words on which the neighbours before `first` and after `last` depend."""
        n, doc = len(self.name), self.doc[first]
        before, after = np.maximum(first - 1, 0), np.minimum(last + 1, n - 1)
        has_before = (first > 0) & (self.doc[before] == doc)
        has_after = (last < n - 1) & (self.doc[after] == doc)
        return np.where(has_before, self.low[before], self.bounds[doc] - 1), np.where(has_after, self.high[after], self.bounds[doc + 1] + 1)

    def runs(self, seed: int) -> Level:
        """Each run of one symbol gets a name of its own."""
        same = (self.name[1:] == self.name[:-1]) & (self.doc[1:] == self.doc[:-1])
        first = np.flatnonzero(np.concatenate(([True], ~same)))
        last = np.append(first[1:], len(self.name)) - 1
        length = last - first + 1
        name = np.where(length > 1, mix(self.name[first] + mix(length.astype(np.uint64), seed), seed + 1), self.name[first])
        low, high = self._reach(first, last)
        return Level(name, low, high, self.doc[first], self.bounds)

    def pairs(self, seed: int) -> Level:
        """Symbols fall into left and right ones by their names; a left and a right one in turn get one name."""
        left = (mix(self.name, seed) >> np.uint64(63)) == 0
        joined = left[:-1] & ~left[1:] & (self.doc[1:] == self.doc[:-1])
        second = np.concatenate(([False], joined))
        first = np.flatnonzero(~second)
        pair = np.append(joined, False)[first]
        last = first + pair
        reach_low, reach_high = self._reach(first, last)
        name = np.where(pair, mix(mix(self.name[first], seed + 1) + self.name[last], seed + 2), self.name[first])
        low = np.where(~pair & ~left[first], reach_low, self.low[first])
        high = np.where(~pair & left[first], reach_high, self.high[last])
        return Level(name, low, high, self.doc[first], self.bounds)


def levels(names: np.ndarray, bounds: np.ndarray, count: int = 3) -> list[Level]:
    """The symbols at all levels; level 0 has the words themselves."""
    at = np.arange(len(names))
    out = [Level(names, at, at + 1, np.repeat(np.arange(len(bounds) - 1), np.diff(bounds)), bounds)]
    for r in range(count):
        out.append(out[-1].runs(10 * r + 11).pairs(10 * r + 14))
    return out


def _least(value: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Where the least value of each range low..high (both included) stands, leftmost first."""
    size = high - low + 1
    out, table, step = np.empty(len(low), dtype=np.int64), np.arange(len(value)), 1
    while len(size) and step <= size.max():
        use = np.flatnonzero((size >= step) & (size < 2 * step))
        a, b = table[low[use]], table[high[use] - step + 1]
        out[use] = np.where(value[b] < value[a], b, a)
        if 2 * step > len(value):
            break
        a, b = table[: len(table) - step], table[step:]
        table = np.where(value[b] < value[a], b, a)
        step *= 2
    return out


def anchored(names: np.ndarray, bounds: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs (first window, last window, anchor) of the windows of all documents.

    The anchor of a window is, at the highest level that has any, the symbol of
    least hash among those that depend on words of the window alone. So it
    depends on the window's words alone, and equal windows have equal anchors.
    A symbol may be a single word that never met a partner; it is hashed with
    all the words on which it depends, so that documents share an anchor only
    if they share half a window in a row (or hashes collide, which makes
    candidates and no results).
    """
    starts = np.flatnonzero(np.arange(len(names)) + window <= np.repeat(bounds[1:], np.diff(bounds)))
    if not len(starts):
        return starts, starts, np.zeros(0, np.uint64)
    doc = np.searchsorted(bounds, starts, side="right") - 1
    anchor = np.zeros(len(starts), np.uint64)
    place = np.zeros(len(starts), np.int64)
    rest, ranges = np.arange(len(starts)), Ranges(names, BASE)
    count = rounds(window)
    for number, level in reversed(list(enumerate(levels(names, bounds, count)))):
        p = starts[rest]
        low = np.searchsorted(level.low, p, side="left")
        high = np.searchsorted(level.high, p + window, side="right") - 1
        held = low <= high
        value = mix(ranges(np.maximum(level.low, 0), np.minimum(level.high, len(names))) + level.name, 1000 + number)
        best = _least(value, low[held], high[held])
        anchor[rest[held]] = value[best]
        place[rest[held]] = best * (count + 1) + number
        rest = rest[~held]
        if not len(rest):
            break
    heads = np.flatnonzero(np.concatenate(([True], (place[1:] != place[:-1]) | (doc[1:] != doc[:-1]))))
    tails = np.append(heads[1:], len(starts)) - 1
    return starts[heads], starts[tails], anchor[heads]


class Words:
    """The words of a batch's texts: their names, where each text's begin, and the words themselves."""

    def __init__(self, batch: pa.RecordBatch) -> None:
        words, self.bounds = split_words(strings(batch.column("text")))
        self.names = mix(word_ids(words))
        spaced = pc.binary_join_element_wise(words, pa.scalar("", words.type), pa.scalar(" ", words.type)).cast(pa.large_binary())
        self.at = np.frombuffer(spaced.buffers()[1], np.int64)[spaced.offset : spaced.offset + len(spaced) + 1]
        self.bytes = memoryview(spaced.buffers()[2] or b"")

    def digests(self, low: np.ndarray, high: np.ndarray) -> tuple[pa.Array, pa.Array]:
        """128 bits of BLAKE2b of the words low to high of each stretch, as two columns: what equal stretches are told by."""
        cells = b"".join(hashlib.blake2b(self.bytes[a:b], digest_size=16).digest() for a, b in zip(self.at[low].tolist(), self.at[high].tolist(), strict=True))
        both = np.frombuffer(cells, dtype="<i8").reshape(-1, 2)
        return pa.array(both[:, 0].copy()), pa.array(both[:, 1].copy())

    def shas(self) -> list[str]:
        """SHA-256 of each text's words joined by one space."""
        edges = self.at[self.bounds].tolist()
        return [hashlib.sha256(self.bytes[a : max(a, b - 1)]).hexdigest() for a, b in zip(edges[:-1], edges[1:], strict=True)]


def _parse(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text", 2_000_000):
                words = Words(batch)
                bounds = words.bounds
                first, last, anchor = anchored(words.names, bounds, window)
                k1, k2 = words.digests(first, last + window)
                doc = np.searchsorted(bounds, first, side="right") - 1
                cuts = np.searchsorted(doc, np.arange(len(bounds))).astype(np.int32)
                lists = lambda x, kind: pa.ListArray.from_arrays(pa.array(cuts), pa.array(x, kind))  # noqa: E731, B023
                columns = {
                    "doc_id": batch.column("doc_id"),
                    "th": batch.column("th"),
                    "n_words": pa.array(np.diff(bounds), pa.int64()),
                    "sha": pa.array(words.shas(), pa.string()),
                    "name": lists(anchor.view(np.int64), pa.int64()),
                    "k1": lists(k1, pa.int64()),
                    "k2": lists(k2, pa.int64()),
                    "p0": lists((first - bounds[doc]).astype(np.int32), pa.int32()),
                    "p1": lists((last - bounds[doc]).astype(np.int32), pa.int32()),
                }
                yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))

    return run


def _windows(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text", 1_000_000):
                words = Words(batch)
                ranges = batch.column("ranges")
                cuts = np.asarray(ranges.offsets, dtype=np.int64)
                flat = ranges.flatten()
                p0, p1 = (np.asarray(flat.field(c), dtype=np.int64) for c in ("p0", "p1"))
                doc = np.repeat(np.arange(batch.num_rows), np.diff(cuts))
                counts = p1 - p0 + 1
                pos = np.repeat(p0 - (np.cumsum(counts) - counts), counts) + np.arange(int(counts.sum()))
                of = np.repeat(doc, counts)
                at = pos + words.bounds[of]
                for low in range(0, len(pos), 200_000):
                    part = slice(low, low + 200_000)
                    take = pa.array(of[part])
                    yield pa.RecordBatch.from_arrays([*words.digests(at[part], at[part] + window), batch.column("doc_id").take(take), batch.column("th").take(take), pa.array(pos[part].astype(np.int32))], names=["k1", "k2", "doc_id", "th", "p0"])

    return run


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for batch in slices(whole, "text"):
            removed, shas = [], []
            for text, ranges in zip(strings(batch.column("text")).cast(pa.large_binary()), batch.column("ranges"), strict=True):
                words = text.as_py().split()
                flat = ranges.values
                edges = np.zeros(len(words) + 1, dtype=np.int64)
                np.add.at(edges, np.asarray(flat.field("p0")), 1)
                np.add.at(edges, np.asarray(flat.field("p1")), -1)
                covered = np.cumsum(edges[:-1]) > 0
                removed.append(int(covered.sum()))
                shas.append(hashlib.sha256(b" ".join(w for w, c in zip(words, covered.tolist(), strict=True) if not c)).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("th"), pa.array(removed, pa.int64()), pa.array(shas, pa.string())], names=["doc_id", "th", "n_removed", "kept_sha256"])


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 50) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256) for every row.

    A word goes if a window of `window` words that covers it also starts in a
    document of smaller id. Rounds of run and pair naming give every word
    sequence the same interior symbols wherever it stands, as names are hashes
    of what they stand for and so the same on all machines without a table of
    names. Each window is filed under one symbol that its words alone decide;
    consecutive windows of one symbol are one row. Rows whose symbol only one
    document has are done. For the others, equal stretches of windows are
    settled whole, and only the first document of each stretch gives single
    windows to compare with those of other stretches of its symbol. Symbols
    only find candidates: stretches and windows are verified by cryptographic
    digests of their words, so names that collide change no result.

    Null texts have no words. Documents with a null id stay whole and remove
    nothing. Rows of one id are one document each, and none has the smaller
    id. Very long texts are read whole. An empty table gives no rows; other
    columns are not read, whatever their names.
    """
    staging = Staging(docs.sparkSession, "repeats")
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("th"))
    parsed = staging.write(over_texts(rows, _parse(window), "doc_id long, th long, n_words long, sha string, name array<long>, k1 array<long>, k2 array<long>, p0 array<int>, p1 array<int>"), "parsed")
    stretch = parsed.where("doc_id is not null").select("doc_id", "th", F.explode(F.arrays_zip("name", "k1", "k2", "p0", "p1")).alias("r")).select("doc_id", "th", "r.*")
    differ = (F.min("k1") < F.max("k1")) | (F.min("k2") < F.max("k2"))
    shared = stretch.groupBy("name").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi"), differ.alias("several")).where("lo < hi")
    shared = staging.write(shared.select("name", "several"), "shared")
    found = staging.write(stretch.join(shared, "name").select("doc_id", "th", "k1", "k2", "p0", "p1", "several").distinct(), "found")
    least = staging.write(found.groupBy("k1", "k2").agg(F.min("doc_id").alias("lo")), "least")
    placed = staging.write(found.join(least, ["k1", "k2"]).select("doc_id", "th", "p0", "p1", "several", "lo"), "placed")
    staging.drop("shared", "found", "least")
    whole = placed.where("lo < doc_id").select("doc_id", "th", "p0", (F.col("p1") + window).alias("p1"))
    firsts = placed.where("lo = doc_id and several").groupBy("doc_id", "th").agg(F.collect_list(F.struct("p0", "p1")).alias("ranges"))
    windows = over_texts(rows.join(firsts, ["doc_id", "th"]).select("doc_id", "th", "text", "ranges"), _windows(window), "k1 long, k2 long, doc_id long, th long, p0 int")
    windows = staging.write(windows, "windows")
    first_of = windows.groupBy("k1", "k2").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).where("lo < hi").select("k1", "k2", "lo")
    first_of = staging.write(first_of, "first_of")
    alone = windows.join(first_of, ["k1", "k2"]).where("lo < doc_id").select("doc_id", "th", "p0", (F.col("p0") + window).alias("p1"))
    covered = staging.write(whole.union(alone).groupBy("doc_id", "th").agg(F.collect_set(F.struct("p0", "p1")).alias("ranges")), "covered")
    staging.drop("windows", "first_of", "placed")
    cut = over_texts(rows.join(covered, ["doc_id", "th"]).select("doc_id", "th", "text", "ranges"), _cut, "doc_id long, th long, n_removed long, kept_sha256 string")
    cut = staging.write(cut.distinct(), "cut")
    return (
        parsed.select("doc_id", "th", "n_words", "sha")
        .join(cut, ["doc_id", "th"], "left")
        .select("doc_id", "n_words", F.coalesce("n_removed", F.lit(0).cast("long")).alias("n_removed"), F.coalesce("kept_sha256", "sha").alias("kept_sha256"))
    )
