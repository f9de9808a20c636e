"""Collocations: phrases of neighbouring words, named pair by pair in tables that all blocks of text share."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyspark
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..staging import Staging
from .recompression import mix
from .text import give_back, over_texts, slices, strings, word_ids

#: Bytes of text that a task numbers together as one block.
BLOCK_BYTES = 8 << 20
#: Numbers in one row of a block's sequence.
PART = 1 << 16
#: Dictionary entries that a task names at a time, on average and at most (each distinct pair of a block is one).
BUCKET_ENTRIES = 1 << 20
#: Rows of packed entries in one Arrow batch.
PACKED_ROWS = 32
#: First ranking of a language's phrases is by this many parts.
PARTS_OF_RANKING = 64
_LETTER, _BLANK, _BREAK = 0, 1, 2
_KIND = np.zeros(256, dtype=np.uint8)
_KIND[[0x20, 0x09]] = _BLANK
_KIND[[*b".,;:!?", *range(0x0A, 0x0E)]] = _BREAK


def cut(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """All words of all texts in lower case, the text each is from, and whether a piece ends before it."""
    texts = pc.ascii_lower(texts)
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = np.frombuffer(texts.buffers()[2] or b"", dtype=np.uint8)[offsets[0] : offsets[-1]] if len(texts) else np.zeros(0, np.uint8)
    offsets = offsets - offsets[0]
    kind = _KIND[raw]
    letter = kind == _LETTER
    first = letter.copy()  # of a word
    first[1:] &= ~letter[:-1]
    heads = offsets[:-1][np.diff(offsets) > 0]
    first[heads] = letter[heads]
    starts = np.flatnonzero(first)
    of = np.searchsorted(offsets, starts, "right") - 1
    breaks = np.cumsum(kind == _BREAK, dtype=np.int64)[starts]
    ends_before = np.ones(len(starts), dtype=bool)
    ends_before[1:] = (breaks[1:] != breaks[:-1]) | (of[1:] != of[:-1])
    data = raw[letter]
    places = np.append((np.cumsum(letter) - 1)[starts], len(data)).astype(np.int64)
    words = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(places), pa.py_buffer(data))
    return words, of, ends_before


def runs_only(codes: np.ndarray) -> np.ndarray:
    """The sequence without what has no neighbour: runs of one code, and breaks (-1) after a break."""
    real = codes >= 0
    near = np.zeros(len(codes), dtype=bool)
    both = real[1:] & real[:-1]
    near[1:] |= both
    near[:-1] |= both
    gap = ~near
    keep = near.copy()
    keep[1:] |= gap[1:] & near[:-1]  # one break after each run
    return np.where(near, codes, -1)[keep].astype(np.int32)


_BLOCKS = pa.schema(
    [("block", pa.int64()), ("part", pa.int32()), ("codes", pa.binary())]  # a block's sequence
    + [("bucket", pa.int64()), ("lang", pa.string()), ("words", pa.list_(pa.string())), ("lefts", pa.binary()), ("rights", pa.binary()), ("counts", pa.binary()), ("total", pa.int64())]  # and its dictionary
)
_NAMES = pa.schema(
    [("id", pa.int64()), ("f", pa.int64()), ("lang", pa.string()), ("word", pa.string()), ("left", pa.int64()), ("right", pa.int64())]  # a table of ids
    + [("block", pa.int64()), ("codes", pa.binary()), ("ids", pa.binary())]  # and what they are in each block
)


def _ddl(schema: pa.Schema) -> str:
    names = {"int64": "long", "int32": "int", "list<item: string>": "array<string>", "list<element: string>": "array<string>"}
    return ", ".join(f"{f.name} {names.get(str(f.type), f.type)}" for f in schema)


def _batches(rows: list[dict], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    for i in range(0, len(rows), PACKED_ROWS):
        yield pa.RecordBatch.from_pylist(rows[i : i + PACKED_ROWS], schema=schema)


def _sequence(block: int, codes: np.ndarray) -> list[dict]:
    return [{"block": block, "part": i // PART, "codes": codes[i : i + PART].tobytes()} for i in range(0, len(codes), PART)]


def _ranges(keys: np.ndarray) -> Iterator[tuple[int, int]]:
    """Where the runs of equal keys begin and end."""
    cuts = np.flatnonzero(keys[1:] != keys[:-1]) + 1
    yield from zip([0, *cuts.tolist()], [*cuts.tolist(), len(keys)], strict=True)


def _word_blocks(block_bytes: int, buckets: int):
    """A task that numbers the words of its texts, block by block."""

    def block_of(number: int, held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(held)
        words, of, ends_before = cut(strings(table.column("text")))
        if not len(words):
            return
        langs = table.column("lang").combine_chunks().dictionary_encode()
        coded = words.dictionary_encode()
        both = np.asarray(langs.indices).astype(np.int64)[of] * len(coded.dictionary) + np.asarray(coded.indices)
        names, codes, counts = np.unique(both, return_inverse=True, return_counts=True)
        lang, word = np.divmod(names, len(coded.dictionary))
        bucket = ((word_ids(coded.dictionary)[word] + word_ids(langs.dictionary)[lang]) % np.uint64(buckets)).astype(np.int64)
        order = np.lexsort((bucket, lang))
        place = np.empty(len(order), dtype=np.int64)  # codes follow the order of the dictionary's rows
        place[order] = np.arange(len(order))
        sequence = np.full(len(codes) + int(ends_before.sum()), -1, dtype=np.int64)
        sequence[np.arange(len(codes)) + np.cumsum(ends_before)] = place[codes]
        rows = _sequence(number, runs_only(sequence))
        lang, bucket, word, counts = lang[order], bucket[order], coded.dictionary.take(pa.array(word[order])), counts[order].astype(np.int64)
        for low, high in _ranges(lang * buckets + bucket):
            rows.append({"block": number, "part": low, "bucket": int(bucket[low]), "lang": langs.dictionary[int(lang[low])].as_py(), "words": word.slice(low, high - low).to_pylist(), "counts": counts[low:high].tobytes(), "total": int(counts[low:high].sum())})
        yield from _batches(rows, _BLOCKS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = pyspark.TaskContext.get().partitionId() << 33
        held, size = [], 0
        for batch in batches:
            for piece in slices(batch, "text"):
                held.append(piece)
                size += piece.column("text").nbytes
                if size >= block_bytes:
                    yield from block_of(number, held)
                    held, size, number = [], 0, number + 1
        if held:
            yield from block_of(number, held)

    return run


def _numbers(rows: pa.Table, column: str, kind: type = np.int64) -> list[np.ndarray]:
    return [np.frombuffer(v, dtype=kind) for v in rows.column(column).to_pylist()]


def _named(min_count: int, pairs: bool):
    """A function that gives ids to the frequent words or pairs of one bucket, from the dictionaries of all blocks."""

    def run(rows: pa.Table) -> pa.Table:
        give_back()  # what the group before has used
        counts = _numbers(rows, "counts")
        sizes = np.array([len(c) for c in counts])
        if pairs:
            left, right = np.concatenate(_numbers(rows, "lefts")), np.concatenate(_numbers(rows, "rights"))
            order = np.lexsort((right, left))
            new = np.ones(len(order), dtype=bool)
            new[1:] = (np.diff(left[order]) != 0) | (np.diff(right[order]) != 0)
            name = np.empty(len(order), dtype=np.int64)
            name[order] = np.cumsum(new) - 1
            first = order[new]
        else:
            langs, words = rows.column("lang").combine_chunks().dictionary_encode(), rows.column("words").combine_chunks().flatten().dictionary_encode()
            both = np.repeat(np.asarray(langs.indices).astype(np.int64), sizes) * len(words.dictionary) + np.asarray(words.indices)
            first, name = np.unique(both, return_inverse=True)
        total = np.zeros(len(first), dtype=np.int64)
        np.add.at(total, name, np.concatenate(counts))  # whole numbers, exact
        often = np.flatnonzero(total >= min_count)
        if not len(often):
            return _NAMES.empty_table()
        ids = np.full(len(total), -1, dtype=np.int64)
        ids[often] = rows.column("bucket")[0].as_py() << 32 | np.arange(len(often))
        if pairs:
            facts = {"left": left[first[often]], "right": right[first[often]]}
        else:
            lang, word = np.divmod(first[often], len(words.dictionary))
            facts = {"lang": langs.dictionary.take(pa.array(lang)), "word": words.dictionary.take(pa.array(word))}
        facts |= {"id": ids[often], "f": total[often]}
        table = pa.RecordBatch.from_arrays([pa.array(facts[f.name], f.type) if f.name in facts else pa.nulls(len(often), f.type) for f in _NAMES], schema=_NAMES)
        found, at = [], 0
        for block, start, n in zip(rows.column("block").to_pylist(), rows.column("part").to_pylist(), sizes.tolist(), strict=True):
            mine = ids[name[at : at + n]]
            known = np.flatnonzero(mine >= 0)
            if len(known):
                found.append({"block": block, "codes": (known + start).astype(np.int32).tobytes(), "ids": mine[known].tobytes()})
            at += n
        return pa.Table.from_batches([table, *_batches(found, _NAMES)], _NAMES)

    return run


def _pair_blocks(last: bool, buckets: int):
    """A function that puts table ids for a block's codes and numbers the pairs of neighbours."""

    def run(parts: pa.Table, names: pa.Table) -> pa.Table:
        give_back()  # what the group before has used
        empty = _BLOCKS.empty_table()
        if not parts.num_rows or not names.num_rows:
            return empty
        order = np.argsort(np.asarray(parts.column("part")))
        pieces = _numbers(parts, "codes", np.int32)
        codes = np.concatenate([pieces[i] for i in order])
        known, ids = np.concatenate(_numbers(names, "codes", np.int32)), np.concatenate(_numbers(names, "ids"))
        named = np.full(int(max(codes.max(), known.max())) + 2, -1, dtype=np.int64)  # the last is for -1
        named[known] = np.arange(len(ids))
        places = named[codes]
        good = np.flatnonzero((places[:-1] >= 0) & (places[1:] >= 0))
        if not len(good):
            return empty
        found, number, counts = np.unique(places[good] * len(ids) + places[good + 1], return_inverse=True, return_counts=True)
        left, right = np.divmod(found, len(ids))
        left, right, counts = ids[left], ids[right], counts.astype(np.int64)
        bucket = (mix(mix(left.astype(np.uint64), 1) + right.astype(np.uint64), 2) % np.uint64(buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        block, rows = parts.column("block")[0].as_py(), []
        if not last:
            place = np.empty(len(order), dtype=np.int64)
            place[order] = np.arange(len(order))
            whole = np.full(len(codes), -1, dtype=np.int64)
            whole[good] = place[number]
            rows = _sequence(block, runs_only(whole))
        left, right, counts, bucket = left[order], right[order], counts[order], bucket[order]
        for low, high in _ranges(bucket):
            rows.append({"block": block, "part": low, "bucket": int(bucket[low]), "lefts": left[low:high].tobytes(), "rights": right[low:high].tobytes(), "counts": counts[low:high].tobytes()})
        return pa.Table.from_batches(_batches(rows, _BLOCKS), _BLOCKS)

    return run


def _score(a: str, l: str, r: str) -> str:  # noqa: E741
    wide = "CAST({} AS DECIMAL(20,0))".format
    return f"(CAST(1000000 AS DECIMAL(7,0)) * ({wide(a)} * {wide(a)})) DIV ({wide(l)} * {wide(r)})"


def collocations(docs: DataFrame, max_words: int = 3, min_count: int = 10, subsumed_percent: int = 50, top: int = 2000, text_column: str = "text", lang_column: str = "lang", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The phrases of each language whose words stand together more than their parts would by chance.

    Texts in lower case (A-Z) are cut at `.,;:!?` and line ends into pieces,
    these at blanks and tabs into words. Phrases are 2 to `max_words` words of a
    piece that occur `min_count` times or more in a language. The rows are each
    language's first `top`: lang, rank (from 1), phrase, a (its count), l and r
    (the counts of the parts of its weakest cut), n (words of the language) and
    score, floor(1000000 a a / (l r)). A phrase inside a longer one that has
    `subsumed_percent` of its count or more is left out.

    Words are numbered within blocks of text; the blocks' dictionaries meet in
    one table, bucket by bucket of words, which gives every frequent word an id.
    A pair of neighbouring ids that is frequent gets an id in the next table, and
    so on for longer phrases: an id's pair is its first and its last k-1 words,
    which lead to the counts of all cuts and to what the phrase subsumes. Only
    dictionaries and numbers are shuffled, a block's once a level; counts are
    exact, also beyond 64 bits within the score, which fails rather than
    overflows at 38 digits.

    A null text has no words; a null language counts as `und`, together with
    rows that say `und`. Repeated rows count each time. Ties in score go by
    count, then phrase by bytes; ties of cuts to the shorter first part. No rows
    give no rows. Texts of any length are read whole (one text is never split
    over blocks). Other columns, whatever their names, are not read.
    """
    if max_words < 2 or min_count < 1:
        raise ValueError("max_words must be 2 or more and min_count 1 or more")
    spark = docs.sparkSession
    staging = Staging(spark, "collocations")
    rows = docs.select(F.col(text_column).alias("text"), F.coalesce(F.col(lang_column), F.lit("und")).alias("lang"))
    buckets = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    blocks = staging.write(over_texts(rows, _word_blocks(block_bytes, buckets), _ddl(_BLOCKS)), "blocks1")
    totals = blocks.where("bucket IS NOT NULL").groupBy("lang").agg(F.sum("total").alias("n"))
    buckets = max(buckets, -(-(totals.agg(F.sum("n")).first()[0] or 0) // BUCKET_ENTRIES))
    levels: list[DataFrame] = []
    for k in range(1, max_words + 1):
        named = staging.write(blocks.where("bucket IS NOT NULL").groupBy("bucket").applyInArrow(_named(min_count, k > 1), _ddl(_NAMES)), f"names{k}")
        levels.append(_described(named.where("id IS NOT NULL"), levels[-1] if levels else None, staging, k))
        if k == max_words:
            break
        sequences = blocks.where("bucket IS NULL").select("block", "part", "codes")
        known = named.where("id IS NULL").select(F.col("block").alias("of"), "codes", "ids")
        pairs = sequences.groupBy("block").cogroup(known.groupBy("of")).applyInArrow(_pair_blocks(k + 1 == max_words, buckets), _ddl(_BLOCKS))
        blocks = staging.write(pairs, f"blocks{k + 1}")
    found = None
    for k, level in enumerate(levels[1:], 2):
        if k < max_words:
            longer = levels[k].select(F.explode(F.array("left", "right")).alias("id"), "f").groupBy("id").agg(F.max("f").alias("longest"))
            level = level.join(longer, "id", "left").where(~F.coalesce(100 * F.col("longest") >= subsumed_percent * F.col("f"), F.lit(False)))
        cuts = [F.struct(F.expr(_score("f", f"firsts[{i - 1}]", f"lasts[{k - i - 1}]")).alias("score"), F.lit(i), F.expr(f"firsts[{i - 1}]").alias("l"), F.expr(f"lasts[{k - i - 1}]").alias("r")) for i in range(1, k)]
        level = level.withColumn("cut", F.array_min(F.array(*cuts))).select("lang", "phrase", F.col("f").alias("a"), "cut.l", "cut.r", "cut.score")
        found = level if found is None else found.union(level)
    best = _first(_first(found, top, F.pmod(F.xxhash64("phrase"), F.lit(PARTS_OF_RANKING))), top)
    return best.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def _first(phrases: DataFrame, top: int, *parts: Column) -> DataFrame:
    """The first rows of each language, or of each of its parts."""
    order = Window.partitionBy("lang", *parts).orderBy(F.desc("score"), F.desc("a"), "phrase")
    return phrases.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= top)


def _described(named: DataFrame, parents: DataFrame | None, staging: Staging, k: int) -> DataFrame:
    """The ids of one level with phrase, last word, and the counts of their first and last 1 to k words."""
    if parents is None:
        one = F.array("f")
        return staging.write(named.select("id", "lang", "f", F.col("word").alias("phrase"), F.col("word").alias("last"), one.alias("firsts"), one.alias("lasts")), f"level{k}")
    first = parents.select(F.col("id").alias("left"), "lang", F.col("phrase").alias("head"), "firsts")
    last = parents.select(F.col("id").alias("right"), "last", "lasts")
    both = named.select("id", "f", "left", "right").join(first, "left").join(last, "right")
    grown = [F.concat(c, F.array("f")).alias(c) for c in ("firsts", "lasts")]
    return staging.write(both.select("id", "lang", "f", "left", "right", F.concat_ws(" ", "head", "last").alias("phrase"), "last", *grown), f"level{k}")
