"""Queries against all records in blocks: matrix products in tasks, which keep the best of each query, or count what is better.

Queries go past the records in blocks of bounded size; records are read once for
each block and are never shuffled. Products only choose: what they choose, or
cannot tell apart, is summed again from left to right, so that scores and ranks
don't depend on how records are dealt.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import RetrievalError
from ..functions import vectors as V
from ..staging import Staging

#: Bytes of queries in one block, which every task gets.
BLOCK_BYTES = 32 << 20
#: Cells of one product.
PRODUCT_CELLS = 2 << 20
#: Scores that one task of a whole ranking holds, on average, and cells that it sums at once.
HELD_SCORES, RANKED_CELLS = 8 << 20, 256 << 10
#: Bytes of records up to which a task of `whole_rankings` holds all of them, and rows that it gives at once.
HELD_BYTES, GIVEN_ROWS = 1 << 30, 100_000
#: Records in one packed row.
PACKED_ROWS = 256
#: Far more than products and sums of unit vectors may differ, far less than scores that matter.
EPSILON = 1e-9
BEST = "query_id string, chunk_id string, document_id string, page_number int, score double"
COUNTS = "query_id string, chunk_id string, better long"
RANKING = "query_id string, chunk_id string, document_id string, page_number int, score double, rank int"


def left_to_right(rows: np.ndarray) -> np.ndarray:
    """The sum of each row, in order."""
    return np.cumsum(rows, axis=1)[:, -1] if rows.shape[1] else np.zeros(len(rows))


def matrix(lists: pa.ListArray | pa.ChunkedArray, width: int | None = None) -> np.ndarray:
    """Equally long lists of numbers as rows."""
    lists = lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists
    sizes = np.diff(np.asarray(lists.offsets))
    width = width if width is not None else int(sizes[0]) if len(sizes) else 0
    if lists.null_count or (sizes != width).any():
        raise RetrievalError(f"vectors must have {width} numbers each")
    return np.asarray(lists.flatten(), dtype=np.float64).reshape(len(lists), width)


class Queries:
    """One block of queries; with `on`, their places by the value that records must agree in."""

    def __init__(self, rows: pa.Table, on: str | None) -> None:
        self.ids = rows.column("query_id").to_pylist()
        self.vectors = matrix(rows.column("vector"))
        self.norms = np.sqrt(left_to_right(self.vectors**2))
        self.places: dict | None = None
        if on:
            self.places = {}
            for i, value in enumerate(rows.column(on).to_pylist()):
                if value is not None:
                    self.places.setdefault(value, []).append(i)
        self.place_of = {q: i for i, q in enumerate(self.ids)}

    def meetings(self, batch: pa.RecordBatch, on: str | None, wanted: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(places of records in the batch, places of queries) that meet, each a product of bounded size."""
        if self.places is None:
            groups = [(np.arange(batch.num_rows), np.arange(len(self.ids)))]
        else:
            values = batch.column(on).dictionary_encode()
            coded = np.asarray(values.indices.fill_null(-1))
            groups = [(np.flatnonzero(coded == i), np.array(self.places[v])) for i, v in enumerate(values.dictionary.to_pylist()) if v in self.places]
        for rows, queries in groups:
            if wanted is not None:
                queries = queries[wanted[queries]]
            step = max(1, PRODUCT_CELLS // max(1, len(rows)))
            for i in range(0, len(queries), step):
                yield rows, queries[i : i + step]


def query_blocks(queries: DataFrame, on: str | None, block_bytes: int | None = None) -> Iterator[Queries]:
    """The queries (query_id, vector[, on]) in blocks by hash, one after the other."""
    facts = queries.agg(F.count("*"), F.max(F.size("vector"))).first()
    blocks = max(1, -(-(facts[0] * ((facts[1] or 0) * 8 + 200)) // (block_bytes or BLOCK_BYTES)))
    columns = [F.col("query_id").cast("string").alias("query_id"), F.col("vector").cast("array<double>").alias("vector"), *([on] if on else [])]
    for i in range(blocks if facts[0] else 0):
        rows = queries.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == i).select(*columns).toArrow()
        if rows.num_rows:
            yield Queries(rows, on)


class Best:
    """The best k records of each query of a block, by score and then the smaller id."""

    def __init__(self, queries: int, k: int) -> None:
        self.k, self.floor = k, np.full(queries, -np.inf)
        self.query, self.score, self.rows = np.zeros(0, np.int64), np.zeros(0), np.zeros((0, 3), dtype=object)

    def add(self, query: np.ndarray, score: np.ndarray, rows: np.ndarray) -> None:
        query, score, rows = np.concatenate((self.query, query)), np.concatenate((self.score, score)), np.concatenate((self.rows, rows))
        order = np.lexsort((rows[:, 0].astype(str), -score, query))
        query = query[order]
        place = np.arange(len(query)) - np.searchsorted(query, query)
        kept = order[place < self.k]
        self.query, self.score, self.rows = query[place < self.k], score[kept], rows[kept]
        last = np.flatnonzero(place[place < self.k] == self.k - 1)
        self.floor[self.query[last]] = self.score[last]


def _rows_of(batch: pa.RecordBatch) -> np.ndarray:
    out = np.empty((batch.num_rows, 3), dtype=object)
    for i, c in enumerate(("chunk_id", "document_id", "page_number")):
        out[:, i] = batch.column(c).to_pylist()
    return out


def _pairs(approx: np.ndarray, floor: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Places in a product that may be among the best."""
    if len(approx) > k:
        floor = np.maximum(floor, np.partition(approx, len(approx) - k, axis=0)[len(approx) - k])
    return np.nonzero(approx >= floor - EPSILON)


class Records:
    """A piece of a batch of records, small enough for one product: vectors, norms (1 for sparse unit vectors) and names."""

    def __init__(self, batch: pa.RecordBatch, block: Queries, column_of: np.ndarray | None, others: bool) -> None:
        self.batch, self.rows_of, width = batch, _rows_of(batch), block.vectors.shape[1]
        if column_of is None:
            self.vectors = matrix(batch.column("vector"), width)
            self.norms = np.sqrt(left_to_right(self.vectors**2))
        else:
            buckets = batch.column("buckets")
            columns = column_of[np.clip(np.asarray(buckets.flatten()), -1, len(column_of) - 2)]
            of = np.repeat(np.arange(batch.num_rows), np.diff(np.asarray(buckets.offsets)))
            self.vectors, self.norms = np.zeros((batch.num_rows, width)), np.ones(batch.num_rows)
            self.vectors[of[columns >= 0], columns[columns >= 0]] = np.asarray(batch.column("weights").flatten())[columns >= 0]
        self.own = {i: block.place_of[c] for i, c in enumerate(batch.column("chunk_id").to_pylist()) if c in block.place_of} if others else {}

    @classmethod
    def pieces(cls, batch: pa.RecordBatch, block: Queries, column_of: np.ndarray | None, others: bool) -> Iterator[Records]:
        step = max(1, PRODUCT_CELLS // max(1, block.vectors.shape[1]))
        for i in range(0, batch.num_rows, step):
            yield cls(batch.slice(i, step), block, column_of, others)

    def products(self, rows: np.ndarray, block: Queries, queries: np.ndarray) -> np.ndarray:
        """Scores but for rounding; records that are the query itself have none."""
        found = (self.vectors[rows] @ block.vectors[queries].T) / (self.norms[rows][:, None] * block.norms[queries])
        for i, row in enumerate(rows.tolist() if self.own else ()):
            if row in self.own:
                found[i, queries == self.own[row]] = -np.inf
        return found

    def exact(self, rows: np.ndarray, block: Queries, queries: np.ndarray) -> np.ndarray:
        return left_to_right(block.vectors[queries] * self.vectors[rows]) / (block.norms[queries] * self.norms[rows])


def _searching(shared, k: int, on: str | None, others: bool, digits: int | None = None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, column_of = shared.value
        best = Best(len(block.ids), k)
        for batch in batches:
            for piece in Records.pieces(batch, block, column_of, others):
                able = None
                if column_of is not None:  # no record of a piece can score more than their largest weights together
                    able = piece.vectors.max(axis=0) @ block.vectors.T >= best.floor - EPSILON
                for rows, queries in block.meetings(piece.batch, on, able):
                    approx = piece.products(rows, block, queries)
                    r, q = _pairs(approx, best.floor[queries], k)
                    real = approx[r, q] > -np.inf
                    r, q = rows[r[real]], queries[q[real]]
                    for i in range(0, len(r), 100_000):
                        rr, qq = r[i : i + 100_000], q[i : i + 100_000]
                        score = piece.exact(rr, block, qq)
                        best.add(qq, np.round(score, digits) if digits is not None else score, piece.rows_of[rr])
        yield from _found(block, best)

    return run


def _found(block: Queries, best: Best) -> Iterator[pa.RecordBatch]:
    for i in range(0, len(best.query), 10_000):
        rows = best.rows[i : i + 10_000]
        yield pa.RecordBatch.from_pydict(
            {"query_id": [block.ids[q] for q in best.query[i : i + 10_000]], "chunk_id": rows[:, 0], "document_id": rows[:, 1], "page_number": pa.array(rows[:, 2], pa.int32()), "score": best.score[i : i + 10_000]},
            schema=pa.schema([("query_id", pa.string()), ("chunk_id", pa.string()), ("document_id", pa.string()), ("page_number", pa.int32()), ("score", pa.float64())]),
        )


def _passes(records: DataFrame, blocks: Iterator[tuple], task, schema: str) -> DataFrame:
    """One pass over the records for each block, which every task gets."""
    spark, out = records.sparkSession, None
    for block in blocks:
        found = records.mapInArrow(task(spark.sparkContext.broadcast(block)), schema)
        out = found if out is None else out.union(found)
    return out if out is not None else spark.createDataFrame([], schema)


def best_dense(index: DataFrame, queries: DataFrame, k: int, on: str | None = None, others: bool = False, digits: int | None = None) -> DataFrame:
    """Of every task the k records best for each query by cosine, a superset of the best k of all.

    With `on`, a query meets the records that agree in that column; with
    `others`, no record whose id is the query's. Scores may be rounded to
    `digits` before they are compared.
    """
    _digits(digits)
    blocks = ((block, None) for block in query_blocks(queries, on))
    return _passes(_dense_records(index, on), blocks, lambda shared: _searching(shared, k, on, others, digits), BEST)


def _dense_records(index: DataFrame, on: str | None) -> DataFrame:
    return index.select("chunk_id", "document_id", "page_number", F.col("vector").cast("array<double>").alias("vector"), *([on] if on and on not in ("document_id", "page_number") else []))


def _counting(shared, on: str | None, others: bool, tie: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, column_of, of, ids, scores = shared.value  # the wanted records, by query and score
        first, last = np.searchsorted(of, np.arange(len(block.ids))), np.searchsorted(of, np.arange(len(block.ids)), "right")
        better = np.zeros(len(of), dtype=np.int64)
        for batch in batches:
            for piece in Records.pieces(batch, block, column_of, others):
                for rows, queries in block.meetings(piece.batch, on, last > first):
                    approx = piece.products(rows, block, queries)
                    order = np.argsort(approx, axis=0)
                    for j, q in enumerate(queries.tolist()):
                        column, wanted = approx[order[:, j], j], slice(first[q], last[q])
                        low, high = np.searchsorted(column, scores[wanted] - EPSILON), np.searchsorted(column, scores[wanted] + EPSILON, "right")
                        better[wanted] += len(column) - high
                        for w in np.flatnonzero(high > low):  # these are told apart by their sums and ids
                            near, at = rows[order[low[w] : high[w], j]], first[q] + w
                            above = piece.exact(near, block, np.full(len(near), q)) - scores[at]
                            names = piece.rows_of[near, 0].astype(str)
                            better[at] += int(((above > tie) | ((np.abs(above) <= tie) & (names < ids[at]))).sum())
        yield pa.RecordBatch.from_pydict({"query_id": [block.ids[q] for q in of.tolist()], "chunk_id": ids, "better": better}, schema=pa.schema([("query_id", pa.string()), ("chunk_id", pa.string()), ("better", pa.int64())]))

    return run


def _counted(records: DataFrame, blocks: Iterator[tuple[Queries, np.ndarray | None]], scored: DataFrame, on: str | None, others: bool, digits: int | None) -> DataFrame:
    """(query_id, chunk_id, rank) of the rows in `scored` (query_id, chunk_id, score)."""

    def shared() -> Iterator[tuple]:
        for block, column_of in blocks:
            names = records.sparkSession.createDataFrame([(q,) for q in block.ids], "query_id string")
            found = scored.join(F.broadcast(names), "query_id", "left_semi").select("query_id", "chunk_id", "score").toArrow()
            of = np.array([block.place_of[q] for q in found.column("query_id").to_pylist()], dtype=np.int64)
            scores = np.asarray(found.column("score"), dtype=np.float64)
            order = np.lexsort((scores, of))
            ids = found.column("chunk_id").to_pylist()
            yield block, column_of, of[order], [ids[i] for i in order], scores[order]

    tie = 0.0 if digits is None else 0.5 * 10.0**-digits
    counted = _passes(records, shared(), lambda sent: _counting(sent, on, others, tie), COUNTS)
    return counted.groupBy("query_id", "chunk_id").agg((F.sum("better") + 1).cast("int").alias("rank"))


def ranks(index: DataFrame, queries: DataFrame, wanted: DataFrame, on: str | None = None, others: bool = False, digits: int | None = None) -> DataFrame:
    """(query_id, chunk_id, rank) of wanted records among all that their query meets, by counting those that are better.

    `wanted` is (query_id, chunk_id); pairs that don't meet have no row. Nothing
    is sorted over tasks and no record is shuffled but the wanted ones: tasks
    count, and counts are summed. The wanted rows of one block of queries are
    held by each task.
    """
    _digits(digits)
    vectors = index.select("chunk_id", F.col("vector").alias("v"), *([F.col(on).alias("__on")] if on else []))
    asked = queries.select(F.col("query_id").cast("string").alias("query_id"), F.col("vector").alias("qv"), *([on] if on else []))
    pairs = wanted.select(F.col("query_id").cast("string").alias("query_id"), "chunk_id").distinct()
    met = pairs.join(asked, "query_id").join(vectors, "chunk_id").where((F.col(on) == F.col("__on")) if on else F.lit(True)).where((F.col("query_id") != F.col("chunk_id")) if others else F.lit(True))
    score = V.cosine(F.col("qv"), F.col("v"), V.norm(F.col("qv")), V.norm(F.col("v")))
    scored = met.select("query_id", "chunk_id", (F.round(score, digits) if digits is not None else score).alias("score"))
    blocks = ((block, None) for block in query_blocks(queries.join(pairs.select("query_id").distinct(), "query_id", "left_semi"), on))
    return _counted(_dense_records(index, on), blocks, scored, on, others, digits)


def _scores(queries: np.ndarray, records: np.ndarray) -> np.ndarray:
    """Cosines of all queries with all records, each summed from left to right."""
    norms = [np.sqrt(left_to_right(m**2)) for m in (queries, records)]
    out = np.empty((len(queries), len(records)))
    for low in range(0, len(records), step := max(1, RANKED_CELLS // max(1, len(queries)))):
        part = np.ascontiguousarray(records[low : low + step].T)
        sums = np.zeros((len(queries), part.shape[1]))
        for d in range(len(part)):
            sums = sums + queries[:, d, None] * part[d] if d else queries[:, d, None] * part[d]
        with np.errstate(divide="ignore", invalid="ignore"):
            out[:, low : low + step] = sums / (norms[0][:, None] * norms[1][low : low + step])
    return out


def group_ranks(index: DataFrame, queries: DataFrame, on: str) -> DataFrame:
    """(query_id, chunk_id, rank) of all records that agree with their query in `on`, among all records but the query itself.

    Every record goes past every query, which is what a whole ranking asks for.
    Queries are dealt in groups whose scores fit in HELD_SCORES; a task holds
    those, the records' ids and one query's order, and nothing goes through the
    driver. Records are sent once for each group.
    """
    size, asked = index.count(), queries.count()
    groups = max(1, -(-asked * max(1, size) // HELD_SCORES))
    left = queries.select(F.pmod(F.xxhash64(F.col("query_id").cast("string")), F.lit(groups)).alias("g"), F.col("query_id").cast("string").alias("query_id"), F.col(on).alias("on"), F.col("vector").cast("array<double>").alias("vector"))
    right = index.select("chunk_id", F.col(on).alias("on"), F.col("vector").cast("array<double>").alias("vector"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(groups - 1).cast("long"))).alias("g"))

    def ranked(some: pa.Table, records: pa.Table) -> pa.Table:
        found = {"query_id": [], "chunk_id": [], "rank": []}
        if some.num_rows and records.num_rows:
            records = records.take(pc.sort_indices(records.column("chunk_id")))  # equal scores are then in order
            vectors = matrix(records.column("vector"))
            scores = _scores(matrix(some.column("vector"), vectors.shape[1]), vectors)
            scores[np.isnan(scores)] = np.inf  # as in a descending order of SQL
            coded = records.column("on").combine_chunks().dictionary_encode()
            codes, code_of = np.asarray(coded.indices.fill_null(-1)), {v: i for i, v in enumerate(coded.dictionary.to_pylist())}
            ids, place = records.column("chunk_id").combine_chunks(), np.empty(records.num_rows, dtype=np.int32)
            own_of = {c: i for i, c in enumerate(ids.to_pylist())}
            for q, value, row in zip(some.column("query_id").to_pylist(), some.column("on").to_pylist(), scores, strict=True):
                wanted = codes == code_of.get(value, -2)
                if q in own_of:
                    row[own_of[q]], wanted[own_of[q]] = -np.inf, False
                place[np.argsort(-row, kind="stable")] = np.arange(1, len(row) + 1)
                at = np.flatnonzero(wanted)
                found["query_id"].append(pa.DictionaryArray.from_arrays(pa.array(np.zeros(len(at), np.int32)), pa.array([q])).cast(pa.string()))
                found["chunk_id"].append(ids.take(pa.array(at)))
                found["rank"].append(pa.array(place[at], pa.int32()))
        kinds = [("query_id", pa.string()), ("chunk_id", pa.string()), ("rank", pa.int32())]
        return pa.table([pa.chunked_array(found[c], kind) for c, kind in kinds], schema=pa.schema(kinds))

    return left.groupBy("g").cogroup(right.groupBy("g")).applyInArrow(ranked, "query_id string, chunk_id string, rank int")


def _by_width(lists: pa.ListArray) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Places and rows of lists without nulls, by their length."""
    ends, values = np.asarray(lists.offsets), lists.values
    missing = np.concatenate(([0], np.cumsum(np.asarray(values.is_null())))) if values.null_count else np.zeros(len(values) + 1, np.int64)
    whole = np.asarray(lists.is_valid()) & (missing[ends[1:]] == missing[ends[:-1]])
    sizes, flat = np.diff(ends), np.asarray(values.fill_null(0.0), dtype=np.float64)
    found = {}
    for width in np.unique(sizes[whole]).tolist():
        at = np.flatnonzero(whole & (sizes == width))
        found[width] = at, flat[ends[at][:, None] + np.arange(width)]
    return found


def _descending(score: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Places from the best score on; equal scores stay in order, NaN is first and what is unknown last, as in SQL."""
    if known.all() and not np.isnan(score).any():
        order = np.argsort(-score)
        return order if (np.diff(score[order]) < 0).all() else np.argsort(-score, kind="stable")
    odd = np.isnan(score)
    return np.lexsort((np.where(odd | ~known, 0.0, -score), np.where(known, ~odd, 2)))


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for some PACKED_ROWS rows, with a list for each column."""
    for whole in batches:
        for low in range(0, whole.num_rows, PACKED_ROWS):
            batch = pa.RecordBatch.from_struct_array(pa.concat_arrays([whole.slice(low, PACKED_ROWS).to_struct_array()]))
            ends = pa.array([0, batch.num_rows], pa.int32())
            yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(ends, c) for c in batch.columns], names=batch.schema.names)


def _unpacked(lists: pa.StructArray) -> pa.RecordBatch:
    """The rows of packed ones."""
    return pa.RecordBatch.from_arrays([lists.field(i).flatten() for i in range(lists.type.num_fields)], names=[f.name for f in lists.type])


def _rankings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rankings of one group's queries over all records, query by query, from packed rows (asked, held); each batch has the group's queries again."""
    asked, held = None, []
    for batch in batches:
        if batch.num_rows:
            asked = pa.Table.from_batches([_unpacked(batch.column("asked").slice(0, 1))]) if asked is None else asked
            held.append(_unpacked(batch.column("held")))
    if asked is None:
        return
    rows = pa.Table.from_batches(held)
    del held
    rows = rows.take(pc.sort_indices(rows.column("chunk_id"))).combine_chunks()  # equal scores are then in order
    if not (asked.num_rows and rows.num_rows):
        return
    asked = asked.combine_chunks()
    names = [rows.column(c).chunk(0) for c in ("chunk_id", "document_id", "page_number")]
    norms = [np.asarray(t.column("norm").chunk(0).fill_null(0.0)) for t in (asked, rows)]
    records = {w: (at, np.ascontiguousarray(v.T)) for w, (at, v) in _by_width(rows.column("vector").chunk(0)).items()}
    ids, vectors = asked.column("chunk_id").to_pylist(), _by_width(asked.column("vector").chunk(0))
    width_of = {int(i): (w, j) for w, (at, _) in vectors.items() for j, i in enumerate(at)}
    for i, query in enumerate(ids):
        score, known = np.zeros(rows.num_rows), np.zeros(rows.num_rows, dtype=bool)
        w, j = width_of.get(i, (-1, 0))
        if w in records:
            at, columns = records[w]
            for low in range(0, len(at), RANKED_CELLS // 8):
                part = at[low : low + RANKED_CELLS // 8]
                sums = np.zeros(len(part))
                for d in range(w):
                    sums += vectors[w][1][j, d] * columns[d, low : low + len(part)]
                with np.errstate(divide="ignore", invalid="ignore"):
                    score[part] = sums / (norms[0][i] * norms[1][part])
            known[at] = True
        order = _descending(score, known)
        for low in range(0, len(order), GIVEN_ROWS):
            part = order[low : low + GIVEN_ROWS]
            places = pa.array(part)
            scores = pa.array(score[part], mask=~known[part])
            given = [pa.repeat(pa.scalar(query, pa.string()), len(part)), *(n.take(places) for n in names), scores, pa.array(np.arange(low + 1, low + len(part) + 1, dtype=np.int32))]
            yield pa.RecordBatch.from_arrays(given, names=["query_id", "chunk_id", "document_id", "page_number", "score", "rank"])


def whole_rankings(index: DataFrame, queries: DataFrame) -> DataFrame | None:
    """(query_id, chunk_id, document_id, page_number, score, rank) of all records for each query, best first, ties by chunk_id.

    A row for each query and record is what is asked for, so rows are made where
    they are ranked and are never shuffled or sorted by Spark: queries are dealt
    in groups of HELD_SCORES rows. Records are written once, and each group's
    task reads all of them; they are not sent to the groups, which would be as
    many copies as there are groups, on disk. A task holds the records and one
    query's scores; where records are too many for that (HELD_BYTES), the answer
    is None.
    """
    spark = index.sparkSession
    facts = index.agg(F.count("*"), F.max(F.size("vector"))).first()
    asked = queries.count()
    if facts[0] * ((facts[1] or 0) * 8 + 100) > HELD_BYTES:
        return None
    slots = 2 * spark.sparkContext.defaultParallelism
    groups = max(1, -(-asked * facts[0] // HELD_SCORES), min(slots, asked))
    own = F.col("norm") if "norm" in index.columns else F.lit(None).cast("double")
    vector = F.col("vector").cast("array<double>")
    place = F.pmod(F.xxhash64(F.col("query_id").cast("string")), F.lit(groups)).cast("int").alias("g")
    left = queries.select(place, F.struct(F.col("query_id").cast("string").alias("chunk_id"), vector.alias("vector"), V.norm(F.col("vector")).cast("double").alias("norm")).alias("q"))
    left = left.groupBy("g").agg(F.collect_list("q").alias("qs"))
    left = left.select("g", F.struct(*[F.col(f"qs.{c}").alias(c) for c in ("chunk_id", "vector", "norm")]).alias("asked"))
    kinds = {"chunk_id": "string", "document_id": "string", "page_number": "int", "vector": "array<double>", "norm": "double"}
    right = index.select(*[F.col(c).cast(kinds[c]).alias(c) for c in ("chunk_id", "document_id", "page_number")], vector.alias("vector"), F.coalesce(own, V.norm(F.col("vector"))).cast("double").alias("norm"))
    right = Staging(spark, "rankings").write(right.mapInArrow(_packed, ", ".join(f"{c} array<{kind}>" for c, kind in kinds.items())), "records")
    # one partition of records, and one for each group: a product's task streams the former past the group's one row
    met = right.select(F.struct(*kinds).alias("held")).coalesce(1).hint("shuffle_replicate_nl").crossJoin(left.repartitionById(groups, "g").select("asked"))
    return met.mapInArrow(_rankings, RANKING)


def _sparse_blocks(queries: DataFrame) -> Iterator[tuple[Queries, np.ndarray]]:
    """Blocks of sparse queries as rows over the buckets that any query uses, of which there are no more than dimensions."""
    used = [r.bucket for r in queries.select("bucket").distinct().orderBy("bucket").collect()]
    column_of = np.full(max(used, default=0) + 3, -1, dtype=np.int64)  # the last two are for other buckets
    column_of[used] = np.arange(len(used))
    cells = F.map_from_entries(F.collect_list(F.struct(F.col("bucket").cast("int"), "weight")))
    places = F.array(*[F.lit(b) for b in used]) if used else F.array().cast("array<int>")
    dense = queries.groupBy("query_id").agg(cells.alias("m")).select("query_id", F.transform(places, lambda b: F.coalesce(F.element_at("m", b), F.lit(0.0))).alias("vector"))
    for block in query_blocks(dense, None):
        block.norms = np.ones(len(block.ids))
        yield block, column_of


def _digits(digits: int | None) -> None:
    if digits is not None and 10.0**-digits < EPSILON:
        raise RetrievalError(f"{digits} digits are finer than products tell apart")


def best_sparse(records: DataFrame, queries: DataFrame, k: int, digits: int | None = None) -> DataFrame:
    """As `best_dense` for sparse unit vectors: `records` has lists of buckets and weights, `queries` is (query_id, bucket, weight).

    Weights must not be negative. Records are read in pieces, whose largest
    weights bound what any record in them can score; a query whose k-th score is
    above that skips the piece. Records that share no bucket with a query score
    0; they are kept only while the query is short of k. Scores are rounded to
    `digits` before they are compared.
    """
    _digits(digits)
    index = records.select("chunk_id", "document_id", "page_number", F.col("buckets").cast("array<long>").alias("buckets"), "weights")
    return _passes(index, _sparse_blocks(queries), lambda shared: _searching(shared, k, None, False, digits), BEST)
