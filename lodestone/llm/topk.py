"""Exact top-k by inner product, with sorted lists read in order and bounds on what is not read yet."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..staging import Staging
from .text import give_back

#: Rows of a shard, whose lists are sorted and read together: a task's first, and the largest, to which they double.
FIRST_ROWS, SHARD_ROWS = 256, 4096
#: Queries that one pass over the vectors answers, and those that read a shard's lists together.
PASS_QUERIES, BLOCK_QUERIES = 16_384, 256
#: Rows of the vectors that a task has at least, if there are so many.
TASK_ROWS = 8192
#: Shares of the lists to which they are read one after the other, until outsiders cannot qualify.
DEPTHS = (0.02, 0.06, 0.15, 0.35, 0.65, 1.0)
#: Where more of a shard's rows than this share may still qualify, reading on costs more than their final scores.
HOPELESS = 0.25
#: Candidates for each result at which final scores are resolved.
ENOUGH = 8


def number_type(rows: int | float, queries: int | float, dims: int) -> type:
    """A type in which all sums of the search are exact, from the greatest sizes of components."""
    most = 8 * max(1, int(rows)) * max(1, int(queries)) * max(1, dims)
    return np.float64 if most < 2**53 else np.int64 if most < 2**63 else object


class Lists:
    """The sorted lists of a shard: for each dimension, all rows by their component.

    Queries read a list from its high end where their own component is
    positive, from its low end where it is negative. `read` counts the entries
    that were read and `held` those of all lists, both for all queries.
    """

    def __init__(self, ids: np.ndarray, vectors: np.ndarray) -> None:
        order = np.argsort(ids, kind="stable")
        self.ids, self.vectors = ids[order], vectors[order]
        self.by = np.argsort(self.vectors, axis=0, kind="stable")
        self.sorted = np.take_along_axis(self.vectors, self.by, axis=0)
        self.read = self.held = 0

    def search(self, queries: np.ndarray, own: np.ndarray, k: int, floor: list | None = None) -> list[tuple[np.ndarray, np.ndarray]]:
        """(ids, scores) of each query's rows that may be among its k best; ties to smaller ids.

        `own` are ids that a query leaves out, `floor` scores that k rows
        elsewhere are known to reach (None: no such score). A row's lower bound
        starts from the least of every list. Reading an entry adds to it what
        the component is above the least; the row's upper bound is its lower
        bound and what the lists that are not read yet can add at most, by the
        last values read. Lower bounds are running sums, to which each depth
        adds the entries between the last depth and this one; what is unread
        is summed once a depth. A row stays while its
        upper bound reaches the k-th best lower bound and the floor. When few
        stay, or all is read, their scores are resolved; and so they are where
        most rows stay, in one product for all such queries. Sums are exact.
        """
        n, dims = self.vectors.shape
        high = max(map(abs, (int(self.vectors.max(initial=0)), int(self.vectors.min(initial=0)))))
        wide = max(map(abs, (int(queries.max(initial=0)), int(queries.min(initial=0)))))
        kind = number_type(high, wide, dims)
        vectors, order, asked = self.vectors.astype(kind), self.sorted.astype(kind), queries.astype(kind).T
        out: list[tuple[np.ndarray, np.ndarray]] = [(np.zeros(0, np.int64), np.zeros(0, np.int64))] * len(queries)
        least = [None] * len(queries) if floor is None else floor
        open_ = np.arange(len(queries))
        own_low, own_high = np.searchsorted(self.ids, own), np.searchsorted(self.ids, own, side="right")
        positive, negative = np.maximum(asked, 0), np.minimum(asked, 0)
        first, last = order[0], order[-1]
        lower = np.zeros((n, len(queries)), dtype=kind) + (first @ positive + last @ negative if dims else 0)
        done_to = 0
        self.held += n * dims * len(queries)
        for share in DEPTHS:
            depth = min(n, max(1, int(np.ceil(share * n))))
            for j in range(dims):
                # a row stands once in each part of a list
                top, low = slice(n - depth, n - done_to), slice(done_to, depth)
                lower[self.by[top, j]] += (order[top, j] - first[j])[:, None] * positive[j]
                lower[self.by[low, j]] += (order[low, j] - last[j])[:, None] * negative[j]
            self.read += (depth - done_to) * dims * len(open_)
            done_to = depth
            above = ((order[n - depth] - first) @ positive + (order[depth - 1] - last) @ negative) if dims else np.zeros(len(open_), dtype=kind)
            # what the entries read so far take off the bound on what is unread
            off_high, off_low = positive * (order[n - depth] - first)[:, None], negative * (order[depth - 1] - last)[:, None]
            gone = self._seen(n - depth, n).astype(kind) @ off_high + self._seen(0, depth).astype(kind) @ off_low if dims and depth < n else above
            upper = lower + above - gone
            allowed = np.ones((n, len(open_)), dtype=bool)
            for i in np.flatnonzero(own_high[open_] > own_low[open_]).tolist():
                allowed[own_low[open_[i]] : own_high[open_[i]], i] = False
            stays = allowed
            for i, q in enumerate(open_.tolist()):
                bound = least[q]
                sure = lower[allowed[:, i], i]
                if len(sure) > k:
                    best = int((np.sort(sure)[::-1] if kind is object else np.partition(sure, len(sure) - k)[len(sure) - k :][::-1])[k - 1 if kind is object else -1])
                    bound = best if bound is None else max(bound, best)
                if bound is not None:
                    stays[:, i] &= (upper[:, i] >= bound).astype(bool)
            many = stays.sum(axis=0)
            hopeless = (many > HOPELESS * n) & (many > ENOUGH * k)
            done = (many <= ENOUGH * k) | (depth == n) | hopeless
            whole = vectors @ asked[:, hopeless] if dims and hopeless.any() else None
            column = np.cumsum(hopeless) - 1
            for i in np.flatnonzero(done).tolist():
                rows = np.flatnonzero(stays[:, i])
                if whole is not None and hopeless[i]:
                    scores = whole[rows, column[i]]
                else:
                    scores = vectors[rows] @ asked[:, i] if dims else np.zeros(len(rows), dtype=kind)
                if kind is not object and len(rows) > 4 * k:  # what is below the k-th best need not be ordered
                    near = scores >= np.partition(scores, len(scores) - k)[len(scores) - k]
                    rows, scores = rows[near], scores[near]
                keep = np.lexsort((rows, -scores.astype(object) if kind is object else -scores))[:k] if len(rows) > k else slice(None)
                out[open_[i]] = (self.ids[rows[keep]], scores[keep])
            if done.any():
                open_, asked, positive, negative = open_[~done], asked[:, ~done], positive[:, ~done], negative[:, ~done]
                lower = lower[:, ~done]
            if not len(open_):
                return out
        return out

    def _seen(self, low: int, high: int) -> np.ndarray:
        """Which components of which rows stand at places low to high of their lists."""
        seen = np.zeros(self.by.shape, dtype=bool)
        np.put_along_axis(seen, self.by[low:high], True, axis=0)
        return seen


class Best:
    """The k best of each query of a pass, as its task goes from shard to shard."""

    def __init__(self, own: np.ndarray, k: int) -> None:
        self.own, self.k = own, k
        self.ids: list[np.ndarray] = [np.zeros(0, np.int64)] * len(own)
        self.scores: list[np.ndarray] = [np.zeros(0, object)] * len(own)
        self.floor: list[int | None] = [None] * len(own)

    def add(self, q: int, ids: np.ndarray, scores: np.ndarray) -> None:
        if not len(ids):
            return
        ids, scores = np.concatenate((self.ids[q], ids)), np.concatenate((self.scores[q], [int(s) for s in scores.tolist()]))
        keep = sorted(range(len(ids)), key=lambda i: (-scores[i], ids[i]))[: self.k]
        self.ids[q], self.scores[q] = ids[keep], scores[keep].astype(object)
        if len(keep) == self.k:
            self.floor[q] = int(self.scores[q][-1])


def whole_numbers(rows: DataFrame, id_col: str, vector_col: str, scale: int) -> DataFrame:
    """(vec_id, v): components as floor(scale * x); vectors null or with null or non-finite components are left out.

    Components that are no longs are an error.
    """
    x = F.col(vector_col).cast("array<double>")
    sound = x.isNotNull() & F.col(id_col).isNotNull() & F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))

    def whole(c: Column) -> Column:
        big = F.abs(c * scale) >= float(2**63)
        return F.when(big, F.raise_error(F.lit("a vector's component does not fit in a long")).cast("long")).otherwise(F.floor(c * scale).cast("long"))

    return rows.where(F.coalesce(sound, F.lit(False))).select(F.col(id_col).cast("long").alias("vec_id"), F.transform(x, whole).alias("v"))


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    return np.asarray(column.flatten(), dtype=np.int64).reshape(len(column), dims)


def _against(queries: dict[int, tuple[np.ndarray, np.ndarray]], k: int):
    """Searches all vectors of a task, shard by shard, for queries (ids, vectors) by their length."""

    def answer(best: dict[int, Best], dims: int, held: list[tuple[np.ndarray, np.ndarray]]) -> None:
        own, asked = queries[dims]
        lists = Lists(np.concatenate([i for i, _ in held]), np.concatenate([v for _, v in held]))
        state = best.setdefault(dims, Best(own, k))
        for at in range(0, len(own), BLOCK_QUERIES):
            part = slice(at, at + BLOCK_QUERIES)
            for q, (ids, scores) in enumerate(lists.search(asked[part], own[part], k, state.floor[part]), at):
                state.add(q, ids, scores)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
        size: dict[int, int] = {}
        best: dict[int, Best] = {}
        for batch in batches:
            lengths = np.asarray(batch.column("v").value_lengths(), dtype=np.int64)
            for dims in np.unique(lengths).tolist():
                if dims not in queries:
                    continue
                own = batch.filter(pa.array(lengths == dims))
                ids, vectors = np.asarray(own.column("vec_id"), dtype=np.int64), _matrix(own.column("v"), dims)
                while len(ids):
                    full = size.setdefault(dims, FIRST_ROWS)
                    room = full - sum(len(i) for i, _ in waiting.get(dims, []))
                    waiting.setdefault(dims, []).append((ids[:room], vectors[:room]))
                    ids, vectors = ids[room:], vectors[room:]
                    if sum(len(i) for i, _ in waiting[dims]) >= full:
                        answer(best, dims, waiting.pop(dims))
                        size[dims] = min(SHARD_ROWS, 2 * full)
        for dims, held in waiting.items():
            answer(best, dims, held)
        for state in best.values():
            if any(abs(int(s)) >= 2**63 for scores in state.scores for s in scores):
                raise OverflowError("an inner product among a query's best does not fit in a long")
            counts = [len(i) for i in state.ids]
            columns = (np.repeat(state.own, counts), np.concatenate(state.ids), np.concatenate(state.scores).astype(np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["query_id", "vec_id", "score"])
        give_back()

    return run


def search(vectors: DataFrame, k: int = 10, query_step: int = 100, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 1024) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row whose id is divisible by query_step, its k best others.

    Queries go past all vectors in passes of at most PASS_QUERIES, which are
    broadcast. A task cuts its vectors into shards as they come, sorts a
    shard's lists once, and reads them without random access until no outsider
    can qualify; each query's k-th score so far goes from shard to shard as a
    floor, and as the first shards are small, it is soon high. Vectors are never shuffled for a query; the tasks' best,
    k for each query at most, are merged by query.

    Vectors of different length never meet; those of length 0 are alike, with
    score 0. Repeated ids are rows of their own, but a query's own id is left
    out altogether; a query id that repeats is asked once, with its smallest
    vector. Sums are exact at any size; a component, or a score among a
    query's best, that does not fit in a long is an error. An empty table, or
    one without others, gives no rows; other columns are not read.
    """
    spark = vectors.sparkSession
    staging = Staging(spark, "topk")
    rows = staging.write(whole_numbers(vectors, id_col, vector_col, scale), "vectors")
    count = rows.count()
    parts = max(1, min(-(-count // TASK_ROWS), 100_000))
    if rows.rdd.getNumPartitions() < min(parts, 2 * spark.sparkContext.defaultParallelism):
        rows = staging.write(rows.repartition(parts), "dealt")
    asked = rows.where(F.col("vec_id") % query_step == 0).groupBy(F.size("v").alias("d"), "vec_id").agg(F.min("v").alias("v"))
    asked = staging.write(asked, "queries")
    passes = -(-asked.count() // (PASS_QUERIES // 2))
    found = None
    for number in range(passes):
        mine = F.pmod(F.xxhash64("vec_id"), F.lit(passes)) == number
        table = asked.where(mine).select("d", "vec_id", "v").toArrow()  # PASS_QUERIES rows at most, by their number and a hash
        queries = {}
        for dims in table.column("d").unique().to_pylist():
            own = table.filter(pc.equal(table.column("d"), dims)).combine_chunks()
            queries[dims] = (np.asarray(own.column("vec_id"), dtype=np.int64), _matrix(own.column("v").combine_chunks(), dims))
        best = staging.write(rows.mapInArrow(_against(queries, k), "query_id long, vec_id long, score long"), f"best-{number}")
        found = best if found is None else found.union(best)
    if found is None:
        found = spark.createDataFrame([], "query_id long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def brute_force(ids: np.ndarray, vectors: np.ndarray, k: int, query_step: int) -> pd.DataFrame:
    """The same by all inner products; for tests and small tables."""
    rows = []
    for i in np.flatnonzero(ids % query_step == 0):
        scores = [sum(int(a) * int(b) for a, b in zip(v, vectors[i], strict=True)) for v in vectors]
        order = [j for j in sorted(range(len(ids)), key=lambda j: (-scores[j], ids[j])) if ids[j] != ids[i]][:k]
        rows += [(int(ids[i]), r + 1, int(ids[j]), int(scores[j])) for r, j in enumerate(order)]
    return pd.DataFrame(rows, columns=["query_id", "rank", "vec_id", "score"])
