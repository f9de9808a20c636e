"""Similarity search of batches of queries: scores, ranks, top-k and whole rankings.

Texts stay out of scoring; results get them by a join on the few rows kept.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import checks
from ..errors import RetrievalError
from ..functions import text as T
from ..functions import vectors as V
from ..staging import Staging
from . import blockwise

#: Queries are matched with the index in blocks of so many; one block is broadcast, more are dealt by block.
QUERY_BLOCK = 1000
#: Results of at most so many rows are broadcast.
BROADCAST_RESULTS = 250_000


def _rank(scored: DataFrame) -> DataFrame:
    return scored.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), F.col("chunk_id").asc())))


def valid_queries(queries: DataFrame) -> DataFrame:
    """Queries must be non-blank texts with unique ids."""
    checks.require(checks.rules(queries, {"blank query": ~T.non_blank(F.col("query"))}, ["query_id"], "query_id"), RetrievalError)
    return queries


def valid_top_k(top_k: object, records: int) -> None:
    """Too large a top_k raises; it is never clamped."""
    checks.positive_int(top_k, "top_k", RetrievalError)
    if top_k > records:
        raise RetrievalError(f"top_k {top_k} is more than the {records} records")


def scores(index: DataFrame, queries: DataFrame, on: str | None = None) -> DataFrame:
    """(query_id, chunk_id, document_id, page_number, score): cosine of each query with each record.

    `queries` has query_id and vector. With `on`, a query meets only the
    records that agree in that column, by an equi-join. Without, all pairs are
    asked for: the queries are cut into blocks by hash, and a single block of
    checked size is broadcast over the index; several are joined by block.
    """
    q = queries.select("query_id", F.col("vector").alias("qv"), V.norm(F.col("vector")).alias("qn"), *([on] if on else []))
    records = index.select("chunk_id", "document_id", "page_number", "vector", F.coalesce(F.col("norm"), V.norm(F.col("vector"))).alias("norm") if "norm" in index.columns else V.norm(F.col("vector")).alias("norm"))
    if on:
        met = records.join(q, on)
    else:
        blocks = -(-max(1, q.count()) // QUERY_BLOCK)
        q = q.withColumn("block", F.pmod(F.xxhash64("query_id"), F.lit(blocks)))
        records = records.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long")))) if blocks > 1 else records.withColumn("block", F.lit(0).cast("long"))
        met = records.join(F.broadcast(q) if blocks == 1 else q, "block")
    return met.select("query_id", "chunk_id", "document_id", "page_number", V.cosine(F.col("qv"), F.col("vector"), F.col("qn"), F.col("norm")).alias("score"))


def full_ranking(scored: DataFrame, top_k: int) -> DataFrame:
    """All candidates with rank and `selected`."""
    return _rank(scored).withColumn("selected", F.col("rank") <= top_k)


def full_trace(index: DataFrame, queries: DataFrame, top_k: int) -> DataFrame:
    """All records of every query with rank and `selected`: ranked where they are scored, or by Spark's sort where no task can hold the records."""
    ranked = blockwise.whole_rankings(index, queries)
    if ranked is None:
        return full_ranking(scores(index, queries), top_k)
    return ranked.withColumn("selected", F.col("rank") <= top_k)


def top(scored: DataFrame, top_k: int) -> DataFrame:
    """The best top_k of each query; ranks are limited before the shuffle too."""
    return _rank(scored).where(F.col("rank") <= top_k)


def search(index: DataFrame, queries: DataFrame, top_k: int = 5, on: str | None = None, digits: int | None = None) -> DataFrame:
    """(query_id, rank, chunk_id, document_id, page_number, score, text[, document_name]), best first, ties by chunk_id.

    Each task keeps the best top_k of its own records for every query; the few
    that leave the tasks are ranked. Scores may be rounded to `digits` first.
    """
    if on is None:
        valid_top_k(top_k, index.count())
    else:
        checks.positive_int(top_k, "top_k", RetrievalError)
    best = top(blockwise.best_dense(index, queries, top_k, on, digits=digits), top_k)
    carried = [c for c in ("text", "document_name") if c in index.columns]
    named = with_columns_of(best, index, *carried) if carried else best
    return named.select("query_id", "rank", "chunk_id", "document_id", "page_number", "score", *carried)


def lexical_search(records: DataFrame, queries: DataFrame, top_k: int = 5, digits: int | None = None) -> DataFrame:
    """(query_id, rank, chunk_id, document_id, page_number, score) of sparse unit vectors, best first, ties by chunk_id.

    `records` is (chunk_id, document_id, page_number, buckets, weights), `queries`
    is (query_id, bucket, weight). Records that share no bucket with a query
    score 0 and fill up what it is short of.
    """
    checks.positive_int(top_k, "top_k", RetrievalError)
    return top(blockwise.best_sparse(records, queries, top_k, digits), top_k).select("query_id", "rank", "chunk_id", "document_id", "page_number", "score")


def with_columns_of(results: DataFrame, records: DataFrame, *columns: str) -> DataFrame:
    """Results with columns of their records; the results are written, so that no search runs again, and go to the records if they are few."""
    found = Staging(records.sparkSession, "results").write(results, "results")
    side = F.broadcast(found) if found.count() <= BROADCAST_RESULTS else found
    return records.select("chunk_id", *columns).join(side, "chunk_id").select(*results.columns, *columns)
