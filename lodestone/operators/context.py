"""Ranked results to evidence bundles under a character budget."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import checks
from ..errors import ContextError
from ..staging import Staging


def valid_results(results: DataFrame) -> DataFrame:
    """Required fields must be there, and a chunk appears once for each query.

    The results are written, as the check and what follows both read them: a few
    rows for each query, which a ranking made. One job checks all.
    """
    results = Staging(results.sparkSession, "results").write(results, "results")
    missing = F.col("chunk_id").isNull() | (F.col("chunk_id") == "") | F.col("document_id").isNull() | (F.col("document_id") == "")
    missing = missing | F.col("page_number").isNull() | F.col("score").isNull() | F.col("text").isNull()
    checks.require(checks.rules(results, {"retrieval result with an empty field": missing}, ["query_id", "chunk_id"], "query_id"), ContextError)
    return results


def budgeted(results: DataFrame, max_chars: int | None) -> DataFrame:
    """Adds `kept`: the best-first prefix within the budget; rank 1 always, and nothing after the first overflow.

    Lengths are not negative, so the running sum never falls and the prefix is
    where it is within the budget.
    """
    checks.positive_int(max_chars, "max_chars", ContextError, optional=True)
    if max_chars is None:
        return results.withColumn("kept", F.lit(True))
    running = F.sum(F.length("text")).over(Window.partitionBy("query_id").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0))
    return results.withColumn("kept", (F.col("rank") == 1) | (running <= max_chars))


def _name(rows: DataFrame) -> DataFrame:
    return rows if "document_name" in rows.columns else rows.withColumn("document_name", F.lit(None).cast("string"))


def evidence_documents(marked: DataFrame) -> DataFrame:
    """(query_id, document_id, chunk_count, pages, document_name, first_rank) of documents that keep evidence.

    The name is the first that any result of the document carries, kept or not.
    """
    rows = _name(marked)
    kept = F.col("kept")
    out = rows.groupBy("query_id", "document_id").agg(
        F.count(F.when(kept, 1)).alias("chunk_count"),
        F.array_sort(F.collect_set(F.when(kept, F.col("page_number")))).alias("pages"),
        F.min_by("document_name", F.when(F.col("document_name").isNotNull(), F.col("rank"))).alias("document_name"),
        F.min("rank").alias("first_rank"),
    )
    return out.where("chunk_count > 0")


def build_context(results: DataFrame, queries: DataFrame, max_chars: int | None = None) -> DataFrame:
    """One bundle for each query: evidence in rank order, its documents, and what the budget cut off."""
    marked = budgeted(valid_results(results), max_chars)
    item = F.struct("rank", "chunk_id", "document_id", "page_number", "score", "text", "document_name")
    bundles = _name(marked).groupBy("query_id").agg(
        F.array_sort(F.collect_list(F.when(F.col("kept"), item))).alias("evidence"),
        F.transform(F.array_sort(F.collect_list(F.when(~F.col("kept"), F.struct("rank", "chunk_id")))), lambda x: x["chunk_id"]).alias("truncated_chunk_ids"),
    )
    documents = evidence_documents(marked).groupBy("query_id").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("first_rank", "document_id", "chunk_count", "pages", "document_name"))), lambda d: F.struct(d["document_id"].alias("document_id"), d["chunk_count"].alias("chunk_count"), d["pages"].alias("pages"), d["document_name"].alias("document_name"))).alias("documents")
    )
    joined = queries.select("query_id", "query").join(bundles, "query_id", "left").join(documents, "query_id", "left")
    fill = lambda c, like: F.coalesce(F.col(c), F.array().cast(like.schema[c].dataType))
    return joined.select(
        "query_id", "query", F.coalesce(F.size("evidence"), F.lit(0)).alias("evidence_count"), fill("documents", documents).alias("documents"),
        fill("evidence", bundles).alias("evidence"), fill("truncated_chunk_ids", bundles).alias("truncated_chunk_ids"),
    ).withColumn("evidence_count", F.greatest(F.col("evidence_count"), F.lit(0)))
