"""The ingestion report: pages, chunks and vectors of each document side by side."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import checks
from ..errors import IngestionError
from ..staging import Staging


def ingestion_report(pages: DataFrame, chunks: DataFrame, embeddings: DataFrame) -> DataFrame:
    """One row for each document of the pages; a document that only chunks or vectors know, or unequal counts, raise."""
    p = pages.groupBy("document_id").agg(F.count("*").alias("total_pages"), F.array_sort(F.collect_list(F.when(F.col("extraction_status") == "failed", F.col("page_number")))).alias("failed_pages"))
    c = chunks.groupBy("document_id").agg(F.count("*").alias("total_chunks"))
    e = embeddings.groupBy("document_id").agg(F.count("*").alias("embedded_chunks"))
    joined = p.join(c, "document_id", "full_outer").join(e, "document_id", "full_outer").na.fill(0, ["total_chunks", "embedded_chunks"])
    joined = Staging(pages.sparkSession, "report").write(joined, "counts")  # a row for each document, counted once
    broken = {"chunks or vectors of an unknown document": F.col("total_pages").isNull(), "chunk and vector counts differ": F.col("total_chunks") != F.col("embedded_chunks")}
    checks.require(checks.rules(joined, broken, ["document_id"], "document_id"), IngestionError)
    failed = F.size("failed_pages")
    return joined.select(
        "document_id", "total_pages", (F.col("total_pages") - failed).alias("parsed_pages"), "failed_pages", "total_chunks", "embedded_chunks",
        F.col("total_chunks").alias("indexed_chunks"), F.when(failed == 0, "success").otherwise("partial").alias("ingestion_status"),
    )
