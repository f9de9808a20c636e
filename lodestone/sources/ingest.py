"""Ingestion: verified files to pages, checks, reports and artifacts; also `python -m lodestone.sources.ingest`."""

from __future__ import annotations

import argparse
import importlib
import sys

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from .. import checks, schemas
from ..errors import IngestionError
from ..operators import chunking, embedding, reports
from ..operators import pages as P
from ..staging import Staging
from . import documents, files

PIPELINE_VERSION = "lodestone-ingest-2"
#: A manifest of up to so many files is a filter on the files that are opened; beyond, all of the folder is.
PRUNED_FILES = 10_000


def provenance(verified: DataFrame, parser: str, version: str) -> DataFrame:
    """(document_id, provenance): source, checksum, pages, parser, metadata and time of each document."""
    return verified.select(
        "document_id",
        F.struct(
            "document_id", F.col("filename").alias("source_filename"), F.col("sha256").alias("source_sha256"), "page_count",
            F.struct(F.lit(parser).alias("name"), F.lit(version).alias("version")).alias("parser"), F.col("metadata").alias("pdf_metadata"),
            F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss'+00:00'").alias("extraction_timestamp_utc"), F.lit(PIPELINE_VERSION).alias("pipeline_version"),
        ).alias("provenance"),
    )


def scan(spark: SparkSession, source: str, manifest: DataFrame, opener: documents.Opener = documents.Pdf, range_bytes: int = documents.RANGE_BYTES) -> DataFrame:
    """Rows of the manifest's files, from the pages source."""
    rows = spark.read.format(documents.register_pages(spark, opener)).option("rangeBytes", range_bytes).load(source)
    names = [r.filename for r in manifest.select("filename").distinct().limit(PRUNED_FILES + 1).collect()]
    return rows.where(F.col("filename").isin(names)) if len(names) <= PRUNED_FILES else rows.join(manifest.select("filename").distinct(), "filename", "left_semi")


def write_checked(pages: DataFrame, path: str, corpus_version: str) -> tuple[DataFrame, DataFrame | None]:
    """Writes pages by document; gives them as they read back, and the documents (document_id) that came back changed, or None.

    The checksum of what is written is taken as it is written, that of what was
    written in one pass over it. Only where they differ are documents compared.
    """
    seen = Observation()
    files.write_partitioned(pages.observe(seen, *checks.checksum_columns(pages.schema)), path, corpus_version)
    again = files.read_partitioned(pages.sparkSession, path, corpus_version, schema=pages.schema).select(pages.columns)
    if checks.checksum(again) == tuple(seen.get[c] for c in ("rows", "sum1", "sum2")):
        return again, None
    sums = lambda df: df.groupBy("document_id").agg(*checks.checksum_columns(df.schema))
    changed = sums(pages).exceptAll(sums(again)).union(sums(again).exceptAll(sums(pages))).select("document_id").distinct()
    return again, None if changed.isEmpty() else changed  # a task that ran twice may have been observed twice


def run_ingestion(
    spark: SparkSession,
    source: str,
    out: str,
    manifest: DataFrame,
    corpus_version: str,
    opener: documents.Opener = documents.Pdf,
    embedder: embedding.EmbeddingProvider | None = None,
    range_bytes: int = documents.RANGE_BYTES,
) -> DataFrame:
    """Verifies, scans, writes and reloads all documents of a manifest; gives one summary row for each.

    Every page is parsed once. A document that fails a gate stops the run; one
    whose checks fail does not, and its pages are written all the same. Written
    are pages, checks, provenance and summaries, and with an `embedder` also
    chunks, vectors and the ingestion report.

    The summary has document_id, overall_status, reload_ok, page_count,
    total_chars, empty_pages, failed_pages, pages_path and validation_path.
    """
    staging = Staging(spark, "ingest")
    scanned = staging.write(scan(spark, source, manifest, opener, range_bytes), "scanned")
    verified = staging.write(files.require_verified(files.verify(scanned, manifest)), "verified")
    found = scanned.where("page_number IS NOT NULL").drop("document_id", "path", "sha256", "page_count", "encrypted", "error", "metadata")
    parsed = P.page_records(found.join(verified.select("filename", "document_id"), "filename")).select(*[c.split()[0] for c in schemas.PAGES.split(", ")])
    pages, changed = write_checked(parsed, f"{out}/pages", corpus_version)
    expected = verified.select("document_id", F.col("sha256").alias("source_sha256"), F.col("page_count").alias("expected_pages"))
    wrong = expected.select("document_id", F.lit(False).alias("reload_ok")).limit(0) if changed is None else changed.withColumn("reload_ok", F.lit(False))
    reloaded = expected.select("document_id").join(wrong, "document_id", "left").withColumn("reload_ok", F.coalesce("reload_ok", F.lit(True)))
    stats = staging.write(P.page_statistics(pages), "stats")
    reload_check = reloaded.select("document_id", F.lit("reload_equivalent").alias("name"), F.when(F.col("reload_ok"), "pass").otherwise("fail").alias("status"), F.lit("written pages equal those parsed").alias("detail"))
    found_checks = staging.write(P.validation_checks(pages, expected, stats).unionByName(reload_check), "checks")
    files.write_partitioned(found_checks, f"{out}/validation", corpus_version, "json")
    files.write_partitioned(provenance(verified, getattr(opener, "__name__", "opener"), "1"), f"{out}/provenance", corpus_version, "json")
    if embedder is not None:
        write_report(spark, pages, out, corpus_version, embedder)
    at = lambda stage: F.concat(F.lit(f"{out}/{stage}/corpus_version={corpus_version}/document_id="), F.col("document_id"))
    summary = (
        checks.roll_up(found_checks, "document_id")
        .join(reloaded, "document_id")
        .join(stats.select("document_id", "page_count", "total_chars", "empty_pages", "failed_pages"), "document_id", "left")
        .withColumn("pages_path", at("pages"))
        .withColumn("validation_path", at("validation"))
    )
    files.write_partitioned(summary, f"{out}/summary", corpus_version, "json")
    return summary


def write_report(spark: SparkSession, pages: DataFrame, out: str, corpus_version: str, embedder: embedding.EmbeddingProvider) -> DataFrame:
    """Chunks, embeds and reports the pages, each written by document; gives the report."""
    files.write_partitioned(chunking.chunk_pages(pages), f"{out}/chunks", corpus_version)
    chunks = files.read_partitioned(spark, f"{out}/chunks", corpus_version)
    vectors = embedding.generate_embeddings(chunks.drop("corpus_version"), embedder).withColumn("model_name", F.lit(embedder.name))
    files.write_partitioned(vectors, f"{out}/embeddings", corpus_version, within=("model_name",))
    report = reports.ingestion_report(pages, chunks, vectors)
    files.write_partitioned(report, f"{out}/report", corpus_version, "json")
    return report


def main(argv: list[str] | None = None) -> int:
    """0 if all documents pass or pass with warnings, 1 if one's checks fail, 2 if the run stops."""
    from ..session import build_session

    options = argparse.ArgumentParser("lodestone-ingest", description="Verified documents to pages, checks and reports.")
    options.add_argument("source", help="folder of the documents")
    options.add_argument("out", help="folder of the artifacts")
    options.add_argument("--manifest", required=True, help="JSON lines: filename, document_id, expected_sha256, expected_pages")
    options.add_argument("--corpus", required=True, metavar="VERSION")
    options.add_argument("--opener", metavar="MODULE:NAME", help="how documents are opened; PDF where absent")
    options.add_argument("--embed", choices=("hash", "e5"), help="also chunk, embed and report")
    given = options.parse_args(argv)
    spark = build_session("lodestone-ingest")
    module, _, name = (given.opener or "").partition(":")
    opener = getattr(importlib.import_module(module), name) if module else documents.Pdf
    try:
        manifest = files.read_json(spark, given.manifest, schemas.MANIFEST)
        summary = run_ingestion(spark, given.source, given.out, manifest, given.corpus, opener, embedding.named_provider(given.embed) if given.embed else None)
    except IngestionError as stopped:
        print(f"stopped: {stopped}", file=sys.stderr)
        return 2
    failed = 0
    for r in summary.orderBy("document_id").toLocalIterator():
        failed += r.overall_status == "fail"
        print(f"{r.document_id}: {r.overall_status}, {r.page_count or 0} pages, {r.total_chars or 0} characters, empty {r.empty_pages or 'none'}, failed {r.failed_pages or 'none'}, reload {'equal' if r.reload_ok else 'differs'}")
    return 1 if failed else 0


if __name__ == "__main__":
    sys.exit(main())
