"""Page records, their statistics and the validation of a document's pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import checks
from ..functions import text as T

# Fixed values of the report's rules.
LOW_TEXT_RATIO = 0.10
CONTROL_RATIO = 0.01
TRACEABLE = ("document_id", "filename", "page_number")
REQUIRED = (*TRACEABLE, "text", "text_sha256", "char_count", "word_count", "page_width", "page_height", "extraction_status", "extraction_error")


def page_records(pages: DataFrame) -> DataFrame:
    """Adds text_sha256, char_count, word_count and extraction_status to rows with a text.

    Rows whose status is already `failed` keep it, with null text metrics.
    """
    failed = F.coalesce(F.col("extraction_status") == "failed", F.lit(False)) if "extraction_status" in pages.columns else F.lit(False)
    text = F.coalesce("text", F.lit(""))
    status = F.when(failed, "failed").when(T.non_blank(text), "ok").otherwise("empty")
    return (
        pages.withColumn("text", text)
        .withColumn("text_sha256", F.when(~failed, F.sha2(F.encode(text, "UTF-8"), 256)))
        .withColumn("char_count", F.when(~failed, F.length(text)).otherwise(0))
        .withColumn("word_count", F.when(~failed, T.word_count(text)).otherwise(0))
        .withColumn("extraction_status", status)
    )


def _numbers(rule: Column) -> Column:
    return F.array_sort(F.collect_list(F.when(rule, F.col("page_number"))))


def page_statistics(pages: DataFrame) -> DataFrame:
    """One row for each document: counts, spreads of characters and words, and lists of odd pages.

    A page has little text below a tenth of the document's median, which needs
    the median first; the lists come from the second of two aggregations.
    """
    spread = [
        f(c).alias(f"{c.removesuffix('_count')}s_{n}")
        for c in ("char_count", "word_count")
        for n, f in (("mean", lambda c: F.round(F.avg(c), 1)), ("median", F.median), ("min", F.min), ("max", F.max))
    ]
    counts = pages.groupBy("document_id").agg(F.count("*").alias("page_count"), F.sum("char_count").alias("total_chars"), F.sum("word_count").alias("total_words"), *spread)
    ratio = T.control_ratio(F.col("text"))
    marked = pages.select("document_id", "page_number", "char_count", "extraction_status", ratio.alias("ratio")).join(counts.select("document_id", "chars_median"), "document_id")
    low = F.col("char_count") < F.when(F.col("chars_median") > 0, F.col("chars_median") * LOW_TEXT_RATIO).otherwise(0)
    lists = marked.groupBy("document_id").agg(
        _numbers(F.col("extraction_status") == "empty").alias("empty_pages"),
        _numbers(F.col("extraction_status") == "failed").alias("failed_pages"),
        _numbers(low).alias("low_text_pages"),
        F.array_sort(F.collect_list(F.when(F.col("ratio") > CONTROL_RATIO, F.struct("page_number", F.round("ratio", 4).alias("ratio"))))).alias("control_char_pages"),
    )
    return counts.join(lists, "document_id")


def provenance_problems(pages: DataFrame) -> DataFrame:
    """(document_id, page_number, problem): fields that a page must have and the table has not, then empty ones that trace it."""
    absent = [F.lit(f"missing field '{c}'") for c in REQUIRED if c not in pages.columns]
    empty = [F.when(F.col(c).isNull() | (F.col(c).cast("string") == ""), F.lit(f"empty traceability field '{c}'")) for c in TRACEABLE if c in pages.columns]
    keys = [F.col(c) if c in pages.columns else F.lit(None).cast(t).alias(c) for c, t in (("document_id", "string"), ("page_number", "int"))]
    return pages.select(*keys, F.explode(F.array_compact(F.array(*absent, *empty))).alias("problem"))


def validation_checks(pages: DataFrame, expected: DataFrame, stats: DataFrame | None = None) -> DataFrame:
    """(document_id, name, status, detail): eight checks of each document of `expected` (document_id, source_sha256, expected_pages).

    `stats` may be the pages' statistics, where they are there already.
    """
    stats = page_statistics(pages) if stats is None else stats
    problems = provenance_problems(pages).groupBy("document_id").agg(
        F.slice(F.array_sort(F.collect_list(F.concat(F.lit("page "), F.col("page_number").cast("string"), F.lit(": "), F.col("problem")))), 1, 10).alias("problems")
    )
    known = expected.join(stats, "document_id", "left").join(problems, "document_id", "left")
    shown = lambda c: F.when(F.coalesce(F.size(c), F.lit(0)) > 0, F.concat(F.lit("["), F.array_join(c, ", "), F.lit("]"))).otherwise("none")
    text = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("string")
    verdict = lambda ok: F.when(ok, "pass").otherwise("fail")
    pages_found, failed, empty = F.coalesce("page_count", F.lit(0)), F.coalesce(F.size("failed_pages"), F.lit(0)), F.coalesce(F.size("empty_pages"), F.lit(0))
    all_checks = [
        ("source_sha256_matches_manifest", F.lit("pass"), F.concat(F.lit("source SHA-256: "), F.coalesce("source_sha256", F.lit("")))),
        ("page_count_matches_manifest", verdict(pages_found == F.col("expected_pages")), F.concat(F.lit("expected "), F.col("expected_pages").cast("string"), F.lit(", parsed "), text("page_count"))),
        ("document_text_present", verdict(F.coalesce("total_chars", F.lit(0)) > 0), F.concat(F.lit("characters: "), text("total_chars"))),
        ("page_provenance_complete", verdict(F.col("problems").isNull()), F.coalesce(F.array_join("problems", "; "), F.lit("complete"))),
        ("extraction_failures", verdict(failed == 0), F.concat(F.lit("failed pages: "), shown(F.col("failed_pages")))),
        ("empty_pages_reported", F.when(empty == 0, "info").otherwise("warn"), F.concat(F.lit("empty pages: "), shown(F.col("empty_pages")))),
        ("control_char_anomalies", F.lit("info"), F.concat(F.lit("pages: "), shown(F.transform("control_char_pages", lambda p: p["page_number"])))),
        ("low_text_pages", F.lit("info"), F.concat(F.lit("pages: "), shown(F.col("low_text_pages")))),
    ]
    rows = F.explode(F.array(*[F.struct(F.lit(n).alias("name"), s.alias("status"), d.alias("detail")) for n, s, d in all_checks])).alias("c")
    return known.select("document_id", rows).select("document_id", "c.*")


def validation_report(pages: DataFrame, expected: DataFrame) -> DataFrame:
    """(document_id, overall_status)."""
    return checks.roll_up(validation_checks(pages, expected), "document_id")
