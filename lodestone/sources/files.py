"""Reading and writing: verified binary files, page scans, JSON documents, artifact paths."""

from __future__ import annotations

from pathlib import PurePosixPath

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from .. import checks, schemas
from ..errors import IngestionError
from ..functions import text as T

def binary_files(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """(path, filename, length, content, sha256): whole files with their SHA-256 in upper case."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)
    return files.select("path", F.regexp_replace("path", "^.*/", "").alias("filename"), "length", "content", F.upper(F.sha2("content", 256)).alias("sha256"))


def verify(scanned: DataFrame, manifest: DataFrame) -> DataFrame:
    """(filename, document_id, sha256, page_count, metadata, reason): every manifest row, reason null if it passes all gates.

    `scanned` are rows of the pages source. Gates in order: the file is there,
    its SHA-256 is the manifest's in either case, it opens, is not encrypted, and
    has the manifest's number of pages.
    """
    found = scanned.where("page_number IS NULL").select("filename", "sha256", "page_count", "encrypted", "error", "metadata")
    listed = manifest.join(found, "filename", "left")
    reason = (
        F.when(F.col("sha256").isNull(), "missing")
        .when(F.col("sha256") != F.upper("expected_sha256"), "checksum differs")
        .when(F.col("error").isNotNull(), F.concat(F.lit("cannot be opened: "), F.col("error")))
        .when(F.col("encrypted"), "encrypted")
        .when(F.col("page_count") != F.col("expected_pages"), "page count differs")
    )
    document = F.coalesce("document_id", T.document_id(F.col("filename")))
    return listed.select("filename", document.alias("document_id"), "sha256", "page_count", "metadata", reason.alias("reason"))


def require_verified(verified: DataFrame) -> DataFrame:
    bad = verified.where("reason is not null").limit(10).collect()
    if bad:
        raise IngestionError("; ".join(f"{r.filename}: {r.reason}" for r in bad))
    return verified


def write_json(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).option("ignoreNullFields", "false").json(path)


def read_json(spark: SparkSession, path: str, schema: str, multi_line: bool = False) -> DataFrame:
    """Rows of a known schema; a malformed row fails the read."""
    return spark.read.schema(schema).option("mode", "FAILFAST").option("multiLine", multi_line).json(path)


def round_trip_equal(df: DataFrame, path: str, kind: str = "json") -> bool:
    """Whether what was written reads back as the same rows, repeats included: one pass over each side."""
    again = df.sparkSession.read.schema(df.schema).format(kind).load(path)
    return checks.checksum(df) == checks.checksum(again)


def artifact_path(root: str, stage: str, corpus_version: str, document_id: str, kind: str) -> str:
    """root/stage/corpus/document/document.kind.json; empty parts raise."""
    if not (stage and corpus_version and document_id and kind):
        raise IngestionError("an artifact path needs stage, corpus version, document and kind")
    return str(PurePosixPath(root) / stage / corpus_version / document_id / f"{document_id}.{kind}.json")


def embedding_dir(provider: str) -> str:
    """The stage folder of a provider's vectors; an unknown provider raises."""
    known = {"hash": "embeddings-hash", "e5": "embeddings-e5"}
    if provider not in known:
        raise IngestionError(f"unknown provider {provider!r}")
    return known[provider]


def write_partitioned(df: DataFrame, path: str, corpus_version: str, kind: str = "parquet", within: tuple[str, ...] = ()) -> None:
    """One folder for each corpus version and document (and the columns `within`), so that readers of one document open no other.

    Rows are dealt by document first, so a task opens few files; a large
    document is written by several tasks.
    """
    if "document_id" not in df.columns:
        raise IngestionError("rows must carry a document_id")
    dealt = df.withColumn("corpus_version", F.lit(corpus_version)).hint("rebalance", F.col("document_id"))
    dealt.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("corpus_version", *within, "document_id").format(kind).save(path)


def read_partitioned(spark: SparkSession, path: str, corpus_version: str, document_id: str | None = None, kind: str = "parquet", schema: StructType | None = None) -> DataFrame:
    """A corpus version's rows, or one document's; other folders are not listed for reading.

    With a schema, ids stay texts even where all of them look like numbers.
    """
    reader = spark.read.format(kind)
    if schema is not None:
        reader = reader.schema(StructType([*(f for f in schema.fields if f.name != "corpus_version"), StructField("corpus_version", StringType())]))
    rows = reader.load(path).where(F.col("corpus_version") == corpus_version)
    return rows.where(F.col("document_id") == document_id) if document_id is not None else rows


def env_value(lines: str, key: str) -> str | None:
    """The value of KEY=value among lines of an environment file, without quotes."""
    for line in lines.splitlines():
        name, found, value = line.strip().partition("=")
        if found and name.removeprefix("export ").strip() == key:
            return value.strip().strip("\"'") or None
    return None


def catalog(spark: SparkSession, rows: list[tuple]) -> DataFrame:
    """The table of documents' names and sources; all fields are text."""
    return spark.createDataFrame(rows, schemas.CATALOG)
