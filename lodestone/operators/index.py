"""The index: chunks joined one to one with their vectors, checked, and named from a catalog."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import checks
from ..errors import RetrievalError
from ..functions import vectors as V

#: A catalog of at most so many rows is broadcast.
CATALOG_ROWS = 100_000


def with_names(rows: DataFrame, catalog: DataFrame) -> DataFrame:
    """Adds document_name (null where the catalog has none)."""
    names = catalog.select("document_id", F.when(F.col("document_name") != "", F.col("document_name")).alias("document_name"))
    return rows.join(F.broadcast(names) if names.count() <= CATALOG_ROWS else names, "document_id", "left")


def orphans(chunks: DataFrame, embeddings: DataFrame) -> DataFrame:
    """(chunk_id, side): what only one side has; one full outer join."""
    left, right = chunks.select("chunk_id", F.lit(1).alias("l")), embeddings.select("chunk_id", F.lit(1).alias("r"))
    sided = left.join(right, "chunk_id", "full_outer").where("l is null or r is null")
    return sided.select("chunk_id", F.when(F.col("r").isNull(), "chunk without vector").otherwise("vector without chunk").alias("side"))


#: Rules of an index, in the order in which they are reported.
RULES = ("chunk repeated", "vector repeated", "chunk without vector", "vector without chunk", "bad vector", "chunk and vector of different documents", "vectors of different dimensions")


def index_checks(chunks: DataFrame, embeddings: DataFrame, dimension: int | None = None) -> DataFrame:
    """(rule, violations, example): what keeps two sides from being an index, one row for each of RULES.

    Both sides are read once: their ids, documents and the vectors' state meet
    by chunk_id, and one aggregate counts all rules. Examples are the smallest ids.
    """
    size = F.lit(dimension) if dimension else F.size("vector")
    left = chunks.select("chunk_id", F.lit(1).alias("l"), F.lit(0).alias("r"), "document_id", F.lit(None).cast("boolean").alias("bad"), F.lit(None).cast("int").alias("d"))
    right = embeddings.select("chunk_id", F.lit(0).alias("l"), F.lit(1).alias("r"), "document_id", V.problem(F.col("vector"), size).isNotNull().alias("bad"), F.size("vector").alias("d"))
    of = lambda side: F.collect_set(F.when(F.col(side) == 1, F.coalesce("document_id", F.lit("")))).alias(f"of_{side}")  # noqa: E731  a value a row, as ids should be unique
    ids = left.unionByName(right).groupBy("chunk_id").agg(F.sum("l").alias("l"), F.sum("r").alias("r"), F.max("bad").alias("bad"), F.max("d").alias("d"), of("l"), of("r"))
    broken = [
        F.col("l") > 1, F.col("r") > 1, F.col("r") == 0, F.col("l") == 0, F.coalesce("bad", F.lit(False)),
        (F.col("l") > 0) & (F.col("r") > 0) & (F.col("of_l") != F.col("of_r")),
    ]
    totals = ids.agg(
        *[c for i, b in enumerate(broken) for c in (F.count_if(b).alias(f"n{i}"), F.min(F.when(b, F.col("chunk_id"))).alias(f"e{i}"))],
        F.min("d").alias("least"), F.max("d").alias("most"), F.max_by("chunk_id", F.struct("d", "chunk_id")).alias("widest"),
    )
    rows = [F.struct(F.lit(RULES[i]).alias("rule"), F.col(f"n{i}").alias("violations"), F.col(f"e{i}").alias("example")) for i in range(len(broken))]
    differ = F.coalesce(F.col("least") != F.col("most"), F.lit(False))
    rows.append(F.struct(F.lit(RULES[-1]).alias("rule"), differ.cast("long").alias("violations"), F.when(differ, F.col("widest")).alias("example")))
    return totals.select(F.inline(F.array(*rows)))


def build_index(chunks: DataFrame, embeddings: DataFrame, catalog: DataFrame | None = None, dimension: int | None = None, document_id: str | None = None) -> DataFrame:
    """(chunk_id, document_id, page_number, text, vector, norm[, document_name]); any disagreement raises, after one job.

    `document_id` is that of records which carry none of their own, on either side.
    """
    if document_id is not None:
        own = F.coalesce(F.when(F.col("document_id") != "", F.col("document_id")), F.lit(document_id))
        chunks, embeddings = chunks.withColumn("document_id", own), embeddings.withColumn("document_id", own)
    checks.require(index_checks(chunks, embeddings, dimension), RetrievalError)
    joined = chunks.select("chunk_id", "document_id", "page_number", "text").join(embeddings.select("chunk_id", "vector"), "chunk_id")
    index = joined.select("chunk_id", "document_id", "page_number", "text", "vector", V.norm(F.col("vector")).alias("norm"))
    return with_names(index, catalog) if catalog is not None else index


def corpus_index(parts: list[DataFrame]) -> DataFrame:
    """The union of documents' indexes: ids unique over all, one dimension."""
    if not parts:
        raise RetrievalError("no documents")
    merged = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    checks.unique(merged, ["chunk_id"], RetrievalError)
    checks.one_value(merged.select(F.size("vector").alias("d")), "d", "vector dimension", RetrievalError)
    return merged


def summary(index: DataFrame) -> DataFrame:
    """(document_count, chunk_count)."""
    return index.agg(F.count_distinct("document_id").alias("document_count"), F.count("*").alias("chunk_count"))


def single_model(headers: DataFrame, allowed: tuple[str, ...]) -> str:
    """The one model that all artifacts name, which must be an allowed one."""
    name = checks.one_value(headers, "model_name", "embedding model", RetrievalError)
    if name not in allowed:
        raise RetrievalError(f"no embedder for model {name!r}")
    return str(name)
