"""Mixing sources to target weights by capped water-filling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..staging import Staging
from .text import WORD

#: Each source's documents are dealt by hash to so many buckets, so that no task orders a whole source.
BUCKETS = 4096


def word_count(text: Column) -> Column:
    """Words of the whole text (null: 0)."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)).cast("long"), F.lit(0).cast("long"))


def water_fill(sources: DataFrame, max_epochs: float, total: float | None = None) -> DataFrame:
    """Adds `target` to (…, source_size, weight): shares of the total by weight, clamped at max_epochs times the size.

    Sources whose share is above their limit are clamped to it, and what they
    leave is shared by weight among the others, which may clamp more, until a
    round clamps none. A round is one sum over the table of sources; the driver
    holds two numbers.
    """
    known = sources.withColumn("cap", F.col("source_size") * F.lit(float(max_epochs)))
    every = known.agg(F.sum("source_size"), F.sum("weight")).first()
    size, level, clamped = float((every[0] or 0) if total is None else total), None, 0
    over = F.lit(False)
    if every[1]:
        level = size / float(every[1])
        while level is not None:
            over = F.col("weight") * F.lit(level) > F.col("cap")
            held, left, count = known.agg(F.sum(F.when(over, F.col("cap"))), F.sum(F.when(~over, F.col("weight"))), F.sum(over.cast("long"))).first()
            if count == clamped:
                break
            clamped, level = count, (size - (held or 0.0)) / float(left) if left else None
    target = F.col("cap") if level is None else F.when(over, F.col("cap")).otherwise(F.col("weight") * F.lit(level))
    return known.withColumn("target", target).drop("cap")


def cyclic_weights(sources: DataFrame, cycle: tuple[int, ...], staging: Staging) -> DataFrame:
    """Adds `weight`: the cycle's numbers in turn, over sources by code point, null last."""
    placed = staging.numbered(sources, [F.col("source").asc_nulls_last()], "place", "placed-sources")
    return placed.withColumn("weight", F.element_at(F.array(*[F.lit(w) for w in cycle]), (F.col("place") % len(cycle) + 1).cast("int"))).drop("place")


def mix(
    docs: DataFrame,
    weights: DataFrame | tuple[int, ...] = (5, 2, 1),
    id_col: str = "doc_id",
    source_col: str = "source",
    text_col: str = "text",
    max_epochs: float = 3.0,
    total: int | None = None,
    seed: str = "mix",
) -> DataFrame:
    """One row for each document: doc_id, source, size, source_size, target, reps, taken.

    `weights` is a cycle over the sources in order, or a table (source,
    weight). A source's target is its share of `total` (default: all sizes),
    by capped water-filling. Each document is repeated floor(target /
    source_size) times, and those first in the order of a seeded hash once
    more, until the source's words come nearest its target. A null source is a
    source; a null or empty text has size 0; a null id is hashed as the word
    null; repeated rows each take part; an empty table gives no rows; other
    columns are not read. Reruns give the same rows.
    """
    staging = Staging(docs.sparkSession, "mixing")
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit("null"))))
    rows = docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        F.col(source_col).cast("string").alias("source"),
        word_count(F.col(text_col)).alias("size"),
        F.conv(F.substring(digest, 1, 8), 16, 10).cast("long").alias("h"),
    ).withColumn("skey", F.coalesce(F.concat(F.lit("s"), "source"), F.lit("n"))).withColumn("b", F.shiftright("h", 20).cast("int"))
    rows = staging.write(rows, "sizes")
    sums = staging.write(rows.groupBy("skey", "source", "b").agg(F.sum("size").alias("bucket_size")), "sums")
    sources = staging.write(sums.groupBy("skey", "source").agg(F.sum("bucket_size").alias("source_size")), "sources")
    weighed = cyclic_weights(sources, weights, staging) if isinstance(weights, tuple) else sources.join(
        weights.select(F.coalesce(F.concat(F.lit("s"), F.col("source").cast("string")), F.lit("n")).alias("skey"), F.col("weight")), "skey"
    )
    filled = water_fill(weighed, max_epochs, total)
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    filled = filled.withColumn("whole", whole).withColumn("part", F.col("target") - F.col("whole") * F.col("source_size"))
    earlier = F.coalesce(F.sum("bucket_size").over(Window.partitionBy("skey").orderBy("b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = sums.withColumn("before", earlier).join(filled.drop("source").hint("merge"), "skey").select("skey", "b", "before", "source_size", "target", "whole", "part")
    placed = staging.write(placed, "placed")
    within = Window.partitionBy("skey", "b").orderBy("h", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0)
    middle = F.col("before") + F.sum("size").over(within) - F.col("size") / 2
    more = F.when((F.col("part") > 0) & (middle <= F.col("part")), 1).otherwise(0)
    taken = rows.join(placed.hint("merge"), ["skey", "b"]).withColumn("reps", F.col("whole") + more)
    return taken.select("doc_id", "source", "size", "source_size", "target", "reps", (F.col("size") * F.col("reps")).alias("taken"))
