"""Assertions on tables: each counts what breaks a rule and raises the stage's error."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def positive_int(value: object, label: str, error: type[Exception], optional: bool = False) -> None:
    """A bool is no int here."""
    if value is None and optional:
        return
    if isinstance(value, bool) or not isinstance(value, int) or value < 1:
        raise error(f"{label} must be a positive integer" + " or None" * optional)


def none(df: DataFrame, rule: Column, label: str, error: type[Exception], show: str | None = None) -> DataFrame:
    """Raises if `rule` holds for any row; gives the table back."""
    found = df.where(rule)
    rows = (found.select(show) if show else found).limit(10).collect()
    if rows:
        raise error(f"{label}: {', '.join(str(r[0]) for r in rows)}" if show else label)
    return df


def unique(df: DataFrame, keys: list[str], error: type[Exception]) -> DataFrame:
    rows = df.groupBy(*keys).count().where("count > 1").limit(10).collect()
    if rows:
        raise error(f"duplicate {', '.join(keys)}: {', '.join('/'.join(str(r[k]) for k in keys) for r in rows)}")
    return df


def rules(df: DataFrame, broken: dict[str, Column], keys: list[str], show: str) -> DataFrame:
    """(rule, violations, example): all rules of a table in one pass, and `duplicate <keys>` first; the example is the smallest.

    A rule is about the rows of one key; it counts keys with a row that breaks it.
    """
    shown = F.col(show).cast("string")
    found = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"), *[F.max(F.coalesce(b, F.lit(False))).alias(f"__{i}") for i, b in enumerate(broken.values())], *([] if show in keys else [F.min(show).alias(show)]))
    counters = [("duplicate " + ", ".join(keys), F.col("__n") > 1), *((label, F.col(f"__{i}")) for i, label in enumerate(broken))]
    totals = found.agg(*[c for i, (_, b) in enumerate(counters) for c in (F.count_if(b).alias(f"n{i}"), F.min(F.when(b, shown)).alias(f"e{i}"))])
    rows = F.array(*[F.struct(F.lit(label).alias("rule"), F.col(f"n{i}").alias("violations"), F.col(f"e{i}").alias("example")) for i, (label, _) in enumerate(counters)])
    return totals.select(F.inline(rows))


def require(found: DataFrame, error: type[Exception]) -> None:
    """Raises for every rule of `rules` that is broken; one job."""
    broken = [r for r in found.collect() if r["violations"]]  # a row for each rule
    if broken:
        raise error("; ".join(f"{r['rule']}: {r['violations']}, for example {r['example']}" for r in broken))


def one_value(df: DataFrame, column: str, label: str, error: type[Exception]) -> object:
    """The only value of a column."""
    rows = [r[0] for r in df.select(column).distinct().limit(3).collect()]
    if len(rows) != 1:
        raise error(f"{label}: expected one value, found {rows or 'none'}")
    return rows[0]


def _comparable(column: Column, kind: T.DataType) -> Column:
    """What hashes alike for equal values alone: maps without their order, lists with their size, nulls with their place."""
    both = lambda c, k: (c.isNull().alias("absent"), _comparable(c, k).alias("value"))
    if isinstance(kind, T.MapType):
        entries = F.transform(F.map_entries(column), lambda e: F.struct(e["key"].alias("key"), *both(e["value"], kind.valueType)))
        return F.struct(F.size(column).alias("n"), F.array_sort(entries).alias("entries"))
    if isinstance(kind, T.ArrayType):
        return F.struct(F.size(column).alias("n"), F.transform(column, lambda v: F.struct(*both(v, kind.elementType))).alias("items"))
    if isinstance(kind, T.StructType):
        return F.struct(*[F.struct(*both(column[f.name], f.dataType)).alias(f.name) for f in kind.fields])
    return column


def checksum_columns(schema: T.StructType) -> list[Column]:
    """Aggregates that tell tables apart as multisets of rows, in any order: their number and two sums of row hashes.

    Null and empty values differ, and so do a value here and the same in the
    next column. The sums are exact. They are no guard against forgery.
    """
    cells = []
    for f in sorted(schema.fields, key=lambda f: f.name):
        cell = F.col(f"`{f.name}`")
        cells += [cell.isNull(), _comparable(cell, f.dataType)]
    sums = [F.coalesce(F.sum(F.xxhash64(F.lit(seed), *cells).cast("decimal(38,0)")), F.lit(0).cast("decimal(38,0)")) for seed in (1, 2)]
    return [F.count(F.lit(1)).alias("rows"), sums[0].alias("sum1"), sums[1].alias("sum2")]


def checksum(df: DataFrame) -> tuple:
    """The table's checksum, in one pass."""
    return tuple(df.agg(*checksum_columns(df.schema)).first())


def roll_up(checks: DataFrame, *keys: str) -> DataFrame:
    """overall_status by key: fail over pass_with_warnings over pass."""
    severity = F.max(F.when(F.col("status") == "fail", 2).when(F.col("status") == "warn", 1).otherwise(0))
    return checks.groupBy(*keys).agg(F.element_at(F.array(F.lit("pass"), F.lit("pass_with_warnings"), F.lit("fail")), severity + 1).alias("overall_status"))
