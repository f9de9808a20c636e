"""Reading order of positioned words: rows, gutters between columns, regions, lines and page text.

All steps run over the words of many pages at once and are keyed by page.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..staging import Staging


@dataclass(frozen=True)
class LayoutConfig:
    """Lengths in points, shares of the page's width or of its segments. Fixed values."""

    row_split_gap: float = 8.0
    coverage_tolerance: float = 0.05
    min_gutter_width: float = 6.0
    scan_lo: float = 0.15
    scan_hi: float = 0.85
    min_side_lines: int = 5
    table_cell_proximity: float = 10.0


def upright(words: DataFrame) -> DataFrame:
    """Without rotated words; words that don't say are kept."""
    return words.where(F.coalesce("upright", F.lit(True)))


def _row() -> Column:
    return F.bround("top").cast("int")


def word_rows(words: DataFrame) -> DataFrame:
    """(page_id, row, w): the words of each row from left to right, as structures of x0, word_index, x1 and text."""
    word = F.struct("x0", "word_index", "x1", F.coalesce("text", F.lit("")).alias("text"))
    return words.groupBy("page_id", _row().alias("row")).agg(F.array_sort(F.collect_list(word)).alias("w"))


def row_segments(rows: DataFrame, gap: float = LayoutConfig.row_split_gap) -> DataFrame:
    """(page_id, row, segment, x0, x1, words): rows of words cut where one begins more than `gap` after the one before ends."""
    size, at = F.size("w"), lambda i: F.get("w", i)
    inner = F.when(size > 1, F.sequence(F.lit(1), size - 1)).otherwise(F.array().cast("array<int>"))
    cuts = F.filter(inner, lambda i: at(i)["x0"] - at(i - 1)["x1"] > gap)
    bounds = rows.select("page_id", "row", "w", F.posexplode(F.arrays_zip(F.concat(F.array(F.lit(0)), cuts).alias("low"), F.concat(cuts, F.array(size)).alias("high"))).alias("segment", "b"))
    return bounds.select("page_id", "row", F.col("segment").cast("long").alias("segment"), at(F.col("b.low"))["x0"].alias("x0"), at(F.col("b.high") - 1)["x1"].alias("x1"), (F.col("b.high") - F.col("b.low")).cast("long").alias("words"))


def line_segments(words: DataFrame, gap: float = LayoutConfig.row_split_gap) -> DataFrame:
    """(page_id, row, segment, x0, x1, words), as `row_segments`, of words without their texts, which are sorted by row and never gathered."""
    order = Window.partitionBy("page_id", "row").orderBy("x0", "word_index")
    cut = F.coalesce((F.col("x0") - F.lag("x1").over(order) > gap).cast("long"), F.lit(0))
    placed = words.select("page_id", _row().alias("row"), "x0", "word_index", "x1").withColumns({"cut": cut, "last": F.coalesce(F.lead("x0").over(order) - F.col("x1") > gap, F.lead("page_id").over(order).isNull())})
    numbered = placed.withColumn("segment", F.sum("cut").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    found = numbered.groupBy("page_id", "row", "segment").agg(F.min("x0").alias("x0"), F.max(F.when(F.col("last"), F.col("x1"))).alias("x1"), F.count("*").alias("words"))
    return found.select("page_id", "row", "segment", "x0", "x1", "words")


def _scanned(segments: DataFrame, pages: DataFrame, c: LayoutConfig) -> DataFrame:
    """(page_id, lo, last, total, x0, x1): a row for each page that is scanned, with the ends of its segments."""
    whole = F.col("x0").isNotNull() & F.col("x1").isNotNull()
    ends = [F.collect_list(F.when(whole, F.col(x))).alias(x) for x in ("x0", "x1")]
    held = segments.groupBy("page_id").agg(F.count("*").alias("total"), *ends).where(F.col("total") >= 2 * c.min_side_lines)
    width = F.col("page_width")
    return pages.join(held, "page_id").select("page_id", (width * c.scan_lo).alias("lo"), F.floor(width * c.scan_hi - width * c.scan_lo).alias("last"), "total", "x0", "x1")


def _covered(lo: float, last: int, x0: np.ndarray, x1: np.ndarray) -> np.ndarray:
    """How many segments cover each step: each adds one at the first step that it covers and takes one away after the last."""
    first, after = np.maximum(np.ceil(x0 - lo), 0).astype(np.int64), np.floor(x1 - lo).astype(np.int64) + 1
    first, after = first[after > first], after[after > first]
    change = [np.bincount(np.minimum(at, last + 1), minlength=last + 2) for at in (first, after)]
    return np.cumsum(change[0] - change[1])[: last + 1]


def _pages(lo: pd.Series, last: pd.Series, x0: pd.Series, x1: pd.Series) -> Iterator[np.ndarray | None]:
    for a, n, s, e in zip(lo, last, x0, x1, strict=True):
        yield None if pd.isna(a) else _covered(a, int(n), np.asarray(s, dtype=np.float64), np.asarray(e, dtype=np.float64))


def coverage_profile(segments: DataFrame, pages: DataFrame, config: LayoutConfig | None = None) -> DataFrame:
    """(page_id, i, x, covered, total, frac): at each step of one point, how many of a page's segments cover x.

    `pages` is (page_id, page_width). A page's segments meet in one row, which
    becomes its steps; steps are neither joined nor sorted.
    """

    @F.pandas_udf("array<long>")
    def covered(lo: pd.Series, last: pd.Series, x0: pd.Series, x1: pd.Series) -> pd.Series:
        return pd.Series(list(_pages(lo, last, x0, x1)), dtype=object)

    found = _scanned(segments, pages, config or LayoutConfig())
    steps = found.select("page_id", "lo", "total", F.posexplode(covered("lo", "last", "x0", "x1")).alias("i", "covered"))
    return steps.select("page_id", F.col("i").cast("long").alias("i"), (F.col("lo") + F.col("i")).alias("x"), "covered", "total", (F.col("covered") / F.col("total")).alias("frac"))


def gutters(segments: DataFrame, pages: DataFrame, config: LayoutConfig | None = None) -> DataFrame:
    """(page_id, start, end, max_coverage, width, mid, left_lines, right_lines): runs of steps that almost nothing covers."""
    c = config or LayoutConfig()

    @F.pandas_udf("array<struct<low:long,high:long,most:long>>")
    def low_runs(lo: pd.Series, last: pd.Series, x0: pd.Series, x1: pd.Series, total: pd.Series) -> pd.Series:
        out = []
        for covered, n in zip(_pages(lo, last, x0, x1), total, strict=True):
            low = np.flatnonzero(covered / n <= c.coverage_tolerance) if covered is not None else np.zeros(0, np.int64)
            runs = np.split(low, np.flatnonzero(np.diff(low) > 1) + 1)
            out.append([{"low": int(r[0]), "high": int(r[-1]), "most": int(covered[r].max())} for r in runs if len(r) and r[-1] - r[0] >= c.min_gutter_width])
        return pd.Series(out, dtype=object)

    runs = _scanned(segments, pages, c).select("page_id", "lo", "total", "x0", "x1", F.explode(low_runs("lo", "last", "x0", "x1", "total")).alias("r"))
    start, end, width = F.col("lo") + F.col("r.low"), F.col("lo") + F.col("r.high"), (F.col("r.high") - F.col("r.low")).cast("double")
    found = runs.select("page_id", start.alias("start"), end.alias("end"), (F.col("r.most") / F.col("total")).alias("max_coverage"), width.alias("width"), "x0", "x1")
    left, right = F.filter("x1", lambda x: x <= F.col("start")), F.filter("x0", lambda x: x >= F.col("end"))
    found = found.withColumns({"mid": (F.col("start") + F.col("end")) / 2, "left_lines": F.size(left).cast("long"), "right_lines": F.size(right).cast("long")}).drop("x0", "x1")
    return found.where((F.col("left_lines") >= c.min_side_lines) & (F.col("right_lines") >= c.min_side_lines))


def cell_boundaries(cells: DataFrame) -> DataFrame:
    """(page_id, bounds): sorted distinct x positions of table cells, to a tenth of a point."""
    edges = cells.select("page_id", F.explode(F.array("x0", "x1")).alias("x")).where("x is not null").select("page_id", F.bround("x", 1).alias("x"))
    return edges.groupBy("page_id").agg(F.array_sort(F.collect_set("x")).alias("bounds"))


def guard_tables(found: DataFrame, cells: DataFrame, proximity: float = LayoutConfig.table_cell_proximity) -> DataFrame:
    """Adds `rejected`: a gutter whose middle is near a cell's edge is a table's column. No cells, no rejection."""
    near = F.exists("bounds", lambda b: F.abs(F.col("mid") - b) <= proximity)
    return found.join(cell_boundaries(cells), "page_id", "left").withColumn("rejected", F.coalesce(near, F.lit(False))).drop("bounds")


def column_split(found: DataFrame) -> DataFrame:
    """(page_id, split_x): the middle of the leftmost gutter."""
    return found.groupBy("page_id").agg(F.min_by("mid", "start").alias("split_x"))


def regions(words: DataFrame, kept: DataFrame) -> DataFrame:
    """Adds `region` to words: how many gutter middles lie at or left of the word's centre."""
    bounds = kept.groupBy("page_id").agg(F.array_sort(F.collect_list("mid")).alias("bounds"))
    centre = (F.col("x0") + F.col("x1")) / 2
    number = F.coalesce(F.size(F.filter("bounds", lambda b: b <= centre)), F.lit(0))
    return words.join(bounds, "page_id", "left").withColumn("region", F.greatest(number, F.lit(0))).withColumn("regions", F.greatest(F.coalesce(F.size("bounds"), F.lit(0)), F.lit(0)) + 1).drop("bounds")


def lines(placed: DataFrame) -> DataFrame:
    """(page_id, region, top, x0, x1, text, word_count, median_x0) of words with a region."""
    order = F.array_sort(F.collect_list(F.struct("x0", "word_index", F.coalesce("text", F.lit("")).alias("text"))))
    out = placed.groupBy("page_id", "region", _row().alias("top")).agg(F.min("x0").alias("x0"), F.max("x1").alias("x1"), F.count("*").alias("word_count"), order.alias("w"))
    middle = F.element_at("w", (F.floor(F.size("w") / 2) + 1).cast("int"))["x0"]
    return out.select("page_id", "region", "top", "x0", "x1", F.array_join(F.transform("w", lambda w: w["text"]), " ").alias("text"), "word_count", middle.alias("median_x0"))


def row_lines(rows: DataFrame, kept: DataFrame) -> DataFrame:
    """As `lines`, from gathered rows of words and the gutters kept: a row is one line in each region that its words are in."""
    bounds = kept.groupBy("page_id").agg(F.array_sort(F.collect_list("mid")).alias("bounds"))
    number = lambda w: F.size(F.filter(F.coalesce("bounds", F.array().cast("array<double>")), lambda b: b <= (w["x0"] + w["x1"]) / 2))
    numbered = rows.join(bounds, "page_id", "left").withColumn("r", F.transform("w", number))
    split = numbered.select("page_id", F.col("row").alias("top"), "w", "r", F.explode(F.array_distinct("r")).alias("region"))
    held = split.withColumn("w", F.filter("w", lambda w, i: F.get("r", i) == F.col("region"))).drop("r")
    middle = F.get("w", F.floor(F.size("w") / 2).cast("int"))["x0"]
    of = lambda field: F.transform("w", lambda w: w[field])
    return held.select("page_id", "region", "top", F.array_min(of("x0")).alias("x0"), F.array_max(of("x1")).alias("x1"), F.array_join(of("text"), " ").alias("text"), F.size("w").cast("long").alias("word_count"), middle.alias("median_x0"))


def region_texts(placed: DataFrame) -> DataFrame:
    """(page_id, region, x0, x1, word_count, text): extent and lines of each region that has words."""
    return joined_lines(lines(placed))


def joined_lines(found: DataFrame) -> DataFrame:
    """The lines of each region, from top to bottom."""
    by_line = found.groupBy("page_id", "region").agg(F.min("x0").alias("x0"), F.max("x1").alias("x1"), F.sum("word_count").alias("word_count"), F.array_sort(F.collect_list(F.struct("top", "text"))).alias("l"))
    return by_line.select("page_id", "region", "x0", "x1", "word_count", F.array_join(F.transform("l", lambda x: x["text"]), "\n").alias("text"))


def reading_order(words: DataFrame, cells: DataFrame, pages: DataFrame, config: LayoutConfig | None = None) -> DataFrame:
    """One row for each page: text in reading order, gutters kept and rejected, regions and word counts.

    `words` as in schemas.WORDS, `cells` as in schemas.CELLS, `pages` is
    (page_id, page_width). Pages without words have an empty text and one
    region. Words are read twice, for the gutters, which are written, and for the
    texts; words that are dealt by page are shuffled no more.
    """
    c = config or LayoutConfig()
    staging = Staging(words.sparkSession, "layout")
    rows = word_rows(upright(words))
    segments = row_segments(rows, c.row_split_gap)
    found = staging.write(guard_tables(gutters(segments, pages, c), cells, c.table_cell_proximity), "gutters")
    texts = joined_lines(row_lines(rows, found.where("not rejected")))
    shape = F.struct("start", "end", "max_coverage", "width", "mid", "left_lines", "right_lines")
    listed = found.groupBy("page_id").agg(F.array_sort(F.collect_list(F.when(~F.col("rejected"), shape))).alias("gutters"), F.array_sort(F.collect_list(F.when(F.col("rejected"), shape))).alias("rejected_gutters"))
    by_region = F.array_sort(F.collect_list(F.struct("region", "x0", "x1", "word_count", "text"))).alias("r")
    page = texts.groupBy("page_id").agg(F.sum("word_count").alias("word_count"), by_region)
    out = pages.join(page, "page_id", "left").join(listed, "page_id", "left")
    none = F.array().cast(listed.schema["gutters"].dataType)
    count = F.greatest(F.coalesce(F.size("gutters"), F.lit(0)), F.lit(0)) + 1
    said = F.filter("r", lambda x: T.non_blank(x["text"]))
    flat = F.array_join(F.transform(said, lambda x: x["text"]), "\n")
    single = F.element_at("r", 1)["text"]
    cell = lambda i: F.filter("r", lambda x: x["region"] == i)
    held = lambda i, field: F.coalesce(F.try_element_at(cell(i), F.lit(1))[field], F.lit(0))
    extents = F.transform(F.sequence(F.lit(0), count - 1), lambda i: F.struct(held(i, "x0").alias("x0"), held(i, "x1").alias("x1"), held(i, "word_count").alias("word_count")))
    return out.select(
        "page_id",
        (count > 1).alias("is_two_column"),
        F.when(count > 1, F.element_at("gutters", 1)["mid"]).alias("split_x"),
        F.coalesce("gutters", none).alias("gutters"),
        F.coalesce("rejected_gutters", none).alias("rejected_gutters"),
        count.alias("region_count"),
        (count == 1).alias("fallback_used"),
        F.when(count > 1, extents).alias("regions"),
        F.coalesce(F.when(count > 1, flat).otherwise(single), F.lit("")).alias("text"),
        F.coalesce("word_count", F.lit(0)).alias("word_count"),
        F.when(count > 1, F.element_at(extents, 1)["word_count"]).otherwise(F.coalesce("word_count", F.lit(0))).alias("left_word_count"),
        F.when(count > 1, F.element_at(extents, -1)["word_count"]).otherwise(F.lit(0)).alias("right_word_count"),
    )
