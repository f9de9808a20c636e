"""Document fingerprints as invertible Bloom lookup sketches; everything here is DataFrame expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..staging import Staging

#: A paragraph is a line, cut at the ends of sentences after so many characters, and anyway after PARAGRAPH + SLACK.
PARAGRAPH, SLACK = 100, 200
_PIECE = rf"[^\n]{{1,{PARAGRAPH}}}[^\n.!?]{{0,{SLACK}}}[.!?]*\n*|\n+"
#: Hash functions, cells for each in a fingerprint, and cells for each in the parts of the larger sketches that retries build.
HASHES, WIDTH, RETRIES = 3, 5, (5, 16, 64, 256)
#: Paragraphs of two versions that share a part of the larger sketches, on average.
LOAD = 6
#: Buckets of the order by id at first, at most, and rows of one, on average; buckets of TOO_MANY times more are divided again.
BUCKETS, BUCKET_ROWS, TOO_MANY = 100_000, 1000, 8

_CELL = "struct<n:int,k:bigint,h:bigint>"


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with the value computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _check(key: Column) -> Column:
    """The second hash of a digest: checks that a cell holds it alone, and places it."""
    return F.xxhash64(key, F.lit(0x1B17))


def _cell(check: Column, j: int, width: int) -> Column:
    """The cell of hash function j."""
    return F.pmod(F.shiftright(check, 16 * j), F.lit(width)).cast("int") + j * width


def digests(text: Column) -> Column:
    """Sorted distinct 64-bit digests of a text's paragraphs."""
    return F.array_sort(F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(_PIECE), 0), lambda p: F.xxhash64(p))))


def _placed(keys: Column, sign: int, width: int) -> Column:
    """Elements (k, h, s, p0, p1, p2) of digests, to be put into cells."""
    return F.transform(
        F.transform(keys, lambda k: F.struct(k.alias("k"), _check(k).alias("h"))),
        lambda e: F.struct(e["k"].alias("k"), e["h"].alias("h"), F.lit(sign).alias("s"), *[_cell(e["h"], j, width).alias(f"p{j}") for j in range(HASHES)]),
    )


def _cells(elements: Column, width: int) -> Column:
    """The cells of a sketch: signed count, and exclusive ors of digests and of their checks."""
    empty = F.struct(F.lit(0).alias("n"), F.lit(0).cast("long").alias("k"), F.lit(0).cast("long").alias("h"))

    add = lambda a, e: F.struct((a["n"] + e["s"]).alias("n"), a["k"].bitwiseXOR(e["k"]).alias("k"), a["h"].bitwiseXOR(e["h"]).alias("h"))
    cell = lambda j: lambda c: F.aggregate(F.filter(elements, lambda e: e[f"p{j}"] == c), empty, add)
    return F.concat(*[F.transform(F.sequence(F.lit(j * width), F.lit((j + 1) * width - 1)), cell(j)) for j in range(HASHES)])


def sketch(keys: Column) -> Column:
    """The fingerprint's cells of a set of digests."""
    return _let(_placed(keys, 1, WIDTH), lambda e: _cells(e, WIDTH))


def _subtract(x: Column, y: Column) -> Column:
    return F.zip_with(x, y, lambda a, b: F.struct((a["n"] - b["n"]).alias("n"), a["k"].bitwiseXOR(b["k"]).alias("k"), a["h"].bitwiseXOR(b["h"]).alias("h")))


def _peel(cells: Column, steps: Column, width: int) -> Column:
    """struct(a, r, cells): digests recovered of the first and of the second version, and what is left.

    A cell whose check is that of its digest holds one digest alone; it is
    taken out of its cells, which may leave others alone.
    """

    def step(state: Column, _: Column) -> Column:
        alone = F.array_position(F.transform(state["cells"], lambda c: (F.abs(c["n"]) == 1) & (c["h"] == _check(c["k"]))), F.lit(True))

        def take(at: Column) -> Column:
            cell = F.element_at(state["cells"], at.cast("int"))

            def without(p: Column) -> Column:
                less = lambda c, i: F.when(F.exists(p, lambda q: q == i), F.struct((c["n"] - cell["n"]).alias("n"), c["k"].bitwiseXOR(cell["k"]).alias("k"), c["h"].bitwiseXOR(cell["h"]).alias("h"))).otherwise(c)
                return F.struct(
                    (state["a"] + F.when(cell["n"] == 1, 1).otherwise(0)).alias("a"), (state["r"] + F.when(cell["n"] == -1, 1).otherwise(0)).alias("r"),
                    F.transform(state["cells"], less).alias("cells"), F.lit(False).alias("stuck"),
                )

            return _let(F.array(*[_cell(cell["h"], j, width) for j in range(HASHES)]), without)

        stuck = F.struct(state["a"].alias("a"), state["r"].alias("r"), state["cells"].alias("cells"), F.lit(True).alias("stuck"))
        return F.when(state["stuck"], state).otherwise(_let(alone, lambda at: F.when(at > 0, take(at)).otherwise(stuck)))

    start = F.struct(F.lit(0).alias("a"), F.lit(0).alias("r"), cells.alias("cells"), F.lit(False).alias("stuck"))
    return F.aggregate(F.sequence(F.lit(1), F.greatest(steps, F.lit(1))), start, step)


def _recovered(cells: Column, steps: Column, width: int) -> Column:
    """struct(a, r) if the peeling leaves nothing, else null."""
    done = lambda s: F.when(~F.exists(s["cells"], lambda c: (c["n"] != 0) | (c["k"] != 0) | (c["h"] != 0)), F.struct(s["a"].alias("a"), s["r"].alias("r")))
    return _let(_peel(cells, steps, width), done)


def _divided(x: Column, y: Column) -> Column:
    """struct(a, r, retries, exact) from two larger sketches, which are subtracted part by part.

    The larger sketch of a version has many parts, as many as the paragraphs
    need, each of the digests of one residue. A part that fails is built larger
    for both versions and subtracted again. Digests that share their cells at
    every width would be told apart without a sketch; `exact` counts such parts.
    """
    parts = F.greatest(F.ceil((F.size(x) + F.size(y)) / LOAD), F.lit(1))
    # two levels, so that a text of n paragraphs is divided in n * sqrt(n) steps
    outer = F.ceil(F.sqrt(parts)).cast("int")
    inner = F.ceil(parts / outer).cast("int")
    none = F.struct(*[F.lit(0).alias(c) for c in ("a", "r", "retries", "exact")])
    whole = lambda keys, width: _let(_placed(keys, 1, width), lambda e: _cells(e, width))
    result = lambda d, retries, exact: F.struct(d["a"].alias("a"), d["r"].alias("r"), F.lit(retries).alias("retries"), F.lit(exact).alias("exact"))

    def attempt(own: Column, retries: int, width: int) -> Column:
        left = _recovered(_subtract(whole(own["x"], width), whole(own["y"], width)), F.size(own["x"]) + F.size(own["y"]), width)
        return _let(left, lambda d: F.when(d.isNotNull(), result(d, retries, 0)))

    def solve(own: Column) -> Column:
        plain = F.struct(F.size(F.array_except(own["x"], own["y"])).alias("a"), F.size(F.array_except(own["y"], own["x"])).alias("r"))
        tries = [attempt(own, i, w) for i, w in enumerate(RETRIES)]
        return F.when(F.size(own["x"]) + F.size(own["y"]) == 0, none).otherwise(F.coalesce(*tries, result(plain, len(RETRIES), 1)))

    add = lambda t, s: F.struct(*[(t[c] + s[c]).alias(c) for c in ("a", "r", "retries", "exact")])
    of = lambda keys, shift, n, i: F.filter(keys, lambda k: F.pmod(F.shiftright(k, shift), n) == i)
    both = lambda p, shift, n, i: F.struct(of(p["x"], shift, n, i).alias("x"), of(p["y"], shift, n, i).alias("y"))
    within = lambda p: F.aggregate(F.transform(F.sequence(F.lit(0), inner - 1), lambda i: _let(both(p, 33, inner, i), solve)), none, add)
    return _let(F.struct(x.alias("x"), y.alias("y")), lambda p: F.aggregate(F.transform(F.sequence(F.lit(0), outer - 1), lambda i: _let(both(p, 7, outer, i), within)), none, add))


def difference(x: Column, y: Column, sketch_x: Column, sketch_y: Column) -> Column:
    """struct(likeness, retries, exact) of two versions from the digests that subtracted sketches give back.

    First the two fingerprints are subtracted and peeled; where that fails,
    larger sketches are. Likeness is the paragraphs shared over all of both (0
    to 1).
    """
    small = _let(_recovered(_subtract(sketch_x, sketch_y), F.lit(HASHES * WIDTH), WIDTH), lambda d: F.when(d.isNotNull(), F.struct(d["a"].alias("a"), d["r"].alias("r"), F.lit(0).alias("retries"), F.lit(0).alias("exact"))))
    share = lambda d: F.when(F.size(x) + d["r"] == 0, 1.0).otherwise((F.size(x) - d["a"]) / (F.size(x) + d["r"]))
    return _let(F.coalesce(small, _divided(x, y)), lambda d: F.struct(share(d).alias("likeness"), d["retries"].alias("retries"), d["exact"].alias("exact")))


def likeness(x: Column, y: Column, sketch_x: Column, sketch_y: Column) -> Column:
    return difference(x, y, sketch_x, sketch_y)["likeness"]


def serialized(cells: Column) -> Column:
    """A sketch as text: count, digest and check (its low half) of each cell in hexadecimal."""
    low = lambda v, n: F.lower(F.lpad(F.hex(v), n, "0"))
    return F.array_join(F.transform(cells, lambda c: F.concat(low(c["n"].bitwiseAND(F.lit(0x7FFFFFFF)), 8), low(c["k"], 16), F.substring(low(c["h"], 16), 9, 8))), "")


def _slot(parts: Column, kind: Column, x: Column, low: Column, high: Column, th: Column, low_th: Column, high_th: Column, salt: Column) -> Column:
    """The part (from 0) of a bucket that a row belongs to: by id, by text hash where ids are equal, or by salt where rows are."""
    exact = lambda c: c.cast("decimal(20,0)")
    place = lambda v, a, b: F.least((((exact(b) - exact(v)).cast("double") / (exact(b) - exact(a)).cast("double")) * parts).cast("int"), parts - 1)
    return F.when(kind == "id", place(x, low, high)).when(kind == "text", place(th, low_th, high_th)).otherwise(F.pmod(salt, parts).cast("int"))


def bucketed(rows: DataFrame, staging: Staging) -> tuple[DataFrame, DataFrame]:
    """`rows` (doc_id, text, th, salt) with b, the path of their bucket in the order by descending id and text hash; and (b, head).

    Ids are cut into ranges of equal width. A range that holds many times more
    rows than its share is cut again between its own least and greatest id; one
    of a single id (or of none) by the hash of the text, and one of equal rows,
    whose order is free, by their number. So neither outliers nor ids that
    repeat put many rows into one task.
    """
    count, low, high = rows.agg(F.count("*"), F.min("doc_id"), F.max("doc_id")).first()
    buckets = max(1, min(BUCKETS, count // BUCKET_ROWS))
    share = max(BUCKET_ROWS, count // buckets)
    first = F.lit(0) if low is None or low == high else _slot(F.lit(buckets), F.lit("id"), F.col("doc_id"), F.lit(low), F.lit(high), F.col("th"), F.col("th"), F.col("th"), F.col("salt"))
    rows = rows.withColumn("b", F.array(F.when(F.col("doc_id").isNull(), buckets).otherwise(first)))
    level = 0
    while True:
        sums = rows.groupBy("b").agg(
            F.count("*").alias("n"), F.min("doc_id").alias("low"), F.max("doc_id").alias("high"), F.min("th").alias("low_th"), F.max("th").alias("high_th"), F.max(F.struct("doc_id", "th")).alias("head")
        )
        sums = staging.write(sums, f"buckets-{level}")
        crowded = sums.where(F.col("n") > TOO_MANY * share)
        if crowded.isEmpty():
            return rows, sums.select("b", "head")
        level += 1
        kind = F.when(F.col("low") < F.col("high"), "id").when(F.col("low_th") < F.col("high_th"), "text").otherwise("row")
        cut = F.broadcast(crowded.select("b", F.greatest(F.ceil(F.col("n") / share), F.lit(2)).cast("int").alias("parts"), kind.alias("kind"), "low", "high", "low_th", "high_th"))  # BUCKETS / TOO_MANY rows at most at a level
        slot = _slot(*[F.col(c) for c in ("parts", "kind", "doc_id", "low", "high", "th", "low_th", "high_th", "salt")])
        rows = rows.join(cut, "b", "left").withColumn("b", F.when(F.col("parts").isNull(), F.col("b")).otherwise(F.concat("b", F.array(slot)))).select("doc_id", "text", "th", "salt", "b")


def with_next(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, text, keys, cells, next): each row with the text, digests and sketch of the next by descending id.

    The order is cut into buckets, each sorted by one task; the first row of
    each bucket is copied to the bucket before it, so no task sees all rows.
    Null ids come last; equal ids are ordered by a hash of their text, equal
    rows in any order.
    """
    staging = Staging(docs.sparkSession, "versions")
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("th"), F.monotonically_increasing_id().alias("salt"))
    rows, heads = bucketed(rows, staging)
    first = F.first("head").over(Window.orderBy("b").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    heads = heads.select("b", F.coalesce(F.lead("head").over(Window.orderBy("b")), first).alias("n")).select("b", F.col("n.doc_id").alias("nd"), F.col("n.th").alias("nt"))
    found = rows.select("doc_id", "text", "th").join(F.broadcast(heads.withColumnRenamed("b", "nb")), F.col("doc_id").eqNullSafe(F.col("nd")) & (F.col("th") == F.col("nt")))  # a row for each bucket
    copies = found.groupBy(F.col("nb").alias("b")).agg(*[F.first(c).alias(c) for c in ("doc_id", "text", "th")])  # rows that repeat are copied once
    dealt = rows.select("doc_id", "text", "th", "b", F.lit(0).alias("copy")).unionByName(copies.select("doc_id", "text", "th", "b", F.lit(1).alias("copy")))
    order = Window.partitionBy("b").orderBy("copy", F.col("doc_id").desc_nulls_last(), F.col("th").desc())
    keyed = dealt.withColumn("keys", digests(F.col("text"))).withColumn("cells", sketch(F.col("keys")))
    return keyed.withColumn("next", F.lead(F.struct("text", "keys", "cells")).over(order)).where("copy = 0").select("doc_id", "text", "keys", "cells", "next")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, n_paragraphs, n_retries, n_exact) for every row.

    The fingerprint is a sketch of the set of a text's paragraphs. The edited
    text has its last half replaced by the first code points of the next
    document, descending by id (after the last: the first; a single row is its
    own next). Likeness comes from subtracted sketches; n_retries counts the
    parts of larger ones that were built again, n_exact those that no sketch
    could tell. Null texts are empty, which have no paragraphs and are alike
    (1); very long texts are sketched whole, in n * sqrt(n) steps for n
    paragraphs; rows that repeat have a row each; null ids come last; an empty
    table gives no rows; other columns are not read, whatever their names.
    """
    known = with_next(docs, id_col, text_col)
    half = F.floor(F.length("text") / 2).cast("int")
    known = known.withColumn("edited", F.concat(F.substring(F.col("text"), F.lit(1), F.length("text") - half), F.substring(F.col("next.text"), F.lit(1), half)))
    known = known.withColumn("e", digests(F.col("edited"))).withColumn("ec", sketch(F.col("e")))
    known = known.withColumn("d_edited", difference(F.col("keys"), F.col("e"), F.col("cells"), F.col("ec"))).withColumn("d_next", difference(F.col("keys"), F.col("next.keys"), F.col("cells"), F.col("next.cells")))
    return known.select(
        "doc_id",
        F.length("text").cast("long").alias("n_chars"),
        F.sha2(F.encode("edited", "UTF-8"), 256).alias("edited_sha256"),
        serialized(F.col("cells")).alias("fingerprint"),
        serialized(F.col("ec")).alias("edited_fingerprint"),
        F.col("d_edited.likeness").alias("near_edited"),
        F.col("d_next.likeness").alias("near_next"),
        F.size("keys").cast("long").alias("n_paragraphs"),
        (F.col("d_edited.retries") + F.col("d_next.retries")).cast("long").alias("n_retries"),
        (F.col("d_edited.exact") + F.col("d_next.exact")).cast("long").alias("n_exact"),
    )
