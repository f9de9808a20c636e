"""Text expressions; all run in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# What counts as white space everywhere (the Unicode white space of Python's str methods).
_SPACES = r"\x09-\x0D\x1C-\x20\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
WS = f"[{_SPACES}]"
NON_WS = f"[^{_SPACES}]"
# Blank lines between paragraphs, ends of sentences, control characters, chunk ids.
PARAGRAPH_BREAK = r"\n[ \t]*\n+"
SENTENCE_BREAK = f"(?<=[.!?]){WS}+"
CONTROL = r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]"
CHUNK_ID = r"^(.+)-p(\d{3})-c(\d{3})$"


def strip_ws(text: Column) -> Column:
    """Without white space at either end."""
    return F.regexp_replace(text, rf"^{WS}+|{WS}+\z", "")


def non_blank(text: Column) -> Column:
    """Whether there is anything but white space; null counts as blank."""
    return F.coalesce(text.rlike(NON_WS), F.lit(False))


def words(text: Column) -> Column:
    """Pieces between white space. Extracting them by a pattern took eight times as long, for a result of each match."""
    return F.filter(F.split(text, f"{WS}+"), lambda w: w != "")


def tokens(text: Column) -> Column:
    """Lower-case pieces between white space, punctuation attached."""
    return words(F.lower(text))


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(f"{NON_WS}+")), F.lit(0))


def control_ratio(text: Column) -> Column:
    """Share of control characters (but not TAB, LF, CR); 0 for an empty text."""
    length = F.length(text)
    return F.when(length > 0, (length - F.length(F.regexp_replace(text, CONTROL, ""))) / length).otherwise(0.0)


def rounded(number: Column, digits: int) -> Column:
    """A number that is not negative, rounded as DuckDB does: by its product with a power of ten, half up. Spark's `round` goes by decimal digits, and 0.0640625 becomes 0.064063, not 0.064062."""
    scaled = number * float(10**digits)
    whole = F.floor(scaled)
    return F.when(F.isnan(number), number).otherwise((whole + F.when(scaled - whole >= 0.5, 1).otherwise(0)) / float(10**digits))


def chunk_id(document_id: Column, page_number: Column, chunk_index: Column) -> Column:
    """document-pNNN-cNNN; more digits are kept."""
    return F.format_string("%s-p%03d-c%03d", document_id, page_number, chunk_index)


def chunk_id_parts(column: Column) -> Column:
    """struct(document_id, page_number, chunk_index) of a well-formed id, else nulls."""
    part = lambda i: F.when(column.rlike(CHUNK_ID), F.regexp_extract(column, CHUNK_ID, i))
    return F.struct(part(1).alias("document_id"), part(2).cast("int").alias("page_number"), part(3).cast("int").alias("chunk_index"))


def document_id(filename: Column) -> Column:
    """The first two dash-separated parts of the file's stem in upper case; a stem without a dash as it is."""
    stem = F.regexp_replace(F.regexp_replace(filename, r"^.*/", ""), r"(?<=.)\.[^.]*$", "")
    parts = F.split(stem, "-")
    return F.when(F.size(parts) >= 2, F.upper(F.concat_ws("-", F.slice(parts, 1, 2)))).otherwise(stem)


def greedy(items: Column, limit: int, separator: str, slack: int = 0) -> Column:
    """Joins items in order into pieces of at most `limit - slack` characters; a longer item stands alone."""
    kind = "struct<o:array<string>,c:string>"
    start = F.struct(F.array().cast("array<string>").alias("o"), F.lit("").alias("c")).cast(kind)

    def step(state: Column, item: Column) -> Column:
        full = F.length(state["c"]) + len(separator) + F.length(item) + slack > limit
        return (
            F.when(state["c"] == "", F.struct(state["o"].alias("o"), item.alias("c")))
            .when(full, F.struct(F.concat(state["o"], F.array(state["c"])).alias("o"), item.alias("c")))
            .otherwise(F.struct(state["o"].alias("o"), F.concat(state["c"], F.lit(separator), item).alias("c")))
        )

    return F.aggregate(items, start, step, lambda s: F.when(s["c"] == "", s["o"]).otherwise(F.concat(s["o"], F.array(s["c"]))))
