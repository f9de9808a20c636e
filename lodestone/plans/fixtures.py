"""The driver's tables as inputs of the stages, in Spark and (as text) in DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import chunking, pages
from ..staging import Staging

#: Failed and empty pages are numbered from here on.
BESIDE = 1_000_000
#: Page numbers of at most so many documents are broadcast (16 bytes each).
BROADCAST_NUMBERS = 1_000_000
QUERY_STEP = 20  # searches take every row whose id is divisible by it as a query


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def raw_pages(spark: SparkSession, sf_dir: str, double_newlines: bool = False) -> DataFrame:
    """Documents as the pages of their source, all of them whole; some sources have a failed or an empty page besides.

    Pages are numbered by ranges of ids, without their texts, so that no task
    sorts a whole source. They meet the texts in hash tables of ids: texts are
    not sorted, and only shuffled where the ids are too many to be broadcast.
    """
    docs, numbers = table(spark, sf_dir, "documents"), page_numbers(spark, sf_dir)
    docs = docs.join(F.broadcast(numbers) if docs.count() <= BROADCAST_NUMBERS else numbers.hint("shuffle_hash"), "doc_id")
    text = F.replace("text", F.lit("\n"), F.lit("\n\n")) if double_newlines else F.col("text")
    failed = F.col("doc_id") % 97 == 0
    page = lambda number, text, status: [
        F.col("source").alias("document_id"),
        F.concat("source", F.lit(".txt")).alias("filename"),
        number.alias("page_number"),
        text.alias("text"),
        status.cast("string").alias("extraction_status"),
        F.lit(None).cast("string").alias("extraction_error"),
        F.lit(None).cast("double").alias("page_width"),
        F.lit(None).cast("double").alias("page_height"),
    ]
    beside = docs.where(failed | (F.col("doc_id") % 89 == 0)).select(*page(F.col("page_number") + BESIDE, F.lit(""), F.when(failed, "failed")))
    return docs.select(*page(F.col("page_number"), text, F.lit(None))).union(beside)


def page_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, page_number): the place of each document in its source, from 1."""
    ids = table(spark, sf_dir, "documents").select("doc_id", "source")
    placed = Staging(spark, "pages").numbered(ids, [F.col("source"), F.col("doc_id")], "place", "ids")
    first = placed.groupBy("source").agg(F.min("place").alias("first"))
    return placed.join(first, "source").select("doc_id", (F.col("place") - F.col("first") + 1).cast("int").alias("page_number"))


def page_table(spark: SparkSession, sf_dir: str, double_newlines: bool = False) -> DataFrame:
    return pages.page_records(raw_pages(spark, sf_dir, double_newlines))


def chunk_table(spark: SparkSession, sf_dir: str, double_newlines: bool = False) -> DataFrame:
    return chunking.chunk_pages(page_table(spark, sf_dir, double_newlines))


def staged_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The chunks, written once for what reads them more than once."""
    return Staging(spark, "chunks").write(chunk_table(spark, sf_dir), "chunks")


def expected_pages(found: DataFrame) -> DataFrame:
    """The manifest of the pages; one document is said to have a page more."""
    return found.groupBy("document_id").agg((F.count("*") + F.when(F.col("document_id") == "src3", 1).otherwise(0)).alias("expected_pages")).withColumn("source_sha256", F.upper(F.sha2("document_id", 256)))


def catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names for the sources that a nation's key names; the others have none."""
    nation = table(spark, sf_dir, "nation")
    return nation.where("n_nationkey < 12").select(F.concat(F.lit("src"), F.col("n_nationkey").cast("string")).alias("document_id"), F.col("n_name").alias("document_name"))


def vector_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    return rows.select(
        F.format_string("vec-%08d", "vec_id").alias("chunk_id"), F.concat(F.lit("label-"), F.col("label").cast("string")).alias("document_id"), (F.col("vec_id") % 7 + 1).cast("int").alias("page_number"),
        F.col("embedding").cast("array<double>").alias("vector"), "vec_id",
    )


def vector_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_index(spark, sf_dir).where(F.col("vec_id") % QUERY_STEP == 0).select(F.col("chunk_id").alias("query_id"), "document_id", "vector")


def text_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select(F.format_string("item-%05d", "item_id").alias("query_id"), F.col("text").alias("query"))


def words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every word of every document on a page of ten words a line, in one column or two.

    Texts are dealt by page before they become words, many times as many bytes:
    what groups words by page, or by page and row, then finds them together.
    """
    docs = table(spark, sf_dir, "documents").select(F.format_string("page-%06d", "doc_id").alias("page_id"), "doc_id", "text").repartition("page_id")
    placed = docs.select("page_id", "doc_id", F.posexplode(T.words(F.col("text"))).alias("word_index", "text"))
    i = F.col("word_index") % 10
    x0 = F.when((F.col("doc_id") % 2 == 0) & (i >= 5), 330.0 + (i - 5) * 45.0).otherwise(50.0 + i * 45.0)
    return placed.select(
        "page_id", "word_index", x0.alias("x0"), (x0 + 40.0).alias("x1"),
        (50.3 + 12.0 * F.floor(F.col("word_index") / 10)).alias("top"), "text", (F.col("word_index") % 97 != 0).alias("upright"),
    )


def layout_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.format_string("page-%06d", "doc_id").alias("page_id"), F.lit(600.0).alias("page_width"))


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every third page has a table; on every sixth, a cell ends within the space between the columns."""
    docs = table(spark, sf_dir, "documents").where("doc_id % 3 = 0")
    x = F.when(F.col("doc_id") % 6 == 0, 305.04).otherwise(120.0)
    return docs.select(F.format_string("page-%06d", "doc_id").alias("page_id"), F.lit(60.0).alias("x0"), F.lit(50.0).alias("top"), x.alias("x1"), F.lit(90.0).alias("bottom"))


# --- the same in DuckDB SQL -------------------------------------------------

WS, NON_WS = T.WS.replace("'", "''"), T.NON_WS.replace("'", "''")


def sql_pages(double_newlines: bool = False) -> str:
    text = "replace(text, chr(10), chr(10) || chr(10))" if double_newlines else "text"
    return f"""whole AS (SELECT doc_id, source AS document_id, source || '.txt' AS filename, CAST(row_number() OVER (PARTITION BY source ORDER BY doc_id) AS INT) AS page_number, {text} AS text, false AS failed FROM documents),
raw AS (SELECT document_id, filename, page_number, text, failed FROM whole UNION ALL SELECT document_id, filename, CAST({BESIDE} + page_number AS INT), '', doc_id % 97 = 0 FROM whole WHERE doc_id % 97 = 0 OR doc_id % 89 = 0),
pages AS (SELECT document_id, filename, page_number, text, CASE WHEN NOT failed THEN sha256(text) END AS text_sha256,
  CAST(CASE WHEN failed THEN 0 ELSE length(text) END AS INT) AS char_count, CAST(CASE WHEN failed THEN 0 ELSE len(regexp_extract_all(text, '{NON_WS}+')) END AS INT) AS word_count,
  CASE WHEN failed THEN 'failed' WHEN regexp_matches(text, '{NON_WS}') THEN 'ok' ELSE 'empty' END AS extraction_status FROM raw)"""


def sql_greedy(items: str, limit: int, separator: str, slack: int = 0) -> str:
    """Greedy joining as a fold over a text whose pieces chr(1) separates."""
    last = "string_split(a, chr(1))[-1]"
    step = f"CASE WHEN {last} = '' THEN a || x WHEN length({last}) + {len(separator)} + length(x) + {slack} > {limit} THEN a || chr(1) || x ELSE a || {_quoted(separator)} || x END"
    return f"(CASE WHEN len({items}) = 0 THEN CAST([] AS VARCHAR[]) ELSE list_filter(string_split(list_reduce({items}, lambda a, x: {step}), chr(1)), lambda z: z <> '') END)"


def _quoted(separator: str) -> str:
    return " || ".join("chr(10)" if c == "\n" else f"'{c}'" for c in separator)


def sql_chunks(double_newlines: bool = False) -> str:
    """CTEs pages … chunks(chunk_id, document_id, page_number, chunk_index, text)."""
    sentences = f"list_filter(string_split(regexp_replace(p, '([.!?]){WS}+', '\\1' || chr(1), 'g'), chr(1)), lambda s: regexp_matches(s, '{NON_WS}'))"
    words = lambda p: sql_greedy(f"string_split({p}, ' ')", 1800, " ")
    return f"""{sql_pages(double_newlines)},
paragraphs AS (SELECT document_id, page_number, unnest(list_filter(string_split_regex(text, '\\n[ \\t]*\\n+'), lambda p: regexp_matches(p, '{NON_WS}'))) AS p,
  generate_subscripts(list_filter(string_split_regex(text, '\\n[ \\t]*\\n+'), lambda p: regexp_matches(p, '{NON_WS}')), 1) AS n FROM pages WHERE extraction_status = 'ok'),
sentenced AS (SELECT *, CASE WHEN length(p) > 1800 THEN {sentences} END AS s FROM paragraphs),
grouped AS (SELECT *, CASE WHEN length(p) <= 1800 THEN [p] WHEN len(s) <= 1 THEN {words("p")} ELSE {sql_greedy("s", 1800, " ")} END AS g FROM sentenced),
groups AS (SELECT document_id, page_number, n, unnest(g) AS piece, generate_subscripts(g, 1) AS m FROM grouped),
fitted AS (SELECT document_id, page_number, n, m, CASE WHEN length(piece) <= 1800 THEN [piece] ELSE {words("piece")} END AS f FROM groups),
pieces AS (SELECT document_id, page_number, flatten(list(f ORDER BY n, m)) AS items FROM fitted GROUP BY document_id, page_number),
packed AS (SELECT document_id, page_number, {sql_greedy("items", 1200, chr(10) * 2, 2)} AS c FROM pieces),
merged AS (SELECT document_id, page_number, CASE WHEN len(c) >= 2 AND length(c[-1]) < 200 AND length(c[-2]) + 2 + length(c[-1]) <= 1800
  THEN list_append(c[:-3], c[-2] || chr(10) || chr(10) || c[-1]) ELSE c END AS c FROM packed),
numbered AS (SELECT document_id, page_number, unnest(c) AS text, CAST(generate_subscripts(c, 1) AS INT) AS chunk_index FROM merged),
chunks AS (SELECT printf('%s-p%03d-c%03d', document_id, page_number, chunk_index) AS chunk_id, document_id, page_number, chunk_index, text FROM numbered)"""


SQL_EXPECTED = "expected AS (SELECT document_id, count(*) + CASE WHEN document_id = 'src3' THEN 1 ELSE 0 END AS expected_pages, upper(sha256(document_id)) AS source_sha256 FROM pages GROUP BY document_id)"
SQL_CATALOG = "catalog AS (SELECT 'src' || n_nationkey AS document_id, n_name AS document_name FROM nation WHERE n_nationkey < 12)"
SQL_VECTORS = """idx AS (SELECT 'vec-' || lpad(CAST(vec_id AS VARCHAR), 8, '0') AS chunk_id, 'label-' || label AS document_id, CAST(vec_id % 7 + 1 AS INT) AS page_number, CAST(embedding AS DOUBLE[]) AS v, vec_id FROM embeddings),
normed AS (SELECT *, sqrt(list_reduce(list_transform(v, lambda x: x * x), lambda s, x: s + x)) AS norm FROM idx),
qs AS (SELECT chunk_id AS query_id, document_id, v AS qv, norm AS qn FROM normed WHERE vec_id % 20 = 0)"""
_COSINE = "list_reduce(list_transform(list_zip(qv, v), lambda z: z[1] * z[2]), lambda s, x: s + x) / (qn * norm)"
SQL_SCORED = f"{SQL_VECTORS}, scored AS (SELECT query_id, chunk_id, normed.document_id, page_number, {_COSINE} AS score FROM qs, normed)"
SQL_ROUTED = f"{SQL_VECTORS}, scored AS (SELECT query_id, chunk_id, normed.document_id, page_number, {_COSINE} AS score FROM qs JOIN normed ON qs.document_id = normed.document_id)"


def sql_sparse(texts: str, key: str, name: str, idf: bool = False, fit: str | None = None) -> str:
    """CTE `name`(key, bucket, weight) of unit vectors by SHA-256 buckets; `fit` names the tokens of the fitted corpus."""
    tok = f"{name}_tokens AS (SELECT {key}, token, count(*) AS tf FROM (SELECT {key}, unnest(list_filter(string_split_regex(lower(text), '{WS}+'), lambda t: t <> '')) AS token FROM {texts}) GROUP BY ALL)"
    if idf:
        fitted = fit or f"{name}_tokens"
        df = f"{name}_df AS (SELECT token, count(*) AS df FROM {fitted} GROUP BY token), {name}_n AS (SELECT count(*) AS n FROM {'chunks' if fit else texts})"
        weight, join = f"1 + ln((SELECT n FROM {name}_n)::DOUBLE / coalesce(df, 1))", f"LEFT JOIN {name}_df USING (token)"
        tok = f"{tok}, {df}"
    else:
        weight, join = "1.0::DOUBLE", ""
    return f"""{tok},
{name}_sums AS (SELECT {key}, bucket, sum(tf * w) AS weight FROM (SELECT {key}, CAST('0x' || substr(sha256(token), 15, 2) AS INT) AS bucket, tf, {weight} AS w FROM {name}_tokens {join}) GROUP BY ALL),
{name} AS (SELECT {key}, bucket, weight / sqrt(sum(weight * weight) OVER (PARTITION BY {key})) AS weight FROM {name}_sums)"""


SQL_ITEMS = "items AS (SELECT 'item-' || lpad(CAST(item_id AS VARCHAR), 5, '0') AS query_id, text FROM benchmark)"


def sql_lexical(idf: bool = False) -> str:
    """CTEs … ranked(query_id, chunk_id, document_id, page_number, score, rank, text) of all chunks for all benchmark items."""
    return f"""{sql_chunks()}, {SQL_ITEMS}, {sql_sparse("chunks", "chunk_id", "cv", idf)}, {sql_sparse("items", "query_id", "qv", idf, "cv_tokens" if idf else None)},
products AS (SELECT query_id, chunk_id, sum(qv.weight * cv.weight) AS score FROM qv JOIN cv USING (bucket) GROUP BY ALL),
scored AS (SELECT query_id, chunk_id, document_id, page_number, text, round(coalesce(score, 0), 9) AS score FROM (SELECT query_id FROM items) CROSS JOIN chunks LEFT JOIN products USING (query_id, chunk_id)),
ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS INT) AS rank FROM scored)"""


SQL_WORDS = f"""words AS (SELECT 'page-' || lpad(CAST(doc_id AS VARCHAR), 6, '0') AS page_id, doc_id, CAST(k - 1 AS INT) AS word_index, text,
  CASE WHEN doc_id % 2 = 0 AND (k - 1) % 10 >= 5 THEN 330.0::DOUBLE + ((k - 1) % 10 - 5) * 45 ELSE 50.0::DOUBLE + (k - 1) % 10 * 45 END AS x0,
  CAST(round_even(50.3 + 12 * ((k - 1) // 10), 0) AS INT) AS row, (k - 1) % 97 <> 0 AS upright
  FROM (SELECT doc_id, unnest(w) AS text, generate_subscripts(w, 1) AS k FROM (SELECT doc_id, regexp_extract_all(text, '{NON_WS}+') AS w FROM documents))),
up AS (SELECT *, x0 + 40 AS x1 FROM words WHERE upright),
cut AS (SELECT *, CASE WHEN x0 - lag(x1) OVER w > 8 THEN 1 ELSE 0 END AS c FROM up WINDOW w AS (PARTITION BY page_id, row ORDER BY x0, word_index)),
seg AS (SELECT *, CAST(sum(c) OVER (PARTITION BY page_id, row ORDER BY x0, word_index ROWS UNBOUNDED PRECEDING) AS BIGINT) AS segment FROM cut),
segments AS (SELECT page_id, row, segment, min(x0) AS x0, max(x1) AS x1, count(*) AS words FROM seg GROUP BY ALL)"""
SQL_COVERAGE = f"""{SQL_WORDS},
totals AS (SELECT page_id, count(*) AS total FROM segments GROUP BY page_id HAVING count(*) >= 10),
grid AS (SELECT page_id, total, i, 90.0::DOUBLE + i AS x FROM totals, (SELECT unnest(range(0, 421)) AS i)),
profile AS (SELECT page_id, i, x, total, count(s.x0) AS covered FROM grid g LEFT JOIN segments s USING (page_id) WHERE s.x0 <= x AND x <= s.x1 GROUP BY ALL),
coverage AS (SELECT page_id, i, x, coalesce(covered, 0) AS covered, total, coalesce(covered, 0)::DOUBLE / total AS frac FROM grid LEFT JOIN profile USING (page_id, i, x, total))"""
SQL_GUTTERS = f"""{SQL_COVERAGE},
low AS (SELECT *, i - row_number() OVER (PARTITION BY page_id ORDER BY i) AS island FROM coverage WHERE frac <= 0.05),
runs AS (SELECT page_id, min(x) AS "start", max(x) AS "end", max(frac) AS max_coverage, (max(i) - min(i))::DOUBLE AS width FROM low GROUP BY page_id, island HAVING max(i) - min(i) >= 6),
found AS (SELECT r.*, ("start" + "end") / 2 AS mid, count(*) FILTER (s.x1 <= "start") AS left_lines, count(*) FILTER (s.x0 >= "end") AS right_lines FROM runs r JOIN segments s USING (page_id) GROUP BY ALL),
gutters AS (SELECT * FROM found WHERE left_lines >= 5 AND right_lines >= 5),
cells AS (SELECT 'page-' || lpad(CAST(doc_id AS VARCHAR), 6, '0') AS page_id, [60.0::DOUBLE, CASE WHEN doc_id % 6 = 0 THEN 305.0::DOUBLE ELSE 120.0::DOUBLE END] AS bounds FROM documents WHERE doc_id % 3 = 0),
guarded AS (SELECT gutters.*, coalesce(len(list_filter(bounds, lambda b: abs(mid - b) <= 10)) > 0, false) AS rejected FROM gutters LEFT JOIN cells USING (page_id))"""
