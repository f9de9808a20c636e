"""The queries op1 to op13 over the driver's tables, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import collocations, licenses, mixing, owners, packing, prefixtrie, recompression, secrets, simhash, tokenfiles, topk, toxicity, versions


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best others of every hundredth vector by whole-number inner product."""
    return topk.search(_table(spark, sf_dir, "embeddings"), k=10, query_step=100)


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SimHash near-duplicates over all documents."""
    return simhash.near_duplicates(_table(spark, sf_dir, "documents")).drop("th")


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of all documents, learnt from the labels of four folds of five."""
    labels = _table(spark, sf_dir, "labels")
    learnt = labels.where(~toxicity.held_out(F.col("doc_id")))
    scored = toxicity.score(_table(spark, sf_dir, "documents"), learnt)
    return scored.select("doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), F.size("passages").alias("n_passages"))


def _tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op4_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token files of all documents, written and read back."""
    return tokenfiles.round_trip(_table(spark, sf_dir, "documents"), _tokenizer("word_bpe_49k.json"), keeps_space=False, end_id=2)


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources mixed to weights 5, 2, 1 in turn, at most three epochs of any."""
    return mixing.mix(_table(spark, sf_dir, "documents"), weights=(5, 2, 1), max_epochs=3.0)


def op6_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sketches of all documents and of their edited texts, and how alike they are."""
    return versions.fingerprints(_table(spark, sf_dir, "documents"))


def op7_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of all documents: counts of the base kinds, and digests of base and all spans."""
    found = secrets.scan_secrets(_table(spark, sf_dir, "documents"))
    of = lambda kind: F.filter("spans", lambda s: s["kind"] == kind)
    counts = [F.size(of(k)).cast("long").alias(f"n_{k}") for k in secrets.KINDS]
    base = secrets.span_text(F.filter("spans", lambda s: s["kind"] != secrets.LEARNT))
    return found.select("doc_id", *counts, F.sha2(F.encode(base, "UTF-8"), 256).alias("base_sha256"), secrets.span_text(F.col("spans")).alias("spans"))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into windows of 1024 tokens that hold the sources in proportion."""
    return packing.pack(_table(spark, sf_dir, "documents"), _tokenizer("byte_bpe_50k.json"), window=1024, end_id=0)


def op9_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence families of all documents."""
    return licenses.families(licenses.scan_licenses(_table(spark, sf_dir, "documents")))


def op10_recompression(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of 50-word windows that a document of smaller id has as well, removed."""
    return recompression.remove_repeats(_table(spark, sf_dir, "documents"), window=50)


def op11_prefixtrie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The prefix trie of all conversations, rebuilt on the first one of each hundred."""
    return prefixtrie.conversation_trie(_table(spark, sf_dir, "conversations"), block=100, shared_turns=6)


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 2000 phrases of two and three words of each language."""
    return collocations.collocations(_table(spark, sf_dir, "documents"), max_words=3, min_count=10, subsumed_percent=50, top=2000)


def op13_owners(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with the document of largest id that has their text, case of A-Z aside."""
    return owners.owners(_table(spark, sf_dir, "documents"), keep="largest").members


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_topk": op1_topk,
    "op2_simhash": op2_simhash,
    "op3_toxicity": op3_toxicity,
    "op4_token_files": op4_token_files,
    "op5_mixing": op5_mixing,
    "op6_versions": op6_versions,
    "op7_secrets": op7_secrets,
    "op8_packing": op8_packing,
    "op9_licenses": op9_licenses,
    "op10_recompression": op10_recompression,
    "op11_prefixtrie": op11_prefixtrie,
    "op12_collocations": op12_collocations,
    "op13_owners": op13_owners,
}

_OP5 = """
WITH d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS size,
         CAST('0x' || substr(md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), 'null')), 1, 8) AS BIGINT) AS h
  FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source ASC NULLS LAST) - 1 AS place FROM d GROUP BY source),
w AS (SELECT *, [5, 2, 1][CAST(place % 3 + 1 AS INT)] AS weight, 3.0::DOUBLE * source_size AS cap FROM s),
o AS (SELECT *, (sum(source_size) OVER ())::DOUBLE - coalesce(sum(cap) OVER b, 0.0::DOUBLE) AS left_size,
             sum(weight) OVER () - coalesce(sum(weight) OVER b, 0) AS left_weight
      FROM w WINDOW b AS (ORDER BY source_size::DOUBLE / weight, coalesce('s' || source, 'n') ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
c AS (SELECT *, weight * (left_size / left_weight) > cap AS clamped FROM o),
t AS (SELECT *, CASE WHEN clamped THEN cap ELSE weight * (max(CASE WHEN NOT clamped THEN left_size END) OVER () / max(CASE WHEN NOT clamped THEN left_weight END) OVER ()) END AS target FROM c),
r AS (SELECT source, source_size, target, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS whole FROM t),
p AS (SELECT d.doc_id, d.source, d.size, r.source_size, r.target, r.whole, r.target - r.whole * r.source_size AS part,
             sum(d.size) OVER (PARTITION BY d.source ORDER BY d.h, d.doc_id, d.size ROWS UNBOUNDED PRECEDING) - d.size / 2.0::DOUBLE AS middle
      FROM d JOIN r ON d.source IS NOT DISTINCT FROM r.source)
SELECT doc_id, source, size, source_size, target, CAST(whole + CASE WHEN part > 0 AND middle <= part THEN 1 ELSE 0 END AS BIGINT) AS reps,
       CAST(size * (whole + CASE WHEN part > 0 AND middle <= part THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM p
"""

_OP1 = """
WITH v AS (SELECT vec_id, list_transform(CAST(embedding AS DOUBLE[]), lambda x: CAST(floor(1024 * x) AS BIGINT)) AS v FROM embeddings
           WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, v.vec_id, CAST(coalesce(list_sum(list_transform(list_zip(q.v, v.v), lambda z: z[1] * z[2])), 0) AS BIGINT) AS score
      FROM v q JOIN v ON q.vec_id % 100 = 0 AND q.vec_id <> v.vec_id AND len(q.v) = len(v.v)),
r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INT) AS rank, vec_id, score FROM s)
SELECT * FROM r WHERE rank <= 10
"""

_OP10 = """
WITH d AS (SELECT doc_id, row_number() OVER () AS rid, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
u AS (SELECT doc_id, rid, len(w) AS n, unnest(w) AS word, generate_subscripts(w, 1) AS j FROM d),
s AS (SELECT doc_id, rid, n, j, md5(string_agg(word, ' ') OVER (PARTITION BY rid ORDER BY j ROWS BETWEEN CURRENT ROW AND 49 FOLLOWING)) AS h FROM u WHERE n >= 50),
f AS (SELECT h, min(doc_id) AS lo FROM s WHERE j <= n - 49 GROUP BY h),
c AS (SELECT DISTINCT rid, unnest(range(j, j + 50)) AS j FROM s JOIN f USING (h) WHERE s.j <= n - 49 AND lo < doc_id),
k AS (SELECT rid, string_agg(word, ' ' ORDER BY j) AS kept, count(*) AS n_kept FROM u ANTI JOIN c USING (rid, j) GROUP BY rid)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n_kept, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN k USING (rid)
"""

#: crc32 of the decimal id, bit by bit and polynomial 3988292384, as DuckDB has no such function.
_OP11 = """
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
g AS (SELECT conv_id, turn, {'d': sha256(length(role)::VARCHAR || ':' || role || text), 'n': CAST(length(text) AS BIGINT)} AS x FROM t),
own AS (SELECT conv_id, list(x ORDER BY turn NULLS FIRST, x.d) AS x FROM g GROUP BY conv_id),
h AS (SELECT conv_id, x, conv_id - conv_id % 100 AS base,
             CAST(xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(conv_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)),
               lambda a, b: list_reduce(list_prepend(xor(a, b), [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]), lambda s, z: CASE WHEN s % 2 = 1 THEN xor(s // 2, 3988292384::BIGINT) ELSE s // 2 END)),
               4294967295::BIGINT) % 6 AS INT) AS h FROM own),
r AS (SELECT h.conv_id, list_concat(coalesce(list_slice(b.x, 1, h.h), []), list_slice(h.x, h.h + 1, len(h.x))) AS x FROM h LEFT JOIN own b ON b.conv_id = h.base),
p AS (SELECT conv_id, len(x) AS len, unnest(range(0, len(x) + 1)) AS depth, x FROM r),
k AS (SELECT conv_id, len, depth, sha256(array_to_string(list_transform(list_slice(x, 1, depth), lambda y: y.d), '')) AS key,
             sha256(array_to_string(list_transform(list_slice(x, 1, depth - 1), lambda y: y.d), '')) AS up, coalesce(x[depth].n, 0) AS chars FROM p),
n AS (SELECT depth, key, any_value(up) AS up, any_value(chars) AS chars, min(conv_id) AS conv_id, count(*) AS n_convs,
             sha256(coalesce(string_agg(CASE WHEN len = depth THEN conv_id::VARCHAR END, ',' ORDER BY conv_id), '')) AS ends_sha256 FROM k GROUP BY depth, key),
c AS (SELECT n.*, count(z.key) AS n_children FROM n LEFT JOIN n z ON z.depth = n.depth + 1 AND z.up = n.key GROUP BY ALL),
s AS (SELECT k.depth, k.key, sum(CASE WHEN c.n_children = 0 THEN 1 ELSE 0 END) AS n_leaves, sum((c.n_convs - 1) * c.chars) AS saved_tokens
      FROM c JOIN k ON k.conv_id = c.conv_id AND k.depth <= c.depth GROUP BY k.depth, k.key)
SELECT c.conv_id, CAST(c.depth AS BIGINT) AS depth, u.conv_id AS parent_conv_id, c.n_convs, c.n_children, CAST(s.n_leaves AS BIGINT) AS n_leaves,
       CAST(s.saved_tokens AS BIGINT) AS saved_tokens, c.ends_sha256
FROM c JOIN s USING (depth, key) LEFT JOIN n u ON u.depth = c.depth - 1 AND u.key = c.up
"""

_OP12 = """
WITH d AS (SELECT row_number() OVER () AS rid, coalesce(lang, 'und') AS lang,
                  string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]') AS p FROM documents),
e AS (SELECT rid, lang, unnest(p) AS p, generate_subscripts(p, 1) AS i FROM d),
f AS (SELECT rid, lang, i, regexp_extract_all(p, '[^\\x20\\x09]+') AS w FROM e),
u AS (SELECT rid, lang, i, unnest(w) AS w1, generate_subscripts(w, 1) AS j FROM f),
v AS (SELECT lang, w1, lead(w1) OVER s AS w2, lead(w1, 2) OVER s AS w3 FROM u WINDOW s AS (PARTITION BY rid, i ORDER BY j)),
c1 AS (SELECT lang, w1, count(*) AS f FROM v GROUP BY ALL),
c2 AS (SELECT lang, w1, w2, count(*) AS f FROM v WHERE w2 IS NOT NULL GROUP BY ALL HAVING f >= 10),
c3 AS (SELECT lang, w1, w2, w3, count(*) AS f FROM v WHERE w3 IS NOT NULL GROUP BY ALL HAVING f >= 10),
m AS (SELECT lang, w1, w2, max(f) AS f FROM (SELECT lang, w1, w2, f FROM c3 UNION ALL SELECT lang, w2, w3, f FROM c3) GROUP BY ALL),
x AS (SELECT lang, c2.w1 || ' ' || c2.w2 AS phrase, c2.f AS a, a.f AS l, b.f AS r, 1 AS k
      FROM c2 JOIN c1 a USING (lang, w1) JOIN c1 b ON b.lang = c2.lang AND b.w1 = c2.w2 LEFT JOIN m USING (lang, w1, w2) WHERE m.f IS NULL OR 100 * m.f < 50 * c2.f
      UNION ALL
      SELECT lang, c3.w1 || ' ' || c3.w2 || ' ' || c3.w3, c3.f, a.f, b.f, 1 FROM c3 JOIN c1 a USING (lang, w1) JOIN c2 b ON b.lang = c3.lang AND b.w1 = c3.w2 AND b.w2 = c3.w3
      UNION ALL
      SELECT lang, c3.w1 || ' ' || c3.w2 || ' ' || c3.w3, c3.f, a.f, b.f, 2 FROM c3 JOIN c2 a USING (lang, w1, w2) JOIN c1 b ON b.lang = c3.lang AND b.w1 = c3.w3),
y AS (SELECT *, CAST((1000000::HUGEINT * a * a) // (l::HUGEINT * r) AS BIGINT) AS score FROM x),
z AS (SELECT * FROM y QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
o AS (SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, score FROM z),
t AS (SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM c1 GROUP BY lang)
SELECT lang, rank, phrase, a, l, r, n, score FROM o JOIN t USING (lang) WHERE rank <= 2000
"""

_OP13 = """
WITH d AS (SELECT doc_id, row_number() OVER () AS rid, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       row_number() OVER (PARTITION BY t ORDER BY doc_id DESC NULLS LAST, rid) = 1 AS kept, sha256(t) AS text_sha256
FROM d WINDOW w AS (PARTITION BY t)
"""

ORACLE_SQL: dict[str, str] = {
    "op1_topk": _OP1,
    "op5_mixing": _OP5,
    "op10_recompression": _OP10,
    "op11_prefixtrie": _OP11,
    "op12_collocations": _OP12,
    "op13_owners": _OP13,
}
