import hashlib
import re

import pytest
from pyspark.sql import functions as F

from lodestone.llm import versions


def pieces(text):
    return set(re.findall(versions._PIECE, text))


def jaccard(a, b):
    return 1.0 if not a | b else len(a & b) / len(a | b)


@pytest.mark.parametrize("bucket_rows", [7, 1000])
def test_against_sets(spark, monkeypatch, docs, rows, bucket_rows):
    monkeypatch.setattr(versions, "BUCKET_ROWS", bucket_rows)
    got = {r.doc_id: r for r in versions.fingerprints(docs).collect()}
    order = sorted(((r[0], r[1] or "") for r in rows), reverse=True)
    prints = {}
    for at, (i, text) in enumerate(order):
        after = order[(at + 1) % len(order)][1]
        half = len(text) // 2
        edited = text[: len(text) - half] + after[:half]
        r = got[i]
        assert r.n_chars == len(text) and r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert r.near_edited == jaccard(pieces(text), pieces(edited))
        assert r.near_next == jaccard(pieces(text), pieces(after))
        assert prints.setdefault(r.fingerprint, pieces(text)) == pieces(text)
    assert len(got) == len(order)


@pytest.mark.parametrize(("shared", "left", "right"), [(0, 0, 0), (5, 2, 1), (40, 0, 3), (10, 30, 25), (300, 200, 400)])
def test_peeling_recovers_differences(spark, shared, left, right):
    key = lambda i: F.xxhash64(i)
    keys = lambda a, b: F.array_sort(F.transform(F.sequence(F.lit(0), F.lit(a + b)), lambda i: key(F.when(i < a, i).otherwise(i + 10_000 * (1 + b)))))
    frame = spark.range(1).select(keys(shared, left).alias("x"), keys(shared, right).alias("y")).withColumns({"cx": versions.sketch(F.col("x")), "cy": versions.sketch(F.col("y"))})
    r = frame.select(versions.likeness(F.col("x"), F.col("y"), F.col("cx"), F.col("cy")).alias("l"), "x", "y").first()
    assert r.l == jaccard(set(r.x), set(r.y))


def expected(rows):
    """(doc_id, edited text, next text) of rows (doc_id, text): by descending id, null last, then by text hash; any order of equal rows."""
    out = []
    for at, (i, text) in enumerate(rows):
        after, half = rows[(at + 1) % len(rows)][1], len(text) // 2
        out.append((str(i), hashlib.sha256((text[: len(text) - half] + after[:half]).encode()).hexdigest(), jaccard(pieces(text), pieces(after))))
    return sorted(out)


@pytest.mark.parametrize("many", [2, 8])
def test_ids_far_apart_null_and_repeated(spark, monkeypatch, many):
    monkeypatch.setattr(versions, "BUCKET_ROWS", 5)
    monkeypatch.setattr(versions, "TOO_MANY", many)
    text = lambda i: f"line {i % 7}\nline {i % 11}\nand so on {i % 3}."
    rows = [(2**63 - 1, "the first"), (-(2**63), "the last")] + [(2**60 + i, text(i)) for i in range(90)] + [(i, text(i * i)) for i in range(60)]
    rows += [(77, f"same id {i}") for i in range(100)] + [(78, "equal rows")] * 100 + [(None, f"no id {i}") for i in range(80)] + [(None, "nor here")] * 40
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    hashed = {r.text: r.h for r in frame.select("text", F.xxhash64("text").alias("h")).distinct().collect()}
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, hashed[r[1]]), reverse=True)
    got = versions.fingerprints(frame)
    assert sorted((str(r.doc_id), r.edited_sha256, r.near_next) for r in got.collect()) == expected(order)
    parts, _ = versions.bucketed(frame.select("doc_id", "text", F.xxhash64("text").alias("th"), F.monotonically_increasing_id().alias("salt")), versions.Staging(spark, "t"))
    assert parts.groupBy("b").count().agg(F.max("count")).first()[0] <= 5 * many


def test_larger_sketches_on_failure(spark):
    """Digests that share all cells of narrow sketches need wider ones; equal checks no sketch can tell apart."""
    rows = spark.range(200_000).select(F.xxhash64("id").alias("k")).select("k", F.array(*[F.pmod(F.shiftright(versions._check(F.col("k")), 16 * j), F.lit(5)) for j in range(3)]).alias("c")).where("c[0] = 0 and c[1] = 0 and c[2] = 0").limit(40).collect()
    assert len(rows) == 40
    frame = spark.createDataFrame([([r.k for r in rows[:20]], [r.k for r in rows[20:]])], "x array<long>, y array<long>")
    d = frame.withColumns({"cx": versions.sketch(F.col("x")), "cy": versions.sketch(F.col("y"))}).select(versions.difference(F.col("x"), F.col("y"), F.col("cx"), F.col("cy")).alias("d")).first().d
    assert (d.likeness, d.exact) == (0.0, 0) and d.retries > 0


def test_very_long_text(spark):
    long = "\n".join(f"a line of the long text, number {i}" for i in range(8_000))
    got = versions.fingerprints(spark.createDataFrame([(2, long), (1, long + "\nmore")], "doc_id long, text string")).orderBy("doc_id").collect()
    assert [r.n_paragraphs for r in got] == [8_001, 8_000] and all(r.near_next > 0.99 and r.n_exact == 0 for r in got)


def test_plan_has_no_python(docs, spark, empty):
    plan = versions.fingerprints(docs)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
    assert versions.fingerprints(empty).count() == 0
    odd = spark.createDataFrame([(None, "a\nb"), (5, "a\nb"), (5, "c"), (7, None)], "doc_id long, text string")
    got = versions.fingerprints(odd).collect()
    assert sorted(r.n_chars for r in got) == [0, 1, 3, 3]
    assert len({r.fingerprint for r in got}) == 3
    alone = versions.fingerprints(odd.where("doc_id = 7")).first()
    assert (alone.near_edited, alone.near_next) == (1.0, 1.0)
