"""What queries over large tables rest on: no list that grows with the square of a table, no shuffle of what can stay."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.operators import blockwise, embedding, evaluation
from lodestone.plans import fixtures


@pytest.fixture(scope="module")
def vectors(spark):
    r = np.random.default_rng(3)
    rows = [(f"v{i:03d}", f"g{i % 3}" if i < 58 else f"alone{i}", r.integers(-2, 3, 4).astype(float).tolist()) for i in range(60)]
    rows = [(c, g, v if any(v) else [1.0] * 4) for c, g, v in rows]
    return spark.createDataFrame(rows, "chunk_id string, document_id string, vector array<double>").withColumn("page_number", F.lit(1)), rows


def brute(rows):
    """Of each record as a query, (rank, id) of the others of its group among all others."""
    out = {}
    for q, g, v in rows:
        score = lambda w, v=v: sum(a * b for a, b in zip(v, w)) / (np.sqrt(sum(a * a for a in v)) * np.sqrt(sum(b * b for b in w)))
        others = sorted(((-score(w), c, h) for c, h, w in rows if c != q))
        found = [(i, c) for i, (_, c, h) in enumerate(others, 1) if h == g]
        if found:
            out[q] = found
    return out


@pytest.mark.parametrize("held", [8 << 20, 400])
def test_group_ranks(vectors, monkeypatch, held):
    monkeypatch.setattr(blockwise, "HELD_SCORES", held)
    index, rows = vectors
    queries, expected = index.select(F.col("chunk_id").alias("query_id"), "document_id", "vector"), brute(rows)
    got = {r.case_id: r for r in evaluation.group_metrics(index, queries, "document_id", 2).collect()}
    assert set(got) == set(expected) and len(got) == 58
    for q, found in expected.items():
        top = [i for i, _ in found if i <= 2]
        assert (got[q].relevant_ranks, got[q].first_relevant_rank, got[q].hitk) == (top, min(top, default=None), int(bool(top)))
    ranks = {}
    for r in evaluation.group_full_ranks(index, queries, "document_id", 2).collect():
        ranks.setdefault(r.case_id, []).append((r.rank, r.chunk_id))
    assert {q: sorted(f) for q, f in ranks.items()} == {q: f for q, f in expected.items() if f[0][0] > 2}


def test_hashing_shuffles_nothing(spark):
    texts = spark.createDataFrame([("a", "One one TWO\x1ctwo　x"), ("b", "y")], "chunk_id string, text string")
    for hasher in (embedding.sha_bucket, embedding.blake_bucket):
        found = embedding.HashProvider(64, hasher).embed_sparse(texts, "chunk_id", "text")
        assert "Exchange" not in found._jdf.queryExecution().toString()
        other = embedding.sparse(embedding.token_counts(texts, "chunk_id", "text"), "chunk_id", hasher, 64)
        rounded = lambda df: sorted((r.chunk_id, r.bucket, round(r.weight, 12)) for r in df.collect())
        assert rounded(found) == rounded(other)


def test_idf_both_ways(spark, monkeypatch):
    rows = [(f"c{i}", " ".join(f"w{i % k}" for k in range(1, 9)) + f" own{i}") for i in range(40)]
    texts = spark.createDataFrame(rows, "chunk_id string, text string")
    monkeypatch.setattr(embedding, "COUNTED_BYTES", 100)
    monkeypatch.setattr(embedding, "REMEMBERED", 5)
    rounded = lambda: sorted((r.chunk_id, r.bucket, round(r.weight, 12)) for r in embedding.TermWeightedProvider(texts, "chunk_id", "text", 32, embedding.sha_bucket).embed_sparse(texts, "chunk_id", "text").collect())
    listed = rounded()
    monkeypatch.setattr(embedding, "LISTED_TOKENS", 0)
    assert listed == rounded()


def test_words_stay_with_their_page(spark):
    import os

    from lodestone.plans import catalog

    sf_dir = "/root/testdata/sf0.001"
    if not os.path.isdir(sf_dir):
        pytest.skip("the driver's tables are absent")
    plan = catalog.QUERIES["coverage_profile"](spark, sf_dir)._jdf.queryExecution().sparkPlan().toString()
    assert plan.count("Join") == 1  # of pages and their segments; no step is joined
    executed = catalog.QUERIES["line_segments"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert executed.count("Exchange") == 1 and "text" in executed.split("Exchange")[1]


def test_whole_rankings_are_made_where_they_are_scored(spark, monkeypatch):
    """The same rows as by scores and a window, ties and odd vectors included, and no pair is shuffled or sorted by Spark."""
    import random

    from lodestone.operators import retrieval

    r = random.Random(9)
    vectors = [[r.choice([-1.0, 0.5, 1.0, 2.0]) for _ in range(3)] for _ in range(60)]
    vectors[7], vectors[11], vectors[20] = None, [1.0, None, 2.0], [1.0, 2.0]
    rows = [(f"c{i * 7 % 60:02d}", f"d{i % 4}", i % 5, v) for i, v in enumerate(vectors)]
    index = spark.createDataFrame(rows, "chunk_id string, document_id string, page_number int, vector array<double>").repartition(3)
    queries = index.where("page_number = 0 or chunk_id in ('c49', 'c17')").selectExpr("chunk_id as query_id", "vector")
    want = retrieval.full_ranking(retrieval.scores(index, queries), 5)
    monkeypatch.setattr(blockwise, "GIVEN_ROWS", 7)
    got = retrieval.full_trace(index, queries, 5)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "Sort" not in plan
    assert sorted(map(repr, got.select(want.columns).collect())) == sorted(map(repr, want.collect()))
    monkeypatch.setattr(blockwise, "HELD_BYTES", 1)
    assert sorted(map(repr, retrieval.full_trace(index, queries, 5).select(want.columns).collect())) == sorted(map(repr, want.collect()))
    assert retrieval.full_trace(index, queries.limit(0), 5).isEmpty() and retrieval.full_trace(index.limit(0), queries, 5).isEmpty()


def test_page_numbers_sort_no_texts(spark, tmp_path, monkeypatch):
    """Texts meet their page numbers without being sorted, whether numbers are broadcast or not, and get the same numbers."""
    rows = [(i, f"text {i}", f"s{i % 3}") for i in range(40)]
    spark.createDataFrame(rows, "doc_id long, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    got, was = [], spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for most in (0, 1000):
            monkeypatch.setattr(fixtures, "BROADCAST_NUMBERS", most, raising=False)
            found = fixtures.raw_pages(spark, str(tmp_path))
            plan = found._jdf.queryExecution().sparkPlan().toString()
            assert not [line for line in plan.splitlines() if "SortMergeJoin [doc_id" in line], plan
            got.append(sorted((r.text, r.page_number) for r in found.where("page_number < 1000000").collect()))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", was)
    assert got[0] == got[1] == sorted((t, i // 3 + 1) for i, t, _ in rows)


def test_whole_rankings_copy_no_records(spark):
    """Records are written once and read by each group of queries; what is shuffled is the queries alone."""
    from lodestone.operators import retrieval

    index = fixtures.vector_index(spark, "/root/testdata/sf0.001")
    got = retrieval.full_trace(index, fixtures.vector_queries(spark, "/root/testdata/sf0.001"), 5)
    plan = got._jdf.queryExecution().sparkPlan().toString()
    assert "CartesianProduct" in plan and "Generate" not in plan, plan
    exchanges = [plan.splitlines()[i + 1 :] for i, line in enumerate(plan.splitlines()) if "Exchange" in line]
    assert exchanges and all(not any("records" in line for line in below) for below in exchanges), plan
    got.write.format("noop").mode("overwrite").save()
    assert got.rdd.getNumPartitions() >= 2


@pytest.mark.parametrize("most", [100_000, 0])
def test_holders_leave_texts_where_they_are(spark, monkeypatch, most):
    """A query meets the texts with its rarest inner word; neither texts nor their words are shuffled, unless queries are too many."""
    monkeypatch.setattr(evaluation, "BROADCAST_WORDS", most, raising=False)
    texts = ["the red fox ran over the hill", "red fox ran over the hi", "a fox", "", None, "the  red fox", "hill the red fox ran"]
    asked = ["the red fox ran", "red fox", "ed fox ran over the hi", "fox", "no such words here", "the red fox"]
    chunks = spark.createDataFrame([(f"c{i}", t) for i, t in enumerate(texts)], "chunk_id string, text string")
    queries = spark.createDataFrame([(f"q{i}", t) for i, t in enumerate(asked)], "query_id string, query string")
    was = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = evaluation.holders(chunks, queries.where("query_id not in ('q1', 'q3')"))
        plan = got._jdf.queryExecution().executedPlan().toString()
        assert most == 0 or "hashpartitioning" not in plan, plan
        found = sorted(map(tuple, evaluation.holders(chunks, queries).collect()))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", was)
    assert found == sorted((f"q{i}", f"c{j}") for i, q in enumerate(asked) for j, t in enumerate(texts) if t and q in t)
