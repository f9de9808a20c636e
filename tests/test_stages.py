import json

import pytest
from pyspark.sql import functions as F

from lodestone.errors import ContextError, EmbeddingError, EvaluationError, GenerationError, IngestionError, RetrievalError
from lodestone.operators import answer, context, embedding, evaluation, index, pages, records, reports, retrieval
from lodestone.plans.run import run_queries

CHUNKS = "chunk_id string, document_id string, page_number int, chunk_index int, text string"
ROWS = [("A-p001-c001", "A", 1, 1, "sugar levels and diet"), ("A-p001-c002", "A", 1, 2, "sugar sugar insulin dose"), ("B-p002-c001", "B", 2, 1, "walking and sleep"), ("B-p003-c001", "B", 3, 1, "Insulin storage, cold")]


@pytest.fixture(scope="module")
def chunks(spark):
    return spark.createDataFrame(ROWS, CHUNKS).cache()


@pytest.fixture(scope="module")
def built(spark, chunks):
    names = spark.createDataFrame([("A", "Name of A", "", "", "", "")], "document_id string, document_name string, source string, publication_date string, version string, ingestion_date string")
    provider = embedding.HashProvider(64)
    return index.build_index(chunks, embedding.generate_embeddings(chunks, provider), names).cache(), provider


def test_hash_vectors(spark, chunks):
    import hashlib
    import math

    got = {r.chunk_id: r.vector for r in embedding.HashProvider(16).embed(chunks, "chunk_id", "text").collect()}
    for key, *_, text in ROWS:
        counts = [0.0] * 16
        for t in text.lower().split():
            counts[int.from_bytes(hashlib.blake2b(t.encode(), digest_size=8).digest(), "big") % 16] += 1
        n = math.sqrt(sum(c * c for c in counts))
        assert got[key] == pytest.approx([c / n for c in counts])
    with pytest.raises(EmbeddingError):
        embedding.HashProvider(16).embed(spark.createDataFrame([("x", "  ")], "chunk_id string, text string"), "chunk_id", "text")
    with pytest.raises(EmbeddingError):
        embedding.HashProvider(True)
    with pytest.raises(EmbeddingError):
        embedding.named_provider("other")


def test_idf_weights(chunks):
    import math

    provider = embedding.TermWeightedProvider(chunks, "chunk_id", "text", 64, embedding.sha_bucket)
    weights = {r.token: r.weight for r in provider.weights.collect()}
    assert weights["sugar"] == pytest.approx(1 + math.log(4 / 2)) and weights["sleep"] == pytest.approx(1 + math.log(4))
    assert provider.params()["corpus_chunks"] == 4


def test_models_run_by_batch(chunks):
    seen = embedding.ModelProvider("m", 2, lambda: lambda texts: [[float(len(t)), 1.0] for t in texts], prefix="q: ")
    got = {r.chunk_id: r.vector for r in embedding.generate_embeddings(chunks, seen).collect()}
    assert got["A-p001-c001"] == [len("q: sugar levels and diet"), 1.0]
    for bad in ([0.0, 0.0], [float("nan"), 1.0], [1.0]):
        with pytest.raises(EmbeddingError):
            embedding.generate_embeddings(chunks, embedding.ModelProvider("bad", 2, lambda bad=bad: lambda texts: [bad for _ in texts]))


def test_index_checks(spark, chunks, built):
    vectors = chunks.select("chunk_id", "document_id", "page_number", F.array(F.lit(1.0), F.lit(2.0)).alias("vector"))
    assert index.summary(built[0]).first().asDict() == {"document_count": 2, "chunk_count": 4}
    for a, b in (
        (chunks, vectors.where("page_number < 3")), (chunks.where("page_number < 3"), vectors), (chunks.union(chunks), vectors), (chunks, vectors.union(vectors)),
        (chunks, vectors.withColumn("document_id", F.lit("A"))), (chunks, vectors.withColumn("vector", F.when(F.col("page_number") == 1, F.array(F.lit(1.0))).otherwise(F.col("vector")))),
        (chunks, vectors.withColumn("vector", F.array(F.lit(0.0), F.lit(0.0)))),
    ):
        with pytest.raises(RetrievalError):
            index.build_index(a, b)
    one = index.build_index(chunks, vectors)
    with pytest.raises(RetrievalError):
        index.corpus_index([one, one])
    assert index.corpus_index([one.where("document_id = 'A'"), one.where("document_id = 'B'")]).count() == 4


def test_search(spark, built):
    store, provider = built
    queries = spark.createDataFrame([("q1", "sugar insulin"), ("q2", "sleep")], "query_id string, query string")
    got = retrieval.search(store, provider.embed(queries, "query_id", "query"), 2).orderBy("query_id", "rank").collect()
    assert [r.rank for r in got] == [1, 2, 1, 2] and got[0].chunk_id == "A-p001-c002" and got[0].document_name == "Name of A" and got[2].chunk_id == "B-p002-c001"
    ties = spark.createDataFrame([("q", "zzz unseen")], "query_id string, query string")
    zero = retrieval.search(store, provider.embed(ties, "query_id", "query"), 4).orderBy("rank").collect()
    assert [r.score for r in zero] == sorted((r.score for r in zero), reverse=True)
    for k in (0, 5, True, "2"):
        with pytest.raises(RetrievalError):
            retrieval.search(store, provider.embed(queries, "query_id", "query"), k)
    with pytest.raises(RetrievalError):
        retrieval.valid_queries(spark.createDataFrame([("q", " ")], "query_id string, query string"))


def test_many_query_blocks(spark, built, monkeypatch):
    store, provider = built
    vectors = provider.embed(spark.createDataFrame([(f"q{i}", f"sugar {i}") for i in range(7)], "query_id string, query string"), "query_id", "query").cache()
    whole = sorted(map(tuple, retrieval.scores(store, vectors).collect()))
    monkeypatch.setattr(retrieval, "QUERY_BLOCK", 2)
    assert sorted(map(tuple, retrieval.scores(store, vectors).collect())) == whole and len(whole) == 28


def results(spark, sizes, doc="D"):
    rows = [("q", i, f"c{i}", f"{doc}{i % 2}", i, 1.0 / i, "x" * n) for i, n in enumerate(sizes, 1)]
    return spark.createDataFrame(rows, "query_id string, rank int, chunk_id string, document_id string, page_number int, score double, text string")


@pytest.mark.parametrize(("budget", "kept"), [(None, 4), (1, 1), (150, 1), (160, 2), (161, 2), (10_000, 4)])
def test_budget(spark, budget, kept):
    queries = spark.createDataFrame([("q", "what"), ("none", "empty")], "query_id string, query string")
    got = {r.query_id: r for r in context.build_context(results(spark, [100, 60, 200, 1]), queries, budget).collect()}
    assert [e.rank for e in got["q"].evidence] == list(range(1, kept + 1)) and got["q"].truncated_chunk_ids == [f"c{i}" for i in range(kept + 1, 5)]
    assert got["q"].evidence_count == kept and [d.document_id for d in got["q"].documents] == ["D1", "D0"][: min(kept, 2)]
    assert (got["none"].evidence_count, got["none"].evidence, got["none"].documents) == (0, [], [])


def test_context_rejects(spark):
    queries = spark.createDataFrame([("q", "what")], "query_id string, query string")
    good = results(spark, [5])
    for bad in (good.union(good), good.withColumn("text", F.lit(None).cast("string")), good.withColumn("chunk_id", F.lit(""))):
        with pytest.raises(ContextError):
            context.build_context(bad, queries)
    for size in (0, True, 1.5):
        with pytest.raises(ContextError):
            context.build_context(good, queries, size)


def test_citations(spark):
    text = "EVIDENCE_ITEM_RANK: 2, EVIDENCE_ITEM_RANK:02 EVIDENCE_ITEM_RANK : 0 EVIDENCE_ITEM_RANK: 99999999999 EVIDENCE_ITEM_CHUNK_ID: a-1. EVIDENCE_ITEM_CHUNK_ID:é_9 evidence_item_rank: 7"
    row = spark.range(1).select(answer.cited_ranks(F.lit(text)).alias("r"), answer.cited_chunks(F.lit(text)).alias("c"), answer.invalid_citations(F.lit(text), F.array(F.lit("a-1"), F.lit("b"))).alias("i"), answer.invalid_citations(F.lit(None).cast("string"), F.array(F.lit("a"))).alias("n")).first()
    assert row.r == ["2", "0", "99999999999"] and row.c == ["a-1", "é_9"] and row.n == []
    assert [tuple(x) for x in row.i] == [("rank", "0"), ("rank", "99999999999"), ("chunk_id", "é_9")]


def test_run_and_records(spark, built, tmp_path, monkeypatch):
    store, provider = built
    queries = spark.createDataFrame([("q1", "sugar insulin"), ("q2", "sleep")], "query_id string, query string")
    script = answer.ScriptedProvider(lambda p: f"  {answer.ABSTAIN} no  " if "sleep" in p.split("TOTAL")[0] else "Yes EVIDENCE_ITEM_RANK: 1, EVIDENCE_ITEM_CHUNK_ID: nope")
    run = run_queries(store, queries, provider, script, 3, 40, tmp_path / "log")
    got = {r.query_id: r for r in run.answers.collect()}
    assert got["q1"].status == "ok" and [tuple(x) for x in got["q1"].invalid_citations] == [("chunk_id", "nope")] and got["q2"].status == "abstained" and got["q2"].answer == f"{answer.ABSTAIN} no"
    assert run.candidates.count() == 8 and run.candidates.where("selected").count() == 6
    logged = {r["query_id"]: r for p in (tmp_path / "log").glob("*.json") for r in map(json.loads, p.read_text().splitlines())}
    record = logged["q1"]
    assert len(record["run_id"]) == 32 and record["retrieval"]["top_k"] == 3 and len(record["retrieval"]["chunks"]) == 3
    assert len(record["sources"]) == len(record["context"]["chunk_ids_used"]) and record["generation"]["abstained"] is False
    assert run.records.where(F.col("run_id") == record["run_id"]).count() == 1
    monkeypatch.setenv(records.LOG_VARIABLE, "  ")
    assert records.log_path() is None and records.log_path("x") == "x"


def test_no_evidence_never_asks(spark):
    def fail(prompt):
        raise AssertionError("asked")

    queries = spark.createDataFrame([("q", "what")], "query_id string, query string")
    bundles = context.build_context(results(spark, [5]).limit(0), queries)
    got = answer.generate_answers(bundles, answer.ScriptedProvider(fail)).first()
    assert (got.status, got.answer, got.attempts, got.invalid_citations) == ("no_evidence", None, 0, [])
    assert "TOTAL_SUPPLIED_EVIDENCE_ITEMS: 0" in got.prompt_text
    with pytest.raises(GenerationError):
        answer.generate_answers(bundles.withColumn("query", F.lit(" ")), answer.ScriptedProvider(fail))


def test_metrics(spark):
    ranked = spark.createDataFrame([("a", f"c{i}", i) for i in range(1, 9)] + [("b", f"c{i}", i) for i in range(1, 9)] + [("c", "c1", 1)], "case_id string, chunk_id string, rank int")
    cases = spark.createDataFrame([("a", ["c3", "c1"]), ("b", ["c7", "zz"]), ("c", ["c1"])], "case_id string, expected_chunk_ids array<string>")
    got = {r.case_id: r for r in evaluation.case_metrics(ranked, evaluation.valid_cases(cases)).collect()}
    assert (got["a"].first_relevant_rank, got["a"].relevant_ranks, got["a"].hit1, got["a"].hitk, got["a"].reciprocal_rank, got["a"].full_ranks) == (1, [1, 3], 1, 1, 1.0, None)
    assert (got["b"].first_relevant_rank, got["b"].hitk, got["b"].reciprocal_rank) == (None, 0, 0.0) and [tuple(x) for x in got["b"].full_ranks] == [("c7", 7), ("zz", None)]
    total = evaluation.summary(evaluation.case_metrics(ranked, cases)).first()
    assert (total.n_cases, total.hit1, total.hitk, total.mrr) == (3, 2, 2, pytest.approx(2 / 3))
    for bad in ([], ["x", "x"]):
        with pytest.raises(EvaluationError):
            evaluation.valid_cases(spark.createDataFrame([("a", bad)], "case_id string, expected_chunk_ids array<string>"))
    with pytest.raises(EvaluationError):
        evaluation.case_metrics(ranked, cases, 0)


def test_benchmark(spark, chunks):
    cases = spark.createDataFrame([("k1", "A", "insulin dose", ["A-p001-c002"]), ("k2", "B", "sugar", ["B-p003-c001"])], "case_id string, document_id string, query string, expected_chunk_ids array<string>")
    fit = {"hash": lambda c: (embedding.HashProvider(), embedding.HashProvider()), "idf": lambda c: (p := embedding.TermWeightedProvider(c, "chunk_id", "text"), p)}
    got = evaluation.run_with_providers(cases, chunks, fit, 1).collect()
    assert {(r.provider, r.case_id): r.hitk for r in got} == {("hash", "k1"): 1, ("hash", "k2"): 0, ("idf", "k1"): 1, ("idf", "k2"): 0}
    missed = next(r for r in got if r.case_id == "k2")
    assert [tuple(x) for x in missed.full_ranks] == [("B-p003-c001", 2)]


def test_page_reports(spark):
    rows = [("A", "a.pdf", i, t, s) for i, (t, s) in enumerate([("word " * 100, None), ("word " * 99, None), ("x\x01", None), ("", None), ("lost", "failed")], 1)] + [("B", "", 1, "fine", None)]
    found = pages.page_records(spark.createDataFrame(rows, "document_id string, filename string, page_number int, text string, extraction_status string"))
    problems = pages.provenance_problems(found.where("document_id = 'B'")).collect()
    assert [r.problem for r in problems] == ["missing field 'page_width'", "missing field 'page_height'", "missing field 'extraction_error'", "empty traceability field 'filename'"]
    found = found.withColumns({c: F.lit(None).cast("string") for c in ("page_width", "page_height", "extraction_error")})
    stats = {r.document_id: r for r in pages.page_statistics(found).collect()}["A"]
    assert (stats.page_count, stats.empty_pages, stats.failed_pages, stats.chars_max, stats.words_max) == (5, [4], [5], 500, 100)
    assert [tuple(x) for x in stats.control_char_pages] == [(3, 0.5)] and stats.chars_median == 2 and stats.low_text_pages == [4, 5]
    expected = spark.createDataFrame([("A", "S", 6), ("B", "S", 1), ("C", "S", 1)], "document_id string, source_sha256 string, expected_pages int")
    checks = {(r.document_id, r.name): r.status for r in pages.validation_checks(found, expected).collect()}
    assert checks["A", "page_count_matches_manifest"] == "fail" and checks["A", "empty_pages_reported"] == "warn" and checks["A", "extraction_failures"] == "fail"
    assert checks["B", "page_provenance_complete"] == "fail" and checks["C", "document_text_present"] == "fail"
    good = found.where("document_id = 'B'").withColumn("filename", F.lit("b.pdf"))
    assert pages.validation_report(good, expected.where("document_id = 'B'")).first().overall_status == "pass"
    chunks = spark.createDataFrame([("A", 1), ("A", 2)], "document_id string, n int")
    with pytest.raises(IngestionError):
        reports.ingestion_report(found, chunks, chunks.limit(1))
    with pytest.raises(IngestionError):
        reports.ingestion_report(found, chunks.withColumn("document_id", F.lit("Z")), chunks.withColumn("document_id", F.lit("Z")))
