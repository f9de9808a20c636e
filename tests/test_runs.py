"""One run, one computation: what runs write, and who reads it."""

import json
import threading
import urllib.request

import pytest
from pyspark.sql import functions as F

from lodestone import service
from lodestone.errors import GenerationError, RetrievalError
from lodestone.operators import answer, embedding, index
from lodestone.plans.run import RunStore, query_run_id, responses, run_queries, traces
from lodestone.timings import StageTimings


@pytest.fixture(scope="module")
def built(spark):
    rows = [(f"A-p00{i}-c001", "A", i, t) for i, t in enumerate(["sugar levels and diet", "insulin dose by weight", "sleep and exercise", "diet and sleep"], 1)]
    chunks = spark.createDataFrame(rows, "chunk_id string, document_id string, page_number int, text string")
    provider = embedding.HashProvider(64)
    return index.build_index(chunks, embedding.generate_embeddings(chunks, provider)).cache(), provider


class Counting:
    """A provider that notes every call in a file, as workers are other processes."""

    name, model = "counting", "c-1"

    def __init__(self, path, said="yes, see EVIDENCE_ITEM_RANK: 1"):
        self.path, self.said = str(path), said

    def generate(self, prompt, timeout=60.0):
        with open(self.path, "a") as f:
            f.write("x")
        return {"text": self.said, "usage": {"n": 1}, "attempts": 2}


def asked(spark, n=1):
    return spark.createDataFrame([(f"q{i}", f"diet and sleep {i}") for i in range(n)], "query_id string, query string")


def test_one_call_however_often_a_run_is_read(spark, built, tmp_path):
    store = RunStore(spark, str(tmp_path / "runs"))
    run = run_queries(built[0], asked(spark, 3), built[1], Counting(tmp_path / "n"), 2, runs=store, run_log=tmp_path / "log", run_id="r1", timestamp="then")
    for _ in range(2):
        found = {r.query_id: r for r in responses(store, "r1").collect()}
        traced = {r.query_id: r for r in traces(store, "r1").collect()}
    assert (tmp_path / "n").read_text() == "xxx"
    assert sorted(found) == ["q0", "q1", "q2"] and run.answers.count() == 3
    one = found["q1"]
    ids = {r.query_id: r.i for r in run.records.select("query_id", query_run_id("r1").alias("i")).collect()}
    assert one.run_id == ids["q1"] and len(one.run_id) == 32 and one.timestamp == "then"
    assert (one.answer, one.status, one.abstained, one.model, one.attempts, one.invalid_citations) == ("yes, see EVIDENCE_ITEM_RANK: 1", "ok", False, "c-1", 2, [])
    assert one.retrieval.top_k == 2 and len(one.retrieval.chunks) == 2 and len(one.sources) == len(one.context.chunk_ids_used)
    trace = traced["q1"]
    assert trace.execution_record.run_id == one.run_id and trace.execution_record.generation.answer == one.answer
    assert [c.selected for c in trace.retrieval_trace.candidates] == [True, True, False, False] and trace.retrieval_trace.total_candidates == 4
    assert {c.chunk_id for c in trace.retrieval_trace.candidates if c.passed_to_context} == set(one.context.chunk_ids_used)
    assert trace.generation_trace.provider_called and trace.generation_trace.timings.llm_generation_ms > 0 and "EVIDENCE" in trace.generation_trace.prompt_text
    assert trace.context_trace.input_retrieval_count == 2 and trace.context_trace.context_ms > 0 and trace.retrieval_trace.embedding_ms > 0
    logged = [json.loads(line) for p in (tmp_path / "log").glob("*.json") for line in p.read_text().splitlines()]
    assert {r["run_id"] for r in logged} == {r.run_id for r in found.values()}
    stages = {r.stage: (r.rows, r.ms) for r in run.timings.collect()}
    assert [stages[s][0] for s in ("vectors", "candidates", "bundles", "answers", "records")] == [3, 12, 3, 3, 3] and all(ms > 0 for _, ms in stages.values())


def test_runs_without_commit_are_not_there(spark, built, tmp_path):
    store = RunStore(spark, str(tmp_path / "runs"))
    with pytest.raises(GenerationError):
        run_queries(built[0], asked(spark), built[1], Counting(tmp_path / "n", " "), 1, runs=store, run_id="bad")
    with pytest.raises(RetrievalError):
        responses(store, "bad")
    with pytest.raises(RetrievalError):
        store.read("../x", "records")
    run_queries(built[0], asked(spark), built[1], Counting(tmp_path / "n"), 1, runs=store, run_id="bad")
    assert responses(store, "bad").count() == 1


def test_timings_add_no_job(spark):
    df = spark.range(100).withColumn("v", F.col("id") % 7)

    def ids():
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
        return spark.sparkContext.statusTracker().getJobIdsForGroup()

    with StageTimings(spark) as timed:
        before = len(ids())
        df.groupBy("v").count().collect()
        plain = len(ids()) - before
        before = len(ids())
        timed.mark(df, "read", F.max("id").alias("top")).groupBy("v").count().collect()
        assert len(ids()) - before == plain
        assert (timed["read"].rows, timed["read"].actions, timed["read"].more) == (100, 1, {"top": 99}) and timed["read"].ms > 0
        timed.mark(df.where("v = 1"), "odd").count()
        timed.mark(df.where("v = 1"), "odd").count()
    assert [(r.stage, r.actions, r.rows) for r in timed.table().collect()] == [("read", 1, 100), ("odd", 2, 15)]
    timed.mark(df, "after").count()
    assert len(timed.table().collect()) == 2


def test_service_runs_once_and_forgets_keys(spark, built, tmp_path):
    keys, lines = [], []

    def generator(key):
        keys.append(key)
        return Counting(tmp_path / "n")

    asking = service.Questions(built[0], built[1], generator, RunStore(spark, str(tmp_path / "runs")))
    server = service.serve(asking.ask, asking.health, port=0, trace=asking.trace, log=lambda **f: lines.append(service.access_line(**f)))
    threading.Thread(target=server.serve_forever, daemon=True).start()

    def call(path, body=None):
        data = None if body is None else json.dumps(body).encode()
        try:
            with urllib.request.urlopen(urllib.request.Request(f"http://127.0.0.1:{server.server_port}{path}", data=data)) as r:
                return r.status, json.load(r)
        except urllib.error.HTTPError as e:
            return e.code, json.load(e)

    code, found = call("/query", {"query": " diet ", "top_k": 2, "api_key": " s3cret "})
    assert code == 200 and set(found) == {"run_id", "timestamp", "query", "answer", "status", "abstained", "model", "attempts", "invalid_citations", "sources", "retrieval", "context"}
    assert found["query"] == "diet" and found["abstained"] is False and len(found["retrieval"]["chunks"]) == 2
    assert (tmp_path / "n").read_text() == "x" and keys == ["s3cret"]
    code, traced = call("/trace", {"query": "diet", "top_k": "1", "api_key": " "})
    assert code == 200 and traced["ok"] and traced["trace"]["retrieval_trace"]["top_k"] == 1 and keys[1] is None
    for bad in ({"query": " "}, {"query": "x", "top_k": "many"}, {"query": "x", "top_k": 51}):
        code, wrong = call("/trace", bad)
        assert code == 400 and wrong["ok"] is False and wrong["error"]
    assert call("/health")[1] == {"status": "ok", "embedding_model": built[1].name, "document_count": 1, "chunk_count": 4}
    asking.generator = lambda key: Counting(tmp_path / "n", " ")
    code, failed = call("/query", {"query": "diet", "top_k": 1})
    assert code == 500 and "empty response" in failed["detail"]
    server.shutdown()
    logged = [json.loads(line) for line in lines]
    assert [x["status"] for x in logged] == [200, 200, 400, 400, 400, 200, 500] and logged[0]["run_id"] == found["run_id"]
    assert "diet" not in "".join(lines) and "s3cret" not in "".join(lines)
    stored = "".join(p.read_text(errors="replace") for p in (tmp_path / "runs").rglob("*") if p.is_file())
    assert "s3cret" not in stored
