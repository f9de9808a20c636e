"""Model calls against a server that fails, throttles and counts, with tasks that die."""

import json
import os
import threading
import time
from collections import Counter
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

import pytest
from pyspark.sql import functions as F

from lodestone.errors import EmbeddingError, GenerationError
from lodestone.operators import answer, calls, embedding
from lodestone.sources import models


class Server:
    """Answers each prompt; some are refused at first, some always. Counts answers by prompt."""

    def __init__(self):
        self.answered, self.refused, self.keys, self.times = Counter(), Counter(), set(), []
        outer = self

        class Handler(BaseHTTPRequestHandler):
            def do_POST(self):
                body = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
                outer.keys.add(self.headers[models.KEY_HEADER])
                outer.times.append(time.monotonic())
                if "requests" in body:
                    texts = [r["content"]["parts"][0]["text"] for r in body["requests"]]
                    kinds = {r["taskType"] for r in body["requests"]}
                    if outer.refused["embed"] == 0:
                        outer.refused["embed"] += 1
                        return self.send(429, {"error": {"message": "quota"}})
                    for t in texts:
                        outer.answered[t, min(kinds)] += 1
                    return self.send(200, {"embeddings": [{"values": [float(len(t)), 1.0]} for t in texts]})
                text = body["contents"][0]["parts"][0]["text"]
                if "never" in text:
                    return self.send(403, {"error": {"message": "no access to this"}})
                if ("busy" in text and outer.refused[text] < 1) or ("later" in text and outer.refused[text] < 1):
                    outer.refused[text] += 1
                    return self.send(429 if "later" in text else 503, {"error": {"message": "wait"}}, {"Retry-After": "0.05"} if "later" in text else {})
                outer.answered[text] += 1
                return self.send(200, {"candidates": [{"content": {"parts": [{"text": " said " + text.split()[-1]}]}}], "usageMetadata": {"total": len(text)}})

            def send(self, code, body, headers=()):
                data = json.dumps(body).encode()
                self.send_response(code)
                for k, v in dict(headers).items():
                    self.send_header(k, v)
                self.send_header("Content-Length", str(len(data)))
                self.end_headers()
                self.wfile.write(data)

            def log_message(self, *args):
                pass

        self.http = ThreadingHTTPServer(("127.0.0.1", 0), Handler)
        threading.Thread(target=self.http.serve_forever, daemon=True).start()
        self.root = f"http://127.0.0.1:{self.http.server_port}"

    def model(self, **more):
        return models.HttpTextModel("m/1", key="k3y", root=self.root, backoff_s=0.01, **more)


@pytest.fixture
def server():
    made = Server()
    yield made
    made.http.shutdown()


PROMPTS = [f"{kind} {i}" for kind in ("plain", "busy", "later") for i in range(8)]


def prompts(spark, texts=PROMPTS):
    return spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "n int, prompt string").repartition(3)


def test_each_prompt_is_answered_once(spark, server, tmp_path):
    table = calls.AnswerTable(spark, str(tmp_path / "answers"))
    rows = prompts(spark, [*PROMPTS, *PROMPTS, None])
    found = table.with_answers(rows, "prompt", answer.Prompts(server.model()), calls.Policy(concurrency=3, tasks=2))
    got = found.collect() + found.collect()  # reading again calls nobody
    assert len(got) == 2 * (2 * len(PROMPTS) + 1)
    assert all(json.loads(r.answer)["text"] == "said " + r.prompt.split()[-1] for r in got if r.prompt)
    assert {r.prompt: r.attempts for r in got if r.prompt}["busy 1"] == 2 and all(r.answer is None for r in got if r.prompt is None)
    assert server.answered == {p: 1 for p in PROMPTS} and server.keys == {"k3y"}
    again = calls.AnswerTable(spark, str(tmp_path / "answers")).with_answers(prompts(spark, [*PROMPTS, "plain 99"]), "prompt", answer.Prompts(server.model()))
    assert again.where("answer IS NOT NULL").count() == len(PROMPTS) + 1
    assert server.answered == {p: 1 for p in [*PROMPTS, "plain 99"]}
    other = answer.Prompts(models.HttpTextModel("m2", key="k", root=server.root))
    table.with_answers(prompts(spark, ["plain 1"]), "prompt", other)
    assert server.answered["plain 1"] == 2  # another model is another request


def test_failures_are_told_and_the_rest_is_kept(spark, server, tmp_path):
    table = calls.AnswerTable(spark, str(tmp_path / "answers"))
    with pytest.raises(GenerationError) as failed:
        table.with_answers(prompts(spark, ["plain 1", "never 2", "plain 3"]), "prompt", answer.Prompts(server.model()))
    assert "no access to this" in str(failed.value) and "k3y" not in str(failed.value)
    assert (failed.value.status, failed.value.attempts) == (403, 1)
    assert table.known().count() == 2 and server.answered == {"plain 1": 1, "plain 3": 1}


class Dying:
    """Kills its worker after some answers, once for each folder."""

    batch, identity = 1, "dying"

    def __init__(self, model, flag, after):
        self.model, self.flag, self.after = model, flag, after

    def call(self, requests, timeout):
        found = [self.model.generate(r, timeout) for r in requests]
        with open(self.flag, "a") as f:
            f.write(".")
        if os.path.getsize(self.flag) == self.after:
            os._exit(1)
        return found


def test_a_lost_worker_repeats_no_answer_it_wrote_down(spark, server, tmp_path):
    table, flag = calls.AnswerTable(spark, str(tmp_path / "answers")), str(tmp_path / "flag")
    caller = Dying(server.model(), flag, 9)
    one = calls.Policy(concurrency=1, tasks=1)
    with pytest.raises(Exception):  # noqa: B017  Spark's own error: the worker is gone, and a local session tries a task once
        table.with_answers(prompts(spark), "prompt", caller, one)
    assert not table.journal.empty() and sum(server.answered.values()) == 9
    found = table.with_answers(prompts(spark), "prompt", caller, one)
    assert found.where("answer IS NULL").count() == 0
    # the ninth was given and lost with the worker before it could be written down; all others came once
    assert sorted(server.answered.values()) == [1] * (len(PROMPTS) - 1) + [2]
    assert table.journal.empty()


def test_a_task_reads_what_its_predecessor_wrote(tmp_path):
    import pyarrow as pa

    class Once:
        batch, identity, asked = 2, "once", []

        def call(self, requests, timeout):
            self.asked.extend(requests)
            return [{"text": r} for r in requests]

    journal, caller = calls.Journal(str(tmp_path / "journal")), Once()
    journal.put({"key": "aa", "answer": '{"text": "old"}', "attempts": 1, "ms": 1.0, "error": None, "status": None})
    (tmp_path / "journal" / "bb").mkdir()
    (tmp_path / "journal" / "bb" / "bb.json").write_text('{"key": "bb", "ans')  # cut off
    batch = pa.RecordBatch.from_pydict({"key": ["aa", "bb", "cc", "dd"], "request": ["a", "b", "c", "d"]})
    rows = [r for out in calls._answering(caller, calls.Policy(concurrency=1), journal)(iter([batch])) for r in out.to_pylist()]
    assert {r["key"]: json.loads(r["answer"])["text"] for r in rows} == {"aa": "old", "bb": "b", "cc": "c", "dd": "d"}
    assert sorted(caller.asked) == ["b", "c", "d"]


def test_pace_is_shared(spark, server, tmp_path):
    table = calls.AnswerTable(spark, str(tmp_path / "answers"))
    table.with_answers(prompts(spark, [f"plain {i}" for i in range(12)]), "prompt", answer.Prompts(server.model()), calls.Policy(concurrency=4, tasks=1, per_minute=1200))
    gaps = sorted(server.times)
    assert gaps[-1] - gaps[0] >= 11 * 0.05 * 0.9
    with pytest.raises(GenerationError):
        calls.Policy(concurrency=0)
    with pytest.raises(GenerationError):
        calls.Policy(per_minute=-1.0)


def test_embeddings_by_task(spark, server, tmp_path):
    make = lambda task: models.HttpEmbeddingModel(task, key="k", root=server.root, batch=2, backoff_s=0.0, gap_s=0.0)
    table = calls.AnswerTable(spark, str(tmp_path / "answers"))
    provider = embedding.RemoteProvider("remote", 2, make(models.DOCUMENT_TASK), make(models.QUERY_TASK), table, calls.Policy(tasks=1, concurrency=1))
    texts = spark.createDataFrame([("a", "one"), ("b", "three"), ("c", "one")], "chunk_id string, text string")
    got = {r.chunk_id: r.vector for r in provider.embed(texts, "chunk_id", "text").collect()}
    assert got == {"a": [3.0, 1.0], "b": [5.0, 1.0], "c": [3.0, 1.0]}
    asked = embedding.embed_questions(provider, texts.where("chunk_id = 'a'"), "chunk_id", "text")
    assert asked.first().vector == [3.0, 1.0]
    assert server.answered == {("one", models.DOCUMENT_TASK): 1, ("three", models.DOCUMENT_TASK): 1, ("one", models.QUERY_TASK): 1}
    assert provider.params()["external"] and provider.params()["batch_size"] == 2
    with pytest.raises(EmbeddingError):
        provider.embed(texts.withColumn("text", F.lit(" ")), "chunk_id", "text")


def test_keys(monkeypatch, tmp_path):
    monkeypatch.delenv(models.KEY_VARIABLE, raising=False)
    with pytest.raises(GenerationError):
        models.api_key("  ")
    (tmp_path / ".env").write_text(f"OTHER=1\n{models.KEY_VARIABLE}='from file'\n")
    assert models.api_key(None, tmp_path / ".env") == "from file"
    monkeypatch.setenv(models.KEY_VARIABLE, " from environment ")
    assert models.api_key(None, tmp_path / ".env") == "from environment" and models.api_key(" given ") == "given"
    assert "given" not in repr(models.HttpTextModel(key="given"))


def test_attempts_and_waits():
    waits, tried = [], []

    def call(status, wait=None):
        def once():
            tried.append(status)
            if len(tried) < 3:
                failed = GenerationError("busy", status)
                failed.wait_s = wait
                raise failed
            return "got"

        return once

    assert calls.attempted(call(503), 3, 1.0, sleep=waits.append) == ("got", 3) and waits == [1.0, 2.0]
    tried.clear()
    assert calls.attempted(call(429, 7.0), 3, 1.0, sleep=waits.append) == ("got", 3) and waits[2:] == [7.0, 7.0]
    tried.clear()
    with pytest.raises(GenerationError) as failed:
        calls.attempted(call(400), 3, 1.0, sleep=waits.append)
    assert failed.value.attempts == 1 and len(tried) == 1
    assert calls.retryable(429) and calls.retryable(500) and not any(map(calls.retryable, (404, 401, None, True, "429")))


def test_responses_of_models():
    assert answer.parse_response({"candidates": [{"content": {"parts": [{"text": "a"}, "b", {}, 5]}}], "usageMetadata": 5}) == {"text": "ab", "usage": {"raw": 5}}
    assert answer.parse_response({"text": "t", "usage": {"n": 1}}) == {"text": "t", "usage": {"n": 1}}
    for bad in ({}, {"candidates": []}, {"candidates": [5]}, {"candidates": [{"content": {"parts": []}}]}, {"candidates": [{"content": {"parts": [{"text": " "}]}}]}):
        with pytest.raises(GenerationError):
            answer.parse_response(bad)
    assert answer.usage(None) == {} and answer.attempts(True) == 1 and answer.attempts(0) == 1 and answer.attempts(4) == 4


def test_server_errors(server):
    with pytest.raises(GenerationError) as failed:
        models.post_json(server.root, {"contents": [{"parts": [{"text": "never x"}]}]}, 5.0, "k3y")
    assert failed.value.status == 403 and "no access" in str(failed.value)
    with pytest.raises(GenerationError) as failed:
        models.post_json("http://127.0.0.1:9", {}, 0.5, "k3y")
    assert failed.value.status is None
    with pytest.raises(GenerationError):
        server.model(max_attempts=True)
    with pytest.raises(GenerationError):
        server.model().generate(" ")
