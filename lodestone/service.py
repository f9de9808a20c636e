"""Questions over HTTP: GET /health, POST /query (an answer), POST /trace (all of its run); also `python -m lodestone.service`."""

from __future__ import annotations

import argparse
import json
import logging
import sys
import time
from collections.abc import Callable
from dataclasses import dataclass
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from typing import TYPE_CHECKING

from .errors import StageError
from .operators.records import LOG_FIELDS

if TYPE_CHECKING:
    from pyspark.sql import DataFrame

    from .operators.answer import GenerationProvider
    from .operators.embedding import EmbeddingProvider
    from .plans.run import RunStore

# Limits of a request.
DEFAULT_TOP_K, MAX_TOP_K = 5, 50


def access_line(**facts: object) -> str:
    """A line of the access log: those of the facts that a log may carry. Questions, answers and keys are none of them."""
    return json.dumps({k: facts[k] for k in LOG_FIELDS if facts.get(k) is not None}, ensure_ascii=False, default=str)


def access_log(write: Callable[[str], None] | None = None) -> Callable[..., None]:
    """A function that logs one request: to `write`, or as plain lines of this module's logger."""
    if write is None:
        lines = logging.StreamHandler()
        lines.setFormatter(logging.Formatter("%(message)s"))
        target = logging.Logger(__name__, logging.INFO)
        target.addHandler(lines)
        write = target.info
    return lambda **facts: write(access_line(level="INFO", logger=__name__, message="request", **facts))


def _number(value: object, low: int, high: int | None) -> bool:
    return isinstance(value, int) and not isinstance(value, bool) and value >= low and (high is None or value <= high)


def request_problem(body: object) -> str | None:
    """What is wrong with a query's body, or None."""
    if not isinstance(body, dict):
        return "the body must be an object"
    query, key = body.get("query"), body.get("api_key")
    if not isinstance(query, str) or not query.strip():
        return "query must be a non-blank text"
    if not _number(body.get("top_k", DEFAULT_TOP_K), 1, MAX_TOP_K):
        return f"top_k must be an integer from 1 to {MAX_TOP_K}"
    if body.get("max_chars") is not None and not _number(body["max_chars"], 1, None):
        return "max_chars must be a positive integer"
    return None if key is None or isinstance(key, str) else "api_key must be a text"


def normal_request(body: dict) -> dict:
    """query, top_k, max_chars and api_key, stripped; a blank key is none."""
    return {"query": body["query"].strip(), "top_k": body.get("top_k", DEFAULT_TOP_K), "max_chars": body.get("max_chars"), "api_key": (body.get("api_key") or "").strip() or None}


Ask = Callable[[dict], dict]


def handle(ask: Ask, body: object) -> tuple[int, dict]:
    """(HTTP status, body) of one question: 422 for a bad request, 500 where the run fails.

    Errors of the stages say what went wrong, with the message of a model's API;
    of others, which may quote data, only the kind is told.
    """
    wrong = request_problem(body)
    if wrong:
        return 422, {"detail": wrong}
    try:
        return 200, ask(normal_request(body))
    except StageError as failed:
        return 500, {"detail": f"{type(failed).__name__}: {failed}"}
    except Exception as failed:
        return 500, {"detail": type(failed).__name__}


def handle_trace(ask: Ask, body: object) -> tuple[int, dict]:
    """As `handle`, for callers that show traces: 400 for a bad request, and bodies say whether they are `ok`.

    Here top_k may also be the text of a number, as forms send it.
    """
    if isinstance(body, dict) and isinstance(body.get("top_k"), str):
        text = body["top_k"].strip()
        body = body | {"top_k": int(text) if text.lstrip("+-").isdecimal() else None}
    code, found = handle(ask, body)
    return (code, {"ok": True, "trace": found}) if code == 200 else (400 if code == 422 else code, {"ok": False, "error": found["detail"]})


@dataclass
class Questions:
    """Answers questions over one index. Each question is a run of its own, which is written once; answers and traces read it.

    `generator` gives the model for a request's key (or none); the key lives as
    long as the request.
    """

    index: DataFrame
    embedder: EmbeddingProvider
    generator: Callable[[str | None], GenerationProvider]
    runs: RunStore

    def _run(self, asked: dict) -> str:
        from .plans.run import run_queries

        queries = self.index.sparkSession.createDataFrame([("q", asked["query"])], "query_id string, query string")
        return run_queries(self.index, queries, self.embedder, self.generator(asked["api_key"]), asked["top_k"], asked["max_chars"], runs=self.runs).run_id

    def ask(self, asked: dict) -> dict:
        from .plans.run import responses

        found = responses(self.runs, self._run(asked)).drop("query_id").first().asDict(True)
        return found

    def trace(self, asked: dict) -> dict:
        from .plans.run import traces

        return traces(self.runs, self._run(asked)).drop("query_id").first().asDict(True)

    def health(self) -> dict:
        from .operators import index

        return {"status": "ok", "embedding_model": self.embedder.name} | index.summary(self.index).first().asDict()


def serve(ask: Ask, health: Callable[[], dict], host: str = "127.0.0.1", port: int = 8000, trace: Ask | None = None, log: Callable[..., None] | None = None) -> ThreadingHTTPServer:
    """A server that is not started yet."""
    log = log or access_log()
    posts = {"/query": lambda body: handle(ask, body)} | ({"/trace": lambda body: handle_trace(trace, body)} if trace else {})

    class Handler(BaseHTTPRequestHandler):
        def _respond(self, find: Callable[[], tuple[int, dict]]) -> None:
            began = time.perf_counter()
            status, body = find()
            content = json.dumps(body, ensure_ascii=False, default=str).encode()
            self.send_response(status)
            self.send_header("Content-Type", "application/json; charset=utf-8")
            self.send_header("Content-Length", str(len(content)))
            self.end_headers()
            self.wfile.write(content)
            log(method=self.command, path=self.path, status=status, duration_ms=round(1000 * (time.perf_counter() - began), 3), run_id=body.get("run_id") or (body.get("trace") or {}).get("run_id"))

        def do_GET(self) -> None:
            self._respond(lambda: (200, health()) if self.path == "/health" else (404, {"detail": "not found"}))

        def do_POST(self) -> None:
            self._respond(self._posted)

        def _posted(self) -> tuple[int, dict]:
            if self.path not in posts:
                return 404, {"detail": "not found"}
            try:
                body = json.loads(self.rfile.read(int(self.headers.get("Content-Length") or 0)))
            except ValueError:
                body = None
            return posts[self.path](body)

        def log_message(self, *args: object) -> None:
            """The access log has its own lines."""

    return ThreadingHTTPServer((host, port), Handler)


def main(argv: list[str] | None = None) -> int:
    from pyspark.sql import functions as F

    from .operators import answer, chunking, embedding, index
    from .plans.run import RunStore
    from .session import build_session
    from .sources.models import HttpTextModel
    from .staging import Staging

    options = argparse.ArgumentParser("lodestone-service", description="Questions over the pages of a Parquet table.")
    options.add_argument("pages", help="pages table (schemas.PAGES)")
    options.add_argument("--listen", default="127.0.0.1:8000", metavar="HOST:PORT")
    options.add_argument("--embedder", default="hash", choices=("hash", "e5"))
    options.add_argument("--document", help="only this document's pages")
    options.add_argument("--runs", help="shared folder that keeps the runs")
    options.add_argument("--no-model", action="store_true", help="abstain from every answer instead of calling a model")
    given = options.parse_args(argv)

    spark = build_session("lodestone-service")
    pages = spark.read.parquet(given.pages)
    chunks = chunking.chunk_pages(pages.where(F.col("document_id") == given.document) if given.document else pages)
    staging, embedder = Staging(spark, "service"), embedding.named_provider(given.embedder)
    chunks = staging.write(chunks, "chunks")
    built = staging.write(index.build_index(chunks, embedding.generate_embeddings(chunks, embedder)), "index")
    silent = answer.ScriptedProvider(lambda prompt: f"{answer.ABSTAIN} no text model is configured")
    asked = Questions(built, embedder, (lambda key: silent) if given.no_model else (lambda key: HttpTextModel(key=key)), RunStore(spark, given.runs) if given.runs else RunStore.temporary(spark))
    host, _, port = given.listen.rpartition(":")
    serve(asked.ask, asked.health, host, int(port), asked.trace).serve_forever()
    return 0


if __name__ == "__main__":
    sys.exit(main())
