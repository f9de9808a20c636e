"""Text and embedding models behind JSON over HTTP. Keys travel in a header alone, and are in no message."""

from __future__ import annotations

import json
import os
import time
import urllib.error
import urllib.parse
import urllib.request
from collections.abc import Callable
from pathlib import Path

from .. import checks
from ..errors import EmbeddingError, GenerationError, StageError
from ..operators.answer import parse_response
from ..operators.calls import attempted
from .files import env_value

# The public API's address, paths, header and default models, and the variable that names the key.
API_ROOT = "https://generativelanguage.googleapis.com"
GENERATE, EMBED = "/v1beta/models/{model}:generateContent", "/v1beta/models/{model}:batchEmbedContents"
KEY_HEADER, KEY_VARIABLE = "x-goog-api-key", "GOOGLE_API_KEY"
TEXT_MODEL, EMBEDDING_MODEL, EMBEDDING_DIMENSION = "gemini-2.5-flash", "gemini-embedding-001", 3072
DOCUMENT_TASK, QUERY_TASK = "RETRIEVAL_DOCUMENT", "RETRIEVAL_QUERY"

Post = Callable[[str, dict, float, str], dict]


def api_key(given: str | None = None, env_file: str | Path | None = None, error: type[StageError] = GenerationError) -> str:
    """The given key, else the environment's, else that of an environment file; blank counts as none."""
    found = (given or "").strip() or os.environ.get(KEY_VARIABLE, "").strip()
    if not found and env_file is not None and Path(env_file).is_file():
        found = env_value(Path(env_file).read_text(encoding="utf-8"), KEY_VARIABLE) or ""
    if not found:
        raise error(f"{KEY_VARIABLE} is absent or empty")
    return found


def post_json(url: str, body: dict, timeout: float, key: str) -> dict:
    """The JSON object that a POST gives; errors carry the status, the API's own message and the wait it asks for."""
    asked = urllib.request.Request(url, json.dumps(body).encode(), {"Content-Type": "application/json", KEY_HEADER: key}, method="POST")
    try:
        with urllib.request.urlopen(asked, timeout=timeout) as response:
            content = response.read()
    except urllib.error.HTTPError as refused:
        raise _refusal(refused) from None
    except OSError as failed:
        raise GenerationError(f"request failed: {type(failed).__name__}") from None
    try:
        found = json.loads(content)
    except ValueError:
        raise GenerationError("the response is not JSON") from None
    if not isinstance(found, dict):
        raise GenerationError("the response is not a JSON object")
    return found


def _refusal(refused: urllib.error.HTTPError) -> GenerationError:
    try:
        said = json.loads(refused.read())["error"]["message"]
    except (ValueError, KeyError, TypeError, OSError):
        said = None
    problem = GenerationError(f"the model's server answered {refused.code}" + (f": {said}" if said else ""), status=refused.code)
    try:
        problem.wait_s = float(refused.headers.get("Retry-After"))
    except (TypeError, ValueError):
        problem.wait_s = None
    return problem


def _url(root: str, path: str, model: str) -> str:
    return root.rstrip("/") + path.format(model=urllib.parse.quote(model, safe=""))


class HttpTextModel:
    """A text model; retried on 429 and 5xx with doubling waits, or those that the server names."""

    name = "http"

    def __init__(self, model: str = TEXT_MODEL, key: str | None = None, root: str = API_ROOT, max_attempts: int = 3, backoff_s: float = 1.0, post: Post = post_json, sleep: Callable[[float], None] = time.sleep) -> None:
        checks.positive_int(max_attempts, "max_attempts", GenerationError)
        if isinstance(backoff_s, bool) or not isinstance(backoff_s, (int, float)) or backoff_s < 0:
            raise GenerationError("backoff_s must not be negative")
        self.model, self.root, self.max_attempts, self.backoff_s, self._post, self._sleep = model, root, max_attempts, float(backoff_s), post, sleep
        self._key = api_key(key)

    def __repr__(self) -> str:
        return f"{type(self).__name__}({self.model!r})"

    def generate(self, prompt: str, timeout: float = 60.0) -> dict:
        if not isinstance(prompt, str) or not prompt.strip():
            raise GenerationError("the prompt must be a non-blank text")
        if timeout <= 0:
            raise GenerationError("the timeout must be positive")
        body = {"contents": [{"parts": [{"text": prompt}]}]}
        found, attempts = attempted(lambda: self._post(_url(self.root, GENERATE, self.model), body, timeout, self._key), self.max_attempts, self.backoff_s, sleep=self._sleep)
        try:
            return parse_response(found) | {"attempts": attempts}
        except GenerationError as failed:
            failed.attempts = attempts
            raise


class HttpEmbeddingModel:
    """A model of vectors for one kind of task; only 429 is retried, after waits of one length, and calls keep a distance."""

    def __init__(self, task: str, model: str = EMBEDDING_MODEL, key: str | None = None, root: str = API_ROOT, batch: int = 32, retries: int = 5, backoff_s: float = 65.0, gap_s: float = 2.0, env_file: str | None = ".env", post: Post = post_json, sleep: Callable[[float], None] = time.sleep) -> None:
        checks.positive_int(batch, "batch", EmbeddingError)
        self.task, self.model, self.root, self.batch, self.retries, self.backoff_s, self.gap_s, self._post, self._sleep = task, model, root, batch, retries, backoff_s, gap_s, post, sleep
        self._key = api_key(key, env_file, EmbeddingError)
        self.identity = f"{model}/{task}"

    def __repr__(self) -> str:
        return f"{type(self).__name__}({self.identity!r})"

    def call(self, requests: list[str], timeout: float) -> list[dict]:
        name = f"models/{self.model}"
        body = {"requests": [{"model": name, "content": {"parts": [{"text": t}]}, "taskType": self.task} for t in requests]}
        found, attempts = attempted(lambda: self._post(_url(self.root, EMBED, self.model), body, timeout, self._key), self.retries + 1, self.backoff_s, 1.0, self._sleep, lambda status: status == 429)
        self._sleep(self.gap_s)
        vectors = found.get("embeddings")
        if not isinstance(vectors, list) or len(vectors) != len(requests):
            raise EmbeddingError("the response has more or fewer vectors than texts")
        values = [v.get("values") if isinstance(v, dict) else None for v in vectors]
        if not all(isinstance(v, list) and v for v in values):
            raise EmbeddingError("a vector of the response has no values")
        return [{"vector": [float(x) for x in v], "attempts": attempts} for v in values]
