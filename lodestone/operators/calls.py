"""Calls of metered models for whole tables: each distinct request is answered once, whatever is lost on the way.

Requests are keyed by a digest of model, parameters and text. Answers are rows
of a written table. While a job runs, every answer is also an entry of a journal
in the same folder, so that a task that is run again finds what its predecessor
was given; a job that died leaves its journal to the next one.
"""

from __future__ import annotations

import json
import threading
import time
import uuid
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from typing import Protocol, TypeVar

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import checks
from ..errors import GenerationError, StageError
from ..staging import Staging

Result = TypeVar("Result")
#: Requests that a task looks up in the journal, and hands to its threads, at a time.
AT_ONCE = 256
_SCHEMA = "key string, answer string, attempts int, ms double, error string, status int"
_ARROW = pa.schema([("key", pa.string()), ("answer", pa.string()), ("attempts", pa.int32()), ("ms", pa.float64()), ("error", pa.string()), ("status", pa.int32())])


def retryable(code: object) -> bool:
    """429 and 5xx; nothing else, and no status at all is none."""
    return isinstance(code, int) and not isinstance(code, bool) and (code == 429 or 500 <= code <= 599)


def attempted(call: Callable[[], Result], most: int, backoff_s: float, growth: float = 2.0, sleep: Callable[[float], None] = time.sleep, again: Callable[[object], bool] = retryable) -> tuple[Result, int]:
    """The call's result and how many attempts it took.

    What fails with a status that `again` allows is tried up to `most` times in
    all, after waits that grow, or longer where the server names a time
    (`wait_s` of the error). Errors that leave carry their attempts.
    """
    for attempt in range(1, most + 1):
        try:
            return call(), attempt
        except Exception as failed:
            failed.attempts = attempt  # type: ignore[attr-defined]
            if attempt == most or not again(getattr(failed, "status", None)):
                raise
            sleep(max(backoff_s * growth ** (attempt - 1), getattr(failed, "wait_s", None) or 0.0))
    raise AssertionError


@dataclass(frozen=True)
class Policy:
    """How hard a model may be called: calls in flight in one task, tasks, and calls a minute of all tasks together (0: any)."""

    concurrency: int = 4
    tasks: int = 8
    per_minute: float = 0.0
    timeout_s: float = 60.0

    def __post_init__(self) -> None:
        checks.positive_int(self.concurrency, "concurrency", GenerationError)
        checks.positive_int(self.tasks, "tasks", GenerationError)
        if self.per_minute < 0 or self.timeout_s <= 0:
            raise GenerationError("per_minute must not be negative, timeout_s must be positive")


class Caller(Protocol):
    """A model as a function of up to `batch` requests; must be picklable. Each result can be written as JSON."""

    identity: str
    batch: int

    def call(self, requests: list[str], timeout: float) -> list[dict]: ...


class Pace:
    """Lets calls begin at even distances, whatever thread they come from."""

    def __init__(self, seconds: float, clock: Callable[[], float] = time.monotonic, sleep: Callable[[float], None] = time.sleep) -> None:
        self.seconds, self.clock, self.sleep = seconds, clock, sleep
        self.lock, self.next = threading.Lock(), 0.0

    def wait(self) -> None:
        if not self.seconds:
            return
        with self.lock:
            begins = max(self.clock(), self.next)
            self.next = begins + self.seconds
        self.sleep(max(0.0, begins - self.clock()))


class Journal:
    """One small file for each answer, in a folder that all machines share."""

    def __init__(self, uri: str) -> None:
        self.uri = uri

    def _open(self) -> tuple[pafs.FileSystem, str]:
        return pafs.FileSystem.from_uri(self.uri) if "://" in self.uri else (pafs.LocalFileSystem(), self.uri)

    def found(self, keys: list[str]) -> dict[str, dict]:
        """The entries of these keys; a file that was cut off while it was written is none."""
        fs, root = self._open()
        known = {}
        for key, info in zip(keys, fs.get_file_info([f"{root}/{k[:2]}/{k}.json" for k in keys]), strict=True):
            if info.type == pafs.FileType.File:
                with fs.open_input_stream(info.path) as file:
                    try:
                        known[key] = json.loads(file.read())
                    except ValueError:
                        continue
        return known

    def put(self, entry: dict) -> None:
        fs, root = self._open()
        folder = f"{root}/{entry['key'][:2]}"
        fs.create_dir(folder, recursive=True)
        with fs.open_output_stream(f"{folder}/{entry['key']}.json") as file:
            file.write(json.dumps(entry).encode())

    def empty(self) -> bool:
        fs, root = self._open()
        return not any(f.type == pafs.FileType.File for f in fs.get_file_info(pafs.FileSelector(root, allow_not_found=True, recursive=True)))

    def clear(self) -> None:
        fs, root = self._open()
        fs.delete_dir_contents(root, missing_dir_ok=True)


def _answering(caller: Caller, policy: Policy, journal: Journal):
    """A task that answers its requests, some at a time; what fails becomes a row with the error."""

    def ask(pairs: list[tuple[str, str]], pace: Pace) -> list[dict]:
        pace.wait()
        began = time.perf_counter()
        try:
            results = caller.call([request for _, request in pairs], policy.timeout_s)
            if len(results) != len(pairs):
                raise GenerationError(f"{len(pairs)} requests got {len(results)} results")
        except Exception as failed:
            wrong = {"answer": None, "attempts": getattr(failed, "attempts", None) or 1, "ms": 1000 * (time.perf_counter() - began), "error": f"{type(failed).__name__}: {failed}", "status": getattr(failed, "status", None)}
            return [{"key": key} | wrong for key, _ in pairs]
        ms = 1000 * (time.perf_counter() - began) / len(pairs)
        entries = [{"key": key, "answer": json.dumps(result), "attempts": max(1, result.get("attempts") or 1), "ms": ms, "error": None, "status": None} for (key, _), result in zip(pairs, results, strict=True)]
        for entry in entries:
            journal.put(entry)
        return entries

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pace = Pace(60.0 * policy.tasks / policy.per_minute if policy.per_minute else 0.0)
        with ThreadPoolExecutor(policy.concurrency) as pool:
            for batch in batches:
                pairs = list(zip(batch.column("key").to_pylist(), batch.column("request").to_pylist(), strict=True))
                for i in range(0, len(pairs), AT_ONCE):
                    some = pairs[i : i + AT_ONCE]
                    known = journal.found([key for key, _ in some])
                    new = [p for p in some if p[0] not in known]
                    groups = [new[j : j + caller.batch] for j in range(0, len(new), caller.batch)]
                    rows = [*known.values(), *(e for group in pool.map(lambda g: ask(g, pace), groups) for e in group)]
                    yield pa.RecordBatch.from_pylist(rows, schema=_ARROW)

    return run


class AnswerTable:
    """Answers of models in a folder that all machines share; one driver writes to it at a time."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")
        self.journal = Journal(f"{self.root}/journal")

    @classmethod
    def temporary(cls, spark: SparkSession) -> AnswerTable:
        """A table for this application alone."""
        return cls(spark, Staging(spark, "answers").root)

    def _rows(self) -> DataFrame:
        fs, path = self.journal._open()
        there = fs.get_file_info(f"{path.removesuffix('/journal')}/answers").type == pafs.FileType.Directory
        schema = f"{_SCHEMA}, job string"
        return self.spark.read.schema(schema).parquet(f"{self.root}/answers") if there else self.spark.createDataFrame([], schema)

    def known(self) -> DataFrame:
        """(key, answer, attempts, ms): one row for each request that was answered."""
        return self._rows().where("error IS NULL").select("key", "answer", "attempts", "ms").dropDuplicates(["key"])

    def recover(self) -> None:
        """Takes over what a job that died had been given."""
        if not self.journal.empty():
            left = self.spark.read.schema(_SCHEMA).option("recursiveFileLookup", "true").json(self.journal.uri).where("answer IS NOT NULL")
            left.withColumn("job", F.lit("recovered")).write.mode("append").parquet(f"{self.root}/answers")
            self.journal.clear()

    def with_answers(self, rows: DataFrame, request: str, caller: Caller, policy: Policy | None = None, error: type[StageError] = GenerationError) -> DataFrame:
        """rows with answer (JSON), attempts and ms of the request in a column; null requests stay without.

        Requests that the table knows are not made again, and equal ones are made
        once. All that can be answered is written before a failure raises.
        """
        policy = policy or Policy()
        self.recover()
        key = call_key(F.col(request), caller.identity)
        asked = rows.where(F.col(request).isNotNull()).select(key.alias("key"), F.col(request).alias("request")).dropDuplicates(["key"])
        new = asked.join(self.known().select("key"), "key", "left_anti").repartition(policy.tasks, "key")
        job = uuid.uuid4().hex
        new.mapInArrow(_answering(caller, policy, self.journal), _SCHEMA).withColumn("job", F.lit(job)).write.mode("append").parquet(f"{self.root}/answers")
        self.journal.clear()
        failed = self._rows().where((F.col("job") == job) & F.col("error").isNotNull()).select("error", "status", "attempts").limit(10).collect()
        if failed:
            raise_failed(failed, error)
        answers = self.known().withColumnRenamed("key", "__key")
        return rows.withColumn("__key", key).join(answers, "__key", "left").drop("__key")


def raise_failed(failed: list, error: type[StageError]) -> None:
    problem = error("; ".join(dict.fromkeys(r["error"] for r in failed)))
    problem.status, problem.attempts = failed[0]["status"], failed[0]["attempts"]  # type: ignore[attr-defined]
    raise problem


def call_key(request: Column, identity: str) -> Column:
    """The digest by which a request to a model is known."""
    return F.sha2(F.concat(F.lit(f"{len(identity)}:{identity}:"), request), 256)
