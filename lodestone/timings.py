"""Rows and times of named stages, from metrics that ride on jobs which run anyway."""

from __future__ import annotations

import threading
import uuid
from dataclasses import dataclass, field

from pyspark.java_gateway import ensure_callback_server_started
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "stage string, actions int, rows long, ms double"


@dataclass
class Stage:
    """What one stage has cost: actions that read it, rows of the last one, time of all; further metrics by name."""

    actions: int = 0
    rows: int = 0
    ms: float = 0.0
    more: dict[str, object] = field(default_factory=dict)


class _Listener:
    """Spark calls it after every action of the session; one for each session, as it can't be taken back."""

    def __init__(self) -> None:
        self.open: dict[str, StageTimings] = {}

    def onSuccess(self, name: str, execution, nanoseconds: int) -> None:
        found = execution.observedMetrics().iterator() if self.open else None
        while found is not None and found.hasNext():
            pair = found.next()
            of, _, stage = pair._1().partition(":")
            if of in self.open:
                row = pair._2()
                self.open[of].add(stage, {c: row.get(i) for i, c in enumerate(row.schema().fieldNames())}, nanoseconds / 1e6)

    def onFailure(self, name: str, execution, failure) -> None:
        """A failed action has no metrics."""

    class Java:
        implements = ["org.apache.spark.sql.util.QueryExecutionListener"]


_listeners: dict[str, _Listener] = {}


def _listener(spark: SparkSession) -> _Listener:
    session = spark._jsparkSession.sessionUUID()
    if session not in _listeners:
        ensure_callback_server_started(spark.sparkContext._gateway)
        _listeners[session] = _Listener()
        spark._jsparkSession.listenerManager().register(_listeners[session])
    return _listeners[session]


class StageTimings:
    """Within it, each action on a marked table adds to its stage; no job is added.

    A stage's time is that of the whole actions that computed it: mark what is
    written, and read on from what was written. Python callbacks come through
    the session's gateway, so it needs a classic session.
    """

    def __init__(self, spark: SparkSession) -> None:
        self.spark, self._id, self._lock = spark, uuid.uuid4().hex, threading.Lock()
        self._stages: dict[str, Stage] = {}

    def add(self, stage: str, metrics: dict, ms: float) -> None:
        with self._lock:
            known = self._stages.setdefault(stage, Stage())
            known.actions, known.rows, known.ms = known.actions + 1, metrics.pop("rows"), known.ms + ms
            known.more |= metrics

    def __enter__(self) -> StageTimings:
        _listener(self.spark).open[self._id] = self
        return self

    def __exit__(self, *failure: object) -> None:
        self._drain()
        del _listener(self.spark).open[self._id]

    def _drain(self) -> None:
        self.spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()

    def mark(self, df: DataFrame, stage: str, *metrics: Column) -> DataFrame:
        """df, whose actions count for the stage; further metrics are aggregates of its rows."""
        return df.observe(f"{self._id}:{stage}", F.count(F.lit(1)).alias("rows"), *metrics)

    def __getitem__(self, stage: str) -> Stage:
        self._drain()
        with self._lock:
            return self._stages[stage]

    def table(self) -> DataFrame:
        """(stage, actions, rows, ms), in the order in which stages came."""
        self._drain()
        with self._lock:
            rows = [(name, s.actions, s.rows, s.ms) for name, s in self._stages.items()]
        return self.spark.createDataFrame(rows, SCHEMA)
