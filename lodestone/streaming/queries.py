"""Queries that arrive as a stream of JSON files, answered batch by batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from .. import schemas


def query_stream(spark: SparkSession, path: str, files_per_batch: int = 100) -> DataFrame:
    return spark.readStream.schema(schemas.QUERIES).option("maxFilesPerTrigger", files_per_batch).json(path)


def answer_stream(queries: DataFrame, answer: Callable[[DataFrame], DataFrame], out: str, checkpoint: str) -> StreamingQuery:
    """Appends `answer(batch)` for each batch once: a repeated batch replaces its own folder."""

    def each(batch: DataFrame, number: int) -> None:
        answer(batch).write.mode("overwrite").option("ignoreNullFields", "false").json(f"{out}/batch={number}")

    return queries.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
