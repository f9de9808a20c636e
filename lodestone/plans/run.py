"""Question answering end to end, for a batch of queries at once: every stage is computed once and written under the run's id."""

from __future__ import annotations

import uuid
from dataclasses import dataclass
from datetime import UTC, datetime
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import RetrievalError
from ..operators import answer, context, embedding, records, retrieval
from ..operators.calls import AnswerTable, Policy
from ..operators.embedding import EmbeddingProvider
from ..staging import Staging
from ..timings import StageTimings

#: Candidates of each query that a run keeps, at least.
KEPT_CANDIDATES = 100


class RunStore:
    """Tables of runs in a folder that all machines share. A run is there once its commit is; what failed before is not."""

    STAGES = ("vectors", "candidates", "bundles", "answers", "records", "timings")

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")

    @classmethod
    def temporary(cls, spark: SparkSession) -> RunStore:
        return cls(spark, Staging(spark, "runs").root)

    def _path(self, run_id: str, stage: str) -> str:
        if not run_id.isalnum():
            raise RetrievalError(f"a run's id has letters and digits alone, not {run_id!r}")
        return f"{self.root}/{stage}/run={run_id}"

    def write(self, run_id: str, stage: str, df: DataFrame) -> DataFrame:
        """Writes a stage and gives it back as a table; a run that is tried again replaces what it wrote."""
        df.write.mode("overwrite").parquet(self._path(run_id, stage))
        return self.spark.read.schema(df.schema).parquet(self._path(run_id, stage))

    def commit(self, run_id: str, timestamp: str, facts: dict[str, int | str | None]) -> None:
        columns = {"run_id": run_id, "timestamp": timestamp} | facts
        kinds = ", ".join(f"{c} {'long' if isinstance(v, int) else 'string'}" for c, v in columns.items())
        self.write(run_id, "commits", self.spark.createDataFrame([tuple(columns.values())], kinds))

    def commit_of(self, run_id: str) -> dict:
        """What the run's commit says; a run without one raises."""
        try:
            return self.spark.read.parquet(self._path(run_id, "commits")).first().asDict()
        except Exception as missing:
            raise RetrievalError(f"no committed run {run_id!r}") from missing

    def read(self, run_id: str, stage: str) -> DataFrame:
        self.commit_of(run_id)
        return self.spark.read.parquet(self._path(run_id, stage))


@dataclass
class Trace:
    """One run: its id and its written tables. `candidates` has the first ones of each query."""

    run_id: str
    timestamp: str
    runs: RunStore
    candidates: DataFrame
    results: DataFrame
    bundles: DataFrame
    answers: DataFrame
    records: DataFrame
    timings: DataFrame


def run_queries(
    index: DataFrame,
    queries: DataFrame,
    embedder: EmbeddingProvider,
    generator: answer.GenerationProvider,
    top_k: int = 5,
    max_chars: int | None = None,
    run_log: str | Path | None = None,
    runs: RunStore | None = None,
    answers: AnswerTable | None = None,
    policy: Policy | None = None,
    run_id: str | None = None,
    timestamp: str | None = None,
    keep: int = KEPT_CANDIDATES,
    digits: int | None = None,
) -> Trace:
    """Embeds, ranks, packs, asks and records the queries (query_id, query).

    Each stage is written under the run's id (in `runs`, or a folder of this
    application) and the next one reads it, so ranking and model calls happen
    once, however often the trace is read. `answers` may keep answers beyond the
    run. The commit is written last. A query's own run id is a digest of the
    run's and its query_id, so that a stage computed again gives the same.
    """
    spark = index.sparkSession
    runs, run_id = runs or RunStore.temporary(spark), run_id or uuid.uuid4().hex
    timestamp = timestamp or datetime.now(UTC).isoformat(timespec="microseconds")
    queries = retrieval.valid_queries(queries)
    size = index.count()
    retrieval.valid_top_k(top_k, size)
    with StageTimings(spark) as timed:
        stage = lambda name, df: runs.write(run_id, name, timed.mark(df, name))
        vectors = stage("vectors", embedding.embed_questions(embedder, queries, "query_id", "query"))
        candidates = stage("candidates", retrieval.search(index, vectors, min(size, max(top_k, keep)), digits=digits).withColumn("selected", F.col("rank") <= top_k))
        results = candidates.where("selected").drop("selected")
        bundles = stage("bundles", context.build_context(results, queries, max_chars))
        answered = stage("answers", answer.generate_answers(bundles, generator, answers, policy))
        recorded = stage("records", records.execution_records(answered, results, top_k, query_run_id(run_id), F.lit(timestamp)))
        timings = runs.write(run_id, "timings", timed.table())
    runs.commit(run_id, timestamp, {"top_k": top_k, "max_chars": str(max_chars) if max_chars is not None else None, "total_candidates": size, "embedder": embedder.name, "dimension": embedder.dimension})
    if records.log_path(run_log):
        records.append_records(recorded, run_log)
    return Trace(run_id, timestamp, runs, candidates, results, bundles, answered, recorded, timings)


def query_run_id(run_id: str) -> Column:
    """32 hexadecimal digits for each query of a run."""
    return F.md5(F.concat(F.lit(f"{run_id}:"), F.col("query_id").cast("string")).cast("binary"))


def responses(runs: RunStore, run_id: str) -> DataFrame:
    """One row for each query with what a caller is told: the record and the answer's facts, no prompt and no vector."""
    facts = runs.read(run_id, "answers").select("query_id", "attempts", "invalid_citations")
    generation = F.col("generation")
    return runs.read(run_id, "records").join(facts, "query_id").select(
        "query_id", "run_id", "timestamp", "query", generation["answer"].alias("answer"), generation["status"].alias("status"), generation["abstained"].alias("abstained"),
        generation["model"].alias("model"), "attempts", "invalid_citations", "sources", "retrieval", "context",
    )


def traces(runs: RunStore, run_id: str) -> DataFrame:
    """One row for each query with all that its run went through: retrieval_trace, context_trace, generation_trace, execution_record.

    Candidates say whether they were selected and whether the context took them.
    Times of stages that work on all queries at once are the stage's, divided by
    its queries; a model call's time is its own.
    """
    commit = runs.commit_of(run_id)
    read = lambda stage: runs.read(run_id, stage)
    took = {r["stage"]: r["ms"] for r in read("timings").collect()}  # a row for each stage
    bundles, recorded = read("bundles"), read("records")
    queries = F.lit(float(max(1, bundles.count())))
    each = lambda stage: F.lit(took.get(stage, 0.0)) / queries
    used = recorded.select("query_id", F.explode("context.chunk_ids_used").alias("chunk_id")).withColumn("passed_to_context", F.lit(True))
    marked = read("candidates").join(used, ["query_id", "chunk_id"], "left").withColumn("passed_to_context", F.coalesce("passed_to_context", F.lit(False)))
    fields = [c for c in ("rank", "chunk_id", "document_id", "document_name", "page_number", "score", "text", "selected", "passed_to_context") if c in marked.columns]
    lists = marked.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct(*fields))).alias("candidates"))
    most = F.lit(commit["max_chars"]).cast("int").alias("max_chars")
    said = read("answers").select(
        "query_id",
        F.struct(
            "provider", "model", "query", "evidence", "prompt_text", "answer", "status", (F.col("evidence_count") > 0).alias("provider_called"),
            F.struct(each("bundles").alias("context_ms"), F.col("llm_generation_ms"), (each("bundles") + F.col("llm_generation_ms")).alias("total_ms")).alias("timings"),
            "usage", "attempts", "invalid_citations",
        ).alias("generation_trace"),
    )
    record = F.struct("run_id", "timestamp", "query", "retrieval", "context", "generation", "sources")
    return (
        recorded.select("query_id", "run_id", "timestamp", "query", record.alias("execution_record"))
        .join(lists, "query_id", "left")
        .join(bundles.drop("query"), "query_id")
        .join(said, "query_id")
        .select(
            "query_id", "run_id", "timestamp", "query",
            F.struct(
                F.struct(F.lit(commit["embedder"]).alias("name"), F.lit(commit["dimension"]).alias("dimension")).alias("provider"), each("vectors").alias("embedding_ms"),
                each("candidates").alias("retrieval_ms"), F.lit(commit["top_k"]).alias("top_k"), F.lit(commit["total_candidates"]).alias("total_candidates"), "candidates",
            ).alias("retrieval_trace"),
            F.struct(
                F.size(F.filter("candidates", lambda c: c["selected"])).alias("input_retrieval_count"), "evidence_count", "documents", "evidence", most, "truncated_chunk_ids", each("bundles").alias("context_ms"),
            ).alias("context_trace"),
            "generation_trace", "execution_record",
        )
    )
