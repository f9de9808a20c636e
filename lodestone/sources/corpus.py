"""Corpora of written artifacts: pages are chunked again and joined with their vectors into one checked index."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas
from ..errors import RetrievalError
from ..operators import chunking, embedding, evaluation
from ..operators import index as idx
from ..staging import Staging
from . import files

_VECTORS = schemas.EMBEDDINGS + ", model_name string, corpus_version string"


@dataclass
class Corpus:
    """An index, the provider that embeds questions for it, and the chunks it is of."""

    index: DataFrame
    embedder: embedding.EmbeddingProvider
    chunks: DataFrame


def model_of(vectors: DataFrame, providers: dict[str, embedding.EmbeddingProvider]) -> embedding.EmbeddingProvider:
    """The provider of the one model that all artifacts name; models are names of folders, so no vector is read."""
    return providers[idx.single_model(vectors.select("model_name").distinct(), tuple(providers))]


def load_corpus(spark: SparkSession, root: str, corpus_version: str, providers: dict[str, embedding.EmbeddingProvider] | None = None, document_id: str | None = None, catalog: DataFrame | None = None) -> Corpus:
    """The corpus that an ingestion with vectors has written under `root`, or one document of it.

    Chunks are cut from the pages anew, so an index never mixes texts and
    vectors of different chunkings: ids must agree one to one. All vectors must
    be of one model, one that `providers` (by name; hash where absent) has. Only
    the version's, and the document's, folders are read.
    """
    if providers is None:
        known = embedding.HashProvider()
        providers = {known.name: known}
    pages = files.read_partitioned(spark, f"{root}/pages", corpus_version, document_id, schema=_schema(spark, schemas.PAGES)).drop("corpus_version")
    vectors = files.read_partitioned(spark, f"{root}/embeddings", corpus_version, document_id, schema=_schema(spark, _VECTORS)).drop("corpus_version")
    if vectors.isEmpty():
        raise RetrievalError(f"no vectors of {document_id or 'any document'} in corpus {corpus_version!r}")
    embedder = model_of(vectors, providers)
    chunks = chunking.chunk_pages(pages)
    return Corpus(idx.build_index(chunks, vectors.drop("model_name"), catalog, embedder.dimension), embedder, chunks)


def _schema(spark: SparkSession, ddl: str):
    return spark.createDataFrame([], ddl).schema


def load_cases(spark: SparkSession, path: str, index: DataFrame) -> DataFrame:
    """Benchmark cases from JSON lines; ids that the index has not, blank queries and repeated cases raise."""
    cases = evaluation.valid_cases(files.read_json(spark, path, schemas.CASES).withColumn("case_id", F.col("case_id").cast("string")))
    wanted = cases.select("case_id", F.explode("expected_chunk_ids").alias("chunk_id"))
    unknown = wanted.join(index.select("chunk_id"), "chunk_id", "left_anti").limit(10).collect()
    if unknown:
        raise RetrievalError("cases expect unknown chunks: " + ", ".join(f"{r.case_id}: {r.chunk_id}" for r in unknown))
    return cases


def run_corpus_benchmark(spark: SparkSession, root: str, corpus_version: str, cases_path: str, providers: dict[str, embedding.EmbeddingProvider] | None = None, top_k: int = 5, digits: int | None = None, full: bool = True) -> DataFrame:
    """Metrics of a file of cases against a written corpus."""
    corpus = load_corpus(spark, root, corpus_version, providers)
    index = Staging(spark, "corpus").write(corpus.index, "index")  # read for the cases, the search and the ranks
    return evaluation.run_benchmark(load_cases(spark, cases_path, index), index, corpus.embedder, top_k, digits, full)
