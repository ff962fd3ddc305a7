"""A facade over a vector table: ingest, query, reason, format, with the defaults and bounds of a request."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioforge import schemas
from folioforge.operators import reasoning, retrieval
from folioforge.plans import pipelines
from folioforge.sources.store import VectorTable


# Names, defaults and bounds of the public interface.
@dataclass(frozen=True)
class Defaults:
    collection: str = "legal_ai_default"
    top_k: int = 5
    use_mmr: bool = True
    mmr_lambda: float = 0.5
    min_score: float = 0.0
    dim: int = 128
    engine: str | None = None
    embedder: str | None = None


class Service:
    """Batch requests against a table at `path`; None, and a top_k of 0, mean the default."""

    def __init__(self, spark: SparkSession, path: str, defaults: Defaults = Defaults(), rules: retrieval.ChunkRules = retrieval.ChunkRules()):
        self.spark, self.table, self.defaults, self.rules = spark, VectorTable(spark, path), defaults, rules

    def ingest(self, documents: DataFrame, collection: str | None = None) -> DataFrame:
        """Chunk, embed and store fused documents; returns the chunks."""
        chunks = pipelines.ingest(documents, self.rules, collection or self.defaults.collection, self.defaults.dim, self.defaults.embedder)
        self.table.upsert(chunks.drop("collection"), collection or self.defaults.collection)
        return chunks

    def query(self, questions: DataFrame, top_k: int | None = None, collection: str | None = None, use_mmr: bool | None = None, mmr_lambda: float | None = None, min_score: float | None = None) -> DataFrame:
        """Ranked chunks for `questions` (`query_id`, `query`); empty questions are left out."""
        d = self.defaults
        k, weight, least = top_k or d.top_k, d.mmr_lambda if mmr_lambda is None else mmr_lambda, d.min_score if min_score is None else min_score
        request = self.spark.range(1).select(F.lit("q").alias("query"), F.lit(k).alias("top_k"), F.lit(weight).alias("mmr_lambda"), F.lit(least).alias("min_score"))
        if faults := schemas.checked(request, schemas.query_rules()).first()["errors"]:
            raise ValueError("; ".join(faults))
        asked = retrieval.embed(schemas.split_rejects(questions, schemas.query_rules()[:1])[0], "query", d.dim, d.embedder).select("query_id", "embedding")
        stored = self.table.read(collection or d.collection)
        if stored is None:
            kind = dict(asked.dtypes)["query_id"]
            return self.spark.createDataFrame([], f"query_id {kind}, position int, id string, score double, {retrieval.CHUNK_COLUMNS}")
        entries = stored.withColumnRenamed("chunk_id", "id")
        return retrieval.retrieve(entries, asked, k, d.use_mmr if use_mmr is None else use_mmr, weight, least)

    def reason(self, queries: DataFrame, fmt: str = "markdown") -> DataFrame:
        """Answers in one format for queries with their context (`reasoning.reason`)."""
        column = {"markdown": "markdown", "plain": "plain", "html": "html", "json": "json_summary"}.get(fmt.lower())
        if column is None:
            raise ValueError(f"unknown format: {fmt}")
        return reasoning.format_answers(*reasoning.reason(queries, engine=self.defaults.engine)).select("query_id", F.col(column).alias("response"))

    def collection_size(self, collection: str | None = None) -> int:
        return self.table.count(collection or self.defaults.collection)

    def clear(self, collection: str | None = None) -> None:
        self.table.delete_collection(collection or self.defaults.collection)
