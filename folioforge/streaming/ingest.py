"""Streaming, an extension: incremental ingest into a vector table, and event windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from folioforge.operators.retrieval import ChunkRules
from folioforge.plans.pipelines import ingest
from folioforge.sources.store import VectorTable


def hourly(events: DataFrame) -> DataFrame:
    """Counts and sums of events per hour and type; the same plan over a batch or a stream."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp"))
    if timed.isStreaming:
        timed = timed.withWatermark("ts", "1 hour")
    rows = timed.groupBy(F.window("ts", "1 hour"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return rows.select(F.col("window.start").cast("timestamp_ntz").alias("window_start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes") -> DataFrame:
    """Events of a user without a pause of `gap`."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp"))
    if timed.isStreaming:
        timed = timed.withWatermark("ts", gap)
    return timed.groupBy(F.session_window("ts", gap), "user_id").agg(F.count("*").alias("n")).select("user_id", "session_window.start", "session_window.end", "n")


def ingest_stream(spark: SparkSession, source: str, schema: str, table: VectorTable, checkpoint: str, collection: str = "legal_ai_default", rules: ChunkRules = ChunkRules()) -> StreamingQuery:
    """Upsert the chunks of arriving fused documents (Parquet files); chunk ids are deterministic, so a repeated batch changes nothing."""
    arriving = spark.readStream.schema(schema).parquet(source)

    def write(batch: DataFrame, _: int) -> None:
        table.upsert(ingest(batch, rules, collection).drop("collection"), collection)

    return arriving.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
