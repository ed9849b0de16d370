"""Streaming forms of event ingestion; ``availableNow`` runs drain what is there and stop."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_events(spark: SparkSession, folder: str, schema) -> DataFrame:
    """Event files as a stream; local times become instants, which watermarks need."""
    return spark.readStream.schema(schema).parquet(folder).withColumn("ts", F.col("ts").cast("timestamp"))


def idempotent(stream: DataFrame, delay: str = "1 day") -> DataFrame:
    """Each event id once within the watermark's delay."""
    return stream.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["event_id"])


def session_state(events: DataFrame) -> DataFrame:
    """Per user: first arrival's time, last time seen, last event type by arrival, and events so far (batch or update-mode stream)."""
    return events.groupBy("user_id").agg(F.min_by("ts", "event_id").alias("first_seen"), F.max("ts").alias("last_seen"), F.max_by("event_type", "event_id").alias("last_type"), F.count(F.lit(1)).alias("n_events"))


def drain(stream: DataFrame, folder: str, key: str) -> DataFrame:
    """Run an update-mode stream over what is there. A batch writes the rows that it changed under its number, so a repeated batch replaces itself and a crash loses nothing; a key's row of the latest batch counts."""

    def upsert(changed: DataFrame, batch: int) -> None:
        changed.write.mode("overwrite").parquet(f"{folder}/state/batch={batch}")

    query = stream.writeStream.outputMode("update").trigger(availableNow=True).option("checkpointLocation", f"{folder}/checkpoint").foreachBatch(upsert).start()
    query.awaitTermination()
    written = stream.sparkSession.read.parquet(f"{folder}/state")
    return written.groupBy(key).agg(F.max_by(F.struct(*[c for c in stream.columns if c != key]), "batch").alias("row")).select(key, "row.*")


def drain_append(stream: DataFrame, folder: str) -> DataFrame:
    """Run an append-mode stream over what is there, and read what it wrote."""
    query = stream.writeStream.format("parquet").outputMode("append").trigger(availableNow=True).option("checkpointLocation", f"{folder}/checkpoint").start(f"{folder}/rows")
    query.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{folder}/rows")
