"""Ingestion of tracked requests: tokens, traffic, idempotent events and sessions, batch by batch of a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meridix.operators import idempotency, scoring

#: Identities that a session takes over from its requests, and how long it is kept after it was last seen.
IDENTITIES, KEPT_DAYS = ("person_id", "account_id", "campaign_id", "send_id"), 180
KEYS = ["event_id", "source_event_id", "ingest_key"]


def resolve(requests: DataFrame, links: DataFrame) -> DataFrame:
    """Requests whose token is a link that is neither revoked nor expired at the time, with the link's identities, the traffic's class, reason and confidence, and an ingest key from token and idempotency key."""
    live = F.col("revoked_at").isNull() & (F.col("expires_at").isNull() | (F.col("expires_at") > F.col("occurred_at")))
    # Links grow with the input, and a row weighs many times what its file does: neither side is broadcast.
    met = requests.join(links.hint("merge"), "token").where(live)
    label, reason = scoring.traffic_class(*(F.col(c) for c in ("agent", "method", "repeats", "accept", "client_hints", "fetch_mode")))
    met = met.withColumns({"traffic": label, "reason": reason}).withColumn("confidence", scoring.confidence(F.col("traffic")))
    key = F.when(F.col("idempotency_key") != "", F.concat(F.lit("link:"), F.col("token"), F.lit(":"), F.col("idempotency_key")))
    return met.select("arrival", "event_id", "source_event_id", key.alias("ingest_key"), "token", "link_type", "session_id", "occurred_at", *IDENTITIES, "traffic", "reason", "confidence")


def session_parts(events: DataFrame) -> DataFrame:
    """What a batch says of each session, in a form that merges: values carry the arrival that set them; metadata by name."""
    set_by = lambda value: F.max(F.when(value.isNotNull(), F.struct(F.col("arrival"), value.alias("value"))))
    e = events.where("session_id is not null and session_id != ''")
    return e.groupBy("session_id").agg(
        F.min(F.struct("arrival", F.col("occurred_at").alias("value"))).alias("first_seen"), F.max("occurred_at").alias("last_seen"), F.count(F.lit(1)).alias("n"),
        *[set_by(F.col(c)).alias(c) for c in IDENTITIES], set_by(F.col("link_type")).alias("last_link_type"),
    )


def merged_sessions(parts: DataFrame) -> DataFrame:
    """Parts of any batches, as parts: associative, so batches merge in any order and parts may be compacted."""
    return parts.groupBy("session_id").agg(F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen"), F.sum("n").alias("n"), *[F.max(c).alias(c) for c in (*IDENTITIES, "last_link_type")])


def sessions(parts: DataFrame) -> DataFrame:
    """session_id, first_seen, last_seen, n, identities (the latest that was known) and metadata."""
    m = merged_sessions(parts)
    return m.select("session_id", F.col("first_seen.value").alias("first_seen"), "last_seen", "n", *[F.col(f"{c}.value").alias(c) for c in IDENTITIES], F.create_map(F.lit("last_link_type"), F.col("last_link_type.value")).alias("metadata"))


def _stored(spark: SparkSession, path: str, batch: int) -> DataFrame | None:
    """What batches before this one wrote."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if batch == 0 or not where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where):
        return None
    return spark.read.option("basePath", path).parquet(path).where(F.col("batch") < batch).drop("batch")


def ingest_batch(requests: DataFrame, links: DataFrame, folder: str, batch: int) -> None:
    """Resolve, classify and append one batch. An event is dropped if it shares any of KEYS with one that is there, earlier in this batch included; its session is seen all the same.

    A batch writes under its number and reads only batches before it, so one that is repeated replaces itself."""
    events = resolve(requests, links)
    before = _stored(requests.sparkSession, f"{folder}/events", batch)
    fresh = events if before is None else idempotency.not_stored(events, before, "arrival", KEYS)
    idempotency.first_accepted(fresh, "arrival", KEYS).write.mode("overwrite").parquet(f"{folder}/events/batch={batch}")
    session_parts(events).write.mode("overwrite").parquet(f"{folder}/sessions/batch={batch}")


def ingest(stream: DataFrame, links: DataFrame, folder: str) -> None:
    """Run the stream over what is there."""
    query = stream.writeStream.trigger(availableNow=True).option("checkpointLocation", f"{folder}/checkpoint").foreachBatch(lambda rows, batch: ingest_batch(rows, links, folder, batch)).start()
    query.awaitTermination()


def current_sessions(spark: SparkSession, folder: str, kept_days: int = KEPT_DAYS) -> DataFrame:
    """Sessions of all batches that were seen in the last ``kept_days`` of the stream's time; older ones have timed out."""
    parts = spark.read.option("basePath", f"{folder}/sessions").parquet(f"{folder}/sessions").drop("batch")
    latest = parts.agg(F.max("last_seen")).first()[0]
    return sessions(parts).where(F.col("last_seen") >= F.lit(latest) - F.expr(f"INTERVAL {kept_days} DAYS")) if latest else sessions(parts)


def compact_sessions(spark: SparkSession, folder: str, kept_days: int = KEPT_DAYS) -> DataFrame:
    """The sessions that have not timed out, merged into one part each: what replaces the parts of the batches, so state follows the sessions in use and not the stream's length."""
    parts = merged_sessions(spark.read.option("basePath", f"{folder}/sessions").parquet(f"{folder}/sessions").drop("batch"))
    latest = parts.agg(F.max("last_seen")).first()[0]
    return parts.where(F.col("last_seen") >= F.lit(latest) - F.expr(f"INTERVAL {kept_days} DAYS")) if latest else parts
