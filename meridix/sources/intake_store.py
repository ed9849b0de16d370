"""Results of an intake, fanned out to ledgers in one batch; replays change nothing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# States that end a record's intake.
DONE = ("ACCEPTED", "ACCEPTED_WITH_WARNINGS", "DUPLICATE")
#: Ledgers of nested rows: the result's array and the key that makes a row of it one.
NESTED = {"observations": "observation_id", "findings": "finding_id"}


def _ledger(spark: SparkSession, folder: str, name: str, before: int | None = None) -> DataFrame | None:
    path = f"{folder}/{name}"
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if before == 0 or not where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where):
        return None
    rows = spark.read.option("basePath", path).parquet(path)
    return rows if before is None else rows.where(F.col("batch") < before)


def latest_states(states: DataFrame) -> DataFrame:
    """source_record_id, state, lead_id: each record's last one, by batch and order within it."""
    return states.groupBy("source_record_id").agg(F.max(F.struct("batch", "seq", "state", "lead_id")).alias("s")).select("source_record_id", "s.state", "s.lead_id")


def outcomes(results: DataFrame, folder: str, batch: int) -> DataFrame:
    """``results`` with ``outcome``: COLLISION where the record's id holds other content, REPLAY_NOOP where its intake has ended, else STORED.

    Of a batch's results for one record only the first by ``seq`` counts; later ones with its content are replays, those
    with other content collide."""
    spark = results.sparkSession
    records, states = _ledger(spark, folder, "records", batch), _ledger(spark, folder, "states", batch)
    first = results.groupBy("source_record_id").agg(F.min(F.struct("seq", "raw_fingerprint")).alias("first"))
    r = results.join(first, "source_record_id")
    known, ended = F.lit(None).cast("string"), F.lit(False)
    if records is not None:
        r = r.join(records.groupBy("source_record_id").agg(F.min("raw_fingerprint").alias("_known")), "source_record_id", "left")
        r = r.join(latest_states(states).select("source_record_id", F.col("state").alias("_state")), "source_record_id", "left")
        known, ended = F.col("_known"), F.coalesce(F.col("_state").isin(*DONE), F.lit(False))
    content = F.coalesce(known, F.col("first.raw_fingerprint"))
    outcome = F.when(F.col("raw_fingerprint") != content, "COLLISION").when(ended | (F.col("seq") != F.col("first.seq")), "REPLAY_NOOP").otherwise("STORED")
    return r.withColumn("outcome", outcome).select(*results.columns, "outcome")


def persist(results: DataFrame, folder: str, batch: int) -> DataFrame:
    """Write a batch of results (seq, source_record_id, raw_fingerprint, state, lead_id, display_name, domain, observations, findings) to the ledgers below ``folder``; returns source_record_id, seq, outcome.

    Records, observations and findings are added where their key is new; states, lead projections and quarantine marks are
    versions, of which the last counts. A batch writes under its number and reads earlier ones only, so one that is
    repeated after a crash replaces itself."""
    spark = results.sparkSession
    done = outcomes(results, folder, batch)
    done.write.mode("overwrite").parquet(f"{folder}/outcomes/batch={batch}")
    done = spark.read.parquet(f"{folder}/outcomes/batch={batch}")
    kept = done.where("outcome = 'STORED'")

    def write(rows: DataFrame, name: str) -> None:
        rows.write.mode("overwrite").parquet(f"{folder}/{name}/batch={batch}")

    def fresh(rows: DataFrame, name: str, key: str) -> DataFrame:
        before = _ledger(spark, folder, name, batch)
        return rows if before is None else rows.join(before.select(key), key, "left_anti")

    write(fresh(kept.select("source_record_id", "raw_fingerprint"), "records", "source_record_id"), "records")
    write(kept.select("source_record_id", "seq", "state", "lead_id"), "states")
    for name, key in NESTED.items():
        rows = kept.select("seq", "source_record_id", F.explode(name).alias("row")).select("seq", "source_record_id", "row.*")
        own = [c for c in rows.columns if c != key]
        once = rows.groupBy(key).agg(F.min(F.struct(*own)).alias("first")).select(key, "first.*").drop("seq")
        write(fresh(once, name, key), name)
    write(kept.where("lead_id is not null").select("lead_id", "seq", "display_name", "domain"), "leads")
    marks = F.when(F.col("state") == "QUARANTINED", True).when(F.col("state").isin("ACCEPTED", "ACCEPTED_WITH_WARNINGS"), False)
    write(kept.select("source_record_id", "seq", marks.alias("held")).where("held is not null"), "quarantine")
    return done.select("source_record_id", "seq", "outcome")


def quarantined(spark: SparkSession, folder: str) -> DataFrame:
    """Records that wait for a decision: those whose last mark holds them."""
    marks = spark.read.option("basePath", f"{folder}/quarantine").parquet(f"{folder}/quarantine")
    return marks.groupBy("source_record_id").agg(F.max(F.struct("batch", "seq", "held")).alias("m")).where("m.held").select("source_record_id")


def leads(spark: SparkSession, folder: str) -> DataFrame:
    """lead_id, display_name, domain: each lead's last projection."""
    rows = spark.read.option("basePath", f"{folder}/leads").parquet(f"{folder}/leads")
    return rows.groupBy("lead_id").agg(F.max(F.struct("batch", "seq", "display_name", "domain")).alias("l")).select("lead_id", "l.display_name", "l.domain")
