"""Upserts under a partial unique key: only open rows conflict."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows of a key between two counted places, at most about.
STRETCH_SECONDS = 86_400


def running_count(rows: DataFrame, keys: list[str], ts: str, order: str, flag: Column, name: str, seconds: int = STRETCH_SECONDS) -> DataFrame:
    """Number of flagged rows before each row of its keys, by ``ts`` and ``order``. A key's rows are dealt by stretches of time: counts of stretches are summed first, then rows within a stretch."""
    stretch = F.floor(F.unix_micros(F.col(ts).cast("timestamp")) / (seconds * 1_000_000))
    marked = rows.withColumn("_flag", flag.cast("int")).withColumn("_stretch", stretch)
    sums = marked.groupBy(*keys, "_stretch").agg(F.sum("_flag").alias("_n"))
    before = sums.withColumn("_before", F.coalesce(F.sum("_n").over(Window.partitionBy(*keys).orderBy("_stretch").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_n")
    within = Window.partitionBy(*keys, "_stretch").orderBy(ts, order).rowsBetween(Window.unboundedPreceding, -1)
    counted = marked.withColumn("_within", F.coalesce(F.sum("_flag").over(within), F.lit(0)))
    return counted.join(before, [*keys, "_stretch"]).withColumn(name, F.col("_before") + F.col("_within")).drop("_flag", "_stretch", "_within", "_before")


def open_tasks(changes: DataFrame, keys: list[str], ts: str, order: str, values: list[str]) -> DataFrame:
    """Tasks after all ``changes`` in order: keys, task_id, values, status, created_at, updated_at, n_upserts.

    ``op`` is upsert, claim, or what closes a task (anything else). An upsert meets the key's open or claimed task and
    replaces its values, keeping id, status and creation; without one it opens a task of its own. So a key's history is cut
    after each closing change, and each piece that has an upsert is one task, a plain aggregate. A claim or a closing change
    before a piece's first upsert finds no task and does nothing."""
    closes = ~F.col("op").isin("upsert", "claim")
    piece = running_count(changes, keys, ts, order, closes, "_piece")
    at, upsert = F.struct(ts, order), F.col("op") == "upsert"
    merged = piece.groupBy(*keys, "_piece").agg(
        F.min(F.when(upsert, at)).alias("first"), F.max(F.when(upsert, F.struct(ts, order, *values))).alias("last"), F.max(F.when(~upsert, F.struct(ts, order, "op"))).alias("moved"), F.count_if(upsert).alias("n_upserts")
    )
    # A change of status counts if the task was there by then.
    status = F.when(F.struct(f"moved.{ts}", f"moved.{order}") > F.col("first"), F.when(F.col("moved.op") == "claim", "claimed").otherwise(F.col("moved.op"))).otherwise("open")
    updated = F.greatest(F.col(f"last.{ts}"), F.when(status != "open", F.col(f"moved.{ts}")))
    return merged.where("first is not null").select(*keys, F.col(f"first.{order}").alias("task_id"), *[F.col(f"last.{v}").alias(v) for v in values], status.alias("status"), F.col(f"first.{ts}").alias("created_at"), updated.alias("updated_at"), "n_upserts")
