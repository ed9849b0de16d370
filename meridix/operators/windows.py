"""Ranking, dedupe and state over ordered rows, as window or aggregate expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def top_per_group(df: DataFrame, keys: list[str], order: list[Column], k: int, rank: str = "rank") -> DataFrame:
    """The first k rows of each group in the given order, numbered from 1. Spark keeps k a group before the shuffle."""
    return df.withColumn(rank, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col(rank) <= k)


def first_wins(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """One row a key: the first in the given order."""
    return top_per_group(df, keys, order, 1, "_rank").drop("_rank")


def duplicate_decisions(df: DataFrame, record_id: str, keys: list[str]) -> DataFrame:
    """Each record's first record with the same keys (its canonical one) and whether it repeats it. Partial minima and a join: no key's records come to one task in full."""
    first = df.groupBy(*keys).agg(F.min(record_id).alias("canonical_id"))
    return df.join(first, keys).withColumn("decision", F.when(F.col(record_id) == F.col("canonical_id"), "unique").otherwise("exact_duplicate"))


def trailing_sums(df: DataFrame, keys: list[str], ts: str, sums: dict[str, tuple[Column, int]], stretch: int = 3600) -> DataFrame:
    """For each name the sum of a column over the rows of the same keys in the last so many seconds, each row included: (t - seconds, t].

    A key's rows are dealt by stretches of time, once for all windows, each with the rows before it that the widest window
    reaches; rows of one instant count together. A sum is what came until now less what had come by the window's start:
    both frames only grow, so a row costs the same however many others its window holds."""
    stretch = max(stretch, *(seconds for _, seconds in sums.values())) * 1_000_000
    own = F.floor(F.col("_at") / stretch)
    dealt = df.withColumn("_at", F.unix_micros(F.col(ts).cast("timestamp"))).withColumns({f"_{name}": c for name, (c, _) in sums.items()}).withColumn("_own", own)
    dealt = dealt.withColumn("_in", F.explode(F.array(F.col("_own"), F.col("_own") + 1)))
    by = Window.partitionBy(*keys, "_in").orderBy("_at")
    until = lambda name, end: F.coalesce(F.sum(f"_{name}").over(by.rangeBetween(Window.unboundedPreceding, end)), F.lit(0))
    found = dealt.withColumns({name: until(name, 0) - until(name, -seconds * 1_000_000) for name, (_, seconds) in sums.items()})
    return found.where("_in = _own").drop("_at", "_own", "_in", *[f"_{name}" for name in sums])


def trailing_count(df: DataFrame, keys: list[str], ts: str, seconds: int, name: str, stretch: int = 3600) -> DataFrame:
    """Rows of the same keys in the last ``seconds``, each row included. A key's rows are dealt by stretches of time, each with the rows before it that its windows reach."""
    stretch = max(seconds, stretch) * 1_000_000
    at = F.unix_micros(F.col(ts).cast("timestamp"))
    own = F.floor(at / stretch)
    dealt = df.withColumn("_at", at).withColumn("_own", own).withColumn("_in", F.explode(F.array(F.col("_own"), F.col("_own") + 1)))
    window = Window.partitionBy(*keys, "_in").orderBy("_at").rangeBetween(-seconds * 1_000_000, 0)
    return dealt.withColumn(name, F.count(F.lit(1)).over(window)).where("_in = _own").drop("_at", "_own", "_in")


def sessions_by_gap(df: DataFrame, key: str, ts: str, order: str, minutes: int) -> DataFrame:
    """Rows numbered by session: a gap of more than ``minutes`` starts a new one."""
    w = Window.partitionBy(key).orderBy(ts, order)
    gap = F.unix_micros(F.col(ts).cast("timestamp")) - F.unix_micros(F.lag(ts).over(w).cast("timestamp"))
    return df.withColumn("session_no", F.sum(F.when(gap > minutes * 60_000_000, 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, 0)))


def upsert_latest(existing: DataFrame, changes: DataFrame, keys: list[str], order: str, created: str) -> DataFrame:
    """Rows after an upsert: the latest of each key wins, the earliest creation stays."""
    both = existing.unionByName(changes)
    others = [c for c in both.columns if c not in (*keys, created)]
    kept = both.groupBy(*keys).agg(F.max_by(F.struct(*others), order).alias("row"), F.min(created).alias(created))
    return kept.select(*[F.col(f"row.{c}") if c in others else F.col(c) for c in both.columns])


def insert_ignore(existing: DataFrame, new: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """New rows whose keys don't exist yet, the first of each key; null keys never collide."""
    known = first_wins(new.where(F.forall(F.array(*[F.col(k).cast("string") for k in keys]), lambda k: k.isNotNull())), keys, order)
    return known.join(existing.select(*keys), keys, "left_anti")


def first_decisive(df: DataFrame, key: str, order: str, value: str, decisive: Column) -> DataFrame:
    """Per key the first decisive value in order, or else the last one (column result)."""
    return df.groupBy(key).agg(F.coalesce(F.min_by(value, F.when(decisive, F.col(order))), F.max_by(value, order)).alias("result"))
