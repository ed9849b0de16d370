"""Experiment variants by the cumulative ranges of an allocation table."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from meridix.functions.text import stable_bucket


def allocation_ranges(allocations: DataFrame) -> DataFrame:
    """experiment, variant, low, high (in buckets of a hundredth of a percent) and valid, from experiment, position, variant and allocation_pct.

    An experiment with a missing or negative share, one over 100 or a sum over 100 is not valid as a whole. An experiment's
    variants are few, so one window task an experiment is enough."""
    order, whole = Window.partitionBy("experiment").orderBy("position", "variant"), Window.partitionBy("experiment")
    pct = F.col("allocation_pct").cast("double")
    high = F.sum(pct).over(order.rowsBetween(Window.unboundedPreceding, 0)) * 100
    valid = (F.sum(pct).over(whole) <= 100.000001) & F.coalesce(F.bool_and(pct.between(0, 100)).over(whole), F.lit(False)) & (F.count("allocation_pct").over(whole) == F.count(F.lit(1)).over(whole))
    return allocations.select("experiment", "variant", F.coalesce(high - pct * 100, F.lit(0.0)).alias("low"), F.coalesce(high, F.lit(0.0)).alias("high"), F.coalesce(valid, F.lit(False)).alias("valid"))


def assign_variants(subjects: DataFrame, allocations: DataFrame) -> DataFrame:
    """experiment, subject, bucket, variant, status for each of ``subjects`` (experiment, subject).

    The bucket is a stable hash of experiment and subject; the variant is the one whose range holds it, none beyond the
    last range (``unallocated``); without a table of its own, or with one that isn't valid, an experiment assigns nobody
    (``no_variants``, ``invalid_allocation``). Each experiment's ranges are one small sorted array, so a subject meets one
    row, and a range of any number of subjects is no join of ranges."""
    ranges = allocation_ranges(allocations).groupBy("experiment").agg(F.array_sort(F.collect_list(F.struct("high", "low", "variant"))).alias("ranges"), F.bool_and("valid").alias("valid"))
    s = subjects.select("experiment", "subject", stable_bucket(F.concat_ws(":", F.col("experiment").cast("string"), F.col("subject").cast("string"))).alias("bucket"))
    hit = F.try_element_at(F.filter("ranges", lambda r: (F.col("bucket") < r["high"]) & (F.col("bucket") >= r["low"])), F.lit(1))
    status = F.when(F.col("ranges").isNull(), "no_variants").when(~F.col("valid"), "invalid_allocation").when(F.col("hit").isNull(), "unallocated").otherwise("assigned")
    j = s.join(ranges, "experiment", "left").withColumn("hit", F.when(F.col("valid"), hit))
    return j.select("experiment", "subject", "bucket", F.col("hit.variant").alias("variant"), status.alias("status"))
