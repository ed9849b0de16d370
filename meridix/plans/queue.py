"""Queries on the work queue (orders stand for queued, sent and claimed work) and its reports."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from meridix.functions.text import decimal
from meridix.operators import scoring, windows
from meridix.plans.registry import query
from meridix.sources.tables import table, tasks


@query("SELECT o_orderkey, o_custkey, o_orderdate, row_number() OVER (ORDER BY CASE WHEN o_orderstatus = 'P' THEN 0 ELSE 1 END, o_orderdate, o_orderkey) AS position FROM orders o JOIN customer c ON o_custkey = c_custkey JOIN nation n ON c_nationkey = n_nationkey WHERE o_orderstatus IN ('O', 'P') AND o_orderdate <= TIMESTAMP '1998-01-01' AND c_acctbal >= 0 AND n_regionkey <> 3 ORDER BY position LIMIT 100")
def claim_due_topk(spark, folder):
    o, c, n = (table(spark, folder, t) for t in ("orders", "customer", "nation"))
    due = o.where("o_orderstatus in ('O', 'P') and o_orderdate <= timestamp_ntz '1998-01-01'").join(c.where("c_acctbal >= 0"), F.col("o_custkey") == F.col("c_custkey")).join(n.where("n_regionkey <> 3"), F.col("c_nationkey") == F.col("n_nationkey"))
    order = [F.when(F.col("o_orderstatus") == "P", 0).otherwise(1), F.col("o_orderdate"), F.col("o_orderkey")]
    # A claim is a bounded batch: top rows first, then their positions.
    claimed = due.orderBy(*order).limit(100)
    return claimed.withColumn("position", F.row_number().over(Window.orderBy(*order)).cast("long")).select("o_orderkey", "o_custkey", "o_orderdate", "position")


@query("SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber >= 3 THEN NULL ELSE CAST(least(60 * pow(2, l_linenumber - 1), 3600) AS BIGINT) END AS wait_s FROM lineitem")
def retry_backoff(spark, folder):
    return table(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", scoring.backoff_seconds(F.col("l_linenumber")).alias("wait_s"))


@query("SELECT o_orderkey, CASE WHEN x.l_orderkey IS NOT NULL THEN 'claiming' WHEN o_orderstatus = 'O' THEN 'queued' ELSE 'done' END AS status FROM orders LEFT JOIN (SELECT DISTINCT l_orderkey FROM lineitem WHERE l_returnflag = 'R') x ON o_orderkey = x.l_orderkey")
def update_from_join(spark, folder):
    hit = table(spark, folder, "lineitem").where("l_returnflag = 'R'").select("l_orderkey").distinct()
    j = table(spark, folder, "orders").join(hit, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    return j.select("o_orderkey", F.when(F.col("l_orderkey").isNotNull(), "claiming").when(F.col("o_orderstatus") == "O", "queued").otherwise("done").alias("status"))


@query("SELECT o_custkey, o_orderkey, o_orderdate, o_totalprice FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC NULLS LAST, o_orderkey DESC) = 1")
def latest_per_group(spark, folder):
    return windows.first_wins(table(spark, folder, "orders"), ["o_custkey"], [F.desc_nulls_last("o_orderdate"), F.desc("o_orderkey")]).select("o_custkey", "o_orderkey", "o_orderdate", "o_totalprice")


@query("SELECT c_custkey, last_order, label FROM (SELECT c_custkey, max(o_orderdate) AS last_order, arg_max(o_orderpriority, (o_orderdate, o_orderkey)) AS label FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY c_custkey) WHERE last_order IS NULL OR last_order <= TIMESTAMP '1998-07-01' ORDER BY CASE label WHEN '1-URGENT' THEN 1 WHEN '2-HIGH' THEN 2 WHEN '3-MEDIUM' THEN 3 ELSE 4 END, last_order ASC NULLS FIRST, c_custkey LIMIT 20")
def refresh_order(spark, folder):
    """The 20 accounts to refresh next: stale ones only, by the label of their latest run, never refreshed ones first."""
    last = table(spark, folder, "orders").groupBy("o_custkey").agg(F.max("o_orderdate").alias("last_order"), F.max_by("o_orderpriority", F.struct("o_orderdate", "o_orderkey")).alias("label"))
    c = table(spark, folder, "customer").join(last, F.col("c_custkey") == F.col("o_custkey"), "left").where("last_order is null or last_order <= timestamp_ntz '1998-07-01'")
    place = F.when(F.col("label") == "1-URGENT", 1).when(F.col("label") == "2-HIGH", 2).when(F.col("label") == "3-MEDIUM", 3).otherwise(4)
    return c.orderBy(place, F.asc_nulls_first("last_order"), "c_custkey").limit(20).select("c_custkey", "last_order", "label")


@query("SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F' AND o_totalprice > 250000) ORDER BY c_custkey LIMIT 40")
def not_yet_processed(spark, folder):
    """The first 40 accounts without a finished run."""
    done = table(spark, folder, "orders").where("o_orderstatus = 'F' and o_totalprice > 250000")
    return table(spark, folder, "customer").join(done, F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey").orderBy("c_custkey").limit(40)


@query("WITH o AS (SELECT o_custkey, count(*) AS n_orders, count(*) FILTER (WHERE o_orderstatus = 'F') AS n_done, avg(o_totalprice) AS mean_price FROM orders GROUP BY 1), l AS (SELECT o_custkey, count(*) AS n_lines, count(DISTINCT l_partkey) AS n_parts FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1) SELECT c_mktsegment, count(*) AS accounts, count(n_orders) AS with_orders, coalesce(sum(n_done), 0)::BIGINT AS done, coalesce(sum(n_lines), 0)::BIGINT AS lines, coalesce(sum(n_parts), 0)::BIGINT AS parts, CAST(round(coalesce(avg(mean_price), 0), 2) AS DECIMAL(18, 2)) AS mean_price FROM customer LEFT JOIN o ON c_custkey = o.o_custkey LEFT JOIN l ON c_custkey = l.o_custkey GROUP BY c_mktsegment")
def coverage_rollup(spark, folder):
    o, l, c = (table(spark, folder, t) for t in ("orders", "lineitem", "customer"))
    by_order = o.groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n_orders"), F.count_if(F.col("o_orderstatus") == "F").alias("n_done"), F.avg("o_totalprice").alias("mean_price"))
    by_line = l.join(o.select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey")).groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n_lines"), F.countDistinct("l_partkey").alias("n_parts"))
    j = c.withColumnRenamed("c_custkey", "o_custkey").join(by_order, "o_custkey", "left").join(by_line, "o_custkey", "left")
    zero = F.lit(0)
    return j.groupBy("c_mktsegment").agg(F.count(F.lit(1)).alias("accounts"), F.count("n_orders").alias("with_orders"), F.coalesce(F.sum("n_done"), zero).alias("done"), F.coalesce(F.sum("n_lines"), zero).alias("lines"), F.coalesce(F.sum("n_parts"), zero).alias("parts"), decimal(F.coalesce(F.avg("mean_price"), F.lit(0.0)), 2).alias("mean_price"))


@query("SELECT (SELECT count(*) FROM customer) AS accounts, (SELECT count(DISTINCT o_custkey) FROM orders) AS active, (SELECT count(*) FROM orders WHERE o_orderstatus = 'O') AS open_work, (SELECT count(*) FROM lineitem) AS attempts")
def global_metrics(spark, folder):
    c, o, l = (table(spark, folder, t) for t in ("customer", "orders", "lineitem"))
    parts = [c.agg(F.count(F.lit(1)).alias("accounts")), o.agg(F.countDistinct("o_custkey").alias("active"), F.count_if(F.col("o_orderstatus") == "O").alias("open_work")), l.agg(F.count(F.lit(1)).alias("attempts"))]
    out = parts[0]
    for one_row in parts[1:]:  # joins of single rows
        out = out.crossJoin(F.broadcast(one_row))
    return out


@query("SELECT l_orderkey, l_linenumber, (sum(l_quantity) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity ROWS UNBOUNDED PRECEDING))::BIGINT AS delay_days FROM lineitem")
def touchpoint_schedule(spark, folder):
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity").rowsBetween(Window.unboundedPreceding, 0)
    return table(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", F.sum("l_quantity").over(w).cast("long").alias("delay_days"))


@query("SELECT 'without_orders' AS side, count(*) AS n FROM (SELECT c_custkey FROM customer EXCEPT SELECT o_custkey FROM orders) UNION ALL SELECT 'unknown_account', count(*) FROM (SELECT o_custkey FROM orders EXCEPT SELECT c_custkey FROM customer)")
def set_reconciliation(spark, folder):
    c, o = table(spark, folder, "customer").select(F.col("c_custkey").alias("k")), table(spark, folder, "orders").select(F.col("o_custkey").alias("k"))
    count = lambda df, side: df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(side).alias("side"), "n")
    return count(c.subtract(o), "without_orders").unionByName(count(o.subtract(c), "unknown_account"))


@query("SELECT o_custkey, s_nationkey, count(DISTINCT o_orderkey) AS paths, CAST(round(sum(l_extendedprice), 2) AS DECIMAL(18, 2)) AS amount FROM orders JOIN lineitem ON o_orderkey = l_orderkey JOIN supplier ON l_suppkey = s_suppkey GROUP BY ALL")
def attribution_path(spark, folder):
    """Lines and orders meet, and orders are counted once, in tasks whose number follows from the number of lines."""
    o, l, s = (table(spark, folder, t) for t in ("orders", "lineitem", "supplier"))
    n = tasks(l)
    lines = l.join(s, F.col("l_suppkey") == F.col("s_suppkey")).select("l_orderkey", "s_nationkey", "l_extendedprice").repartition(n, "l_orderkey")
    j = lines.join(o.select("o_orderkey", "o_custkey").repartition(n, "o_orderkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    return j.groupBy("o_custkey", "s_nationkey").agg(F.countDistinct("o_orderkey").alias("paths"), decimal(F.sum("l_extendedprice"), 2).alias("amount"))


@query("SELECT l_orderkey, CASE WHEN count(DISTINCT l_shipdate) = 1 THEN min(l_shipdate) END AS agreed, count(DISTINCT l_shipdate) AS kinds FROM lineitem GROUP BY l_orderkey")
def consensus_value(spark, folder):
    return table(spark, folder, "lineitem").groupBy("l_orderkey").agg(F.countDistinct("l_shipdate").alias("kinds"), F.min("l_shipdate").alias("least")).select("l_orderkey", F.when(F.col("kinds") == 1, F.col("least")).alias("agreed"), "kinds")


@query("SELECT l_orderkey, coalesce(max(l_linenumber), 0) + 1 AS next_attempt FROM lineitem GROUP BY l_orderkey")
def next_attempt_number(spark, folder):
    return table(spark, folder, "lineitem").groupBy("l_orderkey").agg((F.coalesce(F.max("l_linenumber"), F.lit(0)) + 1).alias("next_attempt"))


@query("SELECT l_returnflag, l_linestatus, CAST(round(sum(l_quantity), 2) AS DECIMAL(18, 2)) AS sum_qty, CAST(round(sum(l_extendedprice * (1 - l_discount)), 2) AS DECIMAL(18, 2)) AS revenue, count(*) AS n FROM lineitem GROUP BY ALL")
def outcome_summary(spark, folder):
    return table(spark, folder, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(decimal(F.sum("l_quantity"), 2).alias("sum_qty"), decimal(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"), F.count(F.lit(1)).alias("n"))
