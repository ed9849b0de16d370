"""Queries on delivery control: rate ceilings, leases, attempts, verification, merged candidates, streamed sessions."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from meridix.functions.text import emails
from meridix.operators import scoring, windows
from meridix.plans.registry import query
from meridix.sources.tables import scratch, table
from meridix.streaming import sessions

# Searches in a minute and an hour, fetched URLs in a minute and a day.
SEARCHES, FETCHES = (27, 450), (135, 900)
AGO = "OVER (PARTITION BY kind ORDER BY ts RANGE BETWEEN INTERVAL {} MICROSECOND PRECEDING AND CURRENT ROW)"
# Requests: a search for each view and click, else a fetch of up to ten URLs.
CALLS = "SELECT *, CASE WHEN event_type IN ('view', 'click') THEN 'search' ELSE 'fetch' END AS kind, CASE WHEN event_type IN ('view', 'click') THEN 1 ELSE event_id % 10 + 1 END AS urls FROM events"


@query(f"SELECT kind, count(*) AS n, sum(urls)::BIGINT AS urls, max(m)::BIGINT AS peak_minute, max(h)::BIGINT AS peak_hour, max(d)::BIGINT AS peak_day, count_if(m > CASE kind WHEN 'search' THEN {SEARCHES[0]} ELSE {FETCHES[0]} END) AS over_minute, count_if(kind = 'search' AND h > {SEARCHES[1]}) AS over_hour, count_if(kind = 'fetch' AND d > {FETCHES[1]}) AS over_day FROM (SELECT kind, urls, sum(urls) {AGO.format(59_999_999)} AS m, sum(urls) {AGO.format(3_599_999_999)} AS h, sum(urls) {AGO.format(86_399_999_999)} AS d FROM ({CALLS})) GROUP BY kind")
def rate_ceilings(spark, folder):
    """Requests that their windows' ceilings would hold back: sums of URLs, all windows over one deal by stretches of time."""
    search = F.col("event_type").isin("view", "click")
    calls = table(spark, folder, "events").select("ts", F.when(search, "search").otherwise("fetch").alias("kind"), F.when(search, 1).otherwise(F.col("event_id") % 10 + 1).alias("urls"))
    w = windows.trailing_sums(calls, ["kind"], "ts", {"m": (F.col("urls"), 60), "h": (F.col("urls"), 3600), "d": (F.col("urls"), 86400)})
    is_search = F.col("kind") == "search"
    over = {"over_minute": F.col("m") > F.when(is_search, SEARCHES[0]).otherwise(FETCHES[0]), "over_hour": is_search & (F.col("h") > SEARCHES[1]), "over_day": ~is_search & (F.col("d") > FETCHES[1])}
    peaks = {"peak_minute": "m", "peak_hour": "h", "peak_day": "d"}
    return w.groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.sum("urls").alias("urls"), *[F.max(c).alias(k) for k, c in peaks.items()], *[F.count_if(c).alias(k) for k, c in over.items()])


@query("SELECT user_id, attempts, CASE WHEN decided IS NOT NULL THEN 'complete' WHEN attempts >= 5 THEN 'failed' ELSE 'pending' END AS status FROM (SELECT user_id, count_if(event_type = 'error') AS attempts, max(CASE WHEN event_type = 'purchase' AND value > 180 THEN 1 END) AS decided FROM events GROUP BY user_id)")
def analysis_job_status(spark, folder):
    e = table(spark, folder, "events")
    jobs = e.groupBy("user_id").agg(F.count_if(F.col("event_type") == "error").alias("attempts"), F.bool_or((F.col("event_type") == "purchase") & (F.col("value") > 180)).alias("decided"))
    return jobs.select("user_id", "attempts", scoring.job_status(F.col("decided"), F.col("attempts")).alias("status"))


@query("SELECT user_id, coalesce(arg_min(event_type, event_id) FILTER (WHERE event_type IN ('purchase', 'signup')), arg_max(event_type, event_id)) AS result FROM events GROUP BY user_id")
def verification_fallback(spark, folder):
    return windows.first_decisive(table(spark, folder, "events"), "user_id", "event_id", "event_type", F.col("event_type").isin("purchase", "signup"))


@query("SELECT l_partkey, max(l_discount) AS confidence, arg_max(l_orderkey, l_discount * 1e9 + l_orderkey + l_linenumber / 10.0) AS best_order, string_agg(DISTINCT l_returnflag, ',' ORDER BY l_returnflag) AS flags, count(*) AS n_sources FROM lineitem GROUP BY l_partkey")
def merged_candidates(spark, folder):
    place = F.struct("l_discount", "l_orderkey", "l_linenumber")
    return table(spark, folder, "lineitem").groupBy("l_partkey").agg(F.max("l_discount").alias("confidence"), F.max(place)["l_orderkey"].alias("best_order"), F.array_join(F.array_sort(F.collect_set("l_returnflag")), ",").alias("flags"), F.count(F.lit(1)).alias("n_sources"))


@query("SELECT l_orderkey, count(*) AS n_steps, min(l_linenumber) = 1 AND max(l_linenumber) = count(*) AND count(DISTINCT l_linenumber) = count(*) AS contiguous FROM lineitem GROUP BY l_orderkey")
def sequence_contiguity(spark, folder):
    # Three plain aggregates instead of sorting a list of each order's steps.
    steps = table(spark, folder, "lineitem").groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n_steps"), F.min("l_linenumber").alias("lo"), F.max("l_linenumber").alias("hi"), F.countDistinct("l_linenumber").alias("kinds"))
    return steps.select("l_orderkey", "n_steps", ((F.col("lo") == 1) & (F.col("hi") == F.col("n_steps")) & (F.col("kinds") == F.col("n_steps"))).alias("contiguous"))


@query("SELECT o_orderkey, o_custkey, slot FROM (SELECT o_orderkey, o_custkey, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS INT) AS slot, cap, sent FROM orders JOIN (SELECT c_custkey, CASE c_mktsegment WHEN 'BUILDING' THEN 0 ELSE 8 END AS cap FROM customer) ON o_custkey = c_custkey LEFT JOIN (SELECT o_custkey AS k, count(*) AS sent FROM orders WHERE o_orderstatus = 'F' GROUP BY ALL) ON o_custkey = k WHERE o_orderstatus = 'O') WHERE cap = 0 OR slot <= cap - coalesce(sent, 0)")
def strict_cap_claims(spark, folder):
    """Open orders within what their customer's cap leaves (0: no cap); the sent count and the rank come from one shuffle on the customer."""
    o = table(spark, folder, "orders").where(F.col("o_orderstatus").isin("O", "F"))
    by = Window.partitionBy("o_custkey")
    o = o.select("o_orderkey", "o_custkey", "o_orderdate", "o_orderstatus", F.count_if(F.col("o_orderstatus") == "F").over(by).alias("sent")).where("o_orderstatus = 'O'")
    o = o.withColumn("slot", F.row_number().over(by.orderBy("o_orderdate", "o_orderkey")))
    c = table(spark, folder, "customer").select("c_custkey", F.when(F.col("c_mktsegment") == "BUILDING", 0).otherwise(8).alias("cap"))
    return o.join(c, F.col("o_custkey") == F.col("c_custkey")).where("cap = 0 or slot <= cap - sent").select("o_orderkey", "o_custkey", "slot")


@query("SELECT c_custkey, sha256(to_json({'c_custkey': c_custkey, 'c_mktsegment': c_mktsegment, 'c_name': c_name, 'c_nationkey': c_nationkey})::VARCHAR) AS fingerprint FROM customer")
def record_fingerprint(spark, folder):
    fields = F.struct("c_custkey", "c_mktsegment", "c_name", "c_nationkey")
    return table(spark, folder, "customer").select("c_custkey", F.sha2(F.to_json(fields, {"ignoreNullFields": "false"}), 256).alias("fingerprint"))


@query("SELECT doc_id, array_to_string(list_sort(list_distinct(string_split(lower(array_to_string(regexp_extract_all(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:[.][A-Za-z0-9-]+)+'), ',')), ','))), ',') AS emails FROM documents WHERE regexp_matches(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:[.][A-Za-z0-9-]+)+')")
def contact_emails(spark, folder):
    d = table(spark, folder, "documents").where(F.contains("text", F.lit("@"))).select("doc_id", emails(F.col("text")).alias("found"))
    return d.where(F.size("found") > 0).select("doc_id", F.array_join("found", ",").alias("emails"))


@query("SELECT user_id, arg_min(ts, event_id) AS first_seen, max(ts) AS last_seen, arg_max(event_type, event_id) AS last_type, count(*) AS n_events FROM events GROUP BY user_id")
def streaming_session_upsert(spark, folder):
    """Session state kept by a drained stream; equal to the batch result."""
    schema = table(spark, folder, "events").schema
    stream = sessions.session_state(sessions.read_events(spark, f"{folder}/events.parque[t]", schema))
    found = sessions.drain(stream, scratch(spark, "sessions"), "user_id")
    return found.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("first_seen", "last_seen")})
