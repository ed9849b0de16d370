"""Queries on behaviour events and accounts: intent, routing, sessions, traffic, retention."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from meridix.functions.text import decimal, stable_bucket
from meridix.operators import folds, scoring, windows
from meridix.plans.registry import query
from meridix.sources.tables import table

TODAY = "2024-01-31"
RULES = "(VALUES " + ", ".join(f"('{t}', CAST({w} AS DOUBLE), {h})" for t, w, h in scoring.SIGNALS) + ") r(event_type, weight, half_life)"
COMPONENTS = f"""SELECT user_id, event_type, event_id, greatest(0, datediff('day', CAST(ts AS DATE), DATE '{TODAY}')) AS age_days, weight * pow(2.0::DOUBLE, -greatest(0, datediff('day', CAST(ts AS DATE), DATE '{TODAY}'))::DOUBLE / half_life) AS value FROM (SELECT e.*, r.weight, r.half_life, row_number() OVER (PARTITION BY user_id, e.event_type ORDER BY event_id) AS k FROM events e JOIN {RULES} ON e.event_type = r.event_type WHERE weight > 0) WHERE k = 1"""
SCORES = f"""SELECT user_id, count(*) AS n_signals, CAST(round(sum(value), 4) AS DECIMAL(18, 4)) AS raw_intent, CAST(round(least(10.0, greatest(0.0, sum(value))), 2) AS DECIMAL(18, 2)) AS intent FROM ({COMPONENTS}) GROUP BY user_id"""


@query(f"SELECT *, CASE WHEN intent >= 3 THEN 'hot' WHEN intent >= 1.5 THEN 'warm' ELSE 'cold' END AS band FROM ({SCORES})")
def intent_decay_score(spark, folder):
    s = scoring.intent_scores(table(spark, folder, "events"), TODAY)
    return s.withColumn("band", F.when(F.col("intent") >= 3, "hot").when(F.col("intent") >= 1.5, "warm").otherwise("cold"))


@query(f"SELECT user_id, event_type, event_id, CAST(age_days AS INT) AS age_days, CAST(round(value, 4) AS DECIMAL(18, 4)) AS value FROM ({COMPONENTS})")
def score_component_ledger(spark, folder):
    return scoring.intent_components(table(spark, folder, "events"), TODAY).withColumn("value", decimal(F.col("value"), 4))


REPEATED = "SELECT event_id % 5000 AS event_key, event_id, user_id, event_type FROM events WHERE event_id % 7 <> 0 UNION ALL SELECT NULL, event_id, user_id, event_type FROM events WHERE event_id % 7 = 0"


@query(f"SELECT event_key, min(event_id) AS event_id, arg_min(user_id, event_id) AS user_id, arg_min(event_type, event_id) AS event_type FROM ({REPEATED}) WHERE event_key IS NOT NULL GROUP BY event_key UNION ALL SELECT * FROM ({REPEATED}) WHERE event_key IS NULL")
def event_idempotent_dedupe(spark, folder):
    """The first event of each key counts, whatever later ones say; events without a key never collide."""
    key = F.when(F.col("event_id") % 7 != 0, F.col("event_id") % 5000)
    e = table(spark, folder, "events").select(key.alias("event_key"), "event_id", "user_id", "event_type")
    first = e.where("event_key is not null").groupBy("event_key").agg(F.min(F.struct("event_id", "user_id", "event_type")).alias("first"))
    return first.select("event_key", "first.*").unionByName(e.where("event_key is null"))


@query("SELECT user_id, arg_min(ts, event_id) AS first_seen, max(ts) AS last_seen, arg_max(event_type, event_id) AS last_type, arg_max(event_type, event_id) FILTER (WHERE event_type <> 'error') AS last_good_type, count(*) AS n_events FROM events GROUP BY user_id")
def session_rollup(spark, folder):
    e = table(spark, folder, "events")
    good = F.max_by("event_type", F.when(F.col("event_type") != "error", F.col("event_id")))
    return e.groupBy("user_id").agg(F.min_by("ts", "event_id").alias("first_seen"), F.max("ts").alias("last_seen"), F.max_by("event_type", "event_id").alias("last_type"), good.alias("last_good_type"), F.count(F.lit(1)).alias("n_events"))


@query("SELECT user_id, session_no, count(*) AS n_events, min(ts) AS started, max(ts) AS ended FROM (SELECT user_id, ts, CAST(sum(CASE WHEN gap > INTERVAL 240 MINUTE THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS session_no FROM (SELECT *, ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS gap FROM events)) GROUP BY ALL")
def session_gap_windows(spark, folder):
    s = windows.sessions_by_gap(table(spark, folder, "events"), "user_id", "ts", "event_id", 240)
    return s.groupBy("user_id", "session_no").agg(F.count(F.lit(1)).alias("n_events"), F.min("ts").alias("started"), F.max("ts").alias("ended"))


# Requests have no headers in the tables; agents of all ten kinds, near misses and browsers follow from an event's id, in the query and its twin alike.
AGENTS = ("Mozilla/5.0 (X11)", "GoogleImageProxy", "Mozilla/5.0 Proofpoint", "Mimecast-1", "barracuda/2", "urlscan.io", "HeadlessChrome/9", "PhantomJS", "news-crawler", "Baiduspider", "FeedBot/2", "superbot", "robotics lab", "botanist", "Mozilla/5.0 (Mac)", None)
LISTED = "[" + ", ".join("NULL" if a is None else f"'{a}'" for a in AGENTS) + "]"
TRAFFIC = f"""SELECT event_id, user_id, ts, CASE WHEN scanner > 0 THEN 'automated' WHEN upper(method) NOT IN ('GET', 'HEAD') THEN 'unknown' WHEN repeats >= 20 AND mode IS NULL THEN 'automated' WHEN hints >= 2 AND agent IS NOT NULL THEN 'human_candidate' ELSE 'unknown' END AS traffic,
CASE WHEN scanner > 0 THEN 'scanner_' || scanner WHEN upper(method) NOT IN ('GET', 'HEAD') THEN 'non_browser_method' WHEN repeats >= 20 AND mode IS NULL THEN 'high_repeat_without_fetch_metadata' WHEN hints >= 2 AND agent IS NOT NULL THEN 'coherent_browser_hints' ELSE 'insufficient_evidence' END AS reason
FROM (SELECT *, CASE WHEN agent IS NULL THEN 0 ELSE coalesce(list_position([agent ILIKE '%' || p || '%' FOR p IN ['googleimageproxy', 'proofpoint', 'mimecast', 'barracuda', 'urlscan', 'headlesschrome', 'phantomjs', 'crawler', 'spider']] || [lower(agent) IN ('feedbot/2', 'superbot')], true), 0) END AS scanner, CAST(user_id % 2 = 0 AS INT) + CAST(user_id % 3 = 0 AS INT) + CAST(mode IS NOT NULL AS INT) AS hints
FROM (SELECT event_id, user_id, ts, {LISTED}[(event_id % 16 + 1)::INT] AS agent, CASE event_id % 11 WHEN 0 THEN 'head' WHEN 1 THEN 'POST' ELSE 'GET' END AS method, event_id % 25 AS repeats, CASE WHEN user_id % 5 < 3 THEN 'navigate' END AS mode FROM events))"""


def requests(events):
    """Events as requests, with the headers that AGENTS and the ids give them."""
    i = F.col("event_id")
    agent = F.element_at(F.array(*map(F.lit, AGENTS)), (i % 16 + 1).cast("int"))
    method = F.when(i % 11 == 0, "head").when(i % 11 == 1, "POST").otherwise("GET")
    header = lambda holds, value: F.when(holds, value)
    return events.withColumns({"agent": agent, "method": method, "repeats": i % 25, "accept": header(F.col("user_id") % 2 == 0, "text/html"), "client_hints": header(F.col("user_id") % 3 == 0, "x"), "fetch_mode": header(F.col("user_id") % 5 < 3, "navigate")})


def _traffic(spark, folder):
    label, why = scoring.traffic_class(*(F.col(c) for c in ("agent", "method", "repeats", "accept", "client_hints", "fetch_mode")))
    return requests(table(spark, folder, "events")).select("event_id", "user_id", label.alias("traffic"), why.alias("reason"))


@query(f"SELECT event_id, user_id, traffic, reason, CAST(CASE traffic WHEN 'automated' THEN 0.1 WHEN 'human_candidate' THEN 0.8 ELSE 0.4 END AS DECIMAL(3, 2)) AS confidence FROM ({TRAFFIC})")
def traffic_classification(spark, folder):
    return _traffic(spark, folder).withColumn("confidence", scoring.confidence(F.col("traffic")))


@query(f"SELECT user_id, count(*) AS n_human FROM ({TRAFFIC}) WHERE traffic <> 'automated' GROUP BY user_id")
def human_engagement(spark, folder):
    return _traffic(spark, folder).where("traffic != 'automated'").groupBy("user_id").agg(F.count(F.lit(1)).alias("n_human"))


@query("SELECT event_type, count_if(ts < TIMESTAMP '2024-01-16') AS purged, count_if(ts >= TIMESTAMP '2024-01-16') AS kept FROM events GROUP BY event_type")
def retention_purge_counts(spark, folder):
    cutoff = F.lit("2024-01-16").cast("timestamp_ntz")
    return table(spark, folder, "events").groupBy("event_type").agg(F.count_if(F.col("ts") < cutoff).alias("purged"), F.count_if(F.col("ts") >= cutoff).alias("kept"))


@query("SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 3600 SECOND PRECEDING AND CURRENT ROW) AS last_hour FROM events")
def repeat_rate_window(spark, folder):
    return windows.trailing_count(table(spark, folder, "events"), ["user_id"], "ts", 3600, "last_hour").select("event_id", "last_hour")


@query("SELECT user_id, sum(CAST(json_extract_string(props, '$.k') AS BIGINT))::BIGINT AS k_sum, max(CAST(json_extract_string(props, '$.k') AS BIGINT)) AS k_max, count(DISTINCT json_extract_string(props, '$.k')) AS k_kinds FROM events GROUP BY user_id")
def json_payload_rollup(spark, folder):
    k = F.get_json_object("props", "$.k")
    return table(spark, folder, "events").groupBy("user_id").agg(F.sum(k.cast("long")).alias("k_sum"), F.max(k.cast("long")).alias("k_max"), F.countDistinct(k).alias("k_kinds"))


@query("SELECT user_id, event_type, arg_max(value, event_id) AS value, max(event_id) AS version, min(ts) AS created_at FROM events GROUP BY user_id, event_type")
def upsert_latest_wins(spark, folder):
    e = table(spark, folder, "events").select("user_id", "event_type", "value", F.col("event_id").alias("version"), F.col("ts").alias("created_at"))
    return windows.upsert_latest(e.where("version % 2 = 0"), e.where("version % 2 = 1"), ["user_id", "event_type"], "version", "created_at")


# An event as an observation of a contact; every seventh is an answer, every eleventh finds the contact connected.
KINDS = {"signup": "connection_request_sent", "click": "message_sent", "purchase": "Connection_Accepted ", "error": "opt_out", "view": "profile_viewed"}
SEEN = "CASE WHEN event_id % 7 = 0 THEN 'replied' WHEN event_id % 11 = 0 OR event_type = 'purchase' THEN 'active' WHEN event_type IN ('signup', 'click') THEN 'awaiting_reply' WHEN event_type = 'error' THEN 'suppressed' END"
NEXT_AT = "TIMESTAMP '2024-01-10' + INTERVAL 1 DAY * (event_id % 12)"


@query(f"""WITH o AS (SELECT user_id, event_id, {SEEN} AS settled, ts >= {NEXT_AT} AS late, {NEXT_AT} AS next_at FROM events)
SELECT user_id, count(*) AS n_events, list_reduce(['new'] || list(coalesce(settled, CASE WHEN late THEN 'late' ELSE '' END) ORDER BY event_id), lambda s, x: CASE WHEN x = 'late' AND s = 'awaiting_reply' THEN 'follow_up_due' WHEN x IN ('late', '') THEN s ELSE x END) AS state, arg_max(CASE WHEN coalesce(settled, 'active') IN ('active', 'awaiting_reply') THEN [next_at] ELSE [NULL] END, event_id)[1] AS next_action_at FROM o GROUP BY user_id""")
def contact_state_machine(spark, folder):
    i, e = F.col("event_id"), table(spark, folder, "events")
    kind = F.element_at(F.create_map(*[F.lit(x) for pair in KINDS.items() for x in pair]), F.col("event_type"))
    due = F.lit("2024-01-10").cast("timestamp_ntz") + F.make_dt_interval((i % 12).cast("int"))
    o = e.select("user_id", "event_id", kind.alias("event"), (i % 7 == 0).alias("inbound_message"), F.when(i % 11 == 0, True).alias("connected"), F.col("ts").alias("observed_at"), due.alias("next_action_at"))
    return folds.fold_states(o, "user_id", "event_id", "new")


BUCKET = "CAST(('0x' || substr(sha256('exp-1:' || c_custkey), 1, 16))::UBIGINT % 10000 AS INT)"


@query(f"SELECT c_custkey, {BUCKET} AS bucket, CASE WHEN {BUCKET} < 4000 THEN 'a' WHEN {BUCKET} < 7500 THEN 'b' END AS variant FROM customer")
def stable_variant_assignment(spark, folder):
    c = table(spark, folder, "customer").select("c_custkey", stable_bucket(F.concat(F.lit("exp-1:"), F.col("c_custkey").cast("string"))).alias("bucket"))
    return c.withColumn("variant", F.when(F.col("bucket") < 4000, "a").when(F.col("bucket") < 7500, "b"))


@query("SELECT event_type, CAST(date_trunc('day', ts) AS DATE) AS day, count(*) AS n, CAST(round(sum(CAST(value AS DECIMAL(18, 4))), 4) AS DECIMAL(18, 4)) AS total_value FROM events GROUP BY ALL")
def daily_event_rollup(spark, folder):
    return table(spark, folder, "events").groupBy("event_type", F.col("ts").cast("date").alias("day")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("value").cast("decimal(18,4)")).cast("decimal(18,4)").alias("total_value"))


@query("SELECT user_id, event_id, CAST(round(value - lag(value) OVER (PARTITION BY user_id ORDER BY event_id), 6) AS DECIMAL(18, 6)) AS change FROM events")
def value_change_ledger(spark, folder):
    w = Window.partitionBy("user_id").orderBy("event_id")
    return table(spark, folder, "events").select("user_id", "event_id", decimal(F.col("value") - F.lag("value").over(w), 6).alias("change"))
