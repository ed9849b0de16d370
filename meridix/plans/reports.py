"""Queries on sequences, enrollments, evidence, ledgers and reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from meridix.operators import windows
from meridix.plans.people import pick
from meridix.plans.registry import query
from meridix.plans.sqltext import listed
from meridix.sources import tables
from meridix.sources.tables import table
from meridix.streaming import sessions

NOW = "1998-03-01 00:00:00"
# Orders are enrollments, line items the steps of their sequence versions.
ENROLLED = "SELECT o_orderkey AS enrollment_id, o_custkey AS person_id, CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'P' THEN 'active' ELSE 'enrolled' END AS status, CAST(o_orderkey % 5 AS INT) AS step_no, CASE WHEN o_orderkey % 3 <> 0 THEN o_orderdate END AS next_action_at FROM orders"


@query(f"""
SELECT enrollment_id, step_no + 1 AS next_step, CAST(TIMESTAMP '{NOW}' + to_days(CAST(delay AS INT)) AS TIMESTAMP) AS scheduled_at FROM ({ENROLLED}) JOIN (
    SELECT l_orderkey, l_linenumber, CAST(min(l_quantity) AS INT) % 14 AS delay FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) = 1) ON l_orderkey = enrollment_id AND l_linenumber = step_no + 1
WHERE status NOT IN ('replied', 'completed', 'suppressed', 'bounced', 'cancelled') AND step_no < 4 AND (next_action_at IS NULL OR next_action_at <= TIMESTAMP '{NOW}')
""")
def sequence_next_action(spark, folder):
    """The next step of each open enrollment that is due and has steps left; a step number must be there exactly once."""
    o, now = table(spark, folder, "orders"), F.lit(NOW).cast("timestamp_ntz")
    at = F.when(F.col("o_orderkey") % 3 != 0, F.col("o_orderdate"))
    due = o.where((F.col("o_orderstatus") != "F") & (F.col("o_orderkey") % 5 < 4) & (at.isNull() | (at <= now))).select("o_orderkey", (F.col("o_orderkey") % 5 + 1).cast("int").alias("next_step"))
    steps = table(spark, folder, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.count(F.lit(1)).alias("n"), (F.min("l_quantity").cast("int") % 14).alias("delay")).where("n = 1")
    j = due.join(steps, (F.col("o_orderkey") == F.col("l_orderkey")) & (F.col("next_step") == F.col("l_linenumber")))
    return j.select(F.col("o_orderkey").alias("enrollment_id"), "next_step", (now + F.make_dt_interval("delay")).alias("scheduled_at"))


@query("SELECT c_custkey, c_custkey % 4 AS variant, coalesce(CASE WHEN c_custkey % 4 = 1 THEN 'subject b' WHEN c_custkey % 4 = 2 AND c_custkey % 9 <> 0 THEN 'subject c' END, n_name) AS subject, CASE WHEN c_custkey % 4 IN (1, 2) THEN 'experiment' ELSE 'base' END AS origin FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE n_nationkey % 6 <> 0")
def treatment_resolution(spark, folder):
    """The treatment of each person: a variant's own fields over those of the base, of usable versions only."""
    n = table(spark, folder, "nation").where("n_nationkey % 6 <> 0")
    c = table(spark, folder, "customer").join(n, F.col("c_nationkey") == F.col("n_nationkey")).withColumn("variant", F.col("c_custkey") % 4)
    own = F.when(F.col("variant") == 1, "subject b").when((F.col("variant") == 2) & (F.col("c_custkey") % 9 != 0), "subject c")
    return c.select("c_custkey", "variant", F.coalesce(own, F.col("n_name")).alias("subject"), F.when(F.col("variant").isin(1, 2), "experiment").otherwise("base").alias("origin"))


@query("SELECT o_orderkey FROM orders o WHERE EXISTS (SELECT 1 FROM lineitem l WHERE l.l_orderkey = o.o_orderkey AND l_suppkey % 100 = o_custkey % 100 AND l_linestatus = o_orderstatus AND l_returnflag = CASE WHEN o_orderstatus = 'F' THEN 'R' ELSE 'N' END) AND EXISTS (SELECT 1 FROM customer WHERE c_custkey = o_custkey AND c_acctbal > 0)")
def enrollment_gate(spark, folder):
    """Enrollments with a review that agrees on four keys, and with a verified contact."""
    o = table(spark, folder, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", (F.col("o_custkey") % 100).alias("k"), F.when(F.col("o_orderstatus") == "F", "R").otherwise("N").alias("flag"))
    reviews = table(spark, folder, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), (F.col("l_suppkey") % 100).alias("k"), F.col("l_linestatus").alias("o_orderstatus"), F.col("l_returnflag").alias("flag"))
    verified = table(spark, folder, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("o_custkey"))
    return o.join(reviews, ["o_orderkey", "k", "o_orderstatus", "flag"], "left_semi").join(verified, "o_custkey", "left_semi").select("o_orderkey")


ASKED = "SELECT o_orderkey + o_orderkey % 2 AS enrollment_id, CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_custkey END AS person, o_orderpriority AS label FROM orders"


@query(f"""
SELECT a.enrollment_id, a.label, CASE WHEN o_orderkey IS NULL THEN 'create' WHEN a.person IS NOT DISTINCT FROM CASE WHEN o_orderkey % 14 = 0 THEN NULL ELSE o_custkey END AND a.label IS NOT DISTINCT FROM o_orderpriority THEN 'replay' ELSE 'conflict' END AS outcome
FROM ({ASKED}) a LEFT JOIN orders ON o_orderkey = a.enrollment_id AND o_orderkey % 4 <> 0
""")
def enrollment_idempotency(spark, folder):
    """A request that repeats a known enrollment is a replay if all agrees, nulls included, and a conflict if not."""
    o = table(spark, folder, "orders")
    asked = o.select((F.col("o_orderkey") + F.col("o_orderkey") % 2).alias("enrollment_id"), F.when(F.col("o_orderkey") % 7 != 0, F.col("o_custkey")).alias("person"), F.col("o_orderpriority").alias("label"))
    known = o.where("o_orderkey % 4 <> 0").select(F.col("o_orderkey").alias("known"), F.when(F.col("o_orderkey") % 14 != 0, F.col("o_custkey")).alias("known_person"), F.col("o_orderpriority").alias("known_label"))
    same = F.col("person").eqNullSafe(F.col("known_person")) & F.col("label").eqNullSafe(F.col("known_label"))
    j = asked.join(known, F.col("enrollment_id") == F.col("known"), "left")
    return j.select("enrollment_id", "label", F.when(F.col("known").isNull(), "create").when(same, "replay").otherwise("conflict").alias("outcome"))


CLAIMS = "SELECT l_orderkey AS claim_id, list_sort(list_distinct(list(l_partkey % 2500))) AS refs FROM lineitem GROUP BY l_orderkey"


@query(f"SELECT claim_id, array_to_string(list_filter(refs, lambda r: r % 7 = 0), ',') AS unknown_refs, coalesce(names, '') AS names, coalesce(n, 0) AS n FROM ({CLAIMS}) LEFT JOIN (SELECT claim_id, string_agg(DISTINCT p_brand, ',' ORDER BY p_brand) AS names, count(*) AS n FROM (SELECT claim_id, unnest(refs) AS r FROM ({CLAIMS})) JOIN part ON p_partkey = r AND r % 7 <> 0 GROUP BY claim_id) USING (claim_id)")
def evidence_references(spark, folder):
    """The evidence that each claim refers to, resolved by id, and the references that no evidence has."""
    held = table(spark, folder, "lineitem").groupBy(F.col("l_orderkey").alias("claim_id")).agg(F.array_sort(F.collect_set(F.col("l_partkey") % 2500)).alias("refs"))
    evidence = table(spark, folder, "part").where("p_partkey % 7 <> 0").select(F.col("p_partkey").alias("r"), "p_brand")
    named = held.select("claim_id", F.explode("refs").alias("r")).join(evidence, "r").groupBy("claim_id").agg(F.array_join(F.array_sort(F.collect_set("p_brand")), ",").alias("names"), F.count(F.lit(1)).alias("n"))
    unknown = F.array_join(F.filter("refs", lambda r: r % 7 == 0), ",")
    return held.join(named, "claim_id", "left").select("claim_id", unknown.alias("unknown_refs"), F.coalesce("names", F.lit("")).alias("names"), F.coalesce("n", F.lit(0)).alias("n"))


@query("SELECT c_custkey, o_orderkey AS run_id, o_orderdate AS completed_at, coalesce(n_lines, 0) AS evidence, coalesce(n_parts, 0) AS people, coalesce(n_late, 0) AS signals FROM customer JOIN (SELECT * FROM orders WHERE o_orderstatus = 'F' QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1) ON c_custkey = o_custkey LEFT JOIN (SELECT l_orderkey, count(*) AS n_lines, count(DISTINCT l_suppkey) AS n_parts, count_if(l_returnflag = 'R') AS n_late FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey ORDER BY completed_at DESC NULLS LAST, c_custkey LIMIT 30")
def recent_companies(spark, folder):
    """The 30 companies with the newest completed run, and what that run found."""
    last = windows.first_wins(table(spark, folder, "orders").where("o_orderstatus = 'F'"), ["o_custkey"], [F.desc("o_orderdate"), F.desc("o_orderkey")])
    top = last.join(table(spark, folder, "customer"), F.col("c_custkey") == F.col("o_custkey")).orderBy(F.desc_nulls_last("o_orderdate"), "c_custkey").limit(30)
    # Only the lines of the runs that stay are counted.
    lines = table(spark, folder, "lineitem").join(F.broadcast(top.select(F.col("o_orderkey").alias("l_orderkey"))), "l_orderkey", "left_semi")
    found = lines.groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("evidence"), F.countDistinct("l_suppkey").alias("people"), F.count_if(F.col("l_returnflag") == "R").alias("signals"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return top.join(found, F.col("o_orderkey") == F.col("l_orderkey"), "left").select("c_custkey", F.col("o_orderkey").alias("run_id"), F.col("o_orderdate").alias("completed_at"), *map(zero, ("evidence", "people", "signals")))


@query("SELECT c_custkey // 20 AS company, string_agg(c_name || ':' || CAST(CAST(c_acctbal AS DECIMAL(18, 2)) AS VARCHAR), ';' ORDER BY c_acctbal DESC, c_name) AS detail, count_if(c_acctbal > 0) AS depth FROM customer GROUP BY 1")
def company_details(spark, folder):
    """The people of each company (twenty at most) in one ordered line, and how many have evidence."""
    entry = F.struct((-F.col("c_acctbal")).alias("a"), F.col("c_name").alias("b"), F.concat("c_name", F.lit(":"), F.col("c_acctbal").cast("decimal(18,2)").cast("string")).alias("c"))
    s = table(spark, folder, "customer").groupBy(F.expr("c_custkey div 20").alias("company")).agg(F.array_sort(F.collect_list(entry)).alias("all"), F.count_if(F.col("c_acctbal") > 0).alias("depth"))
    return s.select("company", F.array_join(F.transform("all", lambda x: x["c"]), ";").alias("detail"), "depth")


@query("SELECT user_id, event_id, event_type, ts, CASE event_type WHEN 'click' THEN 'link' WHEN 'error' THEN 'system' ELSE 'page' END AS surface FROM events WHERE event_type IN ('click', 'view', 'signup')")
def behavioural_timeline(spark, folder):
    """What the timeline view shows: events without address, agent or payload."""
    surface = F.when(F.col("event_type") == "click", "link").when(F.col("event_type") == "error", "system").otherwise("page")
    return table(spark, folder, "events").where(F.col("event_type").isin("click", "view", "signup")).select("user_id", "event_id", "event_type", "ts", surface.alias("surface"))


HANDOFF = ("interested", "question")


@query(f"SELECT conv_id, turn, 'sales_follow_up' AS task, CASE WHEN class = 'interested' THEN 'high' ELSE 'normal' END AS urgency, regexp_matches(uuid, '^[0-9a-f]{{8}}-[0-9a-f]{{4}}-[0-9a-f]{{4}}-[0-9a-f]{{4}}-[0-9a-f]{{12}}$') AS lineage_valid FROM (SELECT conv_id, turn, {pick(['interested', 'negative', 'question', 'other'], 'conv_id + turn')} AS class, CASE WHEN conv_id % 5 = 0 THEN 'x' || conv_id ELSE substr(md5(CAST(conv_id AS VARCHAR)), 1, 8) || '-' || substr(md5(CAST(conv_id AS VARCHAR)), 9, 4) || '-4abc-8abc-' || substr(md5(CAST(conv_id AS VARCHAR)), 21, 12) END AS uuid FROM conversations WHERE role = 'user') WHERE class IN ({listed(HANDOFF)})")
def sales_handoffs(spark, folder):
    """Tasks for the replies that a person should answer, and whether their lineage ids are well formed."""
    digest = F.md5(F.col("conv_id").cast("string").cast("binary"))
    uuid = F.when(F.col("conv_id") % 5 == 0, F.concat(F.lit("x"), F.col("conv_id").cast("string"))).otherwise(F.concat_ws("-", F.substring(digest, 1, 8), F.substring(digest, 9, 4), F.lit("4abc"), F.lit("8abc"), F.substring(digest, 21, 12)))
    c = table(spark, folder, "conversations").where("role = 'user'").withColumn("class", F.expr(pick(["interested", "negative", "question", "other"], "conv_id + turn"))).where(F.col("class").isin(*HANDOFF))
    return c.select("conv_id", "turn", F.lit("sales_follow_up").alias("task"), F.when(F.col("class") == "interested", "high").otherwise("normal").alias("urgency"), uuid.rlike("^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$").alias("lineage_valid"))


@query("SELECT user_id, arg_min(event_id, (ts, event_id)) AS event_id, arg_min(event_type, (ts, event_id)) AS event_type FROM events WHERE user_id % 3 <> 0 GROUP BY user_id")
def insert_ignore_first(spark, folder):
    """Rows whose key the table doesn't hold yet, the first of each key."""
    e = table(spark, folder, "events").select("user_id", "event_id", "event_type", "ts")
    fresh = windows.insert_ignore(e.where("user_id % 3 = 0").select("user_id").distinct(), e, ["user_id"], [F.col("ts"), F.col("event_id")])
    return fresh.select("user_id", "event_id", "event_type")


BINDINGS = {"s_name": "display_name", "s_nationkey": "country_code", "s_phone": "phone", "s_acctbal": "balance"}


@query("SELECT s_suppkey, 'display_name' AS field, s_name AS raw FROM supplier UNION ALL SELECT s_suppkey, 'country_code', CAST(s_nationkey AS VARCHAR) FROM supplier")
def source_adapters(spark, folder):
    """A source's columns as rows of canonical fields, of those that it has."""
    return tables.adapt(table(spark, folder, "supplier").drop("s_acctbal"), BINDINGS)


@query("SELECT n_nationkey, CASE WHEN n_nationkey % 5 <> 0 THEN n_name END AS n_name, n_regionkey FROM nation")
def csv_intake(spark, folder):
    """A CSV whose header must name the schema's columns in order; blanks come back as nulls."""
    path = tables.scratch(spark, "csv")
    n = table(spark, folder, "nation").select("n_nationkey", F.when(F.col("n_nationkey") % 5 != 0, F.col("n_name")).alias("n_name"), "n_regionkey")
    n.write.option("header", True).csv(path)
    return tables.csv_records(spark, path, "n_nationkey int, n_name string, n_regionkey int")


@query("SELECT event_id % 3000 AS key, count(*) AS n FROM (SELECT DISTINCT event_id % 3000 AS event_id FROM events) GROUP BY 1")
def append_only_ledger(spark, folder):
    """Three appends of overlapping keys leave each key once."""
    path = tables.scratch(spark, "ledger")
    for part in range(3):
        tables.append_new(table(spark, folder, "events").where(f"event_id % 3 = {part}").select((F.col("event_id") % 3000).alias("key")), path, ["key"])
    return spark.read.parquet(path).groupBy("key").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT DISTINCT event_id % 4000 AS event_id FROM events")
def streaming_idempotent_events(spark, folder):
    """A stream in which each event id counts once within the watermark's delay."""
    schema = table(spark, folder, "events").schema
    stream = sessions.read_events(spark, f"{folder}/events.parque[t]", schema).withColumn("event_id", F.col("event_id") % 4000)
    return sessions.drain_append(sessions.idempotent(stream, "400 days").select("event_id"), tables.scratch(spark, "stream"))
