"""Queries on claims of queued work: windows, caps since local midnight, leases, reclaim, fencing, threads, JSON payloads."""

from __future__ import annotations

from pyspark.sql import functions as F

from meridix.operators import windows
from meridix.plans.people import pick
from meridix.plans.registry import query
from meridix.plans.sqltext import quoted
from meridix.sources.tables import table

NOW = "1998-03-01 02:30:00"
# Orders are sends, nations campaigns and suppliers mailboxes; what these tables lack follows from their keys.
OFFSETS = {"+00:00": 0, "-05:00": -300, "+05:30": 330, "+01:00": 60}
ZONES = [*OFFSETS]
SEND = {
    "send_id": "o_orderkey", "person_id": "o_custkey", "campaign_id": "CAST(o_orderkey % 25 AS INT)", "mailbox_id": "CAST(o_orderkey % 97 AS BIGINT)",
    "status": "CASE o_orderstatus WHEN 'O' THEN 'queued' WHEN 'P' THEN 'claiming' ELSE 'sent' END", "attempts": "CAST(o_orderkey % 4 AS INT)",
    "next_attempt_at": "CASE WHEN o_orderkey % 3 = 0 THEN o_orderdate + INTERVAL '2' HOUR END", "scheduled_at": "o_orderdate", "lease_until": "CASE WHEN o_orderstatus = 'P' AND o_orderkey % 5 <> 0 THEN o_orderdate + INTERVAL '10' MINUTE END",
}
CAMPAIGN = {
    "campaign": "CAST(n_nationkey AS INT)", "campaign_zone": pick(ZONES, "n_nationkey"), "opens": "CASE WHEN n_nationkey % 3 <> 0 THEN '01:00:00' END", "closes": "CASE WHEN n_nationkey % 3 = 1 THEN '12:00:00' WHEN n_nationkey % 3 = 2 THEN '22:30:00' END",
    "campaign_limit": "CASE n_nationkey % 5 WHEN 0 THEN 0 WHEN 1 THEN 1 WHEN 2 THEN 2 ELSE 500 END", "campaign_active": "n_nationkey % 11 <> 5",
}
MAILBOX = {"mailbox": "s_suppkey", "mailbox_zone": pick([*ZONES, ""], "s_suppkey"), "mailbox_limit": "CASE s_suppkey % 4 WHEN 0 THEN 0 WHEN 1 THEN 1 ELSE 50 END", "health": pick(["healthy", "unknown", "caution", "blocked"], "s_suppkey"), "mailbox_domain": "'m' || s_suppkey || '.example.com'"}
PERSON = {"person": "c_custkey", "address": "CASE WHEN c_custkey % 17 = 0 THEN ' ' ELSE 'P' || c_custkey || '@Example.com' END"}
OFFSET = "CASE {} " + " ".join(f"WHEN '{z}' THEN INTERVAL '{m}' MINUTE" for z, m in OFFSETS.items()) + " ELSE INTERVAL '0' MINUTE END"


def _sql(fields: dict) -> str:
    return ", ".join(f"{sql} AS {name}" for name, sql in fields.items())


def _read(spark, folder, name: str, fields: dict):
    return table(spark, folder, name).selectExpr(*[f"{sql} AS {field}" for field, sql in fields.items()])


def _zone(zone):
    return F.when(F.coalesce(zone, F.lit("")) == "", "+00:00").otherwise(zone)


def _local(ts, zone):
    """A UTC time as the zone's clock shows it."""
    return F.convert_timezone(F.lit("UTC"), _zone(zone), ts)


def _midnight(now, zone):
    """The last local midnight of a zone, in UTC."""
    return F.convert_timezone(_zone(zone), F.lit("UTC"), F.date_trunc("day", _local(now, zone)).cast("timestamp_ntz"))


def _sent_today(sends, owners, key: str, owner: str, zone: str, name: str):
    """Per owner the sends since its local midnight, no correlated scan: sends are counted by owner and minute first (every zone's midnight is a whole minute), and only those counts meet the owners."""
    now = F.lit(NOW).cast("timestamp_ntz")
    sent = sends.where("status = 'sent'").groupBy(F.col(key).alias("_key"), F.date_trunc("minute", "scheduled_at").alias("_minute")).agg(F.count(F.lit(1)).alias("_n"))
    met = sent.join(owners.select(F.col(owner).alias("_key"), F.col(zone).alias("_zone")), "_key")
    return met.where(F.col("_minute") >= _midnight(now, F.col("_zone"))).groupBy("_key").agg(F.sum("_n").alias(name))


MIDNIGHT = "date_trunc('day', TIMESTAMP '" + NOW + "' + {0}) - {0}"
CLAIMABLE = f"""
sends AS (SELECT {_sql(SEND)} FROM orders), campaigns AS (SELECT {_sql(CAMPAIGN)} FROM nation), mailboxes AS (SELECT {_sql(MAILBOX)} FROM supplier), people AS (SELECT {_sql(PERSON)} FROM customer),
by_campaign AS (SELECT campaign, count(status) AS campaign_sent FROM campaigns LEFT JOIN sends ON campaign_id = campaign AND status = 'sent' AND scheduled_at >= {MIDNIGHT.format(OFFSET.format('campaign_zone'))} GROUP BY campaign),
by_mailbox AS (SELECT mailbox, count(status) AS mailbox_sent FROM mailboxes LEFT JOIN sends ON mailbox_id = mailbox AND status = 'sent' AND scheduled_at >= {MIDNIGHT.format(OFFSET.format('mailbox_zone'))} GROUP BY mailbox),
claimable AS (SELECT * FROM sends JOIN people ON person_id = person JOIN campaigns ON campaign_id = campaign JOIN mailboxes ON mailbox_id = mailbox JOIN by_campaign USING (campaign) JOIN by_mailbox USING (mailbox)
    WHERE (status = 'queued' AND coalesce(next_attempt_at, scheduled_at) <= TIMESTAMP '{NOW}' OR status = 'claiming' AND lease_until IS NOT NULL AND lease_until <= TIMESTAMP '{NOW}')
      AND campaign_active AND health IN ('healthy', 'unknown', 'caution') AND trim(address) <> '' AND person % 19 <> 0
      AND NOT EXISTS (SELECT 1 FROM conversations WHERE role = 'user' AND CAST(conv_id AS VARCHAR) = CAST(person_id AS VARCHAR))
      AND (opens IS NULL OR closes IS NULL OR strftime(TIMESTAMP '{NOW}' + CASE WHEN mailbox_zone = '' THEN {OFFSET.format('campaign_zone')} ELSE {OFFSET.format('mailbox_zone')} END, '%H:%M:%S') BETWEEN opens AND closes)
      AND (campaign_limit = 0 OR campaign_sent < campaign_limit) AND (mailbox_limit = 0 OR mailbox_sent < mailbox_limit))
"""


def _claimable(spark, folder):
    """Sends that may be claimed now: due or with an expired lease, everything active and sound, nobody suppressed or replied, the window open, no cap reached (0 is no cap)."""
    now = F.lit(NOW).cast("timestamp_ntz")
    sends, campaigns, mailboxes, people = (_read(spark, folder, *x) for x in (("orders", SEND), ("nation", CAMPAIGN), ("supplier", MAILBOX), ("customer", PERSON)))
    by_campaign = _sent_today(sends, campaigns, "campaign_id", "campaign", "campaign_zone", "campaign_sent").withColumnRenamed("_key", "campaign")
    by_mailbox = _sent_today(sends, mailboxes, "mailbox_id", "mailbox", "mailbox_zone", "mailbox_sent").withColumnRenamed("_key", "mailbox")
    due = ((F.col("status") == "queued") & (F.coalesce("next_attempt_at", "scheduled_at") <= now)) | ((F.col("status") == "claiming") & (F.col("lease_until") <= now))
    campaigns = campaigns.where("campaign_active").join(by_campaign, "campaign", "left").where("campaign_limit = 0 or coalesce(campaign_sent, 0) < campaign_limit")
    mailboxes = mailboxes.where("health in ('healthy', 'unknown', 'caution')").join(by_mailbox, "mailbox", "left").where("mailbox_limit = 0 or coalesce(mailbox_sent, 0) < mailbox_limit")
    replied = table(spark, folder, "conversations").where("role = 'user'").select(F.col("conv_id").cast("string").alias("replied")).distinct()
    people = people.where("trim(address) <> '' and person % 19 <> 0").join(replied, F.col("person").cast("string") == F.col("replied"), "left_anti")
    j = sends.where(due).join(people, F.col("person_id") == F.col("person")).join(campaigns, F.col("campaign_id") == F.col("campaign")).join(mailboxes, F.col("mailbox_id") == F.col("mailbox"))
    clock = F.date_format(_local(now, F.when(F.col("mailbox_zone") == "", F.col("campaign_zone")).otherwise(F.col("mailbox_zone"))), "HH:mm:ss")
    return j.where(F.col("opens").isNull() | F.col("closes").isNull() | clock.between(F.col("opens"), F.col("closes")))


ORDER = "CASE WHEN status = 'claiming' THEN 0 ELSE 1 END, CASE WHEN status = 'claiming' THEN lease_until ELSE coalesce(next_attempt_at, scheduled_at) END, send_id"


@query(f"WITH {CLAIMABLE} SELECT send_id, person_id, campaign_id, mailbox_id, status FROM claimable")
def claim_eligibility(spark, folder):
    """All sends that a worker might claim now."""
    return _claimable(spark, folder).select("send_id", "person_id", "campaign_id", "mailbox_id", "status")


@query(f"""
WITH {CLAIMABLE} SELECT send_id, lower(trim(address)) AS recipient, attempts + 1 AS attempts, TIMESTAMP '{NOW}' + INTERVAL '10' MINUTE AS lease_until, '<' || send_id || '@' || mailbox_domain || '>' AS message_id, status = 'claiming' AS reclaimed
FROM (SELECT * FROM claimable ORDER BY {ORDER} LIMIT 100)
""")
def claim_batch(spark, folder):
    """The next 100 claims, expired leases first, as the claim leaves them: one attempt more, a lease of ten minutes, a message id."""
    order = [F.when(F.col("status") == "claiming", 0).otherwise(1), F.when(F.col("status") == "claiming", F.col("lease_until")).otherwise(F.coalesce("next_attempt_at", "scheduled_at")), F.col("send_id")]
    lease = F.lit(NOW).cast("timestamp_ntz") + F.expr("INTERVAL '10' MINUTE")
    message = F.concat(F.lit("<"), F.col("send_id").cast("string"), F.lit("@"), "mailbox_domain", F.lit(">"))
    return _claimable(spark, folder).orderBy(*order).limit(100).select("send_id", F.lower(F.trim("address")).alias("recipient"), (F.col("attempts") + 1).alias("attempts"), lease.alias("lease_until"), message.alias("message_id"), (F.col("status") == "claiming").alias("reclaimed"))


CAPS = f"""
SELECT campaign, campaign_limit, campaign_sent, campaign_limit = 0 OR campaign_sent < campaign_limit AS allowed, {MIDNIGHT.format(OFFSET.format('campaign_zone'))} AS since
FROM by_campaign JOIN campaigns USING (campaign)
"""


@query(f"WITH {CLAIMABLE} {CAPS}")
def cap_eligibility(spark, folder):
    """Sends of each campaign since midnight on its own clock, against its limit; a limit of 0 is none."""
    now = F.lit(NOW).cast("timestamp_ntz")
    sends, campaigns = _read(spark, folder, "orders", SEND), _read(spark, folder, "nation", CAMPAIGN)
    sent = _sent_today(sends, campaigns, "campaign_id", "campaign", "campaign_zone", "campaign_sent").withColumnRenamed("_key", "campaign")
    n = F.coalesce("campaign_sent", F.lit(0)).cast("long")
    return campaigns.join(sent, "campaign", "left").select("campaign", "campaign_limit", n.alias("campaign_sent"), ((F.col("campaign_limit") == 0) | (n < F.col("campaign_limit"))).alias("allowed"), _midnight(now, F.col("campaign_zone")).alias("since"))


# Claims (by line) of jobs (by order): a worker and a token that grows; results come from workers that may have lost their lease.
JOBS = "SELECT l_orderkey AS job_id, l_linenumber AS token, 'w' || l_suppkey % 7 AS worker, l_shipdate AS claimed_at, l_shipdate + INTERVAL '2' DAY AS lease_until, l_shipdate + to_days(CAST(l_partkey % 5 AS INT)) AS done_at, l_returnflag AS flag FROM lineitem"
RULED = "CASE WHEN token < newest THEN 'stale_token' WHEN done_at > lease_until THEN 'lease_expired' WHEN flag = 'R' THEN 'failed' ELSE 'completed' END"


@query(f"SELECT job_id, token, worker, {RULED} AS outcome FROM (SELECT *, max(token) OVER (PARTITION BY job_id) AS newest FROM ({JOBS}))")
def lease_fencing(spark, folder):
    """What becomes of a worker's result: only the newest token within its lease may write."""
    j = table(spark, folder, "lineitem").select(
        F.col("l_orderkey").alias("job_id"), F.col("l_linenumber").alias("token"), F.concat(F.lit("w"), (F.col("l_suppkey") % 7).cast("string")).alias("worker"),
        (F.col("l_shipdate") + F.expr("INTERVAL '2' DAY")).alias("lease_until"), (F.col("l_shipdate") + F.make_dt_interval((F.col("l_partkey") % 5).cast("int"))).alias("done_at"), F.col("l_returnflag").alias("flag"),
    )
    newest = j.groupBy("job_id").agg(F.max("token").alias("newest"))
    outcome = F.when(F.col("token") < F.col("newest"), "stale_token").when(F.col("done_at") > F.col("lease_until"), "lease_expired").when(F.col("flag") == "R", "failed").otherwise("completed")
    return j.join(newest, "job_id").select("job_id", "token", "worker", outcome.alias("outcome"))


QUEUE = "SELECT event_id AS job_id, ts AS created_at, CASE event_type WHEN 'view' THEN 'pending' WHEN 'click' THEN 'processing' ELSE 'complete' END AS status, CAST(user_id % 6 AS INT) AS attempts, CASE WHEN event_id % 4 <> 0 THEN ts + INTERVAL '120' SECOND END AS lease_until FROM events"


@query(f"SELECT job_id, attempts + 1 AS attempts, TIMESTAMP '2024-01-20 00:02:00' AS lease_until FROM ({QUEUE}) WHERE attempts < 5 AND (status = 'pending' OR status = 'processing' AND lease_until <= TIMESTAMP '2024-01-20 00:00:00') ORDER BY created_at, job_id LIMIT 100")
def analysis_queue_claim(spark, folder):
    """The 100 oldest analysis jobs that are pending, or whose lease ran out, and have attempts left."""
    e = table(spark, folder, "events")
    status = F.when(F.col("event_type") == "view", "pending").when(F.col("event_type") == "click", "processing").otherwise("complete")
    now = F.lit("2024-01-20 00:00:00").cast("timestamp_ntz")
    j = e.select(F.col("event_id").alias("job_id"), F.col("ts").alias("created_at"), status.alias("status"), (F.col("user_id") % 6).cast("int").alias("attempts"), F.when(F.col("event_id") % 4 != 0, F.col("ts") + F.expr("INTERVAL '120' SECOND")).alias("lease"))
    free = (F.col("status") == "pending") | ((F.col("status") == "processing") & (F.col("lease") <= now))
    claimed = j.where(free & (F.col("attempts") < 5)).orderBy("created_at", "job_id").limit(100)
    return claimed.select("job_id", (F.col("attempts") + 1).alias("attempts"), F.lit("2024-01-20 00:02:00").cast("timestamp_ntz").alias("lease_until"))


THREADS = "SELECT conv_id, min(turn) AS first_turn, arg_min(role, turn) AS opened_by FROM conversations GROUP BY conv_id"
INBOUND = "SELECT event_id, CASE WHEN event_id % 3 <> 0 THEN event_id % 400 END AS thread, lower(trim(CASE WHEN event_id % 2 = 0 THEN ' P' ELSE 'p' END || user_id || '@Example.com ')) AS sender FROM events"


@query(f"""
SELECT event_id, CASE WHEN t.conv_id IS NOT NULL THEN 'thread' WHEN o.o_custkey IS NOT NULL THEN 'enrollment' ELSE 'unknown' END AS matched_by, coalesce(t.conv_id, o.o_custkey) AS person_id, CASE WHEN t.conv_id IS NULL THEN o.o_orderkey END AS enrollment_id
FROM ({INBOUND}) i LEFT JOIN ({THREADS}) t ON thread = t.conv_id LEFT JOIN (SELECT lower('P' || o_custkey || '@example.com') AS address, o_custkey, o_orderkey FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1) o ON sender = address
""")
def reply_identity(spark, folder):
    """Whom an inbound message is from: its thread if that is known, else the latest enrollment of the sender's address."""
    e = table(spark, folder, "events")
    sender = F.lower(F.trim(F.concat(F.when(F.col("event_id") % 2 == 0, " P").otherwise("p"), F.col("user_id").cast("string"), F.lit("@Example.com "))))
    i = e.select("event_id", F.when(F.col("event_id") % 3 != 0, F.col("event_id") % 400).alias("thread"), sender.alias("sender"))
    threads = table(spark, folder, "conversations").select("conv_id").distinct()
    latest = windows.first_wins(table(spark, folder, "orders"), ["o_custkey"], [F.desc("o_orderdate"), F.desc("o_orderkey")])
    latest = latest.select(F.lower(F.concat(F.lit("P"), F.col("o_custkey").cast("string"), F.lit("@example.com"))).alias("address"), "o_custkey", "o_orderkey")
    j = i.join(threads, F.col("thread") == F.col("conv_id"), "left").join(latest, F.col("sender") == F.col("address"), "left")
    by = F.when(F.col("conv_id").isNotNull(), "thread").when(F.col("o_custkey").isNotNull(), "enrollment").otherwise("unknown")
    return j.select("event_id", by.alias("matched_by"), F.coalesce("conv_id", "o_custkey").alias("person_id"), F.when(F.col("conv_id").isNull(), F.col("o_orderkey")).alias("enrollment_id"))


@query("SELECT 'inbound' AS direction, conv_id, turn, length(coalesce(text, '')) AS n FROM conversations WHERE role = 'user' UNION ALL SELECT 'outbound', o_custkey, o_orderkey, length(o_orderstatus) FROM orders JOIN (SELECT DISTINCT conv_id FROM conversations) ON o_custkey = conv_id WHERE o_orderstatus = 'F'")
def message_timeline(spark, folder):
    """Messages in and out of the known conversations, in one table."""
    c = table(spark, folder, "conversations")
    inbound = c.where("role = 'user'").select(F.lit("inbound").alias("direction"), "conv_id", "turn", F.length(F.coalesce("text", F.lit(""))).cast("long").alias("n"))
    known = table(spark, folder, "orders").where("o_orderstatus = 'F'").join(c.select("conv_id").distinct(), F.col("o_custkey") == F.col("conv_id"), "left_semi")
    return inbound.unionByName(known.select(F.lit("outbound").alias("direction"), F.col("o_custkey").alias("conv_id"), F.col("o_orderkey").alias("turn"), F.length("o_orderstatus").cast("long").alias("n")))


# A campaign's configuration by nation: names, window, limits, steps (suppliers of the nation) and their versions.
CONFIG = {"name": "CASE WHEN n_nationkey % 6 = 0 THEN ' ' ELSE n_name END", "limit_": "CASE WHEN n_nationkey % 7 = 0 THEN -1 ELSE n_nationkey END", "opens": "n_nationkey % 5", "closes": "n_nationkey % 4 + 2"}
CODES = [("trim(name) = ''", "NAME_MISSING"), ("limit_ < 0", "NEGATIVE_LIMIT"), ("opens >= closes", "EMPTY_WINDOW"), ("steps = 0", "NO_STEPS"), ("steps <> numbers OR steps <> last_no", "STEPS_NOT_CONTIGUOUS"), ("unversioned > 0", "STEP_WITHOUT_MESSAGE"), ("active > 3", "TOO_MANY_ACTIVE_STEPS")]
STEPS = "SELECT s_nationkey, count(*) AS steps, count(DISTINCT s_suppkey % 5 + 1) AS numbers, max(s_suppkey % 5 + 1) AS last_no, count_if(s_suppkey % 8 = 0) AS unversioned, count_if(s_acctbal > 0) AS active FROM supplier GROUP BY s_nationkey"


@query(f"""
SELECT n_nationkey, array_to_string(list_filter([{', '.join(f"CASE WHEN {c} THEN '{k}' END" for c, k in CODES)}], lambda x: x IS NOT NULL), ',') AS errors FROM (
    SELECT n_nationkey, {_sql(CONFIG)}, coalesce(steps, 0) AS steps, coalesce(numbers, 0) AS numbers, coalesce(last_no, 0) AS last_no, coalesce(unversioned, 0) AS unversioned, coalesce(active, 0) AS active
    FROM nation LEFT JOIN ({STEPS}) ON n_nationkey = s_nationkey)
""")
def campaign_configuration(spark, folder):
    """All that stands against activating a campaign: its own settings, and whether its steps are there, contiguous and versioned."""
    number = F.col("s_suppkey") % 5 + 1
    steps = table(spark, folder, "supplier").groupBy("s_nationkey").agg(
        F.count(F.lit(1)).alias("steps"), F.countDistinct(number).alias("numbers"), F.max(number).alias("last_no"), F.count_if(F.col("s_suppkey") % 8 == 0).alias("unversioned"), F.count_if(F.col("s_acctbal") > 0).alias("active"))
    n = table(spark, folder, "nation").selectExpr("n_nationkey", *[f"{sql} AS {k}" for k, sql in CONFIG.items()]).join(steps, F.col("n_nationkey") == F.col("s_nationkey"), "left")
    n = n.fillna(0, ["steps", "numbers", "last_no", "unversioned", "active"])
    return n.select("n_nationkey", F.array_join(F.array_compact(F.array(*[F.when(F.expr(c), k) for c, k in CODES])), ",").alias("errors"))


TEMPLATES = ["Hi {{ first_name }}, greetings from {{ company.city }}.", "{{company.name}} and {{ first_name }}", "Plain text", "{{ missing }} here", "Dear {{ first_name }} of {{ company.name }}: {{ company.city }}"]
VALUES = {"first_name": "CASE WHEN c_custkey % 9 = 0 THEN ' ' ELSE c_name END", "company.name": "c_mktsegment", "company.city": "CASE WHEN c_custkey % 7 <> 0 THEN 'City ' || c_nationkey END"}
SLOT = r"\{{\{{\s*{}\s*\}}\}}"


def _filled_sql() -> str:
    out = "template"
    for k in VALUES:
        pattern = SLOT.format(k.replace(".", r"\."))
        out = f"CASE WHEN regexp_matches({out}, {quoted(pattern)}) AND trim(coalesce(\"{k}\", '')) <> '' THEN regexp_replace({out}, {quoted(pattern)}, \"{k}\", 'g') ELSE {out} END"
    return out


@query(f"""
SELECT c_custkey, CASE WHEN left_over = '' THEN rendered END AS rendered, left_over AS missing FROM (
    SELECT c_custkey, rendered, array_to_string(list_sort(list_distinct(regexp_extract_all(rendered, '\\{{\\{{\\s*([A-Za-z0-9_.]+)\\s*\\}}\\}}', 1))), ', ') AS left_over FROM (
        SELECT c_custkey, {_filled_sql()} AS rendered FROM (SELECT c_custkey, {pick(TEMPLATES, 'c_custkey')} AS template, {', '.join(f'{sql} AS "{k}"' for k, sql in VALUES.items())} FROM customer)))
""")
def template_rendering(spark, folder):
    """Templates with dotted placeholders filled in; a missing or blank value leaves no text but the names of what is missing."""
    c = table(spark, folder, "customer").selectExpr("c_custkey", f"{pick(TEMPLATES, 'c_custkey')} AS template", *[f"{sql} AS v{k}" for k, sql in enumerate(VALUES.values())])
    text = F.col("template")
    for k, name in enumerate(VALUES):
        value = F.when(F.trim(F.coalesce(f"v{k}", F.lit(""))) != "", F.col(f"v{k}"))
        # A dollar or backslash in a value is text, not a reference to a group.
        plain = F.regexp_replace(value, r"([\\$])", r"\\$1")
        text = F.when(value.isNotNull(), F.regexp_replace(text, F.lit(SLOT.format(name.replace(".", r"\."))), plain)).otherwise(text)
    missing = F.array_join(F.array_sort(F.array_distinct(F.regexp_extract_all(text, F.lit(r"\{\{\s*([A-Za-z0-9_.]+)\s*\}\}"), F.lit(1)))), ", ")
    return c.select("c_custkey", F.when(missing == "", text).alias("rendered"), missing.alias("missing"))


@query("""
SELECT event_id, json_type(props) AS kind, len(json_keys(props)) AS n_keys, coalesce(json_extract_string(props, '$.account_id'), json_extract_string(props, '$.k'), 'none') AS account, nullif(trim(CASE WHEN event_id % 3 = 0 THEN ' ' ELSE event_type END), '') AS cleaned,
    json_extract_string(json_merge_patch(props, json_object('k', event_id)), '$.k') AS merged, json_object('event_id', event_id, 'event_type', event_type, 'user_id', user_id)::VARCHAR AS as_json FROM events
""")
def json_payload_rules(spark, folder):
    """Kind and keys of a payload, a value with fallbacks, blanks as null, a shallow merge in which the right side wins, and the row as JSON."""
    held = F.from_json("props", "map<string,string>")
    merged = F.map_concat(F.map_filter(held, lambda k, _: k != "k"), F.create_map(F.lit("k"), F.col("event_id").cast("string")))
    blank = F.trim(F.when(F.col("event_id") % 3 == 0, " ").otherwise(F.col("event_type")))
    return table(spark, folder, "events").select(
        "event_id", F.when(F.trim("props").startswith("{"), "OBJECT").when(F.trim("props").startswith("["), "ARRAY").alias("kind"), F.size(F.json_object_keys("props")).cast("long").alias("n_keys"),
        F.coalesce(F.get_json_object("props", "$.account_id"), F.get_json_object("props", "$.k"), F.lit("none")).alias("account"), F.nullif(blank, F.lit("")).alias("cleaned"),
        merged["k"].alias("merged"), F.to_json(F.struct("event_id", "event_type", "user_id")).alias("as_json"),
    )


@query("SELECT o_orderkey, lower(regexp_replace(sha1(unhex('6ba7b8109dad11d180b400c04fd430c8') || CAST(o_orderkey AS VARCHAR)::BLOB), '^(.{8})(.{4}).(.{3})(.)(.{3})(.{12}).*$', '\\1-\\2-5\\3-')) || substr('89ab', CAST(('0x' || substr(sha1(unhex('6ba7b8109dad11d180b400c04fd430c8') || CAST(o_orderkey AS VARCHAR)::BLOB), 17, 1))::INT % 4 + 1 AS INT), 1) || substr(sha1(unhex('6ba7b8109dad11d180b400c04fd430c8') || CAST(o_orderkey AS VARCHAR)::BLOB), 18, 3) || '-' || substr(sha1(unhex('6ba7b8109dad11d180b400c04fd430c8') || CAST(o_orderkey AS VARCHAR)::BLOB), 21, 12) AS message_uuid FROM orders")
def message_uuids(spark, folder):
    """Name-based (version 5) UUIDs of sends."""
    h = F.sha1(F.concat(F.unhex(F.lit("6ba7b8109dad11d180b400c04fd430c8")), F.col("o_orderkey").cast("string").cast("binary")))
    part = lambda at, n: F.substring(h, at, n)
    variant = F.substring(F.lit("89ab"), (F.conv(part(17, 1), 16, 10).cast("int") % 4 + 1), F.lit(1))
    return table(spark, folder, "orders").select("o_orderkey", F.concat(part(1, 8), F.lit("-"), part(9, 4), F.lit("-5"), part(14, 3), F.lit("-"), variant, part(18, 3), F.lit("-"), part(21, 12)).alias("message_uuid"))
