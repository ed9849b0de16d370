"""Queries on ingestion: several unique keys, contracts, canonical JSON and ids, tracked requests, threads, allocation, open tasks."""

from __future__ import annotations

import json

from pyspark.sql import Window
from pyspark.sql import functions as F

from meridix.functions import canonical
from meridix.functions import contract_schemas as schemas
from meridix.operators import allocation, contracts, idempotency, threads, upserts
from meridix.plans.accounts import TRAFFIC, requests
from meridix.plans.registry import query
from meridix.plans.sqltext import quoted
from meridix.sources import intake_store, mail
from meridix.sources.tables import scratch, table
from meridix.streaming import ingestion, sessions

# Three keys a row: the event's own, a source's and one of its content; rows chain across them.
KEYED = "SELECT event_id, 'i' || (event_id % 4000) AS own_key, CASE WHEN event_id % 7 <> 0 THEN 's' || (event_id // 3) END AS source_key, CASE WHEN event_id % 5 <> 0 THEN user_id || ':' || event_type || ':' || CAST(CAST(ts AS DATE) AS VARCHAR) END AS ingest_key FROM events"
_LEAST = " AND ".join(f"({k} IS NULL OR event_id = min(CASE WHEN open THEN event_id END) OVER (PARTITION BY {k}))" for k in ("own_key", "source_key", "ingest_key"))
_TAKEN = " OR ".join(f"({k} IS NOT NULL AND bool_or(wins) OVER (PARTITION BY {k}))" for k in ("own_key", "source_key", "ingest_key"))


@query(f"""
WITH RECURSIVE turns AS (
    SELECT 0 AS turn, event_id, own_key, source_key, ingest_key, true AS open, false AS stays, true AS more FROM ({KEYED})
    UNION ALL
    SELECT turn + 1, event_id, own_key, source_key, ingest_key, open AND NOT taken, stays OR wins, bool_or(open AND NOT taken) OVER () FROM (
        SELECT *, ({_TAKEN}) AS taken FROM (SELECT *, open AND {_LEAST} AS wins FROM turns WHERE more)))
SELECT event_id, own_key, source_key, ingest_key FROM turns WHERE stays AND NOT more
""")
def multi_key_idempotency(spark, folder):
    """Events that stay when each is inserted unless one that stayed shares any of three keys; what was dropped blocks nobody."""
    i = F.col("event_id")
    content = F.concat_ws(":", F.col("user_id").cast("string"), "event_type", F.col("ts").cast("date").cast("string"))
    e = table(spark, folder, "events").select("event_id", F.concat(F.lit("i"), i % 4000).alias("own_key"), F.when(i % 7 != 0, F.concat(F.lit("s"), F.expr("event_id div 3"))).alias("source_key"), F.when(i % 5 != 0, content).alias("ingest_key"))
    return idempotency.first_accepted(e, "event_id", ["own_key", "source_key", "ingest_key"])


_UUID = "11111111-1111-4111-8111-111111111111"
_EVENT = {"event_id": _UUID, "schema_version": "1", "event_type": "link_clicked", "occurred_at": "2024-01-01T00:00:00Z", "source_system": "web", "environment": "staging", "correlation_id": "c-{id}", "confidence": 0.4, "payload": {"n": 1}, "account_id": None}
_TREATMENT = {k: _UUID for k in ("enrollment_id", "campaign_id", "sequence_step_id", "strategy_version_id", "offer_version_id", "message_version_id", "cta_version_id", "sequence_version_id")} | {"schema_version": "1", "person_id": "p-{id}", "account_id": "a", "recipient_email": "x{id}@example.com", "subject": "Hello", "body_text": "Text", "headers": {"X-A": "b"}, "rendered_at": "2024-01-01T00:00:00Z", "asset": None}
_REQUEST = {k: _UUID for k in ("send_id", "campaign_id", "sequence_step_id", "mailbox_id")} | {"schema_version": "1", "idempotency_key": "k-{id}", "person_id": "p", "scheduled_at": "2024-01-01T00:00:00Z", "treatment": _TREATMENT}
_DECISION = {"decision_id": "dup_{id}", "source_record_id": "sr_{id}", "duplicate_type": "replay", "rule_id": "r", "matched_source_record_ids": ["sr_1", "sr_2"], "comparison_keys": {}, "decided_at": "2024-01-01T00:00:00Z", "decision_version": "1"}


def _without(payload: dict, name: str) -> dict:
    return {k: v for k, v in payload.items() if k != name}


#: (contract, payload, what a reader of the contract finds wrong first; None: nothing). Each rule is broken once.
CASES = [
    ("tracking_event", _EVENT, None), ("tracking_event", _EVENT | {"extra": 1}, "additionalProperties"), ("tracking_event", _without(_EVENT, "payload"), "required payload"),
    ("tracking_event", _EVENT | {"event_id": "no-uuid"}, "event_id: format uuid"), ("tracking_event", _EVENT | {"event_type": ""}, "event_type: minLength"), ("tracking_event", _EVENT | {"environment": "lab"}, "environment: enum"),
    ("tracking_event", _EVENT | {"confidence": 1.5}, "confidence: maximum"), ("tracking_event", _EVENT | {"confidence": -1}, "confidence: minimum"), ("tracking_event", _EVENT | {"confidence": "0.4"}, "confidence: type"), ("tracking_event", _EVENT | {"account_id": 5}, "account_id: type"),
    ("strict_send_request", _REQUEST, None), ("strict_send_request", _REQUEST | {"treatment": _TREATMENT | {"recipient_email": "nobody"}}, "treatment.recipient_email: format email"),
    ("strict_send_request", _REQUEST | {"treatment": _without(_TREATMENT, "subject")}, "treatment: required subject"), ("strict_send_request", _REQUEST | {"treatment": _TREATMENT | {"headers": {"X-A": "b", "X-N": 3}}}, "treatment.headers.X-N: type"),
    ("strict_send_request", _REQUEST | {"treatment": _TREATMENT | {"more": {}}}, "treatment: additionalProperties"), ("send_request", _REQUEST | {"treatment": {"invalid": True}}, None), ("send_request", _REQUEST | {"treatment": "none"}, "treatment: type"),
    ("duplicate_decision", _DECISION, None), ("duplicate_decision", _DECISION | {"duplicate_type": "maybe"}, "duplicate_type: enum"), ("duplicate_decision", _DECISION | {"matched_source_record_ids": ["sr_1", "x"]}, "matched_source_record_ids.1: minLength"),
    ("duplicate_decision", _DECISION | {"matched_source_record_ids": {}}, "matched_source_record_ids: type"), ("duplicate_decision", [_DECISION], "type"),
]
CONTRACTS = {"tracking_event": schemas.TRACKING_EVENT, "send_request": schemas.SEND_REQUEST, "strict_send_request": schemas.STRICT_SEND_REQUEST, "duplicate_decision": schemas.DUPLICATE_DECISION}
_KNOWN = "CASE event_id % " + str(len(CASES)) + " " + " ".join(f"WHEN {k} THEN {quoted(wrong) if wrong else 'NULL'}" for k, (_, _, wrong) in enumerate(CASES)) + " END"


@query(f"SELECT event_id, [{', '.join(quoted(c) for c, _, _ in CASES)}][(event_id % {len(CASES)} + 1)::INT] AS contract, {_KNOWN} AS failure, ({_KNOWN}) IS NULL AS accepted FROM events")
def contract_validation(spark, folder):
    """Payloads against their contracts, nested ones included: the first rule that each breaks, and where. The twin holds what the payloads were made to break."""
    k = (F.col("event_id") % len(CASES)).cast("int")
    payload = F.replace(F.element_at(F.array(*[F.lit(json.dumps(p)) for _, p, _ in CASES]), k + 1), F.lit("{id}"), F.col("event_id").cast("string"))
    e = table(spark, folder, "events").select("event_id", F.element_at(F.array(*[F.lit(c) for c, _, _ in CASES]), k + 1).alias("contract"), payload.alias("payload"))
    failure = F.lit("unknown contract")
    for name, schema in CONTRACTS.items():
        failure = F.when(F.col("contract") == name, contracts.contract_failure(F.col("payload"), schema)).otherwise(failure)
    return e.select("event_id", "contract", failure.alias("failure")).withColumn("accepted", F.col("failure").isNull())


@query("""SELECT event_id, '{"event":{"k":[' || event_id || ',null,"é"],"type":"' || event_type || '"},"user":' || user_id || '}' AS canonical, sha256('{"event":{"k":[' || event_id || ',null,"é"],"type":"' || event_type || '"},"user":' || user_id || '}') AS fingerprint FROM events""")
def canonical_json_fingerprint(spark, folder):
    """Nested payloads, spelled two ways by turns: the order of names and white space change neither the canonical form nor its digest."""
    one, other = '{ "user" : %d, "event": {"type":"%s", "k": [%d, null, "é"]} }', '{"event":{"k":[%3$d,null,"\\u00e9"],"type":"%2$s"},"user":%1$d}'
    text = lambda form: F.format_string(form, "user_id", "event_type", "event_id")
    e = table(spark, folder, "events").select("event_id", canonical.canonical_json(F.when(F.col("event_id") % 2 == 0, text(one)).otherwise(text(other))).alias("canonical"))
    return e.withColumn("fingerprint", canonical.fingerprint(F.col("canonical")))


_N = lambda c: f"coalesce('\"' || {c} || '\"', 'null')"
_KEY = "CASE WHEN s_suppkey % 4 <> 0 THEN 'k' || s_suppkey END"
_RAW = """sha256('{"domain":"' || s_suppkey || '.example","merchant_name":"' || s_name || '"}')"""


@query(f"""
WITH r AS (SELECT s_suppkey, s_name, {_KEY} AS key, {_RAW} AS raw FROM supplier),
sr AS (SELECT *, 'sr_' || substr(sha256('{{"raw_fingerprint":"' || raw || '","source_name":"scraper city","source_record_key":' || {_N('key')} || '}}'), 1, 40) AS record_id FROM r),
ld AS (SELECT *, 'lead_' || substr(sha256(CASE WHEN key IS NULL THEN '{{"source_name":"scraper city","source_record_id":"' || record_id || '","source_record_key":null}}' ELSE '{{"source_name":"scraper city","source_record_key":"' || key || '"}}' END), 1, 40) AS lead_id FROM sr)
SELECT s_suppkey, raw AS raw_fingerprint, record_id, lead_id,
    'obs_' || substr(sha256('{{"canonical_field":"display_name","lead_id":"' || lead_id || '","normalized_value":"' || s_name || '","source_field_name":"merchant_name"}}'), 1, 40) AS observation_id,
    'finding_' || substr(sha256('{{"code":"MISSING","field":null,"lead_id":"' || lead_id || '","observed_value_ref":' || {_N('key')} || ',"rule_id":"r1","source_record_id":"' || record_id || '","validation_version":"v1"}}'), 1, 40) AS finding_id,
    'dup_' || substr(sha256('{{"rule_id":"dedupe","source_record_id":"' || record_id || '"}}'), 1, 40) AS decision_id,
    sha256('{{"adapter_version":"a1","mapped_fields":[{{"canonical_field":"display_name","raw_value":"' || s_name || '","source_field_name":"merchant_name"}}],"source_name":"scraper city","source_record_key":' || {_N('key')} || ',"source_version":"1"}}') AS source_fingerprint
FROM ld
""")
def derived_record_ids(spark, folder):
    """A source record's fingerprints and the ids of the record, its lead, an observation, a finding and a duplicate decision."""
    k = F.col("s_suppkey").cast("string")
    s = table(spark, folder, "supplier").select("s_suppkey", "s_name", F.when(F.col("s_suppkey") % 4 != 0, F.concat(F.lit("k"), k)).alias("key"), canonical.fingerprint(canonical.stable_json(merchant_name=F.col("s_name"), domain=F.concat(k, F.lit(".example")))).alias("raw_fingerprint"))
    source, key, lit = F.lit("  Scraper City "), F.col("key"), F.lit
    s = s.withColumn("record_id", canonical.source_record_id(source, key, F.col("raw_fingerprint")))
    s = s.withColumn("lead_id", canonical.lead_id(source, key, F.col("record_id")))
    record, lead = F.col("record_id"), F.col("lead_id")
    mapped = F.array(F.struct(lit("display_name").alias("canonical_field"), lit("merchant_name").alias("source_field_name"), F.col("s_name").alias("raw_value")))
    return s.select(
        "s_suppkey", "raw_fingerprint", "record_id", "lead_id",
        canonical.observation_id(lead, lit("merchant_name"), lit("display_name"), F.col("s_name")).alias("observation_id"),
        canonical.finding_id(record, lead, lit("r1"), lit(None).cast("string"), lit("MISSING"), key, lit("v1")).alias("finding_id"),
        canonical.duplicate_decision_id(record, lit("dedupe")).alias("decision_id"),
        canonical.source_fingerprint(lit("scraper city"), lit("1"), key, lit("a1"), mapped).alias("source_fingerprint"),
    )


LINKS = "SELECT c_custkey, c_custkey % 9 = 0 AS revoked, CASE WHEN c_custkey % 4 = 0 THEN TIMESTAMP '2024-01-05' + INTERVAL 1 DAY * (c_custkey % 25) END AS expires_at, CASE WHEN c_custkey % 3 <> 0 THEN c_custkey END AS person_id, 'acc-' || c_nationkey AS account_id, CASE WHEN c_custkey % 5 <> 0 THEN c_mktsegment END AS campaign_id, CASE c_custkey % 2 WHEN 0 THEN 'asset' ELSE 'page' END AS link_type FROM customer"
MET = f"SELECT e.event_id, e.event_id AS arrival, e.ts, l.*, user_id % 40 AS session_no, CASE WHEN e.event_id % 6 <> 0 THEN 'link:tok-' || c_custkey || ':' || (e.event_id % 200) END AS ingest_key, traffic FROM ({TRAFFIC}) e JOIN ({LINKS}) l ON c_custkey = user_id + e.event_id % 5 WHERE NOT revoked AND (expires_at IS NULL OR expires_at > ts)"


def _ingested(spark, folder) -> str:
    """Run the events as a stream of requests; the folder with what was kept."""
    c, k = table(spark, folder, "customer"), F.col("c_custkey")
    start = F.lit("2024-01-05").cast("timestamp")
    links = c.select(
        F.concat(F.lit("tok-"), k).alias("token"), F.when(k % 9 == 0, start).alias("revoked_at"), F.when(k % 4 == 0, start + F.make_dt_interval((k % 25).cast("int"))).alias("expires_at"),
        F.when(k % 3 != 0, k).alias("person_id"), F.concat(F.lit("acc-"), "c_nationkey").alias("account_id"), F.when(k % 5 != 0, F.col("c_mktsegment")).alias("campaign_id"),
        F.lit(None).cast("string").alias("send_id"), F.when(k % 2 == 0, "asset").otherwise("page").alias("link_type"),
    )
    i = F.col("event_id")
    stream = requests(sessions.read_events(spark, f"{folder}/events.parque[t]", table(spark, folder, "events").schema)).select(
        i.alias("arrival"), i.cast("string").alias("event_id"), F.lit(None).cast("string").alias("source_event_id"), F.concat(F.lit("tok-"), F.col("user_id") + i % 5).alias("token"),
        F.when(i % 6 != 0, (i % 200).cast("string")).alias("idempotency_key"), (F.col("user_id") % 40).cast("string").alias("session_id"), F.col("ts").alias("occurred_at"), "agent", "method", "repeats", "accept", "client_hints", "fetch_mode",
    )
    path = scratch(spark, "ingest")
    ingestion.ingest(stream, links, path)
    return path


@query(f"SELECT event_id, ingest_key, traffic, account_id FROM (SELECT *, CASE WHEN ingest_key IS NULL THEN 1 ELSE row_number() OVER (PARTITION BY ingest_key ORDER BY arrival) END AS place FROM ({MET})) WHERE place = 1")
def tracked_events(spark, folder):
    """Requests of live links, classified and kept once an ingest key, through a stream."""
    found = spark.read.parquet(f"{_ingested(spark, folder)}/events")
    return found.select(F.col("event_id").cast("long").alias("event_id"), "ingest_key", "traffic", "account_id")


_LATEST = lambda c: f"arg_max({c}, arrival) FILTER (WHERE {c} IS NOT NULL)"


@query(f"SELECT CAST(session_no AS VARCHAR) AS session_id, arg_min(ts, arrival) AS first_seen, max(ts) AS last_seen, count(*) AS n, {_LATEST('person_id')} AS person_id, {_LATEST('account_id')} AS account_id, {_LATEST('campaign_id')} AS campaign_id, arg_max(link_type, arrival) AS last_link_type FROM ({MET}) GROUP BY session_no")
def tracked_sessions(spark, folder):
    """Sessions of the same stream: each identity is the latest that was known, duplicates of events count as visits."""
    s = ingestion.current_sessions(spark, _ingested(spark, folder))
    time = lambda c: F.col(c).cast("timestamp_ntz").alias(c)
    return s.select("session_id", time("first_seen"), time("last_seen"), "n", "person_id", "account_id", "campaign_id", F.col("metadata")["last_link_type"].alias("last_link_type"))


@query("SELECT conv_id, turn, 'm' || conv_id || '.' || first AS root FROM (SELECT *, min(turn) OVER (PARTITION BY conv_id) AS first FROM conversations)")
def thread_roots(spark, folder):
    """The first message of each turn's conversation, found from references alone: turns name the one before, and every second one also two before it, as shortened headers do."""
    c = table(spark, folder, "conversations").where("conv_id is not null and turn is not null")
    turn = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn"))
    name = lambda t: F.concat(F.lit("m"), F.col("conv_id"), F.lit("."), t)
    before, two = F.lag("turn", 1).over(Window.partitionBy("conv_id").orderBy("turn")), F.lag("turn", 2).over(Window.partitionBy("conv_id").orderBy("turn"))
    m = c.select("conv_id", "turn", name(F.col("turn")).alias("message_id"), name(before).alias("in_reply_to"), F.when((turn % 2 == 1) & two.isNotNull(), F.concat_ws(" ", name(two), name(before))).alias("references"))
    return m.join(threads.thread_roots(m), "message_id").select("conv_id", "turn", "root")


ALLOCATED = "(VALUES (1, 'a', 40.0), (2, 'b', 35.5), (3, 'c', -1.0)) v(position, variant, share)"
SHARES = f"SELECT n_nationkey AS experiment, position, variant, CASE WHEN n_nationkey % 7 = 0 THEN 60 WHEN position = 3 THEN n_nationkey % 3 * 10 ELSE share END AS pct FROM nation, {ALLOCATED} WHERE n_nationkey % 11 <> 5"
_BUCKET = "CAST(('0x' || substr(sha256(c_nationkey || ':' || c_custkey), 1, 16))::UBIGINT % 10000 AS INT)"


@query(f"""
WITH ranged AS (SELECT experiment, variant, (sum(pct) OVER w - pct) * 100 AS low, sum(pct) OVER w * 100 AS high, sum(pct) OVER (PARTITION BY experiment) <= 100.000001 AS valid FROM ({SHARES}) WINDOW w AS (PARTITION BY experiment ORDER BY position)),
known AS (SELECT experiment, bool_and(valid) AS valid FROM ranged GROUP BY experiment)
SELECT c_nationkey AS experiment, c_custkey AS subject, {_BUCKET} AS bucket, r.variant, CASE WHEN k.experiment IS NULL THEN 'no_variants' WHEN NOT k.valid THEN 'invalid_allocation' WHEN r.variant IS NULL THEN 'unallocated' ELSE 'assigned' END AS status
FROM customer LEFT JOIN known k ON k.experiment = c_nationkey LEFT JOIN ranged r ON r.experiment = c_nationkey AND k.valid AND {_BUCKET} >= low AND {_BUCKET} < high
""")
def variant_allocation(spark, folder):
    """Each customer's variant in the experiment of their nation, by the cumulative ranges of its allocation table."""
    n = table(spark, folder, "nation").where("n_nationkey % 11 != 5").select("n_nationkey", F.explode(F.array(*[F.struct(F.lit(p).alias("position"), F.lit(v).alias("variant"), F.lit(s).alias("share")) for p, v, s in ((1, "a", 40.0), (2, "b", 35.5), (3, "c", -1.0))])).alias("v"))
    pct = F.when(F.col("n_nationkey") % 7 == 0, 60).when(F.col("v.position") == 3, F.col("n_nationkey") % 3 * 10).otherwise(F.col("v.share"))
    shares = n.select(F.col("n_nationkey").alias("experiment"), "v.position", "v.variant", pct.alias("allocation_pct"))
    return allocation.assign_variants(table(spark, folder, "customer").select(F.col("c_nationkey").alias("experiment"), F.col("c_custkey").alias("subject")), shares)


_OP = "CASE event_type WHEN 'purchase' THEN 'done' WHEN 'error' THEN 'claim' ELSE 'upsert' END"


@query(f"""
WITH c AS (SELECT user_id, event_id, ts, value, event_type, {_OP} AS op, coalesce(sum(CAST({_OP} = 'done' AS INT)) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS piece FROM events),
placed AS (SELECT *, bool_or(op = 'upsert') OVER (PARTITION BY user_id, piece ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS there FROM c),
held AS (SELECT * FROM placed WHERE there)
SELECT user_id, arg_min(event_id, (ts, event_id)) AS task_id, arg_max(event_type, (ts, event_id)) FILTER (WHERE op = 'upsert') AS event_type, arg_max(value, (ts, event_id)) FILTER (WHERE op = 'upsert') AS value,
    coalesce(CASE arg_max(op, (ts, event_id)) FILTER (WHERE op <> 'upsert') WHEN 'claim' THEN 'claimed' WHEN 'done' THEN 'done' END, 'open') AS status, min(ts) AS created_at, max(ts) AS updated_at, count_if(op = 'upsert') AS n_upserts
FROM held GROUP BY user_id, piece
""")
def open_task_upserts(spark, folder):
    """Tasks of each user under a key that only open tasks hold: an upsert replaces the open task or opens one; a purchase closes it."""
    op = F.when(F.col("event_type") == "purchase", "done").when(F.col("event_type") == "error", "claim").otherwise("upsert")
    e = table(spark, folder, "events").select("user_id", "event_id", "ts", "value", "event_type", op.alias("op"))
    return upserts.open_tasks(e, ["user_id"], "ts", "event_id", ["event_type", "value"])


@query("""
WITH c AS (SELECT conv_id, turn, text, min(turn) OVER w AS first, lag(turn) OVER (PARTITION BY conv_id ORDER BY turn) AS before FROM conversations WINDOW w AS (PARTITION BY conv_id))
SELECT conv_id || '.' || turn AS uid, '<m' || conv_id || '.' || turn || '@x>' AS message_id, CASE WHEN turn % 5 = 4 THEN '' ELSE 'jo' || conv_id || '@example.com' END AS sender, 'Gruß ' || conv_id AS subject,
    CASE WHEN before IS NULL THEN '<m' || conv_id || '.' || turn || '@x>' ELSE '<m' || conv_id || '.' || CASE WHEN turn % 2 = 0 THEN first ELSE before END || '@x>' END AS thread_key, sha256(trim(text)) AS body_sha256, CASE WHEN turn % 5 = 4 THEN 'sender_invalid' END AS error FROM c
""")
def parsed_mail(spark, folder):
    """Conversations written as raw mail, plain or in parts with an attachment, and read back."""
    c, by = table(spark, folder, "conversations"), Window.partitionBy("conv_id").orderBy("turn")
    name = lambda t: F.concat(F.lit("<m"), F.col("conv_id"), F.lit("."), t, F.lit("@x>"))
    first, before = F.min("turn").over(Window.partitionBy("conv_id")), F.lag("turn").over(by)
    c = c.select("conv_id", "turn", "text", name(F.col("turn")).alias("own"), name(before).alias("answers"), name(first).alias("root"))
    line = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts], F.lit("\n"))
    refers = F.when(F.col("answers").isNull(), "").when(F.col("turn") % 2 == 0, line("References: ", F.col("root"), " ", F.col("answers"))).otherwise(line("In-Reply-To: ", F.col("answers")))
    sender = F.when(F.col("turn") % 5 == 4, "nobody").otherwise(F.concat(F.lit("Jo Doe <JO"), "conv_id", F.lit("@Example.com>")))
    head = F.concat(line("Message-ID: ", F.col("own")), line("From: ", sender), line("Subject: =?utf-8?q?Gru=C3=9F?= ", F.col("conv_id").cast("string")), refers, F.lit("MIME-Version: 1.0\n"))
    kind, transfer = "Content-Type: text/plain; charset=utf-8\n", "Content-Transfer-Encoding: 8bit\n\n"
    parts = F.concat(F.lit(f"Content-Type: multipart/mixed; boundary=BOUND\n\n--BOUND\n{kind}{transfer}"), "text", F.lit(f"\n--BOUND\n{kind}Content-Disposition: attachment; filename=a.txt\n\nno text of the mail\n--BOUND--\n"))
    raw = F.concat(head, F.when(F.col("turn") % 3 == 1, parts).otherwise(F.concat(F.lit(kind + transfer), "text")))
    m = mail.parsed(c.select(F.concat("conv_id", F.lit("."), "turn").alias("uid"), raw.cast("binary").alias("raw")))
    return m.select("uid", "message_id", F.when(F.col("error").isNull(), F.col("sender")).otherwise("").alias("sender"), "subject", "thread_key", F.sha2("body", 256).alias("body_sha256"), "error")


# Three deliveries of the suppliers: the second repeats and changes some, the third repeats all of the second.
_STATE = "CASE WHEN n % 7 = 0 THEN 'QUARANTINED' WHEN n % 5 = 0 THEN 'ACCEPTED_WITH_WARNINGS' WHEN n % 11 = 0 THEN 'DUPLICATE' ELSE 'ACCEPTED' END"
_ROUNDS = ("TRUE", "n % 2 = 0 OR n % 7 = 0", "n % 2 = 0 OR n % 7 = 0")


@query(f"""
WITH r AS (SELECT s_suppkey AS n, s_name FROM supplier),
b0 AS (SELECT *, {_STATE} AS state FROM r),
b1 AS (SELECT n, CASE WHEN n % 26 = 0 THEN 'COLLISION' WHEN n % 7 <> 0 THEN 'REPLAY_NOOP' ELSE 'STORED' END AS outcome FROM r WHERE {_ROUNDS[1]}),
b2 AS (SELECT n, CASE WHEN n % 26 = 0 THEN 'COLLISION' WHEN n % 7 <> 0 OR n % 14 = 0 THEN 'REPLAY_NOOP' ELSE 'STORED' END AS outcome FROM r WHERE {_ROUNDS[2]})
SELECT 'outcome.' || outcome AS name, count(*) AS n FROM (SELECT 'STORED' AS outcome FROM b0 UNION ALL SELECT outcome FROM b1 UNION ALL SELECT outcome FROM b2) GROUP BY outcome
UNION ALL SELECT 'records', count(*) FROM r UNION ALL SELECT 'observations', 2 * count(*) FROM r UNION ALL SELECT 'findings', count(*) FROM r WHERE n % 7 = 0
UNION ALL SELECT 'quarantined', count(*) FROM r WHERE n % 7 = 0 AND (n % 14 <> 0 OR n % 26 = 0) UNION ALL SELECT 'leads', count(*) FROM r WHERE n % 7 <> 0 OR n % 14 = 0 AND n % 26 <> 0
""")
def intake_persistence(spark, folder):
    """Intake results fanned out to records, states, observations, findings, leads and quarantine, delivered three times with repeats, collisions and records that leave quarantine."""
    path, n = scratch(spark, "intake"), F.col("n")
    s, outcomes = table(spark, folder, "supplier").select(F.col("s_suppkey").alias("n"), "s_name"), None
    for batch, chosen in enumerate(_ROUNDS):
        # From the second delivery on every 26th record has other content, and every 14th is accepted at last.
        state = F.expr(_STATE) if batch == 0 else F.when(n % 14 == 0, "ACCEPTED").otherwise(F.expr(_STATE))
        key = F.concat(F.lit("sr_"), n)
        content = F.sha2(F.concat("s_name", F.when((n % 26 == 0) & F.lit(batch > 0), "!").otherwise("")), 256)
        lead = F.when(state != "QUARANTINED", F.concat(F.lit("lead_"), n))
        observed = F.array(*[F.struct(F.concat(F.lit(f"obs_{f}_"), n).alias("observation_id"), F.lit(f).alias("field"), F.col("s_name").alias("value")) for f in ("display_name", "domain")])
        found = F.filter(F.array(F.struct(F.when(state == "QUARANTINED", F.concat(F.lit("finding_"), n)).alias("finding_id"), F.lit("INVALID_DOMAIN").alias("code"))), lambda f: f["finding_id"].isNotNull())
        results = s.where(chosen).select(n.alias("seq"), key.alias("source_record_id"), content.alias("raw_fingerprint"), state.alias("state"), lead.alias("lead_id"), F.col("s_name").alias("display_name"), F.lit("x.example").alias("domain"), observed.alias("observations"), found.alias("findings"))
        done = intake_store.persist(results, path, batch).select(F.concat(F.lit("outcome."), "outcome").alias("name"))
        outcomes = done if outcomes is None else outcomes.union(done)
    rows = {name: spark.read.parquet(f"{path}/{name}") for name in ("records", "observations", "findings")} | {"quarantined": intake_store.quarantined(spark, path), "leads": intake_store.leads(spark, path)}
    for name, own in rows.items():
        outcomes = outcomes.union(own.select(F.lit(name).alias("name")))
    return outcomes.groupBy("name").agg(F.count(F.lit(1)).alias("n"))
