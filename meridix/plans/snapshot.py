"""Queries on snapshots and cleanup. Customers are companies, orders runs, line items evidence, suppliers people, events signals."""

from __future__ import annotations

from pyspark.sql import functions as F

from meridix.operators import cleanup, snapshots
from meridix.plans.registry import query
from meridix.sources.tables import table

RUNS = {"run_id": "o_orderkey", "company_id": "o_custkey", "status": "CASE o_orderstatus WHEN 'F' THEN 'completed' ELSE 'failed' END"}
EVIDENCE = {
    "run_id": "l_orderkey", "evidence_id": "l_orderkey * 10 + l_linenumber", "decision_maker_id": "CASE WHEN l_linenumber % 3 <> 0 THEN l_suppkey END", "source_url": "CASE l_returnflag WHEN 'R' THEN NULL WHEN 'A' THEN '  ' ELSE 'https://x.example' END",
    "confidence": "CASE WHEN l_linenumber % 5 <> 0 THEN CAST(l_discount * 10 AS DECIMAL(9, 2)) END", "observed_at": "CAST(l_shipdate AS DATE)", "claim_name": "CASE WHEN l_linenumber % 3 = 0 AND l_partkey % 2 = 0 THEN concat('Supplier ', CAST(l_suppkey AS {text})) END",
}
PEOPLE = {"decision_maker_id": "s_suppkey", "company_id": "s_suppkey * 3", "full_name": "concat('Supplier ', CAST(s_suppkey AS {text}))"}
SIGNALS = {"signal_id": "event_id", "company_id": "user_id", "evidence_id": "CASE WHEN event_id % 3 = 0 THEN (event_id % 5000 + 1) * 10 + 1 END", "signal_date": "CASE WHEN event_id % 4 <> 0 THEN ts END"}
STATUS = "CASE s_suppkey % 4 WHEN 0 THEN 'Verified' WHEN 1 THEN 'deliverable' WHEN 2 THEN 'unknown' END"


def _read(spark, folder, name, fields):
    return table(spark, folder, name).selectExpr(*[f"{sql.format(text='STRING')} AS {c}" for c, sql in fields.items()])


def _sql(name, fields):
    return f"SELECT {', '.join(f'{sql.format(text="VARCHAR")} AS {c}' for c, sql in fields.items())} FROM {name}"


def _quality(spark, folder):
    c = table(spark, folder, "customer").select(F.col("c_custkey").alias("company_id"))
    methods = table(spark, folder, "supplier").select(F.col("s_suppkey").alias("decision_maker_id"), F.explode(F.array(F.lit("email"), F.lit("linkedin"), F.lit("email"))).alias("channel"), F.expr(STATUS).alias("verification_status")).where("decision_maker_id % 3 != 0")
    parts = [_read(spark, folder, t, f) for t, f in (("orders", RUNS), ("lineitem", EVIDENCE), ("supplier", PEOPLE))]
    return snapshots.quality_by_company(*parts, methods, _read(spark, folder, "events", SIGNALS), c.where("company_id % 2 = 0"), c.where("company_id % 3 = 0"))


BY_COMPANY = f"""
WITH runs AS ({_sql('orders', RUNS)}), evidence AS (SELECT e.*, company_id FROM ({_sql('lineitem', EVIDENCE)}) e JOIN runs USING (run_id)), people AS ({_sql('supplier', PEOPLE)}), signals AS ({_sql('events', SIGNALS)}),
methods AS (SELECT s_suppkey AS decision_maker_id, unnest(['email', 'linkedin', 'email']) AS channel, {STATUS} AS verification_status FROM supplier WHERE s_suppkey % 3 <> 0),
enriched AS (SELECT DISTINCT company_id FROM runs WHERE status = 'completed'),
ev AS (SELECT company_id, count(*) AS evidence, count(*) FILTER (WHERE source_url IS NOT NULL AND trim(source_url) <> '') AS evidence_with_url, count(*) FILTER (WHERE confidence >= 0.8) AS high_confidence, sum(confidence) AS confidence, count(confidence) AS rated FROM evidence GROUP BY company_id),
dm AS (SELECT company_id, count(*) AS decision_makers FROM people GROUP BY company_id),
dm_ev AS (SELECT company_id, count(DISTINCT decision_maker_id) AS dm_with_evidence FROM evidence WHERE decision_maker_id IS NOT NULL AND trim(coalesce(source_url, '')) <> '' GROUP BY company_id),
intent AS (SELECT company_id, count(*) AS intent_signals, count(evidence_id) AS intent_with_evidence, count(signal_date) AS intent_dated FROM signals GROUP BY company_id),
mail AS (SELECT company_id, count(*) AS email_candidates, count(*) FILTER (WHERE lower(coalesce(verification_status, '')) IN ('verified', 'deliverable', 'valid')) AS verified_emails FROM people JOIN methods USING (decision_maker_id) WHERE channel = 'email' GROUP BY company_id),
by_company AS (SELECT company_id, {', '.join(f'coalesce({c}, 0) AS {c}' for c in snapshots.COUNTS)}, confidence, rated, c.c_custkey IS NOT NULL AS has_facts, s.c_custkey IS NOT NULL AS has_score
    FROM enriched LEFT JOIN ev USING (company_id) LEFT JOIN dm USING (company_id) LEFT JOIN dm_ev USING (company_id) LEFT JOIN intent USING (company_id) LEFT JOIN mail USING (company_id)
    LEFT JOIN customer c ON c.c_custkey = company_id AND company_id % 2 = 0 LEFT JOIN customer s ON s.c_custkey = company_id AND company_id % 3 = 0)
"""


@query(BY_COMPANY + "SELECT * EXCLUDE (confidence, rated), CAST(round(confidence::DOUBLE / rated, 4) AS DECIMAL(18, 4)) AS avg_confidence FROM by_company")
def quality_companies(spark, folder):
    """What is known of each enriched company."""
    return _quality(spark, folder).withColumn("avg_confidence", F.round("avg_confidence", 4).cast("decimal(18,4)"))


@query(BY_COMPANY + """SELECT count(*) AS enriched, count_if(has_facts) AS with_facts, count_if(evidence > 0) AS with_evidence, count_if(evidence >= 2) AS with_2plus_evidence, count_if(evidence_with_url > 0) AS evidence_url_covered, count_if(high_confidence > 0) AS with_high_conf_evidence,
count_if(decision_makers > 0) AS with_dm, count_if(decision_makers >= 2) AS with_2plus_dm, count_if(dm_with_evidence > 0) AS with_dm_evidence, count_if(intent_signals > 0) AS with_intent, count_if(intent_with_evidence > 0) AS intent_evidence_linked, count_if(intent_dated > 0) AS intent_dated,
count_if(email_candidates > 0) AS with_dm_email, count_if(verified_emails > 0) AS with_verified_dm_email, count_if(has_score) AS with_score, CAST(round(coalesce(avg(confidence::DOUBLE / rated), 0), 3) AS DECIMAL(18, 3)) AS avg_evidence_conf FROM by_company""")
def quality_totals(spark, folder):
    """How many enriched companies have what."""
    return snapshots.quality_totals(_quality(spark, folder)).withColumn("avg_evidence_conf", F.round("avg_evidence_conf", 3).cast("decimal(18,3)"))


@query(f"WITH runs AS ({_sql('orders', RUNS)}), evidence AS ({_sql('lineitem', EVIDENCE)}) SELECT company_id, count(*) AS n_evidence, count(DISTINCT evidence_id) AS n_ids, max(observed_at) AS newest FROM evidence JOIN runs USING (run_id) GROUP BY company_id")
def evidence_snapshot(spark, folder):
    """Each company's nested documents, read back: all entries are there, once, and the newest leads a part."""
    d = snapshots.evidence_documents(_read(spark, folder, "lineitem", EVIDENCE), _read(spark, folder, "orders", RUNS), 20)
    entries = d.select("company_id", F.from_json("document", "array<struct<id:long,observed_at:string>>").alias("all"))
    parts = entries.select("company_id", F.size("all").alias("n"), F.get("all", F.lit(0))["observed_at"].cast("date").alias("first"), F.explode("all.id").alias("id"))
    return parts.groupBy("company_id").agg(F.count(F.lit(1)).alias("n_evidence"), F.countDistinct("id").alias("n_ids"), F.max("first").alias("newest"))


@query("SELECT (SELECT count(*) FROM customer) AS companies, (SELECT count(DISTINCT o_custkey) FROM orders WHERE o_orderstatus = 'F') AS enriched_companies, (SELECT count(*) FROM lineitem) AS evidence, (SELECT count(*) FROM supplier) AS decision_makers, (SELECT count(*) FROM events) AS intent_signals, (SELECT count(*) FROM customer WHERE c_custkey % 2 = 0) AS company_facts, (SELECT count(*) FROM customer WHERE c_custkey % 3 = 0) AS scored_companies, (SELECT 2 * count(*) FROM supplier) AS dm_email_candidates, (SELECT 2 * count(*) FROM supplier WHERE s_suppkey % 4 < 2) AS verified_dm_emails, (SELECT count(*) FROM customer) - (SELECT count(DISTINCT o_custkey) FROM orders WHERE o_orderstatus = 'F') AS remaining_companies")
def dashboard_metrics(spark, folder):
    """The nine counts of the overview and what is left to do: one aggregate a table, reduced to one row."""
    n = F.count(F.lit(1))
    c, s = table(spark, folder, "customer"), table(spark, folder, "supplier")
    done = table(spark, folder, "orders").where("o_orderstatus = 'F'").select("o_custkey").distinct()
    rows = [
        c.agg(n.alias("companies"), F.count_if(F.col("c_custkey") % 2 == 0).alias("company_facts"), F.count_if(F.col("c_custkey") % 3 == 0).alias("scored_companies")),
        done.agg(n.alias("enriched_companies")), table(spark, folder, "lineitem").agg(n.alias("evidence")), table(spark, folder, "events").agg(n.alias("intent_signals")),
        s.agg(n.alias("decision_makers"), (2 * n).alias("dm_email_candidates"), (2 * F.count_if(F.col("s_suppkey") % 4 < 2)).alias("verified_dm_emails")),
    ]
    names = [name for row in rows for name in row.columns]
    # Rows of one column set each, added up: no join.
    wide = [row.select(*[F.col(x) if x in row.columns else F.lit(None).cast("long").alias(x) for x in names]) for row in rows]
    out = wide[0]
    for more in wide[1:]:
        out = out.union(more)
    out = out.agg(*[F.max(x).alias(x) for x in names])
    return out.withColumn("remaining_companies", F.greatest(F.col("companies") - F.col("enriched_companies"), F.lit(0)))


KEYS = {"people": "decision_maker_id", "evidence": "evidence_id", "signals": "signal_id", "scores": "score_id"}
REFERENCES = [
    cleanup.Reference("evidence", "decision_maker_id", "people", "decision_maker_id"), cleanup.Reference("evidence", "claim_name", "people", "full_name", "claim_name IS NOT NULL"),
    cleanup.Reference("signals", "evidence_id", "evidence", "evidence_id"), cleanup.Reference("scores", "signal_id", "signals", "signal_id"),
]


@query(f"""
WITH people AS ({_sql('supplier', PEOPLE)}), evidence AS ({_sql('lineitem', EVIDENCE)}), signals AS ({_sql('events', SIGNALS)}), scores AS (SELECT event_id + 1000000 AS score_id, event_id AS signal_id FROM events WHERE event_id % 2 = 0),
p AS (SELECT * FROM people WHERE decision_maker_id % 5 = 0),
e AS (SELECT * FROM evidence WHERE decision_maker_id IN (SELECT decision_maker_id FROM p) OR claim_name IN (SELECT full_name FROM p)),
s AS (SELECT * FROM signals WHERE evidence_id IN (SELECT evidence_id FROM e)), c AS (SELECT * FROM scores WHERE signal_id IN (SELECT signal_id FROM s))
SELECT 'people' AS name, (SELECT count(*) FROM p) AS gone, (SELECT count(*) FROM people) AS n UNION ALL SELECT 'evidence', (SELECT count(DISTINCT evidence_id) FROM e), (SELECT count(*) FROM evidence)
UNION ALL SELECT 'signals', (SELECT count(*) FROM s), (SELECT count(*) FROM signals) UNION ALL SELECT 'scores', (SELECT count(*) FROM c), (SELECT count(*) FROM scores)
""")
def quality_cascade(spark, folder):
    """People who fail the gate go, with the evidence that names them by id or in its claim, the signals that rest on it and the scores that rest on those."""
    events = table(spark, folder, "events")
    scores = events.where("event_id % 2 = 0").select((F.col("event_id") + 1_000_000).alias("score_id"), F.col("event_id").alias("signal_id"))
    tables = {"people": _read(spark, folder, "supplier", PEOPLE), "evidence": _read(spark, folder, "lineitem", EVIDENCE), "signals": _read(spark, folder, "events", SIGNALS), "scores": scores}
    gone = cleanup.cascade(tables, {"people": tables["people"].where("decision_maker_id % 5 = 0")}, REFERENCES, KEYS)
    out = None
    for name, rows in tables.items():
        both = rows.select(F.lit(name).alias("name"), F.lit(0).alias("g"), F.lit(1).alias("t")).union(gone[name].select(F.lit(name), F.lit(1), F.lit(0)))
        out = both if out is None else out.union(both)
    return out.groupBy("name").agg(F.sum("g").alias("gone"), F.sum("t").alias("n"))
