"""Queries on evidence: dated signals, relations and their spans, candidates with a fallback."""

from __future__ import annotations

from pyspark.sql import functions as F

from meridix.functions import vocabulary as V
from meridix.operators import evidence
from meridix.plans.people import ISO_DATE, PUBLISHED, SPELLED, US_DATE, event_date
from meridix.plans.registry import query
from meridix.plans.sqltext import listed, quoted
from meridix.sources.tables import table

# A document's text and a sentence that its id picks: each context once, terms out of context, dates spelled three ways.
SENTENCES = [f"On it {' with much '.join(c if k % 2 else [t.upper() for t in c])}." for k, c in enumerate(c for _, own in V.INTENT_CONTEXTS for c in own)]
SENTENCES += ["It supports funding education and security.", "The ceo raised a hand.", "A platform, an award, a market."] * 3
DATED = ["March 7, 2024", "on 2024-03-05", "undated", "2024-02-31"]
TEXT = f"concat(text, ' ', [{listed(SENTENCES)}][CAST(doc_id % {len(SENTENCES)} AS INT) + 1], ' ', [{listed(DATED)}][CAST(doc_id % {len(DATED)} AS INT) + 1])"


def _pick(words, key):
    return F.element_at(F.array(*map(F.lit, words)), (key % len(words)).cast("int") + 1)


def _signal_sql() -> str:
    cases = []
    for signal, contexts in V.INTENT_CONTEXTS:
        whens = " ".join(f"WHEN {' AND '.join(f'contains(low, {quoted(t)})' for t in c)} THEN {quoted('+'.join(c))}" for c in contexts)
        weight, life = V.INTENT_RULES.get(V.SIGNAL_NAMES.get(signal, signal), (0, 1))
        cases.append(f"SELECT doc_id, event_date, {quoted(V.SIGNAL_NAMES.get(signal, signal))} AS signal_type, CASE {whens} END AS terms, {weight} AS weight, {life} AS half_life FROM dated")
    return " UNION ALL ".join(cases)


@query(f"""
WITH d AS (SELECT doc_id, {TEXT} AS page, {PUBLISHED} AS published FROM documents),
parts AS (SELECT doc_id, page, published, regexp_extract(page, {quoted(ISO_DATE)}, 1) AS iso, regexp_extract(page, {quoted(US_DATE)}, 1) AS d FROM d),
dated AS MATERIALIZED (SELECT doc_id, trim(regexp_replace(lower(page), '\\s+', ' ', 'g')) AS low, coalesce(TRY_CAST(left(trim(published), 10) AS DATE), CASE WHEN iso <> '' THEN TRY_CAST(iso AS DATE) END, CASE WHEN d <> '' THEN TRY_CAST({SPELLED} AS DATE) END) AS event_date FROM parts)
SELECT doc_id, signal_type, terms, event_date, weight, half_life FROM ({_signal_sql()}) WHERE terms IS NOT NULL AND event_date IS NOT NULL
""")
def intent_context_signals(spark, folder):
    """Public signals of dated pages: all terms of a context must stand in the text, and the first context is the evidence."""
    d, k = table(spark, folder, "documents"), F.col("doc_id")
    page = F.concat_ws(" ", "text", _pick(SENTENCES, k), _pick(DATED, k))
    pages = d.select(k.alias("id"), page.alias("text"), F.expr(PUBLISHED).alias("published")).withColumn("event_date", event_date(F.col("published"), F.col("text")))
    found = evidence.intent_signals(pages)
    return found.select(F.col("id").alias("doc_id"), "signal_type", F.array_join("terms", "+").alias("terms"), "event_date", "weight", "half_life")


NAMES = ["Example Holdings", "North & West Co.", "O'Neil-Grant Foods, Inc", "Zed", "Alpha Beta Gamma Delta Epsilon Zeta Eta Theta"]
LINES = [f"Ünlike others it is {phrase} {NAMES[k % len(NAMES)]}." for k, (phrase, _, _) in enumerate(V.RELATIONS)] + ["It is owned by nobody.", "A counterpart of Someone, then.", "Founded and operated by  Two Spaces here"]
LINE = f"[{listed(LINES)}][CAST(doc_id % {len(LINES)} AS INT) + 1]"
NAME_SQL = evidence.NAME


def _span_sql() -> str:
    out = []
    for k, (phrase, predicate, kind) in enumerate(V.RELATIONS):
        pattern = rf"(?s)^(.*?)((?:^|[^\p{{L}}\p{{N}}_]){phrase}\s+({NAME_SQL}))"
        out.append(f"SELECT doc_id, {quoted(predicate)} AS predicate, {quoted(kind)} AS entity_type, {k} AS n, regexp_extract(whole, {quoted(pattern)}, 1) AS head, regexp_extract(whole, {quoted(pattern)}, 2) AS held, regexp_extract(whole, {quoted(pattern)}, 3) AS raw, {quoted(phrase[0])} AS first FROM t WHERE contains(whole, {quoted(phrase)})")
    return " UNION ALL ".join(out)


SPANS = f"""
WITH t AS MATERIALIZED (SELECT doc_id, concat({LINE}, ' ', text) AS whole FROM documents), s AS ({_span_sql()}),
placed AS (SELECT doc_id, predicate, entity_type, regexp_replace(raw, '[.,;:]+$', '') AS name, substr(held, instr(held, first)) AS quote, length(head) + instr(held, first) - 1 AS start FROM s WHERE regexp_replace(raw, '[.,;:]+$', '') <> ''),
spans AS (SELECT *, start + length(quote) AS "end" FROM placed)
"""


def _evidence(spark, folder):
    return table(spark, folder, "documents").select(F.col("doc_id").alias("evidence_id"), _pick(LINES, F.col("doc_id")).alias("title"), "text")


@query(SPANS + """SELECT doc_id, predicate, entity_type, name, quote, start::INT AS start, "end"::INT AS "end" FROM spans a WHERE NOT EXISTS (SELECT 1 FROM spans b WHERE b.doc_id = a.doc_id AND b.start <= a.start AND b."end" >= a."end" AND length(b.quote) > length(a.quote))""")
def relation_spans(spark, folder):
    """Relations that a text states, with the quote and its place in code points; a span inside a longer one gives way."""
    return evidence.outermost(evidence.relation_spans(_evidence(spark, folder))).withColumnRenamed("evidence_id", "doc_id")


TYPES = ["BRAND", "OPERATING_ENTITY", "PARENT_COMPANY", "UNKNOWN"]
GIVEN = "CASE doc_id % 5 WHEN 0 THEN ' Brand ' WHEN 1 THEN 'planet' WHEN 2 THEN 'parent_company' END"


@query(SPANS + f""", given AS (SELECT doc_id, trim(raw) AS name, upper(trim(kind)) AS entity_type, 'TARGET' AS relation FROM (SELECT doc_id, unnest(['Acme', ' ACME', 'Other']) AS raw, {GIVEN} AS kind FROM documents) WHERE upper(trim(kind)) IN ({listed(TYPES)})),
both_ AS (SELECT doc_id, name, entity_type, relation, 'structured' AS method FROM given UNION ALL SELECT doc_id, name, entity_type, predicate, 'deterministic' FROM spans WHERE doc_id NOT IN (SELECT doc_id FROM given))
SELECT doc_id, arg_min(name, (relation, name, method)) AS name, entity_type, min(relation) AS relation, min(method) AS method FROM both_ GROUP BY doc_id, lower(name), entity_type""")
def evidence_candidates(spark, folder):
    """Candidates of an extractor, of known types only; documents for which it gave none fall back to the relations of their text."""
    rows = table(spark, folder, "documents").select(F.col("doc_id").alias("evidence_id"), F.explode(F.array(F.lit("Acme"), F.lit(" ACME"), F.lit("Other"))).alias("name"), F.expr(GIVEN).alias("entity_type"), F.lit("TARGET").alias("relation"))
    return evidence.candidates(rows, _evidence(spark, folder), TYPES).withColumnRenamed("evidence_id", "doc_id")
