"""Queries on fit, signals, routing and replies by the full rule tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from meridix.functions import vocabulary as V
from meridix.operators import rules, scoring, terms
from meridix.plans.accounts import SCORES, TODAY
from meridix.plans.registry import query
from meridix.plans.sqltext import has_any, labels, listed, quoted
from meridix.sources.tables import table

# Notes are a document's text and two phrases that its id picks, so that every word of the tables occurs.
PHRASES = [w.upper() if k % 2 else w for k, w in enumerate(w for *_, words in V.FIT_AMPLIFIERS + V.NEGATIVE_RULES for w in words)] + ["nothing of note"] * 40
STRUCTURE = {"employees": "{k} % 700", "sessions": "{k} * 7919 % 8000000", "login": "{k} % 3 = 0"}
POINTS = " + ".join(
    ["CASE WHEN employees BETWEEN 50 AND 500 THEN 1 ELSE 0 END", "CASE WHEN sessions BETWEEN 100000 AND 5000000 THEN 1 ELSE 0 END", "CASE WHEN login THEN 1 ELSE 0 END"]
    + [f"CASE WHEN {has_any('notes', words)} THEN {n} ELSE 0 END" for _, n, words in V.FIT_AMPLIFIERS]
)
ATTRIBUTES = labels(
    ("employees BETWEEN 50 AND 500", "employee_band"), ("sessions BETWEEN 100000 AND 5000000", "traffic_band"), ("login", "login_surface"),
    *[(has_any("notes", words), key) for key, _, words in V.FIT_AMPLIFIERS],
)
FLAGS = labels(*[(has_any("notes", words), key) for key, words in V.NEGATIVE_RULES])


def _structure(key: str) -> str:
    return ", ".join(f"{sql.format(k=key)} AS {name}" for name, sql in STRUCTURE.items())


def _picked(key: str) -> str:
    return f"[{listed(PHRASES)}][CAST(({key}) % {len(PHRASES)} AS INT) + 1]"


def _phrase(key):
    return F.element_at(F.array(*map(F.lit, PHRASES)), (key % len(PHRASES)).cast("int") + 1)


FIT = f"""
SELECT *, {POINTS} AS raw, {ATTRIBUTES} AS attributes, {FLAGS} AS flags FROM (
    SELECT doc_id, lower(concat(text, ' ', {_picked('doc_id')}, ' ', {_picked('doc_id * 7 + 3')})) AS notes, {_structure('doc_id')} FROM documents)
"""


@query(f"""
SELECT doc_id, CAST(raw AS INT) AS raw, CAST(least(10, greatest(0, raw)) AS INT) AS fit,
       array_to_string(attributes, ',') AS attributes, array_to_string(flags, ',') AS flags FROM ({FIT})
""")
def company_fit(spark, folder):
    """Points of a company's size, traffic, login and notes, and the friction that the notes tell of."""
    key = F.col("doc_id")
    d = table(spark, folder, "documents").selectExpr("doc_id", "text", *[f"{sql.format(k='doc_id')} AS {name}" for name, sql in STRUCTURE.items()])
    d = d.withColumn("notes", F.concat_ws(" ", "text", _phrase(key), _phrase(key * 7 + 3)))
    found = terms.Index(w for *_, words in V.FIT_AMPLIFIERS + V.NEGATIVE_RULES for w in words)
    d = d.withColumn("found", found.terms_in(F.lower(F.coalesce("notes", F.lit("")))))
    facts, has = [F.col(c) for c in STRUCTURE], found.any_of(F.col("found"))
    raw = rules.fit_raw(has, *facts)
    joined = lambda c: F.array_join(c, ",")
    return d.select("doc_id", raw.alias("raw"), rules.capped(raw).alias("fit"), joined(rules.fit_attributes(has, *facts)).alias("attributes"), joined(rules.negative_flags(has)).alias("flags"))


STAGES = [*V.BEHAVIOUR_P1, "VISITED", "UNKNOWN", "READ_DOCS", "LEFT", "NEW", "OPENED"]
BASE = """
CASE WHEN behaviour OR fit > 5 AND intent > 5 THEN 'P1' WHEN fit > 5 THEN 'P2' WHEN intent > 5 THEN 'P3' ELSE 'P4' END
"""
ROUTED = f"""
WITH companies AS (
    SELECT c_custkey, c_mktsegment, lower(concat_ws(', ', {_picked('c_custkey')}, {_picked('c_custkey * 5 + 1')}, {_picked('c_custkey * 11 + 2')}, {_picked('c_custkey * 13 + 5')})) AS notes,
           {_structure('c_custkey')}, [{listed(STAGES)}][CAST(c_custkey % {len(STAGES) * 4} AS INT) + 1] AS stage, c_custkey % 5 = 0 AS bridge, CAST(c_custkey % 4 AS INT) AS depth FROM customer),
fitted AS (SELECT *, CAST(least(10, greatest(0, {POINTS})) AS INT) AS fit, {FLAGS} AS flags FROM companies),
scored AS (SELECT f.*, coalesce(s.intent, 0) AS intent, coalesce(stage IN ({listed(V.BEHAVIOUR_P1)}), false) AS behaviour FROM fitted f LEFT JOIN ({SCORES}) s ON c_custkey = user_id),
based AS (SELECT *, {BASE} AS base FROM scored),
promoted AS (SELECT *, CASE WHEN bridge AND base = 'P3' THEN 'P2' WHEN bridge AND base = 'P2' THEN 'P1' ELSE base END AS raised FROM based),
held AS (SELECT *, CASE WHEN list_contains(flags, 'corporate_route_only') AND raised IN ('P1', 'P2') THEN 'P3' ELSE raised END AS kept FROM promoted)
SELECT c_custkey, c_mktsegment, intent, fit, CASE WHEN list_contains(flags, 'ma_freeze') AND kept = 'P1' THEN 'P2' ELSE kept END AS priority,
       array_to_string({labels(
           ("behaviour", "behavior_p1"), ("bridge AND base IN ('P2', 'P3')", "india_bridge"), ("list_contains(flags, 'corporate_route_only')", "corporate_route_cap"),
           ("list_contains(flags, 'ma_freeze')", "ma_freeze_cap"), ("list_contains(flags, 'business_contraction')", "business_contraction_friction"),
           ("list_contains(flags, 'founder_departed')", "founder_transition_friction"), ("depth >= 2", "decision_maker_depth"))}, ',') AS modifiers FROM held
"""


@query(ROUTED)
def priority_routing(spark, folder):
    """Fit, decayed intent and routing of each account in one row."""
    key = F.col("c_custkey")
    c = table(spark, folder, "customer").selectExpr("c_custkey", "c_mktsegment", *[f"{sql.format(k='c_custkey')} AS {name}" for name, sql in STRUCTURE.items()])
    c = c.withColumn("notes", F.concat_ws(", ", _phrase(key), _phrase(key * 5 + 1), _phrase(key * 11 + 2), _phrase(key * 13 + 5)))
    stage = F.get(F.array(*map(F.lit, STAGES)), (key % (len(STAGES) * 4)).cast("int"))
    found = terms.Index(w for *_, words in V.FIT_AMPLIFIERS + V.NEGATIVE_RULES for w in words)
    facts, has = [F.col(x) for x in STRUCTURE], found.any_of(F.col("found"))
    c = c.withColumn("found", found.terms_in(F.lower("notes")))
    c = c.select(key, "c_mktsegment", rules.capped(rules.fit_raw(has, *facts)).alias("fit"), rules.negative_flags(has).alias("flags"), F.coalesce(stage.isin(*V.BEHAVIOUR_P1), F.lit(False)).alias("behaviour"))
    s = scoring.intent_scores(table(spark, folder, "events"), TODAY).select("user_id", "intent")
    j = c.join(s, key == F.col("user_id"), "left").withColumn("intent", F.coalesce("intent", F.lit(0).cast("decimal(18,2)")))
    priority, modifiers = rules.route(F.col("fit"), F.col("intent"), F.col("behaviour"), F.col("flags"), key % 5 == 0, key % 4)
    return j.select(key, "c_mktsegment", "intent", "fit", priority.alias("priority"), F.array_join(modifiers, ",").alias("modifiers"))


SIGNAL_TEXTS = [w if k % 3 else f"  Recent {w.upper()}  noted " for k, w in enumerate(w for _, words in V.SIGNAL_ALIASES for w in words)]
SIGNAL_TEXTS += [*V.INTENT_RULES, *V.CONTEXT_ONLY, "new ciso after funding", "gdpr and dpdp", "trialling", "strategy", "", "  ", "Docs_Visit", "sdk_install"]
SCORED = [*V.INTENT_RULES]
MATCHED = labels(*[(f"regexp_matches(t, {quoted(rules.alias_pattern(words))})", key) for key, words in V.SIGNAL_ALIASES])


@query(f"""
SELECT event_id, status, signal, CAST(CASE signal {' '.join(f"WHEN '{k}' THEN {w}" for k, (w, _) in V.INTENT_RULES.items())} WHEN NULL THEN NULL ELSE CASE WHEN signal IS NOT NULL THEN 0 END END AS INT) AS weight,
       CAST(CASE signal {' '.join(f"WHEN '{k}' THEN {h}" for k, (_, h) in V.INTENT_RULES.items())} ELSE CASE WHEN signal IS NOT NULL THEN 1 END END AS INT) AS half_life FROM (
    SELECT event_id, CASE WHEN t = '' THEN 'empty' WHEN len(m) = 0 THEN 'unsupported' WHEN len(m) > 1 THEN 'ambiguous' ELSE 'ok' END AS status, CASE WHEN len(m) = 1 AND t <> '' THEN m[1] END AS signal FROM (
        SELECT event_id, t, CASE WHEN t IN ({listed([*V.INTENT_RULES, *V.CONTEXT_ONLY])}) THEN [t] ELSE {MATCHED} END AS m FROM (
            SELECT event_id, trim(regexp_replace(translate(lower([{listed(SIGNAL_TEXTS)}][CAST(event_id % {len(SIGNAL_TEXTS)} AS INT) + 1]), '_', ' '), '\\s+', ' ', 'g')) AS t FROM events)))
""")
def signal_normalisation(spark, folder):
    """Free names of signals to canonical ones with weight and half-life; no match or several are errors."""
    raw = F.element_at(F.array(*map(F.lit, SIGNAL_TEXTS)), (F.col("event_id") % len(SIGNAL_TEXTS)).cast("int") + 1)
    e = table(spark, folder, "events").select("event_id", rules.signal_key(raw).alias("t")).withColumn("m", rules.signal_types(F.col("t")))
    status = F.when(F.col("t") == "", "empty").when(F.size("m") == 0, "unsupported").when(F.size("m") > 1, "ambiguous").otherwise("ok")
    e = e.select("event_id", status.alias("status"), F.when(status == "ok", F.col("m")[0]).alias("signal"))
    weight, life = ({k: v[at] for k, v in V.INTENT_RULES.items()} for at in (0, 1))
    some = F.col("signal").isNotNull()
    return e.select("event_id", "status", "signal", F.when(some, rules.lookup(F.col("signal"), weight, 0)).alias("weight"), F.when(some, rules.lookup(F.col("signal"), life, 1)).alias("half_life"))


REPLIES = [
    "please unsubscribe me", "REMOVE ME from this list", "I am not interested", "no thanks", "I am out of office until May", "away from my office", "back on Monday",
    "not now", "maybe later", "reach out in a month or later", "I'd be interested", "tell me more", "let's talk", "can we schedule", "book a quick call", "worth a chat",
    "what's the price", "how does it work", "is it ready?", "ready?\nthanks", "no_thanks", "disinterested", "rescheduled", "nothing", "", "unsubscribed",
]


def _reply_case(of: int) -> str:
    cases = []
    for name, why, phrases in V.REPLY_RULES:
        hit = f"regexp_matches(t, {quoted('(?im)' + rules.phrase_pattern(phrases))})" + (" OR regexp_matches(t, '(?m)\\?$')" if name == "question" else "")
        cases.append(f"WHEN {hit} THEN '{(name, why)[of]}'")
    return f"CASE WHEN regexp_replace(t, '\\s+', '', 'g') = '' THEN '{('unclassified', 'empty_reply')[of]}' {' '.join(cases)} ELSE '{('other', 'no_known_classification_signal')[of]}' END"


REPLIED = f"SELECT conv_id, turn, CASE WHEN (conv_id * 31 + turn) % 9 = 0 THEN '' ELSE concat(coalesce(text, ''), chr(10)) END || [{listed(REPLIES)}][CAST((conv_id * 7 + turn) % {len(REPLIES)} AS INT) + 1] AS t FROM conversations WHERE role = 'user'"
CLASSED = f"SELECT conv_id, turn, {_reply_case(0)} AS class, {_reply_case(1)} AS reason FROM ({REPLIED.replace('chr(10)', 'chr(10)')})"
ACTIONS = "CASE class " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in V.REPLY_ACTIONS.items()) + " END"


def _replies(spark, folder):
    key = F.col("conv_id") * 7 + F.col("turn")
    head = F.when((F.col("conv_id") * 31 + F.col("turn")) % 9 == 0, "").otherwise(F.concat(F.coalesce("text", F.lit("")), F.lit("\n")))
    c = table(spark, folder, "conversations").where("role = 'user'").withColumn("t", F.concat(head, F.element_at(F.array(*map(F.lit, REPLIES)), (key % len(REPLIES)).cast("int") + 1)))
    label, reason = rules.reply_class(F.col("t"))
    return c.select("conv_id", "turn", label.alias("class"), reason.alias("reason"))


@query(f"SELECT *, {ACTIONS} AS action FROM ({CLASSED})")
def reply_classification(spark, folder):
    """The first of six groups of phrases that a reply holds, why, and what to do."""
    return _replies(spark, folder).withColumn("action", rules.lookup(F.col("class"), V.REPLY_ACTIONS, "human_review"))


# What a semantic model found, by the turn's number: nothing, an opt-out, or an intent.
INTENTS = ["interested", "negative", "not_now", "ooo", "unsubscribe", "pricing"]
MODEL = f"CASE WHEN turn % 4 = 0 THEN 'none' WHEN conv_id % 13 = 0 THEN 'opt_out' ELSE [{listed(INTENTS)}][CAST((conv_id + turn) % {len(INTENTS)} AS INT) + 1] END"
DECISIONS = [
    ("class IN ('unsubscribe', 'negative')", "class", "CASE WHEN class = 'unsubscribe' THEN 'suppress_contact' ELSE 'stop_cold_sequence' END", "false", "deterministic_safety_precedence"),
    ("class IN ('not_now', 'ooo')", "class", "CASE WHEN class = 'not_now' THEN 'schedule_later' ELSE 'defer_until_return' END", "false", "deterministic_defer_precedence"),
    ("model = 'none'", "class", "CASE WHEN class IN ('interested', 'question') THEN 'human_follow_up' ELSE 'human_review' END", "class IN ('interested', 'question')", "semantic_analysis_unavailable"),
    ("model = 'opt_out'", "'unsubscribe'", "'suppress_contact'", "false", "semantic_explicit_opt_out"),
    ("model IN ('unsubscribe', 'negative')", "model", "CASE WHEN model = 'unsubscribe' THEN 'suppress_contact' ELSE 'stop_cold_sequence' END", "false", "semantic_safety_precedence"),
    ("model IN ('not_now', 'ooo')", "model", "CASE WHEN model = 'not_now' THEN 'schedule_later' ELSE 'defer_until_return' END", "false", "semantic_defer_precedence"),
    ("model IN ('interested', 'question') OR class IN ('interested', 'question')", "model", "'human_follow_up'", "true", "positive_intent_reconciled"),
    ("true", "model", "'human_review'", "false", "no_safe_automatic_action"),
]
RECONCILED = [("effective_intent", 1), ("action", 2), ("send_allowed", 3)]


def _decided(at: int) -> str:
    return "CASE " + " ".join(f"WHEN {d[0]} THEN {d[at] if at < 4 else quoted(d[4])}" for d in DECISIONS) + " END"


@query(f"SELECT conv_id, turn, {', '.join(f'{_decided(at)} AS {name}' for name, at in RECONCILED)}, {_decided(4)} AS reason FROM (SELECT *, {MODEL} AS model FROM ({CLASSED}))")
def policy_reconcile(spark, folder):
    """What a model read in a reply never overrides a rule that stops or defers."""
    c, m = F.col("class"), F.col("model")
    found = F.element_at(F.array(*map(F.lit, INTENTS)), ((F.col("conv_id") + F.col("turn")) % len(INTENTS)).cast("int") + 1)
    r = _replies(spark, folder).withColumn("model", F.when(F.col("turn") % 4 == 0, "none").when(F.col("conv_id") % 13 == 0, "opt_out").otherwise(found))
    stop, defer, good = ("unsubscribe", "negative"), ("not_now", "ooo"), ("interested", "question")
    stopped = lambda x: F.when(x == "unsubscribe", "suppress_contact").otherwise("stop_cold_sequence")
    deferred = lambda x: F.when(x == "not_now", "schedule_later").otherwise("defer_until_return")
    decide = lambda intent, action, allowed, reason: F.struct(intent.alias("effective_intent"), action.alias("action"), allowed.alias("send_allowed"), F.lit(reason).alias("reason"))
    no, yes = F.lit(False), F.lit(True)
    out = (
        F.when(c.isin(*stop), decide(c, stopped(c), no, "deterministic_safety_precedence"))
        .when(c.isin(*defer), decide(c, deferred(c), no, "deterministic_defer_precedence"))
        .when(m == "none", decide(c, F.when(c.isin(*good), "human_follow_up").otherwise("human_review"), c.isin(*good), "semantic_analysis_unavailable"))
        .when(m == "opt_out", decide(F.lit("unsubscribe"), F.lit("suppress_contact"), no, "semantic_explicit_opt_out"))
        .when(m.isin(*stop), decide(m, stopped(m), no, "semantic_safety_precedence"))
        .when(m.isin(*defer), decide(m, deferred(m), no, "semantic_defer_precedence"))
        .when(m.isin(*good) | c.isin(*good), decide(m, F.lit("human_follow_up"), yes, "positive_intent_reconciled"))
        .otherwise(decide(m, F.lit("human_review"), no, "no_safe_automatic_action"))
    )
    return r.select("conv_id", "turn", out.alias("d")).select("conv_id", "turn", "d.*")
