"""Queries on people: who decides, who may be written to, what pages say, what happens next."""

from __future__ import annotations

from pyspark.sql import functions as F

from meridix.functions import vocabulary as V
from meridix.operators import people, rules, terms, windows
from meridix.plans.registry import query
from meridix.plans.sqltext import first_of, has_any, labels, listed, quoted
from meridix.sources.tables import table


def pick(words, key: str) -> str:
    """An expression of both engines: the word that a number picks."""
    return "CASE " + " ".join(f"WHEN ({key}) % {len(words)} = {k} THEN {quoted(w) if w is not None else 'NULL'}" for k, w in enumerate(words)) + " END"


TITLES = [
    "CISO", " ciso ", "Chief Information Security Officer", "chief information security & risk officer", "VP Engineering", "Head of Product", "Growth Lead", "Director of Fraud",
    "Marketing Manager", "Chief Executive Officer", "Founder", "Assistant", "", None, "Technology Principal", "AVP Compliance", "General Manager, Risk", "CTO", "Finance Director", "Identity Architect",
]
NAMES = ["Ada Lovelace", "Grace B. Hopper", "LinkedIn Team", "ada lovelace", "As Co-CEO", "Supplier Group", "Jean-Luc O'Neil", "X", "Mary  Ann   Evans", "Profile Page"]
PEOPLE = {
    "title": pick(TITLES, "s_suppkey"), "name": pick(NAMES, "s_suppkey * 3 + 1"), "company": pick(["The Supplier Group", "Acme Ltd", "Lovelace Ada", "", "Hopper & Co"], "s_suppkey * 7 + 2"),
    "priority": "CASE WHEN s_suppkey % 4 <> 0 THEN CAST(s_suppkey % 9 AS INT) END", "statuses": pick(["verified", "unknown", "unknown,verified", "invalid", "", "stale,unknown"], "s_suppkey * 11 + 3"),
    "family": pick(["security", "identity", "Risk ", "", "product", "other", None], "s_suppkey * 13 + 1"), "confidence": "CAST(s_suppkey % 21 AS INT) * 5",
}
PERSON = ", ".join(f"{sql} AS {name}" for name, sql in PEOPLE.items())
FLAT = "lower(trim(regexp_replace(coalesce({}, ''), '\\s+', ' ', 'g')))"
TITLE = FLAT.format("title")


def _people(spark, folder):
    return table(spark, folder, "supplier").selectExpr("s_suppkey", "s_nationkey", *[f"{sql} AS {name}" for name, sql in PEOPLE.items()])


ROLE = [(n, f) for n, f, _ in V.ROLE_FAMILIES]


@query(f"SELECT s_suppkey, title, {first_of('lower(title)', ROLE)} AS family, CAST({first_of('lower(title)', [(n, p) for n, _, p in V.ROLE_FAMILIES])} AS INT) AS priority FROM (SELECT s_suppkey, {PERSON} FROM supplier)")
def role_families(spark, folder):
    """The family and priority of the first role that a title holds."""
    low = F.lower("title")
    has = lambda words: rules.contains_any(low, words)
    priority = rules.first_of(has, [(n, str(p)) for n, _, p in V.ROLE_FAMILIES]).cast("int")
    return _people(spark, folder).select("s_suppkey", "title", rules.first_of(has, ROLE).alias("family"), priority.alias("priority"))


def _tokens(text: str) -> str:
    return f"list_distinct(list_filter(regexp_split_to_array(lower({text}), '[^a-z0-9]+'), lambda t: length(t) > 1 AND t NOT IN ({listed(V.COMPANY_STOPWORDS)})))"


GATE = f"""
CASE WHEN NOT regexp_full_match(n, '[A-Z][A-Za-z''’.-]+(?:\\s+[A-Z][A-Za-z''’.-]+){{1,3}}') THEN 'invalid_person_name_format'
     WHEN len(list_intersect(own, [{listed(V.REJECTED_NAME_TOKENS)}])) > 0 THEN 'name_contains_search_label'
     WHEN t = '' OR NOT regexp_matches(t, '(?i)(?:^|[^A-Za-z0-9_])(?:{V.EXECUTIVE})(?:$|[^A-Za-z0-9_])') THEN 'title_lacks_explicit_executive_role'
     WHEN len(own) > 0 AND len(firm) > 0 AND (list_has_all(firm, own) OR list_has_all(own, firm)) THEN 'name_overlaps_company_identity'
     ELSE 'accepted' END
"""
CLEAN = "trim(regexp_replace(coalesce({}, ''), '\\s+', ' ', 'g'))"


@query(f"""
SELECT s_suppkey, {GATE} AS reason FROM (
    SELECT *, {_tokens('n')} AS own, {_tokens('company')} AS firm FROM (SELECT s_suppkey, {CLEAN.format('name')} AS n, {CLEAN.format('title')} AS t, company FROM (SELECT s_suppkey, {PERSON} FROM supplier)))
""")
def decision_maker_gate(spark, folder):
    """Whether a found name and title are a person who decides, by format, search labels, role and overlap with the company's name."""
    return _people(spark, folder).select("s_suppkey", rules.person_gate(F.col("company"), F.col("name"), F.col("title")).alias("reason"))


VERIFIED = pick(["verified", "invalid", "stale", "unknown"], "s_suppkey")


@query(f"""
SELECT s_suppkey, CASE WHEN s_suppkey % 10 = 0 THEN 'explicit_suppression' WHEN lower(trim(coalesce(title, ''))) IN ({listed(V.CISO_TITLES)}) THEN 'ciso_suppressed_by_policy'
    WHEN status = 'verified' THEN 'eligible_for_human_review' WHEN status = 'invalid' THEN 'contact_invalid' WHEN status = 'stale' THEN 'contact_verification_stale' ELSE 'contact_not_verified' END AS reason
FROM (SELECT s_suppkey, {PERSON}, {VERIFIED} AS status FROM supplier)
""")
def outreach_policy(spark, folder):
    """Why a contact may or may not be written to: suppression, security owners, verification."""
    p = _people(spark, folder).withColumn("status", F.expr(VERIFIED))
    policy = F.when(F.col("s_suppkey") % 10 == 0, "explicit_suppression").when(F.lower(F.trim(F.coalesce("title", F.lit("")))).isin(*V.CISO_TITLES), "ciso_suppressed_by_policy")
    verified = rules.lookup(F.col("status"), {"verified": "eligible_for_human_review", "invalid": "contact_invalid", "stale": "contact_verification_stale"}, "contact_not_verified")
    return p.select("s_suppkey", policy.otherwise(verified).alias("reason"))


SCORE = f"""
CASE {' '.join(f"WHEN f = '{k}' THEN {v}" for k, v in V.ROLE_SCORES.items())} {' '.join(f"WHEN contains(t, '{k}') THEN {v - 4}" for k, v in V.ROLE_SCORES.items())} ELSE 20 END
+ CASE WHEN {has_any('t', ('chief ', 'vp ', 'vice president', 'head of'))} THEN 20 WHEN {has_any('t', ('director', 'avp', 'general manager'))} THEN 16 WHEN {has_any('t', ('lead', 'principal', 'manager'))} THEN 12 ELSE 8 END
+ CASE WHEN contains(statuses, 'verified') THEN 15 WHEN statuses = 'unknown' THEN 3 WHEN statuses <> '' THEN 6 ELSE 0 END
+ CAST(confidence AS DECIMAL(10, 2)) / 20 + CASE WHEN priority IS NOT NULL THEN greatest(0, 6 - least(priority, 6)) ELSE 0 END
"""


@query(f"""
SELECT s_nationkey, s_suppkey, CAST(round(score, 2) AS DECIMAL(10, 2)) AS score, reason, rank FROM (
    SELECT *, row_number() OVER (PARTITION BY s_nationkey ORDER BY reason = 'security_owner_priority' DESC, round(score, 2) DESC, priority IS NOT NULL DESC,
        -CASE WHEN coalesce(priority, 0) = 0 THEN 999 ELSE priority END DESC, lower(name) DESC, s_suppkey DESC) AS rank FROM (
        SELECT *, {SCORE} AS score, CASE WHEN t IN ({listed(V.CISO_TITLES)}) THEN 'security_owner_priority' ELSE 'ranked_for_human_review' END AS reason FROM (
            SELECT *, {TITLE} AS t, lower(trim(coalesce(family, ''))) AS f FROM (SELECT s_suppkey, s_nationkey, {PERSON} FROM supplier))))
WHERE rank <= 6
""")
def decision_maker_rank(spark, folder):
    """The six best people of each group: security owners first, then role, seniority, verification, confidence and priority."""
    title = F.lower(F.trim(F.regexp_replace(F.coalesce("title", F.lit("")), r"\s+", " ")))
    family = F.lower(F.trim(F.coalesce("family", F.lit(""))))
    by_title = F.lit(20)
    for k, v in reversed(V.ROLE_SCORES.items()):
        by_title = F.when(title.contains(k), v - 4).otherwise(by_title)
    role = F.coalesce(F.create_map(*[F.lit(x) for kv in V.ROLE_SCORES.items() for x in kv])[family], by_title)
    seniority = (
        F.when(rules.contains_any(title, ("chief ", "vp ", "vice president", "head of")), 20)
        .when(rules.contains_any(title, ("director", "avp", "general manager")), 16).when(rules.contains_any(title, ("lead", "principal", "manager")), 12).otherwise(8)
    )
    seen = F.array_distinct(F.filter(F.split("statuses", ","), lambda s: s != ""))
    verified = F.when(F.array_contains(seen, "verified"), 15).when((F.size(seen) == 1) & F.array_contains(seen, "unknown"), 3).when(F.size(seen) > 0, 6).otherwise(0)
    early = F.when(F.col("priority").isNotNull(), F.greatest(F.lit(0), 6 - F.least("priority", F.lit(6)))).otherwise(0)
    score = (role + seniority + verified + early + F.col("confidence") / F.lit(20)).cast("decimal(10,2)")
    reason = F.when(title.isin(*V.CISO_TITLES), "security_owner_priority").otherwise("ranked_for_human_review")
    p = _people(spark, folder).withColumns({"score": score, "reason": reason})
    place = -F.when(F.coalesce("priority", F.lit(0)) == 0, 999).otherwise(F.col("priority"))
    order = [F.desc(F.col("reason") == "security_owner_priority"), F.desc("score"), F.desc(F.col("priority").isNotNull()), F.desc(place), F.desc(F.lower("name")), F.desc("s_suppkey")]
    return windows.top_per_group(p, ["s_nationkey"], order, 6).select("s_nationkey", "s_suppkey", "score", "reason", F.col("rank").cast("long").alias("rank"))


EMAILS = {
    "email": "CASE s_suppkey % 7 WHEN 0 THEN 'Jo@acme.com' WHEN 1 THEN ' jo@mail.ACME.com ' WHEN 2 THEN 'jo@notacme.com' WHEN 3 THEN '@acme.com' WHEN 4 THEN 'jo' WHEN 5 THEN 'jo@x@acme.com' ELSE 'jo@' END",
    "domain": "CASE s_suppkey % 3 WHEN 0 THEN 'www.Acme.com' WHEN 1 THEN 'acme.com' ELSE 'other.org' END",
}


@query(f"""
SELECT s_suppkey, contains(e, '@') AND regexp_extract(e, '^(.*)@[^@]*$', 1) <> '' AND a <> '' AND (a = d OR ends_with(a, '.' || d)) AS valid FROM (
    SELECT s_suppkey, lower(trim(email)) AS e, list_last(string_split(lower(trim(email)), '@')) AS a, trim(regexp_replace(lower(domain), '^www\\.', '')) AS d FROM (
        SELECT s_suppkey, {', '.join(f'{s} AS {n}' for n, s in EMAILS.items())} FROM supplier))
""")
def company_email_gate(spark, folder):
    """Whether an address is at the company's domain or a host below it."""
    s = table(spark, folder, "supplier").selectExpr("s_suppkey", *[f"{sql} AS {name}" for name, sql in EMAILS.items()])
    return s.select("s_suppkey", rules.company_email(F.col("domain"), F.col("email")).alias("valid"))


SUPPORT = ["name_match", "current_company_match", "title_match", "company_site_support", "independent_source_support", "former_employee", "stale_employment", "ambiguous_name"]
BITS = {name: f"(s_suppkey * 37 + 11) % {1 << (k + 1)} >= {1 << k}" for k, name in enumerate(SUPPORT)}
POINTS = {"name_match": 30, "current_company_match": 30, "title_match": 20, "company_site_support": 10, "independent_source_support": 10}
IDENTITY = " + ".join(f"CASE WHEN {k} THEN {n} ELSE 0 END" for k, n in POINTS.items())
IDENTITY += " - CASE WHEN former_employee THEN 25 WHEN stale_employment THEN 15 ELSE 0 END - CASE WHEN ambiguous_name THEN 20 ELSE 0 END"


@query(f"""
SELECT s_suppkey, score, reasons, CASE WHEN s_suppkey % 5 = 0 OR s_suppkey % 8 = 0 THEN 'review' WHEN score >= 0.90 THEN 'outreach_ready' WHEN score >= 0.75 THEN 'strong_candidate' ELSE 'review' END AS status FROM (
    SELECT s_suppkey, CAST(greatest(0, least(100, {IDENTITY})) / 100 AS DECIMAL(3, 2)) AS score,
        array_to_string({labels(*[(k, k) for k in POINTS], ('former_employee', 'former_employee_penalty'), ('stale_employment', 'stale_employment_penalty'), ('ambiguous_name', 'ambiguous_name_penalty'))}, ',') AS reasons
    FROM (SELECT s_suppkey, {', '.join(f'{sql} AS {k}' for k, sql in BITS.items())} FROM supplier))
""")
def identity_scores(spark, folder):
    """What supports a person's identity less what speaks against it, and how far outreach may go; without a profile or a sure employer it stops at review."""
    s = table(spark, folder, "supplier").selectExpr("s_suppkey", *[f"{sql} AS {k}" for k, sql in BITS.items()])
    score, reasons = rules.identity_score({k: F.col(k) for k in SUPPORT})
    s = s.select("s_suppkey", score.alias("score"), F.array_join(reasons, ",").alias("reasons"))
    unsure = (F.col("s_suppkey") % 5 == 0) | (F.col("s_suppkey") % 8 == 0)
    return s.withColumn("status", F.when(unsure, "review").when(F.col("score") >= 0.9, "outreach_ready").when(F.col("score") >= 0.75, "strong_candidate").otherwise("review"))


FACTS = [n for n, _ in V.VERTICALS + V.OWNERSHIP + V.SENSITIVITY] + [*V.INDIA_BRIDGE, "1,250,000 monthly visits", "2.5M sessions", "300K visitors", "12 visits and 12 sessions", "7 visits, 9 visitors", "on 2024-03-05", "March 7, 2024", "Sep 31, 2024", "Dec 1, 2023"]
PAGE = f"concat(text, ' ', {pick([f.upper() if k % 2 else f for k, f in enumerate(FACTS)], 'doc_id')}, ' ')"
AMOUNT = r"\b([0-9]+(?:,[0-9]{3})*|[0-9]+(?:\.[0-9]+)?[KMB]?)\s+(?:monthly\s+)?(?:visits|sessions|visitors)\b"
UNITS = "CASE right({x}, 1) WHEN 'K' THEN 1000 WHEN 'M' THEN 1000000 WHEN 'B' THEN 1000000000 ELSE 1 END"


@query(f"""
SELECT doc_id, {first_of('low', V.OWNERSHIP)} AS ownership, {first_of('low', V.SENSITIVITY)} AS sensitivity, {has_any('low', V.INDIA_BRIDGE)} AS india_bridge,
    CASE {' '.join(f"WHEN regexp_matches(low, {quoted('(^|[^a-z0-9_])' + rules.escaped(n) + '([^a-z0-9_]|$)')}) THEN '{v}'" for n, v in V.VERTICALS)} END AS vertical,
    CASE WHEN len(seen) = 1 THEN seen[1] END AS monthly_sessions FROM (
        SELECT doc_id, low, list_distinct(list_transform(regexp_extract_all(page, {quoted('(?i)' + AMOUNT)}, 1), lambda t:
            CAST(CAST(regexp_replace(replace(upper(t), ',', ''), '[KMB]$', '') AS DOUBLE) * {UNITS.format(x="upper(t)")} AS BIGINT))) AS seen FROM (SELECT doc_id, {PAGE} AS page, lower({PAGE}) AS low FROM documents))
""")
def page_facts(spark, folder):
    """Vertical, ownership, data, an office abroad and monthly visits, as a page's words give them; visits only if all numbers agree."""
    d = table(spark, folder, "documents").select("doc_id", F.expr(PAGE).alias("page")).withColumn("low", F.lower("page"))
    index = terms.Index([n for n, _ in V.VERTICALS + V.OWNERSHIP + V.SENSITIVITY] + [*V.INDIA_BRIDGE])
    d = d.withColumn("found", index.terms_in(F.col("low")))
    has, vertical = index.any_of(F.col("found")), F.lit(None).cast("string")
    for n, v in reversed(V.VERTICALS):
        # Only a page that holds the word is searched for it as a word of its own.
        vertical = F.when(has([n]) & F.col("low").rlike("(^|[^a-z0-9_])" + rules.escaped(n) + "([^a-z0-9_]|$)"), v).otherwise(vertical)

    def number(raw):
        up = F.replace(F.upper(raw), F.lit(","), F.lit(""))
        unit = F.when(F.endswith(up, F.lit("K")), 1_000).when(F.endswith(up, F.lit("M")), 1_000_000).when(F.endswith(up, F.lit("B")), 1_000_000_000).otherwise(1)
        return (F.regexp_replace(up, "[KMB]$", "").cast("double") * unit).cast("long")

    seen = F.array_distinct(F.transform(F.regexp_extract_all("page", F.lit("(?i)" + AMOUNT), F.lit(1)), number))
    return d.select(
        "doc_id", rules.first_of(has, V.OWNERSHIP).alias("ownership"), rules.first_of(has, V.SENSITIVITY).alias("sensitivity"),
        has(V.INDIA_BRIDGE).alias("india_bridge"), vertical.alias("vertical"), F.when(F.size(seen) == 1, seen[0]).alias("monthly_sessions"),
    )


MONTHS = "Jan(?:uary)?|Feb(?:ruary)?|Mar(?:ch)?|Apr(?:il)?|May|Jun(?:e)?|Jul(?:y)?|Aug(?:ust)?|Sep(?:tember)?|Oct(?:ober)?|Nov(?:ember)?|Dec(?:ember)?"
US_DATE = rf"(?i)\b((?:{MONTHS})\s+\d{{1,2}},\s+20\d{{2}})\b"
ISO_DATE = r"\b(20\d{2}-\d{2}-\d{2})\b"
PUBLISHED = "CASE doc_id % 5 WHEN 0 THEN '2024-02-10T08:00:00Z' WHEN 1 THEN 'not a date' WHEN 2 THEN '2023-13-01' END"
MONTH = "CASE lower(left(d, 3)) " + " ".join(f"WHEN '{m}' THEN '{k + 1:02d}'" for k, m in enumerate("jan feb mar apr may jun jul aug sep oct nov dec".split())) + " END"
SPELLED = f"regexp_extract(d, '(20[0-9]{{2}})$', 1) || '-' || {MONTH} || '-' || right('0' || regexp_extract(d, ' +([0-9]+),', 1), 2)"


@query(f"""
SELECT doc_id, coalesce(TRY_CAST(left(trim(published), 10) AS DATE), CASE WHEN iso <> '' THEN TRY_CAST(iso AS DATE) END, CASE WHEN d <> '' THEN TRY_CAST({SPELLED} AS DATE) END) AS event_date FROM (
    SELECT doc_id, {PUBLISHED} AS published, regexp_extract(page, {quoted(ISO_DATE)}, 1) AS iso, regexp_extract(page, {quoted(US_DATE)}, 1) AS d FROM (SELECT doc_id, {PAGE} AS page FROM documents))
""")
def event_dates(spark, folder):
    """The date of a page: its published date, else the first ISO date, else the first spelled-out one; impossible dates are none."""
    d = table(spark, folder, "documents").select("doc_id", F.expr(PUBLISHED).alias("published"), F.expr(PAGE).alias("page"))
    return d.select("doc_id", event_date(F.col("published"), F.col("page")).alias("event_date"))


def event_date(published, page):
    """The published date, else the first ISO date of the page, else the first spelled-out one; impossible dates are none."""
    months = F.create_map(*[F.lit(x) for k, m in enumerate("jan feb mar apr may jun jul aug sep oct nov dec".split()) for x in (m, f"{k + 1:02d}")])
    whole = lambda c: F.when(c.rlike(r"^\d{4}-\d{2}-\d{2}$"), c.try_cast("date"))

    def spelled(d):
        return F.concat_ws("-", F.right(d, F.lit(4)), F.element_at(months, F.lower(F.left(d, F.lit(3)))), F.lpad(F.regexp_extract(d, " +([0-9]+),", 1), 2, "0"))

    # The page is read for spelled-out dates once, if it has no other date: a name in a function stands for the match.
    last = F.transform(F.array(F.regexp_extract(page, US_DATE, 1)), lambda d: F.when(d != "", whole(spelled(d))))
    return F.coalesce(whole(F.substring(F.trim(published), 1, 10)), whole(F.regexp_extract(page, ISO_DATE, 1)), F.get(last, F.lit(0)))


STATES = ["new", "awaiting_reply", "active", "replied"]
OBSERVED = ["connection_accepted", "message_sent", "connection_request_sent", "opt_out", "suppressed", "meeting_booked", "closed", "viewed", ""]
CONTACT = {"state": pick(STATES, "event_id"), "event": pick(OBSERVED, "event_id * 5 + user_id"), "inbound": "event_id % 17 = 0", "connected": "event_id % 13 = 0", "due": "event_id % 3 = 0"}


@query(f"""
SELECT event_id, state, CASE WHEN inbound THEN 'replied' WHEN event = 'connection_accepted' OR connected THEN 'active' WHEN event IN ('message_sent', 'connection_request_sent') THEN 'awaiting_reply'
    WHEN event IN ('opt_out', 'suppressed') THEN 'suppressed' WHEN event = 'meeting_booked' THEN 'meeting' WHEN event = 'closed' THEN 'closed'
    WHEN state = 'awaiting_reply' AND due THEN 'follow_up_due' ELSE state END AS next_state FROM (SELECT event_id, {', '.join(f'{s} AS {n}' for n, s in CONTACT.items())} FROM events)
""")
def contact_transitions(spark, folder):
    """A contact's state after what was observed."""
    e = table(spark, folder, "events").selectExpr("event_id", *[f"{s} AS {n}" for n, s in CONTACT.items()])
    return e.select("event_id", "state", rules.next_state(*(F.col(c) for c in ("state", "event", "inbound", "connected", "due"))).alias("next_state"))


CHANNELS = pick(["email", "linkedin", "email,linkedin", "reddit,instagram", "email,instagram,linkedin", ""], "c_custkey * 7 + 1")
NEXT = {"priority": pick(["P1", "P2", "P3", "P4"], "c_custkey"), "talking": "c_custkey % 6 = 0", "waiting": "c_custkey % 5 = 0", "warm": "c_custkey % 2 = 0", "channels": CHANNELS}


@query(f"""
SELECT c_custkey, CASE WHEN talking THEN 'conversation_followup' WHEN waiting THEN 'follow_up' WHEN warm AND linkedin AND priority = 'P1' THEN 'optional_warm' WHEN email THEN 'initial_outreach' ELSE 'operator_action' END AS recommendation,
    CASE WHEN talking THEN CASE WHEN email THEN 'email' ELSE 'none' END WHEN waiting THEN CASE WHEN linkedin THEN 'linkedin' WHEN email THEN 'email' ELSE 'none' END
         WHEN warm AND linkedin AND priority = 'P1' THEN 'social_content' WHEN email THEN 'email' ELSE 'none' END AS channel,
    array_to_string(CASE WHEN talking THEN CASE WHEN email THEN ['email'] ELSE [] END WHEN waiting THEN list_filter(['linkedin', 'email', 'instagram', 'reddit'], lambda x: list_contains(have, x))[1:2]
         WHEN warm AND linkedin AND priority = 'P1' THEN ['social_content', 'linkedin', 'email'] WHEN email THEN ['email'] ELSE [] END, ',') AS sequence,
    CAST(CASE WHEN talking THEN 0.9 WHEN waiting THEN 0.8 WHEN warm AND linkedin AND priority = 'P1' THEN 0.72 WHEN email THEN 0.82 ELSE 0.7 END AS DECIMAL(3, 2)) AS confidence
FROM (SELECT *, string_split(channels, ',') AS have, list_contains(string_split(channels, ','), 'email') AS email, list_contains(string_split(channels, ','), 'linkedin') AS linkedin FROM (
    SELECT c_custkey, {', '.join(f'{s} AS {n}' for n, s in NEXT.items())} FROM customer))
""")
def next_recommendation(spark, folder):
    """What to do next with an account, over which channel, in which order, and how sure that is."""
    c = table(spark, folder, "customer").selectExpr("c_custkey", *[f"{s} AS {n}" for n, s in NEXT.items()]).withColumn("have", F.split("channels", ","))
    has = lambda x: F.array_contains("have", x)
    none, only = F.array().cast("array<string>"), F.array(F.lit("email"))
    known = F.slice(F.filter(F.array(*map(F.lit, ("linkedin", "email", "instagram", "reddit"))), lambda x: F.array_contains(F.col("have"), x)), 1, 2)
    advice = lambda kind, channel, sequence, sure: F.struct(F.lit(kind).alias("recommendation"), channel.alias("channel"), F.array_join(sequence, ",").alias("sequence"), F.lit(sure).cast("decimal(3,2)").alias("confidence"))
    mail = F.when(has("email"), "email").otherwise("none")
    out = (
        F.when(F.col("talking"), advice("conversation_followup", mail, F.when(has("email"), only).otherwise(none), 0.9))
        .when(F.col("waiting"), advice("follow_up", F.when(has("linkedin"), "linkedin").otherwise(mail), known, 0.8))
        .when(F.col("warm") & has("linkedin") & (F.col("priority") == "P1"), advice("optional_warm", F.lit("social_content"), F.array(*map(F.lit, ("social_content", "linkedin", "email"))), 0.72))
        .when(has("email"), advice("initial_outreach", F.lit("email"), only, 0.82)).otherwise(advice("operator_action", F.lit("none"), none, 0.7))
    )
    return c.select("c_custkey", out.alias("o")).select("c_custkey", "o.*")


CODES = [200, 401, 403, 400, 422, 429, 500, 503, 418, 421, 450, 550, 599]
CODE = "CASE " + " ".join(f"WHEN event_id % {len(CODES)} = {k} THEN {c}" for k, c in enumerate(CODES)) + " END"
HTTP = {401: "auth", 403: "policy_block", 400: "invalid_request", 422: "invalid_request", 429: "rate_limit", 500: "provider", 502: "provider", 503: "provider", 504: "provider"}
RESULT, SAFE = pick(["valid", "VALID", "invalid", "catch_all", None, "other"], "event_id * 3 + user_id"), "event_id % 2 = 0"


@query(f"""
SELECT event_id, code, CASE {' '.join(f"WHEN code = {k} THEN '{v}'" for k, v in HTTP.items())} WHEN code >= 400 THEN 'other' ELSE 'none' END AS http_error,
    CASE WHEN event_id % 19 = 0 THEN 'ambiguous' WHEN code < 400 THEN 'accepted' WHEN code < 500 THEN 'transient' ELSE 'permanent' END AS smtp_outcome,
    CASE WHEN event_id % 23 = 0 THEN 'CACHED' WHEN code < 400 THEN 'SUCCEEDED' WHEN code = 429 THEN 'RATE_LIMITED' ELSE 'FAILED' END AS attempt_status,
    CASE WHEN result = 'invalid' THEN 'invalid' WHEN result = 'valid' AND safe THEN 'verified' ELSE 'unknown' END AS verification,
    CAST(CASE WHEN result = 'invalid' OR result = 'valid' AND safe THEN 0.95 ELSE 0.4 END AS DECIMAL(3, 2)) AS confidence
FROM (SELECT event_id, {CODE} AS code, lower({RESULT}) AS result, {SAFE} AS safe FROM events)
""")
def provider_outcomes(spark, folder):
    """What codes and results of HTTP, SMTP and verification providers mean; a connection lost after submission is ambiguous."""
    e = table(spark, folder, "events").selectExpr("event_id", f"{CODE} AS code", f"lower({RESULT}) AS result", f"{SAFE} AS safe")
    code, good = F.col("code"), F.coalesce((F.col("result") == "valid") & F.col("safe"), F.lit(False))
    bad = F.coalesce(F.col("result") == "invalid", F.lit(False))
    error = F.coalesce(F.create_map(*[F.lit(x) for kv in HTTP.items() for x in kv])[code], F.when(code >= 400, "other").otherwise("none"))
    return e.select(
        "event_id", "code", error.alias("http_error"),
        F.when(F.col("event_id") % 19 == 0, "ambiguous").when(code < 400, "accepted").when(code < 500, "transient").otherwise("permanent").alias("smtp_outcome"),
        F.when(F.col("event_id") % 23 == 0, "CACHED").when(code < 400, "SUCCEEDED").when(code == 429, "RATE_LIMITED").otherwise("FAILED").alias("attempt_status"),
        F.when(bad, "invalid").when(good, "verified").otherwise("unknown").alias("verification"), F.when(bad | good, 0.95).otherwise(0.4).cast("decimal(3,2)").alias("confidence"),
    )


FOUND = "concat(text, ' ', " + pick(["Ann@Acme.com and info@acme.com", "ann@acme.com, ANN@ACME.COM", "hr@x.org", "bob.b@mail.example.org;sales@x.io", ""], "doc_id") + ", ' ')"
EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"


@query(f"""
SELECT doc_id, array_to_string(list_sort(list_distinct(list_filter(list_transform(regexp_extract_all(page, {quoted(EMAIL)}), lambda e: lower(e)), lambda e: split_part(e, '@', 1) NOT IN ({listed(V.GENERIC_MAILBOXES)})))), ',') AS contacts
FROM (SELECT doc_id, {FOUND} AS page FROM documents)
""")
def personal_contacts(spark, folder):
    """The addresses of a page that belong to persons, not to generic mailboxes: lower case, distinct, sorted."""
    found = F.transform(F.regexp_extract_all(F.expr(FOUND), F.lit(EMAIL), F.lit(0)), F.lower)
    own = F.filter(found, lambda e: ~F.substring_index(e, "@", 1).isin(*V.GENERIC_MAILBOXES))
    return table(spark, folder, "documents").select("doc_id", F.array_join(F.array_sort(F.array_distinct(own)), ",").alias("contacts"))


# Ten names with profiles that match, half match or lack; claims about them from line items.
MAKERS = {
    "full_name": pick(["Ada Lovelace", "Grace Hopper", "Mary Ann Evans", "Cher", "Jean-Luc O'Neil"], "s_suppkey"), "job_title": pick(["CTO", "Head of Product", None, "", "CFO & VP Finance"], "s_suppkey * 3"),
    "role_family": pick(["security", None, ""], "s_suppkey"), "profile": pick(["https://www.linkedin.com/in/ada-lovelace", "https://www.linkedin.com/in/ghopper", None, "https://www.linkedin.com/in/cher", "https://www.linkedin.com/in/jean-luc-o-neil-7", "https://www.linkedin.com/in/grace-hopper"], "s_suppkey * 7"),
    "domain": pick(["acme.com", "www.Acme.com", "other.org"], "s_suppkey * 11"), "company_name": pick(["Acme", None], "s_suppkey * 13"),
}
CLAIMS = {
    "claim_type": pick(["company_current", "person", "former_role", "Company Page", None, "person", "person"], "l_orderkey + l_linenumber"), "claim_name": pick(["Ada Lovelace", "GRACE  hopper", "Mary Ann Evans", "jean luc o neil", None, "cher", "Ada Byron"], "l_orderkey * 3 + l_linenumber"),
    "claim_text": pick(["leads engineering", "leads engineering", "leads engineering", "ex-acme", "previously cfo of other", "non-executive board director", "leads", "leads", "leads", "leads"], "l_orderkey * 7 + l_linenumber * 5"),
    "ended": "l_orderkey % 23 = 0", "is_current": "CASE WHEN l_orderkey % 29 = 0 THEN FALSE WHEN l_orderkey % 3 = 0 THEN TRUE END", "claim_domain": pick(["acme.com", "WWW.ACME.com", None], "l_orderkey"), "claim_company": pick(["ACME", None, "Zed"], "l_linenumber"),
    "source_url": pick(["https://www.acme.com/team", "https://linkedin.com/in/x", "https://blog.example.org/a", None, "https://news.acme.com:8443/b", "https://www.linkedin.com/y", "https://notacme.com"], "l_orderkey * 5 + l_linenumber * 3"),
}
_TOKENS = lambda c: f"list_filter(regexp_split_to_array(lower(coalesce({c}, '')), '[^a-z0-9]+'), lambda t: t <> '')"
_AT = "regexp_replace(lower(regexp_extract(coalesce(source_url, ''), '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)', 1)), '^www\\.', '')"
_TARGET = "regexp_replace(lower(trim(domain)), '^www\\.', '')"
_SLUG = "regexp_extract(profile, '([^/]*)$', 1)"


@query(f"""
WITH p AS (SELECT s_suppkey AS person_id, {', '.join(f'{s} AS {k}' for k, s in MAKERS.items())} FROM supplier), e AS (SELECT l_suppkey AS person_id, {', '.join(f'{s} AS {k}' for k, s in CLAIMS.items())} FROM lineitem WHERE l_partkey % 9 = 0),
met AS (SELECT e.*, domain, company_name, lower(coalesce(claim_type, '')) AS kind, coalesce(claim_text, '') AS body, {_AT} AS h, {_TARGET} AS target FROM e JOIN p USING (person_id) WHERE trim(coalesce(claim_name, '')) <> '' AND {_TOKENS('claim_name')} = {_TOKENS('full_name')}),
seen AS (SELECT person_id, bool_or(h <> '' AND (h = target OR ends_with(h, '.' || target))) AS site, bool_or(contains(kind, 'company') AND (regexp_replace(lower(coalesce(claim_domain, '')), '^www\\.', '') = target OR coalesce(company_name <> '' AND lower(coalesce(claim_company, '')) = lower(company_name), false))) AS claimed,
    bool_or({has_any('kind', people.FORMER)} OR {has_any('body', people.FORMER)}) AS former, bool_or(coalesce(ended, false) OR coalesce(NOT is_current, false)) AS stale, bool_or({has_any('body', people.BOARD)} OR regexp_matches(body, {quoted(people.PAST_TITLE)})) AS board, count(DISTINCT CASE WHEN h NOT IN ('', 'linkedin.com') THEN h END) >= 2 AS free FROM met GROUP BY person_id),
f AS (SELECT p.*, coalesce(site, false) AS site, coalesce(claimed, false) AS claimed, coalesce(former, false) AS former, coalesce(stale, false) AS stale, coalesce(free, false) AS free, coalesce(board, false) AND {has_any("lower(coalesce(job_title, ''))", people.OPERATING)} AS clash,
    coalesce(len({_TOKENS('full_name')}) >= 2 AND len({_TOKENS(_SLUG)}) >= 2 AND list_has_all({_TOKENS(_SLUG)}, {_TOKENS('full_name')}), false) AND profile IS NOT NULL AS slug, coalesce(job_title, '') <> '' OR coalesce(role_family, '') <> '' AS titled FROM p LEFT JOIN seen USING (person_id)),
g AS (SELECT *, (site OR claimed) AND NOT former AND NOT stale AS here FROM f),
s AS (SELECT *, CAST(greatest(0, least(100, CASE WHEN slug OR free THEN 30 ELSE 0 END + CASE WHEN here THEN 30 ELSE 0 END + CASE WHEN titled THEN 20 ELSE 0 END + CASE WHEN site THEN 10 ELSE 0 END + CASE WHEN free THEN 10 ELSE 0 END - CASE WHEN former THEN 25 WHEN stale THEN 15 ELSE 0 END - CASE WHEN profile IS NOT NULL AND NOT slug THEN 20 ELSE 0 END)) / 100 AS DECIMAL(3, 2)) AS identity,
    CAST(CASE WHEN former OR stale THEN 0 WHEN site AND free THEN 0.95 WHEN site THEN 0.85 WHEN here THEN 0.75 ELSE 0 END AS DECIMAL(3, 2)) AS employer, CAST(CASE WHEN slug THEN 0.95 WHEN profile IS NOT NULL THEN 0.80 ELSE 0 END AS DECIMAL(3, 2)) AS linkedin, CAST(CASE WHEN clash THEN 0 WHEN titled THEN 1 ELSE 0 END AS DECIMAL(3, 2)) AS title FROM g),
o AS (SELECT *, CAST(least(1, identity * 0.65 + employer * 0.20 + linkedin * 0.15) AS DECIMAL(5, 4)) AS overall FROM s)
SELECT person_id, identity, employer, linkedin, title, overall, CASE WHEN profile IS NULL OR employer < 0.75 OR title < 0.75 THEN 'review' WHEN overall >= 0.90 THEN 'outreach_ready' WHEN overall >= 0.75 THEN 'strong_candidate' ELSE 'review' END AS status,
    array_to_string({labels(('slug OR free', 'name_match'), ('here', 'current_company_match'), ('titled', 'title_match'), ('site', 'company_site_support'), ('free', 'independent_source_support'), ('former', 'former_employee_penalty'), ('stale', 'stale_employment_penalty'), ('profile IS NOT NULL AND NOT slug', 'ambiguous_name_penalty'), ('clash', 'current_title_conflict'))}, ',') AS reasons FROM o
""")
def decision_maker_resolution(spark, folder):
    """Confidences and status of found people from the evidence that names them."""
    found = table(spark, folder, "supplier").selectExpr("s_suppkey AS person_id", *[f"{s} AS {k}" for k, s in MAKERS.items()])
    claims = table(spark, folder, "lineitem").where("l_partkey % 9 = 0").selectExpr("l_suppkey AS person_id", *[f"{s} AS {k}" for k, s in CLAIMS.items()])
    return people.resolve_people(found, claims)
