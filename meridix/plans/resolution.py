"""Queries on entity resolution: parts stand for leads and for candidate entities."""

from __future__ import annotations

from pyspark.sql import functions as F

from meridix.functions import text as T
from meridix.operators import matching, windows
from meridix.plans.registry import query
from meridix.plans.sqltext import listed
from meridix.sources.tables import table

DOMAIN = "CASE WHEN p_partkey % 7 = 0 THEN '' WHEN p_partkey % 2 = 0 THEN 'WWW.shop.x' || p_partkey % 300 || '.co.uk' ELSE 'https://x' || p_partkey % 300 || '.co.uk/about' END"
BARE = f"regexp_replace(regexp_extract(lower({DOMAIN}), '^(?:https?://)?(?:www\\.)?([^/]*)', 1), '\\.+$', '')"
BLOCKS = f"""
SELECT p_partkey AS id, unnest(list_concat(list_transform(list_filter(list_distinct(regexp_split_to_array(lower(p_name), '[^a-z0-9]+')), lambda t: t <> '' AND t NOT IN ({listed(T.LEGAL_SUFFIXES)})), lambda t: 't:' || t),
    CASE WHEN {BARE} <> '' THEN ['d:' || array_to_string(string_split({BARE}, '.')[-3:], '.')] ELSE [] END)) AS block FROM part
"""
PAIRS = f"SELECT DISTINCT a.id AS left_id, b.id AS right_id FROM ({BLOCKS}) a JOIN ({BLOCKS}) b ON a.block = b.block AND a.id <> b.id"
#: Candidates of a lead, by id: the table has no order of arrival.
BUDGET = 25
CANDIDATES = f"""
SELECT left_id, right_id, position FROM (SELECT left_id, right_id, row_number() OVER (PARTITION BY left_id ORDER BY right_id) AS position FROM (
    {PAIRS})) WHERE position <= {BUDGET}
"""


def _candidates(spark, folder):
    named = table(spark, folder, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), T.bare_host(F.expr(DOMAIN)).alias("domain"))
    return matching.blocked_pairs(named, named, BUDGET)


@query(CANDIDATES)
def blocking_candidates(spark, folder):
    """The first 25 candidates of each lead that share a name token or a registrable domain with it."""
    return _candidates(spark, folder).withColumn("position", F.col("position").cast("long"))


# What a candidate record says of itself and of the lead follows from the two keys.
FACTS = {
    "exact_official_corporate_url": "(left_id * 31 + right_id) % 97 = 0", "explicit_official_identity_tie": "(left_id * 17 + right_id) % 89 = 0", "registered_identity_match": "(left_id + right_id * 3) % 11 = 0",
    "corporate_social_match": "(left_id + right_id) % 23 = 0", "parent_relationship_consistent": "(left_id + right_id * 2) % 29 = 0", "conflicting_authoritative_domain": "(left_id * 7 + right_id) % 41 = 0",
    "conflicting_geography": "(left_id * 5 + right_id) % 53 = 0", "clearly_different_legal_entity": "(left_id * 3 + right_id) % 61 = 0", "historical_only": "(left_id + right_id * 5) % 43 = 0",
    "external_provider_relationship": "(left_id + right_id * 7) % 59 = 0",
}
NAME = f"array_to_string(list_filter(regexp_split_to_array(lower({{}}), '[^a-z0-9]+'), lambda t: t <> '' AND t NOT IN ({listed(T.LEGAL_SUFFIXES)})), ' ')"
HELD = {
    "exact_verified_canonical_domain": "l_domain <> '' AND l_domain = r_domain AND r_size % 3 = 0", "normalized_company_name": "l_name <> '' AND l_name = r_name", "geography_match": "l_brand = r_brand",
} | FACTS
POINTS = matching.STRONG | matching.MEDIUM | matching.NEGATIVE
COMPARISON = f"""
SELECT left_id, right_id, {' + '.join(f'CASE WHEN {c} THEN {POINTS[k]} ELSE 0 END' for k, c in HELD.items())} AS score, {' OR '.join(HELD[k] for k in matching.STRONG)} AS strong, {' OR '.join(HELD[k] for k in matching.NEGATIVE)} AS rejected
FROM (SELECT left_id, right_id, l.d AS l_domain, l.n AS l_name, l.p_brand AS l_brand, r.d AS r_domain, r.n AS r_name, r.p_brand AS r_brand, r.p_size AS r_size FROM ({{pairs}})
    JOIN (SELECT *, {BARE} AS d, {NAME.format('p_name')} AS n FROM part) l ON left_id = l.p_partkey JOIN (SELECT *, {BARE} AS d, {NAME.format('p_name')} AS n FROM part) r ON right_id = r.p_partkey)
"""
COMPARED = COMPARISON.replace("{pairs}", CANDIDATES)


@query(f"""
SELECT left_id, CASE WHEN eligible IS NULL THEN 'UNRESOLVED' WHEN eligible = 0 AND plausible > 0 THEN 'AMBIGUOUS' WHEN eligible = 0 THEN 'NO_MATCH' WHEN eligible > 1 THEN 'CONFLICT' WHEN left_id % 4 = 0 THEN 'MATCHED_WITH_RELATIONSHIP' ELSE 'MATCHED' END AS status,
    CASE WHEN eligible = 1 THEN best_id END AS best_id, CAST(CASE WHEN eligible = 1 THEN best_score END AS INT) AS score, coalesce(n_rejected, 0) AS n_rejected
FROM (SELECT p_partkey AS left_id FROM part) LEFT JOIN (
    SELECT left_id, count_if(strong AND NOT rejected) AS eligible, count_if(rejected) AS n_rejected, count_if(NOT rejected AND score > 0) AS plausible,
        max(right_id) FILTER (WHERE strong AND NOT rejected) AS best_id, max(score) FILTER (WHERE strong AND NOT rejected) AS best_score FROM ({COMPARISON.replace("{pairs}", PAIRS)}) GROUP BY left_id) USING (left_id)
""")
def entity_compare_adjudicate(spark, folder):
    """Each lead's decision over all records that share a block with it. The weak signal of similar names (name_similarity) is left out: it ranks, but never decides."""
    named = table(spark, folder, "part").select(F.col("p_partkey").alias("id"), T.normalized_name(F.col("p_name")).alias("name"), T.bare_host(F.expr(DOMAIN)).alias("domain"), F.col("p_brand").alias("brand"), F.col("p_size").alias("size"))
    return matching.adjudicate(_leads(spark, folder), matching.compare(matching.all_pairs(named, named), _signals()))


def _leads(spark, folder):
    return table(spark, folder, "part").select(F.col("p_partkey").alias("left_id"), (F.col("p_partkey") % 4 == 0).alias("related"))


def _compared(spark, folder):
    """Leads, and their first candidates with what speaks for and against each."""
    p = table(spark, folder, "part")
    side = lambda s: p.select(F.col("p_partkey").alias(f"{s}_id"), T.bare_host(F.expr(DOMAIN)).alias(f"{s}_domain"), T.normalized_name(F.col("p_name")).alias(f"{s}_name"), F.col("p_brand").alias(f"{s}_brand"), F.col("p_size").alias(f"{s}_size"))
    j = _candidates(spark, folder).join(side("left").hint("merge"), "left_id").join(side("right").hint("merge"), "right_id")
    return _leads(spark, folder), matching.compare(j, _signals())


def _signals():
    same = lambda c: (F.col(f"left_{c}") != "") & (F.col(f"left_{c}") == F.col(f"right_{c}"))
    signals = {k: F.expr(c) for k, c in FACTS.items()}
    return signals | {"exact_verified_canonical_domain": same("domain") & (F.col("right_size") % 3 == 0), "normalized_company_name": same("name"), "geography_match": F.col("left_brand") == F.col("right_brand")}


DECIDED = "CASE WHEN n IS NULL THEN 'UNRESOLVED' WHEN eligible = 0 AND plausible > 0 THEN 'AMBIGUOUS' WHEN eligible = 0 THEN 'NO_MATCH' WHEN eligible > 1 THEN 'CONFLICT' WHEN left_id % 4 = 0 THEN 'MATCHED_WITH_RELATIONSHIP' ELSE 'MATCHED' END"


@query(f"""
WITH compared AS ({COMPARED}),
lists AS (SELECT left_id, count(*) AS n, count_if(strong AND NOT rejected) AS eligible, count_if(NOT rejected AND score > 0) AS plausible, max(right_id) FILTER (WHERE strong AND NOT rejected) AS top, max(score) FILTER (WHERE strong AND NOT rejected) AS points,
    string_agg(right_id || ':' || score, '|' ORDER BY (strong AND NOT rejected) DESC, score DESC, right_id DESC) AS material, string_agg(right_id::VARCHAR, ',' ORDER BY score DESC, right_id DESC) FILTER (WHERE rejected) AS gone FROM compared GROUP BY left_id),
decided AS (SELECT *, {DECIDED} AS status FROM (SELECT p_partkey AS left_id FROM part) LEFT JOIN lists USING (left_id))
SELECT left_id, status, CASE WHEN eligible = 1 THEN top END AS best_id, 'erd:' || left_id || ':' || substr(sha256(left_id || '|' || coalesce(material, '')), 1, 24) AS decision_id, coalesce(gone, '') AS rejected, NOT starts_with(status, 'MATCHED') AS research_required,
    'candidate_generation: Selected ' || coalesce(n, 0) || ' candidates with budget {BUDGET}. / adjudication: ' || CASE status {' '.join(f"WHEN '{k}' THEN '{v}'" for k, v in matching.OUTCOMES.items())} ELSE 'Candidate ' || top || ' selected with score ' || points || '.' END AS trace FROM decided
""")
def resolution_records(spark, folder):
    """What is stored of each decision: its id, the candidates it rejects and how it came about."""
    return matching.decision_records(*_compared(spark, folder), BUDGET)


@query()
def name_similarity(spark, folder):
    """Ratcliff/Obershelp ratio of sorted name tokens for all records that share a block: no built-in has it, so an Arrow-fed function scores the pairs, two names once a task. Null without a name."""
    p = table(spark, folder, "part").select(F.col("p_partkey").alias("id"), F.array_join(F.array_sort(T.name_tokens(F.col("p_name"))), " ").alias("name"), T.bare_host(F.expr(DOMAIN)).alias("domain"))
    return matching.all_pairs(p, p).select("left_id", "right_id", F.round(matching.name_ratio("left_name", "right_name"), 4).alias("ratio"))


HITS = "SELECT p_partkey % 40 AS company, p_partkey % 5 AS purpose, CASE p_size % 6 WHEN 0 THEN 'https://acme' || p_partkey % 40 || '.com/' WHEN 1 THEN 'https://www.linkedin.com/in/' WHEN 2 THEN 'https://forbes.com/' WHEN 3 THEN 'https://blog.org/' WHEN 4 THEN 'https://www.acme' || p_partkey % 40 || '.com/' ELSE 'https://uk.linkedin.com/' END || p_brand || CASE WHEN p_partkey % 3 = 0 THEN '' ELSE '/' || p_type END AS url FROM part"
TIER = "CASE WHEN host = 'acme' || company || '.com' THEN 0 WHEN host = 'linkedin.com' OR ends_with(host, '.linkedin.com') THEN 1 WHEN host IN ('crunchbase.com', 'theorg.com', 'forbes.com', 'sec.gov') THEN 2 ELSE 3 END"


@query(f"""
SELECT company, url, row_number() OVER (PARTITION BY company ORDER BY least_tier, length(url), url) AS place FROM (
    SELECT company, url, min(tier) AS least_tier FROM (SELECT company, url, {TIER} AS tier FROM (SELECT *, regexp_replace(lower(regexp_extract(url, '^https://([^/]*)', 1)), '^www\\.', '') AS host FROM ({HITS}))) WHERE tier < 3 GROUP BY company, url)
QUALIFY place <= 10
""")
def fetch_urls(spark, folder):
    """The ten best addresses to read of each company: its own host, then profiles, then known directories, shorter ones first; each once."""
    p = table(spark, folder, "part").selectExpr("p_partkey % 40 AS company", HITS.split(" AS purpose, ", 1)[1].rsplit(" FROM part", 1)[0])
    host = F.regexp_replace(F.lower(F.regexp_extract("url", "^https://([^/]*)", 1)), r"^www\.", "")
    own = F.concat(F.lit("acme"), F.col("company").cast("string"), F.lit(".com"))
    tier = F.when(host == own, 0).when((host == "linkedin.com") | host.endswith(".linkedin.com"), 1).when(host.isin("crunchbase.com", "theorg.com", "forbes.com", "sec.gov"), 2).otherwise(3)
    once = p.withColumn("tier", tier).where("tier < 3").groupBy("company", "url").agg(F.min("tier").alias("tier"))
    return windows.top_per_group(once, ["company"], [F.col("tier"), F.length("url"), F.col("url")], 10, "place").select("company", "url", F.col("place").cast("long").alias("place"))
