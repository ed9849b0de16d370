"""Queries on intake: raw lead records to normal fields, findings, fingerprints and one decision a record."""

from __future__ import annotations

from pyspark.sql import functions as F

from meridix.functions import text as T
from meridix.plans.people import pick
from meridix.plans.registry import query
from meridix.plans.sqltext import listed, quoted
from meridix.sources.tables import table

# A source's record for each customer; every tenth comes a second time under a new number.
RAW = {
    "city": pick(["  New   York ", "Berlin", None, "", "São Paulo"], "c_custkey * 3"),
    "country_code": pick(["us", "GB", " de ", "USA", None, "1x"], "c_custkey"),
    "display_name": "CASE WHEN c_custkey % 31 = 0 THEN NULL ELSE c_name END",
    "domain": "CASE c_custkey % 9 WHEN 0 THEN 'HTTPS://WWW.Acme' || c_custkey || '.CO.UK:443/path/' WHEN 1 THEN 'acme' || c_custkey || '.com' WHEN 2 THEN ' Acme' || c_custkey || '.Example.ORG. ' WHEN 3 THEN '' "
    "WHEN 4 THEN NULL WHEN 5 THEN 'not a domain' WHEN 6 THEN 'http://user@shop.acme' || c_custkey || '.com.au:8080/x?y=1#z' WHEN 7 THEN 'localhost' ELSE 'www.a.b.acme.com.mx' END",
    "email": pick(["First.Last@ACME.COM", "  a@b@C.com", "nobody", None, " "], "c_custkey * 7 + 1"),
    "phone": pick(["+1 (555) 010-77", "555.010.99 ", None, "n/a", "+49-30/123"], "c_custkey * 11 + 2"),
    "url": pick(["HTTPS://Acme.com:443/a/b/#top", "http://Acme.com/", "http://acme.com:8080/?q=1", "acme.com/x/", None, "https://u:p@acme.com//"], "c_custkey * 5 + 3"),
}
FIELDS = [*RAW]
SOURCE = ", ".join(f"{sql} AS {name}" for name, sql in RAW.items())
RECORDS = f"SELECT c_custkey AS record_id, c_custkey % 13 = 0 AS corrupt, c_custkey % 37 = 0 AS empty, {SOURCE} FROM customer UNION ALL SELECT c_custkey + 1000000, false, false, {SOURCE} FROM customer WHERE c_custkey % 10 = 0"
SPACE = "[\\s\\x{00A0}]+"
TEXT = "trim(regexp_replace({}, '" + SPACE + "', ' ', 'g'))"


def _records(spark, folder):
    c = table(spark, folder, "customer")
    fields = [f"{sql} AS {name}" for name, sql in RAW.items()]
    first = c.selectExpr("c_custkey AS record_id", "c_custkey % 13 = 0 AS corrupt", "c_custkey % 37 = 0 AS empty", *fields)
    return first.unionByName(c.where("c_custkey % 10 = 0").selectExpr("c_custkey + 1000000 AS record_id", "false AS corrupt", "false AS empty", *fields))


def _blank(raw: str, value: str) -> str:
    return f"CASE WHEN trim(regexp_replace({raw}, '{SPACE}', ' ', 'g')) <> '' THEN {value} END"


HOST = "regexp_replace(regexp_extract(CASE WHEN contains({0}, '://') THEN {0} ELSE '//' || {0} END, '^(?:[^:/?#]+:)?//(?:[^/?#]*@)?([^/?#:]*)', 1), '\\.+$', '')"
BARE_URL = "regexp_replace({}, '#.*$', '')"
URL_HEAD = f"regexp_replace(regexp_replace(lower(regexp_extract({{0}}, '^([A-Za-z][A-Za-z0-9+.-]*://)', 1)) || regexp_extract({{0}}, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*@)', 1) || lower(regexp_extract({{0}}, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#]*@)?([^/?#]*)', 1)), '^(http://.*):80$', '\\1'), '^(https://.*):443$', '\\1')"
PATH = "regexp_extract({0}, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1)"
QUERY = "regexp_extract({0}, '^[^?#]*(\\?[^#]*)', 1)"
NORMAL = {
    "city": TEXT, "display_name": TEXT, "country_code": f"upper({TEXT})", "domain": HOST.replace("{0}", f"lower({TEXT.replace('{}', '{0}')})"),
    "email": f"CASE WHEN contains({{0}}, '@') THEN regexp_extract({TEXT.replace('{}', '{0}')}, '^(.*)@[^@]*$', 1) || '@' || lower(list_last(string_split({TEXT.replace('{}', '{0}')}, '@'))) ELSE {TEXT.replace('{}', '{0}')} END",
    "phone": f"CASE WHEN starts_with(regexp_replace({TEXT.replace('{}', '{0}')}, '[\\s().-]+', '', 'g'), '+') THEN '+' ELSE '' END || regexp_replace({{0}}, '[^0-9]', '', 'g')",
}
URL = f"""CASE WHEN NOT regexp_matches({{0}}, '^[A-Za-z][A-Za-z0-9+.-]*://') THEN rtrim({{0}}, '/') ELSE {URL_HEAD} || CASE WHEN {PATH} = '/' THEN '/' ELSE rtrim({PATH}, '/') END || {QUERY} END"""
NORMAL["url"] = URL.replace("{0}", TEXT.replace("{}", "{0}"))


def _normal(field: str) -> str:
    return _blank(field, NORMAL[field].replace("{0}", field).replace("{}", field))


STATE = "CASE WHEN normal IS NULL THEN 'missing' WHEN normal <> raw THEN 'normalized' ELSE 'observed' END"
REASONS = {"domain": "normalized domain representation", "url": "normalized URL representation", "email": "normalized email representation", "phone": "conservative phone representation", "country_code": "normalized country representation"}
WHY = "CASE WHEN raw IS NULL THEN 'source supplied no value' WHEN normal IS NULL THEN 'empty source string treated as missing' " + " ".join(f"WHEN field = '{k}' THEN '{v}'" for k, v in REASONS.items()) + " ELSE 'Unicode and whitespace normalization' END"


def _normalised(field: str):
    c = F.col(field)
    made = {"domain": T.domain, "url": T.canonical_url, "email": T.email, "phone": T.phone, "country_code": lambda x: F.upper(T.collapse(x))}.get(field, T.collapse)
    return F.when(T.collapse(c) != "", made(c))


@query(" UNION ALL ".join(f"SELECT record_id, field, raw, normal, {STATE} AS state, {WHY} AS reason FROM (SELECT record_id, '{f}' AS field, {f} AS raw, {_normal(f)} AS normal FROM ({RECORDS}))" for f in FIELDS))
def field_observations(spark, folder):
    """Each field of each record: raw and normal value, whether it is missing, normalized or observed, and why."""
    each = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("raw"), _normalised(f).alias("normal")) for f in FIELDS])
    o = _records(spark, folder).select("record_id", F.explode(each).alias("o")).select("record_id", "o.*")
    state = F.when(F.col("normal").isNull(), "missing").when(F.col("normal") != F.col("raw"), "normalized").otherwise("observed")
    reason = F.create_map(*[F.lit(x) for kv in REASONS.items() for x in kv])[F.col("field")]
    why = F.when(F.col("raw").isNull(), "source supplied no value").when(F.col("normal").isNull(), "empty source string treated as missing").otherwise(F.coalesce(reason, F.lit("Unicode and whitespace normalization")))
    return o.select("record_id", "field", "raw", "normal", state.alias("state"), why.alias("reason"))


PAYLOAD = "json_object(" + ", ".join(f"'{f}', {f}" for f in FIELDS) + ")::VARCHAR"
SHORT = "regexp_replace(split_part(split_part(regexp_replace(lower(trim(domain)), '^[^:]*://', ''), '/', 1), ':', 1), '\\.+$', '')"
FOUND = {
    "EMPTY_SOURCE_PAYLOAD": ("ERROR", "empty"),
    "RAW_FINGERPRINT_MISMATCH": ("ERROR", "stored <> digest"),
    "INVALID_DOMAIN": ("ERROR", f"coalesce(domain, '') <> '' AND NOT (regexp_full_match({SHORT}, '(?i)[a-z0-9](?:[a-z0-9.-]{{0,253}}[a-z0-9])?') AND contains({SHORT}, '.'))"),
    "INVALID_COUNTRY_CODE_FORMAT": ("WARNING", "coalesce(country_code, '') <> '' AND NOT regexp_full_match(upper(trim(country_code)), '[A-Z]{2}')"),
    "MISSING_IDENTITY_ANCHOR": ("ERROR", f"{_normal('display_name')} IS NULL AND {_normal('domain')} IS NULL AND {_normal('url')} IS NULL"),
}
DIGESTED = f"SELECT *, sha256({PAYLOAD}) AS digest, CASE WHEN corrupt THEN sha256('x' || {PAYLOAD}) ELSE sha256({PAYLOAD}) END AS stored FROM ({RECORDS})"
FINDINGS = "list_filter([" + ", ".join(f"CASE WHEN {c} THEN '{code}' END" for code, (_, c) in FOUND.items()) + "], lambda x: x IS NOT NULL)"
ERRORS = [code for code, (severity, _) in FOUND.items() if severity == "ERROR"]


def _found(spark, folder):
    """Records with their digest (of compact JSON, keys in order, nulls kept) and the codes of their findings."""
    r = _records(spark, folder)
    payload = F.to_json(F.struct(*FIELDS), {"ignoreNullFields": "false"})
    r = r.withColumn("digest", F.sha2(payload, 256)).withColumn("stored", F.when(F.col("corrupt"), F.sha2(F.concat(F.lit("x"), payload), 256)).otherwise(F.col("digest")))
    filled = lambda c: F.coalesce(F.col(c), F.lit("")) != ""
    short = T.plausible_host(F.col("domain"))
    conditions = {
        "EMPTY_SOURCE_PAYLOAD": F.col("empty"), "RAW_FINGERPRINT_MISMATCH": F.col("stored") != F.col("digest"),
        "INVALID_DOMAIN": filled("domain") & ~(short.rlike(r"(?i)^[a-z0-9](?:[a-z0-9.-]{0,253}[a-z0-9])?$") & short.contains(".")),
        "INVALID_COUNTRY_CODE_FORMAT": filled("country_code") & ~F.upper(F.trim("country_code")).rlike("^[A-Z]{2}$"),
        "MISSING_IDENTITY_ANCHOR": _normalised("display_name").isNull() & _normalised("domain").isNull() & _normalised("url").isNull(),
    }
    return r.select("record_id", "digest", F.array_compact(F.array(*[F.when(conditions[code], code) for code in FOUND])).alias("codes"))


@query(f"SELECT record_id, code, CASE WHEN code IN ({listed(ERRORS)}) THEN 'ERROR' ELSE 'WARNING' END AS severity FROM (SELECT record_id, unnest({FINDINGS}) AS code FROM ({DIGESTED}))")
def validation_findings(spark, folder):
    """What is wrong with each record, and how much."""
    return _found(spark, folder).select("record_id", F.explode("codes").alias("code")).withColumn("severity", F.when(F.col("code").isin(*ERRORS), "ERROR").otherwise("WARNING"))


@query(f"""
SELECT record_id, first_id AS canonical_id, CASE WHEN first_id <> record_id THEN 'DUPLICATE' WHEN len(list_intersect(codes, [{listed(ERRORS)}])) > 0 THEN 'QUARANTINED' WHEN len(codes) > 0 THEN 'ACCEPTED_WITH_WARNINGS' ELSE 'ACCEPTED' END AS state
FROM (SELECT record_id, codes, min(record_id) OVER (PARTITION BY digest) AS first_id FROM (SELECT record_id, digest, {FINDINGS} AS codes FROM ({DIGESTED})))
""")
def intake_decisions(spark, folder):
    """One decision a record: a repeat of an earlier record with the same digest is a duplicate, whatever its findings; errors quarantine, warnings don't."""
    r = _found(spark, folder)
    # Partial minima and a join: no digest's rows come to one task in full.
    first = r.groupBy("digest").agg(F.min("record_id").alias("canonical_id"))
    errors = F.arrays_overlap("codes", F.array(*map(F.lit, ERRORS)))
    state = F.when(F.col("canonical_id") != F.col("record_id"), "DUPLICATE").when(errors, "QUARANTINED").when(F.size("codes") > 0, "ACCEPTED_WITH_WARNINGS").otherwise("ACCEPTED")
    return r.join(first, "digest").select("record_id", "canonical_id", state.alias("state"))


@query(f"SELECT state, count(*) AS n, count_if(n_warnings > 0) AS with_warnings FROM (SELECT *, CASE WHEN first_id <> record_id THEN 'DUPLICATE' WHEN len(list_intersect(codes, [{listed(ERRORS)}])) > 0 THEN 'QUARANTINED' WHEN len(codes) > 0 THEN 'ACCEPTED_WITH_WARNINGS' ELSE 'ACCEPTED' END AS state, len(list_filter(codes, lambda c: c NOT IN ({listed(ERRORS)}))) AS n_warnings FROM (SELECT record_id, codes, min(record_id) OVER (PARTITION BY digest) AS first_id FROM (SELECT record_id, digest, {FINDINGS} AS codes FROM ({DIGESTED})))) GROUP BY state")
def intake_report(spark, folder):
    """Records by decision, and how many of them have warnings."""
    d = intake_decisions(spark, folder).join(_found(spark, folder).select("record_id", F.exists("codes", lambda c: ~c.isin(*ERRORS)).alias("warned")), "record_id")
    return d.groupBy("state").agg(F.count(F.lit(1)).alias("n"), F.count_if("warned").alias("with_warnings"))


HOSTS = [f"www.shop.x.{s}" for s in T.TWO_LABEL_SUFFIXES] + ["https://WWW.a.b.example.com/x", "x.com", "localhost", "", "deep.er.example.org.", "ac.uk"]
DOMAIN = "CASE WHEN h = '' THEN '' WHEN len(string_split(h, '.')) <= 2 THEN h WHEN array_to_string(string_split(h, '.')[-2:], '.') IN (" + listed(T.TWO_LABEL_SUFFIXES) + ") THEN array_to_string(string_split(h, '.')[-3:], '.') ELSE array_to_string(string_split(h, '.')[-2:], '.') END"


@query(f"SELECT c_custkey, h AS host, {DOMAIN} AS domain FROM (SELECT c_custkey, regexp_replace(regexp_replace(regexp_extract(CASE WHEN contains(x, '://') THEN x ELSE 'https://' || x END, '^[^:/?#]+://(?:[^/?#]*@)?([^/?#:]*)', 1), '\\.+$', ''), '^www\\.', '') AS h FROM (SELECT c_custkey, lower(trim({pick(HOSTS, 'c_custkey')})) AS x FROM customer))")
def registrable_domains(spark, folder):
    """The domain that can be registered, of hosts below each public suffix of the list and others."""
    h = T.bare_host(F.expr(pick(HOSTS, "c_custkey")))
    return table(spark, folder, "customer").select("c_custkey", h.alias("host"), T.registrable_domain(h).alias("domain"))


PROFILES = ["https://www.linkedin.com/in/ada/", "linkedin.com/in/ada?locale=de_DE&x=1", "http://LinkedIn.com/in/Ada-B", "https://linkedin.com/company/acme", "https://uk.linkedin.com/in/x", "", "  www.linkedin.com/in/grace  ", "https://linkedin.com/in/a/b"]
PROFILE = "CASE WHEN starts_with(x, 'http://') OR starts_with(x, 'https://') THEN x ELSE 'https://' || x END"


@query(f"""
SELECT s_suppkey, CASE WHEN regexp_matches(x, '^https?://(?i:www\\.)?(?i:linkedin\\.com)/in/[^/?#]+/?(?:[?#]|$)') THEN 'https://www.linkedin.com/in/' || regexp_extract(x, '/in/([^/?#]+)', 1)
    || CASE WHEN regexp_extract(x, '[?&]locale=([^&#]+)', 1) <> '' THEN '?locale=' || regexp_extract(x, '[?&]locale=([^&#]+)', 1) ELSE '' END END AS profile
FROM (SELECT s_suppkey, {PROFILE} AS x FROM (SELECT s_suppkey, trim({pick(PROFILES, 's_suppkey')}) AS x FROM supplier))
""")
def profile_urls(spark, folder):
    """Canonical profile addresses; pages that are no profile have none, and of the query only the locale stays."""
    return table(spark, folder, "supplier").select("s_suppkey", T.profile_url(F.expr(pick(PROFILES, "s_suppkey"))).alias("profile"))


LINKS = ["https://acme.com/x", "http://acme.com", "https://u:p@acme.com/", "https:///x", "ftp://acme.com", "HTTPS://Acme.com", "acme.com", ""]


@query(f"""
SELECT event_id, regexp_matches(u, '^(?i:https)://[^/?#]') AND NOT regexp_matches(u, '^[^/]*//[^/?#]*@') AS destination_valid, revoked IS NULL AND (expires IS NULL OR expires > TIMESTAMP '2024-01-15 00:00:00') AS resolvable,
    sha256('s3cret' || chr(0) || ip) AS ip_hash, 'campaign-send:' || user_id || ':' || event_id % 7 || ':' || event_id AS idempotency_key FROM (
    SELECT event_id, user_id, {pick(LINKS, 'event_id')} AS u, CASE WHEN event_id % 6 = 0 THEN ts END AS revoked, CASE WHEN event_id % 4 <> 0 THEN ts END AS expires, '10.0.' || user_id % 256 || '.' || event_id % 256 AS ip FROM events)
""")
def tracked_links(spark, folder):
    """Whether a link's destination may be used and its token resolves now; the keyed digest of the visitor's address; the key of the send."""
    e = table(spark, folder, "events").withColumns({"u": F.expr(pick(LINKS, "event_id")), "revoked": F.expr("CASE WHEN event_id % 6 = 0 THEN ts END"), "expires": F.expr("CASE WHEN event_id % 4 <> 0 THEN ts END")})
    ip = F.format_string("10.0.%d.%d", F.col("user_id") % 256, F.col("event_id") % 256)
    now = F.lit("2024-01-15 00:00:00").cast("timestamp_ntz")
    return e.select(
        "event_id", (F.col("u").rlike("^(?i:https)://[^/?#]") & ~F.col("u").rlike("^[^/]*//[^/?#]*@")).alias("destination_valid"),
        (F.col("revoked").isNull() & (F.col("expires").isNull() | (F.col("expires") > now))).alias("resolvable"),
        F.sha2(F.concat(F.lit("s3cret"), F.char(F.lit(0)), ip).cast("binary"), 256).alias("ip_hash"),
        F.concat_ws(":", F.lit("campaign-send"), "user_id", (F.col("event_id") % 7).cast("string"), "event_id").alias("idempotency_key"),
    )
