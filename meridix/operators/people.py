"""Decision makers from evidence: who they are, where they work now, and how far outreach may go."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meridix.functions.text import host
from meridix.operators.rules import contains_any, identity_score

# Words of former employment, titles whose holders have an operating role, and claims that speak against one.
FORMER = ("former", "ex-", "previous employer", "past employer")
OPERATING = ("cto", "chief technology", "vp engineering", "head of engineering", "ciso", "chief information security", "head of security", "coo", "chief operating", "cfo", "chief financial", "vp finance", "head of finance")
BOARD = ("non-executive board director", "non executive board director")
PAST_TITLE = r"(?:^|[^\p{L}\p{N}_])(?:former|ex|previously)\s+(?:cto|ciso|coo|cfo|chief technology officer|chief information security officer|chief operating officer|chief financial officer)(?:$|[^\p{L}\p{N}_])"


def bare(h: Column) -> Column:
    return F.regexp_replace(h, r"^www\.", "")


def tokens(c: Column) -> Column:
    """Runs of lower-case ASCII letters and digits, in order."""
    return F.filter(F.split(F.lower(F.coalesce(c, F.lit(""))), "[^a-z0-9]+"), lambda t: t != "")


def at_domain(url_host: Column, domain: Column) -> Column:
    """Whether a host is the domain or below it."""
    target = F.regexp_replace(bare(F.trim(F.lower(domain))), ":.*$", "")
    return (url_host != "") & (target != "") & ((url_host == target) | F.endswith(url_host, F.concat(F.lit("."), target)))


def slug_matches(profile: Column, name: Column) -> Column:
    """Whether a profile's address holds every part of a name of two parts or more."""
    slug = tokens(F.regexp_extract(F.regexp_replace(profile, r"[?#].*$|/+$", ""), "([^/]*)/*$", 1))
    return F.coalesce((F.size(tokens(name)) >= 2) & (F.size(slug) >= 2) & (F.size(F.array_except(tokens(name), slug)) == 0), F.lit(False))


def resolve_people(people: DataFrame, evidence: DataFrame) -> DataFrame:
    """person_id, identity, employer, linkedin, title, overall (confidences), status, reasons.

    ``people``: person_id, full_name, job_title, role_family, profile (a normalised address or null), domain, company_name.
    ``evidence``: person_id, claim_type, claim_name, claim_text (the claim's values in lower case), ended (it has an end
    date), is_current, claim_domain, claim_company, source_url. Evidence counts if it names the person, part by part. What a
    person's evidence says is a handful of any-of facts: they merge, so no person's evidence is gathered, and two
    independent hosts are a smallest one that isn't the largest."""
    met = evidence.join(people.select("person_id", "full_name", "domain", "company_name"), "person_id").where((F.trim(F.coalesce("claim_name", F.lit(""))) != "") & (tokens(F.col("claim_name")) == tokens(F.col("full_name"))))
    kind, text, at = F.lower(F.coalesce("claim_type", F.lit(""))), F.coalesce("claim_text", F.lit("")), bare(host(F.coalesce("source_url", F.lit(""))))
    other = F.when((at != "") & (at != "linkedin.com"), at)
    same_company = (bare(F.lower(F.coalesce("claim_domain", F.lit("")))) == bare(F.lower("domain"))) | ((F.col("company_name") != "") & (F.lower(F.coalesce("claim_company", F.lit(""))) == F.lower("company_name")))
    facts = {
        "site": at_domain(at, F.col("domain")), "claimed": kind.contains("company") & same_company, "former": contains_any(kind, FORMER) | contains_any(text, FORMER),
        "stale": F.coalesce("ended", F.lit(False)) | (F.col("is_current") == F.lit(False)), "conflict": contains_any(text, BOARD) | text.rlike(PAST_TITLE),
    }
    seen = met.groupBy("person_id").agg(*[F.bool_or(c).alias(k) for k, c in facts.items()], (F.min(other) != F.max(other)).alias("independent"))
    p = people.join(seen, "person_id", "left")
    has = {k: F.coalesce(F.col(k), F.lit(False)) for k in (*facts, "independent")}
    profile, slug = F.col("profile").isNotNull(), slug_matches(F.col("profile"), F.col("full_name"))
    gone = has["former"] | has["stale"]
    current = (has["site"] | has["claimed"]) & ~gone
    titled = (F.coalesce("job_title", F.lit("")) != "") | (F.coalesce("role_family", F.lit("")) != "")
    conflict = has["conflict"] & contains_any(F.lower(F.coalesce("job_title", F.lit(""))), OPERATING)
    score, reasons = identity_score({
        "name_match": slug | has["independent"], "current_company_match": current, "title_match": titled, "company_site_support": has["site"], "independent_source_support": has["independent"],
        "former_employee": has["former"], "stale_employment": has["stale"], "ambiguous_name": profile & ~slug,
    })
    two = lambda c: c.cast("decimal(3,2)")
    employer = two(F.when(gone, 0).when(has["site"] & has["independent"], 0.95).when(has["site"], 0.85).when(current, 0.75).otherwise(0))
    linkedin, title = two(F.when(profile & slug, 0.95).when(profile, 0.80).otherwise(0)), two(F.when(conflict, 0).when(titled, 1).otherwise(0))
    p = p.select("person_id", score.alias("identity"), employer.alias("employer"), linkedin.alias("linkedin"), title.alias("title"), profile.alias("has_profile"), F.concat(reasons, F.when(conflict, F.array(F.lit("current_title_conflict"))).otherwise(F.array().cast("array<string>"))).alias("reasons"))
    overall = F.least(F.lit(1), F.col("identity") * F.expr("0.65BD") + F.col("employer") * F.expr("0.20BD") + F.col("linkedin") * F.expr("0.15BD")).cast("decimal(5,4)")
    p = p.withColumn("overall", overall)
    sure = F.col("has_profile") & (F.col("employer") >= 0.75) & (F.col("title") >= 0.75)
    status = F.when(~sure, "review").when(F.col("overall") >= 0.90, "outreach_ready").when(F.col("overall") >= 0.75, "strong_candidate").otherwise("review")
    return p.select("person_id", "identity", "employer", "linkedin", "title", "overall", status.alias("status"), F.array_join("reasons", ",").alias("reasons"))
