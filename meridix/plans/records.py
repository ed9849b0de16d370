"""Queries on intake records, pages, entities and conversations."""

from __future__ import annotations

from pyspark.sql import functions as F

from meridix.functions.text import LEGAL_SUFFIXES, host, normalize_url, normalized_name, prefixed_id, registrable_domain
from meridix.operators import windows
from meridix.plans.registry import query
from meridix.sources.tables import table

HOST = "lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)', 1))"
TWO = "array_to_string(string_split(h, '.')[-2:], '.')"


@query(f"SELECT domain, count(*) AS pages, count(DISTINCT h) AS hosts FROM (SELECT h, {TWO} AS domain FROM (SELECT {HOST} AS h FROM pages)) GROUP BY domain HAVING count(*) > 1")
def duplicate_domains(spark, folder):
    p = table(spark, folder, "pages").select(host(F.col("url")).alias("h"))
    return p.groupBy(registrable_domain(F.col("h")).alias("domain")).agg(F.count(F.lit(1)).alias("pages"), F.countDistinct("h").alias("hosts")).where("pages > 1")


@query(f"SELECT page_id, h AS host, lower(regexp_extract(u, '^([A-Za-z][A-Za-z0-9+.-]*://[^/?]*)', 1)) || regexp_replace(regexp_replace(u, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?]*', ''), '(.)/+$', '\\1') AS url FROM (SELECT page_id, {HOST} AS h, regexp_replace(url, '#.*$', '') AS u FROM pages)")
def url_normalize(spark, folder):
    return table(spark, folder, "pages").select("page_id", host(F.col("url")).alias("host"), normalize_url(F.col("url")).alias("url"))


@query("SELECT doc_id, first_value(doc_id) OVER w AS canonical_id, CASE WHEN doc_id = first_value(doc_id) OVER w THEN 'unique' ELSE 'exact_duplicate' END AS decision, 'sr_' || substr(sha256(source || '|' || text), 1, 40) AS record_id FROM documents WINDOW w AS (PARTITION BY sha256(text) ORDER BY doc_id)")
def exact_duplicate_decisions(spark, folder):
    d = table(spark, folder, "documents").select("doc_id", F.sha2("text", 256).alias("digest"), prefixed_id("sr_", F.col("source"), F.col("text")).alias("record_id"))
    return windows.duplicate_decisions(d, "doc_id", ["digest"]).select("doc_id", "canonical_id", "decision", "record_id")


@query("SELECT sha256(text) AS evidence_hash, min(doc_id) AS doc_id, count(*) AS copies FROM documents GROUP BY 1")
def evidence_hash_dedupe(spark, folder):
    return table(spark, folder, "documents").groupBy(F.sha2("text", 256).alias("evidence_hash")).agg(F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("copies"))


@query("SELECT sha256(text) AS digest, count(DISTINCT source) AS sources, count(DISTINCT lang) AS langs FROM documents GROUP BY 1 HAVING count(DISTINCT source) > 1 OR count(DISTINCT lang) > 1")
def field_conflict_findings(spark, folder):
    return table(spark, folder, "documents").groupBy(F.sha2("text", 256).alias("digest")).agg(F.countDistinct("source").alias("sources"), F.countDistinct("lang").alias("langs")).where("sources > 1 or langs > 1")


@query("SELECT doc_id FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id AND l.toxic = 1)")
def suppression_anti_join(spark, folder):
    return table(spark, folder, "documents").join(table(spark, folder, "labels").where("toxic = 1"), "doc_id", "left_anti").select("doc_id")


@query("SELECT conv_id, string_agg(turn || ' ' || role || ': ' || coalesce(text, ''), chr(10) ORDER BY turn) AS history, count(*) AS turns FROM conversations GROUP BY conv_id")
def conversation_history(spark, folder):
    line = F.concat(F.col("turn").cast("string"), F.lit(" "), F.col("role"), F.lit(": "), F.coalesce("text", F.lit("")))
    c = table(spark, folder, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", line.alias("line")))).alias("lines"))
    return c.select("conv_id", F.array_join(F.transform("lines", lambda x: x["line"]), "\n").alias("history"), F.size("lines").cast("long").alias("turns"))


@query("SELECT doc_id, contains(lower(text), 'license') AS licence, regexp_matches(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\\.[A-Za-z]{2,}') AS has_email, contains(lower(text), 'password') OR contains(lower(text), 'token') AS credential, CAST(CASE WHEN contains(lower(text), 'license') THEN 2 ELSE 0 END + CASE WHEN contains(lower(text), 'password') OR contains(lower(text), 'token') THEN 3 ELSE 0 END AS INT) AS points FROM documents")
def keyword_fit_flags(spark, folder):
    low = F.lower("text")
    d = table(spark, folder, "documents").select("doc_id", low.contains("license").alias("licence"), F.col("text").rlike(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}").alias("has_email"), (low.contains("password") | low.contains("token")).alias("credential"))
    return d.withColumn("points", F.when(F.col("licence"), 2).otherwise(0) + F.when(F.col("credential"), 3).otherwise(0))


NAME = f"array_to_string(list_filter(regexp_split_to_array(lower(p_name), '[^a-z0-9]+'), lambda t: t <> '' AND t NOT IN ({', '.join(repr(x) for x in LEGAL_SUFFIXES)})), ' ')"


@query(f"SELECT p_partkey, {NAME} AS name FROM part WHERE p_name IS NOT NULL")
def name_normalize(spark, folder):
    return table(spark, folder, "part").where("p_name is not null").select("p_partkey", normalized_name(F.col("p_name")).alias("name"))
