"""Pre-aggregates of a dashboard: one pass over each table, small results by company, then one wide row each and one row of totals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meridix.sources.tables import TASK_ROWS, tasks

# Verification states that count as verified, and the confidence that counts as high.
VERIFIED, HIGH = ("verified", "deliverable", "valid"), 0.8


def _there(c: str) -> Column:
    return F.trim(F.coalesce(F.col(c), F.lit(""))) != ""


def evidence_by_company(evidence: DataFrame, runs: DataFrame) -> DataFrame:
    """company_id, evidence, evidence_with_url, high_confidence, confidence (the sum), rated, dm_with_evidence from evidence (run_id, decision_maker_id, source_url, confidence) of runs (run_id, company_id).

    Evidence is reduced by run and person before it meets the runs; the people of a company are then rows, so counting them is no distinct count beside other sums."""
    by = evidence.groupBy("run_id", "decision_maker_id").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(_there("source_url")).alias("with_url"), F.count_if(F.col("confidence") >= HIGH).alias("high"), F.sum("confidence").alias("confidence"), F.count("confidence").alias("rated")
    )
    met = by.join(runs.select("run_id", "company_id"), "run_id").groupBy("company_id", "decision_maker_id").agg(*[F.sum(c).alias(c) for c in ("n", "with_url", "high", "confidence", "rated")])
    people = F.count_if(F.col("decision_maker_id").isNotNull() & (F.col("with_url") > 0))
    return met.groupBy("company_id").agg(F.sum("n").alias("evidence"), F.sum("with_url").alias("evidence_with_url"), F.sum("high").alias("high_confidence"), F.sum("confidence").alias("confidence"), F.sum("rated").alias("rated"), people.alias("dm_with_evidence"))


def people_by_company(people: DataFrame, methods: DataFrame) -> DataFrame:
    """company_id, decision_makers, email_candidates, verified_emails; contact methods are reduced by person first."""
    mail = methods.where("channel = 'email'").groupBy("decision_maker_id").agg(F.count(F.lit(1)).alias("emails"), F.count_if(F.lower(F.coalesce("verification_status", F.lit(""))).isin(*VERIFIED)).alias("verified"))
    zero = lambda c: F.coalesce(F.sum(c), F.lit(0))
    return people.join(mail, "decision_maker_id", "left").groupBy("company_id").agg(F.count(F.lit(1)).alias("decision_makers"), zero("emails").alias("email_candidates"), zero("verified").alias("verified_emails"))


def intent_by_company(signals: DataFrame) -> DataFrame:
    return signals.groupBy("company_id").agg(F.count(F.lit(1)).alias("intent_signals"), F.count("evidence_id").alias("intent_with_evidence"), F.count("signal_date").alias("intent_dated"))


COUNTS = ("evidence", "evidence_with_url", "high_confidence", "decision_makers", "dm_with_evidence", "intent_signals", "intent_with_evidence", "intent_dated", "email_candidates", "verified_emails")


def quality_by_company(runs: DataFrame, evidence: DataFrame, people: DataFrame, methods: DataFrame, signals: DataFrame, facts: DataFrame, scores: DataFrame) -> DataFrame:
    """A row for each company with a completed run: COUNTS, avg_confidence, has_facts, has_score."""
    enriched = runs.where("status = 'completed'").select("company_id").distinct()
    j = enriched
    for part in (evidence_by_company(evidence, runs), people_by_company(people, methods), intent_by_company(signals)):
        j = j.join(part, "company_id", "left")
    for name, marked in (("has_facts", facts), ("has_score", scores)):
        j = j.join(marked.select("company_id").distinct().withColumn(name, F.lit(True)), "company_id", "left")
    average = (F.col("confidence") / F.col("rated")).cast("decimal(18,6)")
    return j.select("company_id", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in COUNTS], average.alias("avg_confidence"), *[F.coalesce(c, F.lit(False)).alias(c) for c in ("has_facts", "has_score")])


def quality_totals(by_company: DataFrame) -> DataFrame:
    """How many enriched companies have what, and the mean of their mean confidences; one row."""
    some = lambda c, least=1: F.count_if(F.col(c) >= least)
    return by_company.agg(
        F.count(F.lit(1)).alias("enriched"), F.count_if("has_facts").alias("with_facts"), some("evidence").alias("with_evidence"), some("evidence", 2).alias("with_2plus_evidence"), some("evidence_with_url").alias("evidence_url_covered"),
        some("high_confidence").alias("with_high_conf_evidence"), some("decision_makers").alias("with_dm"), some("decision_makers", 2).alias("with_2plus_dm"), some("dm_with_evidence").alias("with_dm_evidence"), some("intent_signals").alias("with_intent"),
        some("intent_with_evidence").alias("intent_evidence_linked"), some("intent_dated").alias("intent_dated"), some("email_candidates").alias("with_dm_email"), some("verified_emails").alias("with_verified_dm_email"), F.count_if("has_score").alias("with_score"),
        F.coalesce(F.avg("avg_confidence"), F.lit(0)).cast("decimal(18,4)").alias("avg_evidence_conf"),
    )


def evidence_documents(evidence: DataFrame, runs: DataFrame, part_size: int = 200, task_rows: int = TASK_ROWS) -> DataFrame:
    """company_id, part, parts, document: a company's evidence as nested JSON, newest first, in parts of about ``part_size`` entries, so no company is one row however much it has. Entries go to parts by a hash of their id; the number of parts follows from the counts, the number of tasks from the rows of evidence."""
    n = tasks(evidence, task_rows)
    e = evidence.repartition(n, "run_id").join(runs.select("run_id", "company_id").repartition(n, "run_id"), "run_id").repartition(n, "company_id")
    sizes = e.groupBy("company_id").agg(F.ceil(F.count(F.lit(1)) / part_size).cast("int").alias("parts"))
    e = e.join(sizes, "company_id").withColumn("part", F.pmod(F.xxhash64("evidence_id"), F.col("parts")).cast("int"))
    entry = F.struct((-F.unix_date("observed_at")).alias("_age"), F.col("evidence_id").alias("id"), "decision_maker_id", "source_url", "confidence", F.col("observed_at").cast("string").alias("observed_at"))
    found = e.groupBy("company_id", "part", "parts").agg(F.array_sort(F.collect_list(entry)).alias("all"))
    return found.select("company_id", "part", "parts", F.to_json(F.transform("all", lambda x: x.dropFields("_age"))).alias("document"))
