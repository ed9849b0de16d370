"""Intent, fit, routing and classification rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meridix.functions.text import decimal
from meridix.functions.vocabulary import INTENT_RULES
from meridix.operators.windows import first_wins

#: What kind of signal an event is; its weight and half-life in days come from the rule table, and context has no weight.
EVENT_SIGNALS = {"signup": "trial_install", "purchase": "sdk_install", "click": "pricing_visit", "view": "docs_visit", "error": "dark_funnel"}
SIGNALS = tuple((event, float(INTENT_RULES[s][0]), INTENT_RULES[s][1]) if s in INTENT_RULES else (event, 0.0, 1) for event, s in EVENT_SIGNALS.items())


def signal_rules(df: DataFrame) -> DataFrame:
    """The rule table as a DataFrame (a fixed handful of rows)."""
    return df.sparkSession.createDataFrame(list(SIGNALS), "event_type string, weight double, half_life int")


def intent_components(events: DataFrame, today: str) -> DataFrame:
    """Per user and signal type: the first event counts, its value halves every half-life."""
    known = events.join(F.broadcast(signal_rules(events)), "event_type").where("weight > 0")
    first = first_wins(known, ["user_id", "event_type"], [F.col("event_id")])
    age = F.greatest(F.lit(0), F.date_diff(F.lit(today).cast("date"), F.col("ts").cast("date")))
    return first.select("user_id", "event_type", "event_id", age.alias("age_days"), (F.col("weight") * F.pow(F.lit(2.0), -age / F.greatest(F.lit(1), F.col("half_life")))).alias("value"))


def intent_scores(events: DataFrame, today: str) -> DataFrame:
    """Decayed sum of each user's signals, clamped to 0..10."""
    raw = intent_components(events, today).groupBy("user_id").agg(F.count(F.lit(1)).alias("n_signals"), F.sum("value").alias("raw"))
    return raw.select("user_id", "n_signals", decimal(F.col("raw"), 4).alias("raw_intent"), decimal(F.least(F.lit(10.0), F.greatest(F.lit(0.0), F.col("raw"))), 2).alias("intent"))


# What gives scanners, mail gateways and headless browsers away in a user agent; a name ending in bot must end there.
SCANNERS = ("googleimageproxy", "proofpoint", "mimecast", "barracuda", "urlscan", "headlesschrome", "phantomjs", "crawler", "spider", r"bot(?:/|$|[^\p{L}\p{N}_])")
#: How sure an event is to be a person's.
CONFIDENCE = {"automated": 0.1, "human_candidate": 0.8, "unknown": 0.4}


def traffic_class(agent: Column, method: Column, repeats: Column, accept: Column, client_hints: Column, fetch_mode: Column) -> tuple[Column, Column]:
    """(class, reason): automated, unknown or human_candidate, by the first rule that holds. Null or empty headers are absent."""
    there = lambda c: F.coalesce(c != "", F.lit(False))
    label, why = F.lit("unknown"), F.lit("insufficient_evidence")
    hints = sum((there(c).cast("int") for c in (accept, client_hints, fetch_mode)), F.lit(0))
    rules = [(agent.rlike("(?i)" + p), "automated", f"scanner_{k}") for k, p in enumerate(SCANNERS, 1)]
    rules += [
        (~F.upper(method).isin("GET", "HEAD"), "unknown", "non_browser_method"),
        ((F.coalesce(repeats, F.lit(1)) >= 20) & ~there(fetch_mode), "automated", "high_repeat_without_fetch_metadata"),
        ((hints >= 2) & there(agent), "human_candidate", "coherent_browser_hints"),
    ]
    for holds, to, reason in reversed(rules):
        label, why = F.when(holds, to).otherwise(label), F.when(holds, reason).otherwise(why)
    return label, why


def confidence(label: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for pair in CONFIDENCE.items() for x in pair]), label).cast("decimal(3,2)")


def backoff_seconds(attempt: Column, base: int = 60, cap: int = 3600, most: int = 3) -> Column:
    """Seconds until the next attempt; null when there is none."""
    return F.when(attempt >= most, F.lit(None)).otherwise(F.least(F.lit(base) * F.pow(F.lit(2.0), attempt - 1), F.lit(float(cap)))).cast("long")


def job_status(decided: Column, attempts: Column, most: int = 5) -> Column:
    """complete, failed after ``most`` attempts, or pending."""
    return F.when(decided, "complete").when(attempts >= most, "failed").otherwise("pending")
