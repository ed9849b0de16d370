"""Evidence from texts: dated intent signals, relations between entities with their places, candidates with a fallback."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meridix.functions import vocabulary as V
from meridix.operators import terms

#: Up to seven capitalised words.
NAME = r"[A-Z][A-Za-z0-9&'.,-]*(?:\s+[A-Z][A-Za-z0-9&'.,-]*){0,6}"


def intent_signals(pages: DataFrame) -> DataFrame:
    """id, signal_type, terms, event_date, weight, half_life: signals that a dated page (id, text, event_date) shows in an explicit context.

    One pass over a page finds which terms it has; a signal needs all terms of one of its contexts, and the first such
    context is its evidence. A page without a date gives none, and neither does a term out of context."""
    contexts = [(s, c) for s, own in V.INTENT_CONTEXTS for c in own]
    index = terms.Index(t for _, c in contexts for t in c)
    text = F.trim(F.regexp_replace(F.lower("text"), r"(?U)\s+", " "))
    # Terms first: few pages hold any, and only those are read for a date.
    p = pages.select("id", "event_date", index.terms_in(text).alias("found")).where((F.size("found") > 0) & F.col("event_date").isNotNull())
    shown = F.array(*[F.struct(F.lit(V.SIGNAL_NAMES.get(s, s)).alias("signal_type"), index.first_context(F.col("found"), own).alias("terms")) for s, own in V.INTENT_CONTEXTS])
    p = p.select("id", "event_date", F.explode(F.filter(shown, lambda s: s["terms"].isNotNull())).alias("s"))
    table = lambda at: F.create_map(*[F.lit(x) for k, v in V.INTENT_RULES.items() for x in (k, v[at])])
    kind = F.col("s.signal_type")
    return p.select("id", kind.alias("signal_type"), "s.terms", "event_date", F.coalesce(F.try_element_at(table(0), kind), F.lit(0)).alias("weight"), F.coalesce(F.try_element_at(table(1), kind), F.lit(1)).alias("half_life"))


def _relation(text: Column, phrase: str, predicate: str, kind: str) -> Column:
    """struct(predicate, entity_type, name, quote, start, end) of the first place where a name follows the phrase as words of their own; null if none does."""
    spaced = phrase.replace(" ", r"\ ")
    pattern = rf"(?s)^(.*?)(?<![\p{{L}}\p{{N}}_])({spaced}\s+({NAME}))"
    part = lambda k: F.regexp_extract(text, pattern, k)
    name = F.regexp_replace(part(3), "[.,;:]+$", "")
    start, quote = F.char_length(part(1)), F.trim(part(2))
    found = F.struct(F.lit(predicate).alias("predicate"), F.lit(kind).alias("entity_type"), name.alias("name"), quote.alias("quote"), start.alias("start"), (start + F.char_length(quote)).alias("end"))
    # The plain search first: few texts hold the phrase, and the pattern reads all that stands before it.
    return F.when(F.contains(text, F.lit(phrase)) & (name != ""), found)


def relation_spans(evidence: DataFrame) -> DataFrame:
    """evidence_id, predicate, entity_type, name, quote, start, end (code points of title and text joined by a space) for (evidence_id, title, text): the first place of each phrase."""
    text = F.concat_ws(" ", F.when(F.col("title") != "", F.col("title")), F.when(F.col("text") != "", F.col("text")))
    found = F.array_compact(F.array(*[_relation(F.col("whole"), *r) for r in V.RELATIONS]))
    return evidence.select("evidence_id", text.alias("whole")).select("evidence_id", F.explode(found).alias("r")).select("evidence_id", "r.*")


def outermost(spans: DataFrame) -> DataFrame:
    """Spans that no longer one of the same evidence contains: `a brand of X` holds `brand of X`. Evidence has eight spans at most, so its own array is enough."""
    all_of = spans.groupBy("evidence_id").agg(F.collect_list(F.struct(*[c for c in spans.columns if c != "evidence_id"])).alias("all"))
    inside = lambda s, o: (o["start"] <= s["start"]) & (o["end"] >= s["end"]) & (o["end"] - o["start"] > s["end"] - s["start"])
    return all_of.select("evidence_id", F.explode(F.filter("all", lambda s: ~F.exists("all", lambda o: inside(s, o)))).alias("s")).select("evidence_id", "s.*")


def located(claims: DataFrame, evidence: DataFrame) -> DataFrame:
    """Quotes of claims (claim_id, evidence_id, quote) with the place where their evidence has them: claim_id, evidence_id, start, end; -1 where the text lacks the quote, null where the evidence is unknown."""
    texts = evidence.select("evidence_id", F.concat_ws(" ", F.when(F.col("title") != "", F.col("title")), F.when(F.col("text") != "", F.col("text"))).alias("whole"))
    start = F.instr("whole", F.col("quote")) - 1
    return claims.join(texts, "evidence_id", "left").select("claim_id", "evidence_id", start.alias("start"), F.when(start >= 0, start + F.char_length("quote")).otherwise(start).alias("end"))


def supported(claims: DataFrame, spans: DataFrame, width: int = 1024) -> DataFrame:
    """Claims (claim_id, evidence_id, start, end) and the spans they overlap: an interval join on evidence and stretches of ``width`` code points, so that evidence with very many spans is no cross join. claim_id, evidence_id, predicate, name, each pair once."""
    parts = lambda a, b: F.explode(F.sequence(F.floor(F.col(a) / width), F.floor((F.greatest(F.col(b), F.col(a) + 1) - 1) / width)))
    c = claims.where("start >= 0").withColumn("part", parts("start", "end"))
    s = spans.select("evidence_id", F.col("start").alias("s_start"), F.col("end").alias("s_end"), "predicate", "name").withColumn("part", parts("s_start", "s_end"))
    met = c.join(s, ["evidence_id", "part"]).where("start < s_end and s_start < end")
    # A pair counts in the first stretch that both have.
    return met.where(F.col("part") == F.floor(F.greatest("start", "s_start") / width)).select("claim_id", "evidence_id", "predicate", "name")


def candidates(structured: DataFrame, evidence: DataFrame, valid_types: list[str]) -> DataFrame:
    """Typed candidates of each lead: evidence_id, name, entity_type, relation, method.

    ``structured`` (evidence_id, name, entity_type, relation) is what an extractor gave; a type that isn't known makes its
    row invalid, and evidence with no valid row at all falls back to the relations of its text (an anti join). Candidates
    of one evidence with the same name (whatever its case) and type count once."""
    kind = F.upper(F.trim("entity_type"))
    good = structured.where(kind.isin(*valid_types) & (F.trim("name") != "")).select("evidence_id", F.trim("name").alias("name"), kind.alias("entity_type"), "relation", F.lit("structured").alias("method"))
    rest = evidence.join(good.select("evidence_id").distinct(), "evidence_id", "left_anti")
    plain = relation_spans(rest).select("evidence_id", "name", "entity_type", F.col("predicate").alias("relation"), F.lit("deterministic").alias("method"))
    first = F.min(F.struct("relation", "name", "method")).alias("first")
    return good.union(plain).groupBy("evidence_id", F.lower("name").alias("key"), "entity_type").agg(first).select("evidence_id", "first.name", "entity_type", "first.relation", "first.method")
