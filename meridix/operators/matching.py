"""Entity resolution: blocking on name tokens and domains, explainable scores, one decision a record."""

from __future__ import annotations

import math
from collections.abc import Iterator
from difflib import SequenceMatcher
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meridix.functions.text import name_tokens, registrable_domain
from meridix.operators.windows import top_per_group

# Points of what speaks for and against a candidate; strong evidence alone establishes identity.
STRONG = {"exact_verified_canonical_domain": 100, "exact_official_corporate_url": 95, "explicit_official_identity_tie": 90}
MEDIUM = {"normalized_company_name": 55, "geography_match": 20, "registered_identity_match": 35, "corporate_social_match": 25, "parent_relationship_consistent": 15}
NEGATIVE = {"conflicting_authoritative_domain": -100, "conflicting_geography": -100, "clearly_different_legal_entity": -100, "historical_only": -100, "external_provider_relationship": -100}


def block_keys() -> Column:
    """A record's name tokens and its registrable domain (``name``, ``domain``); equal domains have equal registrable ones. A record without a name has its domain's block."""
    domain = registrable_domain(F.col("domain"))
    tokens = F.transform(name_tokens(F.col("name")), lambda t: F.concat(F.lit("t:"), t))
    return F.concat(F.coalesce(tokens, F.array().cast("array<string>")), F.when(domain != "", F.array(F.concat(F.lit("d:"), domain))).otherwise(F.array().cast("array<string>")))


def blocks(records: DataFrame, side: str) -> DataFrame:
    """(id, block): a record's blocks (``id``, ``name``, ``domain``)."""
    return records.select(F.col("id").alias(f"{side}_id"), F.explode(block_keys()).alias("block"))


#: Records of a task: each meets up to a budget of others in every one of its blocks, which the size of the table's files doesn't show. A block of so many records is met by broadcast.
TASK_RECORDS = 20_000


def blocked_pairs(left: DataFrame, right: DataFrame, budget: int, task_records: int = TASK_RECORDS) -> DataFrame:
    """Candidates (left_id, right_id, position) that share a block, the first ``budget`` of each left record by id.

    A left record's first ``budget`` partners lie among the first ``budget`` + 1 of each of its blocks (one may be itself).
    These stay one array a block, and a left record's arrays meet in one row, so no task holds its pairs one by one. The number of
    tasks follows from the number of records. Blocks of ``task_records`` left records or more, which are few, are
    broadcast with their arrays; the others are joined by block, so no block's records come to one task in full."""
    tasks = lambda df: max(1, -(-df.count() // task_records))
    n = tasks(left)
    own = blocks(left.repartition(n, "id"), "left")
    firsts = top_per_group(blocks(right.where("id is not null").repartition(tasks(right), "id"), "right"), ["block"], [F.col("right_id")], budget + 1, "_place")
    partners = firsts.groupBy("block").agg(F.collect_list("right_id").alias("ids"))
    frequent = own.groupBy("block").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= task_records).select("block")
    often = own.join(F.broadcast(partners.join(F.broadcast(frequent), "block", "left_semi")), "block")
    seldom = own.join(F.broadcast(frequent), "block", "left_anti").join(partners.hint("merge"), "block")
    met = often.select("left_id", "ids").union(seldom.select("left_id", "ids")).repartition(n, "left_id").groupBy("left_id").agg(F.flatten(F.collect_list("ids")).alias("ids"))
    others = F.filter(F.array_sort(F.array_distinct("ids")), lambda x: x != F.col("left_id"))
    return met.select("left_id", F.posexplode(F.slice(others, 1, budget)).alias("position", "right_id")).select("left_id", "right_id", (F.col("position") + 1).alias("position"))


#: A block's pairs are made in cells of so many records a side at most, which bounds what a task holds; small tables get smaller cells, about ``CELLS`` in all, so that every core has some.
CELL_RECORDS, LEAST_CELL, CELLS = 10_000, 500, 512


def all_pairs(left: DataFrame, right: DataFrame, cell_records: int = CELL_RECORDS) -> DataFrame:
    """All pairs of records with different ids that share a block, each once: every column of both sides as left_* and right_*.

    ``left`` and ``right`` have ``id``, ``name``, ``domain`` and what else a pair is judged by; rows of one id share their blocks.
    The pairs grow with the square of a block, so they are neither stored nor sorted: a block's records are dealt over a grid of
    cells, and a cell's pairs go row by row to what follows. A pair counts in the first of the blocks that its records share."""

    def dealt(records, side):
        own = records.where("id is not null").withColumn("_keys", block_keys()).groupBy("id").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("_keys")))).alias("_all"), F.collect_list(F.struct(*[c for c in records.columns if c != "id"])).alias("_rows"))
        own = own.select("id", "_rows", "_all", F.posexplode("_all").alias("_at", "block")).withColumn("_before", F.expr("slice(_all, 1, _at)"))
        # Blocks without a common bit are disjoint; only the others are compared.
        bits = F.expr("aggregate(_before, 0L, (m, b) -> m | shiftleft(1L, CAST(pmod(xxhash64(b), 64L) AS INT)))")
        own = own.select("block", F.col("id").alias(f"{side}_id"), F.col("_before").alias(f"_{side}_before"), bits.alias(f"_{side}_bits"), F.explode("_rows").alias("_row"))
        return own.select("*", *[F.col(f"_row.{c}").alias(f"{side}_{c}") for c in records.columns if c != "id"]).drop("_row")

    rows = {"left": dealt(left, "left"), "right": dealt(right, "right")}
    sizes = rows["left"].groupBy("block").agg(F.count(F.lit(1)).alias("_n_left")).join(rows["right"].groupBy("block").agg(F.count(F.lit(1)).alias("_n_right")), "block")
    n_pairs = sizes.agg(F.sum(F.col("_n_left").cast("double") * F.col("_n_right"))).first()[0] or 0
    side = min(cell_records, max(LEAST_CELL, math.ceil(math.sqrt(n_pairs / CELLS))))
    n = max(1, math.ceil(n_pairs / (4 * side * side)))
    cells = lambda s: F.ceil(F.col(f"_n_{s}") / side)
    large = F.broadcast(sizes.where((F.col("_n_left") > side) | (F.col("_n_right") > side)).select("block", cells("left").alias("_lefts"), cells("right").alias("_rights")))
    by = ["block", "_left_cell", "_right_cell"]

    def placed(s, other):
        number = lambda of: F.coalesce(f"_{of}s", F.lit(1).cast("long"))
        own = rows[s].join(large, "block", "left").withColumn(f"_{s}_cell", F.pmod(F.xxhash64(f"{s}_id"), number(s))).withColumn(f"_{other}_cell", F.explode(F.sequence(F.lit(0).cast("long"), number(other) - 1)))
        return own.drop("_lefts", "_rights").repartition(n, *by)

    met = placed("left", "right").join(placed("right", "left").hint("merge"), by).where("left_id <> right_id AND ((_left_bits & _right_bits) = 0 OR NOT arrays_overlap(_left_before, _right_before))")
    return met.select(*[f"left_{c}" for c in left.columns], *[f"right_{c}" for c in right.columns])


#: Ratios that a task remembers.
KNOWN_RATIOS = 100_000


def name_ratio(left: str, right: str) -> Column:
    """The standard library's ratio of two texts, null where one is. Its value depends on their order."""

    def ratio(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        matcher, known = SequenceMatcher(None), {}
        for a, b in batches:
            (xs, x), (ys, y) = (((e := c.dictionary_encode()).dictionary.to_pylist(), e.indices.fill_null(-1).to_numpy()) for c in (a, b))
            pairs, at = np.unique(y.astype("int64") * (len(xs) + 1) + x + 1, return_inverse=True)  # a null makes i 0 or j -1
            ratios = []
            for j, i in zip(*(k.tolist() for k in divmod(pairs, len(xs) + 1)), strict=True):
                pair = (xs[i - 1], ys[j]) if i > 0 and j >= 0 else None
                if pair and pair not in known:
                    if len(known) >= KNOWN_RATIOS:
                        known.clear()
                    if matcher.b != pair[1]:
                        matcher.set_seq2(pair[1])  # what it prepares serves all texts that meet this one
                    matcher.set_seq1(pair[0])
                    known[pair] = matcher.ratio()
                ratios.append(known[pair] if pair else None)
            yield pa.array(ratios, pa.float64()).take(pa.array(at))

    return F.arrow_udf(ratio, "double")(left, right)


def compare(pairs: DataFrame, signals: dict[str, Column]) -> DataFrame:
    """left_id, right_id, score, strong, rejected from the signals that hold."""
    points = STRONG | MEDIUM | NEGATIVE
    held = {k: F.coalesce(c, F.lit(False)) for k, c in signals.items()}
    any_of = lambda names: reduce(lambda a, b: a | b, [held[k] for k in names if k in held], F.lit(False))
    score = reduce(lambda a, b: a + b, [F.when(c, points[k]).otherwise(0) for k, c in held.items()])
    return pairs.select("left_id", "right_id", score.alias("score"), any_of(STRONG).alias("strong"), any_of(NEGATIVE).alias("rejected"))


def adjudicate(leads: DataFrame, compared: DataFrame) -> DataFrame:
    """One decision for each of ``leads`` (left_id, related): left_id, status, best_id, score, n_rejected. Counts and maxima of plain numbers, so that candidates are never sorted.

    No candidate is UNRESOLVED; without strong evidence that nothing contradicts it is AMBIGUOUS, or NO_MATCH where no
    candidate has points; several such candidates CONFLICT; one is MATCHED, or MATCHED_WITH_RELATIONSHIP."""
    eligible = F.col("strong") & ~F.col("rejected")
    facts = compared.groupBy("left_id").agg(
        F.count_if(eligible).alias("n_eligible"), F.count_if("rejected").alias("n_rejected"), F.count_if(~F.col("rejected") & (F.col("score") > 0)).alias("n_plausible"),
        F.max(F.when(eligible, F.col("right_id"))).alias("best_id"), F.max(F.when(eligible, F.col("score"))).alias("best_score"),
    )
    j = leads.join(facts, "left_id", "left")
    status = (
        F.when(F.col("n_eligible").isNull(), "UNRESOLVED").when((F.col("n_eligible") == 0) & (F.col("n_plausible") > 0), "AMBIGUOUS").when(F.col("n_eligible") == 0, "NO_MATCH")
        .when(F.col("n_eligible") > 1, "CONFLICT").when(F.col("related"), "MATCHED_WITH_RELATIONSHIP").otherwise("MATCHED")
    )
    matched = F.col("n_eligible") == 1
    return j.select("left_id", status.alias("status"), F.when(matched, F.col("best_id")).alias("best_id"), F.when(matched, F.col("best_score")).alias("score"), F.coalesce("n_rejected", F.lit(0)).cast("long").alias("n_rejected"))


# What a decision's trace says of each outcome.
OUTCOMES = {
    "UNRESOLVED": "No deterministic candidates were generated.", "NO_MATCH": "All candidates were rejected or lacked any positive identity evidence.",
    "AMBIGUOUS": "Plausible candidate evidence exists, but deterministic identity evidence is insufficient; returning AMBIGUOUS.", "CONFLICT": "Multiple candidates have strong identity evidence; returning CONFLICT.",
}


def decision_records(leads: DataFrame, compared: DataFrame, budget: int) -> DataFrame:
    """What is stored of each decision: left_id, status, best_id, decision_id, rejected, research_required, trace.

    The id is a digest of the candidates and their scores, best first, so a decision that would come out of other evidence
    is another one. A lead has ``budget`` candidates at most, so its ordered list is short."""
    eligible = F.col("strong") & ~F.col("rejected")
    lists = compared.groupBy("left_id").agg(F.sort_array(F.collect_list(F.struct(eligible.alias("eligible"), "score", "right_id", "rejected")), False).alias("all"))
    j = adjudicate(leads, compared).join(lists, "left_id", "left").withColumn("all", F.coalesce("all", F.array().cast(lists.schema["all"].dataType)))
    material = F.array_join(F.transform("all", lambda c: F.concat(c["right_id"].cast("string"), F.lit(":"), c["score"].cast("string"))), "|")
    lead = F.col("left_id").cast("string")
    said = F.element_at(F.create_map(*[F.lit(x) for pair in OUTCOMES.items() for x in pair]), F.col("status"))
    chosen = F.concat(F.lit("Candidate "), F.col("best_id").cast("string"), F.lit(" selected with score "), F.col("score").cast("string"), F.lit("."))
    trace = F.array(F.concat(F.lit("candidate_generation: Selected "), F.size("all").cast("string"), F.lit(f" candidates with budget {budget}.")), F.concat(F.lit("adjudication: "), F.coalesce(said, chosen)))
    rejected = F.array_join(F.transform(F.filter("all", lambda c: c["rejected"]), lambda c: c["right_id"].cast("string")), ",")
    decision = F.concat(F.lit("erd:"), lead, F.lit(":"), F.substring(F.sha2(F.concat(lead, F.lit("|"), material), 256), 1, 24))
    return j.select("left_id", "status", "best_id", decision.alias("decision_id"), rejected.alias("rejected"), (~F.col("status").startswith("MATCHED")).alias("research_required"), F.array_join(trace, " / ").alias("trace"))
