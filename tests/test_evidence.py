"""Term index, signals, relations and candidates on cases worked out by hand."""

import datetime
import sys

import pytest
from pyspark.sql import functions as F

from meridix.operators import evidence, rules, terms
from meridix.functions import vocabulary as V
from meridix.plans.people import event_date

DAY = datetime.date(2026, 8, 20)


@pytest.mark.parametrize("library", [True, False])
def test_terms_in_one_pass(spark, monkeypatch, library):
    texts = ["raised a series a funding round", "RAISED", "", None, "fund", "fundingfunding seriesseries a", "é funding é" * 50]
    index = terms.Index(["funding", "funding round", "series a", "raised", "a", "fund", "funding"])
    if not library:
        monkeypatch.setitem(sys.modules, "ahocorasick", None)
    rows = spark.createDataFrame([(t,) for t in texts], "t string").coalesce(1).withColumn("f", index.terms_in(F.col("t")))
    want = [sorted({k for w, k in index.number.items() if w in (t or "")}) for t in texts]
    assert [r["f"] for r in rows.collect()] == want and index.number["fund"] == 5
    has = index.any_of(F.col("f"))
    assert [r[0] for r in rows.select(has(["raised", "series a"])).collect()] == [True, False, False, False, False, True, False]
    got = [r[0] for r in rows.select(index.first_context(F.col("f"), [["raised", "funding"], ["fund"]])).collect()]
    assert got == [["raised", "funding"], None, None, None, ["fund"], ["fund"], ["fund"]]


def test_signals_need_a_date_and_a_context(spark):
    pages = [
        (1, "August 20, 2026 — The company RAISED\n\tfunding to expand operations.", DAY), (2, "Our platform supports funding education and security for customers.", DAY), (3, "The company raised funding.", None),
        (4, "Jo was appointed CISO; a new CEO is sought. GDPR.", DAY), (5, "migrating   to   next.js after a security breach", DAY), (6, None, DAY),
    ]
    got = sorted((r["id"], r["signal_type"], r["terms"], r["weight"], r["half_life"]) for r in evidence.intent_signals(spark.createDataFrame(pages, "id int, text string, event_date date")).collect())
    assert got == [
        (1, "funding", ["raised", "funding"], 3, 21), (4, "executive_business_event", ["appointed", "ceo"], 2, 45), (4, "gdpr", ["gdpr"], 0, 1),
        (5, "ca_breach", ["security breach"], 0, 1), (5, "tech_migration", ["migrating to", "next.js"], 3, 45),
    ]


def test_event_dates(spark):
    cases = [("2026-08-20T10:00:00Z", "on 2025-01-01", "2026-08-20"), ("20 Aug", "seen 2025-01-01, March 3, 2024", "2025-01-01"), (None, "Sept 9, 2024 and Sep 9, 2024", "2024-09-09"), ("2026-13-01", "Feb 30, 2024", None), (None, "march  7,  2024", "2024-03-07"), ("", "none", None)]
    rows = spark.createDataFrame([c[:2] for c in cases], "p string, t string").coalesce(1)
    assert [None if r[0] is None else str(r[0]) for r in rows.select(event_date(F.col("p"), F.col("t"))).collect()] == [c[2] for c in cases]


def spans_of(spark, rows):
    e = spark.createDataFrame(rows, "evidence_id int, title string, text string")
    return e, evidence.relation_spans(e)


def test_relations_and_their_places(spark):
    rows = [(1, None, "BrandCo is operated by Example Holdings."), (2, "Übersicht 😀", "a brand of North-West Co., and more"), (3, "", "counterpart of Someone; owned by nobody"), (4, None, None), (5, "x", "acquired by Zed. later acquired by Other"), (6, None, "owned by ...")]
    e, spans = spans_of(spark, rows)
    whole = {1: rows[0][2], 2: f"{rows[1][1]} {rows[1][2]}", 5: "x acquired by Zed. later acquired by Other"}
    got = {(r["evidence_id"], r["predicate"], r["name"]): r for r in evidence.outermost(spans).collect()}
    assert set(got) == {(1, "OPERATED_BY", "Example Holdings"), (2, "BRAND_OF", "North-West Co"), (5, "ACQUIRED_BY", "Zed")}
    assert all(whole[k[0]][r["start"] : r["end"]] == r["quote"] for k, r in got.items())
    assert got[1, "OPERATED_BY", "Example Holdings"]["entity_type"] == "OPERATING_ENTITY" and got[2, "BRAND_OF", "North-West Co"]["quote"] == "a brand of North-West Co.,"
    # Inside the longer one stands the shorter phrase's own span.
    assert spans.where("evidence_id = 2").count() == 2


def test_claims_meet_the_spans_they_overlap(spark):
    rows = [(1, None, "x" * 3000 + " It is operated by Example Holdings. " + "y" * 3000 + " is part of Zed"), (2, "T", "nothing")]
    e, spans = spans_of(spark, rows)
    claims = spark.createDataFrame([(1, 1, "operated by"), (2, 1, "Holdings. yyyy"), (3, 1, "xxx It"), (4, 1, "not there"), (5, 9, "gone"), (6, 1, rows[0][2]), (7, 2, "nothing")], "claim_id int, evidence_id int, quote string")
    placed = evidence.located(claims, e)
    at = {r["claim_id"]: (r["start"], r["end"]) for r in placed.collect()}
    assert at[1] == (3007, 3018) and at[4] == (-1, -1) and at[5] == (None, None) and at[7] == (2, 9)
    for width in (16, 1024):
        got = sorted((r["claim_id"], r["predicate"], r["name"]) for r in evidence.supported(placed, spans, width).collect())
        assert got == [(1, "OPERATED_BY", "Example Holdings"), (2, "OPERATED_BY", "Example Holdings"), (6, "OPERATED_BY", "Example Holdings"), (6, "PART_OF", "Zed")]


def test_candidates_fall_back_where_nothing_valid_came(spark):
    e, _ = spans_of(spark, [(1, None, "owned by Alpha"), (2, None, "owned by Beta"), (3, None, "owned by Gamma"), (4, None, "plain")])
    given = spark.createDataFrame([(1, "Acme", "brand", "x"), (1, " ACME ", "BRAND ", "y"), (1, "Acme", "planet", "z"), (2, "Acme", "planet", "x"), (3, " ", "BRAND", "x")], "evidence_id int, name string, entity_type string, relation string")
    got = sorted(map(tuple, evidence.candidates(given, e, ["BRAND", "UNKNOWN"]).collect()))
    assert got == [(1, "Acme", "BRAND", "x", "structured"), (2, "Beta", "UNKNOWN", "OWNED_BY", "deterministic"), (3, "Gamma", "UNKNOWN", "OWNED_BY", "deterministic")]


def test_fit_of_notes(spark):
    notes = ["Sells a SMART LOCK and pet feeder; coppa; recently acquired", "riot", "nothing", None, "21+ whiskey, financing, subscription, hipaa, soc 2 type ii, franchise, waitlist, reddit ama"]
    index = terms.Index(w for *_, words in V.FIT_AMPLIFIERS + V.NEGATIVE_RULES for w in words)
    d = spark.createDataFrame([(n,) for n in notes], "n string").coalesce(1).withColumn("found", index.terms_in(F.lower(F.coalesce("n", F.lit("")))))
    has, none = index.any_of(F.col("found")), [F.lit(None).cast(t) for t in ("int", "long", "boolean")]
    got = [(r[0], r[1], r[2]) for r in d.select(rules.fit_raw(has, *none), F.array_join(rules.fit_attributes(has, *none), ","), F.array_join(rules.negative_flags(has), ",")).collect()]
    assert got[0] == (5, "iot_device_control,kids_minors", "ma_freeze") and got[1] == (3, "iot_device_control", "") and got[2] == got[3] == (0, "", "")
    assert got[4][0] == 1 + 1 + 1 + 2 + 2 + 1 + 2 + 2
