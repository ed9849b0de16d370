"""Cleanup and snapshots on cases worked out by hand."""

import json

from meridix.operators import cleanup, snapshots


def test_deletion_spreads_level_by_level(spark):
    tables = {
        "people": spark.createDataFrame([(1, "Ann"), (2, "Bob"), (3, None)], "person int, name string"),
        "evidence": spark.createDataFrame([(10, 1, None), (11, 2, "Ann"), (12, 2, "Bob"), (13, None, None), (14, 3, "Cy")], "evidence int, person int, claim string"),
        "signals": spark.createDataFrame([(20, 10), (21, 11), (22, 12), (23, None)], "signal int, evidence int"),
        "scores": spark.createDataFrame([(30, 20, None), (31, 22, None), (32, 22, 31), (33, None, 30), (34, 23, 35), (35, 23, 34)], "score int, signal int, based_on int"),
    }
    keys = {"people": "person", "evidence": "evidence", "signals": "signal", "scores": "score"}
    refs = [cleanup.Reference("evidence", "person", "people", "person"), cleanup.Reference("evidence", "claim", "people", "name", "claim is not null"), cleanup.Reference("signals", "evidence", "evidence", "evidence"), cleanup.Reference("scores", "signal", "signals", "signal"), cleanup.Reference("scores", "based_on", "scores", "score")]
    gone = cleanup.cascade(tables, {"people": tables["people"].where("person = 1")}, refs, keys)
    ids = lambda found: {name: sorted(r[0] for r in rows.select(keys[name]).collect()) for name, rows in found.items()}
    # Ann goes, what names her by id or in its claim, what rests on that, and the score based on a score that goes.
    assert ids(gone) == {"people": [1], "evidence": [10, 11], "signals": [20, 21], "scores": [30, 33]}
    assert ids(cleanup.kept(tables, gone, keys)) == {"people": [2, 3], "evidence": [12, 13, 14], "signals": [22, 23], "scores": [31, 32, 34, 35]}
    # Scores that rest on each other go together, and the circle ends.
    assert ids(cleanup.cascade(tables, {"scores": tables["scores"].where("score = 34")}, refs, keys)) == {"people": [], "evidence": [], "signals": [], "scores": [34, 35]}
    assert ids(cleanup.cascade(tables, {}, refs, keys)) == {name: [] for name in tables}


def test_quality_of_companies(spark):
    runs = spark.createDataFrame([(1, 100, "completed"), (2, 100, "failed"), (3, 200, "completed"), (4, 300, "failed")], "run_id int, company_id int, status string")
    evidence = spark.createDataFrame([(1, 7, "u", 0.9), (1, 7, " ", 0.5), (2, 8, None, 0.8), (2, 7, "u", None), (4, 9, "u", 1.0)], "run_id int, decision_maker_id int, source_url string, confidence double")
    people = spark.createDataFrame([(7, 100), (8, 100), (9, 300)], "decision_maker_id int, company_id int")
    methods = spark.createDataFrame([(7, "email", "VERIFIED"), (7, "email", None), (7, "phone", "verified"), (9, "email", "valid")], "decision_maker_id int, channel string, verification_status string")
    signals = spark.createDataFrame([(200, None, None), (200, 5, "d")], "company_id int, evidence_id int, signal_date string")
    one = spark.createDataFrame([(100,), (100,)], "company_id int")
    q = snapshots.quality_by_company(runs, evidence, people, methods, signals, one, one.limit(0))
    got = {r["company_id"]: r.asDict() for r in q.collect()}
    assert set(got) == {100, 200}
    assert [got[100][c] for c in snapshots.COUNTS] == [4, 2, 2, 2, 1, 0, 0, 0, 2, 1] and float(got[100]["avg_confidence"]) == 0.733333 and (got[100]["has_facts"], got[100]["has_score"]) == (True, False)
    assert [got[200][c] for c in snapshots.COUNTS] == [0, 0, 0, 0, 0, 2, 1, 1, 0, 0] and got[200]["avg_confidence"] is None
    totals = snapshots.quality_totals(q).first().asDict()
    assert (totals["enriched"], totals["with_2plus_dm"], totals["with_intent"], totals["with_facts"], totals["with_score"], float(totals["avg_evidence_conf"])) == (2, 1, 1, 1, 0, 0.7333)
    assert snapshots.quality_totals(q.limit(0)).first()["avg_evidence_conf"] == 0


def test_documents_are_cut_in_parts(spark):
    runs = spark.createDataFrame([(1, 100), (2, 200)], "run_id int, company_id int")
    rows = [(1, k, None if k % 2 else k, "u", 0.5, f"2024-01-{k % 28 + 1:02d}") for k in range(500)] + [(2, 900, None, None, None, None)]
    e = spark.createDataFrame(rows, "run_id int, evidence_id int, decision_maker_id int, source_url string, confidence double, observed_at string").selectExpr("* except (observed_at)", "cast(observed_at as date) as observed_at")
    docs = snapshots.evidence_documents(e, runs, 50).collect()
    parts = [json.loads(d["document"]) for d in docs if d["company_id"] == 100]
    assert len(parts) <= 10 and all(len(p) < 120 for p in parts) and sorted(x["id"] for p in parts for x in p) == list(range(500))
    assert all([x["observed_at"] for x in p] == sorted((x["observed_at"] for x in p), reverse=True) for p in parts)
    assert [json.loads(d["document"]) for d in docs if d["company_id"] == 200] == [[{"id": 900}]]


def test_rows_decide_how_many_tasks_make_documents(spark):
    runs = spark.createDataFrame([(k, k % 40) for k in range(120)], "run_id int, company_id int")
    e = spark.range(1200).selectExpr("cast(id % 120 as int) as run_id", "id as evidence_id", "1 as decision_maker_id", "'u' as source_url", "0.5 as confidence", "date'2024-01-01' as observed_at")
    docs = snapshots.evidence_documents(e, runs, 5, task_rows=100)
    assert docs._jdf.queryExecution().executedPlan().toString().count(", 12), REPARTITION_BY_NUM") >= 2
    got = {}
    for d in docs.collect():
        got.setdefault(d["company_id"], []).extend(x["id"] for x in json.loads(d["document"]))
    assert {c: sorted(ids) for c, ids in got.items()} == {c: list(range(c, 1200, 40)) for c in range(40)}
