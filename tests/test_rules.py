"""Rules that no SQL twin covers, against plain Python."""

import random
from difflib import SequenceMatcher
from functools import partial

from pyspark.sql import functions as F

from meridix import catalog
from meridix.functions import text as T
from meridix.operators import matching, rules, windows
from meridix.plans import queue
from meridix.sources import tables

FOLDER = "/root/testdata/sf0.01"


def test_name_similarity_equals_difflib(spark):
    names = {r["p_partkey"]: " ".join(sorted({t for t in r["p_name"].lower().split() if t not in T.LEGAL_SUFFIXES})) for r in spark.read.parquet(f"{FOLDER}/part.parquet").collect()}
    got = catalog.QUERIES["name_similarity"](spark, FOLDER).collect()
    assert len(got) == catalog.QUERIES["blocking_candidates"](spark, FOLDER).count()
    assert all(abs(r["ratio"] - SequenceMatcher(None, names[r["left_id"]], names[r["right_id"]]).ratio()) < 1e-4 for r in got)


def test_routing_cases(spark):
    cases = [  # fit, intent, behaviour, flags, bridge, depth -> priority, modifiers
        ((6, 6.0, False, [], False, 0), ("P1", "")), ((6, 5.0, False, [], False, 2), ("P2", "decision_maker_depth")), ((5, 6.0, False, [], False, 0), ("P3", "")),
        ((0, 0.0, True, [], True, 0), ("P1", "behavior_p1")), ((6, 0.0, False, [], True, 0), ("P1", "india_bridge")), ((0, 0.0, False, [], True, 0), ("P4", "")),
        ((9, 9.0, False, ["corporate_route_only"], False, 0), ("P3", "corporate_route_cap")), ((9, 9.0, False, ["ma_freeze"], False, 0), ("P2", "ma_freeze_cap")),
        ((9, 9.0, False, ["corporate_route_only", "ma_freeze", "business_contraction", "founder_departed"], True, 0), ("P3", "corporate_route_cap,ma_freeze_cap,business_contraction_friction,founder_transition_friction")),
    ]
    rows = spark.createDataFrame([c for c, _ in cases], "fit int, intent double, behaviour boolean, flags array<string>, bridge boolean, depth int")
    priority, modifiers = rules.route(*(F.col(c) for c in rows.columns))
    assert [tuple(r) for r in rows.coalesce(1).select(priority, F.array_join(modifiers, ",")).collect()] == [want for _, want in cases]


def test_candidates_of_hot_blocks_stay_few(spark):
    records = spark.range(500).select("id", F.lit("Common Name Inc").alias("name"), F.lit("").alias("domain"))
    got = matching.blocked_pairs(records, records, 3).collect()
    assert len(got) == 1500 and {r["right_id"] for r in got if r["left_id"] == 1} == {0, 2, 3}
    assert matching.blocked_pairs(records.limit(0), records.limit(0), 3).count() == 0


def test_trailing_count_across_stretches(spark):
    times = [0, 1, 1, 59, 60, 3599, 3600, 3605, 7199, 7200, 7201, 9000]
    rows = spark.createDataFrame([(k, "a", t) for k, t in enumerate(times)], "id int, key string, s int").withColumn("ts", F.timestamp_seconds("s"))
    got = {r["id"]: r["n"] for r in windows.trailing_count(rows, ["key"], "ts", 60, "n", stretch=100).collect()}
    assert got == {k: sum(t - 60 <= x <= t for x in times) for k, t in enumerate(times)}


def test_host_and_url_forms(spark):
    value = lambda f, x: spark.range(1).select(f(F.lit(x))).first()[0]
    assert value(T.domain, " HTTPS://u@WWW.Acme.CO.uk:443/x ") == "www.acme.co.uk" and value(T.bare_host, "https://www.x.org.") == "x.org"
    assert value(T.canonical_url, "HTTP://A.com:80/b//?q#f") == "http://a.com/b?q" and value(T.phone, "+1 (2) 3-4") == "+1234"
    assert value(T.registrable_domain, "a.b.ac.uk") == "b.ac.uk" and value(T.email, "A@B@C.D") == "A@B@c.d"
    assert value(T.profile_url, "linkedin.com/company/x") is None


def test_decision_records(spark):
    import hashlib

    leads = spark.createDataFrame([(1, False), (2, False), (3, True), (4, False), (5, False)], "left_id long, related boolean")
    compared = spark.createDataFrame([(2, 20, 55, False, False), (2, 21, -45, False, True), (3, 30, 100, True, False), (3, 31, 120, False, False), (4, 40, 100, True, False), (4, 41, 95, True, False), (5, 50, 0, True, True)], "left_id long, right_id long, score int, strong boolean, rejected boolean")
    got = {r["left_id"]: r for r in matching.decision_records(leads, compared, 25).collect()}
    assert {k: (r["status"], r["best_id"], r["rejected"], r["research_required"]) for k, r in got.items()} == {1: ("UNRESOLVED", None, "", True), 2: ("AMBIGUOUS", None, "21", True), 3: ("MATCHED_WITH_RELATIONSHIP", 30, "", False), 4: ("CONFLICT", None, "", True), 5: ("NO_MATCH", None, "50", True)}
    # Eligible candidates come first, whatever the others' scores.
    for lead, material in ((1, ""), (2, "20:55|21:-45"), (3, "30:100|31:120"), (4, "40:100|41:95")):
        assert got[lead]["decision_id"] == f"erd:{lead}:{hashlib.sha256(f'{lead}|{material}'.encode()).hexdigest()[:24]}"
    assert got[3]["trace"] == "candidate_generation: Selected 2 candidates with budget 25. / adjudication: Candidate 30 selected with score 100."


def test_people_from_evidence(spark):
    from meridix.operators.people import resolve_people

    page = "https://www.linkedin.com/in/"
    people = [
        (1, "Jane Doe", "CTO", None, page + "jane-doe", "acme.com", "Acme"), (2, "Jane Doe", "CTO", None, page + "jdoe", "acme.com", "Acme"), (3, "Jane Doe", "CFO", "finance", page + "doe-jane-1", "www.acme.com", None),
        (4, "Cher", None, "", page + "cher", "acme.com", "Acme"), (5, "Bo Li", "", "security", None, "acme.com", "Acme"), (6, "Ann Lee", "Head of Growth", None, page + "ann-lee", "acme.com", "Acme"),
    ]
    evidence = [  # person, claim type, name, text, ended, current, domain, company, url
        (1, "person", "jane  DOE", "leads", None, None, None, None, "https://www.acme.com/team"), (1, "person", "Jane Doe", "", None, True, None, None, "http://news.org:80/a"), (1, "person", "Jane Roe", "former", None, None, None, None, "x"),
        (2, "company_current", "Jane Doe", "", None, None, "www.ACME.com", None, "https://linkedin.com/x"), (3, "person", "Jane Doe", "previously CFO of X".lower(), None, None, None, None, "https://eu.acme.com/"),
        (5, "person", "Bo Li", "", None, False, None, None, "https://acme.com/"), (6, "former_role", "Ann Lee", "", None, None, None, None, "https://acme.com/"), (6, "person", "Ann Lee", "", None, None, None, None, "https://notacme.com/"),
    ]
    p = spark.createDataFrame(people, "person_id int, full_name string, job_title string, role_family string, profile string, domain string, company_name string")
    e = spark.createDataFrame(evidence, "person_id int, claim_type string, claim_name string, claim_text string, ended boolean, is_current boolean, claim_domain string, claim_company string, source_url string")
    got = {r["person_id"]: tuple(float(x) if k < 5 else x for k, x in enumerate(r[1:])) for r in resolve_people(p, e).collect()}
    assert got == {
        1: (1.0, 0.95, 0.95, 1.0, 0.9825, "outreach_ready", "name_match,current_company_match,title_match,company_site_support,independent_source_support"),
        2: (0.3, 0.75, 0.8, 1.0, 0.465, "review", "current_company_match,title_match,ambiguous_name_penalty"),
        3: (0.9, 0.85, 0.95, 0.0, 0.8975, "review", "name_match,current_company_match,title_match,company_site_support,current_title_conflict"),
        4: (0.0, 0.0, 0.8, 0.0, 0.12, "review", "ambiguous_name_penalty"),
        5: (0.15, 0.0, 0.0, 1.0, 0.0975, "review", "title_match,company_site_support,stale_employment_penalty"),
        6: (0.45, 0.0, 0.95, 1.0, 0.435, "review", "name_match,title_match,company_site_support,independent_source_support,former_employee_penalty"),
    }


def test_candidates_whatever_the_tasks_and_frequent_blocks(spark):
    rng = random.Random(11)
    words = ["north", "south", "east", "west", *[f"w{k}" for k in range(30)]]
    rows = [(k, " ".join(rng.choices(words, k=3)) if k % 13 else "", rng.choice(["", f"www.x{k % 7}.co.uk", "y.com"])) for k in range(160)]
    table = spark.createDataFrame(rows, "id long, name string, domain string")
    met = {}
    for r in matching.blocks(table, "left").collect():
        met.setdefault(r["block"], set()).add(r["left_id"])
    near = {k: sorted(set().union(*[ids for ids in met.values() if k in ids]) - {k}) for k, _, _ in rows}
    for budget, task_records in ((4, 20_000), (4, 40), (25, 9), (200, 1)):
        pairs = matching.blocked_pairs(table, table, budget, task_records)
        want = sorted((k, x, at) for k, xs in near.items() for at, x in enumerate(xs[:budget], 1))
        assert sorted(map(tuple, pairs.collect())) == want
        # Records and not file sizes decide how many tasks make the pairs.
        n, plan = -(-160 // task_records), pairs._jdf.queryExecution().executedPlan().toString()
        assert n == 1 or plan.count(f", {n}), REPARTITION_BY_NUM") >= 2


def test_paths_whatever_the_tasks(spark, tmp_path, monkeypatch):
    rng = random.Random(5)
    orders = [(k, k % 7) for k in range(100)] + [(3, 3), (4, 1), (None, 2), (101, None)]  # a repeated order, one of two accounts, no order, no account
    lines = [(rng.choice([*range(102), None]), rng.choice([*range(6), None]), float(rng.randint(1, 900))) for _ in range(700)]
    nations = {k: k % 3 for k in range(5)} | {4: None}
    for name, rows, kinds in (("orders", orders, "o_orderkey long, o_custkey long"), ("lineitem", lines, "l_orderkey long, l_suppkey long, l_extendedprice double"), ("supplier", list(nations.items()), "s_suppkey long, s_nationkey int")):
        spark.createDataFrame(rows, kinds).write.parquet(f"{tmp_path}/{name}.parquet")
    want = {}
    for key, account in orders:
        for order, by, price in lines:
            if order == key and key is not None and by in nations:
                met = want.setdefault((account, nations[by]), [set(), 0.0])
                met[0].add(key)
                met[1] += price
    for task_rows, n in ((250_000, 1), (50, 14)):
        monkeypatch.setattr(queue, "tasks", partial(tables.tasks, task_rows=task_rows))
        got = queue.attribution_path(spark, str(tmp_path))
        # Lines and not file sizes decide how many tasks hold them.
        assert n == 1 or got._jdf.queryExecution().executedPlan().toString().count(f", {n}), REPARTITION_BY_NUM") == 2
        assert {(r[0], r[1]): (r[2], float(r[3])) for r in got.collect()} == {k: (len(ids), total) for k, (ids, total) in want.items()}


def test_all_pairs_whatever_the_cells(spark):
    rng = random.Random(3)
    words = ["north", "south", "east", *[f"w{k}" for k in range(20)]]
    rows = [(k % 150 or None, " ".join(rng.choices(words, k=3)) if k % 13 else "", rng.choice(["", f"www.x{k % 7}.co.uk", "y.com"]), k) for k in range(170)]  # ids that repeat, and none
    table = spark.createDataFrame(rows, "id long, name string, domain string, row int").cache()
    met = {}
    for r in matching.blocks(table.where("id is not null"), "left").collect():
        met.setdefault(r["left_id"], set()).add(r["block"])
    want = sorted((a, b, x, y) for a, *_, x in rows for b, *_, y in rows if a and b and a != b and met.get(a, set()) & met.get(b, set()))
    assert len(want) > 25 * len(rows)
    for cell_records in (10_000, 20, 3):
        pairs = matching.all_pairs(table, table, cell_records)
        assert sorted(map(tuple, pairs.select("left_id", "right_id", "left_row", "right_row").collect())) == want
    assert matching.all_pairs(table.limit(0), table.limit(0)).count() == 0
    nameless = spark.createDataFrame([(1, None, "x.com"), (2, "north", "www.x.com"), (3, "north", "")], "id long, name string, domain string")
    assert sorted(map(tuple, matching.all_pairs(nameless, nameless).select("left_id", "right_id").collect())) == [(1, 2), (2, 1), (2, 3), (3, 2)]


def test_decisions_look_at_every_candidate(spark, tmp_path):
    from meridix.plans import resolution

    rows = [(k, "common name", "Brand#1", "T", 1, 1.0) for k in range(90)]  # each lead has 89 candidates
    spark.createDataFrame(rows, "p_partkey long, p_name string, p_brand string, p_type string, p_size int, p_retailprice double").write.parquet(f"{tmp_path}/part.parquet")
    holds = lambda kind, a, b: any(k in kind and eval(c.replace(" = ", " == "), {"left_id": a, "right_id": b}) for k, c in resolution.FACTS.items())
    got = {r["left_id"]: r for r in catalog.QUERIES["entity_compare_adjudicate"](spark, str(tmp_path)).collect()}
    assert len(got) == 90
    for a, r in got.items():
        others = [b for b in range(90) if b != a]
        eligible = [b for b in others if holds(matching.STRONG, a, b) and not holds(matching.NEGATIVE, a, b)]
        assert r["n_rejected"] == sum(holds(matching.NEGATIVE, a, b) for b in others)
        assert r["best_id"] == (eligible[0] if len(eligible) == 1 else None) and (r["status"] == "CONFLICT") == (len(eligible) > 1)


def test_name_similarity_of_every_pair(spark, tmp_path):
    names = ["north ring", "ring of north", "Ring Ltd", "rings", "north", "", None]
    rows = [(k, names[k % 7], "Brand#1", "T", 1, 1.0) for k in range(320)]
    spark.createDataFrame(rows, "p_partkey long, p_name string, p_brand string, p_type string, p_size int, p_retailprice double").write.parquet(f"{tmp_path}/part.parquet")
    tokens = {k: None if n is None else sorted({t for t in n.lower().split() if t not in T.LEGAL_SUFFIXES}) for k, n, *_ in rows}
    host = lambda k: k % 300 if k % 7 else None
    want = {(a, b) for a in tokens for b in tokens if a != b and (set(tokens[a] or ()) & set(tokens[b] or ()) or host(a) is not None and host(a) == host(b))}
    found = catalog.QUERIES["name_similarity"](spark, str(tmp_path)).collect()
    got = {(r["left_id"], r["right_id"]): r["ratio"] for r in found}
    assert len(found) == len(got) and set(got) == want
    for (a, b), ratio in got.items():
        x, y = tokens[a], tokens[b]
        assert (ratio is None) == (x is None or y is None) and (ratio is None or abs(ratio - SequenceMatcher(None, " ".join(x), " ".join(y)).ratio()) < 1e-4)
