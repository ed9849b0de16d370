"""Ingestion rules on cases worked out by hand; none of them comes from a query's SQL twin."""

import hashlib
import json
import random

import pytest
from pyspark.sql import functions as F

from meridix.functions import canonical
from meridix.functions import contract_schemas as schemas
from meridix.operators import allocation, contracts, folds, idempotency, scoring, threads, upserts, windows
from meridix.streaming import ingestion


def one_by_one(rows, keys):
    seen, kept = set(), []
    for row in sorted(rows):
        own = {(k, v) for k, v in zip(keys, row[1:], strict=True) if v is not None}
        if not own & seen:
            seen |= own
            kept.append(row[0])
    return kept


def test_rows_that_were_dropped_block_nobody(spark):
    keys = ["k1", "k2", "k3"]
    # 2 falls to 1, so 3 stays; 4 falls to 3, so 6 stays; 7 falls to 6; rows without keys stay.
    rows = [(1, "a", None, None), (2, "a", "x", None), (3, None, "x", "q"), (4, "b", None, "q"), (5, None, None, None), (6, "b", "y", None), (7, "c", "y", "z"), (8, None, None, None)]
    take = lambda rows: sorted(r["id"] for r in idempotency.first_accepted(spark.createDataFrame(rows, "id int, k1 string, k2 string, k3 string"), "id", keys).collect())
    assert take(rows) == one_by_one(rows, keys) == [1, 3, 5, 6, 8]
    assert take([(k, None, None, None) for k in range(3)]) == [0, 1, 2]
    # One value shared by a third of all rows, random ones for the rest, and a chain of rows that fall and stay by turns.
    rng = random.Random(3)
    rows = [(k, "hot" if k % 3 == 0 else f"v{rng.randrange(40)}", rng.choice([None, f"w{rng.randrange(60)}"]), rng.choice([None, f"u{rng.randrange(60)}"])) for k in range(300)]
    rows += [(1000 + k, f"c{k // 2}", None, f"d{(k + 1) // 2}") for k in range(12)]
    assert take(rows) == one_by_one(rows, keys)
    assert idempotency.first_accepted(spark.createDataFrame([], "id int, k1 string, k2 string, k3 string"), "id", keys).count() == 0


def test_stored_rows_block(spark):
    new = spark.createDataFrame([(1, "a", "x"), (2, "b", None), (3, None, "y"), (4, None, None)], "id int, k1 string, k2 string")
    old = spark.createDataFrame([(9, "b", "q"), (8, "z", "y")], "id int, k1 string, k2 string")
    assert sorted(r["id"] for r in idempotency.not_stored(new, old, "id", ["k1", "k2"]).collect()) == [1, 4]


def test_only_frequent_values_are_broadcast(spark):
    rng = random.Random(5)
    rows = [(k, "hot" if k % 3 == 0 else f"v{rng.randrange(90)}", rng.choice([None, f"w{rng.randrange(60)}"])) for k in range(400)]
    table = spark.createDataFrame(rows, "id int, k1 string, k2 string")
    keys = ["k1", "k2"]
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    # From no frequent value to all of them.
    for frequent in (1000, 100, 3, 1):
        kept = idempotency.first_accepted(table, "id", keys, frequent)
        assert sorted(r["id"] for r in kept.collect()) == one_by_one(rows, keys)
        assert "Broadcast" not in plan(kept)
        new = idempotency.not_stored(table.where("id >= 200"), table.where("id < 200"), "id", keys, frequent)
        seen = {(k, v) for r in rows[:200] for k, v in enumerate(r[1:]) if v}
        assert sorted(r["id"] for r in new.collect()) == [r[0] for r in rows[200:] if not seen & set(enumerate(r[1:]))]


def test_links_and_requests_meet_by_shuffle(spark):
    link = ["revoked_at timestamp", "expires_at timestamp", "person_id long", "account_id string", "campaign_id string", "send_id string", "link_type string"]
    request = ["arrival long", "event_id string", "source_event_id string", "idempotency_key string", "session_id string", "occurred_at timestamp", "agent string", "method string", "repeats long", "accept string", "client_hints string", "fetch_mode string"]
    rows = lambda columns: spark.range(9).selectExpr("string(id) AS token", *[f"CAST(NULL AS {c.split()[1]}) AS {c.split()[0]}" for c in columns])
    met = ingestion.resolve(rows(request), rows(link))
    assert "Broadcast" not in met._jdf.queryExecution().executedPlan().toString()


def failures(spark, schema, values):
    rows = spark.createDataFrame([(k, v if isinstance(v, str) else json.dumps(v)) for k, v in enumerate(values)], "k int, j string")
    return [r["f"] for r in sorted(rows.select("k", contracts.contract_failure(F.col("j"), schema).alias("f")).collect())]


def test_every_keyword_of_a_contract(spark):
    schema = {
        "type": "object", "required": ["a"], "additionalProperties": {"type": "integer"},
        "properties": {
            "a": {"type": "string", "minLength": 2, "maxLength": 4, "pattern": "^x"}, "b": {"type": ["number", "null"], "minimum": 0, "maximum": 10}, "c": {"const": "v1"},
            "d": {"type": "array", "minItems": 1, "items": {"$ref": "#/$defs/part"}}, "e": {"type": "string", "format": "uuid"}, "f": {"type": "boolean"}, "g": {"enum": ["p", None]},
        },
        "$defs": {"part": {"type": "object", "additionalProperties": False, "required": ["id"], "properties": {"id": {"type": "integer"}, "sub": {"$ref": "#/$defs/leaf"}}}, "leaf": {"type": "string", "format": "email"}},
    }
    uuid = "aaaaaaaa-bbbb-4ccc-8ddd-eeeeeeeeeeee"
    cases = [
        ({"a": "xy"}, None), ({"a": "xy", "b": 10, "c": "v1", "d": [{"id": 1, "sub": "q@r"}], "e": uuid, "f": True, "g": None, "more": 3}, None), ({}, "required a"), ({"a": None}, "a: type"), ({"a": "x"}, "a: minLength"),
        ({"a": "xyzzy"}, "a: maxLength"), ({"a": "yx"}, "a: pattern"), ({"a": "xy", "b": -0.5}, "b: minimum"), ({"a": "xy", "b": 10.5}, "b: maximum"), ({"a": "xy", "b": None}, None), ({"a": "xy", "b": "1"}, "b: type"),
        ({"a": "xy", "c": "v2"}, "c: const"), ({"a": "xy", "d": []}, "d: minItems"), ({"a": "xy", "d": [{"id": 1}, {"id": 1.5}]}, "d.1.id: type"), ({"a": "xy", "d": [{"id": 1, "sub": "nobody"}]}, "d.0.sub: format email"),
        ({"a": "xy", "d": [{"sub": "q@r"}]}, "d.0: required id"), ({"a": "xy", "d": [{"id": 1, "x": 1}]}, "d.0: additionalProperties"), ({"a": "xy", "d": {}}, "d: type"), ({"a": "xy", "e": uuid[:-1]}, "e: format uuid"),
        ({"a": "xy", "f": 1}, "f: type"), ({"a": "xy", "g": "r"}, "g: enum"), ({"a": "xy", "more": "text"}, "more: type"), ([], "type"), ("{", "json"), ({"a": "é" * 2}, "a: pattern"),
    ]
    assert failures(spark, schema, [c for c, _ in cases]) == [want for _, want in cases]


def test_send_request_takes_any_treatment_and_the_strict_one_does_not(spark):
    uuid = "aaaaaaaa-bbbb-4ccc-8ddd-eeeeeeeeeeee"
    request = {"schema_version": "1", "send_id": uuid, "idempotency_key": "k", "campaign_id": uuid, "person_id": "p", "sequence_step_id": uuid, "mailbox_id": uuid, "scheduled_at": "t", "treatment": {"invalid": True}}
    assert failures(spark, schemas.SEND_REQUEST, [request]) == [None]
    assert failures(spark, schemas.STRICT_SEND_REQUEST, [request]) == ["treatment: additionalProperties"]


def test_canonical_json_at_every_level(spark):
    value = {"b": [1, {"z": None, "a": "é\"\\\n"}], "a": {"d": True, "c": {"y": 2, "x": [[], {}]}}, "": 0.5}
    shuffled = '{"a":{"c":{"x":[ [],{} ],"y":2},"d":true},"":0.5, "b":[1,{"a":"\\u00e9\\"\\\\\\n","z":null}]}'
    want = json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False)
    rows = spark.createDataFrame([(json.dumps(value),), (shuffled,), ("nope",), ('{"a":1,"a":2}',), (None,), ("[2,1]",)], "j string")
    assert [r[0] for r in rows.coalesce(1).select(canonical.canonical_json(F.col("j"))).collect()] == [want, want, None, None, None, "[2,1]"]


def test_derived_ids_follow_key_and_content(spark):
    def digest(prefix, **fields):
        return f"{prefix}_{hashlib.sha256(json.dumps(fields, sort_keys=True, separators=(',', ':')).encode()).hexdigest()[:40]}"

    rows = spark.createDataFrame([("n1", "raw1"), ("n1", "raw2"), (None, "raw1"), (None, "raw2")], "key string, raw string").coalesce(1)
    rows = rows.withColumn("record", canonical.source_record_id(F.lit(" Hunter "), F.col("key"), F.col("raw"))).withColumn("lead", canonical.lead_id(F.lit("HUNTER"), F.col("key"), F.col("record")))
    got = rows.collect()
    for r in got:
        assert r["record"] == digest("sr", source_name="hunter", source_record_key=r["key"], raw_fingerprint=r["raw"])
        fields = {"source_name": "hunter", "source_record_key": r["key"]} | ({"source_record_id": r["record"]} if r["key"] is None else {})
        assert r["lead"] == digest("lead", **fields)
    # A changed observation keeps its lead if the record has a key of its own, and never its record id.
    assert len({r["record"] for r in got}) == 4 and got[0]["lead"] == got[1]["lead"] and got[2]["lead"] != got[3]["lead"]


def test_contact_states(spark):
    day = lambda n: f"2026-09-{10 + n:02d} 12:00:00"
    cases = {
        "inbound ends waiting": ([("message_sent", False, None, 0, 4), ("", True, None, 4, 4)], ("replied", None)),
        "due after the window": ([("connection_request_sent", False, None, 0, 4), ("looked", False, None, 4, 4)], ("follow_up_due", 4)),
        "not due before": ([("message_sent", False, None, 0, 4), ("looked", False, None, 3, 4)], ("awaiting_reply", 4)),
        "due, then sent again": ([("message_sent", False, None, 0, 2), ("", False, None, 3, 2), ("Message_Sent ", False, None, 4, 9)], ("awaiting_reply", 9)),
        "connected": ([("message_sent", False, None, 0, 4), ("profile", False, True, 5, 4)], ("active", 4)),
        "only those who wait are due": ([("closed", False, None, 0, 1), ("looked", False, None, 5, 1)], ("closed", 1)),
        "opt out after a reply": ([("", True, None, 0, None), ("OPT_OUT", False, None, 1, None)], ("suppressed", None)),
        "meeting": ([("meeting_booked", False, False, 0, 3)], ("meeting", None)),
        "nothing happens": ([("looked", False, None, 9, 1)], ("new", 1)),
    }
    rows = [(key, k, e, i, c, day(at), None if nxt is None else day(nxt)) for key, (events, _) in cases.items() for k, (e, i, c, at, nxt) in enumerate(events)]
    random.Random(1).shuffle(rows)
    o = spark.createDataFrame(rows, "contact string, seq int, event string, inbound_message boolean, connected boolean, observed_at string, next_action_at string").withColumns({c: F.col(c).cast("timestamp") for c in ("observed_at", "next_action_at")})
    got = {r["contact"]: (r["state"], None if r["next_action_at"] is None else r["next_action_at"].day - 10) for r in folds.fold_states(o.repartition(4), "contact", "seq", "new").collect()}
    assert got == {key: want for key, (_, want) in cases.items()}


def test_traffic_classes(spark):
    cases = [  # agent, method, repeats, accept, client hints, fetch mode -> class, reason
        (("FeedBot/2.1", "GET", 1, "x", "x", "x"), ("automated", "scanner_10")), (("superbot", "GET", 1, None, None, None), ("automated", "scanner_10")), (("my-bot crawler", "GET", 1, None, None, None), ("automated", "scanner_8")),
        (("robotics lab browser", "GET", 1, "x", "x", None), ("human_candidate", "coherent_browser_hints")), (("botanist", "GET", 1, None, None, None), ("unknown", "insufficient_evidence")), (("Googlebot2", "GET", 1, None, None, None), ("unknown", "insufficient_evidence")),
        (("Mozilla HeadlessChrome/1", "GET", 1, "x", "x", "x"), ("automated", "scanner_6")), (("Proofpoint", "POST", 1, None, None, None), ("automated", "scanner_2")), (("Mozilla", "POST", 99, "x", "x", None), ("unknown", "non_browser_method")),
        (("Mozilla", "head", 20, None, None, None), ("automated", "high_repeat_without_fetch_metadata")), (("Mozilla", "GET", 20, "x", None, "navigate"), ("human_candidate", "coherent_browser_hints")), (("Mozilla", "GET", 19, None, None, None), ("unknown", "insufficient_evidence")),
        ((None, "GET", 1, "x", "x", "x"), ("unknown", "insufficient_evidence")), (("", "GET", None, "x", "x", ""), ("unknown", "insufficient_evidence")), (("Mozilla", "GET", 1, "", "x", None), ("unknown", "insufficient_evidence")),
    ]
    rows = spark.createDataFrame([c for c, _ in cases], "a string, m string, r int, x string, y string, z string").coalesce(1)
    label, why = scoring.traffic_class(*(F.col(c) for c in rows.columns))
    assert [tuple(r) for r in rows.select(label, why).collect()] == [want for _, want in cases]


def test_trailing_sums_leave_the_window_at_its_end(spark):
    calls = [(0, 10), (0, 5), (30, 7), (60, 1), (61, 2), (3599, 4), (3600, 8), (90_000, 3)]
    rows = spark.createDataFrame([(k, "f", t, n) for k, (t, n) in enumerate(calls)], "id int, kind string, s int, n int").withColumn("ts", F.timestamp_seconds("s"))
    got = {r["id"]: (r["m"], r["h"]) for r in windows.trailing_sums(rows, ["kind"], "ts", {"m": (F.col("n"), 60), "h": (F.col("n"), 3600)}, stretch=1).collect()}
    assert got == {k: tuple(sum(n for x, n in calls if t - w < x <= t) for w in (60, 3600)) for k, (t, _) in enumerate(calls)}


def test_thread_roots(spark):
    m = [  # id, in reply to, references
        ("<a>", None, None), ("<b>", "<a>", ""), ("<c>", "<b>", "<a> <b>"), ("<late>", "<c>", "<c>"), (" <d> ", " ", "  <gone>   <x>"), ("<e>", "<d>", None), ("<self>", "<self>", None),
        ("<r2>", "<r1>", None), ("<r3>", "<r2>", None), ("<r1>", "<r3>", None), ("<into>", "<r2>", None), ("<into2>", "<into>", None), (None, "<a>", None), ("", "<a>", None), ("<b>", "<a>", None),
    ]
    m += [(f"n{k:03d}", f"n{k + 1:03d}", None) for k in range(100)]
    got = {r["message_id"]: r["root"] for r in threads.thread_roots(spark.createDataFrame(m, "message_id string, in_reply_to string, references string")).collect()}
    want = {"<a>": "<a>", "<b>": "<a>", "<c>": "<a>", "<late>": "<a>", "<d>": "<gone>", "<e>": "<gone>", "<self>": "<self>", **dict.fromkeys(("<r1>", "<r2>", "<r3>", "<into>", "<into2>"), "<r1>"), **{f"n{k:03d}": "n100" for k in range(100)}}
    assert got == want
    assert threads.thread_roots(spark.createDataFrame([], "message_id string, in_reply_to string, references string")).count() == 0


def test_allocation(spark):
    table = spark.createDataFrame([("e", 2, "b", 50.0), ("e", 1, "a", 50.0), ("half", 1, "a", 30.0), ("over", 1, "a", 60.0), ("over", 2, "b", 41.0), ("minus", 1, "a", -5.0), ("null", 1, "a", None), ("zero", 1, "z", 0.0), ("zero", 2, "a", 100.0)], "experiment string, position int, variant string, allocation_pct double")
    people = spark.createDataFrame([(e, p) for e in ("e", "half", "over", "minus", "null", "zero", "none") for p in range(200)], "experiment string, subject int")
    got = allocation.assign_variants(people, table).collect()
    for r in got:
        bucket = int.from_bytes(hashlib.sha256(f"{r['experiment']}:{r['subject']}".encode()).digest()[:8], "big") % 10_000
        want = {"e": ("a" if bucket < 5000 else "b", "assigned"), "half": ("a", "assigned") if bucket < 3000 else (None, "unallocated"), "zero": ("a", "assigned"), "none": (None, "no_variants")}.get(r["experiment"], (None, "invalid_allocation"))
        assert (r["bucket"], r["variant"], r["status"]) == (bucket, *want)
    assert len(got) == 1400


def test_open_tasks(spark):
    at = lambda n: f"2024-01-{n // 24 + 1:02d} {n % 24:02d}:00:00"
    changes = [  # key, time, op, priority
        ("k", 0, "claim", None), ("k", 1, "upsert", "P3"), ("k", 2, "claim", None), ("k", 3, "upsert", "P1"), ("k", 50, "done", None), ("k", 51, "done", None), ("k", 52, "upsert", "P2"), ("k", 90, "upsert", "P4"),
        ("l", 5, "upsert", "P1"), ("l", 6, "dismissed", None), ("m", 1, "done", None),
    ]
    rows = spark.createDataFrame([(k, i, at(t), op, p) for i, (k, t, op, p) in enumerate(changes)], "k string, id int, ts string, op string, priority string").withColumn("ts", F.col("ts").cast("timestamp"))
    got = sorted((r["k"], r["task_id"], r["priority"], r["status"], str(r["created_at"]), str(r["updated_at"]), r["n_upserts"]) for r in upserts.open_tasks(rows, ["k"], "ts", "id", ["priority"]).collect())
    assert got == [("k", 1, "P1", "done", at(1), at(50), 2), ("k", 6, "P4", "open", at(52), at(90), 2), ("l", 8, "P1", "dismissed", at(5), at(6), 1)]


@pytest.fixture
def links(spark):
    rows = [("t1", None, None, 7, "acc", "camp", None, "asset"), ("t2", None, None, None, "acc2", None, "s2", "page"), ("gone", "2024-01-01 00:00:00", None, 1, "x", "x", "x", "page"), ("old", None, "2024-01-02 00:00:00", 1, "x", "x", "x", "page")]
    d = spark.createDataFrame(rows, "token string, revoked_at string, expires_at string, person_id long, account_id string, campaign_id string, send_id string, link_type string")
    return d.withColumns({c: F.col(c).cast("timestamp") for c in ("revoked_at", "expires_at")})


def requests_of(spark, rows):
    d = spark.createDataFrame(rows, "arrival long, event_id string, token string, idempotency_key string, session_id string, at string, agent string")
    none = F.lit(None).cast("string")
    return d.select("arrival", "event_id", none.alias("source_event_id"), "token", "idempotency_key", "session_id", F.col("at").cast("timestamp").alias("occurred_at"), "agent", F.lit("GET").alias("method"), F.lit(1).alias("repeats"), none.alias("accept"), none.alias("client_hints"), none.alias("fetch_mode"))


def test_batches_of_requests(spark, links, tmp_path):
    folder = str(tmp_path)
    first = [(1, "e1", "t1", "k", "s", "2024-01-03 10:00:00", "Mozilla"), (2, "e2", "t1", "k", "s", "2024-01-03 11:00:00", "Mozilla"), (3, "e3", "gone", "k", "s", "2024-01-03 12:00:00", None), (4, "e4", "old", "", "s", "2024-01-02 00:00:00", None), (5, "e5", "nowhere", "", "s", "2024-01-03 00:00:00", None), (6, "e6", "t2", "", "", "2024-01-03 09:00:00", "FeedBot/1")]
    second = [(7, "e7", "t1", "k", "s", "2024-01-03 08:00:00", None), (8, "e6", "t2", "", "q", "2024-01-04 00:00:00", None), (9, "e9", "t2", "", "s", "2024-01-03 09:00:00", None)]
    for batch, rows in enumerate((first, second, second)):
        # The second batch is repeated, as after a crash: it replaces itself.
        ingestion.ingest_batch(requests_of(spark, rows), links, folder, min(batch, 1))
    events = {r["event_id"]: r["traffic"] for r in spark.read.parquet(f"{folder}/events").collect()}
    assert events == {"e1": "unknown", "e6": "automated", "e9": "unknown"}
    got = {r["session_id"]: r for r in ingestion.current_sessions(spark, folder).collect()}
    s = got["s"]
    # Duplicates of events count as visits; an identity that a later link lacks stays; time last seen never goes back.
    assert set(got) == {"s", "q"} and (s["n"], s["person_id"], s["account_id"], s["campaign_id"], s["send_id"], s["metadata"]) == (4, 7, "acc2", "camp", "s2", {"last_link_type": "page"})
    assert (str(s["first_seen"]), str(s["last_seen"])) == ("2024-01-03 10:00:00", "2024-01-03 11:00:00")
    assert {r["session_id"] for r in ingestion.current_sessions(spark, folder, kept_days=0).collect()} == {"q"}
    assert {r["session_id"] for r in ingestion.compact_sessions(spark, folder, kept_days=0).collect()} == {"q"}


def test_parsed_mail(spark):
    from email.message import EmailMessage

    from meridix.sources import mail

    def message(body, html=None, attached=None, **headers):
        m = EmailMessage()
        for k, v in headers.items():
            m[k.replace("_", "-")] = v
        if body is not None:
            m.set_content(body)
        if html:
            m.add_alternative(html, subtype="html") if body is not None else m.set_content(html, subtype="html")
        if attached:
            m.add_attachment(attached, filename="a.txt")
        return m.as_bytes()

    reply = {"Message_ID": "<r@x>", "From": "Buyer <BUYER@example.com>", "Subject": "Re: Grüße", "In_Reply_To": "<send@x>", "X_SL_Send_Id": "s-1"}
    html_only = EmailMessage()
    html_only["Message-ID"], html_only["From"] = "<h@x>", "a@b.c"
    html_only.make_mixed()
    html_only.add_attachment("<style>p{}</style><p>One <b>two</b></p><script>x</script>three", subtype="html", disposition="inline")
    mails = [
        ("1", message("Interested, let's talk.\n", **reply)), ("2", message("Unsubscribe", **reply | {"References": "<send@x> <mid@x>"})), ("3", message("Plain", html="<p>HTML</p>", attached="Attached", Message_ID="<3@x>", From="a@b.c")),
        ("4", html_only.as_bytes()), ("5", message("x", From="a@b.c")), ("6", message("x", Message_ID="<6@x>", From="nobody")), ("7", b""), ("8", None), ("9", b"\xff\xfe broken \x00 bytes\n\nrest"),
    ]
    got = {r["uid"]: r for r in mail.parsed(spark.createDataFrame(mails, "uid string, raw binary")).collect()}
    one = got["1"]
    assert (one["message_id"], one["sender"], one["subject"], one["thread_key"], one["source_send_id"], one["body"], one["error"]) == ("<r@x>", "buyer@example.com", "Re: Grüße", "<send@x>", "s-1", "Interested, let's talk.", None)
    assert got["2"]["thread_key"] == "<send@x>" and got["3"]["body"] == "Plain" and got["3"]["thread_key"] == "<3@x>" and got["4"]["body"] == "One\ntwo\nthree"
    assert [got[k]["error"] for k in "56789"] == ["message_id_missing", "sender_invalid", "message_id_missing", "message_id_missing", "message_id_missing"]


def test_intake_results_fan_out_and_replay(spark, tmp_path):
    from meridix.sources import intake_store

    folder = str(tmp_path)
    schema = "seq int, source_record_id string, raw_fingerprint string, state string, lead_id string, display_name string, domain string, observations array<struct<observation_id:string,value:string>>, findings array<struct<finding_id:string,code:string>>"

    def deliver(batch, rows):
        return sorted((r["seq"], r["outcome"]) for r in intake_store.persist(spark.createDataFrame(rows, schema), folder, batch).collect())

    a = (1, "a", "fa", "ACCEPTED", "la", "Acme", "a.com", [("o1", "x"), ("o2", "y")], [])
    b = (2, "b", "fb", "QUARANTINED", None, None, None, [], [("f1", "BAD")])
    again = (3, "a", "fa", "ACCEPTED", "la", "Acme 2", "a.com", [("o9", "x")], [])
    other = (4, "a", "other", "ACCEPTED", "la", "Acme 3", "a.com", [("o8", "x")], [])
    first = [a, b, again, other]
    assert deliver(0, first) == [(1, "STORED"), (2, "STORED"), (3, "REPLAY_NOOP"), (4, "COLLISION")]
    # The same batch once more, as after a crash, changes nothing.
    assert deliver(0, first) == [(1, "STORED"), (2, "STORED"), (3, "REPLAY_NOOP"), (4, "COLLISION")]
    assert [r[0] for r in intake_store.quarantined(spark, folder).collect()] == ["b"]
    second = [a, (2, "b", "fb", "ACCEPTED", "lb", "Beta", "b.com", [("o1", "other record"), ("o3", "z")], [("f1", "BAD")]), (3, "c", "fc", "QUARANTINED", None, None, None, [], [("f2", "BAD")])]
    assert deliver(1, second) == [(1, "REPLAY_NOOP"), (2, "STORED"), (3, "STORED")]
    assert [r[0] for r in intake_store.quarantined(spark, folder).collect()] == ["c"]
    got = lambda name, key: sorted(r[key] for r in spark.read.parquet(f"{folder}/{name}").collect())
    assert got("records", "source_record_id") == ["a", "b", "c"] and got("observations", "observation_id") == ["o1", "o2", "o3"] and got("findings", "finding_id") == ["f1", "f2"]
    assert sorted(map(tuple, intake_store.leads(spark, folder).collect())) == [("la", "Acme", "a.com"), ("lb", "Beta", "b.com")]
    states = spark.read.option("basePath", f"{folder}/states").parquet(f"{folder}/states")
    assert sorted(map(tuple, intake_store.latest_states(states).collect())) == [("a", "ACCEPTED", "la"), ("b", "ACCEPTED", "lb"), ("c", "QUARANTINED", None)]
