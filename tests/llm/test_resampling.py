"""Importance resampling against plain Python and its SQL twin."""

import hashlib
import math
import re
import zlib
from collections import Counter

import duckdb
import numpy as np

from meridix.llm import common, queries, resampling

FOLDER = "/root/testdata/sf0.001"


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute(rows, target, percent=10, least=20, longest=1, buckets=10_000, seed=2024):
    grams = lambda w: [" ".join(w[i : i + k]) for k in range(1, longest + 1) for i in range(len(w) - k + 1)]
    bucket = lambda g: zlib.crc32(g.encode()) % buckets
    own = [(i, words(t)) for i, t in rows]
    s, t = Counter(bucket(g) for _, w in own for g in grams(w)), Counter(bucket(g) for x in target for g in grams(words(x)))
    S, T = sum(s.values()), sum(t.values())
    gain = {b: math.floor(1000 * math.log((t[b] + 1) * (S + buckets) / ((s[b] + 1) * (T + buckets)))) for b in s}
    out = []
    for i, w in own:
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[bucket(g)] for g in grams(w))
        out.append([i, len(grams(w)), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), len(w)])
    can = sorted((r for r in out if r[4] >= least), key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[1], r[2]))
    place = {}
    for k, r in enumerate(can[: len(can) * percent // 100]):
        place.setdefault(tuple(r), []).append(k + 1)
    return Counter((*r[:4], place[tuple(r)].pop() if place.get(tuple(r)) else None) for r in out)


def test_resampling_equals_brute_force_and_sql(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    target = [r["text"] for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()]
    got = Counter(map(tuple, queries.op12_importance_resampling(spark, FOLDER).collect()))
    assert got == brute([(r["doc_id"], r["text"]) for r in docs.collect()], target)
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{FOLDER}/{t}.parquet')")
    assert got == Counter(con.sql(resampling.SQL).fetchall())


def test_resampling_awkward_rows(spark):
    text = "alpha beta Gamma, gamma! É1 ß " * 4
    rows = [(1, None), (2, ""), (3, " .,; "), (4, text), (4, text), (4, text), (None, text), (None, text), (5, "x" * 100_000 + " y"), (6, "un deux trois " * 9), (7, "un deux " * 40_000)]
    table = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'a' as weight", "1 as score", "2 as rank", "3 as n_words")
    target = ["un deux trois quatre", None, ""]
    wanted = spark.createDataFrame([(t,) for t in target], "text string")
    for longest, percent in ((1, 40), (3, 100)):
        got = resampling.resample(table, wanted, percent, longest=longest, buckets=500)
        assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"]
        assert Counter(map(tuple, got.collect())) == brute(rows, target, percent, longest=longest, buckets=500)
    none = table.limit(0)
    assert resampling.resample(none, wanted).count() == 0
    assert Counter(map(tuple, resampling.resample(table, wanted.limit(0), 50).collect())) == brute(rows, [], 50)


def test_long_texts_are_cut_between_words(monkeypatch):
    raw = b"ab  c " + b"d" * 50 + b" e f"
    assert b"".join(common.stretches(raw, 5)) == raw and [w for p in common.stretches(raw, 5) for w in p.split()] == raw.split()
    assert list(common.stretches(b"")) == []


def test_run_lengths():
    values, n = resampling.run_lengths(np.array([3, 1, 3, 3, 65535], np.uint16))
    assert values.tolist() == [1, 3, 65535] and n.tolist() == [1, 3, 1]
    assert [len(x) for x in resampling.run_lengths(np.empty(0, np.uint16))] == [0, 0]
