"""Collocations against plain Python and the SQL twin."""

import re
from collections import Counter

import duckdb
import numpy as np
import pytest

from meridix.llm import collocations, queries

FOLDER = "/root/testdata/sf0.001"


def brute(rows, least, longest=5, percent=100, top=2000):
    n, f = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\x0a-\x0d]", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")):
            w = re.findall("[^\x20\x09]+", piece)
            n[lang] += len(w)
            f.update((lang, *w[i : i + m]) for m in range(1, longest + 1) for i in range(len(w) - m + 1))
    c = {p: a for p, a in f.items() if len(p) > 2 and a >= least}
    around = Counter()
    for p, a in c.items():
        for m in range(2, len(p) - 1):
            for i in range(1, len(p) - m + 1):
                key = (p[0], *p[i : i + m])
                around[key] = max(around[key], a)
    found = {}
    for p, a in c.items():
        if around[p] and 100 * around[p] >= percent * a:
            continue
        cuts = [(1000 * a * n[p[0]] // (f[p[: k + 1]] * f[(p[0], *p[k + 1 :])]), k, f[p[: k + 1]], f[(p[0], *p[k + 1 :])]) for k in range(1, len(p) - 1)]
        score, _, l, r = min(cuts)
        found.setdefault(p[0], []).append((-score, -a, " ".join(p[1:]).encode(), l, r))
    return Counter((lang, k + 1, phrase.decode(), -a, l, r, n[lang], -score) for lang, own in found.items() for k, (score, a, phrase, l, r) in enumerate(sorted(own)[:top]))


def counted(frame):
    assert frame.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    return Counter(map(tuple, frame.collect()))


def test_query_equals_sql(spark):
    folder = "/root/testdata/sf0.01"
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{folder}/documents.parquet')")
    want = con.sql(collocations.SQL).fetchall()
    assert counted(queries.op13_collocations(spark, folder)) == Counter(want) and len(want) > 50


@pytest.mark.parametrize(("bits", "block", "least", "percent", "top"), [(22, 400_000, 20, 100, 2000), (9, 500, 8, 90, 50)])
def test_equals_brute_force(spark, monkeypatch, bits, block, least, percent, top):
    """Crowded buckets let false candidates through, never lose one; neither do small blocks that cut texts."""
    monkeypatch.setattr(collocations, "BLOCK_WORDS", block)
    monkeypatch.setattr(collocations, "tokens_of", lambda raw, size=3000 if block == 500 else 1 << 21, f=collocations.tokens_of: f(raw, size))
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    want = brute([(r["lang"], r["text"]) for r in docs.collect()], least, percent=percent, top=top)
    assert len(want) > 20 and counted(collocations.collocations(docs, least, percent=percent, top=top, bits=bits)) == want


def test_awkward_rows(spark):
    text = "New york; new YORK city. old  new\tyork city\nhall"
    rows = [("en", None), ("en", ""), ("en", " .;! "), (None, text), ("und", text), ("en", text), ("en", text), ("en", text), ("de", "a a a a a a"), ("é", "ß É é. " * 3), ("fr", "un deux trois " * 20_000)]
    table = spark.createDataFrame(rows, "lang string, text string").selectExpr("*", "1 as n", "2 as phrase", "'x' as segment", "3 as doc_id")
    for least, longest in ((2, 5), (3, 3), (1, 2)):
        assert counted(collocations.collocations(table, least, longest)) == brute(rows, least, longest)
    assert collocations.collocations(table.limit(0)).count() == 0


def test_exact_beyond_64_bits(spark, monkeypatch):
    """Counts near 2**40: products need over 64 bits, and the score is still the exact floor."""
    big = 1 << 40
    found = spark.createDataFrame([("en", "a", 1, 3 * big), ("en", "b", 1, 2 * big + 1), ("en", "a b", 2, big - 7)], "lang string, phrase string, words int, f long")
    totals = spark.createDataFrame([("en", 9 * big + 5)], "lang string, n long")
    monkeypatch.setattr(collocations, "frequent_phrases", lambda *a: (found, totals))
    row = collocations.collocations(found).first()
    assert row["score"] == 1000 * (big - 7) * (9 * big + 5) // (3 * big * (2 * big + 1))


def test_bitmaps_stop_at_the_least_count():
    level = collocations.Level(1, 12, 3, None, None, False)
    level.add("en", [b"a", b"b"] * 5, 0)
    assert level.thrown.max() == 3 and np.count_nonzero(level.thrown) == 2
    assert level.held == {("en", b"a"): 5, ("en", b"b"): 5}
