"""License scan against plain Python, against matching without pieces, and against an edit distance of its own."""

import random
import re

import regex

from meridix.llm import licenses, queries

FOLDER = "/root/testdata/sf0.01"
PHRASES = {"mit": "under the mit license", "apache-2": "apache license version 2", "cc-by-nc": "cc by nc"}


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def base(text):
    w = words(text)
    found = [(k, label) for label, p in PHRASES.items() for k in range(len(w)) if w[k : k + len(p.split())] == p.split()]
    starts = [k for k, _ in found]
    return len(w), len(found), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in found}))


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, above = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(above[j] + 1, row[-1] + 1, above[j - 1] + (x != y)))
    return row[-1]


def least_edits(text, phrase, most):
    """Fewest edits over runs of whole words, by plain edit distance; fixed words must stand where the phrase has them."""
    w, parts = words(text), re.split(r"\{(.*?)\}", phrase)
    n, best = len(re.sub("[{}]", "", phrase).split()), None
    for i in range(len(w)):
        for j in range(i + 1, min(len(w), i + n + most + 1) + 1):
            span = " ".join(w[i:j])
            for cost in _costs(span, parts):
                best = cost if best is None or cost < best else best
    return best


def _costs(span, parts):
    if len(parts) == 1:
        yield distance(parts[0], span)
        return
    for m in re.finditer(f"(?=(?<![^ ]){re.escape(parts[1])}(?![^ ]))", span):
        yield from (distance(parts[0], span[: m.start()]) + c for c in _costs(span[m.start() + len(parts[1]) :], parts[2:]))


def test_base_equals_brute_force(spark):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()}
    got = queries.op11_license_scan(spark, FOLDER).collect()
    assert len(got) == len(texts)
    for r in got:
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) == base(texts[r["doc_id"]])
        assert set(r["base_labels"].split(",")) <= set(r["labels"].split(",")) | {""} and 0 <= r["score"] <= 1
        assert (r["score"] == 0) == (r["labels"] == "")
        for m in r["matches"]:
            part = texts[r["doc_id"]][m["start"] : m["end"]]
            assert any(label == m["label"] and distance(" ".join(words(part)), re.sub("[{}]", "", p)) <= k for label, p, k in licenses.NOTICES)
    assert any(r["labels"] != r["base_labels"] for r in got)


def edited(rng, text, n):
    for _ in range(n):
        at, kind = rng.randrange(len(text)), rng.randrange(3)
        text = text[:at] + (rng.choice("abcxyz 2é") if kind else "") + text[at + (kind != 2) :]
    return text


def test_pieces_lose_no_match():
    """Whatever few edits a notice takes, the label is that of an edit distance worked out over all runs of words."""
    rng, scanner = random.Random(7), licenses.Scanner()
    for label, phrase, most in licenses.NOTICES:
        plain = re.sub("[{}]", "", phrase)
        for n in range(most + 3):
            for _ in range(3 if len(plain) < 60 else 1):
                text = f"lorem éé {edited(rng, plain, n)} ipsum dolor"
                got = {m["label"]: m["edits"] for m in licenses.scan(text.encode(), scanner)["matches"]}
                least = [c for own, p, k in licenses.NOTICES if own == label and (c := least_edits(text, p, k)) is not None and c <= k]
                assert (label in got) == bool(least), (text, got, least)
                assert not least or got[label] <= max(least)


def test_spans_and_scores():
    scanner = licenses.Scanner()
    text = "Été — Released Under the  MIT-Licence!\nÜber Apache License, Version 2.0; cc by-nc cc by nc"
    got = licenses.scan(text.encode(), scanner)
    assert [(m["label"], text[m["start"] : m["end"]], m["edits"]) for m in got["matches"]] == [("mit", "Under the  MIT-Licence", 1), ("apache-2", "Apache License, Version 2", 0), ("cc-by-nc", "cc by-nc", 0), ("cc-by-nc", "cc by nc", 0)]
    assert (got["labels"], got["base_labels"], got["n_base"], got["first_word"], got["last_word"], got["score"]) == ("apache-2,cc-by-nc,mit", "apache-2,cc-by-nc", 3, 8, 16, 1.0)
    one = licenses.scan(b"under the mit licence", scanner)
    assert (one["labels"], one["base_labels"], one["score"]) == ("mit", "", 1 - 1 / 21)
    for other in ("under the mpl license", "apache license version 1", "gnu lesser general public license version 3", "the committee", "under the emit license"):
        found = licenses.scan(other.encode(), scanner)["labels"]
        assert found == ("lgpl" if "lesser" in other else ""), (other, found)


def test_patterns_count_all_edits():
    # Parts on both sides of a fixed word share one bound.
    assert licenses.scan(b"undr the mit licnse", licenses.Scanner())["labels"] == "mit"
    assert licenses.scan(b"undr teh mit licnse", licenses.Scanner())["labels"] == ""
    assert all(regex.compile(licenses.notice(*n).pattern) for n in licenses.NOTICES)


def test_awkward_rows_and_long_texts(spark):
    long = "under the mit license " * 100_000
    rows = [(1, None), (2, ""), (3, " ,; "), (4, "Under the MIT license"), (4, "Under the MIT license"), (None, "CC BY-NC"), (5, long), (6, "a" * 1_000_000)]
    table = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'x' as labels", "1 as score", "2 as matches")
    got = licenses.find_licenses(table).collect()
    assert len(got) == len(rows)
    by = {r["doc_id"]: r for r in got}
    assert all(by[k]["labels"] == "" and by[k]["score"] == 0 and by[k]["first_word"] is None and by[k]["n_words"] == 0 for k in (1, 2, 3))
    assert by[4]["n_base"] == 1 and by[None]["labels"] == "cc-by-nc" and by[6]["n_words"] == 1
    assert (by[5]["n_base"], by[5]["first_word"], by[5]["last_word"], len(by[5]["matches"])) == (100_000, 0, 399_996, 100_000)
    assert licenses.find_licenses(table.limit(0)).count() == 0
