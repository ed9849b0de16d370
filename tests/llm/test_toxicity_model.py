"""The class-conditional models against counts, back-off and log-ratios worked out with dictionaries."""

import math
import re
from collections import Counter

import numpy as np
import pytest

from meridix.llm import toxicity

FOLDER = "/root/testdata/sf0.001"


def words(text):
    return re.findall("[a-z\x80-\U0010ffff]+", (text or "").lower())


@pytest.fixture(scope="module")
def learned(spark):
    docs, labels = spark.read.parquet(f"{FOLDER}/documents.parquet"), spark.read.parquet(f"{FOLDER}/labels.parquet")
    kept = []
    real = toxicity._count_pairs
    toxicity._count_pairs = lambda rows: kept.extend(rows.collect()) or real(rows)
    try:
        return toxicity.learn(docs, labels), kept, docs.collect()
    finally:
        toxicity._count_pairs = real


def test_counts_back_off_and_ratios_equal_brute_force(learned):
    made, rows, docs = learned
    pairs = (Counter(), Counter())
    for r in rows:
        w = words(r["text"])
        pairs[r["toxic"]].update(zip([None, *w], w, strict=False))
    D = toxicity.DISCOUNT
    kinds, total, mass = (Counter(), Counter()), (Counter(), Counter()), (Counter(), Counter())
    for c in (0, 1):
        for (v, w), n in pairs[c].items():
            kinds[c][w] += 1
            total[c][v] += n
            mass[c][v] += min(n, D)
    vocabulary = {w for c in (0, 1) for w in [*kinds[c], *total[c]]}
    both = Counter(kinds[0]) + Counter(kinds[1])
    shared, back = sum(both.values()), sum(min(k, D) for c in (0, 1) for k in kinds[c].values()) / (sum(kinds[0].values()) + sum(kinds[1].values()))
    kept = [sum(max(k - D, 0) for k in kinds[c].values()) for c in (0, 1)]
    base = lambda w: (max(both[w] - 0.75, 0) + 0.75 * len(both) / (len(vocabulary) + 1)) / shared

    def lower(c, w):
        return (1 - back) * max(kinds[c][w] - D, 0) / kept[c] + back * base(w) if kept[c] else base(w)

    def log_p(c, v, w):
        if not total[c][v]:
            return math.log(lower(c, w))
        return math.log(min(1.0, (max(pairs[c][v, w] - D, 0) + mass[c][v] * lower(c, w)) / total[c][v]))

    assert len(rows) > 20 and {r["toxic"] for r in rows} == {0, 1}
    seen = 0
    for d in docs:
        own = words(d["text"])
        w, before = toxicity.words_of(d["text"])
        assert len(w) == len(own)
        full, low = made.model.ratios(before, w)
        want = [(log_p(1, v, x) - log_p(0, v, x), math.log(lower(1, x)) - math.log(lower(0, x))) for v, x in zip([None, *own], own, strict=False)]
        assert np.allclose(full, [f for f, _ in want], atol=2e-4) and np.allclose(low, [x for _, x in want], atol=2e-4)
        seen += len(own)
    assert seen > 20_000


def test_probabilities_of_a_context_sum_to_at_most_one(learned):
    model = learned[0].model
    for c in (0, 1):
        assert 0 < model.lower[c].sum() <= 1 + 1e-3


def test_features_in_parts_equal_those_of_the_whole(learned, monkeypatch):
    model, text = learned[0].model, " ".join(d["text"] for d in learned[2][:40])
    whole = model.features(text)
    for part in (7, 24, 1000):
        monkeypatch.setattr(toxicity, "PART", part)
        assert np.allclose(model.features(text), whole, rtol=1e-9, atol=1e-9)
    assert model.features("") == model.features(None) == (0.0, 0.0, 0.0, 0.0)


def test_scores_by_block_are_the_same(spark, learned, monkeypatch):
    docs, labels = spark.read.parquet(f"{FOLDER}/documents.parquet"), spark.read.parquet(f"{FOLDER}/labels.parquet")
    rows = docs.select("doc_id", "text").union(spark.createDataFrame([(None, None), (7, ""), (None, "a  b")], "doc_id long, text string"))
    near = sorted(map(str, toxicity.score(rows, model=learned[0]).collect()))
    monkeypatch.setattr(toxicity, "MOST_WORDS", 10)
    monkeypatch.setattr(toxicity, "BLOCK_WORDS", 3000)
    far = toxicity.learn(docs, labels)
    assert len(far.model.words) == 0 and far.words.count() == len(learned[0].model.words)
    assert sorted(map(str, toxicity.score(rows, model=far).collect())) == near
