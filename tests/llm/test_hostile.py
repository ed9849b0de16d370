"""Rows that once cost too much or went wrong: broken markup, very long texts, shared and missing ids, rows repeated millions of times."""

import time
import tracemalloc

import numpy as np
import pytest
from pyspark.sql import functions as F

from meridix.llm import bpe, common, html_extract, langid, queries, sharding, toxicity


@pytest.mark.parametrize("page", ["<a " * 200_000, '<a ="<a" ' * 100_000, "<a '\"" * 100_000, "<!" * 100_000, "<script>" + "</script " * 100_000, "<" * 200_000, "<div>" * 20_000 + "<b>" * 20_000 + "</b>" * 20_000])
def test_broken_markup_is_read_in_linear_time(page):
    began = time.process_time()
    html_extract.main_text(page)
    assert time.process_time() - began < 4


def test_unclosed_tags_are_text_and_quotes_are_followed():
    assert html_extract.main_text('<p title="1>2">a</p><p>b <3 &am<b>p;</b> <i x') == "a\n\nb <3 &amp; <i x"
    assert html_extract.main_text("<p>1 < 2 <em>and</em></p><!-- <p>x</p> -->") == "1 < 2 and"


def test_long_child_lists_meet_at_anchors():
    page = lambda k: html_extract.parse("<ul>" + "".join(f"<li>{'shared' if n % 5 == 0 else k} {n}</li>" for n in range(20_000 + 3 * k)) + "</ul>")
    a, b = page(1), page(2)
    began = time.process_time()
    pairs = html_extract.matched(a, b)
    assert time.process_time() - began < 5 and sum(p.own == q.own for p, q in pairs) >= 4000
    place = [(p.number, q.number) for p, q in pairs]
    assert sorted(place) == sorted(place, key=lambda x: x[1]) and all(len({x[s] for x in place}) == len(place) for s in (0, 1))


@pytest.mark.parametrize("name", "ad-slot ad-container advert-box comment-list comments-section sidebar-widget newsletter-box site-notice".split())
def test_containers_of_furniture_leave_articles(name):
    assert html_extract.main_text(f"<article><p>T</p><div class='{name}'>X</div><p class='{name}'>Y</p></article>") == "T\n\nY"


def test_page_of_template_only_is_empty(spark):
    rows = [(k, f"http://h.example/{k}", f"<body><div><p>Boilerplate line of this host</p>{f'<p>News {k} of the day</p>' if k else ''}</div></body>") for k in range(8)]
    got = {r["page_id"]: r["text"] for r in html_extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {0: "", **{k: f"News {k} of the day" for k in range(1, 8)}}


def test_language_learns_rows_that_share_an_id_or_have_none(spark):
    for doc_id in (None, 7):
        rows = [(doc_id, f"das ist ein deutscher satz nummer {k}", "de") for k in range(60)] + [(k, f"this is an english sentence number {k}", "en") for k in range(60)]
        docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
        model = langid.learn(docs, sample_per_lang=30)
        assert model.labels == ["de", "en"] and model.predict(["das ist ein deutscher satz", "this is an english sentence"])[0] == ["de", "en"]


def test_shards_of_rows_repeated_millions_of_times(spark, monkeypatch):
    # 3 million equal rows, and 100,000 texts without an id: slots stay gapless, and no part of a shard holds more than its share.
    same = spark.range(3_000_000).select(F.lit(5).cast("long").alias("doc_id"), F.lit("x").alias("text"))
    none = spark.range(100_000).select(F.lit(None).cast("long").alias("doc_id"), F.concat(F.lit("t"), "id").alias("text"))
    got = sharding.shard_documents(same.union(none)).groupBy("shard").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("slot").alias("slots"), F.max("slot").alias("last")).collect()
    assert sum(r["n"] for r in got) == 3_100_000 and all(r["n"] == r["slots"] == r["last"] + 1 for r in got)


def test_long_texts_hash_as_short_ones_do(monkeypatch):
    rng = np.random.default_rng(2)
    words = [b"w%d" % k * int(rng.integers(1, 9)) for k in rng.integers(0, 500, 3000)]
    for width in (1, 2, 5):
        for n in (0, 1, 3, 4, 5, 6, 3000):
            joined = b" ".join(words[:n])
            want = common._span_hashes(joined, width)
            for size in (1, 7, 100, 20_000):
                monkeypatch.setattr(common, "HASHED_AT_ONCE", size)
                assert (common.span_hashes(joined, width) == want).all() and len(want) == (0 if not n else max(1, n - width + 1))
                assert common.one_space(b"\t " + joined.replace(b" ", b" \n \x0b ") + b"\r") == joined


def test_memory_of_long_texts_is_bounded():
    text = b"some words " * 2_000_000
    tracemalloc.start()
    common.span_hashes(common.one_space(text), 5)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    # 22 MB of text with 4 million words: 8 bytes a word twice, the text a few times, and the parts.
    assert peak < 300e6


def test_bpe_leaves_no_table_behind(spark):
    docs = spark.createDataFrame([(1, "one two three"), (2, None)], "doc_id long, text string")
    before = {t.name for t in spark.catalog.listTables()}
    got = bpe.encode_decode(docs, queries.tokenizer_path())
    assert {t.name for t in spark.catalog.listTables()} == before
    assert {r["doc_id"]: r["n_tokens"] for r in got.collect()} == {1: 3, 2: 0}


def test_toxicity_of_no_documents(spark):
    none = spark.createDataFrame([], "doc_id long, text string, label string")
    assert toxicity.score(none, spark.createDataFrame([], "doc_id long, toxic int")).count() == 0
