"""Each operator against a brute-force version or the library it must agree with, on sf0.001 and on awkward rows."""

import base64
import hashlib
import html
import json
import os
import re
import subprocess
import sys
import zlib
from collections import defaultdict

import numpy as np
import pytest

from meridix.llm import additive, bitsliced, bpe, html_extract, langid, mixing, neardup, queries, secrets, sharding, toxicity

FOLDER = "/root/testdata/sf0.001"
SPACE = "\x20\x09-\x0d"
LONG = "word " * 30_000
AWKWARD = [(1, None, None, None), (2, "", "en", "a"), (3, " \t\n", None, "b"), (4, "one two", "en", "a"), (4, "one two", "en", "a"), (None, "one TWO", "en", None), (5, LONG, "en", "b"), (6, "1234 5678", "de", "é"), (7, "a b c d e f g h", "de", "a"), (8, "a  b c d e F g h", "de", "a")]
SCHEMA = "doc_id long, text string, lang string, source string"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{FOLDER}/documents.parquet")


@pytest.fixture(scope="module")
def texts(docs):
    return {r["doc_id"]: r["text"] for r in docs.collect()}


@pytest.fixture(scope="module")
def awkward(spark):
    """Nulls, empty and long texts, repeated rows, and columns whose names clash with the operators' own."""
    return spark.createDataFrame(AWKWARD, SCHEMA).selectExpr("*", "'x' as size", "1 as key", "2 as score", "3 as n")


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


def words(text):
    return re.findall(f"[^{SPACE}]+", text or "")


def test_mixing_meets_targets_and_limits(docs, texts):
    got = mixing.mix(docs).taken().collect()
    assert sorted((r["doc_id"], r["size"]) for r in got) == sorted((k, len(words(t))) for k, t in texts.items())
    assert all(r["taken"] <= 3 * r["size"] for r in got)
    assert sorted(got) == sorted(mixing.mix(docs).taken().collect())
    source = {r["doc_id"]: r["source"] for r in docs.collect()}
    taken, target = defaultdict(int), {}
    for r in got:
        taken[source[r["doc_id"]]] += r["taken"]
        target[source[r["doc_id"]]] = r["target"]
    assert abs(sum(target.values()) - sum(r["size"] for r in got)) < 1e-6
    assert all(abs(taken[s] - target[s]) <= 0.05 * target[s] for s in target)


def test_mixing_equals_brute_force(docs, texts):
    """Draws, permutations, packing and the join by index, worked out row by row."""
    plan = mixing.mix(docs)
    sources = sorted(plan.sources.collect(), key=lambda r: r["source_no"])
    names = sorted({r["source"] for r in docs.collect()}, key=lambda x: (x is None, x))
    assert [r["source"] for r in sources] == names and [r["weight"] for r in sources] == [k % 3 + 1 for k in range(len(names))]
    quota, room = np.array([round(r["quota"] * 1e6) for r in sources]) / 1e6, np.array([3 * r["blocks"] for r in sources])
    n, left, counts = round(quota.sum()), quota.copy(), np.zeros(len(sources), int)
    rng = np.random.Generator(np.random.Philox(key=[mixing.SEED, mixing.GROUPS]))
    for k in range(mixing.SHARDS):
        got = rng.multinomial(n // mixing.SHARDS + (k < n % mixing.SHARDS), np.maximum(left, 0) / np.maximum(left, 0).sum())
        left, counts = left - got, counts + got
    uses = defaultdict(int)
    for r, total in zip(sources, counts, strict=True):
        slot = np.arange(total)
        for block in mixing.permuted(slot % r["blocks"], slot // r["blocks"], r["blocks"], r["source_no"]):
            uses[r["source_no"], int(block)] += 1
    # The data have a source that reaches its limit in no shard; else draws beyond the room would be dealt anew.
    assert (counts <= room).all()
    taken = defaultdict(int)
    for r in plan.documents.collect():
        for word in range(r["start"], r["start"] + r["size"]):
            taken[r["doc_id"]] += uses[r["source_no"], word // mixing.BLOCK]
    assert {r["doc_id"]: r["taken"] for r in plan.taken().collect()} == {k: taken[k] for k in texts}
    # The draw of each shard decides what is taken.
    assert sorted(mixing.mix(docs, 1).taken().collect()) != sorted(plan.taken().collect())


def test_draws_stay_within_the_room():
    lacking, room = np.array([10.0, 1.0, 0.0, -2.0]), np.array([3, 40, 5, 5])
    for seed in range(20):
        got = mixing.draw(np.random.default_rng(seed), 30, lacking, room)
        assert got.sum() == 30 and (got <= room).all() and got[2] == got[3] == 0
    assert mixing.draw(np.random.default_rng(1), 100, lacking, room).tolist() == room.tolist()


def test_mixing_awkward_rows(awkward, nothing):
    got = mixing.mix(awkward).taken().collect()
    assert len(got) == len(AWKWARD) and all(r["taken"] <= 3 * r["size"] for r in got)
    assert mixing.mix(nothing).taken().count() == 0


def test_mixing_many_equal_rows(spark, monkeypatch):
    monkeypatch.setattr(mixing, "STRETCH", 16)
    rows = spark.createDataFrame([(1, "one two three", "a")] * 100 + [(2, "word " * 5000, "b"), (3, "", "b")] * 2, "doc_id long, text string, source string")
    plan = mixing.mix(rows)
    got = plan.taken().collect()
    assert len(got) == 104 and sum(r["taken"] for r in got if r["doc_id"] == 1) == pytest.approx(900, abs=64) and all(r["taken"] <= 3 * r["size"] for r in got)
    assert sum(len(words(r["text"])) for r in mixing.mixed_documents(rows, plan).collect()) == sum(r["taken"] for r in got)


def test_permutation_is_one():
    for size in (1, 2, 7, 1000):
        assert sorted(mixing.permuted(np.arange(size), np.full(size, 3), size, 5)) == list(range(size))


def test_mixed_blocks_hold_the_words_that_documents_give(docs):
    plan = mixing.mix(docs)
    blocks = mixing.mixed_blocks(docs, plan).collect()
    assert sum(b["n_words"] for b in blocks) == sum(r["taken"] for r in plan.taken().collect()) == sum(len(words(b["text"])) for b in blocks)
    by_doc = mixing.mixed_documents(docs, plan)
    assert by_doc.columns == docs.columns
    assert sum(len(words(r["text"])) for r in by_doc.collect()) == sum(b["n_words"] for b in blocks)


def jump(key, shards):
    key, b, j = key % (1 << 64), -1, 0
    while j < shards:
        b, key = j, (key * 2862933555777941757 + 1) % (1 << 64)
        j = int((b + 1) * (float(1 << 31) / float((key >> 33) + 1)))
    return b


def test_sharding_equals_the_published_hash(docs, texts, awkward, nothing):
    got = sharding.shard_documents(docs).collect()
    assert len(got) == len(texts)
    for r in got:
        raw = texts[r["doc_id"]].encode()
        assert (r["size"], r["text_crc32"], r["shard"], r["grown_shard"]) == (len(raw) + 1, zlib.crc32(raw), jump(r["doc_id"], 16), jump(r["doc_id"], 17))
    odd = sharding.shard_documents(awkward).collect()
    assert len(odd) == len(AWKWARD) and next(r for r in odd if r["doc_id"] == 1)["size"] == 1
    for rows in (got, odd):
        slots = defaultdict(list)
        for r in rows:
            slots[r["shard"]].append(r["slot"])
        assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert sharding.shard_documents(nothing).count() == 0


def test_sharding_many_shards(spark):
    from pyspark.sql import functions as F

    got = spark.range(-50, 50).select("id", sharding.jump_shards(F.col("id"), 1000).alias("s")).select("id", "s.*").collect()
    assert all((r["shard"], r["grown_shard"]) == (jump(r["id"], 1000), jump(r["id"], 1001)) for r in got)


def brute_html(page):
    area = re.search(r"<article>(.*?)</article>", page, re.S)[1]
    parts = (" ".join(html.unescape(re.sub(r"</?b>", "", b.replace("<br>", " "))).split()) for b in re.split(r"</?(?:p|h1)>", area))
    return "\n\n".join(p for p in parts if p)


def test_html_equals_the_article(spark):
    pages = {r["page_id"]: r["html"] for r in spark.read.parquet(f"{FOLDER}/pages.parquet").collect()}
    got = queries.op2_html_text(spark, FOLDER).collect()
    assert len(got) == len(pages) and all(r["text"] == brute_html(pages[r["page_id"]]) and r["n_chars"] == len(r["text"]) for r in got)


def test_html_furniture_templates_and_broken_markup(spark):
    page = '<body><header>Site</header><div class="cookie-notice">OK?</div><main><p>Fixed line</p><p>Text &amp; <i>more</i>\n {}</p><form>f</form><div id="comments"><p>me too</p></div></main><aside>s</aside><script>x="<p>"</script>'
    rows = [(k, f"http://h.example/{k}", page.format(f"of {k}"), "x") for k in range(6)] + [(None, None, None, "x"), (9, "::", "<p>a<p>b<div <", "x"), (10, None, "<div>" * 3000 + "deep", "x")]
    got = {r["page_id"]: r["text"] for r in html_extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string, host string")).collect()}
    assert [got[k] for k in range(6)] == [f"Text & more of {k}" for k in range(6)]
    assert got[None] == "" and got[9].startswith("a\n\nb") and got[10] == "deep"


def test_html_versions_of_an_article_are_no_template(spark):
    shared = "".join(f"<p>Paragraph {k} which both versions of the article share word by word</p>" for k in range(4))
    page = "<body><div><p>Site line</p></div><article><h1>{}</h1>{}</article></body>"
    bodies = [shared + "<p>The first ending</p>", shared + "<p>The second ending</p>", "<p>Something else altogether</p>"]
    # Of hosts with all hashes of urls, some take a version as the reference; and every page of a large host has one line.
    rows = [(10 * h + k, f"http://h{h}.example/{k}", page.format("Title", bodies[k])) for h in range(8) for k in range(3)]
    rows += [(1000 + k, f"http://large.example/{k}", page.format(f"T{k}", f"<p>Written by our staff for all our readers everywhere</p><p>News {k}</p>")) for k in range(30)]
    got = {r["page_id"]: r["text"] for r in html_extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    for h in range(8):
        assert all(got[10 * h + k].count("which both versions") == 4 for k in (0, 1)) and got[10 * h + 2].endswith("Something else altogether")
    assert all(got[1000 + k] == f"T{k}\n\nNews {k}" for k in range(30))


def test_html_long_lists_and_deep_elements(spark):
    # The line stands after as many paragraphs as the page has, between elements that the pages don't share.
    page = lambda k: "<article><h1>T{0}</h1><i class=x{0}></i>{1}<p class=cta>Call us</p>{2}<i class=z{0}></i></article>".format(k, "".join(f"<p>{k} a {n}</p>" for n in range(220 + k)), "".join(f"<p>{k} b {n}</p>" for n in range(9)))
    rows = [(k, f"http://long.example/{k}", page(k)) for k in range(4)]
    rows.append((9, "http://deep.example/", "<div><article><p>First</p>" + "<div>" * 200 + "<nav><b>Menu</b></nav>in<div>ner</div>most" + "</div>" * 200 + "<p>Last</p></article></div>"))
    got = {r["page_id"]: r["text"] for r in html_extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert all("Call us" not in got[k] and got[k].count("\n\n") == 229 + k for k in range(4))
    assert got[9] == "First\n\nin\n\nner\n\nmost\n\nLast"


def unmarked(page, host, k):
    """The page with its article in plain divs, between blocks that every page of the host has and no word or tag gives away."""
    fixed = [f"<div><p>{host} has written for you since 1987 {n}</p></div>" for n in range(3)]
    page = page.replace("<article>", f"{fixed[0]}<div><div>").replace("</article>", f"</div>{fixed[1]}</div>{fixed[2]}")
    # Some pages are of another layout, with blocks of their own.
    return page if k % 3 else page.replace("<body>", "<body><div class=wide><p>All about us</p>").replace("</body>", "</div></body>")


def test_html_result_comes_from_the_induced_wrapper(spark, monkeypatch):
    rows = spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect()
    host = {r["page_id"]: re.sub("^https?://([^/]*).*", r"\1", r["url"]) for r in rows}
    table = spark.createDataFrame([(r["page_id"], r["url"], unmarked(r["html"], host[r["page_id"]], k)) for k, r in enumerate(rows)], "page_id long, url string, html string")
    many = {h for h in host.values() if list(host.values()).count(h) >= 18}
    want = {r["page_id"]: brute_html(r["html"]) for r in rows}
    got = {r["page_id"]: r["text"] for r in html_extract.extract(table).collect()}
    # No page loses article text; hosts with enough pages lose all that is fixed.
    assert all(set(want[k].split("\n\n")) <= set(got[k].split("\n\n")) for k in want)
    held = [k for k in want if host[k] in many]
    assert len(held) >= 25 and sum(got[k] == want[k] for k in held) >= 0.95 * len(held)
    monkeypatch.setattr(html_extract, "LEAST_PAGES", 1 << 30)
    without = {r["page_id"]: r["text"] for r in html_extract.extract(table).collect()}
    assert all("since 1987" in without[k] for k in held)


def test_html_empty_table_and_module_travel(spark):
    from pyspark import cloudpickle

    none = spark.createDataFrame([], "page_id long, url string, html string, layout string")
    assert html_extract.extract(none).count() == 0
    # Functions go by value: a process that cannot import this package reads them.
    sent = cloudpickle.dumps((html_extract.main_text, html_extract.References))
    code = "import sys, pickle; f, r = pickle.load(sys.stdin.buffer); print(f('<p>a</p>', r()('<p>b</p>'), {1}))"
    got = subprocess.run([sys.executable, "-c", code], input=sent, capture_output=True, cwd="/tmp", env={"PATH": os.environ["PATH"]})
    assert got.stdout == b"a\n", got.stderr


def test_html_keywords_and_teasers_keep_the_text():
    kept = '<h2 id="related-work">A</h2><section id="discussion"><p>B</p></section><p class="share-price">C</p><h3 id="legal-history">D</h3><h2 id="search-for-meaning">E</h2><p><math>F</math> <label>G</label></p>'
    gone = '<div class="newsletter-signup">x</div><ul class="menu"><li>x</li></ul><aside>x</aside><article class="comment-body">x</article>'
    assert html_extract.main_text(f"<article>{kept}{gone}</article>") == "A\n\nB\n\nC\n\nD\n\nE\n\nF G"
    story = "The story itself lies in a plain block and is longer than its teasers."
    assert story in html_extract.main_text(f"<main><div><p>{story}</p></div><article>One</article><article>Two</article></main>")
    assert html_extract.main_text(f"<main><p>Aside</p><article>{story}</article></main>") == story


def test_bit_slices_equal_brute_force(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(700, 9)).astype(np.float32)
    x[50:400] = x[7]
    rows = [(k, v.tolist()) for k, v in enumerate(x)] + [(900, None), (1000, [1.0, float("nan")] + [0.0] * 7), (1100, []), (None, x[0].tolist()), (1200, [1e30] * 9), (1300, [1.0, 2.0])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = bitsliced.top_products(table, table.where("vec_id % 100 = 0"), 10).collect()
    good = {k: [int(np.floor(1024.0 * np.float64(np.float32(c)))) for c in v] for k, v in rows if k is not None and v and all(np.isfinite(v))}
    clip = lambda s: max(-(2**63), min(2**63 - 1, s))
    for q in (k for k in good if k % 100 == 0):
        want = sorted(((-sum(a * b for a, b in zip(good[q], v, strict=True)), k) for k, v in good.items() if k != q and len(v) == len(good[q])))[:10]
        want = [(-clip(-s), k) for s, k in want]
        assert [(-r["score"], r["vec_id"]) for r in sorted(got, key=lambda r: r["rank"]) if r["query_id"] == q] == want


def test_bit_slices_of_any_width(spark):
    """Components beyond 24, 52 and 64 bits: ranks follow the exact scores, and scores that no long holds stop at its ends."""
    rng = np.random.default_rng(3)
    rows = [(k, (rng.normal(size=4) * 10.0 ** rng.choice([0, 6, 14, 18, 40, 200])).tolist()) for k in range(300)] + [(400, [1e308] * 4), (500, [-1e308, 1.0, 2.0, 0.5])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    exact = {k: [int(np.floor(1024.0 * c)) if abs(c) < 2.0**52 else int(c) * 1024 for c in v] for k, v in rows}
    got = bitsliced.top_products(table, table.where("vec_id % 100 = 0"), 10).collect()
    for q in (0, 100, 200, 400, 500):
        want = sorted((-sum(a * b for a, b in zip(exact[q], v, strict=True)), k) for k, v in exact.items() if k != q)[:10]
        own = sorted((r for r in got if r["query_id"] == q), key=lambda r: r["rank"])
        assert [(r["vec_id"], r["score"]) for r in own] == [(k, max(-(2**63), min(2**63 - 1, -s))) for s, k in want]
    numbers = sorted([0, 1, -1, 255, 256, -255, -256, 2**63, -(2**63), 2**300, -(2**300)])
    assert sorted(numbers, key=bitsliced.sort_key) == numbers
    none = table.limit(0)
    assert bitsliced.top_products(none, none).count() == 0 and bitsliced.top_products(table, none).count() == 0


def test_additive_quantisation_recall(spark):
    rows = spark.read.parquet(f"{FOLDER}/embeddings.parquet")
    v = {r["vec_id"]: np.array(r["embedding"], float) for r in rows.collect()}
    ids = np.array(sorted(v))
    unit = np.stack([v[k] / np.linalg.norm(v[k]) for k in ids])
    got = queries.op4_additive_quantisation(spark, FOLDER).collect()
    hit = total = 0
    for q in ids[ids % 50 == 0]:
        cos = unit @ unit[np.searchsorted(ids, q)]
        order = [ids[k] for k in np.lexsort((ids, -cos)) if ids[k] != q][:5]
        own = [r for r in got if r["query_id"] == q]
        assert all(abs(cos[np.searchsorted(ids, r["vec_id"])] - r["score"]) < 1e-12 for r in own)
        hit, total = hit + len({r["vec_id"] for r in own} & set(order)), total + 5
    assert hit / total >= 0.9
    odd = spark.createDataFrame([(0, [0.0, 0.0]), (50, [1.0, 0.0]), (51, [2.0, 0.0]), (52, [1.0, 0.0]), (53, None), (54, [float("inf"), 1.0])], "vec_id long, embedding array<float>")
    assert [(r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in additive.nearest(odd, odd.where("vec_id % 50 = 0")).collect()] == [(50, 1, 51, 1.0), (50, 2, 52, 1.0)]
    assert additive.nearest(odd.limit(0), odd.limit(0)).count() == 0


def test_toxicity_finds_held_out_insults(spark, awkward):
    ordinary = ["the ship sails north with the evening tide", "a garden grows slowly under grey skies", "we measured the river twice this week"]
    rude = ["you pathetic idiot", "what a worthless clown you are", "only a moron says so"]
    rows = [(k, f"{ordinary[k % 3]} {k} {ordinary[(k + 1) % 3]}" + (f" {rude[k % 9 // 3]}" if k % 5 == 0 else ""), int(k % 5 == 0)) for k in range(900)]
    d = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    got = {r["doc_id"]: r for r in toxicity.score(d.drop("toxic"), d.select("doc_id", "toxic")).collect()}
    held = [r for r in rows if got[r[0]]["held_out"]]
    assert held and all(got[r[0]]["predicted"] == r[2] for r in held)
    assert all(0 <= r["score"] <= 1 for r in got.values())
    assert toxicity.score(awkward, d.limit(0).select("doc_id", "toxic")).count() == len(AWKWARD)


def test_toxicity_counts_all_labelled_texts(spark, monkeypatch):
    plain = ["tide", "garden", "river", "ship", "evening", "sky"]
    # An insult in 1 of 50 toxic texts, whose words follow on many others; ordinary texts are many.
    text = lambda k: " ".join(plain[(k * p + p) % 6] for p in range(1, 9))
    rows = [(k, text(k) + (f" you {plain[k % 6]} gloomface {plain[k // 50 % 6]} fool" if k % 150 == 0 else " you fool" if k % 3 == 0 else ""), int(k % 3 == 0)) for k in range(3000)]
    d = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    counted = []
    real = toxicity._count_pairs
    monkeypatch.setattr(toxicity, "_count_pairs", lambda r: counted.append(r.count()) or real(r))
    docs, labels = d.drop("toxic"), d.select("doc_id", "toxic")
    got = toxicity.learn(docs, labels, 100)
    learning = toxicity.labelled(docs, labels).count()
    # All but about 30 texts a class for the curve, though a class may give 100.
    assert learning - 120 <= counted[0] < learning
    # Bigrams that are joined give the scores of those that are broadcast.
    near = {r["doc_id"]: r["score"] for r in toxicity.score(docs, model=got).collect()}
    monkeypatch.setattr(toxicity, "MOST_PAIRS", 0)
    far_model = toxicity.learn(docs, labels, 100)
    assert far_model.table is not None and far_model.table.count() == len(got.model.pairs) > 0
    far = {r["doc_id"]: r["score"] for r in toxicity.score(docs, model=far_model).collect()}
    # The same words, bigrams and order of sums: no score differs at all.
    assert near == far


def brute_spans(text):
    found = []
    for m in re.finditer(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text, re.I | re.A):
        found += [(m.start(), 0, f"assign:{m.start()}:{m.end()}")] if len(m[2]) >= 8 else []
    for at, (kind, pattern, least) in enumerate((("access", "AKIA[A-Z0-9]+", 16), ("hex", "[0-9a-f]+", 32)), 1):
        found += [(m.start(), at, f"{kind}:{m.start()}:{m.end()}") for m in re.finditer(pattern, text) if len(m[0]) >= least]
    return ",".join(s for _, _, s in sorted(found))


def test_secrets_equal_brute_force(docs, texts, awkward, nothing):
    for r in secrets.find_secrets(docs).collect():
        assert r["base_sha256"] == hashlib.sha256(brute_spans(texts[r["doc_id"]]).encode()).hexdigest()
    assert secrets.find_secrets(awkward).count() == len(AWKWARD) and secrets.find_secrets(nothing).count() == 0
    for odd in ("password: secret: abcdefghij", "TOKEN='12345678 apikey=short", "AKIA" * 5, "ſecret=abcdefghi tokeN=abcdefgh1", "é" + "0" * 40):
        assert ",".join(f"{k}:{s}:{e}" for s, e, k in secrets.base_spans(odd)) == brute_spans(odd)


def test_structure_confirms_keys():
    def der(tag, body):
        n = len(body)
        return bytes([tag]) + (bytes([n]) if n < 128 else bytes([0x82]) + n.to_bytes(2)) + body

    number = der(2, b"\x01" * 64)
    rsa = der(0x30, der(2, b"\0") + number * 8)
    pkcs8 = der(0x30, der(2, b"\0") + der(0x30, der(6, b"\x2a\x86\x48")) + der(4, rsa))
    for key in (rsa, pkcs8):
        b64 = base64.b64encode(key).decode()
        assert [k for _, _, k in secrets.structural_spans(f"x {b64} y")] == ["der"]
        assert "der" in [k for _, _, k in secrets.structural_spans(f"x {key.hex()} y")]
        assert "pem" in [k for _, _, k in secrets.structural_spans(f"-----BEGIN PRIVATE KEY-----\n{b64}\n-----END PRIVATE KEY-----")]
        assert secrets.structural_spans("x " + base64.b64encode(key[:-1]).decode()) == []
    part = lambda x: base64.urlsafe_b64encode(json.dumps(x).encode()).decode().rstrip("=")
    assert [k for _, _, k in secrets.structural_spans(f"{part({'alg': 'HS256'})}.{part({'sub': 1})}.c2ln")] == ["jwt"]
    assert secrets.structural_spans(f"{part({'typ': 'x'})}.{part({'sub': 1})}.c2ln") == []
    assert secrets.redact("ab secret=12345678 c", [(3, 18, "assign")]) == "ab [assign] c"


def test_language_held_out_accuracy(docs, awkward, nothing):
    lang = {r["doc_id"]: r["lang"] for r in docs.collect()}
    held = [r for r in langid.identify(docs).collect() if r["held_out"]]
    assert sum(r["lang_pred"] == lang[r["doc_id"]] for r in held) >= 0.97 * len(held)
    odd = langid.identify(awkward).collect()
    assert len(odd) == len(AWKWARD) and all(r["lang_pred"] == "und" for r in odd if r["doc_id"] in (1, 2, 3, 6))
    assert langid.identify(nothing).count() == 0


def test_language_scores_equal_brute_force(spark, docs, texts, monkeypatch):
    """Every n-gram of a text counts once, whatever batch or part of a long text it lies in."""
    model = langid.learn(docs)

    def brute(text):
        codes, total = [ord(c) for c in text.lower()], np.zeros(len(model.labels))
        for at in range(len(codes)):
            h = 0
            for n in (1, 2, 3):
                if at + n > len(codes):
                    break
                h = (h + codes[at + n - 1] + 1) * int(langid.SALTS[n - 1]) % (1 << 64)
                h ^= h >> 29
                total += model.table[h * int(langid.SALTS[-1]) % (1 << 64) >> 64 - langid.BUCKET_BITS]
        odds = np.exp(total - total.max())
        return model.labels[int(total.argmax())], odds.max() / odds.sum()

    some = [t for _, t in sorted(texts.items())][:30] + ["x", "ab", "né à 9", None, "", "12 34"]
    monkeypatch.setattr(langid, "CHUNK", 700)
    monkeypatch.setattr(langid, "LANGS_AT_ONCE", 3)
    langs, scores = model.predict(some)
    for text, lang, score in zip(some, langs, scores, strict=True):
        want = brute(text) if text and any(map(str.isalpha, text)) else ("und", 0.0)
        assert lang == want[0] and score == pytest.approx(want[1], abs=1e-6)
    long = np.arange(800_000) % 97
    assert sum(len(b) for w in langid.windows([long]) for b, _ in langid.ngrams(*w)) == 3 * 800_000 - 3


def test_bpe_equals_the_library(spark, docs, texts, awkward, nothing):
    from tokenizers import Tokenizer

    path = queries.tokenizer_path()
    coder = Tokenizer.from_file(path)
    tricky = ["<|startoftext|>Hi<|endoftext|> it's", "ΣΑΣ İstanbul é é   x​y \x1c\x1f 12½", "''s don'T!!!'s", "日本語 emoji 😀👍🏽", None, ""]
    table = docs.select("doc_id", "text").union(spark.createDataFrame([(10_000 + k, t) for k, t in enumerate(tricky)], "doc_id long, text string"))
    want = texts | {10_000 + k: t or "" for k, t in enumerate(tricky)}
    got = bpe.encode_decode(table, path).collect()
    assert len(got) == len(want)
    for r in got:
        ids = coder.encode(want[r["doc_id"]], add_special_tokens=False).ids
        decoded = coder.decode(ids, skip_special_tokens=False)
        assert (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest())
    assert bpe.encode_decode(awkward, path).count() == len(AWKWARD) and bpe.encode_decode(nothing, path).count() == 0


def brute_components(texts):
    sets = {}
    for k, t in texts.items():
        w = words(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets[k] = {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set())
    root = {k: k for k in sets}

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for a in sets:
        for b in sets:
            if a < b and sets[a] and 100 * (both := len(sets[a] & sets[b])) >= 75 * (len(sets[a]) + len(sets[b]) - both):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {k: (len(sets[k]), find(k)) for k in sets}


def test_near_duplicates_equal_brute_force(docs, texts, nothing):
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in neardup.near_duplicates(docs).collect()}
    assert got == brute_components(texts)
    assert neardup.near_duplicates(nothing).count() == 0


@pytest.mark.parametrize("indexed", [neardup.INDEXED, 0])  # hubs as an index, and joined by bucket
def test_near_duplicates_around_a_common_passage(spark, monkeypatch, indexed):
    """Dense buckets of several components: texts that share most of their words, some above and some below the threshold."""
    monkeypatch.setattr(neardup, "INDEXED", indexed)
    rng = np.random.default_rng(5)
    passage = [f"p{n}" for n in range(100)]
    texts = {k: " ".join([*(f"d{n}" for n in rng.integers(0, 10_000, int(rng.integers(8, 40)))), *passage]) for k in range(150)}
    texts |= {150 + k: texts[k] + f" tail{k}" for k in range(30)}
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in neardup.near_duplicates(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()}
    assert got == brute_components(texts)
    assert len({c for _, c in got.values()}) > 10


@pytest.mark.parametrize("most", [neardup.FOREST, 0])  # one last forest, and star steps
def test_components_equal_union_find(spark, most):
    rng = np.random.default_rng(9)
    links = [(k, k + 1) for k in range(100, 160)] + [tuple(map(int, rng.integers(1000, 1300, 2))) for _ in range(150)] + [(7, 7)]
    up = {n: n for link in links for n in link}
    for _ in up:
        for a, b in links:
            up[a] = up[b] = min(up[a], up[b])
    found = neardup.components(spark.createDataFrame(links, "a long, b long").repartition(5), most)
    assert sorted(map(tuple, found.collect())) == sorted((n, r) for n, r in up.items() if n != r)
    assert neardup.components(spark.createDataFrame([], "a long, b long"), most).count() == 0


def test_rarest_parts_of_sets_at_the_threshold_meet():
    rng = np.random.default_rng(6)
    known = np.arange(0, 300, 2, dtype=np.uint64)
    rank = rng.integers(1, 50, len(known))
    for n in range(1, 60):
        whole = np.sort(rng.choice(300, 2 * n, replace=False).astype(np.uint64))
        share = -(-n * neardup.PERCENT // 100)
        a, b = whole[:n], np.sort(np.concatenate([rng.choice(whole[:n], share, replace=False), whole[n : n + n - share]]))
        if 100 * share >= neardup.PERCENT * (2 * n - share):
            assert np.intersect1d(neardup.rarest(a, known, rank), neardup.rarest(b, known, rank)).size
    assert len(neardup.rarest(known, np.empty(0, np.uint64), np.empty(0, np.int64))) == len(known) - 113 + 1


def test_near_duplicates_chains_and_awkward_rows(spark, awkward):
    rng = np.random.default_rng(2)
    base = [f"w{n}" for n in rng.integers(0, 10_000, 120)]
    chain, texts = list(base), {}
    for k in range(60):  # neighbours are similar, ends are not; a hub can't see all of them
        texts[k] = " ".join(chain)
        at = int(rng.integers(0, 118))
        chain[at : at + 2] = [f"x{k}a", f"x{k}b"]
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in neardup.near_duplicates(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()}
    assert got == brute_components(texts)
    odd = neardup.near_duplicates(awkward).collect()
    assert len(odd) == len(AWKWARD)
    named = {r["doc_id"]: r for r in odd}
    assert named[7]["component_id"] == named[8]["component_id"] == 7 and named[None]["component_id"] == 4
    assert {named[k]["component_id"] for k in (1, 2, 3)} == {1, 2, 3}
    kept = neardup.keep_representatives(awkward)
    assert kept.columns == awkward.columns and sorted(r["doc_id"] or 0 for r in kept.collect()) == [1, 2, 3, 4, 5, 6, 7]


CLASHING = "doc_no source_no pieces row key size start n copy place block words uses taken target least k0 k1 k2 k3 k4 text_hash text_hash2 _hash _text _gone _doc_no _pieces _at _part _n sub component_id kept chunk part ids decoded score held_out lang_pred".split()


def test_stages_on_awkward_clashing_and_empty_tables(spark, docs, awkward, nothing):
    import corpus_pipeline

    for table in (awkward, nothing, awkward.limit(0)):
        wide = table.selectExpr("doc_id", "text", "lang", "source", "length(text) as n_chars", *[f"'{c}!' as `{c}`" for c in CLASHING])
        for name, stage in corpus_pipeline.STAGES[:-1]:
            got = stage(spark, wide, FOLDER)
            assert got.columns == wide.columns, name
            rows = got.collect()
            assert all(r[c] == f"{c}!" for r in rows for c in CLASHING) and all(r["n_chars"] == len(r["text"]) for r in rows if r["text"] is not None), name
            assert bool(rows) == bool(table.count()) or name == "language_id"
        assert corpus_pipeline.encode(spark, wide, FOLDER).count() == wide.count()


def test_representatives_of_rows_without_ids(spark):
    a, b = "one two three four five six seven eight", "one  two three four five SIX seven eight"
    rows = [(None, a, 1), (None, a, 2), (None, b, 3), (None, "x", 4), (None, "", 5), (None, "", 5), (3, "y z", 6), (3, "y  z", 7), (4, "y z", 8), (None, "y z", 9)]
    got = neardup.keep_representatives(spark.createDataFrame(rows, "doc_id long, text string, n int")).collect()
    assert sorted(r["doc_id"] or 0 for r in got) == [0, 0, 0, 3] and {" ".join(words(r["text"].lower())) for r in got} == {a, "x", "", "y z"}


def test_pipeline_keeps_its_contract(spark, texts):
    import corpus_pipeline

    names = [k for k, _ in corpus_pipeline.STAGES]
    assert names == ["language_id", "near_dedup", "secret_scan", "mix", "bpe"]
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    known = corpus_pipeline.identify_language(spark, docs, FOLDER)
    assert known.columns == docs.columns and known.count() >= 0.97 * len(texts)
    clean = corpus_pipeline.redact_secrets(spark, docs, FOLDER).collect()
    assert len(clean) == len(texts) and all(brute_spans(r["text"]) == "" and r["n_chars"] == len(r["text"]) for r in clean if brute_spans(texts[r["doc_id"]]))
    out = corpus_pipeline.run(spark, FOLDER)
    assert out.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] and out.count() > 0


def test_hot_buckets_are_ranked_in_parts(spark):
    rows = spark.range(20_000).selectExpr("CASE WHEN id % 3 = 0 THEN 7 ELSE id % 50 END AS bucket", "id AS class_no", "id % 9 AS n").repartition(8, "bucket")
    members = defaultdict(list)
    for r in rows.collect():
        members[r["bucket"]].append(r["class_no"])
    for most in (16, 2000):
        assert sorted(r["class_no"] for r in neardup._ranked(rows, most).collect()) == sorted(c for held in members.values() for c in sorted(held)[:most])


def test_bpe_chunks_hold_little(spark):
    import tracemalloc

    from pyspark.sql import functions as F

    # A worker holds one chunk at a time: about a million words and no text cut.
    text = " ".join(f"w{k % 997}" for k in range(10_000))
    docs = spark.range(0, 250, 1, 1).select(F.col("id").alias("doc_id"), F.lit(text).alias("text"))
    with open(queries.tokenizer_path(), encoding="utf-8") as file:
        sent = spark.sparkContext.broadcast(file.read())
    chunks = bpe._split(docs, sent, 8).select("doc_ids", F.aggregate("sizes", F.lit(0).cast("long"), lambda a, x: a + x).alias("words")).collect()
    assert len(chunks) >= 3 and max(c["words"] for c in chunks) < (1 << 20) + 50_000
    assert sorted(i for c in chunks for i in c["doc_ids"]) == list(range(250))
    # Packing makes nothing of several times the size of its input.
    values = np.random.default_rng(3).integers(0, 1 << 32, 1 << 20).astype(np.uint32)
    tracemalloc.start()
    packed = bpe._pack(values)
    assert tracemalloc.get_traced_memory()[1] < 3.5 * values.nbytes
    tracemalloc.reset_peak()
    assert (bpe._unpack(packed, len(values)) == values).all() and tracemalloc.get_traced_memory()[1] < 4 * values.nbytes
    tracemalloc.stop()
