"""The whole pipeline against a chain of plain versions of its stages."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np

from meridix.llm import langid, mixing, queries, secrets

from test_operators import brute_components, words

FOLDER = "/root/testdata/sf0.001"


def grams(text):
    """Buckets of all n-grams of 1 to 3 characters of the lower-cased text, one by one."""
    salts, bits, out = [int(s) for s in langid.SALTS], 64 - langid.BUCKET_BITS, []
    codes = [ord(c) for c in text.lower()]
    for at in range(len(codes)):
        h = 0
        for n, code in enumerate(codes[at : at + 3]):
            h = (h + code + 1) * salts[n] % (1 << 64)
            h ^= h >> 29
            out.append(h * salts[3] % (1 << 64) >> bits)
    return np.array(out, np.int64)


def recognised(rows, least):
    """Naive Bayes, learned and applied row by row."""
    held = lambda r: zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1
    counts = defaultdict(lambda: np.zeros(1 << langid.BUCKET_BITS))
    own = {r["doc_id"]: grams(r["text"]) for r in rows}
    for r in rows:
        if not held(r) and r["lang"] is not None:
            np.add.at(counts[r["lang"]], own[r["doc_id"]], 1)
    labels = sorted(counts)
    table = np.stack([np.log((counts[x] + 0.5) / (counts[x] + 0.5).sum()) for x in labels]).astype(np.float32).astype(float)
    kept = []
    for r in rows:
        if any(map(str.isalpha, r["text"])):
            total = table[:, own[r["doc_id"]]].sum(axis=1)
            odds = np.exp(total - total.max())
            if odds.max() / odds.sum() >= least:
                kept.append(r)
    return kept


def mixed(plan, rows):
    """(doc_id, text) of each pass, from draws, permutations and packing worked out slot by slot; only where a document lies in its source's stream comes from the plan."""
    sources = sorted(plan.sources.collect(), key=lambda r: r["source_no"])
    quota, room = np.array([round(r["quota"] * 1e6) for r in sources]) / 1e6, np.array([3 * r["blocks"] for r in sources])
    n, left, counts = round(quota.sum()), quota.copy(), np.zeros(len(sources), int)
    rng = np.random.Generator(np.random.Philox(key=[mixing.SEED, mixing.GROUPS]))
    for k in range(mixing.SHARDS):
        got = rng.multinomial(n // mixing.SHARDS + (k < n % mixing.SHARDS), np.maximum(left, 0) / np.maximum(left, 0).sum())
        left, counts = left - got, counts + got
    assert (counts <= room).all()
    uses = Counter()
    for r, total in zip(sources, counts, strict=True):
        slot = np.arange(total)
        uses.update((r["source_no"], int(b)) for b in mixing.permuted(slot % r["blocks"], slot // r["blocks"], r["blocks"], r["source_no"]))
    text = {r["doc_id"]: r["text"] for r in rows}
    for r in plan.documents.collect():
        spans = [m.span() for m in re.finditer("[^\x20\x09-\x0d]+", text[r["doc_id"]])]
        times = [uses[r["source_no"], (r["start"] + k) // mixing.BLOCK] for k in range(len(spans))]
        for turn in range(max(times, default=0)):
            runs = []
            for k, t in enumerate(times):
                if t > turn:
                    if runs and runs[-1][1] == k - 1:
                        runs[-1][1] = k
                    else:
                        runs.append([k, k])
            yield r["doc_id"], "\n".join(text[r["doc_id"]][spans[a][0] : spans[b][1]] for a, b in runs)


def test_pipeline_equals_a_chain_of_plain_stages(spark):
    from tokenizers import Tokenizer

    import corpus_pipeline

    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    rows = recognised([r.asDict() for r in docs.collect()], corpus_pipeline.LEAST_CONFIDENCE)
    component = brute_components({r["doc_id"]: r["text"] for r in rows})
    rows = [r for r in rows if component[r["doc_id"]][1] == r["doc_id"]]
    for r in rows:
        r["text"] = secrets.redact(r["text"], secrets.scan(r["text"]))
        r["n_chars"] = len(r["text"])
    assert 100 < len(rows) < docs.count() and sum(len(words(r["text"])) for r in rows) > 10_000
    coder, want = Tokenizer.from_file(queries.tokenizer_path()), Counter()
    for doc_id, text in mixed(mixing.mix(spark.createDataFrame(rows, docs.schema)), rows):
        ids = coder.encode(text, add_special_tokens=False).ids
        want[doc_id, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(coder.decode(ids, skip_special_tokens=False).encode()).hexdigest()] += 1
    assert Counter(map(tuple, corpus_pipeline.run(spark, FOLDER).collect())) == want


def test_mixed_blocks_of_awkward_tables(spark):
    rows = [(1, None, "a"), (2, "", "a"), (3, " \t", None), (4, "one two", "a"), (4, "one two", "a"), (None, "x y z", None), (5, "word " * 3000, "b")]
    table = spark.createDataFrame(rows, "doc_id long, text string, source string").selectExpr("*", "'s' as shard", "1 as slot", "2 as block", "3 as n_words", "4 as place")
    plan = mixing.mix(table)
    blocks = mixing.mixed_blocks(table, plan).collect()
    assert blocks and all(b["n_words"] == len(words(b["text"])) for b in blocks)
    assert sum(b["n_words"] for b in blocks) == sum(r["taken"] for r in plan.taken().collect())
    for none in (table.limit(0), table.where("doc_id < 4")):
        assert mixing.mixed_blocks(none, mixing.mix(none)).count() == 0


def test_texts_go_to_python_in_bounded_batches(spark, tmp_path):
    import corpus_pipeline
    import pyarrow as pa
    from pyspark.sql import functions as F

    docs = spark.range(0, 9000, 1, 1).select(F.col("id").alias("doc_id"), F.repeat(F.lit("word "), 600).alias("text"), F.lit("en").alias("lang"), F.lit("a").alias("source"), F.lit(3000).alias("n_chars"))

    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.nbytes])], names=["size"])

    spark.conf.unset("spark.sql.execution.arrow.maxBytesPerBatch")
    corpus_pipeline.redact_secrets(spark, docs, str(tmp_path))
    assert max(r["size"] for r in docs.mapInArrow(sizes, "size long").collect()) < 2 * corpus_pipeline.BATCH_BYTES
