"""Language identification: multinomial naive Bayes over hashed character n-grams.

Spark counts the n-grams of a bounded, stratified sample of labelled rows; the matrix of log-probabilities (128 KB a
language) is broadcast. Every batch of whole texts is a sparse matrix of texts by n-gram buckets, kept as the buckets of all
n-grams and each text's first one, and numpy multiplies it by the log-probabilities.
"""

from __future__ import annotations

import sys
from collections.abc import Iterable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meridix.llm.common import held_out, learning_share, slices

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Rows a language that learning reads (about; whole texts), hashed n-grams and their lengths, and most languages (a broadcast of 1 GB).
SAMPLE_PER_LANG, BUCKET_BITS, ORDERS, MOST_LANGS = 4000, 15, (1, 2, 3), 8192
#: Characters that are scored at once (a longer text in parts), and languages at once.
CHUNK, LANGS_AT_ONCE = 1 << 18, 64
SALTS = tuple(np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5))


def codes_of(text: str) -> np.ndarray:
    """Code points of the lower-cased text."""
    return np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)


def ngrams(codes: np.ndarray, owner: np.ndarray, lead: int = 0):
    """For each order the buckets of all n-grams within one owner, and their owners; n-grams that end in the first ``lead`` characters are left out."""
    codes = codes.astype(np.uint64)
    h = np.zeros(len(codes) + 1, np.uint64)
    for n in range(1, max(ORDERS) + 1):
        if len(codes) < n:
            return
        h = (h[: len(codes) - n + 1] + codes[n - 1 :] + np.uint64(1)) * SALTS[n - 1]
        h ^= h >> np.uint64(29)
        if n in ORDERS:
            whole = owner[: len(codes) - n + 1] == owner[n - 1 :]
            whole[: max(0, lead - n + 1)] = False
            yield ((h * SALTS[-1]) >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)[whole], owner[: len(codes) - n + 1][whole]


def windows(texts: Iterable[np.ndarray]):
    """(codes, owner, lead) for ``ngrams``: texts side by side up to CHUNK characters; a longer text by itself in parts, each led by the end of the one before, so that every n-gram counts once."""
    held, size = {}, 0

    def out():
        return np.concatenate([*held.values()]), np.repeat(list(held), [len(x) for x in held.values()]), 0

    for k, codes in enumerate(texts):
        if len(codes) > CHUNK:
            for at in range(0, len(codes), CHUNK):
                first = max(0, at - max(ORDERS) + 1)
                part = codes[first : at + CHUNK]
                yield part, np.full(len(part), k), at - first
            continue
        if held and size + len(codes) > CHUNK:
            yield out()
            held, size = {}, 0
        held[k] = codes
        size += len(codes)
    if held:
        yield out()


@dataclass
class LanguageModel:
    """labels: languages in code-point order; table: log-probability of each bucket (rows) in each language (columns)."""

    labels: list[str]
    table: np.ndarray

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        """Language of each text and its posterior; ``und`` and 0 without a letter or without a learned language. Ties go to the first label."""
        some = [k for k, t in enumerate(texts) if self.labels and t and any(map(str.isalpha, t))]
        total = np.zeros((len(some), len(self.labels)))
        for codes, owner, lead in windows(codes_of(texts[k]) for k in some):
            for buckets, of in ngrams(codes, owner, lead):
                if len(of):
                    first = np.flatnonzero(np.concatenate(([True], of[1:] != of[:-1])))
                    for at in range(0, len(self.labels), LANGS_AT_ONCE):
                        own = slice(at, at + LANGS_AT_ONCE)
                        total[of[first], own] += np.add.reduceat(self.table[buckets, own], first, axis=0, dtype=np.float64)
        langs, scores = ["und"] * len(texts), np.zeros(len(texts))
        if some:
            best = total.argmax(axis=1)
            scores[some] = 1 / np.exp(total - total.max(axis=1, keepdims=True)).sum(axis=1)
            for k, b in zip(some, best.tolist(), strict=True):
                langs[k] = self.labels[b]
        return langs, scores


def learn(docs: DataFrame, sample_per_lang: int = SAMPLE_PER_LANG) -> LanguageModel:
    """Learn from rows with text and lang that are not held out: about ``sample_per_lang`` whole texts a language, chosen by a hash of id and text.

    Every language counts as equally likely beforehand (no prior): how often a corpus has it says little of one text."""
    rows = docs.select(F.col("doc_id").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang")).where(~held_out(F.col("doc_id")) & F.col("lang").isNotNull() & F.col("text").isNotNull())
    counts = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).limit(MOST_LANGS + 1).collect()}
    labels = sorted(counts)
    if len(labels) > MOST_LANGS:
        raise ValueError(f"more than {MOST_LANGS} languages")
    if not labels:
        return LanguageModel([], np.empty((1 << BUCKET_BITS, 0), np.float32))
    share = F.element_at(F.create_map(*[F.lit(x) for k, n in counts.items() for x in (k, min(1.0, sample_per_lang / n))]), F.col("lang"))
    # By id and text: rows that share an id, or have none, are chosen one by one.
    sample = rows.where(learning_share(share, F.col("doc_id"), F.col("text")))

    def count(batches):
        held: dict[str, np.ndarray] = {}

        def flush():
            for lang, n in held.items():
                at = np.flatnonzero(n)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at, pa.int32()), pa.array(n[at], pa.int64())], names=["lang", "bucket", "n"])
            held.clear()

        for batch in slices(batches):
            for text, lang in zip(batch.column("text").to_pylist(), batch.column("lang").to_pylist(), strict=True):
                if lang not in held and len(held) >= LANGS_AT_ONCE:
                    yield from flush()
                n = held.setdefault(lang, np.zeros(1 << BUCKET_BITS, np.int64))
                for window in windows([codes_of(text)]):
                    for buckets, _ in ngrams(*window):
                        n += np.bincount(buckets, minlength=1 << BUCKET_BITS)
        yield from flush()

    got = sample.select("text", "lang").mapInArrow(count, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toArrow()
    n = np.zeros((1 << BUCKET_BITS, len(labels)))
    column = {x: k for k, x in enumerate(labels)}
    n[got["bucket"].to_numpy(), [column[x] for x in got["lang"].to_pylist()]] = got["n"].to_numpy()
    return LanguageModel(labels, np.log((n + 0.5) / (n + 0.5).sum(axis=0)).astype(np.float32))


def identify(docs: DataFrame, model: LanguageModel | None = None) -> DataFrame:
    """Per document: doc_id, held_out, lang_pred, score. Learns from ``docs`` unless a model is given.

    Null texts and texts without a letter are ``und`` with score 0, and so is everything if no language could be learned;
    a null id counts as an empty one for the hold-out; equal rows give equal rows; an empty table gives no rows; other
    columns are ignored."""
    shared = docs.sparkSession.sparkContext.broadcast(model or learn(docs))

    def run(batches):
        for batch in slices(batches):
            langs, scores = shared.value.predict(batch.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names=["doc_id", "held_out", "lang_pred", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id")).alias("held_out"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double")


def keep_recognised(docs: DataFrame, least: float, model: LanguageModel | None = None) -> DataFrame:
    """The rows of ``docs`` whose predicted language is not ``und`` and has a posterior of at least ``least``, with their columns as they are.

    Null texts and texts without a letter go, and so does everything if no language could be learned; null ids stay; equal
    rows stay or go together; columns may have any names; an empty table gives no rows."""
    shared = docs.sparkSession.sparkContext.broadcast(model or learn(docs))
    at = docs.columns.index("text")

    def run(batches):
        for batch in slices(batches):
            langs, scores = shared.value.predict(batch.column(at).to_pylist())
            yield batch.filter(pa.array([lang != "und" and score >= least for lang, score in zip(langs, scores, strict=True)], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
