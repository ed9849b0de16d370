"""Corpus pipeline: language ID, near-dedup, secret scans, mixing to target weights, BPE encoding and decoding.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and reread as the next one's docs.
For every stage: an empty table gives no rows; null ids and sources are values like others; columns beside doc_id, text, lang,
source and n_chars may have any names and stay as they are (the last stage leaves them out); texts of any length are read whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meridix.llm import bpe, langid, mixing, neardup, secrets
from meridix.llm.common import materialize
from meridix.llm.queries import tokenizer_path

#: Least posterior of the predicted language for a document to stay.
LEAST_CONFIDENCE = 0.5

#: Bytes of texts that go to Python at once. Spark's own limit is 10,000 rows: 30 MB of texts here, which the JVM's buffers and Python each hold several times.
BATCH_BYTES = 4 << 20


def _bounded_batches(spark: SparkSession) -> None:
    """What the session sends to Python from now on goes in batches of BATCH_BYTES, or of one row that is longer; rows are the same."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a recognised language stay; null texts, texts without letters and undecided ones go. Equal rows stay or go together; of languages that tie the first by code point is taken."""
    _bounded_batches(spark)
    return langid.keep_recognised(docs, LEAST_CONFIDENCE)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: the one with the smallest doc_id. Of rows that share id and text one stays, also where there is no id; texts without words are near nothing but their own repeats."""
    _bounded_batches(spark)
    return neardup.keep_representatives(docs)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents stay; every secret in a text gives way to its kind in brackets, and n_chars follows the text."""
    _bounded_batches(spark)
    return secrets.redact_documents(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each pass of the mix over a document, with the words that the pass takes. Null texts and texts without words drop out; repeated rows are mixed one by one; reruns agree."""
    _bounded_batches(spark)
    return mixing.mixed_documents(docs, mixing.mix(docs))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of every row's ids and decoded text; a null text counts as an empty one, and equal rows give equal rows."""
    _bounded_batches(spark)
    return bpe.encode_decode(docs, tokenizer_path())


STAGES = [("language_id", identify_language), ("near_dedup", drop_near_copies), ("secret_scan", redact_secrets), ("mix", mix_sources), ("bpe", encode)]

#: Learned models, signatures and digests of subword ids have no SQL form: a test holds the rows of run() to a chain of plain stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole ``documents`` table."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for at, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if at < len(STAGES) - 1:
            docs = materialize(docs, f"stage-{name}")
    return docs
