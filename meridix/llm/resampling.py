"""Importance resampling towards a target distribution of hashed n-grams.

Every text becomes a stream of packed 16-bit feature buckets; streams of many documents lie side by side in blocks, with
the offset of each document, and are written once. Counts come from sorting a block's stream and run-length encoding it;
runs of all blocks are added up by bucket. The gain of each bucket is then looked up along the streams, and
``np.add.reduceat`` sums it document by document. Documents with the highest noisy weight (Gumbel top-k) are drawn.
"""

from __future__ import annotations

import sys
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meridix.llm.common import PLAIN, discard, materialize, ordinal, stretches

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Buckets (65,536 at most), longest run of words that is a feature, least words of a document that can be drawn, percent drawn, seed of the noise.
BUCKETS, LONGEST, LEAST_WORDS, PERCENT, SEED = 10_000, 1, 20, 10, 2024
#: Features and documents of a block, and features whose buckets a task remembers.
BLOCK_FEATURES, BLOCK_DOCS, REMEMBERED = 1 << 20, 10_000, 500_000
BLOCK = "doc_id array<long>, words array<long>, starts array<long>, stream binary"


class _Buckets(dict):
    """Bucket of each feature; forgets all when it has grown too large."""

    def __init__(self, buckets: int):
        super().__init__()
        self.buckets = buckets

    def __missing__(self, feature: bytes) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        self[feature] = out = crc32(feature) % self.buckets
        return out


def streams(rows: DataFrame, longest: int, buckets: int) -> DataFrame:
    """Blocks of packed bucket streams of ``rows`` (doc_id, text): ids, words and first place in the stream of each document, and the stream (little-endian 16-bit)."""
    if not 0 < buckets <= 1 << 16:
        raise ValueError("buckets must fit 16 bits")

    def pack(batches):
        bucket = _Buckets(buckets)
        ids, words, starts, parts, size = [], [], [], [], 0

        def block():
            stream = np.concatenate(parts).tobytes() if parts else b""
            lists = [pa.array([x], pa.list_(pa.int64())) for x in (ids, words, starts)]
            return pa.RecordBatch.from_arrays([*lists, pa.array([stream], pa.binary())], names=["doc_id", "words", "starts", "stream"])

        for batch in batches:
            for doc_id, raw in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                starts.append(size)
                ids.append(doc_id)
                n, last = 0, []
                for part in stretches((raw.as_py() or b"").translate(PLAIN)):
                    found = part.split()
                    n += len(found)
                    # n-grams that reach back into the part before start from its last words.
                    found, lead = last + found, len(last)
                    for k in range(1, longest + 1):
                        first = max(0, lead - k + 1)
                        grams = found[first:] if k == 1 else [b" ".join(found[i : i + k]) for i in range(first, len(found) - k + 1)]
                        parts.append(np.fromiter(map(bucket.__getitem__, grams), np.uint16, len(grams)))
                        size += len(grams)
                    last = found[len(found) - longest + 1 :] if longest > 1 else []
                words.append(n)
                if size >= BLOCK_FEATURES or len(ids) >= BLOCK_DOCS:
                    yield block()
                    ids, words, starts, parts, size = [], [], [], [], 0
        if ids:
            yield block()

    d = rows.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").cast("binary").alias("text"))
    return d.mapInArrow(pack, BLOCK)


def run_lengths(stream: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values of a stream and how often each stands in it: sorted, then run-length encoded."""
    sorted_ = np.sort(stream)
    first = np.flatnonzero(np.concatenate(([True], sorted_[1:] != sorted_[:-1]))) if len(stream) else np.empty(0, np.int64)
    return sorted_[first], np.diff(np.append(first, len(stream)))


def bucket_counts(blocks: DataFrame, buckets: int) -> np.ndarray:
    """Features in each bucket. A task adds its blocks' runs up; at most ``buckets`` sums reach the driver."""

    def count(batches):
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for stream in batch.column(0):
                values, n = run_lengths(np.frombuffer(stream.as_py(), np.uint16))
                total[values] += n
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(total[some])], names=["bucket", "n"])

    out = np.zeros(buckets, np.int64)
    for r in blocks.select("stream").mapInArrow(count, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r["bucket"]] = r["n"]
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandths of the log-ratio of the target's to the source's smoothed share of each bucket, rounded down."""
    s, t, b = source.astype(float), target.astype(float), float(len(source))
    return np.floor(1000 * np.log((t + 1) * (s.sum() + b) / ((s + 1) * (t.sum() + b)))).astype(np.int64)


def weights(blocks: DataFrame, gain: np.ndarray) -> DataFrame:
    """doc_id, n_words, n_features, weight of every document: gains gathered along the streams, summed between offsets."""

    def gather(batches):
        for batch in batches:
            for ids, words, starts, stream in zip(*batch.columns, strict=True):
                at = np.frombuffer(stream.as_py(), np.uint16)
                starts = starts.values.to_numpy()
                sizes = np.diff(np.append(starts, len(at)))
                some, weight = sizes > 0, np.zeros(len(starts), np.int64)
                if some.any():
                    # Documents without features take no places, so the others' offsets still bound each other.
                    weight[some] = np.add.reduceat(gain[at], starts[some])
                yield pa.RecordBatch.from_arrays([ids.values, words.values, pa.array(sizes), pa.array(weight)], names=["doc_id", "n_words", "n_features", "weight"])

    return blocks.mapInArrow(gather, "doc_id long, n_words long, n_features long, weight long")


def noise(doc_id: Column, seed: int) -> Column:
    """Thousandths of a Gumbel variate that the seed and the id decide, rounded down."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("long")


def resample(docs: DataFrame, target: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS, longest: int = LONGEST, buckets: int = BUCKETS, seed: int = SEED) -> DataFrame:
    """Per document: doc_id, n_features, weight, score, and its rank among those drawn (else null).

    ``target`` is any table with a column ``text``. Null texts have no words and weigh 0; a null id counts as an empty text
    in the noise and comes last among ties; ties beyond the id go to fewer features, then to the lower weight, and equal rows
    are interchangeable. An empty table gives no rows; without target texts the gains only reflect the source. Other columns
    are ignored. A text is split in parts, so a long one needs 2 bytes a word beside itself."""
    own = materialize(streams(docs, longest, buckets), "resample-streams")
    wanted = streams(target.select(F.lit(None).cast("long").alias("doc_id"), "text"), longest, buckets)
    gain = gains(bucket_counts(own, buckets), bucket_counts(wanted, buckets))
    found = weights(own, gain).withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed)).withColumn("_row", F.monotonically_increasing_id())
    scored = materialize(found, "resample-scores")
    discard(own)
    can = F.col("n_words") >= least_words
    drawn = scored.where(can).count() * percent // 100
    # Range partitions, sorted, with an offset each: no task ranks all documents. The row's number spreads equal rows.
    ranked = ordinal(scored.where(can), F.desc("score"), F.asc_nulls_last("doc_id"), F.asc("n_features"), F.asc("weight"), F.asc("_row"), name="place")
    columns = ["doc_id", "n_features", "weight", "score"]
    rest = scored.where(~can).select(*columns, F.lit(None).cast("long").alias("rank"))
    return ranked.select(*columns, F.when(F.col("place") < drawn, F.col("place") + 1).alias("rank")).unionByName(rest)


_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_WORDS = rf"regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

#: DuckDB has no CRC-32: its table follows from the polynomial, and each distinct word's bytes run through it.
SQL = rf"""
WITH d AS (SELECT doc_id, {_WORDS} AS words FROM documents),
dw AS (SELECT doc_id, unnest(words) AS w FROM d),
bw AS (SELECT unnest({_WORDS}) AS w FROM benchmark),
steps AS (SELECT list(list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::BIGINT) ELSE c >> 1 END) ORDER BY i) AS crcs FROM (SELECT unnest(range(256)) AS i)),
vocabulary AS (SELECT DISTINCT w, hex(w) AS digits FROM (SELECT w FROM dw UNION ALL SELECT w FROM bw)),
hashed AS (SELECT w, xor(list_reduce([4294967295::BIGINT] || list_transform(range(len(digits) // 2), lambda k: ('0x' || substr(digits, 2 * k + 1, 2))::BIGINT), lambda c, b: xor(crcs[(xor(c, b) & 255) + 1], c >> 8)), 4294967295::BIGINT) % {BUCKETS} AS bucket FROM vocabulary, steps),
places AS (SELECT doc_id, bucket FROM dw JOIN hashed USING (w)),
s AS (SELECT bucket, count(*) AS s FROM places GROUP BY bucket),
t AS (SELECT bucket, count(*) AS t FROM bw JOIN hashed USING (w) GROUP BY bucket),
sums AS (SELECT (SELECT count(*) FROM dw)::DOUBLE AS ss, (SELECT count(*) FROM bw)::DOUBLE AS ts),
gain AS (SELECT s.bucket, floor(1000 * ln((coalesce(t, 0) + 1)::DOUBLE * (ss + {BUCKETS}) / ((s + 1)::DOUBLE * (ts + {BUCKETS}))))::BIGINT AS gain FROM s LEFT JOIN t USING (bucket), sums),
weighed AS (SELECT doc_id, sum(gain)::BIGINT AS weight FROM places JOIN gain USING (bucket) GROUP BY doc_id),
scored AS (SELECT doc_id, len(words)::BIGINT AS n_features, coalesce(weight, 0) AS weight, coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('{SEED}:' || doc_id), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score FROM d LEFT JOIN weighed USING (doc_id)),
placed AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS place, count(*) OVER () AS n FROM scored WHERE n_features >= {LEAST_WORDS})
SELECT doc_id, n_features, weight, score, CASE WHEN place <= n * {PERCENT} // 100 THEN place END AS rank FROM scored LEFT JOIN placed USING (doc_id)
"""
