"""What several operators of this subpackage share: scratch tables, ordered numbering, hashing of words."""

from __future__ import annotations

import sys
import tempfile
import uuid

import numpy as np
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Functions travel to the workers by value: executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

WORD = "[^\\x20\\x09-\\x0D]+"


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder that the cluster names; a temporary one only in a local session that names none (tests)."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        named = tempfile.mkdtemp(prefix="meridix-")
        spark.sparkContext.setCheckpointDir(named)
    return named.rstrip("/")


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` once to the shared scratch folder and read it back: lineage ends there, and any executor can read it.

    The files go when the driver's JVM ends; ``discard`` removes them sooner."""
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(where)
    back = spark.read.schema(df.schema).parquet(path)
    back._scratch_path = path
    return back


def discard(*tables: DataFrame) -> None:
    """Remove materialized tables that no later plan reads."""
    for df in tables:
        spark = df.sparkSession
        where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(df._scratch_path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def small(df: DataFrame, rows: int, max_rows: int = 1_000_000) -> DataFrame:
    """``df`` with a broadcast hint if its counted rows are few and narrow; else as it is, for a shuffled join."""
    return F.broadcast(df) if rows <= max_rows else df


def slices(batches, rows: int = 1000):
    """The batches in parts of at most ``rows`` rows, so that what Python makes of a part's texts stays small."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def word_count(text: Column) -> Column:
    """Number of runs of characters other than ASCII white space; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def ordinal(df: DataFrame, *order: Column, name: str) -> DataFrame:
    """Number the rows from 0 in the given order without bringing them to one task.

    Range-partition and sort, write that, then add each partition's offset; only one count a partition reaches the driver."""
    spark = df.sparkSession
    part = F.spark_partition_id()
    dealt = df.repartitionByRange(*order).sortWithinPartitions(*order)
    dealt = materialize(dealt.withColumns({"_part": part, "_at": F.monotonically_increasing_id() - F.shiftleft(part.cast("long"), 33)}), "ordinal")
    offsets, total = [], 0
    for part_no, n in sorted((r["_part"], r["n"]) for r in dealt.groupBy("_part").agg(F.count(F.lit(1)).alias("n")).collect()):
        offsets.append((part_no, total))
        total += n
    at = spark.createDataFrame(offsets or [(0, 0)], "_part int, _offset long")
    return dealt.join(F.broadcast(at), "_part").withColumn(name, F.col("_at") + F.col("_offset")).drop("_part", "_at", "_offset")


def held_out(doc_id: Column) -> Column:
    """Rows kept from learning: crc32 of the id as text, modulo 3, is 1 (a null id counts as empty text)."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 3 == 1


def learning_share(share: Column, *keys: Column) -> Column:
    """True for about ``share`` of the keys, the same ones in every run."""
    return F.pmod(F.xxhash64(*keys, F.lit("learn")), F.lit(1 << 30)) < share * float(1 << 30)


MIX_A, MIX_B, GOLDEN = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)


def mix64(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = (x ^ (x >> np.uint64(30))) * MIX_A
    x = (x ^ (x >> np.uint64(27))) * MIX_B
    return x ^ (x >> np.uint64(31))


def _byte_table() -> np.ndarray:
    return mix64(np.arange(1, 257, dtype=np.uint64) * GOLDEN)


_POWERS: list[np.ndarray] = []


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the (odd, hence invertible) polynomial base modulo 2**64, and of its inverse."""
    if not _POWERS or len(_POWERS[0]) <= n:
        size = max(1 << 14, 1 << (n + 1).bit_length())
        base = 0xD6E8FEB86659FD93
        for b in (base, pow(base, -1, 1 << 64)):
            out = np.empty(size, np.uint64)
            out[0], filled, step = 1, 1, b
            while filled < size:
                more = min(filled, size - filled)
                out[filled : filled + more] = out[:more] * np.uint64(pow(b, filled, 1 << 64))
                filled += more
            _POWERS.append(out)
        _POWERS[:] = _POWERS[-2:]
    return _POWERS[0], _POWERS[1]


#: Bytes of a text that are hashed at once (about 44 times as many are held meanwhile).
HASHED_AT_ONCE = 1 << 20


def one_space(words: bytes) -> bytes:
    """Words with one space between them, white space runs gone. Long texts become no list of words: runs of spaces halve instead."""
    if len(words) <= HASHED_AT_ONCE:
        return b" ".join(words.split())
    words = words.translate(bytes(32 if c in b"\t\n\v\f\r" else c for c in range(256)))
    while b"  " in words:
        words = words.replace(b"  ", b" ")
    return words.strip(b" ")


def span_hashes(joined: bytes, width: int) -> np.ndarray:
    """64-bit hashes of every run of ``width`` words of ``joined``, words separated by one space each, in order.

    With fewer words than ``width`` the whole sequence is one span, and without words there is none. A long text is hashed in
    parts; each takes the words that its last spans need from the next one."""
    if len(joined) <= HASHED_AT_ONCE:
        return _span_hashes(joined, width)
    out, at = [], 0
    while at < len(joined):
        end = stop = joined.find(b" ", at + HASHED_AT_ONCE)
        for _ in range(width - 1):
            stop = joined.find(b" ", stop + 1) if stop >= 0 else -1
        part = joined[at:] if stop < 0 else joined[at:stop]
        if not at or part.count(b" ") >= width - 1:
            out.append(_span_hashes(part, width))
        # Beyond ``end`` stand the words of the next part; without a place to stop, this part had all spans.
        at = len(joined) if stop < 0 else end + 1
    return np.concatenate(out)


def _span_hashes(joined: bytes, width: int) -> np.ndarray:
    """A polynomial hash over randomised bytes, so that one prefix sum serves all spans."""
    if not joined:
        return np.empty(0, np.uint64)
    raw = np.frombuffer(joined, np.uint8)
    up, down = _powers(len(raw))
    prefix = np.empty(len(raw) + 1, np.uint64)
    prefix[0] = 0
    np.cumsum(_byte_table()[raw] * up[: len(raw)], out=prefix[1:])
    gaps = np.flatnonzero(raw == 32)
    starts, ends = np.concatenate(([0], gaps + 1)), np.concatenate((gaps, [len(raw)]))
    if len(starts) < width:
        starts, ends = starts[:1], ends[-1:]
    else:
        starts, ends = starts[: len(starts) - width + 1], ends[width - 1 :]
    return mix64((prefix[ends] - prefix[starts]) * down[starts] ^ (ends - starts).astype(np.uint64) * GOLDEN)


#: Bytes of words of letters and digits, A-Z in lower case, all beyond ASCII kept; every other byte becomes a space.
PLAIN = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def stretches(raw: bytes, size: int = 1 << 20):
    """``raw`` in parts of about ``size`` bytes, cut before a space: no word is cut, and a long text never becomes one list of words."""
    at = 0
    while at < len(raw):
        end = raw.find(b" ", at + size)
        end = len(raw) if end < 0 else end
        yield raw[at:end]
        at = end
