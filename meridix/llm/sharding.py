"""Sharding by jump consistent hashing, in DataFrame functions only.

The hash follows Lamping and Veach: a 64-bit linear congruential generator, seeded by the key, draws the shard counts at
which the key would move; the last draw below the number of shards is its shard. No ring table exists, and appending one
shard moves only the keys that land in it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from meridix.llm.mixing import each

#: Multiplier of the published generator.
LCG = 2862933555777941757
LOW, HIGH = LCG & 0xFFFFFFFF, LCG >> 32
#: A key needs about ln(shards) draws; this many serve nearly every key, and the rest get as many as there are shards.
FIRST_DRAWS = 24
#: Parts in which a shard's rows are numbered.
PARTS = 1024


def _lit(x: int) -> Column:
    return F.lit(x).cast("long")


def _draw(hi: Column, lo: Column) -> tuple[Column, Column]:
    """key * LCG + 1 modulo 2**64 on unsigned 32-bit halves held in longs, with no step that overflows."""
    m16, m32, low = _lit(0xFFFF), _lit(0xFFFFFFFF), _lit(LOW)
    t0 = lo.bitwiseAND(m16) * low + _lit(1)
    t1 = F.shiftright(lo, 16) * low + F.shiftright(t0, 16)
    new_lo = F.shiftleft(t1.bitwiseAND(m16), 16).bitwiseOR(t0.bitwiseAND(m16))
    new_hi = F.shiftright(t1, 16) + hi.bitwiseAND(m16) * low + F.shiftleft((F.shiftright(hi, 16) * low).bitwiseAND(m16), 16) + lo * _lit(HIGH)
    return new_hi.bitwiseAND(m32), new_lo


def _draws(key: Column, shards: int, most: int) -> Column:
    """struct(before, shard, next, hi, lo) after at most ``most`` draws; ``next`` >= shards when the walk has ended."""
    start = F.struct(_lit(-1).alias("before"), _lit(-1).alias("shard"), _lit(0).alias("next"), F.shiftrightunsigned(key, 32).alias("hi"), key.bitwiseAND(_lit(0xFFFFFFFF)).alias("lo"))

    def step(s: Column, _: Column) -> Column:
        hi, lo = _draw(s["hi"], s["lo"])
        jump = F.floor((s["next"] + 1).cast("double") * (F.lit(float(1 << 31)) / (F.shiftright(hi, 1) + 1).cast("double"))).cast("long")
        return F.when(s["next"] < shards, F.struct(s["shard"].alias("before"), s["next"].alias("shard"), jump.alias("next"), hi.alias("hi"), lo.alias("lo"))).otherwise(s)

    return F.aggregate(F.sequence(F.lit(1), F.lit(most)), start, step)


def jump_shards(key: Column, shards: int) -> Column:
    """struct(shard, grown_shard): the key's shard among ``shards``, and among one more. Null keys count as -1."""
    key = F.coalesce(key.cast("long"), _lit(-1))
    first = _draws(key, shards + 1, min(FIRST_DRAWS, shards + 1))
    walk = first if shards + 1 <= FIRST_DRAWS else F.when(first["next"] > shards, first).otherwise(_draws(key, shards + 1, shards + 1))
    return F.transform(F.array(walk), lambda w: F.struct(F.when(w["shard"] == shards, w["before"]).otherwise(w["shard"]).cast("int").alias("shard"), w["shard"].cast("int").alias("grown_shard")))[0]


def shard_documents(docs: DataFrame, shards: int = 16) -> DataFrame:
    """Shard of each document by its ``doc_id`` alone, with a gapless slot within the shard.

    Nulls: a null id is the key -1; a null text has no bytes and the CRC of an empty text. Equal rows are counted before
    the shuffle and get neighbouring slots, so a row that repeats a billion times is one row in the numbering, and its slots
    come out of arrays of bounded size. Within a shard, rows are numbered in PARTS parts by a hash of id, size and CRC:
    different texts of one id, or of none, spread over all of them. An empty table gives no rows; other columns are ignored."""
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    slim = d.select("doc_id", (F.octet_length("text") + 1).cast("long").alias("size"), F.crc32(F.col("text").cast("binary")).alias("text_crc32"))
    rows = slim.groupBy("doc_id", "size", "text_crc32").agg(F.count(F.lit(1)).alias("n"))
    rows = rows.withColumns({"_at": jump_shards(F.col("doc_id"), shards), "_sub": F.pmod(F.xxhash64("doc_id", "size", "text_crc32"), F.lit(PARTS))}).select("doc_id", "size", "text_crc32", "n", "_at.shard", "_at.grown_shard", "_sub")
    # Two-level numbering: few counts for each (shard, sub), then a running sum within each.
    counts = rows.groupBy("shard", "_sub").agg(F.sum("n").alias("_n"))
    before = counts.withColumn("_before", F.sum("_n").over(Window.partitionBy("shard").orderBy("_sub").rowsBetween(Window.unboundedPreceding, -1))).select("shard", "_sub", F.coalesce("_before", F.lit(0)).alias("_before"))
    running = Window.partitionBy("shard", "_sub").orderBy("doc_id", "text_crc32", "size").rowsBetween(Window.unboundedPreceding, 0)
    # At most PARTS rows a shard: broadcast while that is small, else a shuffled join on the same keys.
    before = F.broadcast(before) if shards * PARTS <= 1 << 20 else before
    numbered = rows.withColumn("_upto", F.sum("n").over(running)).join(before, ["shard", "_sub"])
    numbered = each(numbered.withColumn("_first", F.col("_before") + F.col("_upto") - F.col("n")), "n", "_copy")
    return numbered.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", (F.col("_first") + F.col("_copy")).alias("slot"), "grown_shard")
