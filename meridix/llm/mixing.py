"""Mixing sources to target weights.

Each source's documents, in one pseudorandom order, form a stream of words that is packed into blocks of fixed length.
Every output shard draws how many of its slots go to each source: a multinomial draw by what the sources' targets still
lack. A source's slots, numbered over all shards, run through a pseudorandom permutation of its block indices, one
permutation a pass, so that a block is used equally often up to one use. Slots and blocks meet in a join on the block index.

No step needs a source's rows in one task: offsets in a stream come from a two-level prefix sum over ``SUBSTREAMS`` parts,
and draws are made first among ``GROUPS`` groups of sources, then in each group by itself.
"""

from __future__ import annotations

import re
import sys
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from meridix.llm.common import WORD, discard, materialize, mix64, ordinal, slices, word_count

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Words in a block (only the last one of a source is shorter), output shards, parts of a stream, groups of sources, most uses of a word.
BLOCK, SHARDS, SUBSTREAMS, GROUPS, CAP = 64, 64, 1024, 1024, 3
#: Rows that one array makes at most.
STRETCH = 1 << 16
SEED = 20


def each(df: DataFrame, n: str, name: str) -> DataFrame:
    """Every row once for each of the numbers 0 to ``n`` - 1 in ``name``, over arrays of bounded size."""
    first = F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"({n} - 1) div {STRETCH}")))
    df = df.where(F.expr(f"{n} > 0")).withColumn("_stretch", first)
    return df.withColumn(name, F.explode(F.expr(f"sequence(_stretch * {STRETCH}, least({n}, (_stretch + 1) * {STRETCH}) - 1)"))).drop("_stretch")


@dataclass
class Mix:
    """sources: a row a source with weight, target, blocks and quota (the slots it should get). slots: (source_no, block, shard, slot, pass). documents: a row a distinct document with its offset in its source's stream and its number n of equal rows."""

    sources: DataFrame
    slots: DataFrame
    documents: DataFrame
    few: bool
    block: int

    def copies(self) -> DataFrame:
        """A row for each row with words: its document's columns, and ``place``, its first word in the stream; source_no and place name it."""
        return each(self.documents, "n", "copy").where("size > 0").withColumn("place", F.col("start") + F.col("copy") * F.col("size"))

    def pieces(self) -> DataFrame:
        """The part of each row that lies in each block: ``at`` is the first word, ``words`` the number."""
        d = self.copies().withColumn("_first", F.expr(f"place div {self.block}")).withColumn("_blocks", F.expr(f"(place + size - 1) div {self.block} - _first + 1"))
        d = each(d, "_blocks", "_no").withColumn("block", F.col("_first") + F.col("_no"))
        first = F.greatest("place", F.col("block") * self.block)
        return d.select("source_no", "place", "block", "doc_id", "size", (first - F.col("place")).alias("at"), (F.least(F.col("place") + F.col("size"), (F.col("block") + 1) * self.block) - first).alias("words"))

    def uses(self) -> DataFrame:
        """Pieces with the number of slots that take their block."""
        uses = self.slots.groupBy("source_no", "block").agg(F.count(F.lit(1)).alias("uses"))
        # Both sides grow with the documents.
        return self.pieces().join(uses.hint("merge"), ["source_no", "block"], "left").withColumn("uses", F.coalesce("uses", F.lit(0)))

    def taken(self) -> DataFrame:
        """Per row of the documents: doc_id, size, source_size, target, taken."""
        some = self.uses().groupBy("source_no", "place").agg(F.first("doc_id").alias("doc_id"), F.first("size").alias("size"), F.sum(F.col("words") * F.col("uses")).alias("taken"))
        none = each(self.documents.where("size = 0"), "n", "_no").select("source_no", "doc_id", "size", F.lit(0).cast("long").alias("taken"))
        src = self.sources.select("source_no", "source_size", "target")
        whole = some.select("source_no", "doc_id", "size", "taken").unionByName(none).join(F.broadcast(src) if self.few else src, "source_no")
        return whole.select("doc_id", "size", "source_size", "target", "taken")


def _stream_key() -> Column:
    return F.xxhash64("doc_id", "text_hash", "text_hash2", F.lit(SEED))


def _text_hashes(text: Column) -> list[Column]:
    """128 bits that stand for the text."""
    return [F.xxhash64(text).alias("text_hash"), F.xxhash64(F.lit(SEED), text).alias("text_hash2")]


def _targets(sources: DataFrame) -> float:
    """The rate a weight: a source's target is the rate times its weight, or CAP times its size if that is less; targets share the sum of all sizes. Every round is one small aggregate."""
    total = sources.agg(F.sum("source_size")).first()[0] or 0
    rate, full = 0.0, -1
    while total:
        over = F.col("source_size") * CAP < F.lit(rate) * F.col("weight")
        got = sources.agg(F.coalesce(F.sum(F.when(over, F.col("source_size") * CAP)), F.lit(0)).alias("capped"), F.coalesce(F.sum(F.when(~over, F.col("weight"))), F.lit(0)).alias("open"), F.count_if(over).alias("full")).first()
        if got["full"] == full or not got["open"]:
            break
        full, rate = got["full"], (total - got["capped"]) / got["open"]
    return rate


def draw(rng: np.random.Generator, n: int, lacking: np.ndarray, room: np.ndarray) -> np.ndarray:
    """A multinomial draw of n slots by what each one lacks; what goes beyond a ``room`` is drawn anew among the others."""
    counts = np.zeros(len(room), np.int64)
    while n > 0 and (counts < room).any():
        weights = np.where(counts < room, np.maximum(lacking, 0.0), 0.0)
        if not weights.sum():
            weights = (room - counts).astype(float)
        got = np.minimum(rng.multinomial(n, weights / weights.sum()), room - counts)
        counts += got
        n -= int(got.sum())
    return counts


def drawn(key: list[int], slots: list[int], quota: np.ndarray, room: np.ndarray) -> np.ndarray:
    """Counts [shard, source]: shard k deals slots[k] by multinomial draws, each with the quotas that the shards before have left."""
    rng, total = np.random.Generator(np.random.Philox(key=key)), np.zeros(len(quota), np.int64)
    out = np.zeros((len(slots), len(quota)), np.int64)
    for k, n in enumerate(slots):
        out[k] = draw(rng, n, quota - total, room - total)
        total += out[k]
    return out


def _deal(sources: DataFrame, shards: int) -> DataFrame:
    """Slots of each source: multinomial counts a shard, then the permuted block of each slot."""
    # Quotas are summed in whole millionths of a slot, so that reruns agree to the last bit.
    units = F.round(F.col("quota") * 1_000_000).cast("long")
    group = (F.col("source_no") % GROUPS).alias("group")
    sums = sorted(sources.groupBy(group).agg(F.sum(units).alias("quota"), F.sum(F.col("blocks") * CAP).alias("room")).collect())
    quota, room = np.array([r["quota"] for r in sums], float) / 1e6, np.array([r["room"] for r in sums], np.int64)
    n = min(round(sum(r["quota"] for r in sums) / 1_000_000), int(room.sum()))
    counts = drawn([SEED, GROUPS], [n // shards + (k < n % shards) for k in range(shards)], quota, room)
    of_group = sources.sparkSession.sparkContext.broadcast({r["group"]: counts[:, k] for k, r in enumerate(sums)})

    def among(group: pa.Table) -> pa.Table:
        group = group.sort_by("source_no")
        no, blocks = (group.column(c).to_numpy() for c in ("source_no", "blocks"))
        own = int(no[0]) % GROUPS
        got = drawn([SEED, own], of_group.value[own].tolist(), group.column("quota").to_numpy(), blocks * CAP)
        shard, at = np.nonzero(got)
        first = (np.cumsum(got, axis=0) - got)[shard, at]
        return pa.table([no[at], blocks[at], shard.astype(np.int64), first, got[shard, at]], names=["source_no", "blocks", "shard", "first", "n"])

    def slots(batches):
        for batch in batches:
            for no, blocks, shard, first, start, n in zip(*(batch.column(c).to_pylist() for c in ("source_no", "blocks", "shard", "first", "start", "n")), strict=True):
                slot = np.arange(start, start + n, dtype=np.int64)
                block = permuted(slot % blocks, slot // blocks, blocks, no)
                same = np.ones(len(slot), np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (same * no, block, same * shard, slot - first, slot // blocks)], names=["source_no", "block", "shard", "slot", "pass"])

    dealt = sources.where("blocks > 0").select("source_no", "blocks", "quota", group).groupBy("group").applyInArrow(among, "source_no long, blocks long, shard long, first long, n long")
    # A hot source's slots are dealt over as many tasks as there are stretches.
    stretches = each(dealt.withColumn("stretches", F.expr(f"(n + {STRETCH - 1}) div {STRETCH}")), "stretches", "no").select("source_no", "blocks", "shard", "first", (F.col("first") + F.col("no") * STRETCH).alias("start"), F.expr(f"least({STRETCH}, n - no * {STRETCH})").alias("n"))
    return stretches.repartition("source_no", "shard", "start").mapInArrow(slots, "source_no long, block long, shard long, slot long, pass long")


def permuted(index: np.ndarray, epoch: np.ndarray, size: int, source: int) -> np.ndarray:
    """A pseudorandom permutation of 0..size-1 for each (source, epoch): four Feistel rounds on the next even number of bits, walked until inside."""
    half = max(1, (int(size - 1).bit_length() + 1) // 2)
    mask = np.uint64((1 << half) - 1)
    key = mix64(epoch.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64((source * 0x632BE59BD9B4E019 + SEED) % (1 << 64)))
    out, open_ = index.astype(np.uint64), np.arange(len(index))
    while len(open_):
        left, right = out[open_] >> np.uint64(half), out[open_] & mask
        for round_ in range(4):
            left, right = right, left ^ (mix64(right + key[open_] * np.uint64(2 * round_ + 3)) & mask)
        out[open_] = left << np.uint64(half) | right
        open_ = open_[out[open_] >= size]
    return out.astype(np.int64)


def mix(docs: DataFrame, shards: int = SHARDS, block: int = BLOCK) -> Mix:
    """Plan a mix of all sources of ``docs``: sources by code point, null last, weigh 1, 2, 3, repeating, and share the sum of all sizes; no target exceeds 3 times its source's size.

    A document's size is its number of words (null text: 0). Documents without words take no part and are taken 0 times.
    Null ids and null sources are values like others; equal rows lie one after another in the stream; a source without
    words has target 0; an empty table gives an empty mix; other columns are ignored. What a source is taken differs from
    its target by about one shard's draw (the last one's) and by half a block."""
    text = F.col("text").cast("string")
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), word_count(text).alias("size"), *_text_hashes(text))
    rows = materialize(d.groupBy(*d.columns).agg(F.count(F.lit(1)).alias("n")).withColumn("sub", F.pmod(_stream_key(), F.lit(SUBSTREAMS)).cast("int")), "mix-rows")
    parts = materialize(rows.groupBy("source", "sub").agg(F.sum(F.col("size") * F.col("n")).alias("words")), "mix-parts")
    sources = ordinal(parts.groupBy("source").agg(F.sum("words").alias("source_size")), F.col("source").asc_nulls_last(), name="source_no")
    sources = materialize(sources.withColumn("weight", F.col("source_no") % 3 + 1), "mix-weights")
    rate = _targets(sources)
    sources = sources.withColumn("target", F.least((F.col("source_size") * CAP).cast("double"), F.lit(rate) * F.col("weight"))).withColumn("blocks", F.expr(f"(source_size + {block - 1}) div {block}"))
    sources = materialize(sources.withColumn("quota", F.when(F.col("source_size") > 0, F.col("target") * F.col("blocks") / F.col("source_size")).otherwise(F.lit(0.0))), "mix-sources")
    few = sources.count() <= 100_000
    # Offsets: of each substream in its source (at most SUBSTREAMS rows a source), then of each document in its substream.
    before = parts.withColumn("base", F.sum("words").over(Window.partitionBy("source").orderBy("sub").rowsBetween(Window.unboundedPreceding, 0)) - F.col("words")).select(F.col("source").alias("_s"), F.col("sub").alias("_b"), "base")
    upto = F.sum(F.col("size") * F.col("n")).over(Window.partitionBy("source", "sub").orderBy(_stream_key(), "doc_id", "text_hash", "text_hash2", "size").rowsBetween(Window.unboundedPreceding, 0))
    placed = rows.withColumn("upto", upto).join(before, F.col("source").eqNullSafe(F.col("_s")) & (F.col("sub") == F.col("_b")))
    numbers = sources.select(F.col("source").alias("_t"), "source_no")
    named = placed.drop("_s").join(F.broadcast(numbers) if few else numbers, F.col("source").eqNullSafe(F.col("_t")))
    start = F.col("base") + F.col("upto") - F.col("size") * F.col("n")
    documents = materialize(named.select("doc_id", "source", "text_hash", "text_hash2", "source_no", "size", "n", start.alias("start")), "mix-documents")
    discard(rows, parts)
    return Mix(sources, _deal(sources, shards), documents, few, block)


def words_between(text: str, wanted: list[tuple[int, int]]) -> list[str]:
    """The text of each (first word, number of words), with the white space inside it as it stands."""
    spans = [m.span() for m in re.finditer(WORD, text)]
    return [text[spans[at][0] : spans[at + n - 1][1]] for at, n in wanted]


def _with_uses(docs: DataFrame, plan: Mix) -> DataFrame:
    """row (the columns of ``docs`` as one struct), source_no and pieces (array<struct<at, words, uses, block, place>>) of each row that slots take.

    Rows that are equal in doc_id, source and text share one row struct: the one with the least hash."""
    used = plan.uses().where("uses > 0").groupBy("source_no", "place").agg(F.collect_list(F.struct("at", "words", "uses", "block", "place")).alias("pieces"))
    keys = ["doc_id", "source", "text_hash", "text_hash2"]
    used = used.join(plan.copies().select("source_no", "place", *keys).hint("merge"), ["source_no", "place"])
    text, plain = F.col("text").cast("string"), [f.name for f in docs.schema if "map<" not in f.dataType.simpleString()]
    ident = [F.col("doc_id").cast("long").alias("k0"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("k1"), F.col("source").isNull().alias("k2"), *(h.alias(k) for h, k in zip(_text_hashes(text), ("k3", "k4"), strict=True))]
    # Own names only: no column of the caller's can clash inside the struct.
    held = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.xxhash64(*[F.col(f"`{c}`") for c in plain]).alias("least"), *ident)
    one = held.groupBy("k0", "k1", "k2", "k3", "k4").agg(F.min_by("row", "least").alias("row"))
    same = F.col("doc_id").eqNullSafe(F.col("k0")) & (F.coalesce("source", F.lit("")) == F.col("k1")) & (F.col("source").isNull() == F.col("k2")) & (F.col("text_hash") == F.col("k3")) & (F.col("text_hash2") == F.col("k4"))
    return used.hint("merge").join(one, same).select("row", "source_no", "pieces")


def mixed_blocks(docs: DataFrame, plan: Mix) -> DataFrame:
    """The mix itself: shard, slot, pass, source_no, block, n_words and text, a row a slot; the words of a block are joined by spaces.

    ``plan`` is a mix of the same ``docs``. Null and empty texts give no words; an empty table gives no rows; other columns are ignored."""

    def cut(batches):
        for batch in slices(batches):
            rows, texts = [], batch.column("row").field("text").to_pylist()
            for text, no, pieces in zip(texts, batch.column("source_no").to_pylist(), batch.column("pieces").to_pylist(), strict=True):
                got = words_between(text, [(p["at"], p["words"]) for p in pieces])
                rows += [(no, p["block"], p["place"], p["at"], p["words"], t) for p, t in zip(pieces, got, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*rows, strict=True)) or [()] * 6, [pa.int64()] * 5 + [pa.string()], strict=True)], names=["source_no", "block", "place", "at", "words", "text"])

    held = docs.select("doc_id", "source", F.col("text").cast("string").alias("text"))
    texts = _with_uses(held, plan).mapInArrow(cut, "source_no long, block long, place long, at long, words long, text string")
    # A block has BLOCK words at most, so its parts are few.
    blocks = texts.groupBy("source_no", "block").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "at", "text"))), lambda p: p["text"]), " ").alias("text"), F.sum("words").alias("n_words"))
    return plan.slots.join(blocks.hint("merge"), ["source_no", "block"]).select("shard", "slot", "pass", "source_no", "block", "n_words", "text")


def mixed_documents(docs: DataFrame, plan: Mix) -> DataFrame:
    """The mix by document, in the columns of ``docs``: a row for each pass that takes some of a row, with the words that the pass takes (``n_chars`` follows the text). Rows that the mix doesn't take drop out.

    ``plan`` is a mix of the same ``docs``. Null and empty texts drop out; null ids and sources stay as they are; of rows
    equal in doc_id, source and text the other columns are those of one of them; columns may have any names; an empty
    table gives no rows."""
    names, kinds = docs.columns, docs.schema

    def cut(batches):
        for batch in slices(batches):
            held = batch.column("row")
            columns = dict(zip(names, held.flatten(), strict=True))
            take, texts = [], []
            for k, (text, pieces) in enumerate(zip(columns["text"].to_pylist(), batch.column("pieces").to_pylist(), strict=True)):
                own = sorted((p["at"], p["words"], p["uses"]) for p in pieces)
                for turn in range(max(u for _, _, u in own)):
                    runs: list[list[int]] = []
                    for at, n, uses in own:
                        if uses > turn:
                            if runs and sum(runs[-1]) == at:
                                runs[-1][1] += n
                            else:
                                runs.append([at, n])
                    take.append(k)
                    texts.append("\n".join(words_between(text, runs)))
            at = pa.array(take, pa.int64())
            out = {c: x.take(at) for c, x in columns.items()}
            out["text"] = pa.array(texts, columns["text"].type)
            if "n_chars" in out:
                out["n_chars"] = pa.array(map(len, texts), columns["n_chars"].type)
            yield pa.RecordBatch.from_arrays(list(out.values()), names=names)

    return _with_uses(docs, plan).mapInArrow(cut, kinds)
