"""Collocations by level-wise phrase counting with hashed buckets (PCY, DHP).

Pass k over the texts counts the phrases of k words that can still be frequent, exactly, and throws the phrases of k + 1
words into hash buckets. A phrase of k + 1 words is counted in the next pass only if its bucket reached the least count
(the bucket bitmap of Park, Chen and Yu) and both its parts of k words did (Apriori, as a bitmap of the frequent phrases'
hashes). Bitmaps have a fixed size whatever the corpus, so they are what is broadcast; false hits only cost an exact
count. Phrases, their parts and their scores are then joined and ranked in DataFrames.
"""

from __future__ import annotations

import sys
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from meridix.llm.common import GOLDEN, discard, materialize, mix64, small, stretches

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Least count of a phrase, most words, percent of a phrase's count from which a longer one around it replaces it, phrases a language.
LEAST, LONGEST, PERCENT, TOP = 100, 5, 100, 2000
#: Buckets are 2**BUCKET_BITS; a bitmap of them takes 2**BUCKET_BITS / 8 bytes (512 KB), in SEGMENTS parts.
BUCKET_BITS, SEGMENTS = 22, 64
#: Words of a block, and words and phrases that a task holds at once.
BLOCK_WORDS, HELD_WORDS, HELD_PHRASES = 400_000, 500_000, 400_000
#: Bytes that end a piece become a full stop, white space within one a space, A-Z go to lower case.
ENDS = b".,;:!?\x0a\x0b\x0c\x0d"
PIECES = bytes(46 if c in ENDS else 32 if c in b" \t" else c + 32 if 65 <= c <= 90 else c for c in range(256))
COUNTED = "lang string, phrase binary, n long, segment int, counts binary"


class Words:
    """Numbers and hashes of words; number 0 is the end of a piece."""

    def __init__(self):
        self.clear()

    def clear(self) -> None:
        self.number: dict[bytes, int] = {b".": 0}
        self.words: list[bytes] = [b"."]
        self.hashes = np.zeros(1 << 12, np.uint64)

    def __call__(self, tokens: list[bytes]) -> np.ndarray:
        for w in set(tokens).difference(self.number):
            k = self.number[w] = len(self.words)
            self.words.append(w)
            if k >= len(self.hashes):
                self.hashes = np.concatenate((self.hashes, np.zeros_like(self.hashes)))
            self.hashes[k] = word_hash(w)
        return np.fromiter(map(self.number.__getitem__, tokens), np.int64, len(tokens))


def word_hash(word: bytes) -> int:
    return int.from_bytes(blake2b(word, digest_size=8).digest(), "little")


def extended(h: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Hashes of phrases from those of their parts without the last word, and the last words' hashes."""
    return mix64(h * GOLDEN + w)


def buckets_of(h: np.ndarray, bits: int) -> np.ndarray:
    return (h >> np.uint64(64 - bits)).astype(np.int64)


class Bitmap:
    """A bit a bucket."""

    def __init__(self, bits: int, packed: np.ndarray):
        self.bits, self.packed = bits, packed

    def __call__(self, h: np.ndarray) -> np.ndarray:
        at = buckets_of(h, self.bits)
        return (self.packed[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)


class Level:
    """One pass: counts phrases of ``k`` words and buckets of phrases of k + 1 words, block by block."""

    def __init__(self, k: int, bits: int, least: int, buckets: Bitmap | None, parts: Bitmap | None, last: bool):
        self.k, self.bits, self.least, self.buckets, self.parts, self.last = k, bits, least, buckets, parts, last
        self.words, self.held = Words(), {}
        # Sums stop at ``least``, so that a byte a bucket is enough for the usual ones.
        self.kind = np.uint8 if least <= 255 else np.uint32
        self.thrown = None if last else np.zeros(1 << bits, np.uint32)

    def add(self, lang: str, tokens: list[bytes], lead: int) -> None:
        """Count the phrases that end behind the first ``lead`` tokens."""
        if len(self.words.words) > HELD_WORDS:
            self.words.clear()
        ids = self.words(tokens)
        w = self.words.hashes[ids]
        inside, h, k = ids > 0, np.full(len(ids), word_hash(lang.encode()), np.uint64), self.k
        kept, before = inside, None
        for size in range(1, k + 2 - self.last):
            places = len(ids) - size + 1
            if places <= 0:
                break
            part = h[:places]
            h, whole = extended(part, w[size - 1 :]), inside[:places] & (ids[size - 1 :] > 0)
            inside = whole
            if size == k:
                kept = whole
                if k > 1:
                    kept = whole & self.buckets(h) & self.parts(before[:-1]) & self.parts(before[1:])
                self._count(lang, ids, kept.copy(), lead)
            elif size == k + 1:
                # Only pairs of phrases that this pass counts can be frequent together.
                thrown = whole & kept[:-1] & kept[1:]
                thrown[: max(0, lead - size + 1)] = False
                self.thrown += np.bincount(buckets_of(h[thrown], self.bits), minlength=1 << self.bits).astype(np.uint32)
                np.minimum(self.thrown, self.least, out=self.thrown)
            before = h

    def _count(self, lang: str, ids: np.ndarray, kept: np.ndarray, lead: int) -> None:
        kept[: max(0, lead - self.k + 1)] = False
        at = np.flatnonzero(kept)
        if not len(at):
            return
        # Numbers of phrases grow word by word: no hash decides which phrases are equal.
        number = ids[at]
        for j in range(1, self.k):
            _, number = np.unique(number, return_inverse=True)
            number = number * len(self.words.words) + ids[at + j]
        _, first, n = np.unique(number, return_index=True, return_counts=True)
        words = self.words.words
        for p, c in zip(at[first].tolist(), n.tolist(), strict=True):
            key = (lang, b" ".join([words[i] for i in ids[p : p + self.k].tolist()]) if self.k > 1 else words[ids[p]])
            self.held[key] = self.held.get(key, 0) + c

    def phrases(self) -> pa.RecordBatch:
        lang, phrase = zip(*self.held, strict=True) if self.held else ((), ())
        n = pa.array(list(self.held.values()), pa.int64())
        self.held = {}
        return pa.RecordBatch.from_arrays([pa.array(lang, pa.string()), pa.array(phrase, pa.binary()), n, pa.nulls(len(n), pa.int32()), pa.nulls(len(n), pa.binary())], names=["lang", "phrase", "n", "segment", "counts"])

    def bucket_counts(self) -> pa.RecordBatch:
        return segments(self.thrown.astype(self.kind))


def segments(counts: np.ndarray) -> pa.RecordBatch:
    """A row for each part of the buckets that has any."""
    found = [(k, part) for k, part in enumerate(np.split(counts, SEGMENTS)) if part.any()]
    none = pa.nulls(len(found), pa.string()), pa.nulls(len(found), pa.binary()), pa.nulls(len(found), pa.int64())
    return pa.RecordBatch.from_arrays([*none, pa.array([k for k, _ in found], pa.int32()), pa.array([p.tobytes() for _, p in found], pa.binary())], names=["lang", "phrase", "n", "segment", "counts"])


def tokens_of(raw: bytes, size: int = 1 << 21):
    """The words of a text in parts, piece ends as full stops."""
    for part in stretches(raw.translate(PIECES), size):
        yield part.replace(b".", b" . ").split()


def _pass(docs: DataFrame, level) -> DataFrame:
    """COUNTED rows of one pass: phrases with their counts, words a language (no phrase), and bucket counts in segments."""

    def count(batches):
        own = level()
        k = own.k
        blocks: dict[str, list[bytes]] = {}
        total: dict[str, int] = {}
        waiting = 0

        def flush(lang, lead=0):
            own.add(lang, blocks.pop(lang), lead)

        for batch in batches:
            for lang, raw in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                lead, before = 0, len(blocks.get(lang, ()))
                for tokens in tokens_of(raw.as_py() or b""):
                    total[lang] = total.get(lang, 0) + len(tokens) - tokens.count(b".")
                    block = blocks.setdefault(lang, [])
                    block += tokens
                    if len(block) >= BLOCK_WORDS:
                        # The text may go on: what its next part needs of this one's end leads the next block.
                        tail = block[-k:]
                        flush(lang, lead)
                        blocks[lang], lead = tail, len(tail)
                if lead:
                    flush(lang, lead)
                elif blocks.get(lang):
                    blocks[lang].append(b".")
                waiting += len(blocks.get(lang, ())) - before
                if waiting >= 2 * BLOCK_WORDS:
                    for x in list(blocks):
                        flush(x)
                    waiting = 0
                if len(own.held) >= HELD_PHRASES:
                    yield own.phrases()
        for x in list(blocks):
            flush(x)
        yield own.phrases()
        if not own.last:
            yield own.bucket_counts()
        if k == 1:
            none = [pa.nulls(len(total), t) for t in (pa.binary(), pa.int32(), pa.binary())]
            yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), none[0], pa.array(list(total.values()), pa.int64()), none[1], none[2]], names=["lang", "phrase", "n", "segment", "counts"])

    return docs.mapInArrow(count, COUNTED)


def bitmap(rows: DataFrame, bits: int, least: int) -> Bitmap:
    """A bit for each bucket whose counts (``segment``, ``counts``) reach ``least``. Segments are dealt over tasks, which add them up one row at a time; 2**bits bits reach the driver."""
    kind = np.uint8 if least <= 255 else np.uint32

    def merge(batches):
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, raw in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                counts = np.frombuffer(raw.as_py(), kind).astype(np.uint32)
                sums[k] = np.minimum(sums[k] + counts, least) if k in sums else counts
        for k, counts in sums.items():
            bits_ = np.packbits(counts >= least, bitorder="little").tobytes()
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([bits_], pa.binary())], names=["segment", "bits"])

    packed = np.zeros((1 << bits) // 8, np.uint8).reshape(SEGMENTS, -1)
    for r in rows.select("segment", "counts").repartition("segment").mapInArrow(merge, "segment int, bits binary").collect():
        packed[r["segment"]] = np.frombuffer(r["bits"], np.uint8)
    return Bitmap(bits, packed.reshape(-1))


def phrase_bitmap(found: DataFrame, bits: int) -> Bitmap:
    """The bits of the hashes of frequent phrases (lang, phrase)."""

    def throw(batches):
        seen = np.zeros(1 << bits, np.uint8)
        for batch in batches:
            for lang, phrase in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                h = np.array([word_hash(lang.encode())], np.uint64)
                for w in phrase.encode().split(b" "):
                    h = extended(h, np.array([word_hash(w)], np.uint64))
                seen[buckets_of(h, bits)] = 1
        yield segments(seen)

    return bitmap(found.select("lang", "phrase").mapInArrow(throw, COUNTED), bits, 1)


def frequent_phrases(docs: DataFrame, least: int = LEAST, longest: int = LONGEST, bits: int = BUCKET_BITS) -> tuple[DataFrame, DataFrame]:
    """(lang, phrase, words, f) of all phrases of 1 to ``longest`` words with f >= ``least``, and (lang, n): all words."""
    d = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.col("text").cast("string").cast("binary").alias("text"))
    context = docs.sparkSession.sparkContext
    buckets, parts, levels, totals = None, None, [], None
    for k in range(1, longest + 1):
        shared = context.broadcast((buckets, parts))
        last = k == longest
        counted = materialize(_pass(d, lambda k=k, shared=shared, last=last: Level(k, bits, least, *shared.value, last)), f"phrases-{k}")
        if k == 1:
            totals = materialize(counted.where("segment is null and phrase is null").groupBy("lang").agg(F.sum("n").alias("n")), "phrase-words")
        sums = counted.where("phrase is not null").groupBy("lang", "phrase").agg(F.sum("n").alias("f")).where(F.col("f") >= least)
        levels.append(materialize(sums.select("lang", F.col("phrase").cast("string").alias("phrase"), F.lit(k).alias("words"), "f"), f"frequent-{k}"))
        if not last:
            buckets, parts = bitmap(counted.where("segment is not null"), bits, least), phrase_bitmap(levels[-1], bits)
        discard(counted)
    found = levels[0]
    for more in levels[1:]:
        found = found.union(more)
    return found, totals


def _part(first, last):
    """Words ``first`` to ``last`` (from 1) of the column ``w``, as a phrase."""
    return F.array_join(F.slice("w", first, last - first + 1), " ")


def collocations(docs: DataFrame, least: int = LEAST, longest: int = LONGEST, percent: int = PERCENT, top: int = TOP, bits: int = BUCKET_BITS) -> DataFrame:
    """Each language's ``top`` phrases of 2 to ``longest`` words: lang, rank, phrase, a, l, r, n, score.

    Null texts have no words, a null language is ``und``; repeated rows count each; ties go to the larger count, then to the
    smaller phrase in byte order; an empty table gives no rows; ids and other columns are ignored. Long texts are counted in
    parts that overlap, so no phrase is lost or counted twice."""
    found, totals = frequent_phrases(docs, least, longest, bits)
    w = F.split("phrase", " ")
    candidates = found.where("words > 1").withColumn("w", w)
    # Every part of a frequent phrase is frequent. Single words are parts of many phrases, so their rows are dealt in 16.
    cuts = candidates.select("lang", "phrase", "words", F.col("f").alias("a"), "w", F.explode(F.sequence(F.lit(1), F.col("words") - 1)).alias("k"))
    spread = lambda size: F.when(size == 1, F.pmod(F.xxhash64("phrase"), F.lit(16))).otherwise(0)
    cuts = cuts.select("lang", "phrase", "words", "a", "k", _part(F.lit(1), F.col("k")).alias("left"), _part(F.col("k") + 1, F.col("words")).alias("right"))
    cuts = cuts.withColumns({"left_at": spread(F.col("k")), "right_at": spread(F.col("words") - F.col("k"))})
    copies = F.explode(F.when(F.col("words") == 1, F.sequence(F.lit(0), F.lit(15))).otherwise(F.array(F.lit(0))).cast("array<long>"))
    part = found.where(F.col("words") < longest).select("lang", "phrase", "f", copies.alias("at"))
    left = part.select("lang", F.col("phrase").alias("left"), F.col("at").alias("left_at"), F.col("f").alias("l"))
    right = part.select("lang", F.col("phrase").alias("right"), F.col("at").alias("right_at"), F.col("f").alias("r"))
    scored = cuts.join(left, ["lang", "left", "left_at"]).join(right, ["lang", "right", "right_at"]).join(small(totals, totals.count()), "lang")
    exact = lambda *names: [F.col(c).cast("decimal(18,0)") for c in names]
    a, n, l, r = exact("a", "n", "l", "r")
    scored = scored.withColumns({"over": (a * n).cast("decimal(34,0)") * F.lit(1000).cast("decimal(4,0)"), "under": l * r}).withColumn("score", F.expr("over div under"))
    best = scored.groupBy("lang", "phrase").agg(F.min(F.struct("score", "k", "l", "r", "a", "n")).alias("cut"))
    # A longer phrase that replaces a candidate has one that is longer by a word and does so too: its first or last words.
    inner = candidates.where("words > 2").select("lang", "f", F.explode(F.array(_part(F.lit(1), F.col("words") - 1), _part(F.lit(2), F.col("words")))).alias("phrase"))
    around = inner.groupBy("lang", "phrase").agg(F.max("f").alias("around"))
    kept = best.join(around, ["lang", "phrase"], "left").where(F.col("around").isNull() | (F.col("around") * 100 < F.col("cut.a") * percent))
    order = Window.partitionBy("lang").orderBy(F.desc("cut.score"), F.desc("cut.a"), F.asc("phrase"))
    ranked = kept.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return ranked.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "cut.a", "cut.l", "cut.r", "cut.n", "cut.score")


SQL = rf"""
WITH pieces AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
words AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces),
totals AS (SELECT lang, sum(len(w)) AS n FROM words GROUP BY lang),
places AS (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM words),
sized AS (SELECT lang, w, i, unnest([1, 2, 3, 4, 5]) AS m FROM places),
f AS (SELECT lang, m, array_to_string(w[i : i + m - 1], ' ') AS phrase, count(*) AS f FROM sized WHERE i + m - 1 <= len(w) GROUP BY ALL HAVING count(*) >= {LEAST}),
c AS (SELECT lang, m, phrase, f AS a, string_split(phrase, ' ') AS w FROM f WHERE m > 1),
cuts AS (SELECT lang, phrase, a, k, array_to_string(w[1 : k], ' ') AS p, array_to_string(w[k + 1 : m], ' ') AS q FROM (SELECT *, unnest(range(1, m)) AS k FROM c)),
scored AS (SELECT c.lang, c.phrase, a, k, l.f AS l, r.f AS r, n, (1000::HUGEINT * a * n) // (l.f::HUGEINT * r.f) AS score FROM cuts c JOIN f l ON l.lang = c.lang AND l.phrase = p JOIN f r ON r.lang = c.lang AND r.phrase = q JOIN totals t ON t.lang = c.lang),
best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
inner_ AS (SELECT lang, array_to_string(w[s : s + z - 1], ' ') AS phrase, max(a) AS around FROM (SELECT lang, w, m, a, z, unnest(range(1, m - z + 2)) AS s FROM (SELECT *, unnest(range(2, m)) AS z FROM c)) GROUP BY ALL)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n::BIGINT AS n, score::BIGINT AS score
FROM best LEFT JOIN inner_ USING (lang, phrase) WHERE around IS NULL OR around * 100 < a * {PERCENT} QUALIFY rank <= {TOP}
"""
