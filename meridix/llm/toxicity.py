"""Toxicity by class-conditional Kneser-Ney language models.

Two bigram models, of toxic and of ordinary labelled texts, share their lowest order: continuation counts pooled over both
classes smooth what one class has rarely seen. A text's score follows from the length-normalised difference of the two
log-likelihoods, over the whole text and over its most suspicious window, through a logistic curve fitted on a bounded
sample that the models haven't counted. All other labelled texts are counted, in Spark; every distinct word and bigram has
its own entry. Both tables are broadcast while they are small; beyond that, blocks of texts meet the entries of their own
words and bigrams by shuffle, and a block is scored with a model of those alone.
"""

from __future__ import annotations

import sys
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meridix.llm.common import GOLDEN, held_out, learning_share, materialize, mix64, one_space, slices, small, span_hashes

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: The curve learns from about CURVE_SHARE of a class, CURVE_SHARE * SAMPLE_PER_CLASS texts at most (whole texts, chosen by a hash of the id); all others are counted.
SAMPLE_PER_CLASS, CURVE_SHARE = 6000, 0.3
#: Words of a window, and most words (32 bytes each) and bigrams (12 bytes each) that are broadcast; more are joined, by block.
WINDOW, MOST_WORDS, MOST_PAIRS = 24, 4_000_000, 8_000_000
#: Words and texts of a block, and words of a text whose log-ratios are held at once.
BLOCK_WORDS, BLOCK_TEXTS, PART = 200_000, 1000, 1 << 20
#: Words that a task holds at once while it counts.
AT_ONCE = 300_000
#: Discounts of both orders (of words by kinds of context, of bigrams by sightings): all of a count of one or two, and two of a larger one, pass to the back-off. What a word's log-ratio must exceed to count as suspicious.
DISCOUNT, SUSPICIOUS = 2.0, 1.0
THRESHOLD = 0.7
START = np.uint64(0xA5A5A5A5A5A5A5A5)
LETTERS = bytes(c if chr(c).isalpha() and c < 128 or c >= 128 else 32 for c in range(256))


def words_of(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words (runs of letters, lower case) and of the bigrams that end in them."""
    w = span_hashes(one_space((text or "").lower().encode("utf-8", "surrogatepass").translate(LETTERS)), 1)
    before = np.concatenate(([START], w[:-1])) if len(w) else w
    return w, before


def pair_hash(before: np.ndarray, w: np.ndarray) -> np.ndarray:
    return mix64(before * GOLDEN ^ w)


class Index:
    """Positions in sorted keys that are spread evenly, by their leading bits: a look-up reads one or two places, where a binary search would read one a level."""

    def __init__(self, keys: np.ndarray):
        bits = max(1, len(keys).bit_length() + 1)
        self.keys, self.shift = np.append(keys, np.uint64(0)), np.uint64(64 - bits)
        self.starts = np.zeros((1 << bits) + 1, np.int32)
        np.cumsum(np.bincount((keys >> self.shift).astype(np.int64), minlength=1 << bits), out=self.starts[1:])

    def __call__(self, h: np.ndarray) -> np.ndarray:
        """Positions of the hashes; the number of keys where one is missing."""
        slot = (h >> self.shift).astype(np.int64)
        at, end = self.starts[slot].astype(np.int64), self.starts[slot + 1]
        out = np.full(len(h), len(self.keys) - 1)
        open_ = np.flatnonzero(at < end)
        while len(open_):
            hit = self.keys[at[open_]] == h[open_]
            out[open_[hit]] = at[open_[hit]]
            open_ = open_[~hit]
            at[open_] += 1
            open_ = open_[at[open_] < end[open_]]
        return out


@dataclass
class ToxicityModel:
    """Per class (0 ordinary, 1 toxic) and word, in the order of ``words`` with an entry for unknown ones at the end: its sightings as a context, their back-off mass, its lower-order probability.

    ``pairs`` are bigrams and ``gains`` what a bigram's own counts add to its log-ratio."""

    words: np.ndarray
    totals: np.ndarray
    mass: np.ndarray
    lower: np.ndarray
    pairs: np.ndarray | None = None
    gains: np.ndarray | None = None
    curve: tuple = (-2.0, 0.0, 0.0, 2.0, 2.0)

    def index(self, name: str) -> Index:
        """Built where it is used, once a process."""
        held = self.__dict__.setdefault("_indexes", {})
        keys = getattr(self, name)
        if name not in held or held[name][0] is not keys:
            held[name] = (keys, Index(keys))
        return held[name][1]

    @property
    def padded(self) -> np.ndarray:
        """Gains, with nothing for bigrams that have no entry."""
        held = self.__dict__.setdefault("_indexes", {})
        if "gains" not in held or held["gains"][0] is not self.gains:
            held["gains"] = (self.gains, np.append(self.gains, np.float32(0)))
        return held["gains"][1]

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k != "_indexes"}

    def ratio(self, ctx: np.ndarray, at: np.ndarray, n: tuple) -> np.ndarray:
        """The toxic less the ordinary log-probability of words after contexts, given the bigrams' discounted counts."""
        logs = []
        for c in (0, 1):
            total, low = self.totals[c][ctx], self.lower[c][at]
            seen = total > 0
            logs.append(np.log(np.minimum(np.where(seen, (n[c] + self.mass[c][ctx] * low) / np.where(seen, total, 1), low), 1.0)))
        return logs[1] - logs[0]

    def ratios(self, before: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Per word the log-ratio by the bigram models and by their lower order alone. ``before`` are the words before ``w`` in one text."""
        find = self.index("words")
        at = find(w)
        ctx = np.concatenate((find(before[:1]), at[:-1]))
        full = self.ratio(ctx, at, (0.0, 0.0))
        if self.pairs is not None and len(self.pairs):
            full = full + self.padded[self.index("pairs")(pair_hash(before, w))]
        return full, np.log(self.lower[1][at]) - np.log(self.lower[0][at])

    def features(self, text: str | None) -> tuple[float, float, float, float]:
        """The mean bigram ratio of the text, then by the lower order, whose counts of contexts copies don't raise: the mean, the largest mean over WINDOW words, and the mean excess over SUSPICIOUS. A text shorter than a window counts as padded to one; a long one is worked through in parts."""
        w, before = words_of(text)
        n, full_sum, low_sum, excess, window, last = len(w), 0.0, 0.0, 0.0, None, np.empty(0)
        for at in range(0, n, PART):
            full, low = (x.astype(np.float64) for x in self.ratios(before[at : at + PART], w[at : at + PART]))
            full_sum, low_sum, excess = full_sum + full.sum(), low_sum + low.sum(), excess + np.maximum(low - SUSPICIOUS, 0).sum()
            last = np.concatenate((last, low))
            if len(last) >= WINDOW:
                sums = np.concatenate(([0.0], np.cumsum(last)))
                most = (sums[WINDOW:] - sums[:-WINDOW]).max()
                window = most if window is None else max(window, most)
                last = last[len(last) - WINDOW + 1 :]
        if not n:
            return 0.0, 0.0, 0.0, 0.0
        return full_sum / max(n, WINDOW), low_sum / max(n, WINDOW), (low_sum if window is None else window) / WINDOW, excess / max(n, WINDOW) * 10


def fit_curve(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Logistic regression by Newton's method with a small penalty, classes weighted as they are."""
    w = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -60, 60)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(len(w)), x.T @ (y - p) - 1e-3 * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


def labelled(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, text, toxic of the rows to learn from: not held out, with a text and a label (the larger, if labels of an id differ)."""
    marks = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where("doc_id is not null and toxic in (0, 1)").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where(~held_out(F.col("doc_id")) & F.col("text").isNotNull())
    return rows.join(small(marks, labels.count()), "doc_id")


def _count_pairs(rows: DataFrame) -> DataFrame:
    """v, w, n0, n1: how often each bigram stands in the texts of each class."""

    def counted(label, got):
        w, v = np.concatenate([g[0] for g in got]), np.concatenate([g[1] for g in got])
        _, at, n = np.unique(pair_hash(v, w), return_index=True, return_counts=True)
        n0, n1 = (pa.array(n.astype(np.int64) * (label == c)) for c in (0, 1))
        return pa.RecordBatch.from_arrays([pa.array(v[at].view(np.int64)), pa.array(w[at].view(np.int64)), n0, n1], names=["v", "w", "n0", "n1"])

    def count(batches):
        got, size = ([], []), [0, 0]
        for batch in batches:
            for text, label in zip(batch.column("text"), batch.column("toxic").to_pylist(), strict=True):
                got[label].append(words_of(text.as_py()))
                size[label] += len(got[label][-1][0])
                if size[label] >= AT_ONCE:
                    yield counted(label, got[label])
                    got[label].clear()
                    size[label] = 0
        yield from (counted(label, got[label]) for label in (0, 1) if got[label])

    return rows.mapInArrow(count, "v long, w long, n0 long, n1 long").groupBy("v", "w").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))


def _by_key(rows, key: str, *columns: str) -> tuple[np.ndarray, ...]:
    """A key column (hashes) in the order of unsigned numbers, and other columns in that order, as doubles; nothing for no rows. ``rows`` is a table, or a list of a struct's columns in the same order."""
    if rows is None:
        return NO_HASHES, *(np.empty(0) for _ in columns)
    names = (key, *columns)
    got = {c: np.asarray(rows[c] if isinstance(rows, pa.Table) else rows[k]) for k, c in enumerate(names)}
    h = got[key].astype(np.int64).view(np.uint64)
    order = np.argsort(h)
    return h[order], *(got[c].astype(np.float64)[order] for c in columns)


COLUMNS = ("t0", "t1", "m0", "m1", "k0", "k1")
NO_HASHES = np.empty(0, np.uint64)


def _word_counts(pairs: DataFrame) -> tuple[DataFrame, dict]:
    """(h, *COLUMNS): per class a word's sightings as a context, their back-off mass and the kinds of context before it; and the sums of the whole vocabulary.

    Words whose counts the discounts use up equal unknown ones in every ratio, so the table leaves them out."""
    zero, held = F.lit(0.0), lambda k, most: F.least(F.col(k).cast("double"), F.lit(most))
    ends = pairs.select(F.col("w").alias("h"), *[zero.alias(k) for k in ("t0", "t1", "m0", "m1")], *[(F.col(f"n{c}") > 0).cast("double").alias(f"k{c}") for c in (0, 1)], F.greatest("n0", "n1").alias("most"))
    starts = pairs.select(F.col("v").alias("h"), *[F.col(f"n{c}").cast("double").alias(f"t{c}") for c in (0, 1)], *[held(f"n{c}", DISCOUNT).alias(f"m{c}") for c in (0, 1)], zero.alias("k0"), zero.alias("k1"), F.lit(0).alias("most"))
    table = materialize(starts.union(ends).groupBy("h").agg(*[F.sum(k).alias(k) for k in COLUMNS], F.max("most").alias("most")), "toxic-words")
    shared = F.col("k0") + F.col("k1")
    sums = table.agg(F.count(F.lit(1)).alias("words"), F.sum((shared > 0).cast("double")).alias("kinds"), F.sum(shared).alias("shared"), *[F.sum(k).alias(k) for k in ("k0", "k1")], *[F.sum(held(f"k{c}", DISCOUNT)).alias(f"f{c}") for c in (0, 1)]).first().asDict()
    return table.where(f"k0 > {DISCOUNT} or k1 > {DISCOUNT} or t0 > m0 or t1 > m1 or most > {DISCOUNT}").select("h", *COLUMNS), {k: x or 0 for k, x in sums.items()}


def _model(words: np.ndarray, columns, sums: dict) -> ToxicityModel:
    """The model of some words (sorted hashes, their COLUMNS), with an entry for all others at the end."""
    t0, t1, m0, m1, k0, k1 = (np.append(x, 0.0) for x in columns)
    # The lowest order: continuation counts of both classes together, with a little for words that neither has.
    base = (np.maximum(k0 + k1 - 0.75, 0) + 0.75 * max(1.0, sums["kinds"]) / (sums["words"] + 1)) / max(1.0, sums["shared"])
    # Both classes give the same part to it, else the smaller one, which knows fewer words, would claim every rare word.
    back = (sums["f0"] + sums["f1"]) / max(1.0, sums["k0"] + sums["k1"])
    lower = []
    for k, name in ((k0, "0"), (k1, "1")):
        kept = sums["k" + name] - sums["f" + name]
        lower.append((1 - back) * np.maximum(k - DISCOUNT, 0) / kept + back * base if kept > 0 else base)
    return ToxicityModel(words, *(np.stack(x).astype(np.float32) for x in ((t0, t1), (m0, m1), lower)))


def _gains(pairs: DataFrame, words: DataFrame, sums: dict, held) -> DataFrame:
    """h, gain: what the counts of a bigram add to its log-ratio, where they add anything. Its words' counts come from ``held``, a broadcast model, or else by joins."""
    if held is None:
        before = words.select(F.col("h").alias("v"), *[F.col(c).alias(f"v_{c}") for c in COLUMNS])
        pairs = pairs.join(before, "v", "left").join(words.withColumnRenamed("h", "w"), "w", "left").na.fill(0.0)

    def gain(batches):
        for batch in batches:
            v, w = (batch.column(c).to_numpy().view(np.uint64) for c in ("v", "w"))
            n = tuple(np.maximum(batch.column(f"n{c}").to_numpy() - DISCOUNT, 0).astype(np.float32) for c in (0, 1))
            if held is None:
                # A model of the batch alone: first the words before, then the words, one entry each.
                m = _model(NO_HASHES, [np.concatenate((batch.column(f"v_{c}").to_numpy(), batch.column(c).to_numpy())) for c in COLUMNS], sums)
                ctx = np.arange(len(v))
                at = ctx + len(v)
            else:
                m = held.value
                ctx, at = m.index("words")(v), m.index("words")(w)
            more = (m.ratio(ctx, at, n) - m.ratio(ctx, at, (0.0, 0.0))).astype(np.float32)
            some = more != 0
            yield pa.RecordBatch.from_arrays([pa.array(pair_hash(v, w)[some].view(np.int64)), pa.array(more[some])], names=["h", "gain"])

    return pairs.mapInArrow(gain, "h long, gain float")


@dataclass
class Learned:
    """A model; where words or bigrams are too many for it, it has the curve only, ``words`` (h, *COLUMNS) and ``table`` (h, gain) have the rest, and ``sums`` what all models share."""

    model: ToxicityModel
    table: DataFrame | None = None
    words: DataFrame | None = None
    sums: dict | None = None


FEATURES = ("full", "mean", "window", "excess")


def _measured(model: ToxicityModel, ids, marks, texts, kind) -> pa.RecordBatch:
    x = [model.features(t) for t in texts]
    return pa.RecordBatch.from_arrays([ids, marks, *(pa.array([r[c] for r in x], pa.float64()) for c in range(4))], names=["doc_id", "mark", *FEATURES])


def measured(rows: DataFrame, got: Learned) -> DataFrame:
    """``rows`` (doc_id, text and a column ``mark``) with the features of the text in place of it: doc_id, mark, full, mean, window, excess."""
    kind = dict(rows.dtypes)["mark"]
    schema = f"doc_id long, mark {kind}, " + ", ".join(f"{f} double" for f in FEATURES)
    rows = rows.select("doc_id", "mark", "text")
    if got.table is not None:
        return _measured_by_block(rows, got, schema, kind)
    held = rows.sparkSession.sparkContext.broadcast(got.model)

    def look(batches):
        for batch in slices(batches):
            yield _measured(held.value, batch.column(0), batch.column(1), (t.as_py() for t in batch.column(2)), kind)

    return rows.mapInArrow(look, schema)


def _measured_by_block(rows: DataFrame, got: Learned, schema: str, kind: str) -> DataFrame:
    """Blocks of texts, each with the distinct hashes of its words and bigrams; these meet their entries by shuffle (a block asks once for a word, however often it has it), and the entries come back to the block."""
    sums = got.sums

    def pack(batches):
        ids, marks, texts, words, pairs, size, block = [], [], [], [], [], 0, 0

        def out():
            asked = [np.unique(np.concatenate(x)).view(np.int64) if x else np.empty(0, np.int64) for x in (words, pairs)]
            number = pa.array([part << 32 | block], pa.int64())
            lists = [pa.array([x], pa.list_(t)) for x, t in ((ids, pa.int64()), (marks, mark), (texts, pa.string()), *((a, pa.int64()) for a in asked))]
            return pa.RecordBatch.from_arrays([number, *lists], names=["block", "ids", "marks", "texts", "words", "pairs"])

        part, mark = 0, None
        for batch in batches:
            mark = batch.column(1).type
            for doc_id, own, text, part in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), batch.column(3).to_pylist(), strict=True):
                w, before = words_of(text.as_py())
                ids.append(doc_id)
                marks.append(own)
                texts.append(text.as_py())
                words += [np.unique(w)]
                pairs += [np.unique(pair_hash(before, w))]
                size += len(w)
                if size >= BLOCK_WORDS or len(ids) >= BLOCK_TEXTS:
                    yield out()
                    ids, marks, texts, words, pairs, size, block = [], [], [], [], [], 0, block + 1
        if ids:
            yield out()

    packed = f"block long, ids array<long>, marks array<{kind}>, texts array<string>, words array<long>, pairs array<long>"
    blocks = materialize(rows.withColumn("part", F.spark_partition_id().cast("long")).mapInArrow(pack, packed), "toxic-blocks")
    start = int(START.view(np.int64))
    # The start of a text is a context, too.
    asked = F.array_union("words", F.array(F.lit(start)))
    words = blocks.select("block", F.explode(asked).alias("h")).join(got.words, "h").groupBy("block").agg(F.array_sort(F.collect_list(F.struct("h", *COLUMNS))).alias("known"))
    pairs = blocks.select("block", F.explode("pairs").alias("h")).join(got.table, "h").groupBy("block").agg(F.collect_list(F.struct("h", "gain")).alias("gains"))

    def look(batches):
        for batch in batches:
            for ids, marks, texts, known, gains in zip(*batch.columns, strict=True):
                known, gains = (x.values if x.is_valid else None for x in (known, gains))
                h, *columns = _by_key(known.flatten() if known is not None else None, "h", *COLUMNS)
                model = _model(h, columns, sums)
                model.pairs, gain = _by_key(gains.flatten() if gains is not None else None, "h", "gain")
                model.gains = gain.astype(np.float32)
                yield _measured(model, ids.values, marks.values, texts.values.to_pylist(), kind)

    return blocks.select("block", "ids", "marks", "texts").join(words, "block", "left").join(pairs, "block", "left").select("ids", "marks", "texts", "known", "gains").mapInArrow(look, schema)


def learn(docs: DataFrame, labels: DataFrame, sample_per_class: int = SAMPLE_PER_CLASS) -> Learned:
    """Learn from all labelled rows that are not held out: the curve from about ``CURVE_SHARE * sample_per_class`` whole texts a class at most, the counts from all others."""
    rows = labelled(docs, labels)
    counts = {r["toxic"]: r["n"] for r in rows.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    wanted = CURVE_SHARE * min(sample_per_class, *(counts.get(c, 0) for c in (0, 1)))
    share = F.when(F.col("toxic") == 1, wanted / max(1, counts.get(1, 0))).otherwise(wanted / max(1, counts.get(0, 0)))
    for_curve = learning_share(share, F.col("doc_id"))
    counted = rows.where(~for_curve) if len(counts) == 2 else rows.limit(0)
    pairs = materialize(_count_pairs(counted.select("text", "toxic")), "toxic-pairs")
    words, sums = _word_counts(pairs)
    # Bigrams up to the discount gain nothing.
    strong = pairs.where(f"n0 > {DISCOUNT} or n1 > {DISCOUNT}")
    if words.count() <= MOST_WORDS and strong.count() <= MOST_PAIRS:
        h, *columns = _by_key(words.toArrow(), "h", *COLUMNS)
        made = Learned(_model(h, columns, sums))
        made.model.pairs, gain = _by_key(_gains(strong, words, sums, docs.sparkSession.sparkContext.broadcast(made.model)).toArrow(), "h", "gain")
        made.model.gains = gain.astype(np.float32)
    else:
        made = Learned(_model(NO_HASHES, [np.empty(0)] * 6, sums), materialize(_gains(strong, words, sums, None), "toxic-gains"), words, sums)
    sample = materialize(rows.where(for_curve).select("doc_id", "text", F.col("toxic").alias("mark")), "toxic-sample")
    seen = measured(sample, made).drop("doc_id").toArrow().sort_by([(c, "ascending") for c in ("mark", *FEATURES)])
    y = np.asarray(seen["mark"])
    if 4 <= y.sum() <= len(y) - 4:
        x = np.stack([np.ones(len(y)), *(np.asarray(seen[c]) for c in FEATURES)], axis=1)
        curve = fit_curve(x, y)
        # The curve saw both classes equally often; scores are for texts as they come.
        curve[0] += np.log(counts[1] / counts[0])
        made.model.curve = tuple(float(c) for c in curve)
    return made


def score(docs: DataFrame, labels: DataFrame | None = None, model: Learned | None = None) -> DataFrame:
    """Per document: doc_id, held_out, score, predicted (1 from THRESHOLD up). Learns from ``docs`` and ``labels`` unless a model is given.

    Null and empty texts get the score of a text without evidence. Without labels of both classes the curve is a fixed one.
    A null id counts as an empty one for the hold-out; equal rows give equal rows; of labels that differ the larger counts;
    an empty table gives no rows, and one without labels learns nothing; long texts are hashed and scored in parts; other
    columns are ignored."""
    got = model or learn(docs, labels)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id")).alias("mark"), F.col("text").cast("string").alias("text"))
    first, *rest = got.model.curve
    logit = sum((F.col(c) * k for c, k in zip(FEATURES, rest, strict=True)), F.lit(first))
    found = measured(rows, got).select("doc_id", F.col("mark").alias("held_out"), (1 / (1 + F.exp(-F.greatest(F.least(logit, F.lit(60.0)), F.lit(-60.0))))).alias("score"))
    return found.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))
