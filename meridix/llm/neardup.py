"""Near-duplicate groups: SuperMinHash signatures, banding, verification on full shingle sets, connected components.

Equal word sequences are one class from the start. The members of a bucket of the banding are compared with one hub, and
links merge classes into components. In buckets of up to ``FEW`` members that still hold several components, members of
different ones are compared as they are. Larger ones mostly gather texts around a common passage; their classes are dealt
anew by the rarest shingles of their sets, at least one of which every two sets at the threshold share. Of those outside
their bucket's largest component, ``HUBS`` a bucket are held against the others, then all that are left if their sets are
small enough for an index, or else eight times as many each round, until no bucket holds an untested pair of classes from
two components. Such an index of a round's hubs goes to all tasks, and a task counts each member's shared shingles with all
hubs in one pass; hubs too large for it are joined with the members by bucket. So nothing is capped, and no bucket of more
than ``FEW`` members emits all its pairs.
"""

from __future__ import annotations

import hashlib
import sys

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from meridix.llm.common import GOLDEN, discard, materialize, mix64, one_space, slices, small, span_hashes

cloudpickle.register_pickle_by_value(sys.modules[__name__])

WIDTH, PERCENT = 5, 75
#: A pair at the threshold shares none of 36 bands of 4 ranks with probability (1 - 0.75**4) ** 36, about 1e-6.
BANDS, ROWS = 36, 4
HUBS, GROWTH = 16, 8
#: Members of a bucket that are compared with each other as they are.
FEW = HUBS + 1
#: Parts of a bucket whose members are ranked apart.
PARTS = 64
#: Shingles that an index of hubs holds at most (24 bytes each in every task); more hubs are joined instead.
INDEXED = 2_000_000
#: Links that one task joins into a forest at a time.
FOREST = 500_000
#: Shingles in more classes than ``FEW`` are put last, the most frequent ``RANKED`` of them by frequency; this order,
#: whatever it is, decides the speed and never the links.
RANKED = 500_000
#: Shingles that one signature batch holds at most (a longer text is a batch of its own).
BATCH = 400_000


def normal_words(text: str | None) -> bytes:
    """The words of a text, A-Z lower-cased, with one space between them; bytes.split cuts at ASCII white space only."""
    return one_space((text or "").encode("utf-8", "surrogatepass").lower())


def shingle_set(joined: bytes, width: int = WIDTH) -> np.ndarray:
    """Sorted distinct hashes of the shingles of ``width`` words."""
    return np.unique(span_hashes(joined, width))


def super_min_hash(elements: np.ndarray, owner: np.ndarray, sets: int, m: int) -> np.ndarray:
    """SuperMinHash signatures (sets x m) of many sets at once; ``owner`` names the set of each element.

    Step j gives each element of a set the rank j + r in the j-th place of its own pseudorandom permutation of the m
    components. A set is done, and its elements drop out, when no component can still fall: all are below the next step.
    Values hold j in the upper 8 bits and r in the lower 24. Permutations are kept as the few swaps made so far."""
    h = np.full(sets * m, 0xFFFFFFFF, np.uint32)
    swaps: list[tuple[np.ndarray, np.ndarray]] = []
    open_sets = np.arange(sets)
    for j in range(m):
        x = mix64(elements + np.uint64((j + 1) * int(GOLDEN) % (1 << 64)))
        k = (j + (((x & np.uint64(0xFFFFFFFF)) * np.uint64(m - j)) >> np.uint64(32)).astype(np.int16)).astype(np.int16)
        at_k, at_j = k.copy(), np.full(len(k), j, np.int16)
        for where, value in swaps:
            hit = where == k
            at_k[hit] = value[hit]
            hit = where == j
            at_j[hit] = value[hit]
        swaps.append((k, at_j))
        np.minimum.at(h, owner * m + at_k, (x >> np.uint64(40)).astype(np.uint32) | np.uint32(j << 24))
        open_sets = open_sets[h.reshape(sets, m)[open_sets].max(axis=1) >= np.uint32(min((j + 1) << 24, 0xFFFFFFFF))]
        if not len(open_sets):
            break
        stays = np.zeros(sets, bool)
        stays[open_sets] = True
        stays = stays[owner]
        if stays.sum() < 0.8 * len(stays):
            elements, owner = elements[stays], owner[stays]
            swaps = [(a[stays], b[stays]) for a, b in swaps]
    return h.reshape(sets, m)


def band_keys(signatures: np.ndarray, bands: int = BANDS, rows: int = ROWS) -> np.ndarray:
    """A 64-bit bucket for each band of each signature."""
    out = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64) * GOLDEN, (len(signatures), bands)).copy()
    parts = signatures.reshape(len(signatures), bands, rows).astype(np.uint64)
    for r in range(rows):
        out = mix64(out ^ parts[:, :, r])
    return out.view(np.int64)


def _profiles(docs: DataFrame) -> DataFrame:
    """doc_id, text_hash, key (of the word sequence; null without words), n_shingles, bands."""
    schema = "doc_id long, text_hash long, key binary, n_shingles long, bands array<long>"

    def run(batches):
        for batch in batches:
            ids, hashes = batch.column("doc_id").to_pylist(), batch.column("text_hash").to_pylist()
            todo: list[tuple] = []
            held: dict[bytes, np.ndarray] = {}
            size = 0

            def out(todo, held):
                sets = list(held.values())
                place = {k: i for i, k in enumerate(held)}
                keys = band_keys(super_min_hash(np.concatenate(sets), np.repeat(np.arange(len(sets)), [len(s) for s in sets]), len(sets), BANDS * ROWS)) if sets else []
                n = [len(held[t[2]]) if t[2] else 0 for t in todo]
                bands = [keys[place[t[2]]] if t[2] else None for t in todo]
                return pa.RecordBatch.from_arrays([pa.array([t[0] for t in todo], pa.int64()), pa.array([t[1] for t in todo], pa.int64()), pa.array([t[2] for t in todo], pa.binary()), pa.array(n, pa.int64()), pa.array(bands, pa.list_(pa.int64()))], names=["doc_id", "text_hash", "key", "n_shingles", "bands"])

            for at, text in enumerate(batch.column("text")):
                joined = normal_words(text.as_py())
                key = hashlib.md5(joined).digest() if joined else None
                if key and key not in held:
                    held[key] = shingle_set(joined)
                    size += len(held[key])
                todo.append((ids[at], hashes[at], key))
                if size >= BATCH:
                    yield out(todo, held)
                    todo, held, size = [], {}, 0
            if todo:
                yield out(todo, held)

    return _source(docs).mapInArrow(run, schema)


def _source(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"), F.col("text").cast("string").alias("text"))


def _texts(docs: DataFrame, classes: DataFrame, wanted: DataFrame) -> DataFrame:
    """class_no, text of the classes named in ``wanted``; a class may come more than once, from equal rows."""
    wanted = materialize(wanted.distinct().join(classes.select("class_no", F.coalesce("doc_id", F.lit(-(2**63))).alias("_id"), "text_hash"), "class_no"), "dup-wanted")
    return _source(docs).withColumn("_id", F.coalesce("doc_id", F.lit(-(2**63)))).join(small(wanted, wanted.count()), ["_id", "text_hash"]).select("class_no", "text")


def _shingled(texts: DataFrame) -> DataFrame:
    """class_no, shingles: the sorted hashes of each text's set."""

    def sets(batches):
        seen = set()
        for batch in slices(batches):
            fresh = []
            for at, no in enumerate(batch.column("class_no").to_pylist()):
                if no not in seen:
                    seen.add(no)
                    fresh.append(at)
            part = batch.take(pa.array(fresh, pa.int64()))
            yield pa.RecordBatch.from_arrays([part.column("class_no"), pa.array([shingle_set(normal_words(t)).tobytes() for t in part.column("text").to_pylist()], pa.binary())], names=["class_no", "shingles"])

    return texts.mapInArrow(sets, "class_no long, shingles binary")


def rarest(shingles: np.ndarray, known: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """The part of a set, in one order for all sets, of which any other set at the threshold has an element in its own such part.

    Sets at the threshold share at least PERCENT of each one's elements, so the first n - ceil(n * PERCENT / 100) + 1 suffice."""
    n = len(shingles)
    at = np.minimum(np.searchsorted(known, shingles), max(len(known) - 1, 0))
    late = np.where(known[at] == shingles, rank[at], 0) if len(known) else np.zeros(n, np.int64)
    return shingles[np.lexsort((shingles, late))[: n + (-n * PERCENT) // 100 + 1]]


def _by_rare_shingles(held: DataFrame) -> DataFrame:
    """bucket (a shingle), class_no: each class of ``held`` under the rarest part of its set; shingles of one class are left out."""

    def counts(batches):
        for batch in batches:
            found, n = np.unique(np.concatenate([np.frombuffer(s.as_py(), np.uint64) for s in batch.column("shingles")] or [np.empty(0, np.uint64)]), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(found.view(np.int64)), pa.array(n, pa.int64())], names=["shingle", "n"])

    often = held.select("shingles").mapInArrow(counts, "shingle long, n long").groupBy("shingle").agg(F.sum("n").alias("n")).where(F.col("n") > FEW).orderBy(F.desc("n"), "shingle").limit(RANKED).toPandas()
    known, rank = often["shingle"].to_numpy(np.int64).view(np.uint64), often["n"].to_numpy(np.int64)
    order = np.argsort(known)
    ranks = held.sparkSession.sparkContext.broadcast((known[order], rank[order]))

    def parts(batches):
        known, rank = ranks.value
        for batch in batches:
            chosen = [rarest(np.frombuffer(s.as_py(), np.uint64), known, rank) for s in batch.column("shingles")]
            owner = np.repeat(batch.column("class_no").to_numpy(zero_copy_only=False), [len(c) for c in chosen])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(chosen or [np.empty(0, np.uint64)]).view(np.int64)), pa.array(owner, pa.int64())], names=["bucket", "class_no"])

    placed = held.mapInArrow(parts, "bucket long, class_no long")
    shared = placed.groupBy("bucket").agg(F.min("class_no").alias("lo"), F.max("class_no").alias("hi")).where("lo < hi").select("bucket")
    return placed.join(shared, "bucket").distinct()


def _verified(pairs: DataFrame, held: DataFrame) -> DataFrame:
    """The pairs (a, b) of classes whose full shingle sets, in ``held``, reach the threshold."""
    def compare(batches):
        for batch in batches:
            good = []
            for left, right in zip(batch.column("left"), batch.column("right"), strict=True):
                a, b = np.frombuffer(left.as_py(), np.uint64), np.frombuffer(right.as_py(), np.uint64)
                both = len(np.intersect1d(a, b, assume_unique=True))
                good.append(100 * both >= PERCENT * (len(a) + len(b) - both))
            yield batch.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

    left = pairs.join(held.select(F.col("class_no").alias("a"), F.col("shingles").alias("left")), "a")
    both = left.join(held.select(F.col("class_no").alias("b"), F.col("shingles").alias("right")), "b")
    return materialize(both.select("a", "b", "left", "right").mapInArrow(compare, "a long, b long"), "dup-links")


def _verified_texts(docs: DataFrame, classes: DataFrame, pairs: DataFrame) -> DataFrame:
    """_verified on sets that are made from the texts for these pairs alone."""
    held = materialize(_shingled(_texts(docs, classes, pairs.select(F.col("a").alias("class_no")).union(pairs.select("b")))), "dup-sets")
    found = _verified(pairs, held)
    discard(held)
    return found


class HubIndex:
    """Shingles to hubs: for any set, the hubs at the threshold by one pass over the hubs of its shingles."""

    def __init__(self, sets: list[np.ndarray], names: np.ndarray, comps: np.ndarray):
        flat, owner = np.concatenate([*sets, np.empty(0, np.uint64)]), np.repeat(np.arange(len(sets), dtype=np.int32), [len(s) for s in sets])
        order = np.argsort(flat, kind="stable")
        self.hubs, self.sizes, self.names, self.comps = owner[order], np.array([len(s) for s in sets], np.int64), names, comps
        self.known, self.starts, self.counts = np.unique(flat[order], return_index=True, return_counts=True)

    def linked(self, shingles: np.ndarray, comp: int) -> np.ndarray:
        """One hub's name for each component other than ``comp`` that has a hub at the threshold."""
        if not len(self.known):
            return self.names[:0]
        at = np.minimum(np.searchsorted(self.known, shingles), len(self.known) - 1)
        at = at[self.known[at] == shingles]
        n = self.counts[at]
        places = np.repeat(self.starts[at] - np.cumsum(n) + n, n) + np.arange(n.sum())
        both = np.bincount(self.hubs[places], minlength=len(self.sizes))
        good = np.flatnonzero((100 * both >= PERCENT * (len(shingles) + self.sizes - both)) & (self.comps != comp))
        return self.names[good[np.unique(self.comps[good], return_index=True)[1]]]


def _probed(held: DataFrame, roots: DataFrame, hubs: DataFrame) -> DataFrame:
    """Links (a, b) between the classes of ``held`` and the few of ``hubs`` (class_no), by an index that every task gets."""
    named = _named(held, roots)
    chosen = named.join(F.broadcast(hubs), "class_no").select("class_no", "comp", "shingles").toPandas()
    index = held.sparkSession.sparkContext.broadcast(HubIndex([np.frombuffer(s, np.uint64) for s in chosen["shingles"]], chosen["class_no"].to_numpy(np.int64), chosen["comp"].to_numpy(np.int64)))

    def probe(batches):
        hubs = index.value
        for batch in batches:
            found = [hubs.linked(np.frombuffer(s.as_py(), np.uint64), c) for s, c in zip(batch.column("shingles"), batch.column("comp").to_pylist(), strict=True)]
            own = np.repeat(batch.column("class_no").to_numpy(zero_copy_only=False), [len(f) for f in found])
            yield pa.RecordBatch.from_arrays([pa.array(own, pa.int64()), pa.array(np.concatenate([*found, np.empty(0, np.int64)]), pa.int64())], names=["a", "b"])

    return materialize(named.select("class_no", "comp", "shingles").mapInArrow(probe, "a long, b long"), "dup-links")


def _forests(batches):
    """Union-find over ``FOREST`` links at a time: (node, root) of every node that isn't its tree's smallest."""
    held, size = [], 0

    def forest():
        nodes, at = np.unique(np.concatenate(held), return_inverse=True)
        up = list(range(len(nodes)))
        for a, b in at.reshape(-1, 2).tolist():
            while up[a] != a:
                up[a] = a = up[up[a]]
            while up[b] != b:
                up[b] = b = up[up[b]]
            if a != b:
                up[max(a, b)] = min(a, b)
        top = np.array(up)
        while (top[top] != top).any():
            top = top[top]
        low = np.flatnonzero(top != np.arange(len(top)))
        return pa.RecordBatch.from_arrays([pa.array(nodes[low], pa.int64()), pa.array(nodes[top[low]], pa.int64())], names=["node", "root"])

    for batch in batches:
        held.append(np.column_stack([batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 1)]).ravel())
        size += batch.num_rows
        if size >= FOREST:
            yield forest()
            held, size = [], 0
    if size:
        yield forest()


def components(edges: DataFrame, most: int = FOREST) -> DataFrame:
    """(node, root): the smallest node of the component of every node of ``edges`` (a, b) that isn't itself the smallest.

    Every task joins its links into forests. Up to ``most`` links that are left make the last forest; more of them go through
    alternating large-star and small-star steps: neighbours of a node move to its smallest neighbour until only stars remain."""
    stars = materialize(edges.select("a", "b").mapInArrow(_forests, "node long, root long"), "cc")
    rows = stars.count()
    if rows <= most:
        whole = materialize(stars.coalesce(1).mapInArrow(_forests, "node long, root long"), "cc") if rows else stars
        return whole
    mark = None
    while True:
        state = stars.agg(F.count(F.lit(1)), F.sum(F.xxhash64("node", "root").cast("decimal(38,0)"))).first()
        if tuple(state) == mark or not state[0]:
            return stars
        mark = tuple(state)
        both = stars.union(stars.select("root", "node")).toDF("u", "v")
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u > v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(low, "u")
        new = joined.select(F.col("v").alias("node"), F.col("m").alias("root")).union(joined.select("u", "m")).where("node > root").distinct()
        new = materialize(new, "cc")
        discard(stars)
        stars = new


def _named(rows: DataFrame, roots: DataFrame) -> DataFrame:
    """``rows`` (with class_no) and comp, the class that stands for their component."""
    return rows.join(small(roots, roots.count()), rows["class_no"] == roots["node"], "left").withColumn("comp", F.coalesce("root", "class_no")).drop("node", "root")


def _merged(roots: DataFrame, found: DataFrame) -> DataFrame:
    """The components after the links ``found`` (a, b)."""
    return roots if found.isEmpty() else components(roots.toDF("a", "b").union(found))


def _ranked(members: DataFrame, most: int) -> DataFrame:
    """class_no, n of the first ``most`` members of each bucket, ranked within ``PARTS`` parts of a bucket first: no task sorts a whole hot bucket."""
    # A struct, since rows that are dealt by bucket already would not be dealt anew for (bucket, part).
    cell = F.struct("bucket", F.pmod(F.xxhash64("class_no"), F.lit(PARTS)).alias("part"))
    rows = members.select("bucket", "class_no", "n", cell.alias("cell"))
    for key in ("cell", "bucket"):
        rows = rows.withColumn("rank", F.row_number().over(Window.partitionBy(key).orderBy("class_no"))).where(F.col("rank") <= most).drop("rank")
    return rows.select("class_no", "n").distinct()


def _dense_links(docs: DataFrame, classes: DataFrame, dense: DataFrame, roots: DataFrame) -> DataFrame:
    """The components after all links between classes of ``dense`` (class_no, n)."""
    held = materialize(_shingled(_texts(docs, classes, dense.select("class_no"))), "dup-rare-sets")
    placed = materialize(_by_rare_shingles(held).join(dense, "class_no").select("bucket", "class_no", "n"), "dup-dealt")
    done, hubs = None, HUBS
    while True:
        named = _named(placed, roots)
        mixed = named.groupBy("bucket", "comp").agg(F.count(F.lit(1)).alias("k")).groupBy("bucket").agg(F.count(F.lit(1)).alias("comps"), F.max_by("comp", "k").alias("main")).where("comps > 1")
        others = named.join(mixed, "bucket").where("comp != main")
        if done is None:
            turn = materialize(_ranked(others, hubs), "dup-turn")
        else:
            # Written first: else Catalyst moves the anti join below the distinct, to every row of every bucket.
            left = materialize(others.select("class_no", "n").distinct(), "dup-left")
            turn = materialize(left.join(small(done, done.count()), "class_no", "left_anti"), "dup-turn")
        rows, shingles = turn.agg(F.count(F.lit(1)), F.sum("n")).first()
        if done is not None and rows and shingles > INDEXED:
            turn = materialize(_ranked(others.join(turn.select("class_no"), "class_no", "left_semi"), hubs), "dup-turn")
            shingles = turn.agg(F.sum("n")).first()[0]
        if not rows:
            return roots
        if shingles <= INDEXED:
            found = _probed(held, roots, turn.select("class_no"))
        else:
            x = named.join(turn.select("class_no"), "class_no", "left_semi").select("bucket", F.col("class_no").alias("x"), F.col("n").alias("x_n"), F.col("comp").alias("x_comp"))
            met = named.join(x, "bucket").where("comp != x_comp").where(_similar_sizes("n", "x_n"))
            found = _verified(materialize(met.select(F.least("class_no", "x").alias("a"), F.greatest("class_no", "x").alias("b")).distinct(), "dup-more"), held)
        roots = _merged(roots, found)
        done = turn.select("class_no") if done is None else done.union(turn.select("class_no"))
        hubs *= GROWTH


def _similar_sizes(a: str, b: str):
    return F.expr(f"100 * least({a}, {b}) >= {PERCENT} * greatest({a}, {b})")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """Per row of ``docs``: doc_id, n_shingles, component_id, kept, text_hash, and comp, a number for its component (null for a text without shingles).

    Null and empty texts, and texts of white space only, have no shingles and are linked with nothing: each is its own
    component. Fewer words than a shingle has are one shingle. Equal rows and equal texts share a component; null ids
    take part but name no component while another id is there. An empty table gives no rows; other columns are ignored."""
    profiles = materialize(_profiles(docs), "dup-profiles")
    own = profiles.where("key is not null").groupBy("key").agg(F.min("doc_id").alias("doc_id"), F.min_by("text_hash", F.coalesce("doc_id", F.lit(2**63 - 1))).alias("text_hash"), F.first("n_shingles").alias("n"), F.first("bands").alias("bands"))
    classes = materialize(own.withColumn("class_no", F.monotonically_increasing_id()), "dup-classes")
    placed = classes.select("class_no", "n", F.explode("bands").alias("bucket"))
    hubs = placed.groupBy("bucket").agg(F.min("class_no").alias("hub"), F.min_by("n", "class_no").alias("hub_n"), F.count(F.lit(1)).alias("members")).where("members > 1")
    shared = materialize(placed.join(hubs, "bucket").where("class_no != hub or members > 2"), "dup-buckets")
    pairs = materialize(shared.where("class_no != hub").where(_similar_sizes("n", "hub_n")).select(F.col("hub").alias("a"), F.col("class_no").alias("b")).distinct(), "dup-pairs")
    roots = components(_verified_texts(docs, classes, pairs))
    named = _named(shared.where("members > 2"), roots)
    mixed = named.groupBy("bucket").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo < hi").select("bucket")
    larger = materialize(named.join(mixed, "bucket").select("bucket", "class_no", "n", "hub", "members", "comp"), "dup-larger")
    few = larger.where(F.col("members") <= FEW).where("class_no != hub").select("bucket", "class_no", "n", "comp")
    met = few.join(few.toDF("bucket", "x", "x_n", "x_comp"), "bucket").where("class_no < x and comp != x_comp").where(_similar_sizes("n", "x_n"))
    more = materialize(met.select(F.col("class_no").alias("a"), F.col("x").alias("b")).distinct(), "dup-more")
    if not more.isEmpty():
        roots = _merged(roots, _verified_texts(docs, classes, more))
    dense = materialize(larger.where(F.col("members") > FEW).select("class_no", "n").distinct(), "dup-dense")
    if not dense.isEmpty():
        roots = _dense_links(docs, classes, dense, roots)
    # The smallest id of each component, then one row for each document.
    least = classes.select("class_no", "key", "doc_id").join(roots, F.col("class_no") == F.col("node"), "left").withColumn("comp", F.coalesce("root", "class_no")).select("key", "doc_id", "comp")
    tops = roots.select("root").distinct()
    linked = least.join(tops, F.col("comp") == F.col("root"), "left_semi").groupBy("comp").agg(F.min("doc_id").alias("least_id"))
    by_key = least.join(linked, "comp", "left").select("key", F.coalesce("least_id", "doc_id").alias("component_id"), "comp")
    slim = profiles.select("doc_id", "n_shingles", "text_hash", "key")
    named = slim.where("key is not null").join(by_key, "key").select("doc_id", "n_shingles", "component_id", "text_hash", "comp")
    bare = slim.where("key is null").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"), "text_hash", F.lit(None).cast("long").alias("comp"))
    return named.union(bare).select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)).alias("kept"), "text_hash", "comp")


def keep_representatives(docs: DataFrame) -> DataFrame:
    """One row of ``docs`` for each component of near_duplicates, with its columns as they are: a row with the smallest doc_id, null ids last, then the least hash of the text.

    Texts without shingles (null, empty, white space) are linked with nothing and stay. Rows that are equal in doc_id and
    text become one; if their other columns differ, the one with the least hash of the others stays. Columns may have any
    names; an empty table gives no rows."""
    found = materialize(near_duplicates(docs), "dup-result")
    first = found.where("kept or component_id is null")
    gone = found.where("not kept and component_id is not null").select("doc_id", "text_hash")
    # Rows of one component that share its smallest id, or all have none.
    several = first.where("comp is not null").groupBy("comp").agg(F.min("text_hash").alias("least"), F.max("text_hash").alias("most")).where("least < most")
    gone = gone.union(first.join(several, "comp").where("text_hash != least").select("doc_id", "text_hash")).distinct()
    again = first.groupBy("doc_id", "text_hash").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("doc_id", "text_hash")
    # Own names only: no column of the caller's can clash inside the struct.
    held = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("doc_id").cast("long").alias("at"), F.xxhash64(F.col("text").cast("string")).alias("hash"))
    same = F.col("at").eqNullSafe(F.col("doc_id")) & (F.col("hash") == F.col("text_hash"))
    left = held.join(small(gone, gone.count()), same, "left_anti")
    more = again.count()
    if more:
        plain = [F.col(f"row.`{f.name}`") for f in docs.schema if "map<" not in f.dataType.simpleString()]
        equal = left.join(small(again, more), same, "left_semi").groupBy("at", "hash").agg(F.min_by("row", F.xxhash64(*plain)).alias("row"))
        left = left.join(small(again, more), same, "left_anti").select("row").union(equal.select("row"))
    return left.select("row.*")
