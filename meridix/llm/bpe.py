"""BPE encoding and decoding through one table of the corpus's distinct words.

Texts are split into words by the tokenizer file's own normaliser and pattern, in chunks of bounded size: a chunk keeps its
distinct words once, and its texts as positions in that list. The table of the corpus's distinct words is dealt over tasks by
a hash of the word: each word lies in one bucket and is encoded there once. Chunks and buckets exchange blocks (all words
of a chunk that belong to a bucket, and their ids in the same order), not single words. Ids join the texts by position,
and the vocabulary's pieces join the ids.
"""

from __future__ import annotations

import hashlib
import json
import os
import sys
import unicodedata
import uuid
import zlib
from collections import defaultdict
from itertools import count

import numpy as np
import pyarrow as pa
import regex
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meridix.llm.common import scratch_dir

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Words after which a chunk ends (a text is never cut), and blocks that a bucket codes at once. A worker holds one chunk; Python keeps much of that memory for the stages that follow.
CHUNK, AT_ONCE = 1 << 20, 64
# The white space of the file's patterns, and what Python's own splitting takes for white space beside it.
SPACES = r"\t\n\x0b\x0c\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
NO_SPACES = "\x1c\x1d\x1e\x1f"


class Splitter:
    """Words of a text as the tokenizer file's normaliser and pre-tokenizer make them, special tokens standing for themselves.

    Supports files whose normaliser is NFC, white space to one space, lower case, and whose pre-tokenizer keeps the matches of one pattern, which no white space matches, and then maps bytes."""

    def __init__(self, spec: dict):
        kinds = [n["type"] for n in spec["normalizer"]["normalizers"]]
        steps = [p["type"] for p in spec["pre_tokenizer"]["pretokenizers"]]
        if kinds != ["NFC", "Replace", "Lowercase"] or steps != ["Split", "ByteLevel"] or any(t["normalized"] or t["lstrip"] or t["rstrip"] or t["single_word"] for t in spec["added_tokens"]):
            raise ValueError("a tokenizer file of another kind")
        self.specials = [t["content"] for t in spec["added_tokens"]]
        self.special = regex.compile("(" + "|".join(map(regex.escape, self.specials)) + ")") if self.specials else None
        self.words = regex.compile(spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"].replace("\\s", SPACES))
        self.space = regex.compile(f"[{SPACES}]+")

    def _runs(self, text: str) -> list[str]:
        if not text.isascii():
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")  # sigma has no final form here
        text = text.lower()
        return self.space.split(text) if any(c in text for c in NO_SPACES) else text.split()

    def runs(self, text: str | None) -> list[str]:
        """Normalised parts of the text between white space, and special tokens; no word crosses their ends."""
        if not text:
            return []
        if self.special is None or not any(s in text for s in self.specials):
            return self._runs(text)
        return [r for part in self.special.split(text) for r in ([part] if part in self.specials else self._runs(part))]

    def words_of(self, run: str) -> list[str]:
        return [run] if run in self.specials else self.words.findall(run)


class Positions(dict):
    """Of each run of a chunk the positions (32-bit, as bytes) of its words in the chunk's list of distinct words, worked out once a run."""

    def __init__(self, split: Splitter):
        super().__init__()
        self.split = split
        self.words: defaultdict[str, int] = defaultdict(count().__next__)

    def __missing__(self, run: str) -> bytes:
        at = self[run] = np.array([self.words[w] for w in self.split.words_of(run)], np.int32).tobytes()
        return at


def _pack(values: np.ndarray) -> bytes:
    """Unsigned integers below 2**32 in two planes of 16 bits, compressed. Nothing wider than the planes is made of them on the way."""
    planes = np.empty((2, len(values)), np.uint16)
    planes[0] = values & values.dtype.type(0xFFFF)
    planes[1] = values >> values.dtype.type(16)
    return pa.compress(planes, codec="zstd", asbytes=True)


def _unpack(packed: bytes, n: int) -> np.ndarray:
    low, high = np.frombuffer(pa.decompress(packed, 4 * n, codec="zstd"), np.uint16).reshape(2, n)
    out = high.astype(np.uint32)
    out <<= 16
    out |= low
    return out


SPLIT = "chunk long, doc_ids array<long>, sizes array<long>, at binary, buckets binary, n_words long, blocks array<struct<bucket: int, n: int, size: int, words: binary>>"


def _split(docs: DataFrame, sent, buckets: int) -> DataFrame:
    """Chunks: ids and numbers of words of the texts, positions of all their words in the list of distinct words, the buckets of those, and the list itself, a block a bucket."""

    def split(batches):
        splitter = Splitter(json.loads(sent.value))
        seen, held, chunk, filled = Positions(splitter), [], 0, 0

        def row(part):
            at = np.frombuffer(b"".join(h[1] for h in held), np.uint32)
            words = np.empty(len(seen.words), object)
            words[:] = list(seen.words)
            bucket = np.fromiter((zlib.crc32(w.encode("utf-8", "surrogatepass")) % buckets for w in words), np.int64, len(words))
            order = np.argsort(bucket, kind="stable")
            blocks = []
            for b, own in zip(*_groups(bucket[order], words[order]), strict=True):
                raw = "\n".join(own).encode("utf-8", "surrogatepass")
                blocks.append({"bucket": int(b), "n": len(own), "size": len(raw), "words": pa.compress(raw, codec="zstd", asbytes=True)})
            values = [(part << 32) + chunk, [h[0] for h in held], [len(h[1]) // 4 for h in held], _pack(at), _pack(bucket), len(words), blocks]
            types = [pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary(), pa.binary(), pa.int64(), pa.list_(pa.struct([("bucket", pa.int32()), ("n", pa.int32()), ("size", pa.int32()), ("words", pa.binary())]))]
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, types, strict=True)], names=["chunk", "doc_ids", "sizes", "at", "buckets", "n_words", "blocks"])

        part = 0
        for batch in batches:
            for doc_id, text, part in zip(batch.column("doc_id").to_pylist(), batch.column("text"), batch.column("part").to_pylist(), strict=True):
                held.append((doc_id, b"".join(map(seen.__getitem__, splitter.runs(text.as_py())))))
                filled += len(held[-1][1]) // 4
                if filled >= CHUNK:
                    yield row(part)
                    seen, held, chunk, filled = Positions(splitter), [], chunk + 1, 0
        if held:
            yield row(part)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.spark_partition_id().cast("long").alias("part"))
    return rows.mapInArrow(split, SPLIT)


def _groups(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """The distinct ones of sorted keys, and the values of each."""
    found, first = np.unique(keys, return_index=True)
    return found, np.split(values, first[1:]) if len(found) else []


def _by_chunk(chunks: DataFrame, buckets: int) -> DataFrame:
    """Written once to the shared scratch folder, bucketed by chunk, so that the positions need no shuffle to meet their words' ids."""
    spark = chunks.sparkSession
    path, name = f"{scratch_dir(spark)}/bpe-chunks-{uuid.uuid4().hex}", f"bpe_chunks_{uuid.uuid4().hex}"
    chunks.write.format("parquet").option("path", path).option("compression", "zstd").bucketBy(buckets, "chunk").saveAsTable(name)
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(where)
    back = spark.table(name)
    back.schema  # resolved now: the plan keeps files and buckets, the catalog needs no entry any more
    spark.sql(f"DROP TABLE {name}")
    return back


class WordTable:
    """The distinct words of a bucket with their ids (32-bit, as bytes): a word is encoded when it first comes."""

    def __init__(self, spec_text: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.coder = Tokenizer.from_str(spec_text)
        self.coder.no_truncation()
        self.coder.no_padding()
        self.ids: dict[str, bytes] = {}

    def learn(self, words: set[str]) -> None:
        fresh = list(words.difference(self.ids))
        for word, coded in zip(fresh, self.coder.encode_batch_fast(fresh, add_special_tokens=False), strict=True):
            self.ids[word] = np.array(coded.ids, np.uint32).tobytes()


CODED_BLOCK = "chunk long, bucket int, lengths binary, n int, n_ids long, ids binary"


def coded_blocks(blocks: DataFrame, sent) -> DataFrame:
    """(chunk, bucket, n, size, words) -> (chunk, bucket, lengths, n, n_ids, ids): ids of the block's words in their order. A bucket's blocks come to one task, which holds that bucket's words only."""

    def code(batches):
        table, now, held = WordTable(sent.value), None, []

        def flush():
            words = [pa.decompress(words, size, codec="zstd", asbytes=True).decode("utf-8", "surrogatepass").split("\n") for _, _, size, words in held]
            table.learn(set().union(*words))
            for (chunk, n, _, _), own in zip(held, words, strict=True):
                ids = list(map(table.ids.__getitem__, own))
                flat = np.frombuffer(b"".join(ids), np.uint32)
                values = [chunk, now, _pack(np.fromiter(map(len, ids), np.int64, n) // 4), n, len(flat), _pack(flat)]
                types = [pa.int64(), pa.int32(), pa.binary(), pa.int32(), pa.int64(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, types, strict=True)], names=["chunk", "bucket", "lengths", "n", "n_ids", "ids"])
            held.clear()

        for batch in batches:
            for chunk, bucket, n, size, words in zip(*(batch.column(c).to_pylist() for c in ("chunk", "bucket", "n", "size", "words")), strict=True):
                if bucket != now or len(held) >= AT_ONCE:
                    yield from flush() if held else ()
                    if bucket != now:
                        table.ids.clear()
                        now = bucket
                held.append((chunk, n, size, words))
        yield from flush() if held else ()

    return blocks.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(code, CODED_BLOCK)


CODED = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, ids string, decoded string"


def encode_decode(docs: DataFrame, path: str, keep: bool = False) -> DataFrame:
    """Per document: doc_id, n_tokens, ids_sha256, decoded_sha256; with ``keep`` also ids (text, joined by spaces) and decoded.

    Whole texts are encoded without added special tokens, truncation or padding; special tokens that stand in a text keep
    their ids. The file has no decoder, so decoding joins the pieces by spaces. Null and empty texts have no ids. Null ids
    and equal rows stay as they are; an empty table gives no rows; other columns are ignored."""
    spark = docs.sparkSession
    with open(path, encoding="utf-8") as file:
        sent = spark.sparkContext.broadcast(file.read())
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    chunks = _by_chunk(_split(docs, sent, buckets), buckets)
    coded = coded_blocks(chunks.select("chunk", F.inline("blocks")), sent)
    tables = coded.groupBy("chunk").agg(F.sort_array(F.collect_list(F.struct("bucket", "lengths", "n", "n_ids", "ids"))).alias("table"))

    def place(batches):
        spec = json.loads(sent.value)
        vocabulary = {i: p for p, i in spec["model"]["vocab"].items()} | {t["id"]: t["content"] for t in spec["added_tokens"]}
        for batch in batches:
            for row in range(batch.num_rows):
                doc_ids, sizes, at, bucket, n_words, table = (batch.column(c)[row].as_py() for c in ("doc_ids", "sizes", "at", "buckets", "n_words", "table"))
                lengths, ids, pieces = _placed(_unpack(bucket, n_words), table or [], vocabulary)
                ends = np.cumsum([0, *sizes])
                at, out = _unpack(at, int(ends[-1])), []
                for doc_id, start, end in zip(doc_ids, ends[:-1], ends[1:], strict=True):
                    own = at[start:end]
                    places = own.tolist()
                    a, b = " ".join(map(ids.__getitem__, places)), " ".join(map(pieces.__getitem__, places))
                    out.append((doc_id, int(lengths[own].sum()), hashlib.sha256(a.encode()).hexdigest(), hashlib.sha256(b.encode()).hexdigest(), a if keep else None, b if keep else None))
                types = [pa.int64(), pa.int64()] + [pa.string()] * 4
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "ids", "decoded"])

    out = chunks.drop("blocks").join(tables.hint("shuffle_hash"), "chunk", "left").mapInArrow(place, CODED)
    return out if keep else out.drop("ids", "decoded")


def _placed(bucket: np.ndarray, table: list[dict], vocabulary: dict[int, str]) -> tuple[np.ndarray, list[str], list[str]]:
    """Of a chunk's distinct words, in their order: the number of ids, the ids, and the pieces that join them, both as text."""
    order = np.argsort(bucket, kind="stable")
    lengths = np.zeros(len(order), np.int64)
    if table:
        lengths[order] = in_order = np.concatenate([_unpack(b["lengths"], b["n"]) for b in table])
        flat = np.concatenate([_unpack(b["ids"], b["n_ids"]) for b in table]).tolist()
        ends = np.cumsum(in_order).tolist()
    ids, pieces, start = [""] * len(order), [""] * len(order), 0
    for k, no in enumerate(order.tolist()):
        own = flat[start : ends[k]]
        start = ends[k]
        ids[no] = " ".join(map(str, own))
        pieces[no] = " ".join(map(vocabulary.__getitem__, own))
    return lengths, ids, pieces
