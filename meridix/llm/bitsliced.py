"""Exact top-k inner products on a bit-sliced index.

A segment stores, for each attribute and each bit, the bitmap of the rows that have the bit. A query's weights select
slices, which carry-save adders sum up to the slices of the score; top rows are then selected from the most significant
slice downward, and the rows that tie at the boundary are resolved by id.
"""

from __future__ import annotations

import sys

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meridix.llm.vectors import best, blocks, one_a_query, search, usable

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Rows of a segment, and queries of a group.
SEGMENT, GROUP = 8192, 2048
SCALE = 1024
FULL = np.uint64(0xFFFFFFFFFFFFFFFF)


def quantise(x: np.ndarray, scale: int = SCALE) -> np.ndarray:
    """floor(scale * x), exactly: 64-bit integers, or Python's where one is wider."""
    wide = np.abs(x) >= 2.0**52
    if not wide.any():
        return np.floor(scale * x).astype(np.int64)
    # From 2**52 on a double is a whole number.
    out = [int(v) * scale if w else int(np.floor(scale * v)) for v, w in zip(x.ravel().tolist(), wide.ravel().tolist(), strict=True)]
    return np.array([*out, None], object)[:-1].reshape(x.shape)


def slices(values: np.ndarray) -> tuple[list[int], np.ndarray]:
    """(least value of each attribute, bitmaps [attribute, bit, word]) of integer rows of any width."""
    low = values.min(axis=0)
    up = (values - low).T
    bits = max(1, int(up.max()).bit_length())
    words = -(-len(values) // 64)
    out = np.zeros((values.shape[1], bits, words * 8), np.uint8)
    for b in range(bits):
        packed = np.packbits(((up >> b) & 1).astype(np.uint8), axis=1, bitorder="little")
        out[:, b, : packed.shape[1]] = packed
    return [int(x) for x in low], out.view(np.uint64)


def add_slices(columns: dict[int, list[np.ndarray]], words: int) -> list[np.ndarray]:
    """Bitmaps of the sums: ``columns[p]`` holds stacks of bitmaps that weigh 2**p; three become one and a carry until one is left."""
    out, p = [], 0
    while any(q >= p for q in columns):
        parts = columns.pop(p, [])
        stack = np.concatenate(parts) if parts else np.zeros((0, words), np.uint64)
        while len(stack) > 2:
            n = len(stack) // 3
            a, b, c = stack[:n], stack[n : 2 * n], stack[2 * n : 3 * n]
            ab = a ^ b
            columns.setdefault(p + 1, []).append((a & b) | (c & ab))
            stack = np.concatenate([ab ^ c, stack[3 * n :]])
        if len(stack) == 2:
            columns.setdefault(p + 1, []).append((stack[0] & stack[1])[None])
            stack = (stack[0] ^ stack[1])[None]
        out.append(stack[0] if len(stack) else np.zeros(words, np.uint64))
        p += 1
    return out


def select_top(score: list[np.ndarray], rows: np.ndarray, k: int) -> np.ndarray:
    """Row numbers of the k largest sums among ``rows`` (a bitmap), ties to the smaller row number: slices from the top decide whole sets, the boundary set is cut by row number."""
    sure, open_ = np.zeros_like(rows), rows
    for bitmap in reversed(score):
        with_bit = open_ & bitmap
        n = int(np.bitwise_count(sure).sum()) + int(np.bitwise_count(with_bit).sum())
        if n > k:
            open_ = with_bit
        else:
            sure = sure | with_bit
            open_ = open_ & ~bitmap
            if n == k:
                open_ = np.zeros_like(open_)
                break
    certain = np.flatnonzero(np.unpackbits(sure.view(np.uint8), bitorder="little"))
    boundary = np.flatnonzero(np.unpackbits(open_.view(np.uint8), bitorder="little"))[: k - len(certain)]
    return np.concatenate([certain, boundary])


def top_rows(low: list[int], index: np.ndarray, n: int, query: np.ndarray, skip: np.ndarray, k: int) -> tuple[np.ndarray, list[int]]:
    """(row numbers, scores) of the k rows of a segment with the largest inner products; ``skip`` rows take no part."""
    attributes, bits, words = index.shape
    base = sum(int(q) * lo for q, lo in zip(query, low, strict=True))
    weight, flip = np.abs(query), query < 0
    # A negative weight adds the complement of its attribute instead, and a constant.
    base -= sum(map(int, weight[flip])) * ((1 << bits) - 1)
    flat = np.where(flip.astype(bool)[:, None, None], ~index, index)
    columns: dict[int, list[np.ndarray]] = {}
    for a in range(int(weight.max(initial=0)).bit_length()):
        picked = np.flatnonzero((weight >> a) & 1)
        for b in range(bits if len(picked) else 0):
            columns.setdefault(a + b, []).append(flat[picked, b])
    score = add_slices(columns, words)
    rows = np.full(words, FULL)
    if n % 64:
        rows[-1] = np.uint64((1 << (n % 64)) - 1)
    for r in skip:
        rows[r // 64] &= ~np.uint64(1 << (int(r) % 64))
    top = select_top(score, rows, k)
    total = [base] * len(top)
    for p, bitmap in enumerate(score):
        for at, bit in enumerate(((bitmap[top // 64] >> (top % 64).astype(np.uint64)) & np.uint64(1)).tolist()):
            total[at] += bit << p
    return top, total


def sort_key(x: int) -> bytes:
    """Bytes that order as the integers do, of any size: sign, length, digits; complemented below zero."""
    n = (abs(x).bit_length() + 7) // 8
    raw = bytes([0x80 + (n >> 16), n >> 8 & 255, n & 255]) + abs(x).to_bytes(n)
    return raw if x >= 0 else bytes(255 - c for c in raw)


def top_products(vectors: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """query_id, rank, vec_id, score: for each query the k largest integer inner products over all other ids, ties to the smaller id.

    Components are quantised as floor(1024 * x), of any size. Vectors that are null or empty, or hold null or non-finite
    components, and rows without an id take no part; only vectors of a query's length are its candidates. A query whose id
    repeats counts once, with its smallest vector; candidates that repeat an id are rows like others. Ranks follow the exact
    scores; a score that no long can hold is given as the nearest long. Fewer than k candidates give as many rows; an empty
    table gives none; other columns are ignored."""
    base = blocks(usable(vectors), SEGMENT, "bit-slices")

    def build(batches):
        for batch in batches:
            rows = []
            for dim, data in zip(batch.column("dim").to_pylist(), batch.column("data").to_pylist(), strict=True):
                low, index = slices(quantise(np.frombuffer(data, np.float64).reshape(-1, dim)))
                rows.append((" ".join(map(str, low)), index.tobytes(), index.shape[1]))
            extra = [pa.array([r[c] for r in rows], t) for c, t in enumerate((pa.string(), pa.binary(), pa.int32()))]
            yield pa.RecordBatch.from_arrays([batch.column("block"), batch.column("dim"), batch.column("ids"), *extra], names=["block", "dim", "ids", "low", "slices", "bits"])

    index = base.select("block", "dim", "ids", "data").mapInArrow(build, "block int, dim int, ids binary, low string, slices binary, bits int")

    def answer(dim, ids, held, q_ids, q):
        low = [int(x) for x in held["low"].split()]
        index = np.frombuffer(held["slices"], np.uint64).reshape(dim, held["bits"], -1)
        out: list[tuple[int, int, int, bytes]] = []
        for q_id, query in zip(q_ids.tolist(), quantise(q), strict=True):
            skip = np.arange(np.searchsorted(ids, q_id), np.searchsorted(ids, q_id, "right"))
            at, scores = top_rows(low, index, len(ids), query, skip, k)
            out += [(q_id, int(ids[r]), max(-(2**63), min(2**63 - 1, s)), sort_key(s)) for r, s in zip(at.tolist(), scores, strict=True)]
        columns = list(zip(*out, strict=True)) or [()] * 4
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, [pa.int64()] * 3 + [pa.binary()], strict=True)], names=["query_id", "vec_id", "score", "exact"])

    found = search(index, one_a_query(usable(queries)), answer, "query_id long, vec_id long, score long, exact binary", GROUP)
    return best(found, k, "exact")
