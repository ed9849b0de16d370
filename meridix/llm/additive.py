"""Approximate nearest neighbours by additive quantisation.

Full-dimensional codebooks are learned on residuals of a bounded sample; a beam search encodes every vector as a sum of
codewords; searches score codes with look-up tables and stored norms, then rank a shortlist of each segment exactly.
"""

from __future__ import annotations

import sys

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meridix.llm.common import learning_share, materialize
from meridix.llm.vectors import best, blocks, one_a_query, search, usable

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Vectors that learning reads (about; fewer if they are long), codebooks, codewords of each, beam, rounds of k-means.
SAMPLE, BOOKS, WORDS, BEAM, ROUNDS = 8192, 12, 256, 4, 8
#: Rows of a segment, queries of a group, rows of a segment that a query ranks exactly.
SEGMENT, GROUP, SHORTLIST = 16384, 2048, 320
SAMPLE_VALUES = 4_000_000


def scaled(x: np.ndarray) -> np.ndarray:
    """Rows times a power of two each (which changes no rounding) so that squares neither overflow nor vanish."""
    _, e = np.frexp(np.abs(x).max(axis=1, initial=0))
    return np.ldexp(x, -e[:, None])


def unit(x: np.ndarray) -> np.ndarray:
    x = scaled(x)
    return (x / np.sqrt((x * x).sum(axis=1))[:, None]).astype(np.float32)


def learn_books(sample: np.ndarray, books: int = BOOKS, words: int = WORDS) -> np.ndarray:
    """Codebooks [book, word, dim]: k-means on what the earlier books leave of the sample."""
    rng = np.random.default_rng(4)
    words = max(1, min(words, len(sample)))
    rest, out = sample.astype(np.float32).copy(), []
    for _ in range(books):
        book = rest[rng.choice(len(rest), words, replace=False)].copy()
        for _ in range(ROUNDS):
            near = (rest @ book.T - (book * book).sum(axis=1) / 2).argmax(axis=1)
            n = np.bincount(near, minlength=words)
            total = np.zeros_like(book)
            np.add.at(total, near, rest)
            book = np.where(n[:, None] > 0, total / np.maximum(n, 1)[:, None], rest[rng.choice(len(rest), words)])
        near = (rest @ book.T - (book * book).sum(axis=1) / 2).argmax(axis=1)
        rest -= book[near]
        out.append(book)
    return np.stack(out).astype(np.float32)


def encode(x: np.ndarray, books: np.ndarray, beam: int = BEAM) -> tuple[np.ndarray, np.ndarray]:
    """(codes [row, book], squared norms of the decoded rows): the beam keeps the partial sums with the least error."""
    n = len(x)
    rest = x[:, None, :].astype(np.float32)
    codes = np.zeros((n, 1, 0), np.uint8)
    error = (rest * rest).sum(axis=2)
    for book in books:
        width = rest.shape[1]
        cost = error[:, :, None] - 2 * (rest.reshape(-1, x.shape[1]) @ book.T).reshape(n, width, -1) + (book * book).sum(axis=1)
        flat = cost.reshape(n, -1)
        keep = min(beam, flat.shape[1])
        top = np.argpartition(flat, keep - 1, axis=1)[:, :keep] if keep < flat.shape[1] else np.broadcast_to(np.arange(keep), (n, keep))
        parent, word = top // len(book), top % len(book)
        rest = np.take_along_axis(rest, parent[:, :, None], axis=1) - book[word]
        codes = np.concatenate([np.take_along_axis(codes, parent[:, :, None], axis=1), word[:, :, None].astype(np.uint8)], axis=2)
        error = np.take_along_axis(flat, top, axis=1)
    at = error.argmin(axis=1)
    decoded = x - rest[np.arange(n), at]
    return codes[np.arange(n), at], (decoded * decoded).sum(axis=1)


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 5, shortlist: int = SHORTLIST) -> DataFrame:
    """query_id, rank, vec_id, score: for each query the k nearest found by cosine over all other ids, ties to the smaller id.

    Scores are exact cosines in double precision of the original vectors. Vectors that are null, empty or zero, or hold null
    or non-finite components, and rows without an id take no part; only vectors of a query's length are its candidates. A
    query whose id repeats counts once, with its smallest vector. Fewer than k candidates give as many rows; an empty table
    gives none; other columns are ignored."""
    spark = vectors.sparkSession
    nonzero = F.exists("embedding", lambda x: x != 0)
    rows = usable(vectors).where(nonzero)
    sizes = {r["dim"]: r["n"] for r in rows.groupBy(F.size("embedding").alias("dim")).agg(F.count(F.lit(1)).alias("n")).collect()}
    share = F.lit(0.0)
    for dim, n in sizes.items():
        share = F.when(F.size("embedding") == dim, min(1.0, min(SAMPLE, max(1, SAMPLE_VALUES // dim)) / n)).otherwise(share)
    learned = {}
    sample = rows.where(learning_share(share, F.col("vec_id"))).orderBy("vec_id", "embedding").select("embedding").toArrow().column("embedding").combine_chunks() if sizes else None
    for dim in sizes:
        got = [v for v in (sample.to_pylist() if len(sizes) > 1 else []) if len(v) == dim] if len(sizes) > 1 else None
        matrix = np.array(got, np.float64).reshape(-1, dim) if got is not None else np.asarray(sample.values if hasattr(sample, "values") else sample.flatten(), np.float64).reshape(-1, dim)
        learned[dim] = learn_books(unit(matrix)) if len(matrix) else np.zeros((1, 1, dim), np.float32)
    shared = spark.sparkContext.broadcast(learned)

    def build(batches):
        for batch in batches:
            codes, norms = [], []
            for dim, data in zip(batch.column("dim").to_pylist(), batch.column("data").to_pylist(), strict=True):
                x = unit(np.frombuffer(data, np.float64).reshape(-1, dim))
                made = [encode(x[at : at + 512], shared.value[dim]) for at in range(0, len(x), 512)]
                codes.append(np.concatenate([m[0] for m in made]).T.tobytes())
                norms.append(np.concatenate([m[1] for m in made]).astype(np.float32).tobytes())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("block", "dim", "ids", "data")), pa.array(codes, pa.binary()), pa.array(norms, pa.binary())], names=["block", "dim", "ids", "data", "codes", "norms"])

    index = materialize(blocks(rows, SEGMENT, "aq-blocks").select("block", "dim", "ids", "data").mapInArrow(build, "block int, dim int, ids binary, data binary, codes binary, norms binary"), "aq-index")

    def answer(dim, ids, held, q_ids, q):
        books = shared.value[dim]
        x = scaled(np.frombuffer(held["data"], np.float64).reshape(len(ids), dim))
        lengths = np.sqrt((x * x).sum(axis=1))
        codes = np.frombuffer(held["codes"], np.uint8).reshape(len(books), len(ids))
        inverse = 1 / np.sqrt(np.maximum(np.frombuffer(held["norms"], np.float32), 1e-12))
        found = []
        q = scaled(q)
        tables = np.einsum("bwd,qd->qbw", books, unit(q)) if len(q) else []
        for q_id, query, table in zip(q_ids, q, tables, strict=True):
            guess = table[0][codes[0]]
            for b in range(1, len(books)):
                guess += table[b][codes[b]]
            guess *= inverse
            guess[np.searchsorted(ids, q_id) : np.searchsorted(ids, q_id, "right")] = -np.inf
            keep = min(shortlist, len(ids))
            # Rows that tie with the last of the shortlist are ranked too, so that copies of a vector don't depend on their order.
            at = np.flatnonzero(guess >= np.partition(guess, len(ids) - keep)[len(ids) - keep])
            at = at[ids[at] != q_id]
            score = (x[at] * query).sum(axis=1) / (lengths[at] * np.sqrt((query * query).sum()))
            order = np.lexsort((ids[at], -score))[:k]
            found.append((np.full(len(order), q_id), ids[at][order], score[order]))
        joined = [np.concatenate([f[c] for f in found]) if found else np.empty(0) for c in range(3)]
        return pa.RecordBatch.from_arrays([pa.array(joined[0].astype(np.int64)), pa.array(joined[1].astype(np.int64)), pa.array(joined[2], pa.float64())], names=["query_id", "vec_id", "score"])

    return best(search(index, one_a_query(usable(queries).where(nonzero)), answer, "query_id long, vec_id long, score double", GROUP), k)
