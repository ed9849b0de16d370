"""Blocks of vectors: candidates in segments of bounded size, queries in groups of bounded size, each pair of blocks one task's work."""

from __future__ import annotations

import sys

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from meridix.llm.common import materialize

cloudpickle.register_pickle_by_value(sys.modules[__name__])


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id and embedding (array<double>) of the rows that take part: no null id, no null or empty vector, no null or non-finite component."""
    v = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return v.where(F.col("vec_id").isNotNull() & (F.size("embedding") > 0) & F.coalesce(finite, F.lit(False)))


def as_matrix(column: pa.Array) -> np.ndarray:
    """Rows of one length as a matrix."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1)


def blocks(vectors: DataFrame, rows: int, name: str) -> DataFrame:
    """(block, dim, ids, data): vectors of equal length in blocks of at most ``rows`` rows, ordered by id, written once. Blocks are numbered from 0 in each length."""
    n = vectors.count()

    def pack(batches):
        held: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
        filled: dict[int, int] = {}

        def out(dim):
            ids = np.concatenate([x[0] for x in held[dim]])
            data = np.concatenate([x[1] for x in held[dim]])
            order = np.argsort(ids, kind="stable")
            held.pop(dim)
            filled.pop(dim)
            return [(dim, ids[order][at : at + rows].tobytes(), data[order][at : at + rows].tobytes()) for at in range(0, len(ids), rows)]

        def batch_of(found):
            return pa.RecordBatch.from_arrays([pa.array([f[0] for f in found], pa.int32()), pa.array([f[1] for f in found], pa.binary()), pa.array([f[2] for f in found], pa.binary())], names=["dim", "ids", "data"])

        for batch in batches:
            ids, column = batch.column("vec_id").to_numpy(), batch.column("embedding")
            lengths = np.asarray(column.value_lengths())
            for dim in np.unique(lengths):
                at = np.flatnonzero(lengths == dim)
                held.setdefault(int(dim), []).append((ids[at], as_matrix(column.take(pa.array(at)))))
                filled[int(dim)] = filled.get(int(dim), 0) + len(at)
                if filled[int(dim)] >= rows:
                    yield batch_of(out(int(dim)))
        for dim in list(held):
            yield batch_of(out(dim))

    dealt = vectors.repartition(max(1, -(-n * 51 // (50 * rows))))
    made = materialize(dealt.mapInArrow(pack, "dim int, ids binary, data binary").withColumn("_no", F.monotonically_increasing_id()), name)
    # One small row a block: numbering them needs their keys only.
    numbers = made.select("_no", "dim").withColumn("block", F.row_number().over(Window.partitionBy("dim").orderBy("_no")) - 1)
    return made.join(numbers.select("_no", "block"), "_no").drop("_no")


def search(candidates: DataFrame, queries: DataFrame, answer, schema: str, query_group: int) -> DataFrame:
    """Rows of ``answer(dim, candidate ids, candidate payloads, query ids, query matrix)`` for every pair of a candidate block and a query group.

    ``candidates`` has (block, dim, ids, ...payloads); ``queries`` is a table of usable vectors. A block goes to as many tasks as there are query groups."""
    groups = blocks(queries, query_group, "query-blocks")
    per_dim = groups.groupBy("dim").agg(F.count(F.lit(1)).alias("groups"))
    blocks_per_dim = candidates.groupBy("dim").agg(F.count(F.lit(1)).alias("blocks"))
    left = candidates.join(F.broadcast(per_dim), "dim").withColumn("group", F.explode(F.sequence(F.lit(0).cast("long"), F.col("groups") - 1))).drop("groups")
    right = groups.join(F.broadcast(blocks_per_dim), "dim").select("dim", F.col("block").cast("long").alias("group"), F.col("ids").alias("q_ids"), F.col("data").alias("q_data"), F.explode(F.sequence(F.lit(0), F.col("blocks").cast("int") - 1)).alias("block"))
    pairs = left.join(right, ["dim", "block", "group"])
    payloads = [c for c in candidates.columns if c not in ("block", "dim", "ids")]

    def run(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                row = {c: batch.column(c)[k].as_py() for c in ["dim", "ids", "q_ids", "q_data", *payloads]}
                q_ids = np.frombuffer(row["q_ids"], np.int64)
                q = np.frombuffer(row["q_data"], np.float64).reshape(len(q_ids), row["dim"])
                yield answer(row["dim"], np.frombuffer(row["ids"], np.int64), {c: row[c] for c in payloads}, q_ids, q)

    return pairs.mapInArrow(run, schema)


def best(found: DataFrame, k: int, by: str = "score") -> DataFrame:
    """The k highest scores (by the column ``by``) of each query, ties to the smaller id. Spark keeps k a query before it shuffles."""
    order = Window.partitionBy("query_id").orderBy(F.desc(by), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def one_a_query(queries: DataFrame) -> DataFrame:
    """Queries with each id once; of rows that repeat an id, the one with the smallest vector."""
    return queries.groupBy("vec_id").agg(F.min("embedding").alias("embedding"))
