"""Reading and writing tables."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


#: Rows of a task where rows are sorted and grouped by keys that hardly repeat: what a task holds then follows from rows, which Spark's own target of bytes a partition doesn't show.
TASK_ROWS = 250_000


def tasks(df: DataFrame, task_rows: int = TASK_ROWS) -> int:
    """Number of tasks that take ``task_rows`` rows of ``df`` each."""
    return max(1, -(-df.count() // task_rows))


def csv_records(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """CSV with a header that must name the schema's columns in order; blanks are null."""
    expected = spark.createDataFrame([], schema).columns
    found = spark.read.option("header", True).csv(path).columns
    if found and found[0].startswith("﻿"):
        found[0] = found[0].removeprefix("﻿")
    if found != expected:
        raise ValueError(f"header {found} isn't {expected}")
    return spark.read.option("header", True).option("nullValue", "").schema(schema).csv(path)


def append_new(new: DataFrame, path: str, keys: list[str]) -> None:
    """Append the rows whose keys the Parquet ledger at ``path`` doesn't hold yet (written by one writer at a time)."""
    spark = new.sparkSession
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fresh = new.dropDuplicates(keys)
    if where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where):
        fresh = fresh.join(spark.read.parquet(path).select(*keys), keys, "left_anti")
    fresh.write.mode("append").parquet(path)


def adapt(records: DataFrame, bindings: dict[str, str]) -> DataFrame:
    """Source columns to canonical fields, as rows (record, field, raw value) of those that are there."""
    there = {source: field for source, field in bindings.items() if source in records.columns}
    pairs = F.array(*[F.struct(F.lit(field).alias("field"), F.col(source).cast("string").alias("raw")) for source, field in there.items()])
    return records.select("*", F.explode(pairs).alias("_pair")).select(*[c for c in records.columns if c not in there], "_pair.field", "_pair.raw")


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder name below the shared one that the cluster names; below a temporary one only in a local session that names none (tests)."""
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not shared and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return f"{(shared or tempfile.mkdtemp(prefix='meridix-')).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once to the scratch folder and read back: what follows starts from files that any executor can read."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
