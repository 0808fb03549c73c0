"""What operators share: cutting lineage, and joins that no key can skew."""

from __future__ import annotations

import math
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """A fresh path in the folder that every node shares (spark.checkpoint.dir). Where that is unset, a local session gets a folder of its
    own; on a cluster it is an error."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.conf.get("spark.master", "")):  # driver and executor are one process
            raise ValueError("set spark.checkpoint.dir to a folder that all nodes share")
        root = f"file://{tempfile.gettempdir()}/ashlar-shared"
    return f"{root.rstrip('/')}/{uuid.uuid4().hex}"


def filesystem(spark: SparkSession, path: str):
    """The Hadoop file system and path object of a path."""
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def cut(df: DataFrame, codec: str | None = None) -> DataFrame:
    """Writes df as Parquet in the shared folder and reads it back: lineage ends there and any executor may be lost.
    The files go when the session's JVM ends, or by discard(). codec: their compression, the session's if it isn't told."""
    spark = df.sparkSession
    path = shared_dir(spark)
    (df.write.option("compression", codec) if codec else df.write).parquet(path)
    fs, p = filesystem(spark, path)
    fs.deleteOnExit(p)
    out = spark.read.schema(df.schema).parquet(path)
    out.cut_path = path
    return out


def discard(*cuts: DataFrame) -> None:
    """Deletes the files of what cut() gave; nothing may read them any more."""
    for df in cuts:
        fs, p = filesystem(df.sparkSession, df.cut_path)
        fs.delete(p, True)


#: Rows that a task of dealt() gets.
TASK_ROWS = 500_000


def tasks_for(rows: int, spark: SparkSession) -> int | None:
    """Into how many tasks so many rows are dealt for TASK_ROWS each; None if they are few."""
    return max(math.ceil(rows / TASK_ROWS), spark.sparkContext.defaultParallelism) if rows > TASK_ROWS else None


def dealt(df: DataFrame, keys: list[str], tasks: int | None) -> DataFrame:
    """df dealt by its keys to so many tasks, or as it is if None. What is joined or grouped by these keys then needs the memory of a task's share of rows, however
    many rows there are; the adaptive plan would join small shuffled rows to fewer and larger tasks."""
    return df if tasks is None else df.repartition(tasks, *keys)


def spread(df: DataFrame, keys: list[str]) -> DataFrame:
    """df, a table's own few columns, dealt by its keys to as many tasks as its number of rows asks for: work on each row then isn't left to the few tasks that small files make."""
    return dealt(df, keys, tasks_for(df.count(), df.sparkSession))


def met(left: DataFrame, right: DataFrame, keys: list[str], tasks: int | None, how: str = "inner") -> DataFrame:
    """Join of two tables dealt by the keys to so many tasks. Then neither is broadcast: files say little of how many rows are made of them, and columns of numbers are small in files
    and large in memory."""
    right = dealt(right, keys, tasks)
    return dealt(left, keys, tasks).join(right if tasks is None else right.hint("merge"), keys, how)


def apart(df: DataFrame, rows: int) -> DataFrame:
    """df as a side of a join of so many rows: shuffled, never broadcast, if they are many. Numbers are small in files, so a file's size would have all of them sent through the driver."""
    return df.hint("merge") if rows > TASK_ROWS else df


#: A key is heavy if it has over 1/HEAVY_SHARE of the rows, so there are fewer than HEAVY_SHARE heavy keys.
HEAVY_SHARE = 1000
HEAVY_LEAST = 1000


def skew_join(left: DataFrame, right: DataFrame, keys: list[str], count: str, total: int) -> DataFrame:
    """Left join of `right` (unique non-null keys) to `left`, whatever the spread of the keys.

    count: right's column with the number of left rows of a key, or an upper bound that sums to `total` or less.
    Keys with over total/HEAVY_SHARE rows are fewer than HEAVY_SHARE, so they are broadcast: the bound holds for any
    input. All other keys are joined by shuffle, rows of heavy keys spread at random beside them.
    """
    values = [c for c in right.columns if c not in keys]
    least = max(HEAVY_LEAST, total // HEAVY_SHARE)
    heavy = right.where(F.col(count) > least).select(*keys, F.struct(*values).alias("__heavy"))
    light = right.where(F.col(count) <= least).select(*keys, F.struct(*values).alias("__light"), F.when(F.col(count) < 0, 1).otherwise(0).alias("__spread"))  # never 1, but no constant: a constant key would be taken out of the join
    spread = F.when(F.col("__heavy").isNull(), 0).otherwise(1 + F.pmod(F.xxhash64(*left.columns), F.lit(1 << 20)).cast("int"))
    out = left.join(F.broadcast(heavy), keys, "left").withColumn("__spread", spread).join(apart(light, total), [*keys, "__spread"], "left")
    both = F.coalesce("__heavy", "__light")
    return out.select(*left.columns, *(both[v].alias(v) for v in values))
