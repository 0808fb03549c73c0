"""Streams of observations. A test or a catch-up runs them with availableNow and compares with the batch form."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ashlar.tables import filesystem, shared_dir


def read_stream(spark: SparkSession, path: str, event_time: str | None = None, files_per_batch: int = 1000) -> DataFrame:
    """A folder of Parquet files, or one file, as a stream. Times without a zone become UTC times, which watermarks need."""
    schema = spark.read.parquet(path).schema
    folder, _, name = path.rstrip("/").rpartition("/")
    fs, p = filesystem(spark, path)
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch)
    df = reader.parquet(path) if fs.getFileStatus(p).isDirectory() else reader.option("pathGlobFilter", name).parquet(folder)
    return df.withColumn(event_time, F.col(event_time).cast("timestamp")) if event_time else df


def tumbling(df: DataFrame, event_time: str, width: str, late: str, keys: list[str], *aggs: Column) -> DataFrame:
    """Aggregates of fixed windows. Rows later than `late` behind the newest are dropped; a window closes when that has passed."""
    return df.withWatermark(event_time, late).groupBy(F.window(event_time, width), *keys).agg(*aggs)


def sliding(df: DataFrame, event_time: str, width: str, step: str, late: str, keys: list[str], *aggs: Column) -> DataFrame:
    return df.withWatermark(event_time, late).groupBy(F.window(event_time, width, step), *keys).agg(*aggs)


def sessions(df: DataFrame, event_time: str, gap: str, late: str, keys: list[str], *aggs: Column) -> DataFrame:
    """Aggregates of sessions: rows of a key less than `gap` apart."""
    return df.withWatermark(event_time, late).groupBy(F.session_window(event_time, gap), *keys).agg(*aggs)


def first_seen(df: DataFrame, event_time: str, late: str, keys: list[str]) -> DataFrame:
    """Each key once while its repeats come within `late`: ingestion that can be repeated."""
    return df.withWatermark(event_time, late).dropDuplicatesWithinWatermark(keys)


def monthly_calls(df: DataFrame, event_time: str, keys: list[str]) -> DataFrame:
    """Calls of each calendar month, Pacific time; months aren't of one length, so they are keys and not windows."""
    month = F.date_format(F.from_utc_timestamp(event_time, "America/Los_Angeles"), "yyyy-MM")
    return df.groupBy(month.alias("period"), *keys).agg(F.count("*").alias("calls"))


def drain(df: DataFrame, mode: str = "append") -> DataFrame:
    """Runs a stream over all that is there and returns what it wrote. Output and checkpoint are in the shared folder, so a driver
    or an executor may be lost and the stream go on where it was; complete and update modes are kept by batch."""
    spark, root = df.sparkSession, shared_dir(df.sparkSession)
    out = f"{root}/out"
    writer = df.writeStream.outputMode(mode).option("checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True)
    if mode == "append":
        q = writer.format("parquet").option("path", out).start()
    else:
        q = writer.foreachBatch(lambda batch, n: batch.write.mode("overwrite").parquet(f"{out}/batch={n}")).start()
    q.awaitTermination()
    fs, p = filesystem(spark, root)
    fs.deleteOnExit(p)
    got = spark.read.schema(df.schema)
    if mode == "append":
        return got.parquet(out)
    rows = spark.read.parquet(out)
    if mode == "complete":
        last = rows.agg(F.max("batch")).first()[0]
        return rows.where(F.col("batch") == last).drop("batch")
    return rows


def latest_by_key(df: DataFrame, keys: list[str], order: list[str], target: str | None = None) -> DataFrame:
    """The newest row of each key as a table kept by foreachBatch: each batch is joined into the version before it, and a new version
    written. The checkpoint is kept under the target, so a later run goes on with what came since, and the version to go on from is
    read from the folder: a batch that runs twice, or in a new process, joins into the same one. Late rows count by their time."""
    spark, root = df.sparkSession, (target or shared_dir(df.sparkSession)).rstrip("/")
    top = [*order, *(c for c in df.columns if c not in keys and c not in order)]
    fs, root_path = filesystem(spark, root)
    fs.mkdirs(root_path)

    def versions() -> list[int]:
        """Versions that were written whole, in order."""
        names = [s.getPath() for s in fs.listStatus(root_path) if s.getPath().getName().startswith("version=")]
        done = [p for p in names if fs.exists(spark._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS"))]
        return sorted(int(p.getName()[8:]) for p in done)

    def path(n: int) -> str:
        return f"{root}/version={n:010d}"

    def step(batch: DataFrame, n: int) -> None:
        new = batch.groupBy(*keys).agg(F.max(F.struct(*top)).alias("s"))
        before = [v for v in versions() if v < n]
        if before:
            new = new.unionByName(batch.sparkSession.read.parquet(path(before[-1]))).groupBy(*keys).agg(F.max("s").alias("s"))
        new.write.mode("overwrite").parquet(path(n))

    q = df.writeStream.option("checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True).foreachBatch(step).start()
    q.awaitTermination()
    if not target:
        fs.deleteOnExit(root_path)
    done = versions()
    if not done:
        return spark.createDataFrame([], df.schema).select(*keys, *top)
    return spark.read.parquet(path(done[-1])).select(*keys, "s.*")
