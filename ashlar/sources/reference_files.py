"""Reference files (figures that an authority publishes once a year, say): kept by content, read again only when they changed, decoded by what their bytes allow."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ashlar.functions.scalars import seconds_between

KEPT = "path string, modified timestamp, length long, sha256 string, text string, encoding string, cut_off boolean, read_at timestamp"
_MARK = "﻿"


def decoded(content) -> Column:
    """Struct of text, encoding and cut_off of a file's bytes. UTF-8 where they are valid, without the mark that may begin them; also where only the last character is cut off (up to three bytes are left out, and cut_off
    says so); Latin-1 otherwise, which any bytes are. Null stays null, an empty file is an empty text."""
    b = F.col(content) if isinstance(content, str) else content

    def utf8(less: int) -> Column:
        part = b.cast("string") if not less else F.substring(b, F.lit(1), F.length(b) - less).cast("string")
        return F.when((F.length(b) >= less) & F.is_valid_utf8(part), part)

    # What is left out must be the beginning of a longer character. One byte is that of a Latin-1 letter as well: it counts only after other characters of several bytes.
    starts = {1: "^(C[2-9A-F]|D.|E.|F[0-4])$", 2: "^(E.|F[0-4])[89AB].$", 3: "^F[0-4][89AB].[89AB].$"}

    def begun(less: int) -> Column:
        part = utf8(less)
        known = F.octet_length(part) > F.length(part) if less == 1 else F.lit(True)
        return F.when(F.hex(F.substring(b, F.length(b) - less + 1, F.lit(less))).rlike(starts[less]) & known, part)

    whole, cut_ = utf8(0), F.coalesce(*(begun(n) for n in (1, 2, 3)))
    text = F.coalesce(whole, cut_)
    plain = F.when(F.startswith(text, F.lit(_MARK)), F.substring(text, F.lit(2), F.length(text))).otherwise(text)
    kind = F.when(text.isNull(), "latin-1").when(F.startswith(text, F.lit(_MARK)), "utf-8 with mark").otherwise("utf-8")
    return F.when(b.isNotNull(), F.struct(F.coalesce(plain, F.decode(b, "ISO-8859-1")).alias("text"), kind.alias("encoding"), (whole.isNull() & cut_.isNotNull()).alias("cut_off")))


def no_files(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], KEPT)


def refreshed(spark: SparkSession, folder: str, kept: DataFrame, now: Column, pattern: str = "*") -> tuple[DataFrame, list[str]]:
    """The files of a folder as KEPT rows, and the paths that were read. Files that have the time and length they had are taken from `kept`, without opening them; others are read. Files that are gone are left out.

    The listing doesn't read contents; the paths of changed files go to the driver, as those of any table's files do.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern)
    there = files.load(folder).select("path", F.col("modificationTime").alias("modified"), "length")
    same = there.join(kept, ["path", "modified", "length"])
    paths = [r["path"] for r in there.join(kept, ["path", "modified", "length"], "left_anti").select("path").sort("path").collect()]
    if not paths:
        return same.select(*no_files(spark).columns), []
    new = spark.read.format("binaryFile").load(paths).withColumn("d", decoded("content"))
    new = new.select("path", F.col("modificationTime").alias("modified"), "length", F.sha2("content", 256).alias("sha256"), "d.text", "d.encoding", "d.cut_off", now.cast("timestamp").alias("read_at"))
    return same.select(*new.columns).unionByName(new), paths


def in_time(kept: DataFrame, now: Column, most_days: float) -> DataFrame:
    """Files that were read at most so many days ago: others must be asked for again."""
    return kept.where(seconds_between("read_at", now) <= most_days * 86_400)


def contents(kept: DataFrame) -> DataFrame:
    """sha256, text, paths: each different content once, with the paths that hold it."""
    return kept.groupBy("sha256").agg(F.min("text").alias("text"), F.array_sort(F.collect_set("path")).alias("paths"))
