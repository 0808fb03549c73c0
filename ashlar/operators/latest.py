"""Latest per key, ties, current flags, fill-down, islands, running budgets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def latest_per_key(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key in the order given, which should have no ties. The limit of one row a key is
    applied before the shuffle as well."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("__rn", F.row_number().over(w)).where("__rn = 1").drop("__rn")


def latest_batch(df: DataFrame, keys: list[str], moment: str) -> DataFrame:
    """All rows of each key at its latest moment, ties included."""
    w = Window.partitionBy(*keys).orderBy(F.desc_nulls_last(moment))
    return df.withColumn("__rk", F.rank().over(w)).where("__rk = 1").drop("__rk")


def flag_current(df: DataFrame, group: list[str], moment: str, out: str = "is_current") -> DataFrame:
    """Whether a row is as late as the latest of its group. The maxima are aggregated before the shuffle and joined back."""
    top = df.groupBy(*group).agg(F.max(moment).alias("__top"))
    return df.join(top, group).withColumn(out, F.coalesce(F.col(moment) >= F.col("__top"), F.lit(False))).drop("__top")


def fill_down(df: DataFrame, group: list[str], order: list[Column], value: Column, out: str) -> DataFrame:
    """The last known value at or before each row of its group."""
    w = Window.partitionBy(*group).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn(out, F.last(value, ignorenulls=True).over(w))


def islands(df: DataFrame, group: list[str], order: list[Column], bad: Column, least: int) -> DataFrame:
    """Runs of `least` or more consecutive rows for which `bad` holds: group, island, length, and the first and last `order` row number."""
    w = Window.partitionBy(*group).orderBy(*order)
    rows = df.withColumn("__bad", F.coalesce(bad, F.lit(False))).withColumn("__rn", F.row_number().over(w))
    rows = rows.withColumn("__run", F.sum((~F.col("__bad")).cast("int")).over(w)).where("__bad")
    return rows.groupBy(*group, F.col("__run").alias("island")).agg(F.count("*").alias("length"), F.min("__rn").cast("long").alias("first_row"), F.max("__rn").cast("long").alias("last_row")).where(F.col("length") >= least)


def within_budget(df: DataFrame, period: list[str], order: list[Column], budget: int, cap: int, out: str = "allowed") -> DataFrame:
    """Numbers the calls of a period in order and allows them while the budget lasts; the budget is held to 0 and the cap."""
    w = Window.partitionBy(*period).orderBy(*order)
    return df.withColumn("call_no", F.row_number().over(w).cast("long")).withColumn(out, F.col("call_no") <= max(0, min(budget, cap)))
