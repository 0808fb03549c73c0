"""Official figures: crimes by agency and year, residents by place, and rates against the state's."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ashlar.functions.scalars import rate_per_1000

CRIMES = T.StructType([T.StructField(n, T.StringType()) for n in ("Year", "County", "NCICCode", "Violent_sum", "Homicide_sum", "Property_sum", "Burglary_sum")])


def read_crimes(spark: SparkSession, path: str) -> DataFrame:
    """year, county, agency and counts of a CSV; blanks are unknown; rows without a year or an agency are left out."""
    df = spark.read.schema(CRIMES).option("header", True).csv(path)
    whole = lambda n: F.trim(n).try_cast("int")
    out = df.select(whole("Year").alias("year"), F.trim("County").alias("county"), F.trim("NCICCode").alias("agency"), whole("Violent_sum").alias("violent"), whole("Homicide_sum").alias("homicide"), whole("Property_sum").alias("property"), whole("Burglary_sum").alias("burglary"))
    return out.where("year is not null and agency <> ''")


def latest_file(files: DataFrame) -> DataFrame:
    """Of files (url, end_year, created): the newest year's, the last created."""
    return files.agg(F.max_by("url", F.struct("end_year", "created")).alias("url"))


@F.pandas_udf(T.StringType())
def normalize_place(names: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for b in names:
        yield b.map(lambda s: None if s is None else " ".join(unicodedata.normalize("NFKD", s).encode("ascii", "ignore").decode().lower().replace("-", " ").replace(",", " ").split()))


def fill_counties(rows: DataFrame, order: str, label: str, is_county) -> DataFrame:
    """Rows of a sheet under their county: county lines are carried down and left out. A sheet is one small file's lines."""
    w = Window.partitionBy("sheet").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("__c", is_county).withColumn("county", F.last(F.when(F.col("__c"), F.col(label)), ignorenulls=True).over(w)).where(~F.col("__c")).drop("__c")


def nearest_year(df: DataFrame, keys: list[str], year: str, value: str, target: int) -> DataFrame:
    """Per key: the value of the year nearest to the target, the later of two as near."""
    return df.where(F.col(value).isNotNull()).groupBy(*keys).agg(F.min_by(value, F.struct(F.abs(F.col(year) - target), -F.col(year))).alias(value))


def area_rates(crimes: DataFrame, residents: DataFrame, candidates: DataFrame) -> DataFrame:
    """Per city: rates per 1 000 of its latest reported year and of all agencies together. candidates: (city, ordinal, county, agency), tried in order;
    residents: (city, residents). Cities that no agency matches keep null rates."""
    w = Window.partitionBy("county", "agency").orderBy(F.desc("year"))
    latest = crimes.withColumn("rn", F.row_number().over(w)).where("rn = 1").drop("rn")
    hit = candidates.join(latest, ["county", "agency"]).groupBy("city").agg(F.min_by(F.struct("year", "violent", "property"), "ordinal").alias("c"))
    j = residents.join(hit, "city", "left").select("city", "residents", "c.*")
    state = j.agg((F.sum("violent") * 1000 / F.sum(F.when(F.col("violent").isNotNull(), F.col("residents")))).alias("state_violent"), (F.sum("property") * 1000 / F.sum(F.when(F.col("property").isNotNull(), F.col("residents")))).alias("state_property"))
    return j.crossJoin(F.broadcast(state)).select("city", "year", rate_per_1000("violent", "residents").alias("violent_per_1000"), rate_per_1000("property", "residents").alias("property_per_1000"), F.round("state_violent", 2).alias("state_violent"), F.round("state_property", 2).alias("state_property"))  # one row
