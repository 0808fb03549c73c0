"""Upserts as joins: plain Parquet tables have no MERGE, so a new snapshot is made from the old one and the changes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def upsert(old: DataFrame, new: DataFrame, keys: list[str], first_seen: str | None = None) -> DataFrame:
    """Old and new rows by key; a new row's known values replace the old ones, its unknown ones don't. first_seen, if named, keeps the old value."""
    values = [c for c in old.columns if c not in keys]
    o = old.select(*keys, F.struct(*values).alias("__o"))
    n = new.select(*keys, F.struct(*values).alias("__n"))
    j = o.join(n, keys, "full")
    pick = [F.coalesce(*((F.col(f"__o.{v}"), F.col(f"__n.{v}")) if v == first_seen else (F.col(f"__n.{v}"), F.col(f"__o.{v}")))).alias(v) for v in values]
    return j.select(*keys, *pick)


def insert_missing(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """New rows whose key is not there yet, one a key should new ones repeat."""
    return new.join(old.select(*keys), keys, "left_anti").dropDuplicates(keys)


def survivors(df: DataFrame, entity: str, preferred: str, moment: str, tie: str, attributes: list[str]) -> DataFrame:
    """Per entity: each attribute's value from the preferred source, latest first, else from any; unknown values never win."""
    rank = F.struct(F.col(preferred), F.col(moment), F.col(tie))
    return df.groupBy(entity).agg(*(F.max_by(a, F.when(F.col(a).isNotNull(), rank)).alias(a) for a in attributes))


def fallback(primary: DataFrame, secondary: DataFrame, key: str, ok: str) -> DataFrame:
    """Primary rows that succeeded; for the others the secondary's rows, marked so."""
    good = primary.where(F.col(ok)).withColumn("provider", F.lit("primary"))
    rest = primary.where(~F.coalesce(F.col(ok), F.lit(False))).select(key)
    return good.unionByName(secondary.join(rest, key, "left_semi").withColumn("provider", F.lit("secondary")))
