"""Serving: filtering, sorting and describing a list; nested detail documents; points to route."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def browse(df: DataFrame, *, text: tuple[list[str], str] | None = None, at_least: dict | None = None, at_most: dict | None = None, within: dict | None = None,
           overlaps: dict | None = None, one_of: dict | None = None, include_unrated: tuple[str, float] | None = None) -> DataFrame:
    """The conjunction of the filters given; unknown values fail minima and maxima. text: (columns, needle), without regard to case. within: {array column:
    (low, high)} any element. overlaps: {array column: values}. include_unrated: (column, minimum), null passes."""
    tests: list[Column] = []
    if text and text[1]:
        hits = [F.coalesce(F.contains(F.lower(col), F.lit(text[1].lower())), F.lit(False)) for col in text[0]]
        tests.append(hits[0] if len(hits) == 1 else F.greatest(*hits))
    tests += [F.coalesce(F.col(k) >= v, F.lit(False)) for k, v in (at_least or {}).items() if v is not None]
    tests += [F.coalesce(F.col(k) <= v, F.lit(False)) for k, v in (at_most or {}).items() if v is not None]
    tests += [_any_between(k, *r) for k, r in (within or {}).items() if r]
    tests += [F.arrays_overlap(F.col(k), F.array(*map(F.lit, v))) for k, v in (overlaps or {}).items() if v]
    tests += [F.coalesce(F.col(k).isin(*v), F.lit(False)) for k, v in (one_of or {}).items() if v]
    if include_unrated:
        tests.append(F.col(include_unrated[0]).isNull() | (F.col(include_unrated[0]) >= include_unrated[1]))
    for t in tests:
        df = df.where(t)
    return df


def _any_between(column: str, low, high) -> Column:
    return F.exists(F.col(column), lambda x: x.between(low, high))


def active_filters(**filters) -> int:
    return sum(bool(v) for v in filters.values())


def order_null_last(by: str, descending: bool, *ties: Column) -> list[Column]:
    """Sort keys: unknown values last in both directions, then the ties."""
    return [F.desc_nulls_last(by) if descending else F.asc_nulls_last(by), *ties]


def top_k(df: DataFrame, order: list[Column], k: int, group: list[str] | None = None) -> DataFrame:
    """The first k rows, with their rank; of each group, if one is given."""
    if not group:
        return df.orderBy(*order).limit(k).withColumn("rank", F.row_number().over(Window.orderBy(*order)).cast("long"))
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*group).orderBy(*order)).cast("long")).where(F.col("rank") <= k)


def facets(df: DataFrame, columns: list[str]) -> DataFrame:
    """One row: the sorted distinct values of each column."""
    return df.agg(*(F.array_sort(F.collect_set(x)).alias(x) for x in columns))


def nest(parents: DataFrame, key: str, **children: tuple[DataFrame, list[str]]) -> DataFrame:
    """Parents with an array of structs for each kind of children, in the order of its fields; empty if there are none."""
    for name, (rows, fields) in children.items():
        packed = rows.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(*fields))).alias(name))
        kind = packed.schema[name].dataType.simpleString()
        parents = parents.join(packed, key, "left").withColumn(name, F.coalesce(name, F.array().cast(kind)))
    return parents


def route_chunks(df: DataFrame, lat: str, lon: str, size: int = 60, digits: int = 6) -> DataFrame:
    """Distinct rounded points, each with a chunk of at most `size`; join back by the rounded values. Points are numbered by range
    partitions and places in them, so no task sorts them all."""
    points = df.select(F.round(lat, digits).alias("p_lat"), F.round(lon, digits).alias("p_lon")).where("p_lat IS NOT NULL AND p_lon IS NOT NULL").distinct()
    cell = F.pmod(F.floor(F.col("p_lat") * 10), F.lit(360)) * 4096 + F.pmod(F.floor(F.col("p_lon") * 10), F.lit(4096))
    rows = points.withColumn("cell", cell)
    n = F.row_number().over(Window.partitionBy("cell").orderBy("p_lat", "p_lon")) - 1
    return rows.withColumn("chunk", F.col("cell") * 1_000_000 + F.floor(n / size)).drop("cell")
