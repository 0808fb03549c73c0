"""Prices: ranges, points, conflicts between sources, cheapest totals, the cascade of hard filters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ashlar.functions.scalars import c
from ashlar.tables import dealt, tasks_for


def endpoint_in_range(low, high, least: float, most: float) -> Column:
    """Whether either end of a price range is a positive price from least to most; a range that only straddles them is not."""
    ends = [F.coalesce(c(p).between(least, most) & (c(p) > 0), F.lit(False)) for p in (low, high)]
    return ends[0] | ends[1]


def price_points(df: DataFrame, keys: list[str], low: str, high: str, label: str, unit: str) -> DataFrame:
    """Per key: least and greatest price, the first four labels, and the distinct unit keys, sorted."""
    return df.groupBy(*keys).agg(
        F.min(low).alias("base_min"), F.max(F.coalesce(high, low)).alias("base_max"),
        F.slice(F.array_sort(F.collect_set(label)), 1, 4).alias("labels"), F.array_sort(F.collect_set(unit)).alias("unit_keys"),
    )


def price_conflicts(points: DataFrame, source: str, block: list[str], size: str, tolerance: float = 0.02, gap: float = 50.0) -> DataFrame:
    """Pairs of sources whose price ranges for one plan lie apart: same block (beds), sizes within the tolerance of the larger,
    not known to be different units, and a gap over `gap` and over the tolerance of the cheaper. The join is on the block and on
    a band of the size's logarithm and its neighbours, so only sizes that can be near meet."""
    band = F.floor(F.log(F.col(size)) / -F.log(F.lit(1 - tolerance)))
    p = points.where(F.col(size) > 0).withColumn("__band", band)
    cols = [source, size, "base_min", "base_max", "unit_keys"]
    a = p.select(*block, F.explode(F.array(F.col("__band") - 1, F.col("__band"), F.col("__band") + 1)).alias("__band"), *(F.col(x).alias(f"a_{x}") for x in cols))
    b = p.select(*block, "__band", *(F.col(x).alias(f"b_{x}") for x in cols))
    apart = F.greatest(F.col("b_base_min") - F.col("a_base_max"), F.col("a_base_min") - F.col("b_base_max"))
    j = a.join(b, [*block, "__band"]).where(F.col(f"a_{source}") < F.col(f"b_{source}"))
    j = j.where(F.abs(F.col(f"a_{size}") - F.col(f"b_{size}")) <= F.greatest(f"a_{size}", f"b_{size}") * tolerance)
    j = j.where((F.size("a_unit_keys") == 0) | (F.size("b_unit_keys") == 0) | F.arrays_overlap("a_unit_keys", "b_unit_keys"))
    j = j.withColumn("difference", apart).where(F.col("difference") > F.greatest(F.lit(gap), tolerance * F.least("a_base_min", "b_base_min")))
    return j.drop("__band", "a_unit_keys", "b_unit_keys")


def spread_restrictions(df: DataFrame, keys: list[str], restricted: Column, out: str = "restricted") -> DataFrame:
    """Marks every row whose key is restricted in some row; rows with a null key only by themselves."""
    df = dealt(df, keys, tasks_for(df.count(), df.sparkSession))
    marked = df.where(restricted).select(*keys).distinct().withColumn("__m", F.lit(True))
    return df.join(marked, keys, "left").withColumn(out, F.coalesce("__m", restricted, F.lit(False))).drop("__m")


def cascade(*steps: tuple[Column, str, str], otherwise: str = "included") -> Column:
    """Struct (status, reason) of the first step whose condition fails: (must hold, status, reason). Unknown counts as failing."""
    out = None
    for holds, status, reason in steps:
        fails, value = ~F.coalesce(holds, F.lit(False)), F.struct(F.lit(status).alias("status"), F.lit(reason).alias("reason"))
        out = F.when(fails, value) if out is None else out.when(fails, value)
    return out.otherwise(F.struct(F.lit(otherwise).alias("status"), F.lit("").alias("reason")))


def verification_status(conflict, qualifies, known) -> Column:
    return F.when(c(conflict), "conflict").when(c(qualifies), "verified").when(c(known), "stale").otherwise("none")


def rating_decision(df: DataFrame, entity: list[str], average: str, count: str, confidence: str, low: float = 3.0, least: int = 3, gap: float = 1.0) -> DataFrame:
    """Per entity: status no_reviews, insufficient, ok, low_rating or conflict, and the pooled rating, from the
    ratings (on one scale) of credible sources with enough reviews."""
    usable = (F.col(count) > 0) & F.col(average).isNotNull()
    credible = usable & F.col(confidence).isin("exact", "probable")
    solid = credible & (F.col(count) >= least)
    r = F.col(average)
    g = df.groupBy(*entity).agg(
        F.count(F.when(usable, 1)).alias("usable"), F.count(F.when(solid, 1)).alias("solid"),
        F.min(F.when(solid & (r < low), r)).alias("least_low"), F.max(F.when(solid & (r >= low), r)).alias("most_ok"),
        (F.sum(F.when(solid, r * F.col(count))) / F.sum(F.when(solid, F.col(count)))).alias("pooled"),
    )
    status = (
        F.when(F.col("usable") == 0, "no_reviews").when(F.col("solid") == 0, "insufficient").when(F.col("least_low").isNull(), "ok").when(F.col("most_ok").isNull(), "low_rating")
        .when(F.col("most_ok") - F.col("least_low") >= gap, "conflict").when(F.col("pooled") < low, "low_rating").otherwise("ok")
    )
    return g.select(*entity, status.alias("status"), "solid", F.round("pooled", 4).alias("pooled"))


def cheapest_total(units: DataFrame, fees: DataFrame, entity: str, base: str, own_fee: str, fee: str) -> DataFrame:
    """Per entity: the least of base and fees over its units, a unit's own fees if known, else the entity's required ones, else none;
    of equal totals the lower base. Fees are summed once per entity and joined."""
    sums = fees.groupBy(entity).agg(F.sum(fee).alias("__declared"))
    u = units.join(sums, entity, "left").withColumn("__fees", F.coalesce(F.col(own_fee), F.col("__declared"), F.lit(0)))
    best = F.min(F.struct((F.col(base) + F.col("__fees")).alias("total"), F.col(base).alias("base"), F.col("__fees").alias("fees")))
    return u.where(F.col(base).isNotNull()).groupBy(entity).agg(best.alias("b")).select(entity, "b.total", "b.base", "b.fees")
