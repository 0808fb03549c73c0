"""Scores from weighted evidence: sentiment, confidence, themes, trends, outliers, bursts, overall."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ashlar.functions.scalars import age_years, clamp, is_recent, lower_confidence, round_score

# categories' weights in the overall score, and what confidence levels count.
CATEGORY_WEIGHTS = {"commute": 0.25, "noise": 0.20, "management": 0.20, "building_safety": 0.075, "neighborhood_safety": 0.075, "pests": 0.10, "other_issues": 0.10}
CONFIDENCE_VALUES = {"high": 1.0, "medium": 0.66, "low": 0.33}
NEUTRAL_PRIOR = 2.0


def net_sentiment(influence: str = "influence", value: str = "value") -> Column:
    """Aggregate: influence-weighted mean of values, pulled to zero by a neutral prior; 0 without evidence."""
    total = F.sum(influence)
    return F.when(total > 0, F.sum(F.col(influence) * F.col(value)) / (total + NEUTRAL_PRIOR)).otherwise(0.0)


def sentiment_score(net) -> Column:
    return round_score(clamp(5.5 + 4.5 * net, 1.0, 10.0))


def dominant_share(items: DataFrame, group: list[str], review: str, influence: str) -> DataFrame:
    """Per group: the largest share of its influence that one review has."""
    per = items.groupBy(*group, review).agg(F.sum(influence).alias("__i"))
    return per.groupBy(*group).agg(F.when(F.sum("__i") > 0, F.max("__i") / F.sum("__i")).otherwise(0.0).alias("dominant_share"))


def evidence_confidence(items: DataFrame, group: list[str], review: str, source: str, published: str, influence: str, now: Column,
                        least: int = 3, medium: int = 5, high: int = 8, high_recent: int = 4, high_sources: int = 2, high_single: int = 12, dominant: float = 0.5, old: float = 0.7) -> DataFrame:
    """Per group: reviews, recent reviews, sources, dominant share, old share, and confidence: a level by counts, one lower (not below
    low) if one review dominates or most evidence is over four years old. Two aggregations: by review, then by group."""
    per = items.groupBy(*group, review).agg(
        F.max(source).alias("__s"), F.max(is_recent(published, now).cast("int")).alias("__r"), F.sum(influence).alias("__i"),
        F.sum((F.coalesce(age_years(published, now), F.lit(0.0)) > 4).cast("int")).alias("__o"), F.count("*").alias("__n"),
    )
    g = per.groupBy(*group).agg(
        F.count("*").alias("reviews"), F.sum("__r").alias("recent"), F.count_distinct("__s").alias("sources"),
        F.when(F.sum("__i") > 0, F.max("__i") / F.sum("__i")).otherwise(0.0).alias("dominant_share"), (F.sum("__o") / F.sum("__n")).alias("old_share"),
    )
    many = (F.col("reviews") >= high) & (F.col("recent") >= high_recent) & ((F.col("sources") >= high_sources) | (F.col("reviews") >= high_single))
    level = F.when(F.col("reviews") < least, "insufficient").when(many, "high").when(F.col("reviews") >= medium, "medium").otherwise("low")
    lowered = F.when((F.round("dominant_share", 9) > dominant) | (F.round("old_share", 9) > old), lower_confidence(F.col("level"))).otherwise(F.col("level"))
    return g.withColumn("level", level).withColumn("confidence", lowered)


def theme_rollup(items: DataFrame, group: list[str], theme: str, polarity: str, review: str, weight: str, least: int = 1) -> DataFrame:
    """Per group, theme and polarity: distinct reviews (at least `least`), weight, and rank by (reviews, weight, theme, polarity)."""
    g = items.groupBy(*group, theme, polarity).agg(F.count_distinct(review).alias("reviews"), F.sum(weight).alias("weight")).where(F.col("reviews") >= least)
    w = Window.partitionBy(*group).orderBy(F.desc("reviews"), F.desc(F.round("weight", 6)), theme, polarity)
    return g.withColumn("rank", F.row_number().over(w).cast("long"))


def theme_trends(items: DataFrame, group: list[str], theme: str, review: str, is_new: Column, least: int = 3, change: float = 0.15, top: int = 5) -> DataFrame:
    """Per group: themes whose share of reviews changed between two periods, both with enough reviews; the `top` largest changes."""
    rows = items.withColumn("__new", is_new)
    totals = rows.groupBy(*group).agg(F.count_distinct(F.when(F.col("__new"), F.col(review))).alias("new_reviews"), F.count_distinct(F.when(~F.col("__new"), F.col(review))).alias("old_reviews"))
    per = rows.groupBy(*group, theme).agg(F.count_distinct(F.when(F.col("__new"), F.col(review))).alias("n_new"), F.count_distinct(F.when(~F.col("__new"), F.col(review))).alias("n_old"))
    j = per.join(totals, group).where((F.col("new_reviews") >= least) & (F.col("old_reviews") >= least))
    j = j.withColumn("change", F.col("n_new") / F.col("new_reviews") - F.col("n_old") / F.col("old_reviews")).where(F.abs("change") >= change)
    w = Window.partitionBy(*group).orderBy(F.desc(F.round(F.abs("change"), 9)), theme)
    return j.withColumn("rank", F.row_number().over(w).cast("long")).where(F.col("rank") <= top)


def outliers(df: DataFrame, group: list[str], value: str, gap: float, least: int = 3) -> DataFrame:
    """Rows at least `gap` from their group's mean, in groups of `least` or more. Means are aggregated and joined back. A row just at the gap is one, in whatever order the mean
    was added up: 1e-9 is allowed for binary fractions."""
    g = df.groupBy(*group).agg(F.avg(value).alias("mean"), F.count(value).alias("n")).where(F.col("n") >= least)
    return df.join(g, group).where(F.abs(F.col(value) - F.col("mean")) >= gap - 1e-9)


def age_histogram(df: DataFrame, published: str, now: Column) -> DataFrame:
    """Rows by age: five fixed buckets, empty ones with 0."""
    age = age_years(published, now)
    bucket = F.when(age.isNull(), 4).when(age <= 2, 0).when(age <= 4, 1).when(age <= 7, 2).otherwise(3)
    counts = df.groupBy(bucket.alias("b")).agg(F.count("*").alias("n"))
    names = df.sparkSession.createDataFrame([(0, "0-2"), (1, "2-4"), (2, "4-7"), (3, "7+"), (4, "unknown")], "b int, bucket string")
    return names.join(counts, "b", "left").select("bucket", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def bursts(df: DataFrame, group: list[str], moment: str, row: str, days: int, least: int = 3, share: float = 0.4, out_of: int = 5) -> DataFrame:
    """Per group: the window of `days` from a row on that holds most rows (the earliest of equals); kept if it has `least` rows, which
    are `share` or more of at least `out_of`."""
    seconds = F.unix_seconds(F.col(moment).cast("timestamp"))
    w = Window.partitionBy(*group).orderBy("__s").rangeBetween(0, days * 86400)
    rows = df.where(F.col(moment).isNotNull()).withColumn("__s", seconds).withColumn("__n", F.count("*").over(w))
    best = F.max(F.struct(F.col("__n"), -F.col("__s"), -F.col(row)))
    g = rows.groupBy(*group).agg(best.alias("b"), F.count("*").alias("total"))
    g = g.select(*group, F.col("b.__n").alias("burst"), (-F.col("b.col3")).alias("anchor"), "total")
    return g.where((F.col("burst") >= least) & (F.col("total") >= out_of) & (F.col("burst") / F.col("total") >= share))


def recurrences(df: DataFrame, group: list[str], moment: str, tie: str, days: int) -> DataFrame:
    """Per group: consecutive rows at most `days` whole days apart, and the smallest gap."""
    w = Window.partitionBy(*group).orderBy(moment, tie)
    gap = F.floor((F.unix_seconds(F.col(moment).cast("timestamp")) - F.unix_seconds(F.lag(moment).over(w).cast("timestamp"))) / 86400)
    g = df.withColumn("__gap", gap).groupBy(*group).agg(F.count_if(F.col("__gap") <= days).alias("repeats"), F.min("__gap").alias("least_gap"))
    return g.where("repeats > 0")


def overall_score(scores: DataFrame, entity: str, category: str, score: str, confidence: str) -> DataFrame:
    """Per entity: the weighted mean of its scored categories' scores, weights renormalised; null with under 2 categories or 30 % of
    the weight. Confidence by the weighted sum of levels."""
    def of(values: dict) -> Column:
        return F.element_at(F.create_map(*(F.lit(x) for kv in values.items() for x in kv)), F.col(category) if values is CATEGORY_WEIGHTS else F.col(confidence))

    good = F.col(score).isNotNull() & of(CATEGORY_WEIGHTS).isNotNull() & of(CONFIDENCE_VALUES).isNotNull()
    w = F.when(good, of(CATEGORY_WEIGHTS))
    g = scores.groupBy(entity).agg(F.count(w).alias("categories"), F.coalesce(F.round(F.sum(w), 6), F.lit(0.0)).alias("coverage"), F.sum(w * F.col(score)).alias("__s"), F.sum(w * of(CONFIDENCE_VALUES)).alias("__c"))
    enough = (F.col("categories") >= 2) & (F.col("coverage") >= 0.30)
    index = F.round("__c", 6)
    level = F.when(~enough, "insufficient").when(index >= 0.70, "high").when(index >= 0.45, "medium").otherwise("low")
    return g.select(entity, "categories", "coverage", F.when(enough, round_score(F.col("__s") / F.col("coverage"))).alias("score"), level.alias("confidence"))
