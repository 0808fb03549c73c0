"""Review quality, resident safety, rated places: assessments that combine several signals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ashlar.functions.scalars import age_years, clamp, crime_ratio, is_recent, overlap, ratio_score, round_score
from ashlar.operators.matching import class_members, near_duplicate_pairs
from ashlar.operators.scoring import bursts

LEVELS = ("low", "medium", "high")


def rating_conflict(ratings: DataFrame, entity: list[str], source: str, average: str, gap: float = 1.0) -> DataFrame:
    """Per entity: the best and the worst source by (average, source), if they are `gap` or more apart."""
    key = F.struct(average, source)
    g = ratings.where(F.col(average).isNotNull()).groupBy(*entity).agg(F.max(key).alias("b"), F.min(key).alias("w"))
    return g.where(F.col(f"b.{average}") - F.col(f"w.{average}") >= gap).select(*entity, F.col(f"b.{source}").alias("best"), F.col(f"w.{source}").alias("worst"), (F.col(f"b.{average}") - F.col(f"w.{average}")).alias("gap"))


def source_concentration(reviews: DataFrame, entity: str, source: str) -> DataFrame:
    """Per entity: reviews, sources and the largest source's share."""
    per = reviews.groupBy(entity, source).agg(F.count("*").alias("n"))
    return per.groupBy(entity).agg(F.sum("n").alias("reviews"), F.count("*").alias("sources"), (F.max("n") / F.sum("n")).alias("share"))


def management_changes(reviews: DataFrame, mentions: DataFrame, entity: str, review: str, published: str) -> DataFrame:
    """Per entity with a mention of a change: mentions, the earliest dated one, dated reviews before it, and whether those are most."""
    change = mentions.where("theme = 'management_change'").select(review).distinct().join(reviews, review)
    g = change.groupBy(entity).agg(F.count("*").alias("mentions"), F.min(published).alias("earliest"))
    j = reviews.join(g, entity)
    before = F.coalesce(F.col(published) < F.col("earliest"), F.lit(False))
    return j.groupBy(entity, "mentions", "earliest").agg(F.count_if(before).alias("before"), (F.count_if(before) * 2 > F.count("*")).alias("mostly_before"))


def review_quality(reviews: DataFrame, mentions: DataFrame, ratings: DataFrame, now: Column, concentration: float = 0.8) -> DataFrame:
    """Per property: confidence in its reviews. By counts (15 reviews, 5 recent, 2 sources, none over 80 %: high; 8 and 2: medium; else low); one
    level lower, not below low, for each of: a burst, near-duplicate texts, most reviews from before a change of management, sources that
    disagree, one source with over 80 %. Low without a recent review. reviews: review, property, source, published, text; ratings: property, source, average."""
    p = "property"
    base = reviews.groupBy(p).agg(F.count_if(is_recent("published", now)).alias("recent")).join(source_concentration(reviews, p, "source"), p)
    burst = bursts(reviews.select(p, "review", "published"), [p], "published", "review", 14).select(p, F.lit(True).alias("burst"))
    equal = class_members(reviews, p, "review", "text").groupBy(p, "words").agg(F.count("*").alias("n")).where("n > 1")
    copies = near_duplicate_pairs(reviews, p, "review", "text").select(p).union(equal.select(p)).distinct().withColumn("copies", F.lit(True))
    change = management_changes(reviews.drop("text"), mentions, p, "review", "published").where("mostly_before").select(p, F.lit(True).alias("changed"))
    clash = rating_conflict(ratings, [p], "source", "average").select(p, F.lit(True).alias("clash"))
    j = base
    for other in (burst, copies, change, clash):
        j = j.join(other, p, "left")
    flags = [F.coalesce(f, F.lit(False)) for f in ("burst", "copies", "changed", "clash")] + [F.col("share") > concentration]
    high = (F.col("reviews") >= 15) & (F.col("recent") >= 5) & (F.col("sources") >= 2) & (F.col("share") <= 0.8)
    level = F.when(high, 2).when((F.col("reviews") >= 8) & (F.col("recent") >= 2), 1).otherwise(0)
    steps = sum((f.cast("int") for f in flags), F.lit(0))
    final = F.when(F.col("recent") == 0, 0).otherwise(F.greatest(F.lit(0), level - steps))
    name = lambda n: F.element_at(F.array(*map(F.lit, LEVELS)), n + 1)
    return j.select(p, "reviews", "recent", "sources", F.round("share", 4).alias("share"), name(level).alias("base"), steps.alias("lowered"), name(final).alias("confidence"))


def neighborhood_safety(areas: DataFrame, residents: DataFrame) -> DataFrame:
    """Per property: .6 of the violent and .4 of the property crime ratio's score (renormalised if one is unknown), moved by up to 1 by residents if three
    or more report. areas: property, rates and reference rates; residents: property, reports, net."""
    a = areas.select("property", ratio_score(crime_ratio("violent", "ref_violent")).alias("v"), ratio_score(crime_ratio("property_crime", "ref_property")).alias("q"))
    weight = F.when(F.col("v").isNotNull(), 0.6).otherwise(0.0) + F.when(F.col("q").isNotNull(), 0.4).otherwise(0.0)
    official = (F.coalesce(F.col("v") * 0.6, F.lit(0.0)) + F.coalesce(F.col("q") * 0.4, F.lit(0.0))) / F.when(weight > 0, weight)
    j = a.withColumn("official", official).join(residents, "property", "left")
    move = F.when(F.col("reports") >= 3, F.round("net", 2)).otherwise(0.0)
    return j.select("property", round_score(F.col("official")).alias("official"), move.alias("adjustment"), round_score(clamp(F.col("official") + move, 1.0, 10.0)).alias("score"), F.when(F.col("official").isNull(), "insufficient").otherwise("low").alias("confidence"))


def place_confidence(meters, same_number, name_share) -> Column:
    """exact, probable, weak or null for a place found for a query: by distance, house number and shared name."""
    m, n, s = (x if isinstance(x, Column) else F.col(x) for x in (meters, name_share, same_number))
    s = F.coalesce(s, F.lit(False))
    return (
        F.when((m <= 100) & s & (n >= 0.5), "exact").when((m <= 150) & (s | (n >= 0.6)), "probable").when((m <= 500) & (n >= 0.5), "weak")
    )


def best_place(candidates: DataFrame, key: str) -> DataFrame:
    """Per query: the candidate of the best confidence, the nearest of those. candidates: key, place, meters, same_number, query_words, place_words."""
    c = candidates.withColumn("confidence", place_confidence("meters", "same_number", overlap("query_words", "place_words"))).where("confidence is not null")
    rank = F.when(F.col("confidence") == "exact", 0).when(F.col("confidence") == "probable", 1).otherwise(2)
    return c.groupBy(key).agg(F.min_by(F.struct("place", "confidence", "meters"), F.struct(rank, "meters", "place")).alias("b")).select(key, "b.*")


def age_note(published: Column, now: Column) -> Column:
    """What to say of evidence by its age."""
    age = age_years(published, now)
    return F.when(age.isNull(), "undated").when(age <= 2, "current").when(age <= 4, "older").otherwise("old")
