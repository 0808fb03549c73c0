"""Cards and sentences: what a list and a detail page show of an entity, in words, and in which order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ashlar.functions.scalars import c, conjugate, is_recent
from ashlar.operators.scoring import CATEGORY_WEIGHTS

# How many bedrooms are called, the order of issues, confidence levels in order.
BEDS = {0: "Studio", 1: "1 bedroom"}
ISSUE_RANKS = {"recurring_current": 0, "recurring_old": 1, "isolated": 2}
CONFIDENCE = {"insufficient": 0, "low": 1, "medium": 2, "high": 3}
MOST_TOPICS = 6


def _of(values: dict, key: Column) -> Column:
    return F.element_at(F.create_map(*(F.lit(x) for kv in values.items() for x in kv)), key)


def _dollars(x, digits: int = 0) -> Column:
    return F.concat(F.lit("$"), F.format_number(c(x).cast("double"), digits))


def _span(low: Column, high: Column, show) -> Column:
    return F.when(low.eqNullSafe(high) | high.isNull(), show(low)).otherwise(F.concat(show(low), F.lit("–"), show(high)))


# -- sentences


def price_sentence(beds="beds", label="label", floorplan="floorplan", low="base_min", high="base_max", total="total", fees="fees", months="months", sqft_min="sqft_min", sqft_max="sqft_max") -> Column:
    """A unit's price in words: what it is, its base rent or only the total, the total where it differs, term and size as far as they are known."""
    beds, low, high, total = c(beds), c(low), c(high), c(total)
    what = F.when(beds.isNull(), "Unknown bedrooms").otherwise(F.coalesce(_of(BEDS, beds.cast("int")), F.concat(beds.cast("string"), F.lit(" bedroom"))))
    where = F.when(F.coalesce(c(label), F.lit("")) != "", F.concat(F.lit("unit "), c(label))).otherwise(F.concat(F.lit("floor plan "), F.coalesce(F.nullif(c(floorplan), F.lit("")), F.lit("unnamed"))))
    price = F.when(low.isNotNull(), F.concat(F.lit("advertised base rent "), _span(low, high, _dollars))).otherwise(F.concat(F.lit("total price "), _dollars(total), F.lit(" (base rent not published separately)")))
    more = F.when((total > 0) & (total != low), F.concat(F.lit("published total "), _dollars(total, 2), F.lit(" including "), _dollars(F.coalesce(c(fees), F.lit(0)), 2), F.lit(" required monthly fees")))
    term = F.when(c(months) > 0, F.concat(c(months).cast("string"), F.lit("-month lease")))
    number = lambda x: F.format_number(x.cast("double"), 0)
    size = F.when(c(sqft_min) > 0, F.concat(_span(c(sqft_min), c(sqft_max), number), F.lit(" sq ft")))
    return F.concat_ws("; ", F.concat(what, F.lit(", "), where, F.lit(": "), price), more, term, size)


def commute_sentence(miles="miles", free="free_flow", am="am", pm="pm", status="rush_status") -> Column:
    """A drive in words: distance and free-flow time, and both rush hours or why they are unknown."""
    drive = F.format_string("%.1f miles; %.0f min free-flow driving time (no traffic)", c(miles).cast("double"), c(free).cast("double"))
    rush = F.when(c(am).isNotNull() & c(pm).isNotNull(), F.format_string("; weekday rush hour: %.0f min AM, %.0f min PM (predicted)", c(am).cast("double"), c(pm).cast("double"))).otherwise(
        F.concat(F.lit(". Rush hour: "), F.coalesce(c(status), F.lit(""))))
    return F.when(c(miles).isNull() | c(free).isNull(), F.concat(F.lit("No drivable route found. "), F.coalesce(c(status), F.lit("")))).otherwise(F.concat(drive, rush))


def safety_sentence(jurisdiction="jurisdiction", year="year", violent="violent", prop="property_crime", reason="reason") -> Column:
    """An area's reported crime in words, or why there are no figures."""
    rate = lambda x: F.when(c(x).isNull(), "unknown").otherwise(F.format_string("%.2f", c(x).cast("double")))
    said = F.concat(c(jurisdiction), F.lit(" "), c(year).cast("string"), F.lit(": "), rate(violent), F.lit(" violent and "), rate(prop), F.lit(" property crimes per 1,000 residents"))
    return F.when(c(violent).isNull() & c(prop).isNull(), F.coalesce(c(reason), F.lit("No figures."))).otherwise(said)


def year_span(dates: Column) -> Column:
    """The years of an array of dates: one, or the first and the last; null without dates."""
    years = F.transform(F.filter(dates, lambda d: d.isNotNull()), lambda d: F.year(d))
    low, high = F.array_min(years), F.array_max(years)
    return F.when(low == high, low.cast("string")).otherwise(F.concat(low.cast("string"), F.lit("–"), high.cast("string")))


def age_qualifier(dates: Column, noun: str = "mention") -> Column:
    """How old what is cited is, where none of it is recent."""
    known, n = F.size(F.filter(dates, lambda d: d.isNotNull())), F.size(dates)
    return (
        F.when(known == 0, F.when(n == 1, "review date unavailable").otherwise("review dates unavailable"))
        .when(known < n, F.concat(F.lit(f"{noun}s from "), year_span(dates), F.lit(" or undated")))
        .when(n == 1, F.concat(F.lit(f"{noun} from "), year_span(dates))).otherwise(F.concat(F.lit(f"all {noun}s from "), year_span(dates)))
    )


def recency_note(dates: Column, now: Column, noun: str = "mention") -> Column:
    """note and is_current of an array of dates: how many are from the last two years, or how old all are."""
    recent, n = F.size(F.filter(dates, lambda d: is_recent(d, now))), F.size(dates)
    note = F.when(recent == 0, age_qualifier(dates, noun)).when(recent < n, F.concat(recent.cast("string"), F.lit(" from the last 2 years"))).when(n == 1, "from the last 2 years").otherwise("all from the last 2 years")
    return F.struct(note.alias("note"), (recent > 0).alias("is_current"))


def theme_label(theme) -> Column:
    """A theme's name in words: underlines are blanks, the first letter is a capital."""
    words = F.replace(c(theme), F.lit("_"), F.lit(" "))
    return F.concat(F.upper(F.left(words, F.lit(1))), F.substring(words, 2, 1 << 20))


def counted(n: Column, word: str) -> Column:
    return F.concat(n.cast("string"), F.when(n == 1, f" {word}").otherwise(f" {word}s"))


def theme_claim(theme, dates: Column, now: Column, annotation=None) -> Column:
    """What so many reviews mention, and how recent they are."""
    n = F.size(dates)
    said = conjugate(F.concat(F.lit("mention "), F.lower(theme_label(theme))), n)
    more = F.lit("") if annotation is None else F.when(c(annotation).isNull(), "").otherwise(F.concat(F.lit(" — "), c(annotation)))
    return F.concat(counted(n, "review"), F.lit(" "), said, more, F.lit(" ("), recency_note(dates, now)["note"], F.lit(")."))


def clean_list(values) -> Column:
    """The distinct texts of a list in order, blanks collapsed, empty ones left out."""
    return F.array_distinct(F.filter(F.transform(c(values), lambda v: F.trim(F.regexp_replace(v, r"\s+", " "))), lambda v: v != ""))


def scalar_details(document, exclude: tuple[str, ...] = ()) -> Column:
    """Of a JSON object the members that are texts, numbers or truth values, as a map of texts; lists, objects and nulls are left out."""
    m = F.from_json(c(document), "map<string,string>")
    return F.map_filter(m, lambda k, v: v.isNotNull() & ~v.rlike(r"^\s*[\[{]") & (~k.isin(*exclude) if exclude else F.lit(True)))


# -- orders

#: What a list can be sorted by: where the value is, and whether the largest comes first by default.
SORT_KEYS = {
    "overall": ("overall", True), "monthly_total": ("est_total_min", False), "base_rent": ("rent_min", False), "commute": ("free_flow_minutes", False), "noise": ("noise", True),
    "management": ("management", True), "pests": ("pests", True), "building_safety": ("building_safety", True), "neighborhood_safety": ("neighborhood_safety", True),
    "review_rating": ("coalesce(CASE WHEN panel_status = 'ok' THEN panel_rating END, review_average)", True), "google_rating": ("CASE WHEN panel_status = 'ok' THEN panel_rating END", True),
    "confidence": ("element_at(map('insufficient', 0, 'low', 1, 'medium', 2, 'high', 3), confidence)", True),
}


def sort_order(key: str, descending: bool | None = None) -> list[Column]:
    """Sort keys of a list of cards: the value, unknown ones last either way, then the overall score, the name and the id. An unknown key is the overall score."""
    value, down = SORT_KEYS.get(key, SORT_KEYS["overall"])
    e = F.expr(value)
    return [e.desc_nulls_last() if (down if descending is None else descending) else e.asc_nulls_last(), F.desc_nulls_last("overall"), F.asc("name"), F.asc("id")]


def unit_order() -> list[Column]:
    """Units as shown: those that qualify first, then by bedrooms and rent, unknown ones last, then by label and id."""
    return [F.desc("qualifies"), F.coalesce(F.col("beds"), F.lit(99)).asc(), F.asc_nulls_last("base_min"), F.asc_nulls_last("label"), F.asc("unit_id")]


def issue_order() -> list[Column]:
    """Issues: current ones that recur, old ones that do, isolated ones; each by reviews, then theme."""
    return [_of(ISSUE_RANKS, F.col("status")).asc(), F.desc("reviews"), F.asc("theme")]


# -- figures of a card


def other_sources_average(ratings: DataFrame, entity: str, primary: str) -> DataFrame:
    """Per entity: ratings' mean on a scale of five, weighted by count, without the primary source, to two digits; and their count."""
    used = ratings.where((F.col("source") != primary) & (F.col("n") > 0) & F.col("average").isNotNull())
    g = used.groupBy(entity).agg(F.sum(F.col("average") * 5 / F.col("scale") * F.col("n")).alias("s"), F.sum("n").alias("n"))
    return g.select(entity, F.round(F.col("s") / F.col("n"), 2).alias("average"), "n")


def fee_differences(units: DataFrame, listing: str) -> DataFrame:
    """Per listing: what its units' totals exceed their base rents by, the distinct differences of zero or more: one fee, or a range."""
    d = F.col("total") - F.col("base")
    g = units.where(d >= 0).groupBy(listing).agg(F.array_sort(F.collect_set(d)).alias("differences"))
    low, high = F.array_min("differences"), F.array_max("differences")
    text = F.when(low == high, F.concat(_dollars(low), F.lit("/mo"))).otherwise(F.concat(_dollars(low), F.lit("–"), _dollars(high), F.lit("/mo")))
    return g.select(listing, F.size("differences").alias("n"), F.when(low == high, low).alias("amount"), text.alias("text"))


def comments_summary(mentions: DataFrame, reviews: DataFrame, entity: str, now: Column, days: int = 730, most: int = MOST_TOPICS) -> DataFrame:
    """Per entity with review texts: complaints and praise by how many reviews say so, the `most` commonest of each, equals by theme; and whether all texts
    are old. mentions: entity, review, theme, polarity; reviews: entity, review, published, text. Counts are aggregated before they are ranked."""
    texts = reviews.where(F.trim(F.coalesce("text", F.lit(""))) != "")
    counts = mentions.where(F.col("polarity").isin("negative", "positive")).groupBy(entity, "polarity", "theme").agg(F.count_distinct("review").alias("n"))
    w = Window.partitionBy(entity, "polarity").orderBy(F.desc("n"), "theme")
    top = counts.withColumn("k", F.row_number().over(w)).where(F.col("k") <= most)
    said = F.concat(F.lower(theme_label("theme")), F.lit(" ("), counted(F.col("n"), "review"), F.lit(")"))
    lines = top.groupBy(entity).agg(*(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("polarity") == p, F.struct("k", said.alias("t"))))), lambda x: x["t"]), "; ").alias(p) for p in ("negative", "positive")))
    old = F.timestamp_diff("SECOND", F.col("published"), now) > days * 86400
    per = texts.groupBy(entity).agg(F.count("*").alias("reviews"), F.min(F.coalesce(old, F.lit(False))).alias("old"))
    none = lambda x: F.coalesce(F.nullif(F.col(x), F.lit("")), F.lit("none identified"))
    both = F.concat(F.lit("Complaints: "), none("negative"), F.lit(". Praise: "), none("positive"), F.lit("."))
    text = F.when(F.col("negative").isNull(), "No specific complaints or praise topics found in the review texts.").otherwise(both)
    late = F.when(F.col("old"), F.lit("All of these reviews are more than 2 years old."))
    return per.join(lines, entity, "left").select(entity, "reviews", F.concat_ws(" ", text, late).alias("text"))


def summary_cards(entities: DataFrame, units: DataFrame, assessments: DataFrame, listings: DataFrame, entity: str, rent: tuple[float, float]) -> DataFrame:
    """A card for each entity, wide: unit types, rents, sizes and dates of the units that qualify, the scores of all categories, and its sources.

    units: entity, qualifies, beds, base_min, base_max, sqft_min, sqft_max, promotional, collected; assessments: entity, category, score, confidence; listings:
    entity, source. Each side is one aggregate by the entity, so the joins meet rows that are already where they belong."""
    q = units.where("qualifies")
    rents = F.array_compact(F.array("base_min", "base_max"))
    within = F.filter(F.flatten(F.collect_list(rents)), lambda r: r.between(*rent))
    g = q.groupBy(entity).agg(
        F.array_sort(F.collect_set(F.when(F.col("beds") == 0, "studio").otherwise("1br"))).alias("types"), F.min("base_min").alias("rent_min"),
        F.max(F.coalesce("base_max", "base_min")).alias("rent_max"), F.array_sort(F.array_distinct(within)).alias("qualifying_rents"), F.max("promotional").alias("has_promotion"),
        F.min(F.least("sqft_min", "sqft_max")).alias("sqft_min"), F.max(F.greatest("sqft_min", "sqft_max")).alias("sqft_max"), F.max("collected").alias("last_verified"),
    ).withColumn("unit_types", F.when(F.array_contains("types", "studio"), F.array_prepend(F.array_remove("types", "studio"), "studio")).otherwise(F.col("types"))).drop("types")
    pick = lambda x, k: F.max(F.when(F.col("category") == k, F.col(x)))
    s = assessments.groupBy(entity).agg(*(pick("score", k).alias(k) for k in CATEGORY_WEIGHTS), *(pick("confidence", k).alias(f"{k}_confidence") for k in CATEGORY_WEIGHTS))
    l = listings.groupBy(entity).agg(F.array_sort(F.collect_set("source")).alias("sources"))  # noqa: E741
    out = entities.join(g, entity, "left").join(s, entity, "left").join(l, entity, "left")
    out = out.withColumns({f"{k}_confidence": F.coalesce(f"{k}_confidence", F.lit("insufficient")) for k in CATEGORY_WEIGHTS})
    empty = F.array().cast("array<string>")
    return out.withColumns({"unit_types": F.coalesce("unit_types", empty), "sources": F.coalesce("sources", empty), "has_promotion": F.coalesce("has_promotion", F.lit(False))})


def review_panel(entities: DataFrame, reviews: DataFrame, quality: DataFrame, themes: DataFrame, entity: str, most: int = 5) -> DataFrame:
    """Per entity: the themes praised and criticised most, how good its review data are, or that there are none, or that they weren't evaluated, and how many
    reviews it has. quality: entity, confidence, summary; themes: entity, theme, polarity, reviews."""
    w = Window.partitionBy(entity, "polarity").orderBy(F.desc("reviews"), "theme")
    top = themes.withColumn("k", F.row_number().over(w)).where(F.col("k") <= most)
    listed = lambda p: F.transform(F.array_sort(F.collect_list(F.when(F.col("polarity") == p, F.struct("k", "theme", "reviews")))), lambda x: x["theme"])
    t = top.groupBy(entity).agg(listed("positive").alias("praised"), listed("negative").alias("criticized"))
    n = reviews.groupBy(entity).agg(F.count("*").alias("n_reviews"))
    j = entities.join(n, entity, "left").join(quality, entity, "left").join(t, entity, "left").withColumn("n_reviews", F.coalesce("n_reviews", F.lit(0)))
    missing = F.when(F.col("n_reviews") == 0, "Review data: No reviews found").otherwise("Not evaluated yet.")
    empty = F.array().cast("array<string>")
    return j.select(entity, "n_reviews", F.coalesce("confidence", F.lit("insufficient")).alias("confidence"), F.when(F.col("confidence").isNull(), missing).otherwise(F.col("summary")).alias("summary"), F.coalesce("praised", empty).alias("praised"), F.coalesce("criticized", empty).alias("criticized"))


def review_inputs(reviews: DataFrame, evidence: DataFrame, entity: str) -> DataFrame:
    """What is evaluated of each entity: its reviews with the text and date of their evidence, and the latest summary of its reviews, marked as one. reviews: entity, evidence_id,
    rating; evidence: entity, evidence_id, kind, source, content, published, collected. Reviews without evidence are left out."""
    own = evidence.where("kind = 'review'").select("evidence_id", "source", F.col("content").alias("text"), "published")
    listed = reviews.join(own, "evidence_id").select(entity, "evidence_id", "source", "rating", "text", "published", F.lit(False).alias("is_summary"))
    fields = F.struct("collected", "evidence_id", "source", "content", "published")
    last = evidence.where("kind = 'review_summary'").groupBy(entity).agg(F.max(fields).alias("s")).select(
        entity, "s.evidence_id", "s.source", F.lit(None).cast(listed.schema["rating"].dataType).alias("rating"), F.col("s.content").alias("text"), "s.published", F.lit(True).alias("is_summary"))
    return listed.unionByName(last)


def context(entities: DataFrame, entity: str, latest: dict[str, tuple[DataFrame, list[str]]], whole: dict[str, DataFrame]) -> DataFrame:
    """Entities with all that a page of theirs needs: of each table in `latest` (with its order) the last row as a struct, null if there is none; of each in `whole` all
    rows as an array of structs, empty if there are none. A table is aggregated by the entity before it is joined."""
    out = entities
    for name, (df, order) in latest.items():
        rest = [c for c in df.columns if c not in (entity, *order)]
        out = out.join(df.groupBy(entity).agg(F.max(F.struct(*order, *rest)).alias(name)), entity, "left")
    for name, df in whole.items():
        rows = df.groupBy(entity).agg(F.array_sort(F.collect_list(F.struct(*[c for c in df.columns if c != entity]))).alias(name))
        empty = F.array().cast(rows.schema[name].dataType)
        out = out.join(rows, entity, "left").withColumn(name, F.coalesce(name, empty))
    return out


def intelligence(items: DataFrame, entity: str, now: Column, least: int = 2, most: int = 5) -> DataFrame:
    """Per entity, polarity and theme: reviews and how many of them are recent, of themes that `least` reviews share, the `most` commonest of each polarity, equals by theme.
    items: entity, review, theme, polarity, published."""
    one = items.where(F.col("polarity").isin("positive", "negative")).groupBy(entity, "polarity", "theme", "review").agg(F.max(is_recent("published", now).cast("int")).alias("new"))
    g = one.groupBy(entity, "polarity", "theme").agg(F.count("*").alias("reviews"), F.sum("new").alias("recent")).where(F.col("reviews") >= least)
    w = Window.partitionBy(entity, "polarity").orderBy(F.desc("reviews"), "theme")
    return g.withColumn("rank", F.row_number().over(w).cast("long")).where(F.col("rank") <= most)
