"""What a run stores: listings with all that hangs on them, drives, areas, matches. Each write is a new snapshot or the rows to add, told by ids made of content."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ashlar.functions.scalars import effective_rent, promotion, stable_id
from ashlar.operators.cards import commute_sentence, price_sentence, safety_sentence
from ashlar.operators.serving import route_chunks
from ashlar.operators.upserts import fallback, insert_missing, upsert

# Cities whose figures are their parent city's, and the categories that a summary of reviews bears on.
CITY_ALIASES = {"alviso": "San Jose"}
SUMMARY_CATEGORIES = ("noise", "management", "pests", "building_safety", "neighborhood_safety", "other_issues")


def replaced(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Old rows of keys that new rows don't have, and all new rows: a key's rows are replaced whole."""
    return old.join(new.select(key).distinct(), key, "left_anti").unionByName(new)


def listing_rows(listings: DataFrame) -> dict[str, DataFrame]:
    """links, facts, units, prices and fees of collected listings, a row each, with ids that don't change when the same content comes again.

    listings: property, source, listing, url, name, sha, collected, promotions (array of texts), facts (array of struct key, title, content), units (array of struct unit_key,
    label, floorplan, kind, beds, baths, sqft_min, sqft_max, base_min, base_max, total, fees, months, updated), fees (array of struct fee_type, description, amount,
    amount_text, recurring, mandatory). Null arrays are empty. Prices and fees are known by the page's content, so an unchanged page adds none."""
    own = ["property", "source", "listing"]
    link = stable_id("ls", "source", "listing").alias("link")
    text = F.nullif(F.array_join("promotions", " | "), F.lit(""))
    links = listings.select(link, *own, "url", "name", F.col("collected").alias("last_seen"), text.alias("promotion_text"))
    facts = listings.select(*own, "url", "collected", F.explode("facts").alias("f")).select(stable_id("ev", "source", "listing", F.lit("fact"), "f.key").alias("id"), "property", F.lit("listing_fact").alias("kind"), "f.title", "f.content", "url", "collected")
    u = listings.select(link, *own, "url", "sha", "collected", text.alias("promotion_text"), F.explode("units").alias("u"))
    units = u.select(F.concat_ws("/", "link", "u.unit_key").alias("unit"), "link", "property", *(f"u.{x}" for x in ("unit_key", "label", "floorplan", "kind", "beds", "baths", "sqft_min", "sqft_max")))
    p = u.select(stable_id("ev", F.lit("price"), "source", "listing", "u.unit_key", "sha").alias("id"), F.concat_ws("/", "link", "u.unit_key").alias("unit"), "property", "collected", "url", "promotion_text", "u.*")
    offer = promotion("promotion_text")
    prices = p.select("id", "unit", "property", "collected", "url", "base_min", "base_max", "total", "fees", "months", "updated", F.col("promotion_text").isNotNull().alias("promotional"),
                      effective_rent("base_min", "months", offer).alias("effective"), price_sentence().alias("content"))
    f = listings.select(*own, "url", "sha", "collected", F.explode("fees").alias("f"))
    fees = f.select(stable_id("ev", F.lit("fee"), "source", "listing", "f.description", "sha").alias("id"), "property", "collected", "url", "f.fee_type", "f.description", F.when(F.col("f.recurring"), F.col("f.amount")).alias("amount_monthly"),
                    "f.amount_text", "f.mandatory", "f.recurring")
    return {"links": links, "facts": facts, "units": units, "prices": prices, "fees": fees}


def store_listings(old: dict[str, DataFrame], listings: DataFrame) -> dict[str, DataFrame]:
    """The tables after a write: links, facts and units by their key, the new values over the old ones; prices and fees only where their id is new, and of
    repeated ids one."""
    new = listing_rows(listings)
    keys = {"links": ["link"], "facts": ["id"], "units": ["unit"]}
    out = {k: upsert(old[k], new[k].dropDuplicates(v), v) if k in old else new[k].dropDuplicates(v) for k, v in keys.items()}
    for k in ("prices", "fees"):
        out[k] = old[k].unionByName(insert_missing(old[k], new[k], ["id"])) if k in old else new[k].dropDuplicates(["id"])
    return out


def commute_evidence(routes: DataFrame) -> DataFrame:
    """Evidence of drives: property, provider, lat, lon, computed, miles, free_flow, am, pm, rush_status in, an id, the sentence and the figures out."""
    return routes.select(stable_id("ev", F.lit("commute"), "property", "provider", "lat", "lon", F.date_format("computed", "yyyy-MM-dd'T'HH:mm:ss")).alias("id"), "property", F.lit("commute_fact").alias("kind"),
                         F.col("provider").alias("source"), commute_sentence().alias("content"), "computed", "miles", "free_flow", "am", "pm")


def area_evidence(properties: DataFrame, areas: DataFrame) -> DataFrame:
    """Evidence of an area's safety for each property, by its city, or the city that its name stands for. areas: city (lower case), jurisdiction, year, violent, property_crime,
    reason, url, retrieved. A property whose city has no figures gets none here."""
    names = F.create_map(*(F.lit(x.lower()) for kv in CITY_ALIASES.items() for x in kv))
    city = F.lower(F.trim(F.coalesce("city", F.lit(""))))
    p = properties.select("property", F.coalesce(F.element_at(names, city), city).alias("__city"))
    j = p.join(areas, F.col("__city") == F.col("city"))
    return j.select(stable_id("ev", F.lit("safety"), "property", F.coalesce("jurisdiction", "city"), "year", "url").alias("id"), "property", F.lit("safety_fact").alias("kind"),
                    F.concat(F.lit("Reported crime in "), F.coalesce("jurisdiction", "city"), F.lit(" ("), F.col("year").cast("string"), F.lit(")")).alias("title"), safety_sentence().alias("content"), F.col("retrieved").alias("collected"))


def match_outcomes(old: DataFrame, new: DataFrame) -> DataFrame:
    """The outcome of each property's last look-up: a new one replaces the old one whole, unknown values included. Both: property, status, checked and details."""
    rest = [c for c in new.columns if c not in ("property", "checked")]
    last = new.groupBy("property").agg(F.max(F.struct("checked", *rest)).alias("s")).select("property", "s.*")
    return replaced(old, last.select(old.columns), "property")


def summary_evidence(old: DataFrame, new: DataFrame) -> DataFrame:
    """Evidence of summaries that a place's reviews have: one for each text; the same text again only refreshes when it was collected.
    new: property, place, text, fetched; old: id, property, text, first_collected, collected."""
    rows = new.where("text is not null").select(stable_id("ev", F.lit("review_summary"), "place", "text").alias("id"), "property", "text", F.col("fetched").alias("first_collected"), F.col("fetched").alias("collected"))
    one = rows.groupBy("id").agg(*(F.min_by(x, "collected").alias(x) for x in ("property", "text", "first_collected")), F.max("collected").alias("collected"))
    return upsert(old, one.select(old.columns), ["id"], first_seen="first_collected")


def route_many(points: DataFrame, key: str, providers: list[Callable[[DataFrame], DataFrame]], size: int = 60) -> DataFrame:
    """Routes of all located points: distinct rounded points go to the first provider in chunks, what it fails on to the next. A provider takes (p_lat, p_lon, chunk)
    and gives (p_lat, p_lon, ok, seconds, meters). A point without coordinates has no row."""
    chunks = route_chunks(points, "lat", "lon", size)
    id_ = F.concat_ws(",", "p_lat", "p_lon").alias("point")
    out = providers[0](chunks).select(id_, "ok", "seconds", "meters")
    for p in providers[1:]:
        out = fallback(out.drop("provider") if "provider" in out.columns else out, p(chunks).select(id_, "ok", "seconds", "meters"), "point", "ok")
    located = points.where("lat is not null and lon is not null").select(key, F.concat_ws(",", F.round("lat", 6), F.round("lon", 6)).alias("point"))
    return located.join(out, "point").drop("point")

