"""Pages whose JSON is read as VARIANT: cards of search pages, whatever a walk through all of a value finds, and pages that several readers are tried on.

Values are taken apart by `variant_explode` beside their row, level by level, and paths by `try_variant_get`; what isn't JSON or has another type is
null, so no page can end a job.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ashlar.functions.scalars import as_float, as_int, bed_range, c
from ashlar.sources.pages import json_ld
from ashlar.tables import cut, discard

# What a listing's address looks like, and the type of blocks that have prices.
LISTING_PATH = r"/(?:apartment|home)/(\d+)"
OFFER_TYPE = "Product"


def variant_of(json) -> Column:
    """The VARIANT of a JSON text; null if it isn't one, or if it holds a key twice."""
    return F.try_parse_json(c(json))


def text_at(v: Column, path: str) -> Column:
    return F.try_variant_get(v, path, "string")


def exploded(df: DataFrame, column: str, pos: str = "pos", name: str = "name", value: str = "value") -> DataFrame:
    """df's rows, one for each item of an array or member of an object in `column`: its place, its name (of members) and its value. Other values have none."""
    spark = df.sparkSession
    return df.lateralJoin(spark.tvf.variant_explode(F.col(column).outer()).select(F.col("pos").alias(pos), F.col("key").alias(name), F.col("value").alias(value)))


def search_cards(pages: DataFrame, key: str, html: str) -> DataFrame:
    """key, listing_id, url, name, city, lat, lon, price, beds: the cards of search pages.

    A page's ld+json blocks that are arrays hold places and offers. Those of one block that have the same address are one card: the last place with the last offer; a place without an offer has no
    price, an offer without a place is no card. Of cards of one listing the one whose address came last stays. Prices are the least of all its plans, so they hold for each of `beds` as a
    lower bound only. Blocks that aren't JSON or no arrays, items that are no objects, and addresses without a listing's number are passed over. Rows of one key are one page.
    Places meet offers in one aggregation by page, block and address, first in the tasks.
    """
    blocks = pages.select(F.col(key).alias("page"), F.posexplode(json_ld(html)).alias("block", "text")).select("page", "block", variant_of("text").alias("v"))
    items = exploded(blocks.where(F.startswith(F.schema_of_variant("v"), F.lit("ARRAY"))), "v").select("page", "block", "pos", F.col("value").alias("item"))
    items = items.where(F.startswith(F.schema_of_variant("item"), F.lit("OBJECT"))).withColumn("url", text_at(F.col("item"), "$.url"))
    offer = F.coalesce(text_at(F.col("item"), "$['@type']") == OFFER_TYPE, F.lit(False))
    item = F.col("item")
    place = F.struct(
        F.element_at(F.split(F.coalesce(text_at(item, "$.name"), F.lit("")), " - "), 1).alias("name"), text_at(item, "$.address.streetAddress").alias("street"), text_at(item, "$.address.addressLocality").alias("city"),
        as_float(text_at(item, "$.geo.latitude")).alias("lat"), as_float(text_at(item, "$.geo.longitude")).alias("lon"), text_at(item, "$.numberOfRooms").alias("rooms"))
    known = items.where("url IS NOT NULL").select("page", "block", "url", "pos", offer.alias("offer"), place.alias("place"), as_int(text_at(item, "$.offers.price")).alias("price"))
    there = ~F.col("offer")
    cards = known.groupBy("page", "block", "url").agg(
        F.min(F.when(there, F.col("pos"))).alias("first"), F.max(F.when(there, F.struct("pos", "place"))).alias("place"), F.max(F.when(F.col("offer"), F.struct("pos", "price"))).alias("offer"))
    cards = cards.where("place IS NOT NULL").withColumn("listing_id", F.nullif(F.regexp_extract("url", LISTING_PATH, 1), F.lit(""))).where("listing_id IS NOT NULL")
    last = cards.groupBy("page", "listing_id").agg(F.max(F.struct("block", "first", "url", F.col("place.place").alias("place"), F.col("offer.price").alias("price"))).alias("c"))
    p = F.col("c.place")
    name = F.coalesce(F.nullif(F.trim(p["name"]), F.lit("")), F.nullif(p["street"], F.lit("")), F.col("c.url"))
    beds = F.coalesce(bed_range(p["rooms"]), F.array().cast("array<int>"))
    return last.select(F.col("page").alias(key), "listing_id", "c.url", name.alias("name"), p["city"].alias("city"), p["lat"].alias("lat"), p["lon"].alias("lon"), "c.price", beds.alias("beds"))


#: Levels that a walk goes down before it writes what is left: lineage stays short, and shallow values take one job.
LEVELS = 4


def walked(df: DataFrame, key: str, value: str) -> DataFrame:
    """key, path (names and places from the top), name (of members), value: every value inside the VARIANT `value` of each row, however deep; the value itself isn't one of them.

    Level by level: what is an object or an array goes on. Each round's rows are written to the shared folder; their number is that of the values inside, and a deep value makes more rounds, not more
    rows. Rows of a null value have none. Rows are told apart by their path and key; of rows that share a key all values are given.
    """
    now = df.select(F.col(key).alias("k"), F.array().cast("array<string>").alias("path"), F.lit(None).cast("string").alias("name"), F.col(value).alias("v")).where("v IS NOT NULL")
    out = []
    nested = F.schema_of_variant("v").rlike("^(OBJECT|ARRAY)")
    while True:
        rounds, parts = now, []
        for _ in range(LEVELS):
            step = exploded(rounds.where(nested).select("k", "path", "v"), "v", name="n")
            rounds = step.select("k", F.concat("path", F.array(F.coalesce("n", F.col("pos").cast("string")))).alias("path"), F.col("n").alias("name"), F.col("value").alias("v"))
            parts.append(rounds)
        level = parts[0]
        for p in parts[1:]:
            level = level.unionByName(p)
        depth = len(out) * LEVELS
        found = cut(level)
        out.append(found)
        now = found.where(F.size("path") == depth + LEVELS)
        if now.where(nested).isEmpty():
            break
    whole = out[0]
    for p in out[1:]:
        whole = whole.unionByName(p)
    return whole.select(F.col("k").alias(key), "path", "name", F.col("v").alias("value"))


# What pages say of the network that their listings are fed by.
NETWORK = "Zillow Group"
STATEMENT = "part of Zillow Group"
FOOTER, FOOTER_ITEM = "Trulia Corporate", "About Zillow Group"
NOT_SAID = ("__typename", "logoUrl", "url")


def feed_signals(df: DataFrame, key: str, document: str) -> DataFrame:
    """key, signals, history_sources, property_id, network, independent: what a listing's JSON says of the feed that it came by. One row for each key whose document says something.

    signals, in this order, each kind sorted and each once: sources of the price history; attributions of the listing's source, at any depth; the network's own id of the property; statements, at any depth, that the page is part of the network,
    and a footer that lists it. Documents that aren't JSON say nothing. Rows of one key are one document. No walk has a limit of depth.
    """
    docs = df.select(F.col(key).alias("k"), variant_of(document).alias("v")).where("v IS NOT NULL")
    history = exploded(docs.select("k", F.try_variant_get("v", "$.priceHistory", "variant").alias("v")).where(F.startswith(F.schema_of_variant("v"), F.lit("ARRAY"))), "v")
    known = F.trim(F.when(F.schema_of_variant("s") == "STRING", F.try_variant_get("s", "$", "string")))
    said = history.select("k", F.try_variant_get("value", "$.source", "variant").alias("s")).select("k", known.alias("s")).where("s NOT IN ('', 'N/A')")
    said = said.select("k", F.lit(0).alias("kind"), F.col("s").alias("what"))
    inside = walked(docs, "k", "v")
    text = F.when(F.schema_of_variant("value") == "STRING", F.try_variant_get("value", "$", "string"))
    texts = inside.select("k", "path", "name", F.trim(text).alias("s")).where("s <> '' AND name IS NOT NULL")
    source = F.slice("path", 1, 3) == F.array(*map(F.lit, ("activeListing", "provider", "listingSource")))
    attributed = texts.where(source & F.get("path", F.lit(3)).isin("attribution", "alternativeSources") & ~F.col("name").isin(*NOT_SAID)).select("k", F.lit(1).alias("kind"), F.col("s").alias("what"))
    kept = F.regexp_extract(text_at(F.col("v"), "$.typedHomeId"), "^(.*)_ZPID$", 1)
    ids = docs.select("k", F.lit(2).alias("kind"), F.nullif(kept, F.lit("")).alias("what")).where("what IS NOT NULL")
    stated = texts.where((F.col("name") != "label") & F.contains("s", F.lit(STATEMENT))).select("k", F.lit(3).alias("kind"), F.concat(F.lit('page states "'), "s", F.lit('"')).alias("what"))
    items = F.coalesce(F.try_variant_get("value", "$.children", "array<variant>"), F.array().cast("array<variant>"))
    listed = F.exists(items, lambda x: F.coalesce(F.try_variant_get(x, "$.label", "string") == FOOTER_ITEM, F.lit(False)))
    tops = inside.select("k", "value").unionByName(docs.select("k", F.col("v").alias("value")))
    footer = tops.where((text_at(F.col("value"), "$.label") == FOOTER) & listed).select("k", F.lit(4).alias("kind"), F.lit(f'page lists "{FOOTER_ITEM}" under "{FOOTER}"').alias("what"))
    found = said.unionByName(attributed).unionByName(ids).unionByName(stated).unionByName(footer)
    before = F.element_at(F.array(F.lit("price history source: "), F.lit("listing source attribution: "), F.lit("listed under Zillow property ID (zpid) "), F.lit(""), F.lit("")), F.col("kind") + 1)
    g = found.distinct().groupBy("k").agg(
        F.array_sort(F.collect_list(F.struct("kind", F.concat(before, "what").alias("what")))).alias("all"), F.array_sort(F.collect_set(F.when(F.col("kind") == 0, F.col("what")))).alias("history_sources"), F.max(F.when(F.col("kind") == 2, F.col("what"))).alias("property_id"))
    return g.select(F.col("k").alias(key), F.transform("all", lambda x: x["what"]).alias("signals"), "history_sources", "property_id", F.lit(NETWORK).alias("network"), F.lit(False).alias("independent"))


@dataclass(frozen=True)
class Reader:
    """How pages of a platform are read, by expressions of the page's text: whether it shows the platform's sign, the VARIANT of its data, and the data's units, an array of structs of UNITS."""

    name: str
    sign: Callable[[Column], Column]
    data: Callable[[Column], Column]
    units: Callable[[Column], Column]


UNITS = "array<struct<unit_key:string,kind:string,beds:int,baths:double,sqft:int,base_min:double,base_max:double,total:double>>"


@dataclass(frozen=True)
class Readings:
    """rows: key, reader, unit (struct), of each unit read; failures: key, reader, reason, of each reader that was tried on a page and failed; of both, pages without units that were read all the same have a row of
    a null unit. discard() deletes what was written for them."""

    rows: DataFrame
    failures: DataFrame
    written: DataFrame

    def discard(self) -> None:
        discard(self.written)


def read_in_turn(pages: DataFrame, key: str, html: str, readers: list[Reader]) -> Readings:
    """Reads pages by the first of `readers` that can, in their order; one pass, two outputs.

    A reader is tried on pages that show its sign and that no reader before it could read. It fails for a reason: the page has no data of the platform ("no data"; also what isn't JSON), or
    the data has no list of units ("no units"). A page that shows no sign has one failure, without a reader ("no platform"); a null page too. An empty list of units is an answer. Each page ends in `rows` or in `failures`.
    """
    page = F.col("page")
    df = pages.select(F.col(key).alias("k"), F.col(html).alias("page"))
    open_, read = F.lit(True), F.lit(None).cast(f"struct<reader:string,units:{UNITS}>")
    for k, r in enumerate(readers):
        df = df.withColumn(f"s{k}", open_ & F.coalesce(r.sign(page), F.lit(False)))
        df = df.withColumn(f"d{k}", F.when(F.col(f"s{k}"), r.data(page)))
        df = df.withColumn(f"u{k}", F.when(F.col(f"d{k}").isNotNull(), r.units(F.col(f"d{k}")).cast(UNITS)))
        open_ = open_ & F.col(f"u{k}").isNull()
    failed = []
    for k, r in enumerate(readers):
        read = F.when(F.col(f"u{k}").isNotNull(), F.struct(F.lit(r.name).alias("reader"), F.col(f"u{k}").alias("units"))).otherwise(read) if k == 0 else F.coalesce(read, F.when(F.col(f"u{k}").isNotNull(), F.struct(F.lit(r.name).alias("reader"), F.col(f"u{k}").alias("units"))))
        reason = F.when(F.col(f"d{k}").isNull(), "no data").otherwise("no units")
        failed.append(F.when(F.col(f"s{k}") & F.col(f"u{k}").isNull(), F.struct(F.lit(r.name).alias("reader"), reason.alias("reason"))))
    none = F.struct(F.lit(None).cast("string").alias("reader"), F.lit("no platform").alias("reason"))
    tried = F.array_compact(F.array(*failed))
    seen = F.greatest(*(F.col(f"s{k}") for k in range(len(readers))), F.lit(False))
    out = cut(df.select("k", read.alias("read"), F.when(seen, tried).otherwise(F.array(none)).alias("failed")))
    rows = out.where("read IS NOT NULL").select(F.col("k").alias(key), "read.reader", F.explode_outer("read.units").alias("unit"))
    failures = out.select(F.col("k").alias(key), F.explode("failed").alias("f")).select(key, "f.reader", "f.reason")
    return Readings(rows, failures, out)


def _units(v: Column, path: str, make: Callable[[Column], Column]) -> Column:
    """The structs that `make` gives for the objects of a list of the data; null if there is no list. Units without any price are left out."""
    made = F.transform(F.try_variant_get(v, path, "array<variant>"), make)
    return F.filter(made, lambda u: u["base_min"].isNotNull() | u["base_max"].isNotNull() | u["total"].isNotNull())


def _number(u: Column, path: str) -> Column:
    x = F.try_variant_get(u, path, "double")
    return F.when((x > 0) & (x < 1e9), x)


def _unit(key: Column, kind: Column, beds: Column, baths: Column, sqft: Column, low: Column, high: Column, total: Column) -> Column:
    return F.struct(
        key.alias("unit_key"), kind.alias("kind"), F.when((beds >= 0) & (beds < 100), beds).cast("int").alias("beds"), baths.alias("baths"), sqft.cast("int").alias("sqft"), F.coalesce(low, high).alias("base_min"),
        F.coalesce(high, low).alias("base_max"), total.alias("total"))


def _first(u: Column) -> Column:
    price = "$.startingAtPricesUnfurnished.prices."
    rent = _number(u, price + "price")
    return _unit(text_at(u, "$.unitId"), F.lit("unit"), F.try_variant_get(u, "$.bedroomNumber", "double"), _number(u, "$.bathroomNumber"), _number(u, "$.squareFeet"), rent, rent, _number(u, price + "totalPrice"))


def _second(u: Column) -> Column:
    low, high = _number(u, "$.price_entity.priceLow"), _number(u, "$.price_entity.priceHigh")
    bare_low, bare_high = _number(u, "$.price_entity.adjusted.low_no_fees"), _number(u, "$.price_entity.adjusted.high_no_fees")
    fees = F.coalesce(F.try_variant_get(u, "$.price_entity.pricingReflectFees", "boolean"), F.lit(False))  # then the headline price is the total
    key = F.coalesce(text_at(u, "$.id_value"), text_at(u, "$.id"))
    rest = (F.when(fees, bare_low).otherwise(low), F.when(fees, bare_high).otherwise(high), F.when(fees, low))
    return _unit(key, F.lit("unit"), F.try_variant_get(u, "$.bedrooms", "double"), _number(u, "$.bathrooms"), _number(u, "$.square_feet"), *rest)


def _script(page: Column, element_id: str) -> Column:
    return variant_of(F.nullif(F.regexp_extract(page, rf"(?is)<script[^>]*id=[\"']{element_id}[\"'][^>]*>(.*?)</script>", 1), F.lit("")))


def _assigned(page: Column, name: str) -> Column:
    """The JSON that a script assigns to a name, up to the semicolon that ends the statement or the script."""
    return variant_of(F.nullif(F.regexp_extract(page, rf"(?s){name}\s*=\s*(\{{.*?\}})\s*;?\s*(?:[A-Za-z.]+=|</script>)", 1), F.lit("")))


#: Platforms of properties' own sites, in the order they are tried.
PLATFORM_READERS = [
    Reader("platform_1", lambda p: F.contains(p, F.lit("Fusion.globalContent=")), lambda p: _assigned(p, r"Fusion\.globalContent"), lambda v: _units(v, "$.units", _first)),
    Reader("platform_2", lambda p: F.contains(p, F.lit('id="jd-fp-data-script-app"')), lambda p: _script(p, "jd-fp-data-script-app"), lambda v: _units(v, "$.units", _second)),
]
