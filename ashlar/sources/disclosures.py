"""What listings disclose beside their prices: fees, deals, where a feed comes from, what a total is made of. JSON is read by Spark's own parser, column by column."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ashlar.functions.scalars import as_int, c, fee_items, fee_type
from ashlar.tables import dealt, met, tasks_for

# Fields of the pages and what they are called; networks that feeds name.
LABELLED = (("deposit_fee_text", "Security deposit", "deposit", True), ("application_fee_text", "Application fee", "one_time", True), ("move_in_fees_text", "Move-in fees", "one_time", None))
ONE_TIME = (("applicationFee", "Application fee"), ("adminFee", "Admin fee"), ("brokerFee", "Broker fee"))
PETS = (("additionalRent", "Pet rent", True), ("deposit", "Pet deposit", False), ("initialFee", "Pet fee", False))
NETWORKS = {"ZILLOW": "Zillow Group", "ZRM": "Zillow Group"}
PREFIX = "{}&&"
#: Words of this library's own that tell a disclosure of prices from a deal.
DISCLOSURE_WORDS = ("base rent", "total price", "total monthly", "additional fees", "required fees", "prices include", "pricing", "subject to change", "utilities not included")
CONCESSION_WORDS = ("free", "off", "credit", "waived", "waive", "special", "save", "savings", "discount", "discounted", "concession", "gift card", "reduced")

_FEE = "struct<fee_type:string,description:string,amount:bigint,amount_text:string,recurring:boolean,mandatory:boolean>"
_TEXT_FEES = "struct<additional_fees_text:string,deposit_fee_text:string,application_fee_text:string,move_in_fees_text:string,parking:array<struct<comment:string,space_fee:int>>,pet_policies:struct<general:struct<rent:int>>>"
_NESTED_FEES = (
    "struct<fees:struct<applicationFee:double,adminFee:double,brokerFee:double,amenity:struct<fee:double,feeType:string,notes:string>>,petPolicies:array<struct<id:string,label:string,additionalRent:double,deposit:double,initialFee:double>>,"
    "parking:array<struct<type:string,comments:string,perSpaceFee:double,assignedFee:double>>,floorPlans:array<struct<name:string,deposit:double,units:array<struct<unitId:string,deposit:double>>>>>"
)


def _squash(x: Column) -> Column:
    return F.nullif(F.trim(F.regexp_replace(x, r"\s+", " ")), F.lit(""))


def _says(text: Column, words: tuple[str, ...]) -> Column:
    return F.lower(text).rlike(r"\b(?:" + "|".join(words) + r")\b")


def _fee(kind, description: Column, amount: Column, text: Column, recurring, mandatory) -> Column:
    lit = lambda x: x if isinstance(x, Column) else F.lit(x)
    return F.struct(lit(kind).alias("fee_type"), description.alias("description"), amount.cast("long").alias("amount"), text.alias("amount_text"), lit(recurring).cast("boolean").alias("recurring"), lit(mandatory).cast("boolean").alias("mandatory"))


def text_fees(document) -> Column:
    """Fees of a listing whose page states them in words (JSON): those of the free text, the labelled ones, parking and pets, in this order. An amount is known
    if a labelled text starts with one and has no more than three words."""
    d = F.from_json(c(document), _TEXT_FEES)
    parts = [fee_items(d["additional_fees_text"], F.lit(None).cast("boolean")).cast(f"array<{_FEE}>")]
    for field, label, kind, must in LABELLED:
        text = F.nullif(F.trim(d[field]), F.lit(""))
        words = F.split(text, r"\s+")
        amount = F.when(F.size(words) <= 3, F.translate(F.nullif(F.regexp_extract(F.get(words, 0), r"^\$+\s?([0-9][0-9,]*)$", 1), F.lit("")), ",", "").cast("long"))
        plain = F.replace(text, F.lit("$$"), F.lit("$"))
        parts.append(F.when(text.isNotNull(), F.array(_fee(kind, F.concat(F.lit(f"{label}: "), plain), amount, plain, False, must).cast(_FEE))))
    spots = F.filter(F.coalesce(d["parking"], F.array().cast("array<struct<comment:string,space_fee:int>>")), lambda s: (F.coalesce(F.trim(s["comment"]), F.lit("")) != "") | s["space_fee"].isNotNull())

    def spot(s: Column) -> Column:
        said = F.nullif(F.trim(s["comment"]), F.lit(""))
        price = F.concat(F.lit("$"), s["space_fee"].cast("string"))
        name = F.concat(F.lit("Parking"), F.coalesce(F.concat(F.lit(": "), said), F.lit("")), F.coalesce(F.concat(F.lit(" ("), price, F.lit(")")), F.lit("")))
        return _fee("parking", name, s["space_fee"], price, F.when(_says(said, ("replacement", "one[- ]time")), False), None).cast(_FEE)

    rent = d["pet_policies"]["general"]["rent"]
    pet = _fee("pet", F.concat(F.lit("Pet rent: $"), rent.cast("string"), F.lit("/month (only if you have a pet)")), rent, F.concat(F.lit("$"), rent.cast("string")), True, False).cast(_FEE)
    parts += [F.transform(spots, spot), F.when(rent > 0, F.array(pet))]
    empty = F.array().cast(f"array<{_FEE}>")
    return F.concat(*(F.coalesce(p, empty) for p in parts))


def nested_fees(document) -> Column:
    """Fees of a listing whose page nests them (JSON): one-time fees, the amenity fee, pets, parking, deposits of plans and of their units, in this order, each once.
    A fee without an amount is left out, parking with a comment apart."""
    d = F.from_json(c(document), _NESTED_FEES)

    def priced(kind: str, label: Column, value: Column, recurring, mandatory, suffix: str = "") -> Column:
        text = F.concat(F.lit("$"), F.format_number(value, 0))
        return F.when(value > 0, _fee(kind, F.concat(label, F.lit(": "), text, F.lit(suffix)), F.bround(value), text, recurring, mandatory).cast(_FEE))

    def each(rows: Column, make, kind: str) -> Column:
        return F.flatten(F.transform(F.coalesce(rows, F.array().cast(kind)), lambda r: F.array(*make(r))))

    costs = d["fees"]
    once = F.array(*(priced("one_time", F.lit(label), costs[field], False, True) for field, label in ONE_TIME))
    amenity = costs["amenity"]
    every = F.when(F.lower(amenity["feeType"]).contains("month"), True).when(_says(amenity["feeType"], ("one[- ]?time", "move[- ]in")), False)
    name = F.concat(F.lit("Amenity fee"), F.coalesce(F.concat(F.lit(" ("), amenity["feeType"], F.lit(")")), F.lit("")), F.coalesce(F.concat(F.lit(", "), _squash(amenity["notes"])), F.lit("")))
    label = lambda p: F.coalesce(_squash(p["label"]), _squash(p["id"]), F.lit("Pets"))
    pets = each(d["petPolicies"], lambda p: [priced("pet", F.concat(F.lit(f"{what} ("), label(p), F.lit(")")), p[field], monthly, False, "/month (only if you have a pet)" if monthly else " (only if you have a pet)") for field, what, monthly in PETS],
                "array<struct<id:string,label:string,additionalRent:double,deposit:double,initialFee:double>>")

    def parking(s: Column) -> list[Column]:
        value, said = F.coalesce(s["perSpaceFee"], s["assignedFee"]), _squash(s["comments"])
        what = F.concat(F.lit("Parking ("), F.coalesce(s["type"], F.lit("type not stated")), F.lit(")"), F.coalesce(F.concat(F.lit(", "), said), F.lit("")))
        return [F.coalesce(priced("parking", what, value, None, None), F.when(value.isNull() & said.isNotNull(), _fee("parking", what, F.lit(None), F.lit(None).cast("string"), None, None).cast(_FEE)))]

    spots = each(d["parking"], parking, "array<struct<type:string,comments:string,perSpaceFee:double,assignedFee:double>>")
    plans = F.coalesce(d["floorPlans"], F.array().cast("array<struct<name:string,deposit:double,units:array<struct<unitId:string,deposit:double>>>>"))

    def deposits(p: Column) -> Column:
        own = priced("deposit", F.concat(F.lit("Security deposit ("), F.coalesce(_squash(p["name"]), F.lit("floor plan")), F.lit(")")), p["deposit"], False, True)
        units = F.transform(F.coalesce(p["units"], F.array().cast("array<struct<unitId:string,deposit:double>>")), lambda u: priced("deposit", F.concat(F.lit("Security deposit (unit "), F.coalesce(_squash(u["unitId"]), F.lit("?")), F.lit(")")), u["deposit"], False, True))
        return F.concat(F.array(own), units)

    all_ = F.concat(once, F.array(priced("amenity", name, amenity["fee"], every, None)), pets, spots, F.flatten(F.transform(plans, deposits)))
    return F.array_distinct(F.filter(all_, lambda f: f.isNotNull()))


# Sections of the calculator, whether their fees come again and must be paid, and what they are called; names of what is no fee but the rent.
CALCULATOR = (
    ("monthlyRequiredFees", True, True, "required monthly fee"), ("oneTimeRequiredFees", False, True, "required one-time fee"), ("monthlyOptionalFees", True, False, "optional monthly fee"),
    ("oneTimeOptionalFees", False, False, "optional one-time fee"),
)
RENT_NAMES = ("base rent", "rent", "monthly rent", "monthly base rent")
_MONEY = r"^\$\s?([0-9][0-9,]*(?:\.[0-9]{1,2})?)(?: ?/ ?(?:mo|month))?$"


def calculator_fees(document) -> Column:
    """Fees of a listing whose page has a calculator (JSON), by its four sections, then those of the page's own sections, in this order: fee_type, description, amount, amount_text, recurring, mandatory.

    A fee's least and greatest amount are its min and max, else its value; two different ones are a span without an amount. In the page's own sections the title tells whether fees come again and must be paid, and
    the amount is a text: known if it is money alone, kept as a text if it has money in it. Fees without a name, and the rent itself, are left out. What is no list or no object is passed over.
    """
    d = F.try_parse_json(c(document))
    none = F.array().cast(f"array<{_FEE}>")

    def items(v: Column, path: str) -> Column:
        return F.coalesce(F.try_variant_get(v, path, "array<variant>"), F.array().cast("array<variant>"))

    def fee(name: Column, text: Column, low: Column, high: Column, recurring: Column, mandatory: Column, section: Column) -> Column:
        said = F.nullif(F.trim(text), F.lit(""))
        one = low.isNotNull() & (F.coalesce(high, low) == low)
        dollars = lambda x: F.concat(F.lit("$"), F.format_number(x, 0))
        alone = F.bround(F.replace(F.nullif(F.regexp_extract(said, _MONEY, 1), F.lit("")), F.lit(","), F.lit("")).try_cast("double")).cast("long")
        amount = F.when(low.isNotNull(), F.when(one, low)).otherwise(alone)
        shown = F.when(one, dollars(low)).when(low.isNotNull(), F.concat(dollars(low), F.lit("–"), dollars(high))).when(said.rlike(r"\$\s?[0-9]"), said)
        kind = F.when(recurring.isNotNull() & ~recurring, F.when(F.contains(F.lower(name), F.lit("deposit")), "deposit").otherwise("one_time")).otherwise(fee_type(name))
        words = F.concat(name, F.lit(" ("), section, F.lit("): "), F.coalesce(shown, said, F.lit("amount not stated")))
        return F.when((name != "") & ~F.lower(name).isin(*RENT_NAMES), _fee(kind, words, amount, shown, recurring, mandatory).cast(_FEE))

    def listed(monthly: bool, must: bool, label: str):
        def one(v: Column) -> Column:
            value = as_int(F.try_variant_get(v, "$.fee.amount.value", "string"))
            low = F.coalesce(as_int(F.try_variant_get(v, "$.fee.min", "string")), value)
            high = F.coalesce(as_int(F.try_variant_get(v, "$.fee.max", "string")), low)
            name = F.coalesce(F.trim(F.try_variant_get(v, "$.fee.displayValue", "string")), F.lit(""))
            return fee(name, F.try_variant_get(v, "$.fee.amount.displayText", "string"), low, high, F.lit(monthly), F.lit(must), F.lit(label))

        return one

    parts = [F.transform(items(d, f"$.rentalCostsAndFees.costAndFeeCalculator.fees.{section}"), listed(*kind)) for section, *kind in CALCULATOR]

    def own(s: Column) -> Column:
        title = F.coalesce(F.try_variant_get(s, "$.sectionTitle", "string"), F.lit(""))
        low = F.lower(title)
        monthly = F.when(F.contains(low, F.lit("monthly")), True).when(low.rlike("one[- ]time"), False)
        must = F.when(F.contains(low, F.lit("required")), True).when(F.contains(low, F.lit("optional")), False)
        none_ = F.lit(None).cast("long")

        def one(v: Column) -> Column:
            name = F.coalesce(F.trim(F.try_variant_get(v, "$.title", "string")), F.lit(""))
            return fee(name, F.try_variant_get(v, "$.formattedValue", "string"), none_, none_, monthly, must, F.coalesce(F.nullif(low, F.lit("")), F.lit("fee")))

        return F.transform(items(s, "$.rentalFees"), one)

    parts.append(F.flatten(F.transform(items(d, "$.rentalCostsAndFees.rentalFeeSections"), own)))
    return F.filter(F.concat(*(F.coalesce(p, none) for p in parts)), lambda f: f.isNotNull())


def split_deals(texts) -> Column:
    """promotions and disclosures of the texts in a listing's slot for deals, each once, in order: one that speaks of prices, and neither of a concession nor of an amount of dollars, is a disclosure."""
    told = F.array_distinct(F.filter(F.transform(c(texts), lambda t: _squash(t)), lambda t: t.isNotNull()))
    only = lambda t: _says(t, DISCLOSURE_WORDS) & ~_says(t, CONCESSION_WORDS) & ~t.rlike(r"\$\s*[0-9]")
    return F.struct(F.filter(told, lambda t: ~only(t)).alias("promotions"), F.filter(told, only).alias("disclosures"))


def feed_provenance(document, networks: dict[str, str] = NETWORKS) -> Column:
    """network that a listing's feed names, whether the source is independent of networks known to share feeds, and what on the page says so."""
    d = F.from_json(c(document), "struct<tplsource:string,mlsInfo:struct<feed:string>>")
    source, feed = _squash(d["tplsource"]), _squash(d["mlsInfo"]["feed"])
    network = F.element_at(F.create_map(*(F.lit(x) for kv in networks.items() for x in kv)), F.upper(F.coalesce(source, F.lit(""))))
    signals = F.array_compact(F.array(F.concat(F.lit("tplsource: "), source), F.concat(F.lit("feed: "), feed)))
    return F.struct(network.alias("network"), network.isNull().alias("independent"), signals.alias("signals"))


def cached_bodies(document) -> Column:
    """The bodies of a page's data cache (a JSON object of texts), by key: the guard before each is taken off, and what isn't JSON is left out."""
    m = F.from_json(c(document), "map<string,string>")
    bare = F.transform_values(m, lambda k, v: F.when(F.startswith(v, F.lit(PREFIX)), F.substring(v, len(PREFIX) + 1, 1 << 30)).otherwise(v))
    return F.map_filter(bare, lambda k, v: F.coalesce(v.rlike(r"^\s*[\[{]"), F.lit(False)) & F.try_parse_json(v).isNotNull())


def unit_types(groups: DataFrame, listing: str, total_only: str) -> DataFrame:
    """A listing's unit types, one for each id, the first one wins, with base or total price: where the listing's prices are totals the base rent is unknown. groups: listing,
    ordinal, type_id, price, and the flag total_only."""
    first = groups.groupBy(listing, "type_id").agg(F.min(F.struct("ordinal", "price", total_only)).alias("f")).select(listing, "type_id", "f.*")
    total = F.coalesce(F.col(total_only), F.lit(False))
    return first.select(listing, "type_id", F.when(~total, F.col("price")).alias("base"), F.when(total, F.col("price").cast("double")).alias("total"))


def stub_prices(by_beds, low, beds_low, beds_high) -> Column:
    """The least price by number of bedrooms of a search result: those that it gives, else its least price for each number in its range. A least price is a lower bound
    for all of them, so nothing is lost by filtering on it."""
    given = F.map_filter(F.coalesce(c(by_beds), F.create_map().cast("map<int,int>")), lambda k, v: v > 0)
    span = F.sequence(c(beds_low), F.coalesce(c(beds_high), c(beds_low)))
    return F.when(F.size(given) > 0, given).when((c(low) > 0) & (c(beds_low) <= F.coalesce(c(beds_high), c(beds_low))), F.map_from_arrays(span, F.transform(span, lambda _: c(low)))).otherwise(F.create_map().cast("map<int,int>"))


def total_composition(units: DataFrame, amounts: DataFrame, definitions: DataFrame, listing: str) -> DataFrame:
    """Per listing: what a unit's published additional expenses are made of, only if the least amounts of the required monthly ones add up to them exactly. The first unit
    with additional expenses decides. units: listing, unit, ordinal, extra; amounts: listing, unit, expense, least, shown; definitions: listing, expense, label, frequency, required, category."""
    tasks = tasks_for(amounts.count() + units.count(), units.sparkSession)
    first = dealt(units.where("extra > 0"), [listing], tasks).groupBy(listing).agg(F.min_by(F.struct("unit", "extra"), "ordinal").alias("u")).select(listing, "u.*")
    used = met(met(amounts.where("least > 0"), first, [listing, "unit"], tasks), definitions.where("frequency = 'month' and required"), [listing, "expense"], tasks)
    used = dealt(used, [listing, "extra"], tasks)
    said = F.concat("label", F.lit(" ("), "shown", F.when(F.col("category") == "pets", "; applies only to residents with pets").otherwise(""), F.lit(")"))
    g = used.groupBy(listing, "extra").agg(F.sum("least").alias("sum"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("expense", said.alias("t")))), lambda x: x["t"]), "; ").alias("parts"))
    return g.where(F.abs(F.col("sum") - F.col("extra")) < 0.01).select(listing, F.concat(F.lit("The published total monthly price adds these required monthly charges to base rent, at their minimum amounts: "), "parts", F.lit(".")).alias("text"))
