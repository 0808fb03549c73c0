import json
import random

import pytest

from ashlar.sources import listings, pages
from ashlar.sources.sites import SITES
from ashlar.sources.variants import PLATFORM_READERS, feed_signals, read_in_turn, search_cards, variant_of, walked


def ld(x):
    return f'<script type="application/ld+json">{x if isinstance(x, str) else json.dumps(x)}</script>'


def place(url, **more):
    return {"@type": "Apartment", "url": url, "name": "Oak - San X", "numberOfRooms": "1-3", "geo": {"latitude": "37.5", "longitude": -122}, "address": {"streetAddress": "1 A", "addressLocality": "T"}, **more}


def offer(url, price):
    return {"@type": "Product", "url": url, "offers": {"price": price}}


def test_cards_of_search_pages(spark):
    first = ld([place("/apartment/5"), offer("/apartment/5", "1200"), place("/home/6", name="", numberOfRooms="studio"), offer("/home/7", 9), 3, None]) + ld("{bad") + ld({"url": "/apartment/9"})
    again = ld([place("/apartment/5"), place("/apartment/5", name="Last"), offer("/apartment/5", 1), offer("/apartment/5", 2), place("/x/apartment/5", numberOfRooms=2, geo=None, address=7), place("/x/6")])
    df = spark.createDataFrame([(1, first), (2, again), (3, None), (4, ""), (5, ld("[" * 5000))], "id long, page string")
    got = {(r["id"], r["listing_id"]): (r["url"], r["name"], r["city"], r["lat"], r["price"], r["beds"]) for r in search_cards(df, "id", "page").collect()}
    assert got == {(1, "5"): ("/apartment/5", "Oak", "T", 37.5, 1200, [1, 2, 3]), (1, "6"): ("/home/6", "1 A", "T", 37.5, None, []), (2, "5"): ("/x/apartment/5", "Oak", None, None, None, [2])}
    assert search_cards(df.limit(0), "id", "page").collect() == []


def deep(value, depth):
    for k in range(depth):
        value = [value] if k % 2 else {"n": value}
    return value


def test_walk_finds_what_a_plain_walk_finds(spark):
    rng = random.Random(3)

    def made(level):
        if level == 0 or rng.random() < 0.2:
            return rng.choice([1, "x", None, True, 2.5, [], {}])
        return [made(level - 1) for _ in range(rng.randint(0, 3))] if rng.random() < 0.5 else {rng.choice("abc"): made(level - 1) for _ in range(rng.randint(0, 3))}

    def plain(v, path=()):
        for k, x in v.items() if isinstance(v, dict) else enumerate(v) if isinstance(v, list) else ():
            yield (*path, str(k))
            yield from plain(x, (*path, str(k)))

    docs = [made(7) for _ in range(30)] + [deep("end", 23)]
    df = spark.createDataFrame([(k, json.dumps(d)) for k, d in enumerate(docs)] + [(99, "no json"), (98, None)], "id long, j string").select("id", variant_of("j").alias("v"))
    assert sorted((r["id"], tuple(r["path"])) for r in walked(df, "id", "v").collect()) == sorted((k, p) for k, d in enumerate(docs) for p in plain(d))


@pytest.mark.parametrize("depth", [1, 50])
def test_signals_at_any_depth(spark, depth):
    said = {"a": " this is part of Zillow Group ", "label": "part of Zillow Group, a label"}
    doc = {"deep": deep(said, depth), "typedHomeId": "77_ZPID", "priceHistory": [{"source": "MLS "}, {"source": "N/A"}, {"source": 3}, 7], "f": {"label": "Trulia Corporate", "children": [1, {"label": "About Zillow Group"}]},
           "activeListing": {"provider": {"listingSource": {"attribution": {"x": {"agent": "A B", "url": "no"}}, "alternativeSources": [{"t": deep({"u": " C "}, depth)}], "other": "D"}}}}
    df = spark.createDataFrame([(1, json.dumps(doc)), (2, "{}"), (3, "nope"), (4, None), (5, '{"priceHistory": 3, "typedHomeId": "5"}')], "id long, d string")
    (r,) = feed_signals(df, "id", "d").collect()
    assert r["id"] == 1 and r["history_sources"] == ["MLS"] and r["property_id"] == "77" and r["independent"] is False
    assert r["signals"] == ["price history source: MLS", "listing source attribution: A B", "listing source attribution: C", "listed under Zillow property ID (zpid) 77",
                            'page states "this is part of Zillow Group"', 'page lists "About Zillow Group" under "Trulia Corporate"']


ONE = '<script>Fusion.globalContent=%s;Fusion.x=1</script>'
TWO = '<script id="jd-fp-data-script-app">%s</script>'
UNIT = '{"communityId":"AVB-1","units":[{"unitId":"u","bedroomNumber":1,"startingAtPricesUnfurnished":{"prices":{"price":1000,"totalPrice":1010.5}}}]}'
FEES = '{"units":[{"id_value":"v","bedrooms":2,"price_entity":{"priceLow":1500,"pricingReflectFees":true,"adjusted":{"low_no_fees":1400}}},{"id":"none"}]}'


def test_each_page_is_a_row_or_a_failure(spark):
    kinds = [ONE % UNIT, TWO % FEES, ONE % "{bad}", ONE % "{bad}" + TWO % FEES, ONE % '{"units":{}}', TWO % ("[" * 200_000), TWO % '{"units":[]}', "plain", None, TWO % '{"units":[{"id":"q","bedrooms":1e300,"price_entity":{"priceLow":1e300}}]}']
    r = read_in_turn(spark.createDataFrame(list(enumerate(kinds)), "id long, page string"), "id", "page", PLATFORM_READERS)
    rows = {x["id"]: (x["reader"], x["unit"] and (x["unit"]["unit_key"], x["unit"]["beds"], x["unit"]["base_min"], x["unit"]["total"])) for x in r.rows.collect()}
    failures = sorted(map(tuple, r.failures.collect()))
    r.discard()
    assert rows == {0: ("platform_1", ("u", 1, 1000.0, 1010.5)), 1: ("platform_2", ("v", 2, 1400.0, 1500.0)), 3: ("platform_2", ("v", 2, 1400.0, 1500.0)), 6: ("platform_2", None), 9: ("platform_2", None)}
    assert failures == [(2, "platform_1", "no data"), (3, "platform_1", "no data"), (4, "platform_1", "no units"), (5, "platform_2", "no data"), (7, None, "no platform"), (8, None, "no platform")]


HOSTILE = ["[" * 200_000, '{"units":' * 50_000, "\ud800".encode("utf-16", "surrogatepass").decode("utf-16", "replace"), "\0", "", "{}", "null", '{"a":1e999}', "self.__next_f.push([1,\"" + "f" * 1000]


def _random_pages(rng, n):
    values = ["Infinity", "NaN", "-1", "1e999", str(10**18), str(10**40), '"x"', "null", "[]", "{}", "true", '"2026-13-99"', '"studio"', '""', "[[[]]]", "9" * 400]
    names = sorted({x.split(".")[0] for spec in SITES.values() for group in (spec.fields, spec.unit_fields) for v in group.values() for x in v} | {"floorPlans", "units", "plans", "available_units", "rental_id", "urlPathname", "location", "communityId", "units_data", "floor_plans"})

    def value(level):
        if level == 0 or rng.random() < 0.3:
            return rng.choice(values)
        if rng.random() < 0.4:
            return "[" + ",".join(value(level - 1) for _ in range(rng.randint(0, 3))) + "]"
        return "{" + ",".join(f'"{x}":{value(level - 1)}' for x in rng.sample(names, rng.randint(1, 8))) + "}"

    wraps = ['<script id="__NEXT_DATA__">%s</script>', "Fusion.globalContent=%s", TWO, "%s", 'self.__next_f.push([1,%s])']
    return [w % (json.dumps(v) if "push" in w else v) for _ in range(n) for w in [rng.choice(wraps)] for v in [value(4)]]


@pytest.mark.parametrize("site", sorted(SITES))
def test_no_page_ends_a_job(spark, site):
    made = _random_pages(random.Random(7), 150) + [w % h for h in HOSTILE for w in ('<script id="__NEXT_DATA__">%s</script>', "Fusion.globalContent=%s", "%s")] + [None]
    df = spark.createDataFrame(list(enumerate(made)), "id long, page string").repartition(4)
    rows, failures = pages.read_pages_apart(df, "id", "page", listings.LISTING, listings.read_listings(SITES[site]))
    read, failed = {r["id"] for r in rows.collect()}, {r["id"]: r["reason"] for r in failures.collect()}
    assert not read & set(failed) and all(failed.values())
    assert pages.read_pages(df, "id", "page", listings.LISTING, listings.read_listings(SITES[site])).count() == rows.count()


def test_failures_have_reasons(spark):
    def reader(page):
        if page == "big":
            return [(10**30,)]
        if page == "short":
            return [()]
        return [(int(page),)] if page else []

    df = spark.createDataFrame([("a", "1"), ("b", "x"), ("c", "big"), ("d", None), ("e", "short"), ("f", "2")], "id string, page string")
    rows, failures = pages.read_pages_apart(df, "id", "page", "n int", reader)
    assert sorted(map(tuple, rows.collect())) == [("a", 1), ("f", 2)]
    assert {r["id"]: r["reason"].split(":")[0] for r in failures.collect()} == {"b": "ValueError", "c": "OverflowError", "e": "ValueError"}
