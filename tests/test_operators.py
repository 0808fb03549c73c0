from datetime import datetime

from pyspark.sql import functions as F

from ashlar.operators import components, matching, pricing, scoring, upserts
from ashlar.sources import listings, official, pages


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_components(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (5, 4), (7, 7), (3, 9), (2, 1)], "u long, v long")
    assert rows(components.components(edges)) == [(1, 1), (2, 1), (3, 1), (4, 4), (5, 4), (7, 7), (9, 1)]
    assert rows(components.components(edges.limit(0))) == []


def test_long_chain(spark):
    n = 60
    edges = spark.range(n).select(F.col("id").alias("u"), (F.col("id") + 1).alias("v"))
    assert {r.root for r in components.components(edges).collect()} == {0}


def test_resolution(spark):
    r = spark.createDataFrame([
        (1, "Oak Apartments", "10 Main Street", "Town", "1", 37.0, -122.0), (2, "Oaks", "10 Main St", "town", None, None, None), (3, "Elm", "12 Main St", "Town", "1", 37.0, -122.0),
        (4, "Oak Place", "10 Other St", "Town", "2", 37.0001, -122.0), (5, "Oak Apartments", "99 Far St", "Town", "3", 38.0, -122.0)], "id long, name string, street string, city string, zip string, lat double, lon double")
    assert rows(matching.resolve(r)) == [(1, 1), (2, 1), (3, 3), (4, 1), (5, 5)]


def test_near_pairs_is_exact(spark):
    import random

    rnd = random.Random(1)
    pts = [(k, rnd.uniform(-80, 80) if k % 2 else 60 + rnd.uniform(0, 0.02), rnd.uniform(10, 10.02)) for k in range(120)]
    df = spark.createDataFrame(pts, "id long, lat double, lon double")
    got = {(r.a_id, r.b_id) for r in matching.near_pairs(df, df, 400.0).collect()}
    from ashlar.functions.scalars import haversine_m

    x, y = df.select(*(F.col(c).alias(f"a_{c}") for c in df.columns)), df.select(*(F.col(c).alias(f"b_{c}") for c in df.columns))
    want = {(r.a_id, r.b_id) for r in x.join(y, F.lit(True)).where(haversine_m("a_lat", "a_lon", "b_lat", "b_lon") <= 400).collect()}
    assert got == want


def test_price_conflicts(spark):
    p = spark.createDataFrame([("a", 1, 700, 2000, 2100, ["1"]), ("b", 1, 705, 2300, 2400, ["1", "2"]), ("c", 1, 705, 2300, 2400, ["9"]), ("d", 1, 800, 9000, 9000, [])], "src string, beds int, sqft int, base_min int, base_max int, unit_keys array<string>")
    got = pricing.price_conflicts(p, "src", ["beds"], "sqft")
    assert rows(got.select("a_src", "b_src", "difference")) == [("a", "b", 200)]


def test_rating_decision(spark):
    r = spark.createDataFrame([(1, 4.5, 10, "exact"), (1, 2.0, 10, "exact"), (2, 2.5, 5, "probable"), (3, 2.0, 2, "exact"), (4, 1.0, 50, "weak"), (5, None, 0, "exact"), (6, 3.1, 90, "exact"), (6, 2.9, 10, "exact")], "e int, average double, n int, confidence string")
    got = {x.e: x.status for x in pricing.rating_decision(r, ["e"], "average", "n", "confidence").collect()}
    assert got == {1: "conflict", 2: "low_rating", 3: "insufficient", 4: "insufficient", 5: "no_reviews", 6: "ok"}


def test_upsert_keeps_known_values(spark):
    old = spark.createDataFrame([(1, "a", 1), (2, "b", 2)], "k int, x string, seen int")
    new = spark.createDataFrame([(1, None, 9), (3, "c", 3)], "k int, x string, seen int")
    assert rows(upserts.upsert(old, new, ["k"], first_seen="seen")) == [(1, "a", 1), (2, "b", 2), (3, "c", 3)]


def test_overall_needs_coverage(spark):
    s = spark.createDataFrame([(1, "noise", 8.0, "high"), (1, "commute", 6.0, "low"), (2, "pests", 9.0, "high"), (2, "noise", None, "low"), (3, "other", 5.0, "high")], "e int, category string, score double, confidence string")
    assert rows(scoring.overall_score(s, "e", "category", "score", "confidence")) == [(1, 2, 0.45, 6.9, "low"), (2, 1, 0.1, None, "insufficient"), (3, 0, 0.0, None, "insufficient")]


def test_pages(spark):
    html = '<script type="application/ld+json">{"a": 1}</script><script type="application/ld+json">{bad</script><script id="__NEXT_DATA__">{"x": {"listingId": "7", "plans": [{"beds": "Studio", "units": [{"n": "A", "rent": 1500}, {"n": "A", "rent": "$1,600"}]}, {"beds": 1, "rent": 2000}, {"beds": 2}]}}</script>'
    df = spark.createDataFrame([(1, html), (2, None)], "page long, html string")
    assert df.select(pages.json_ld("html")).first()[0] == ['{"a": 1}']
    spec = listings.Spec(marks=("listingId",), fields={"id": ("listingId",)}, plans=("plans",), units=("units",), unit_fields={"key": ("n",), "price_min": ("rent",), "beds": ("beds",)})
    got = pages.read_pages(df, "page", "html", "id string, units int", lambda h: [(r[0], len(r[8])) for r in listings.read_listings(spec)(h)])
    assert rows(got) == [(1, "7", 3)]
    got = listings.read_listings(spec)(html)
    assert [(u["unit_key"], u["beds"], u["base_min"]) for u in got[0][8]] == [("A", 0, 1500.0), ("A#2", 0, 1600.0), ("2", 1, 2000.0)]
    assert pages.flight_rows('self.__next_f.push([1,"1:T5,héb\\n2:[\\"x\\"]\\n"])') == [("1", "héb\n"), ("2", '["x"]')]
    assert list(pages.objects({"a": [{"b": {}}]})) == [{"a": [{"b": {}}]}, {"b": {}}, {}]
    assert [r[0] for r in spark.createDataFrame([("x px-captcha",), ("<title>Access Denied</title>",), ("Access Denied",), ("g-recaptcha",), ("fine",), (None,), ("g-recaptcha" + " " * 20_000,)], "h string").select(pages.looks_like_challenge("h")).collect()] == [True, True, False, True, False, False, False]


def test_robots(spark):
    text = "User-agent: other\nDisallow: /\n\nUser-agent: *\nDisallow: /private\nAllow: /private/ok$\nDisallow: /*.pdf"
    r = pages.robots_rules(spark.createDataFrame([("h", text)], "host string, text string"), "host", "text", "mybot")
    urls = spark.createDataFrame([("h", p) for p in ("/", "/private/x", "/private/ok", "/private/okay", "/a.pdf")] + [("i", "/private")], "host string, path string")
    got = {(x.host, x.path): x.allowed for x in pages.robots_allow(urls, r, "host", "path").collect()}
    assert got == {("h", "/"): True, ("h", "/private/x"): False, ("h", "/private/ok"): True, ("h", "/private/okay"): False, ("h", "/a.pdf"): False, ("i", "/private"): True}


def test_discovery_stops(spark):
    def fetch(city, page):
        return [{"id": f"{city}{min(page, 3)}{k}"} for k in range(2)], None

    got = listings.discover(spark.createDataFrame([("a",), ("b",)], "city string"), "city", fetch, "city string, id string", "id")
    assert got.count() == 12 and got.select("id").distinct().count() == 12


def test_official(spark, tmp_path):
    f = tmp_path / "c.csv"
    f.write_text("Year,County,NCICCode,Violent_sum,Homicide_sum,Property_sum,Burglary_sum\n2024,A,X,10,,20,\n2023,A,X,1,,2,\n,A,X,1,1,1,1\n2024,B,Y,,,5,\n")
    c = official.read_crimes(spark, str(f))
    assert c.count() == 3
    res = spark.createDataFrame([("x", 1000), ("y", 500), ("z", 10)], "city string, residents int")
    cand = spark.createDataFrame([("x", 1, "Q", "X"), ("x", 2, "A", "X"), ("y", 1, "B", "Y")], "city string, ordinal int, county string, agency string")
    assert rows(official.area_rates(c, res, cand)) == [("x", 2024, 10.0, 20.0, 10.0, 16.67), ("y", 2024, None, 10.0, 10.0, 16.67), ("z", None, None, None, 10.0, 16.67)]
    assert [r[0] for r in spark.createDataFrame([("San José-del, X",)], "n string").select(official.normalize_place("n")).collect()] == ["san jose del x"]


def test_bursts(spark):
    d = [datetime(2026, 1, x) for x in (1, 2, 3, 20)] + [datetime(2025, 1, 1)]
    df = spark.createDataFrame([(1, k, x) for k, x in enumerate(d)], "e int, r int, t timestamp")
    assert rows(scoring.bursts(df, ["e"], "t", "r", 14)) == [(1, 3, 0, 5)]


def test_sites():
    import json

    from ashlar.sources.sites import SITES

    units = lambda site, page: [(u["unit_key"], u["kind"], u["beds"], u["sqft"], u["base_min"], u["total"]) for r in listings.read_listings(SITES[site])(page) for u in r[8]]
    feed = {"units_data": {"layouts": [{"id": 7, "bedrooms": 1, "area": 600}], "units": [{"id": 1, "layoutId": 7, "available": True, "price": "$2,100"}, {"id": 2, "layoutId": 7, "available": True, "leased": True, "price": 1}, {"id": 3, "available": True, "bedrooms": 0, "displayPrice": 1900}, {"id": 4, "available": False, "price": 9}]}}
    assert units("platform_3", json.dumps(feed)) == [("1", "unit", 1, 600, 2100.0, None), ("3", "unit", 0, None, 1900.0, None)]
    sight = {"data": {"id": 5, "floor_plans": [{"id": "a", "bedroom_count": 2}], "units": [{"id": 9, "floor_plan_id": "a", "price": 3000, "total_price": ["3100", "3200"], "area": 900}, {"id": 10, "price": None}]}}
    assert units("platform_4", json.dumps(sight)) == [("9", "unit", 2, 900, 3000.0, 3100.0)]
    groups = {"x": {"floorPlans": {"floorPlanGroups": [{"plans": [{"name": "P", "bedrooms": "Studio", "priceRange": {"min": 1500}}, {"isRoomForRent": True, "priceRange": {"min": 1}}]}]}, "location": {"city": "Town"}}}
    page = f'<script id="__NEXT_DATA__">{json.dumps(groups)}</script>'
    assert units("source_d", page) == [("P", "floorplan", 0, None, 1500.0, None)]
    row = json.dumps({"rental_id": "r1", "available_units": [{"id": 3, "bed": 1, "price": 2000, "price_max": 2200}]})
    page = f"self.__next_f.push([1,{json.dumps('4:' + row + chr(10))}])"
    assert units("source_a", page) == [("3", "floorplan", 1, None, 2000.0, None)] and listings.read_listings(SITES["source_a"])(page)[0][0] == "r1"


def test_near_duplicate_members(spark):
    copies = [(k, "s", "One two three four five six" if k % 2 else "six FIVE four three two one one") for k in range(10, 3010)]
    rest = [(1, "t", "one two three four five six"), (2, "s", "one two three four five seven"), (3, "s", "too few"), (4, "s", None), (5, None, copies[0][2]), (6, None, copies[0][2])]
    df = spark.createDataFrame(copies + rest, "id long, e string, x string")
    got = {(r.e, r.id): r.representative for r in matching.near_duplicate_members(df, "e", "id", "x").collect()}
    assert got == {("s", k): 10 for k, _, _ in copies} | {("t", 1): 1, ("s", 2): 2, (None, 5): 5, (None, 6): 5}
    assert matching.near_duplicate_members(df.limit(0), "e", "id", "x").count() == 0
