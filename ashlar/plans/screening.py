"""Queries of what keeps an entity in or out, of sentences and of orders."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ashlar.operators import cards, screening
from ashlar.plans.pricing import NOW, now
from ashlar.plans.registry import query
from ashlar.session import table

CITIES = {"san jose": "south_bay", "fremont": "east_bay", "milpitas": "south_bay"}
# The corridor of the search.
CORRIDOR = [screening.Box(37.19, 37.592, -122.36, -121.72), screening.Box(37.45, 37.635, -122.12, -121.85)]
NAMES = ("San Jose", "Fremont", "Oakland", None, " san  jose ", "Milpitas,")


def pick(values, key):
    """The value at key, counted round."""
    return F.element_at(F.array(*(F.lit(v).cast("string") for v in values)), (key % len(values) + 1).cast("int"))


def _places(spark, sf_dir):
    key = F.col("c_custkey")
    known = key % 10 > 0
    return table(spark, sf_dir, "customer").select(key.alias("id"), pick(NAMES, key).alias("city"), F.when(known, 37.0 + (key % 800) / 1000.0).alias("lat"), F.when(known, -122.5 + (key % 900) / 1000.0).alias("lon"))


PLACES_SQL = """
p AS (SELECT c_custkey AS id, ['San Jose', 'Fremont', 'Oakland', NULL, ' san  jose ', 'Milpitas,'][c_custkey % 6 + 1] AS city,
  CASE WHEN c_custkey % 10 > 0 THEN 37.0::DOUBLE + (c_custkey % 800) / 1000.0::DOUBLE END AS lat, CASE WHEN c_custkey % 10 > 0 THEN -122.5::DOUBLE + (c_custkey % 900) / 1000.0::DOUBLE END AS lon FROM customer),
b AS (SELECT *, lat IS NOT NULL AS known, coalesce((lat BETWEEN 37.19 AND 37.592 AND lon BETWEEN -122.36 AND -121.72) OR (lat BETWEEN 37.45 AND 37.635 AND lon BETWEEN -122.12 AND -121.85), false) AS inside,
  map {'san jose': 'south_bay', 'fremont': 'east_bay', 'milpitas': 'south_bay'}[lower(trim(regexp_replace(replace(coalesce(city, ''), ',', ' '), '\\s+', ' ', 'g')))] AS region FROM p)
"""


@query(f"""
WITH {PLACES_SQL}
SELECT id, region IS NOT NULL AND (NOT known OR inside) AS allowed, region, CASE WHEN region IS NULL THEN 'City ''' || coalesce(city, 'unknown') || ''' is outside the search area'
  WHEN NOT known THEN 'Coordinates unavailable; allowed by city only' WHEN NOT inside THEN format('Coordinates ({{:.4f}}, {{:.4f}}) fall outside the search corridor', lat, lon) ELSE 'City and coordinates inside the search corridor' END AS reason FROM b
""")
def location_decision(spark, sf_dir):
    out = screening.location_decision(_places(spark, sf_dir), "city", "lat", "lon", CITIES, CORRIDOR)
    return out.select("id", "location.allowed", "location.region", "location.reason")


@query(f"WITH {PLACES_SQL} SELECT id, inside FROM b WHERE NOT known OR inside")
def corridor_prefilter(spark, sf_dir):
    p = _places(spark, sf_dir)
    return p.where(screening.in_corridor("lat", "lon", CORRIDOR, unknown=True)).select("id", screening.in_corridor("lat", "lon", CORRIDOR, unknown=False).alias("inside"))


@query(f"WITH {PLACES_SQL} SELECT id, coalesce(region, '') AS region, CASE WHEN region IS NULL THEN 'not_listed' ELSE 'listed' END AS status, CASE WHEN region IS NULL THEN coalesce(city, 'The city') || ' is not in the list of cities' END AS reason FROM b")
def city_figures(spark, sf_dir):
    figures = spark.createDataFrame(list(CITIES.items()), "city string, region string")
    return screening.city_figures(_places(spark, sf_dir), "city", figures).select("id", F.coalesce("region", F.lit("")).alias("region"), "status", "reason")


@query(r"""
WITH p AS (SELECT p_partkey AS id, p_name || [' Apartments', ' Senior Living', ' 55+ Homes', ' BMR', ' Extended-Stay Suites', ' Affordable Housing', ' Seniority', ' Income Limits'][p_partkey % 8 + 1] AS name,
  list_filter([['Pets'], ['Pets', 'Income-restricted'], ['62 + only', 'Senior'], NULL, ['No smoking', 'low income']][p_partkey % 5 + 1], lambda x: true) AS r,
  'https://' || ['www.a.com/x', 'hyatthouse.com/y', 'book.sonesta.com', 'notsonesta.com', 'a.com/hyatthouse.com'][p_partkey % 5 + 1] AS url, CASE WHEN p_partkey % 7 > 0 THEN p_size % 4 END AS beds FROM part),
x AS (SELECT *, list_filter(coalesce(r, []), lambda v: regexp_matches(v, '(?i)\b(?:senior|age[- ]restricted|\d{2}\s*\+|affordable|income[- ](?:restricted|qualified|capped|protected|limits?)|below[- ]market[- ]rate|bmr|low[- ]income)([^a-zA-Z]|$)'))[1] AS listed,
  regexp_extract(lower(url), '^https://([^/]*)', 1) AS host FROM p)
SELECT id, CASE WHEN listed IS NOT NULL THEN 'Listed as ' || listed WHEN regexp_matches(name, '(?i)\b(?:senior|age\s*55|55\s*\+|62\s*\+|affordable housing|income[- ](?:restricted|protected)|below[- ]market[- ]rate|bmr|low[- ]income)([^a-zA-Z]|$)') THEN 'Name indicates restricted eligibility: ' || name END AS excluded,
  regexp_matches(name, '(?i)\b(?:income|bmr|below[- ]market|affordable|senior|\d{2}\s*%\s*ami|ami)([^a-zA-Z]|$)') AS restricted,
  CASE WHEN host IN ('hyatthouse.com', 'book.sonesta.com') THEN 'Official website is an extended-stay hotel (' || host || ')' WHEN name LIKE '%Extended-Stay%' THEN 'Name indicates an extended-stay hotel: ' || name END AS hotel,
  coalesce(beds IN (0, 1), false) AS wanted FROM x
""")
def eligibility_filters(spark, sf_dir):
    key = F.col("p_partkey")
    name = F.concat("p_name", pick((" Apartments", " Senior Living", " 55+ Homes", " BMR", " Extended-Stay Suites", " Affordable Housing", " Seniority", " Income Limits"), key))
    listed = F.element_at(F.array(*(F.array(*map(F.lit, x)) if x else F.lit(None).cast("array<string>") for x in (["Pets"], ["Pets", "Income-restricted"], ["62 + only", "Senior"], None, ["No smoking", "low income"]))), (key % 5 + 1).cast("int"))
    url = F.concat(F.lit("https://"), pick(("www.a.com/x", "hyatthouse.com/y", "book.sonesta.com", "notsonesta.com", "a.com/hyatthouse.com"), key))
    p = table(spark, sf_dir, "part").select(key.alias("id"), name.alias("name"), listed.alias("r"), url.alias("url"), F.when(key % 7 > 0, F.col("p_size") % 4).alias("beds"))
    return p.select("id", screening.excluded_eligibility("r", "name").alias("excluded"), screening.restricted_unit("name").alias("restricted"), screening.long_stay_hotel("name", "url").alias("hotel"), screening.allowed_unit_type("beds").alias("wanted"))


@query("""
WITH e AS (SELECT c_custkey AS id, ['included', 'excluded', 'needs_reverification', 'excluded', 'excluded'][c_custkey % 5 + 1] AS status, [[], ['price'], ['geography'], ['price', 'stale'], ['price', 'geography']][c_custkey % 5 + 1] AS reasons FROM customer),
s AS (SELECT o_custkey AS id, 'https://site' || (o_orderkey % 50) AS url, o_orderdate AS seen FROM orders WHERE o_orderkey % 4 > 0),
n AS (SELECT id, url FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY seen DESC, url) AS rn FROM s) WHERE rn = 1)
SELECT id, url FROM e JOIN n USING (id) WHERE status IN ('included', 'needs_reverification') OR len(list_filter(reasons, lambda r: r NOT IN ('price', 'stale'))) = 0
""")
def site_targets(spark, sf_dir):
    key = F.col("c_custkey")
    reasons = F.element_at(F.array(*(F.array(*map(F.lit, x)).cast("array<string>") for x in ([], ["price"], ["geography"], ["price", "stale"], ["price", "geography"]))), (key % 5 + 1).cast("int"))
    e = table(spark, sf_dir, "customer").select(key.alias("id"), pick(("included", "excluded", "needs_reverification", "excluded", "excluded"), key).alias("status"), reasons.alias("reasons"))
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("id"), F.when(F.col("o_orderkey") % 4 > 0, F.concat(F.lit("https://site"), (F.col("o_orderkey") % 50).cast("string"))).alias("url"), F.col("o_orderdate").alias("collected"))
    return screening.site_targets(e, o, "id", ("price", "stale"))


@query(f"""
SELECT o_orderkey AS id, o_orderstatus = 'F' OR o_orderkey % 9 = 0 OR TIMESTAMP '{NOW}' - o_orderdate > INTERVAL 900 DAY AS due, o_orderkey % 3 > 0 AND (o_orderkey % 50) / 10 < 3 AND o_orderkey % 8 >= 3 AS low,
  o_orderkey % 3 > 0 AND o_orderkey % 4 IN (1, 2) AS uncertain FROM orders
""")
def lookup_flags(spark, sf_dir):
    key = F.col("o_orderkey")
    o = table(spark, sf_dir, "orders").select(key.alias("id"), F.when(key % 9 > 0, F.when(F.col("o_orderstatus") == "F", "error").otherwise("ok")).alias("last"), "o_orderdate",
                                              F.when(key % 3 > 0, "ok").otherwise("no_match").alias("status"), ((key % 50) / 10).alias("rating"), (key % 8).alias("n"), pick(("exact", "probable", "weak", None), key).alias("confidence"))
    return o.select("id", screening.lookup_due("last", "o_orderdate", now(), 900).alias("due"), screening.low_rating("status", "rating", "n").alias("low"), screening.uncertain_match("status", "confidence").alias("uncertain"))


@query("""
SELECT c_custkey AS id, CASE c_custkey % 5 WHEN 0 THEN NULL WHEN 1 THEN 37.5 WHEN 2 THEN 37.5 WHEN 3 THEN NULL ELSE NULL END AS lat, CASE c_custkey % 5 WHEN 1 THEN 1 WHEN 2 THEN 2 END AS candidates FROM customer
""")
def geocode_choice(spark, sf_dir):
    key = F.col("c_custkey")
    at = lambda lat, number: F.struct(F.lit(lat).alias("lat"), F.lit(-122.0).alias("lon"), F.concat(number.cast("string"), F.lit(" MAIN ST")).alias("matched"))
    lists = (F.array().cast("array<struct<lat:double,lon:double,matched:string>>"), F.array(at(37.5, key)), F.array(at(37.5, key), at(37.5005, key)), F.array(at(37.5, key), at(37.51, key)), F.array(at(37.5, key + 1)))
    matches = lists[0]
    for k in range(1, 5):
        matches = F.when(key % 5 == k, lists[k]).otherwise(matches)
    g = screening.geocoded("m", "a")
    c = table(spark, sf_dir, "customer").select(key.alias("id"), matches.alias("m"), F.concat(F.lit(" "), key.cast("string"), F.lit(" Main Street")).alias("a")).select("id", g.alias("g"))
    return c.select("id", "g.lat", "g.candidates")


@query("""
SELECT page_id, k, CASE k WHEN 0 THEN 'https://x.org/a' WHEN 1 THEN 'https://cdn.x.org/b' WHEN 2 THEN root || '/c' WHEN 3 THEN bare || '?d=1' WHEN 4 THEN (CASE WHEN bare = root THEN root || '/' ELSE regexp_replace(bare, '[^/]*$', '') END) || 'e.html' WHEN 5 THEN 'mailto:f' END AS link
FROM (SELECT page_id, regexp_replace(url, '[?#].*$', '') AS bare, regexp_extract(url, '^(https?://[^/?#]*)', 1) AS root FROM pages), (SELECT unnest(range(7)) AS k) WHERE regexp_matches(bare, '^https://')
""")
def resolved_links(spark, sf_dir):
    links = F.array(*(F.lit(x) for x in ("https://x.org/a", "//cdn.x.org/b", "/c", "?d=1", "e.html", "mailto:f", " ")))
    p = table(spark, sf_dir, "pages").where("url like 'https://%'").select("page_id", "url", F.posexplode(links).alias("k", "raw"))
    return p.select("page_id", F.col("k").cast("long").alias("k"), screening.absolute_link("raw", "url").alias("link"))


UNITS_SQL = """
u AS (SELECT p_partkey AS id, CASE WHEN p_partkey % 13 > 0 THEN p_size % 4 END AS beds, CASE WHEN p_partkey % 3 = 0 THEN 'A' || p_partkey END AS label, CASE WHEN p_partkey % 5 > 0 THEN p_name END AS floorplan,
  CASE WHEN p_partkey % 17 > 0 THEN 1000 + p_partkey % 2500 END AS low, CASE WHEN p_partkey % 2 = 0 THEN 12 END AS months, CASE WHEN p_partkey % 9 > 0 THEN 400 + p_partkey % 900 END AS sqft_min, p_brand, p_size FROM part),
v AS (SELECT *, low + id % 2 * 250 AS high, CASE WHEN low IS NULL THEN 1800 + id % 100 WHEN id % 4 = 0 THEN low + 75.5::DOUBLE END AS total, CASE WHEN id % 8 = 0 THEN 75.5::DOUBLE END AS fees, sqft_min + id % 3 * 50 AS sqft_max FROM u)
"""


def _units(spark, sf_dir):
    key = F.col("p_partkey")
    p = table(spark, sf_dir, "part").select(
        key.alias("id"), F.when(key % 13 > 0, F.col("p_size") % 4).alias("beds"), F.when(key % 3 == 0, F.concat(F.lit("A"), key.cast("string"))).alias("label"), F.when(key % 5 > 0, F.col("p_name")).alias("floorplan"),
        F.when(key % 17 > 0, 1000 + key % 2500).alias("base_min"), F.when(key % 2 == 0, 12).alias("months"), F.when(key % 9 > 0, 400 + key % 900).alias("sqft_min"), "p_brand", "p_size")
    key = F.col("id")
    return p.withColumns({"base_max": F.col("base_min") + key % 2 * 250, "total": F.when(F.col("base_min").isNull(), (1800 + key % 100).cast("double")).when(key % 4 == 0, F.col("base_min") + F.lit(75.5)),
                          "fees": F.when(key % 8 == 0, F.lit(75.5)), "sqft_max": F.col("sqft_min") + key % 3 * 50})


@query(f"""
WITH {UNITS_SQL}
SELECT id, coalesce(CASE beds WHEN 0 THEN 'Studio' WHEN 1 THEN '1 bedroom' ELSE beds || ' bedroom' END, 'Unknown bedrooms') || ', ' || coalesce('unit ' || label, 'floor plan ' || coalesce(floorplan, 'unnamed')) || ': '
  || CASE WHEN low IS NOT NULL THEN 'advertised base rent $' || format('{{:,}}', low) || CASE WHEN low = high THEN '' ELSE '–$' || format('{{:,}}', high) END ELSE 'total price $' || format('{{:,.0f}}', total) || ' (base rent not published separately)' END
  || CASE WHEN low IS NOT NULL AND total <> low THEN '; published total $' || format('{{:,.2f}}', total) || ' including $' || format('{{:,.2f}}', coalesce(fees, 0)) || ' required monthly fees' ELSE '' END
  || coalesce('; ' || months || '-month lease', '') || CASE WHEN sqft_min IS NULL THEN '' ELSE '; ' || format('{{:,}}', sqft_min) || CASE WHEN sqft_min = sqft_max THEN '' ELSE '–' || format('{{:,}}', sqft_max) END || ' sq ft' END AS content FROM v
""")
def price_sentences(spark, sf_dir):
    return _units(spark, sf_dir).select("id", cards.price_sentence().alias("content"))


@query("""
SELECT c_custkey AS id, CASE WHEN c_custkey % 19 = 0 THEN 'No drivable route found. not asked' ELSE printf('%.1f miles; %.0f min free-flow driving time (no traffic)', (c_custkey % 300) / 10::DOUBLE, (c_custkey % 70)::DOUBLE) ||
    CASE WHEN c_custkey % 4 = 0 THEN printf('; weekday rush hour: %.0f min AM, %.0f min PM (predicted)', (c_custkey % 70 + 10)::DOUBLE, (c_custkey % 70 + 15)::DOUBLE) ELSE '. Rush hour: not asked' END END AS drive,
  CASE WHEN c_custkey % 6 = 0 THEN 'No agency.' ELSE 'City ' || (c_custkey % 40) || ' 2024: ' || CASE WHEN c_custkey % 3 = 0 THEN 'unknown' ELSE printf('%.2f', (c_custkey % 90) / 4::DOUBLE) END || ' violent and ' || printf('%.2f', (c_custkey % 70) / 2::DOUBLE) || ' property crimes per 1,000 residents' END AS area FROM customer
""")
def fact_sentences(spark, sf_dir):
    key = F.col("c_custkey")
    c = table(spark, sf_dir, "customer").select(
        key.alias("id"), F.when(key % 19 > 0, (key % 300) / 10).alias("miles"), (key % 70).alias("free_flow"), F.when(key % 2 == 0, key % 70 + 10).alias("am"), F.when(key % 4 == 0, key % 70 + 15).alias("pm"), F.lit("not asked").alias("rush_status"),
        F.concat(F.lit("City "), (key % 40).cast("string")).alias("jurisdiction"), F.lit(2024).alias("year"), F.when(key % 3 > 0, (key % 90) / 4).alias("violent"), F.when(key % 6 > 0, (key % 70) / 2).alias("property_crime"), F.lit("No agency.").alias("reason"))
    return c.select("id", cards.commute_sentence().alias("drive"), cards.safety_sentence().alias("area"))


NOTE_SQL = """CASE WHEN recent = 0 THEN CASE WHEN known = 0 THEN CASE WHEN n = 1 THEN 'review date unavailable' ELSE 'review dates unavailable' END WHEN known < n THEN 'mentions from ' || span || ' or undated'
  WHEN n = 1 THEN 'mention from ' || span ELSE 'all mentions from ' || span END WHEN recent < n THEN recent || ' from the last 2 years' WHEN n = 1 THEN 'from the last 2 years' ELSE 'all from the last 2 years' END"""


@query(f"""
WITH d AS (SELECT o_custkey AS id, CASE WHEN o_orderkey % 5 > 0 THEN o_orderdate END AS d FROM orders WHERE o_orderkey % 3 = 0),
g AS (SELECT id, count(*) AS n, count(d) AS known, count(*) FILTER (d IS NOT NULL AND greatest(0, date_diff('second', d, TIMESTAMP '{NOW}')) / 86400 / 365.25 <= 2) AS recent,
  CASE WHEN min(year(d)) = max(year(d)) THEN min(year(d)) || '' ELSE min(year(d)) || '–' || max(year(d)) END AS span FROM d GROUP BY 1)
SELECT id, {NOTE_SQL} AS note, recent > 0 AS is_current FROM g
""")
def recency_notes(spark, sf_dir):
    key = F.col("o_orderkey")
    o = table(spark, sf_dir, "orders").where(key % 3 == 0).select(F.col("o_custkey").alias("id"), F.struct(F.when(key % 5 > 0, F.col("o_orderdate")).alias("d")).alias("s"))
    g = o.groupBy("id").agg(F.transform(F.collect_list("s"), lambda s: s["d"]).alias("dates"))
    return g.select("id", cards.recency_note(F.col("dates"), now()).alias("r")).select("id", "r.note", "r.is_current")


SORTS_SQL = {
    "overall": "overall DESC", "monthly_total": "est_total_min", "base_rent": "rent_min", "commute": "free_flow_minutes", "noise": "noise DESC", "management": "management DESC", "pests": "pests DESC",
    "building_safety": "building_safety DESC", "neighborhood_safety": "neighborhood_safety DESC", "review_rating": "coalesce(CASE WHEN panel_status = 'ok' THEN panel_rating END, review_average) DESC",
    "google_rating": "CASE WHEN panel_status = 'ok' THEN panel_rating END DESC", "confidence": "list_position(['insufficient', 'low', 'medium', 'high'], confidence) DESC",
}
_SCORES = ("overall", "noise", "management", "pests", "building_safety", "neighborhood_safety")


def _score(k: int) -> str:
    return f"CASE WHEN (c_custkey + {k}) % {5 + k} > 0 THEN (c_custkey * {k + 3}) % 91 / 10.0 + 1 END"


@query(f"""
WITH c AS (SELECT c_custkey AS id, c_name AS name, {', '.join(f'{_score(k)} AS {x}' for k, x in enumerate(_SCORES))}, CASE WHEN c_custkey % 7 > 0 THEN 2000 + c_custkey % 300 END AS est_total_min, CASE WHEN c_custkey % 8 > 0 THEN 1900 + c_custkey % 250 END AS rent_min,
  CASE WHEN c_custkey % 9 > 0 THEN c_custkey % 60 END AS free_flow_minutes, CASE WHEN c_custkey % 3 > 0 THEN 'ok' ELSE 'no_match' END AS panel_status, c_custkey % 50 / 10.0 AS panel_rating, CASE WHEN c_custkey % 4 > 0 THEN c_custkey % 45 / 10.0 END AS review_average,
  ['insufficient', 'low', 'medium', 'high'][c_custkey % 4 + 1] AS confidence FROM customer)
{' UNION ALL '.join(f"SELECT '{k}' AS key, id, row_number() OVER (ORDER BY {v} NULLS LAST, overall DESC NULLS LAST, name, id) AS rank FROM c" for k, v in SORTS_SQL.items())}
""")
def sorted_cards(spark, sf_dir):
    c = table(spark, sf_dir, "customer").selectExpr(
        "c_custkey AS id", "c_name AS name", *(f"{_score(k).replace('/ 10.0', '/ 10D')} AS {x}" for k, x in enumerate(_SCORES)), "CASE WHEN c_custkey % 7 > 0 THEN 2000 + c_custkey % 300 END AS est_total_min", "CASE WHEN c_custkey % 8 > 0 THEN 1900 + c_custkey % 250 END AS rent_min",
        "CASE WHEN c_custkey % 9 > 0 THEN c_custkey % 60 END AS free_flow_minutes", "CASE WHEN c_custkey % 3 > 0 THEN 'ok' ELSE 'no_match' END AS panel_status", "c_custkey % 50 / 10D AS panel_rating", "CASE WHEN c_custkey % 4 > 0 THEN c_custkey % 45 / 10D END AS review_average",
        "element_at(array('insufficient', 'low', 'medium', 'high'), CAST(c_custkey % 4 + 1 AS INT)) AS confidence")
    out = None
    for key in cards.SORT_KEYS:  # a fixed dozen; a list is sorted by one of them at a time
        one = c.select(F.lit(key).alias("key"), "id", F.row_number().over(Window.partitionBy(F.lit(key)).orderBy(*cards.sort_order(key))).cast("long").alias("rank"))
        out = one if out is None else out.unionByName(one)
    return out


@query(f"WITH {UNITS_SQL} SELECT p_brand, id, row_number() OVER (PARTITION BY p_brand ORDER BY p_size > 25 DESC, coalesce(beds, 99), low NULLS LAST, label NULLS LAST, id) AS place FROM v")
def unit_display_order(spark, sf_dir):
    u = _units(spark, sf_dir).withColumn("qualifies", F.col("p_size") > 25).withColumnRenamed("id", "unit_id")
    return u.select("p_brand", F.col("unit_id").alias("id"), F.row_number().over(Window.partitionBy("p_brand").orderBy(*cards.unit_order())).cast("long").alias("place"))


@query(f"""
WITH {UNITS_SQL}, d AS (SELECT p_brand, total - low AS d FROM v WHERE total - low >= 0), g AS (SELECT p_brand, count(DISTINCT d) AS n, min(d) AS a, max(d) AS z FROM d GROUP BY 1)
SELECT p_brand, n, CASE WHEN a = z THEN a END AS amount, CASE WHEN a = z THEN '$' || format('{{:,.0f}}', a) ELSE '$' || format('{{:,.0f}}', a) || '–$' || format('{{:,.0f}}', z) END || '/mo' AS text FROM g
""")
def fee_differences(spark, sf_dir):
    u = _units(spark, sf_dir).select("p_brand", F.col("base_min").cast("double").alias("base"), "total")
    return cards.fee_differences(u, "p_brand").select("p_brand", F.col("n").cast("long").alias("n"), "amount", "text")


@query("""
SELECT user_id, round(sum(a * 5 / s * n) / sum(n), 2) AS average, CAST(sum(n) AS BIGINT) AS n FROM (SELECT user_id, event_type, CASE WHEN user_id % 7 > 0 THEN max(value) END AS a, 1000.0::DOUBLE AS s, count(*) AS n FROM events GROUP BY 1, 2) WHERE event_type <> 'click' AND a IS NOT NULL GROUP BY 1
""")
def other_sources_average(spark, sf_dir):
    e = table(spark, sf_dir, "events").groupBy("user_id", F.col("event_type").alias("source")).agg(F.when(F.col("user_id") % 7 > 0, F.max("value")).alias("average"), F.lit(1000.0).alias("scale"), F.count("*").alias("n"))
    return cards.other_sources_average(e, "user_id", "click")


@query(r"""
SELECT event_id, map_from_entries(list_sort(list_filter([{'k': 'k', 'v': json_extract_string(props, '$.k')}, {'k': 't', 'v': 'x' || user_id}], lambda e: e.v IS NOT NULL))) AS details FROM events
""".replace("map_from_entries(list_sort(", "array_to_string(list_transform(").replace("lambda e: e.v IS NOT NULL))) AS", "lambda e: e.v IS NOT NULL), lambda e: e.k || '=' || e.v), ',') AS"))
def scalar_details(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    document = F.concat(F.regexp_replace("props", r"\}\s*$", ""), F.lit(', "t": "x'), F.col("user_id").cast("string"), F.lit('", "l": [1], "o": {"a": 1}, "n": null, "skip": 5}'))
    m = cards.scalar_details(document, exclude=("skip",))
    return e.select("event_id", F.array_join(F.transform(F.array_sort(F.map_entries(m)), lambda x: F.concat(x["key"], F.lit("="), x["value"])), ",").alias("details"))
