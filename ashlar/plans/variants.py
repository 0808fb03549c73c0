"""Queries of pages read as VARIANT. Pages are put together from the tables by one expression that Spark and DuckDB both know; each side then reads them with its own JSON functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ashlar.plans.registry import query
from ashlar.session import table
from ashlar.sources import variants

_LD = '<script type="application/ld+json">'

#: A search page: places, offers for some, an item that is none, a block that isn't JSON, one that is no array, and a second card of the first listing.
_SEARCH_PAGE = f"""concat('<html>{_LD}[',
'{{"@type":"Apartment","url":"/apartment/', page_id, '","name":"House ', page_id % 7, ' - Town","numberOfRooms":"', page_id % 3, '-', page_id % 3 + 1,
'","geo":{{"latitude":"', 30 + page_id % 10, '.5","longitude":-', page_id % 100, '}},"address":{{"streetAddress":"', page_id, ' Elm St","addressLocality":"City ', length(url) % 5, '"}}}},',
'{{"@type":"Apartment","url":"/home/', page_id + 1000, '","name":"","numberOfRooms":', page_id % 4, ',"address":{{"streetAddress":"', page_id, ' Oak St"}}}},',
'{{"@type":"Apartment","url":"/other/', page_id, '"}},17,null,',
CASE WHEN page_id % 2 = 0 THEN concat('{{"@type":"Product","url":"/apartment/', page_id, '","offers":{{"price":"', length(html) % 3000 + 1, '"}}}},') ELSE '' END,
'{{"@type":"Product","url":"/home/1","offers":{{"price":5}}}}]</script>',
CASE WHEN page_id % 3 = 0 THEN '{_LD}[{{"url":"/home/77"</script>' ELSE '' END, '{_LD}{{"url":"/home/88"}}</script>',
CASE WHEN page_id % 4 = 0 THEN concat('{_LD}[{{"@type":"Apartment","url":"/x/apartment/', page_id, '","name":"Again","numberOfRooms":2}}]</script>') ELSE '' END, '</html>')"""


@query(f"""
WITH p AS (SELECT page_id, regexp_extract_all({_SEARCH_PAGE}, '(?s)<script type="application/ld\\+json">(.*?)</script>', 1) AS l FROM pages),
b AS (SELECT page_id, i AS block, l[i] AS t FROM (SELECT *, unnest(range(1, len(l) + 1)) AS i FROM p)),
v AS (SELECT page_id, block, t::JSON AS t FROM b WHERE json_valid(t) AND CASE WHEN json_valid(t) THEN json_type(t) END = 'ARRAY'),
i AS (SELECT page_id, block, k, json_extract(t, '$[' || k || ']') AS x FROM (SELECT *, unnest(range(json_array_length(t)::BIGINT)) AS k FROM v)),
o AS (SELECT page_id, block, k, x, x->>'$.url' AS url, coalesce(x->>'$."@type"' = 'Product', false) AS offer FROM i WHERE json_type(x) = 'OBJECT'),
c AS (SELECT page_id, block, url, min(k) FILTER (NOT offer) AS first, max_by(x, k) FILTER (NOT offer) AS place, max_by(x, k) FILTER (offer) AS offer FROM o WHERE url IS NOT NULL GROUP BY ALL),
l AS (SELECT *, regexp_extract(url, '/(?:apartment|home)/(\\d+)', 1) AS listing_id FROM c WHERE place IS NOT NULL),
z AS (SELECT * FROM l WHERE listing_id <> '' QUALIFY row_number() OVER (PARTITION BY page_id, listing_id ORDER BY block DESC, first DESC) = 1),
r AS (SELECT *, string_split(place->>'$.numberOfRooms', '-') AS n FROM z)
SELECT page_id, listing_id, url, coalesce(nullif(trim(string_split(place->>'$.name', ' - ')[1]), ''), nullif(place->>'$.address.streetAddress', ''), url) AS name, place->>'$.address.addressLocality' AS city,
  (place->>'$.geo.latitude')::DOUBLE AS lat, (place->>'$.geo.longitude')::DOUBLE AS lon, (offer->>'$.offers.price')::BIGINT AS price,
  array_to_string(range(n[1]::BIGINT, greatest(n[1]::BIGINT, n[len(n)]::BIGINT) + 1), ',') AS beds FROM r
""")
def search_page_cards(spark, sf_dir):
    p = table(spark, sf_dir, "pages").select("page_id", F.expr(_SEARCH_PAGE).alias("page"))
    cards = variants.search_cards(p, "page_id", "page")
    return cards.withColumn("beds", F.array_join(F.transform("beds", lambda b: b.cast("string")), ","))


#: A listing's JSON: a price history, attributions at two depths, an id of the network, a statement that lies as deep as the document's number says, and a footer.
_LISTING = """concat('{"typedHomeId":"', doc_id, CASE WHEN doc_id % 2 = 0 THEN '_ZPID"' ELSE '"' END, ',"priceHistory":[{"source":" ', source, ' "},{"source":"N/A"},{"source":', n_chars, '},7,{"source":"', lang, '"}],',
'"activeListing":{"provider":{"listingSource":{"attribution":{"agent":{"name":"', lang, ' agent","url":"no"}},"other":"no"', CASE WHEN doc_id % 3 = 0 THEN concat(',"alternativeSources":[{"t":[" ', source, ' "]},{"t":"', source, '"}]') ELSE '' END, '}}},',
'"deep":', repeat('{"n":[', CAST(doc_id % 11 AS INT)), CASE WHEN n_chars % 3 = 0 THEN '{"note":" x is part of Zillow Group ","label":"part of Zillow Group"}' ELSE '{}' END, repeat(']}', CAST(doc_id % 11 AS INT)), ',',
'"f":[{"label":"Trulia Corporate","children":[3,{"label":"', CASE WHEN doc_id % 5 = 0 THEN 'About Zillow Group' ELSE 'About' END, '"}]}]}')"""


@query(f"""
WITH d AS (SELECT doc_id AS k, ({_LISTING})::JSON AS j FROM documents),
t AS (SELECT k, key, fullkey, type, t.value AS x, CASE WHEN type = 'VARCHAR' THEN trim(t.atom->>'$') END AS s FROM d, json_tree(d.j) t),
h AS (SELECT k, trim(json_extract(j, '$.priceHistory[' || i || '].source')->>'$') AS s FROM (SELECT *, unnest(range(json_array_length(j, '$.priceHistory')::BIGINT)) AS i FROM d) WHERE json_type(json_extract(j, '$.priceHistory[' || i || '].source')) = 'VARCHAR'),
a AS (SELECT k, 0 AS kind, s AS what FROM h WHERE s NOT IN ('', 'N/A')
  UNION SELECT k, 1, s FROM t WHERE s <> '' AND key IS NOT NULL AND key NOT IN ('url', '__typename', 'logoUrl') AND try_cast(key AS BIGINT) IS NULL AND (starts_with(fullkey, '$.activeListing.provider.listingSource.attribution') OR starts_with(fullkey, '$.activeListing.provider.listingSource.alternativeSources'))
  UNION SELECT k, 2, regexp_extract(j->>'$.typedHomeId', '^(.*)_ZPID$', 1) FROM d WHERE ends_with(j->>'$.typedHomeId', '_ZPID')
  UNION SELECT k, 3, 'page states "' || s || '"' FROM t WHERE key <> 'label' AND contains(s, 'part of Zillow Group')
  UNION SELECT k, 4, 'page lists "About Zillow Group" under "Trulia Corporate"' FROM t WHERE type = 'OBJECT' AND x->>'$.label' = 'Trulia Corporate' AND list_contains(json_extract_string(x, '$.children[*].label'), 'About Zillow Group'))
SELECT k AS doc_id, string_agg(CASE kind WHEN 0 THEN 'price history source: ' WHEN 1 THEN 'listing source attribution: ' WHEN 2 THEN 'listed under Zillow property ID (zpid) ' ELSE '' END || what, '; ' ORDER BY kind, what) AS signals,
  coalesce(string_agg(what, ',' ORDER BY what) FILTER (kind = 0), '') AS history_sources, max(what) FILTER (kind = 2) AS property_id, 'Zillow Group' AS network, false AS independent FROM a GROUP BY k
""")
def deep_feed_signals(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", F.expr(_LISTING).alias("json"))
    out = variants.feed_signals(d, "doc_id", "json")
    return out.withColumn("signals", F.array_join("signals", "; ")).withColumn("history_sources", F.array_join("history_sources", ","))


#: Pages of two platforms and of none, some broken: no JSON, no list of units, brackets that never close, no price, a null page; some that the first reader can't read and the second can.
_SITE_PAGE = """CASE p_partkey % 9 WHEN 8 THEN NULL WHEN 7 THEN concat('<p>', p_name, '</p>') WHEN 6 THEN concat('<script id="jd-fp-data-script-app">', repeat('[', CAST(p_size * 400 AS INT)), '</script>')
ELSE concat(CASE WHEN p_partkey % 9 IN (0, 1) THEN concat('<script>Fusion.globalContent={"units":[{"unitId":"u', p_partkey, '","bedroomNumber":', p_size % 4, ',"startingAtPricesUnfurnished":{"prices":{"price":', p_partkey % 2000, ',"totalPrice":', p_partkey % 2000 + 10, '.5}}}]};Fusion.x=1</script>')
  WHEN p_partkey % 9 IN (2, 3) THEN '<script>Fusion.globalContent={bad};Fusion.x=1</script>' WHEN p_partkey % 9 = 4 THEN '<script>Fusion.globalContent={"units":"none"};Fusion.x=1</script>' ELSE '' END,
  CASE WHEN p_partkey % 9 IN (1, 3, 5) THEN concat('<script id="jd-fp-data-script-app">{"units":[{"id_value":"v', p_partkey, '","bedrooms":', p_size % 3, ',"price_entity":{"priceLow":', p_partkey % 1500 + 1, ',"pricingReflectFees":', CASE WHEN p_size % 2 = 0 THEN 'true' ELSE 'false' END,
    ',"adjusted":{"low_no_fees":', p_partkey % 1500, '}}},{"id":"free"}]}</script>') ELSE '' END) END"""


@query(f"""
WITH p AS (SELECT p_partkey AS id, {_SITE_PAGE} AS page FROM part),
a AS (SELECT id, page, nullif(regexp_extract(page, '(?s)Fusion\\.globalContent=(.*?);Fusion', 1), '') AS one, nullif(regexp_extract(page, '(?s)id="jd-fp-data-script-app">(.*?)</script>', 1), '') AS two FROM p),
b AS (SELECT id, CASE WHEN json_valid(one) THEN CASE WHEN json_type(one, '$.units') = 'ARRAY' THEN one::JSON END END AS one, CASE WHEN json_valid(two) THEN CASE WHEN json_type(two, '$.units') = 'ARRAY' THEN two::JSON END END AS two FROM a),
u AS (SELECT id, 'platform_1' AS reader, unnest(json_extract(one, '$.units[*]')) AS x FROM b WHERE one IS NOT NULL UNION ALL SELECT id, 'platform_2', unnest(json_extract(two, '$.units[*]')) FROM b WHERE one IS NULL AND two IS NOT NULL),
r AS (SELECT id, reader, coalesce(x->>'$.unitId', x->>'$.id_value') AS unit_key, coalesce(x->>'$.bedroomNumber', x->>'$.bedrooms')::INT AS beds, (x->>'$.startingAtPricesUnfurnished.prices.price')::DOUBLE AS p1, (x->>'$.startingAtPricesUnfurnished.prices.totalPrice')::DOUBLE AS t1,
  (x->>'$.price_entity.priceLow')::DOUBLE AS low, (x->>'$.price_entity.adjusted.low_no_fees')::DOUBLE AS bare, coalesce((x->>'$.price_entity.pricingReflectFees')::BOOLEAN, false) AS fees FROM u)
SELECT id, reader, unit_key, beds, nullif(CASE WHEN reader = 'platform_1' THEN p1 WHEN fees THEN bare ELSE low END, 0) AS base_min, CASE WHEN reader = 'platform_1' THEN t1 WHEN fees THEN low END AS total
FROM r WHERE p1 IS NOT NULL OR low IS NOT NULL
""")
def platform_pages(spark, sf_dir):
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.expr(_SITE_PAGE).alias("page"))
    rows = variants.read_in_turn(p, "id", "page", variants.PLATFORM_READERS).rows
    return rows.where("unit IS NOT NULL").select("id", "reader", "unit.unit_key", "unit.beds", "unit.base_min", "unit.total")


@query(f"""
WITH p AS (SELECT p_partkey AS id, {_SITE_PAGE} AS page FROM part),
a AS (SELECT id, coalesce(contains(page, 'Fusion.globalContent='), false) AS s1, coalesce(contains(page, 'jd-fp-data-script-app'), false) AS s2, regexp_extract(page, '(?s)Fusion\\.globalContent=(.*?);Fusion', 1) AS one, regexp_extract(page, '(?s)id="jd-fp-data-script-app">(.*?)</script>', 1) AS two FROM p),
b AS (SELECT *, CASE WHEN NOT s1 THEN NULL WHEN NOT json_valid(one) THEN 'no data' WHEN json_type(one, '$.units') IS DISTINCT FROM 'ARRAY' THEN 'no units' END AS r1,
  CASE WHEN NOT s2 THEN NULL WHEN NOT json_valid(two) THEN 'no data' WHEN json_type(two, '$.units') IS DISTINCT FROM 'ARRAY' THEN 'no units' END AS r2 FROM a)
SELECT id, 'platform_1' AS reader, r1 AS reason FROM b WHERE r1 IS NOT NULL UNION ALL SELECT id, 'platform_2', r2 FROM b WHERE r2 IS NOT NULL AND (NOT s1 OR r1 IS NOT NULL)
UNION ALL SELECT id, NULL, 'no platform' FROM b WHERE NOT s1 AND NOT s2
""")
def failed_pages(spark, sf_dir):
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.expr(_SITE_PAGE).alias("page"))
    return variants.read_in_turn(p, "id", "page", variants.PLATFORM_READERS).failures
