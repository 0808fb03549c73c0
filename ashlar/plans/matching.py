"""Matching, text and lineage queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ashlar.functions import scalars as S
from ashlar.operators import audit, matching, themes
from ashlar.plans.pricing import NOW, now
from ashlar.plans.registry import query
from ashlar.session import table
from ashlar.tables import apart, cut


@query("""
WITH t AS (SELECT source, doc_id, list_sort(list_distinct(regexp_extract_all(lower(text), '[a-z0-9'']+'))) AS w FROM documents),
c AS (SELECT source, w, min(doc_id) AS rep FROM t WHERE len(w) >= 5 GROUP BY 1, 2)
SELECT source, a, b, round(i / (na + nb - i), 6) AS similarity FROM (
  SELECT x.source, x.rep AS a, y.rep AS b, len(list_intersect(x.w, y.w)) AS i, len(x.w) AS na, len(y.w) AS nb FROM c x JOIN c y ON x.source = y.source AND x.rep < y.rep
  AND least(len(x.w), len(y.w)) >= 0.8 * greatest(len(x.w), len(y.w))) WHERE i / (na + nb - i) >= 0.8
""")
def near_duplicate_pairs(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    out = matching.near_duplicate_pairs(d, "source", "doc_id", "text")
    return out.select("source", "a", "b", F.round("similarity", 6).alias("similarity"))


@query("""
SELECT source, doc_id, min(doc_id) OVER (PARTITION BY source, w) AS representative
FROM (SELECT source, doc_id, list_sort(list_distinct(regexp_extract_all(lower(text), '[a-z0-9'']+'))) AS w FROM documents) WHERE len(w) >= 5
""")
def near_duplicate_members(spark, sf_dir):
    return matching.near_duplicate_members(table(spark, sf_dir, "documents").select("doc_id", "source", "text"), "source", "doc_id", "text")


@query("""
WITH p AS (SELECT c_custkey AS id, 37.2 + (c_custkey * 7919 % 4000) / 10000.0 AS lat, -122.3 + (c_custkey * 104729 % 5000) / 10000.0 AS lon FROM customer),
d AS (SELECT a.id AS a, b.id AS b, 2 * 6371000.0 * asin(sqrt(pow(sin(radians(CAST(b.lat - a.lat AS DOUBLE)) / 2), 2) + cos(radians(a.lat)) * cos(radians(b.lat)) * pow(sin(radians(CAST(b.lon - a.lon AS DOUBLE)) / 2), 2))) AS m
  FROM p a JOIN p b ON a.id <> b.id AND abs(a.lat - b.lat) < 0.02 AND abs(a.lon - b.lon) < 0.025)
SELECT a AS id, b AS nearest, round(m, 2) AS meters FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY round(m, 4), b) AS rn FROM d WHERE m <= 1500) WHERE rn = 1
""")
def spatial_match(spark, sf_dir):
    key = F.col("c_custkey")
    p = table(spark, sf_dir, "customer").select(key.alias("id"), (37.2 + (key * 7919 % 4000) / 10000.0).alias("lat"), (-122.3 + (key * 104729 % 5000) / 10000.0).alias("lon"))
    return matching.nearest(p, "id", 1500.0).select("id", "nearest", F.round("meters", 2).alias("meters"))


@query("""
WITH t AS (SELECT p_brand, p_name, list_distinct(regexp_extract_all(lower(p_name), '[a-z0-9]+')) AS w FROM (SELECT DISTINCT p_brand, p_name FROM part))
SELECT a.p_brand, a.p_name AS a, b.p_name AS b, round(len(list_intersect(a.w, b.w)) / (len(a.w) + len(b.w) - len(list_intersect(a.w, b.w))), 6) AS jaccard,
  round(len(list_intersect(a.w, b.w)) / least(len(a.w), len(b.w)), 6) AS overlap
FROM t a JOIN t b ON a.p_brand = b.p_brand AND a.p_name < b.p_name WHERE len(list_intersect(a.w, b.w)) > 0
""")
def name_token_match(spark, sf_dir):
    t = table(spark, sf_dir, "part").select("p_brand", "p_name").distinct().withColumn("w", S.name_tokens("p_name"))
    return matching.shared_tokens(t, "p_brand", "p_name", "w").select("p_brand", "a", "b", F.round("jaccard", 6).alias("jaccard"), F.round("overlap", 6).alias("overlap"))


@query("""
SELECT c_custkey, CASE WHEN c_custkey % 5 = 4 THEN NULL ELSE (c_custkey * 10) || ' ' || ['n', 's', 'e', 'w'][c_custkey % 4 + 1] || ' main ' || ['st', 'ave', 'blvd', 'rd', 'ct', 'pkwy'][c_custkey % 6 + 1] END AS address,
  CASE WHEN c_custkey % 3 = 0 THEN CAST(c_custkey AS VARCHAR) END AS unit FROM customer
""")
def normalized_address(spark, sf_dir):
    key = F.col("c_custkey")
    pick = lambda words, n: F.element_at(F.array(*map(F.lit, words)), (key % n + 1).cast("int"))
    number = F.when(key % 5 == 4, F.lit("Corner of")).otherwise((key * 10).cast("string"))
    tail = F.when(key % 3 == 0, F.concat(F.lit(" Apt "), key.cast("string"))).otherwise("")
    street = F.concat(number, F.lit("  "), pick(("North", "South", "East", "West"), 4), F.lit(" Main "), pick(("Street", "Avenue", "Boulevard", "Road", "Court", "Parkway"), 6), tail)
    c = table(spark, sf_dir, "customer").select("c_custkey", street.alias("street"))
    return c.select("c_custkey", S.normalize_street("street").alias("address"), S.unit_number("street").alias("unit"))


@query("SELECT o_orderkey, 'ev_' || left(sha1(o_orderkey || chr(31) || coalesce(nullif(o_orderstatus, 'O'), 'None') || chr(31) || o_orderpriority), 20) AS id FROM orders")
def stable_ids(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.nullif("o_orderstatus", F.lit("O")).alias("s"), "o_orderpriority")
    return o.select("o_orderkey", S.stable_id("ev", "o_orderkey", "s", "o_orderpriority").alias("id"))


@query(r"""
SELECT page_id, regexp_replace(lower(regexp_extract(url, '^https?://([^/?#]*)', 1)), '^www\.', '') AS host,
  path || CASE WHEN len(kept) > 0 THEN '?' || array_to_string(kept, '&') ELSE '' END AS url
FROM (SELECT page_id, url, regexp_extract(bare, '^([^?]*)', 1) AS path, list_filter(string_split(regexp_extract(bare, '\?(.*)$', 1), '&'), lambda p: p <> '' AND NOT regexp_matches(p, '^(utm_[^=]*|gclid|fbclid|msclkid|ref)(=|$)')) AS kept
  FROM (SELECT *, regexp_replace(url, '#.*$', '') AS bare FROM pages))
""")
def url_canonicalize(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", S.site_host("url").alias("host"), S.clean_url("url").alias("url"))


@query(r"""
SELECT page_id, length(t) AS n_chars, sha256(t) AS text_sha256 FROM (SELECT page_id, trim(regexp_replace(replace(replace(replace(replace(replace(replace(
  regexp_replace(regexp_replace(html, '(?is)<(script|style)\b.*?</(script|style)>|<!--.*?-->', ' ', 'g'), '<[^>]*>', ' ', 'g'),
  '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&amp;', '&'), '\s+', ' ', 'g')) AS t FROM pages)
""")
def visible_text(spark, sf_dir):
    p = table(spark, sf_dir, "pages").select("page_id", S.visible_text("html").alias("t"))
    return p.select("page_id", F.length("t").cast("long").alias("n_chars"), F.sha2("t", 256).alias("text_sha256"))


@query(r"""
SELECT doc_id, count(*) AS n_sentences, CAST(sum(length(s)) AS BIGINT) AS n_chars FROM (
  SELECT doc_id, trim(regexp_replace(unnest(string_split(regexp_replace(regexp_replace(regexp_replace(translate(text, '‘’“” ', '''''"" '), '([.!?])[ \t\n\r\f\v]+', '\1' || chr(1), 'g'),
    '[ \t\r\f\v]*\n+[ \t\r\f\v]*', chr(1), 'g'), '([.!?])([A-Z][a-z])', '\1' || chr(1) || '\2', 'g'), chr(1))), '[ \t\n\r\f\v]+', ' ', 'g')) AS s FROM documents) WHERE s <> '' GROUP BY 1
""")
def sentence_split(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", S.sentences("text").alias("s"))
    n = F.aggregate("s", F.lit(0), lambda a, x: a + F.length(x))
    return d.where(F.size("s") > 0).select("doc_id", F.size("s").cast("long").alias("n_sentences"), n.cast("long").alias("n_chars"))


FEES = ("Trash $25/mo required; Parking (1 space, covered) $150 per month, Pet deposit $500", "Admin fee $1,250.50 one-time; Water, sewer and gas billed back", "Storage $40-$75 monthly optional", "Internet package $60 monthly must be taken\nInsurance", " ")
OFFERS = ("8 weeks free on select homes", "One month free", "Up to 6 weeks of free rent", "half a month free", "Two weeks free!", "Reduced deposits", "")


#: What the fee texts name, by reading: text, place, type, description, amount, its text, recurring, mandatory (null: as assumed).
FEES_READ = (
    (0, 0, "trash", "Trash $25/mo required", 25, "$25", True, True), (0, 1, "parking", "Parking (1 space, covered) $150 per month", 150, "$150", True, None), (0, 2, "pet", "Pet deposit $500", 500, "$500", False, None),
    (1, 0, "other", "Admin fee $1,250.50 one-time", 1250, "$1,250.50", False, None), (1, 1, "utilities", "Water", None, None, None, None), (1, 2, "utilities", "sewer and gas billed back", None, None, None, None),
    (2, 0, "storage", "Storage $40-$75 monthly optional", None, "$40-$75 monthly optional", True, False), (3, 0, "internet", "Internet package $60 monthly must be taken", 60, "$60", True, True), (3, 1, "insurance", "Insurance", None, None, None, None),
)


def _literal(x) -> str:
    return "NULL" if x is None else f"'{x}'" if isinstance(x, str) else str(x)


FEES_SQL = "(VALUES " + ", ".join(f"({', '.join(map(_literal, r))})" for r in FEES_READ) + ") f(k, pos, fee_type, description, amount, amount_text, recurring, said)"


@query(f"SELECT s_suppkey, pos, fee_type, description, amount, amount_text, recurring, CASE WHEN said IS NULL AND s_suppkey % 2 = 0 THEN true ELSE said END AS mandatory FROM supplier JOIN {FEES_SQL} ON s_suppkey % 5 = k")
def fee_text_rows(spark, sf_dir):
    key = F.col("s_suppkey")
    s = table(spark, sf_dir, "supplier").select("s_suppkey", F.element_at(F.array(*map(F.lit, FEES)), (key % len(FEES) + 1).cast("int")).alias("t"))
    items = S.fee_items("t", F.when(key % 2 == 0, True))
    return s.select("s_suppkey", F.posexplode(items).alias("pos", "f")).select("s_suppkey", "pos", "f.*")


@query("""
WITH p AS (SELECT p_partkey, 1500 + p_partkey % 900 AS base, CASE WHEN p_partkey % 4 > 0 THEN 6 + p_partkey % 9 END AS months, p_partkey % 7 AS k FROM part),
o AS (SELECT *, CASE k WHEN 0 THEN 8.0 WHEN 1 THEN 52 / 12.0 WHEN 2 THEN 6.0 WHEN 3 THEN 26 / 12.0 WHEN 4 THEN 2.0 END::DOUBLE AS w, CASE WHEN k = 6 THEN NULL ELSE k IN (1, 3, 4) END AS is_definite FROM p)
SELECT p_partkey, base, months, round(w, 6) AS free_weeks, is_definite, CASE WHEN is_definite AND w < months * 52 / 12.0 THEN CAST(round_even(base * (months * 52 / 12.0::DOUBLE - w) / (months * 52 / 12.0::DOUBLE), 0) AS BIGINT) END AS effective FROM o
""")
def promotion_terms(spark, sf_dir):
    key = F.col("p_partkey")
    p = table(spark, sf_dir, "part").select("p_partkey", (1500 + key % 900).alias("base"), F.when(key % 4 > 0, 6 + key % 9).alias("months"), F.element_at(F.array(*map(F.lit, OFFERS)), (key % len(OFFERS) + 1).cast("int")).alias("t"))
    p = p.withColumn("promo", S.promotion("t"))
    return p.select("p_partkey", "base", "months", F.round("promo.free_weeks", 6).alias("free_weeks"), "promo.is_definite", S.effective_rent("base", "months", F.col("promo")).alias("effective"))


@query(f"""
WITH refs AS (SELECT l_orderkey AS claim, CASE WHEN l_linenumber = 7 THEN -l_orderkey WHEN l_linenumber = 6 THEN l_orderkey % 100 + 1 ELSE l_orderkey END AS o_orderkey, l_suppkey FROM lineitem),
c AS (SELECT DISTINCT claim, o_orderkey, o.o_custkey AS own FROM refs JOIN (SELECT o_orderkey AS k, o_custkey FROM orders) o ON o.k = claim),
v AS (SELECT c.claim, c.o_orderkey, o.o_orderdate AS published, CASE WHEN o.o_custkey IS NULL THEN 'missing' WHEN o.o_custkey <> c.own THEN 'wrong_owner' WHEN o.o_orderstatus = 'P' THEN 'unsupported' ELSE 'valid' END AS verdict FROM c LEFT JOIN orders o ON o.o_orderkey = c.o_orderkey)
SELECT claim, count(*) FILTER (verdict = 'missing') AS missing, count(*) FILTER (verdict = 'wrong_owner') AS wrong_owner, count(*) FILTER (verdict = 'unsupported') AS unsupported, count(*) FILTER (verdict = 'valid') AS valid,
  count(*) FILTER (verdict = 'valid') > 0 AS kept, count(*) FILTER (verdict = 'valid') > 0 AND count(*) FILTER (verdict = 'valid' AND date_diff('second', published, TIMESTAMP '{NOW}') > 730 * 86400) = count(*) FILTER (verdict = 'valid') AS qualified
FROM v GROUP BY 1
""")
def lineage_audit(spark, sf_dir):
    key, line = F.col("l_orderkey"), F.col("l_linenumber")
    refs = table(spark, sf_dir, "lineitem").select(key.alias("claim"), F.when(line == 7, -key).when(line == 6, key % 100 + 1).otherwise(key).alias("o_orderkey")).distinct()
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderdate")
    owned = refs.join(o.select(F.col("o_orderkey").alias("claim"), F.col("o_custkey").alias("own")), "claim")
    evidence = o.withColumnRenamed("o_custkey", "__owner")
    seen = audit.classify_references(owned, evidence, "o_orderkey", "own", F.col("o_orderstatus") != "P")
    return audit.audit_claims(seen, ["claim"], "o_orderdate", now())


#: Review texts made up for these queries; rows of the customer table deal them out.
REVIEWS = (
    "The walls are paper thin. I can hear everything my neighbors do every night!", "Very quiet building and the staff is helpful. Maintenance fixed it quickly.",
    "Never had any bugs or roaches here. It is a peaceful place.", "We saw roaches again and again. Management ignored our requests.",
    "New management took over. Since then the elevator is always broken.", "Packages were stolen twice. This keeps happening every month.",
    "Not quiet at all: street noise and loud neighbors.", "Parking is a nightmare. Water outages too. I feel safe though, good security.",
    "They kept my deposit and added hidden fees.", "Mold in the bathroom, slow internet and no parking.", "Nothing to report.", "No doubt noisy. Mice in the kitchen; ants as well.",
)


#: What each of them states, by reading: number, theme, its polarity, the first sentence that says so, and whether it recurs.
STATED = (
    (0, "noise", "thin_walls", "negative", "The walls are paper thin.", True), (1, "noise", "quiet", "positive", "Very quiet building and the staff is helpful.", False),
    (1, "management", "helpful_staff", "positive", "Very quiet building and the staff is helpful.", False), (1, "management", "quick_repairs", "positive", "Maintenance fixed it quickly.", False),
    (2, "pests", "no_pests", "positive", "Never had any bugs or roaches here.", False), (2, "noise", "quiet", "positive", "It is a peaceful place.", False),
    (3, "pests", "cockroaches", "negative", "We saw roaches again and again.", True), (3, "management", "responsiveness", "negative", "Management ignored our requests.", False),
    (4, "management", "management_change", "neutral", "New management took over.", False), (4, "other_issues", "elevators", "negative", "Since then the elevator is always broken.", True),
    (5, "building_safety", "package_theft", "negative", "Packages were stolen twice.", True), (6, "noise", "other_noise", "negative", "Not quiet at all: street noise and loud neighbors.", False),
    (6, "noise", "street_traffic", "negative", "Not quiet at all: street noise and loud neighbors.", False), (6, "noise", "neighbor_noise", "negative", "Not quiet at all: street noise and loud neighbors.", False),
    (7, "other_issues", "parking", "negative", "Parking is a nightmare.", False), (7, "other_issues", "water_shutdowns", "negative", "Water outages too.", False),
    (7, "building_safety", "secure_building", "positive", "I feel safe though, good security.", False), (8, "management", "deposit_disputes", "negative", "They kept my deposit and added hidden fees.", False),
    (8, "management", "unexplained_charges", "negative", "They kept my deposit and added hidden fees.", False), (9, "other_issues", "mold", "negative", "Mold in the bathroom, slow internet and no parking.", False),
    (9, "other_issues", "internet", "negative", "Mold in the bathroom, slow internet and no parking.", False), (9, "other_issues", "parking", "negative", "Mold in the bathroom, slow internet and no parking.", False),
    (11, "noise", "other_noise", "negative", "No doubt noisy.", False), (11, "pests", "rodents", "negative", "Mice in the kitchen; ants as well.", False), (11, "pests", "ants", "negative", "Mice in the kitchen; ants as well.", False),
)
STATED_SQL = "(VALUES " + ", ".join(f"({k}, '{c}', '{t}', '{p}', '{x}', {again})" for k, c, t, p, x, again in STATED) + ") s(k, category, theme, polarity, excerpt, recurring)"


def reviews(spark, sf_dir):
    key = F.col("c_custkey")
    c = table(spark, sf_dir, "customer").select(
        key.alias("review"), (key % 40).alias("property"), F.concat(F.lit("s"), (key % 3).cast("string")).alias("source"),
        F.when(key % 11 > 0, F.expr("timestampadd(DAY, -CAST(c_custkey * 37 % 3000 AS INT), TIMESTAMP_NTZ'2001-08-01 00:00:00')")).alias("published"),
        F.element_at(F.array(*map(F.lit, REVIEWS)), (key * 7 % len(REVIEWS) + 1).cast("int")).alias("text"))
    return c


@query(f"SELECT c_custkey AS review, category, theme, polarity, excerpt, recurring FROM customer JOIN {STATED_SQL} ON c_custkey * 7 % 12 = k")
def theme_mentions(spark, sf_dir):
    return themes.mine(reviews(spark, sf_dir), "review", "text")


def mined(spark, sf_dir):
    """The reviews, and what they mention, mined once and written."""
    r = reviews(spark, sf_dir)
    return r.withColumn("parts", F.lit(None).cast("map<string,double>")), cut(themes.mine(r, "review", "text"))


#: The reviews in SQL: review, property, source, published.
REVIEWS_AS_SQL = """rv AS (SELECT c_custkey AS review, c_custkey % 40 AS property, 's' || c_custkey % 3 AS source, c_custkey * 7 % 12 AS k,
  CASE WHEN c_custkey % 11 > 0 THEN TIMESTAMP '2001-08-01' - to_days((c_custkey * 37 % 3000)::INT) END AS published FROM customer)"""


@query(f"""
WITH {REVIEWS_AS_SQL}, p AS (SELECT property, theme, review, published, recurring, date_diff('day', lag(published) OVER (PARTITION BY property, theme ORDER BY published NULLS LAST, review), published) AS gap
  FROM rv JOIN {STATED_SQL} USING (k) WHERE category = 'pests' AND polarity = 'negative'),
g AS (SELECT property, theme, bool_or(recurring) AS said, count(DISTINCT review) AS reviews, coalesce(min(gap) <= 730, false) AS soon, count(published) AS dated FROM p GROUP BY 1, 2)
SELECT property, theme, reviews, said OR reviews > 1 AND (soon OR dated < reviews) AS recurring FROM g
""")
def pest_patterns(spark, sf_dir):
    r, m = mined(spark, sf_dir)
    return themes.pest_patterns(r.drop("text", "parts"), m)


@query("SELECT c_custkey AS id, min(c_custkey) OVER (PARTITION BY c_custkey // 3) AS entity FROM customer")
def entity_resolution(spark, sf_dir):
    key = F.col("c_custkey")
    site = F.floor(key / 3)
    r = table(spark, sf_dir, "customer").select(
        key.alias("id"), F.concat(F.lit("The Site "), site.cast("string"), F.lit(" Apartments")).alias("name"), F.concat((site * 10 + 1).cast("string"), F.lit(" Main Street")).alias("street"),
        F.lit("Town").alias("city"), F.when(key % 3 == 0, F.lit("94000")).alias("zip"), (37.2 + site * 0.01 + key % 3 * 0.0001).alias("lat"), F.lit(-122.0).alias("lon"))
    return matching.resolve(r)


# Customers as records: the address from the key and the segment, the area from the nation or the balance. Even keys come first, then the odd ones with every twentieth even one again.
_ADDRESSES = """
WITH RECURSIVE c AS (SELECT c_custkey AS id, concat(c_custkey % 11 + 1, ' ', c_mktsegment, ' Street') AS addr, CASE WHEN c_custkey % 5 > 0 THEN c_nationkey % 9 END AS zip,
    CASE WHEN c_custkey % 3 > 0 THEN floor(abs(c_acctbal))::BIGINT % 7 END AS city, c_custkey % 30 = 1 AND c_custkey - 1 IN (SELECT c_custkey FROM customer) AS hinted FROM customer),
k AS (SELECT id, addr || '|z' || zip AS k FROM c WHERE NOT hinted UNION ALL SELECT id, addr || '|c' || city FROM c WHERE NOT hinted), g AS (SELECT id, k FROM k WHERE k IS NOT NULL),
first(id, root) AS (SELECT id, id FROM c WHERE id % 2 = 0 UNION SELECT b.id, f.root FROM first f JOIN g a ON a.id = f.id JOIN g b ON b.k = a.k AND b.id % 2 = 0),
e AS (SELECT id, min(root) AS entity FROM first GROUP BY 1),
l AS (SELECT a.id AS u, b.id AS v FROM g a JOIN g b ON a.k = b.k UNION SELECT id, id - 1 FROM c WHERE hinted UNION SELECT id - 1, id FROM c WHERE hinted),
both_(id, root) AS (SELECT id, id FROM c UNION SELECT l.v, b.root FROM both_ b JOIN l ON l.u = b.id),
o AS (SELECT id, min(root) AS low, min(CASE WHEN root % 2 = 0 THEN root END) AS stored FROM both_ GROUP BY 1)
"""


def _addresses(spark, sf_dir):
    key = F.col("c_custkey")
    return table(spark, sf_dir, "customer").select(
        key.alias("id"), F.lit(None).cast("long").alias("hint"), F.lit("x").alias("name"), F.concat((key % 11 + 1).cast("string"), F.lit(" "), "c_mktsegment", F.lit(" Street")).alias("street"),
        F.when(key % 3 > 0, F.concat(F.lit("Town "), (F.floor(F.abs("c_acctbal")) % 7).cast("string"))).alias("city"), F.when(key % 5 > 0, (F.col("c_nationkey") % 9).cast("string")).alias("zip"),
        F.lit(None).cast("double").alias("lat"), F.lit(None).cast("double").alias("lon"))


def _two_arrivals(spark, sf_dir):
    r = _addresses(spark, sf_dir)
    key = F.col("id")
    one = matching.arrive(matching.no_members(spark), r.where(key % 2 == 0))
    hints = one.members.select((key + 1).alias("id"), F.col("entity").alias("__h"))
    odd = r.where(key % 2 == 1).join(apart(hints, one.members.count()), "id", "left").withColumn("hint", F.when(key % 30 == 1, F.col("__h"))).drop("__h")
    again = r.where(key % 20 == 0).withColumn("street", F.lit("1 Elsewhere Road"))
    return one, matching.arrive(one.members, odd.unionByName(again))


@query(_ADDRESSES + """
SELECT o.id, coalesce(o.stored, o.low) AS entity, CASE WHEN id % 2 = 0 THEN CASE WHEN id % 20 = 0 THEN 'link' ELSE 'stored' END WHEN hinted THEN 'hint' WHEN coalesce(o.stored, o.low) = id THEN 'new' ELSE 'match' END AS reason FROM o JOIN c USING (id)
""")
def incremental_entities(spark, sf_dir):
    """Each record after two arrivals: its entity, and why the second arrival put it there."""
    _, two = _two_arrivals(spark, sf_dir)
    return two.members.select("id", "entity").join(apart(two.decisions.select("id", "reason"), two.members.count()), "id", "left").select("id", "entity", F.coalesce("reason", F.lit("stored")).alias("reason"))


@query(_ADDRESSES + "SELECT DISTINCT e.entity, o.stored AS into FROM e JOIN o USING (id) WHERE e.entity <> o.stored")
def entity_merges(spark, sf_dir):
    """Stored entities that the second arrival found to be one with another."""
    _, two = _two_arrivals(spark, sf_dir)
    return two.merges
