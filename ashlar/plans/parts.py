"""Queries of small operators: pages, hosts, evidence lists, cards, places, official figures and scalar functions."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ashlar.functions import scalars as S
from ashlar.operators import quality, views
from ashlar.operators.scoring import CATEGORY_WEIGHTS
from ashlar.plans.pricing import NOW, now
from ashlar.plans.registry import query
from ashlar.plans.screening import pick
from ashlar.plans.streams import _events
from ashlar.session import table
from ashlar.sources import listings, official, pages
from ashlar.streaming import streams


@query(f"""
WITH f AS (SELECT page_id, url, [html, html || 'x', NULL][k + 1] AS body, CASE WHEN (page_id + k) % 4 = 0 THEN 404 ELSE 200 END AS status, TIMESTAMP '{NOW}' - to_hours(page_id % 30 + k * 7) AS t, k FROM pages, (SELECT unnest(range(3)) AS k)),
g AS (SELECT *, row_number() OVER (PARTITION BY url ORDER BY t DESC, sha256(body)) AS rn FROM f WHERE status = 200 AND body IS NOT NULL)
SELECT url, length(body) AS n, sha256(body) AS sha FROM g WHERE rn = 1 AND date_diff('second', t, TIMESTAMP '{NOW}') <= 24 * 3600
""")
def cached_pages(spark, sf_dir):
    key, k = F.col("page_id"), F.col("k")
    f = table(spark, sf_dir, "pages").select("page_id", "url", "html", F.explode(F.array(*map(F.lit, range(3)))).alias("k")).select(
        "url", F.when(k == 0, F.col("html")).when(k == 1, F.concat("html", F.lit("x"))).alias("body"), F.when((key + k) % 4 == 0, 404).otherwise(200).alias("status"), (now() - F.make_dt_interval(hours=(key % 30 + k * 7).cast("int"))).alias("fetched_at"))
    return pages.cached(f, now(), 24).select("url", F.length("body").cast("long").alias("n"), pages.content_address("body").alias("sha"))


@query("""
WITH n AS (SELECT DISTINCT url, sha256(html) AS sha256 FROM pages) SELECT count(*) AS n, count(DISTINCT url) AS urls FROM n WHERE (url, sha256) NOT IN (SELECT (url, sha256(html)) FROM pages WHERE page_id % 3 = 0)
""")
def new_pages(spark, sf_dir):
    p = table(spark, sf_dir, "pages")
    old = pages.record_pages(spark.createDataFrame([], "url string, sha256 string"), p.where("page_id % 3 = 0").select("url", F.col("html").alias("body")))
    new = pages.record_pages(old.select("url", "sha256"), p.union(p).select("url", F.col("html").alias("body")))
    return new.agg(F.count("*").alias("n"), F.count_distinct("url").alias("urls"))


@query(r"""
WITH h AS (SELECT page_id, regexp_replace(lower(regexp_extract(url, '^https?://([^/?#]*)', 1)), '^www\.', '') AS host FROM pages), b AS (SELECT min(host) AS b FROM h)
SELECT page_id, coalesce(host = 'blocked.com' OR host LIKE '%.com', false) AS blocked FROM h
""")
def blocked_hosts(spark, sf_dir):
    return pages.hosts_blocked(table(spark, sf_dir, "pages").select("page_id", S.site_host("url").alias("host")), "host", ["blocked.com", "com"]).select("page_id", "blocked")


@query("""
WITH a AS (SELECT o_orderkey AS id, 'x' || o_orderkey AS content FROM orders WHERE o_orderkey % 2 = 0), b AS (SELECT o_orderkey AS id, 'y' AS content FROM orders WHERE o_orderkey % 3 = 0),
u AS (SELECT id, content FROM b UNION ALL SELECT id, content FROM a WHERE id NOT IN (SELECT id FROM b)), r AS (SELECT l_orderkey AS id, l_linenumber FROM lineitem)
SELECT r.id, l_linenumber AS line, coalesce(content, 'missing') AS content FROM r LEFT JOIN u USING (id)
""")
def resolved_evidence(spark, sf_dir):
    o, key = table(spark, sf_dir, "orders"), F.col("o_orderkey")
    a = o.where(key % 2 == 0).select(key.alias("id"), F.concat(F.lit("x"), key.cast("string")).alias("content"))
    index = views.evidence_index(a, o.where(key % 3 == 0).select(key.alias("id"), F.lit("y").alias("content")))
    found, missing = views.resolve_ids(table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("line")), index)
    return found.select("id", "line", "content").unionByName(missing.select("id", "line", F.lit("missing").alias("content")))


@query("""
SELECT c_custkey AS id, 37.0::DOUBLE + c_custkey % 9 AS lat, CASE WHEN c_custkey % 3 = 0 THEN '$' || format('{:,}', 2000 + c_custkey) WHEN c_custkey % 3 = 1 THEN '$' || format('{:,}', 1000 + c_custkey) ELSE 'N/A' END AS label FROM customer WHERE c_custkey % 5 > 0
""")
def map_points(spark, sf_dir):
    key = F.col("c_custkey")
    c = table(spark, sf_dir, "customer").select(key.alias("id"), F.when(key % 5 > 0, 37.0 + key % 9).alias("lat"), F.lit(-122.0).alias("lon"), F.when(key % 3 == 0, 2000 + key).alias("total"), F.when(key % 3 == 1, 1000 + key).alias("base"))
    return views.map_points(c).select("id", "lat", "label")


@query("SELECT c_custkey AS id, array_to_string(list_transform(list_filter(list_sort([{'n': -(c_custkey % 4), 't': 'a'}, {'n': -(c_custkey % 3), 't': 'b'}, {'n': -2, 't': 'c'}]), lambda x: x.n < 0), lambda x: x.t || -x.n), ',') AS themes FROM customer")
def theme_counts(spark, sf_dir):
    key = F.col("c_custkey")
    counts = F.create_map(F.lit("a"), key % 4, F.lit("b"), key % 3, F.lit("c"), F.lit(2).cast("long"))
    c = table(spark, sf_dir, "customer").select(key.alias("id"), views.theme_counts(counts).alias("t"))
    return c.select("id", F.array_join(F.transform("t", lambda x: F.concat(x["theme"], x["n"].cast("string"))), ",").alias("themes"))


@query(f"""
SELECT c_custkey AS e, k AS ordinal, c AS category, CASE WHEN (c_custkey + k) % 2 = 0 THEN 5.0::DOUBLE END AS score, CASE WHEN (c_custkey + k) % 2 = 0 THEN 'high' ELSE 'insufficient' END AS confidence, CASE WHEN (c_custkey + k) % 2 = 0 THEN 'Fine.' ELSE 'Not evaluated yet.' END AS summary
FROM customer, (SELECT unnest({list(CATEGORY_WEIGHTS)}) AS c, unnest(range({len(CATEGORY_WEIGHTS)})) AS k)
""")
def assessment_cards(spark, sf_dir):
    e = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("e"))
    a = e.select("e", F.posexplode(F.array(*map(F.lit, CATEGORY_WEIGHTS))).alias("k", "category")).where((F.col("e") + F.col("k")) % 2 == 0).select("e", "category", F.lit(5.0).alias("score"), F.lit("high").alias("confidence"), F.lit("Fine.").alias("summary"))
    return views.assessment_cards(e, a, "e").select("e", F.col("ordinal").cast("long").alias("ordinal"), "category", "score", "confidence", "summary")


@query("""
SELECT o_orderkey AS claim, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey % 2 DESC, list_position(['negative', 'positive', 'neutral'], ['positive', 'negative', 'neutral'][o_orderkey % 3 + 1]), o_totalprice DESC, o_orderstatus, o_orderkey || '') AS place FROM orders
""")
def claim_places(spark, sf_dir):
    key = F.col("o_orderkey")
    c = table(spark, sf_dir, "orders").select("o_custkey", key.alias("claim"), (key % 2 == 1).alias("is_current"), pick(("positive", "negative", "neutral"), key).alias("polarity"), F.col("o_totalprice").alias("weight"), F.col("o_orderstatus").alias("theme"), key.cast("string").alias("text"))
    return c.select("claim", F.row_number().over(Window.partitionBy("o_custkey").orderBy(*views.claim_order())).cast("long").alias("place"))


@query(f"""
WITH o AS (SELECT o_orderkey AS id, o_orderkey % 2 = 0 AS review, CASE WHEN o_orderkey % 7 > 0 THEN date_diff('second', o_orderdate, TIMESTAMP '{NOW}') // 86400 END AS d FROM orders)
SELECT id, CASE WHEN review THEN 4.5::DOUBLE END AS rating, CASE WHEN NOT review OR d IS NULL THEN NULL WHEN d <= 0 THEN 'today' WHEN d < 30 THEN d || CASE WHEN d = 1 THEN ' day ago' ELSE ' days ago' END WHEN d < 365 THEN d // 30 || CASE WHEN d // 30 = 1 THEN ' month ago' ELSE ' months ago' END
  ELSE d // 365 || CASE WHEN d // 365 = 1 THEN ' year ago' ELSE ' years ago' END END AS age, CASE WHEN d IS NULL THEN 'undated' ELSE 'dated' END AS note FROM o
""")
def evidence_items(spark, sf_dir):
    key = F.col("o_orderkey")
    o = table(spark, sf_dir, "orders").select(key.alias("id"), F.when(key % 2 == 0, "review").otherwise("price").alias("kind"), F.lit("s").alias("source_name"), F.lit("c").alias("content"), F.lit(4.5).alias("rating"), F.lit("r").alias("reviewer"), F.when(key % 7 > 0, F.col("o_orderdate")).alias("published"))
    notes = o.select("id", F.when(quality.age_note(F.col("published"), now()) == "undated", "undated").otherwise("dated").alias("note"))
    return views.evidence_items(o, now()).select("id", "rating", "age").join(notes, "id")


@query("""
SELECT c_custkey AS id, k AS origin, CASE WHEN (c_custkey + k) % 4 > 0 THEN 60.0::DOUBLE * k + c_custkey END AS seconds, CASE WHEN (c_custkey + k) % 4 = 0 THEN 'insufficient' WHEN (c_custkey + k) % 3 = 0 THEN 'low' ELSE 'ok' END AS status FROM customer, (SELECT unnest(range(2)) AS k)
""")
def route_tables(spark, sf_dir):
    key = F.col("c_custkey")
    row = lambda k: F.when((key + k) % 4 > 0, 60.0 * k + key)
    snap = lambda k: F.struct(F.when((key + k) % 3 == 0, 301.0).otherwise(300.0).alias("distance"))
    number = lambda x: F.coalesce(x.cast("string"), F.lit("null"))
    grid = F.concat(F.lit("[["), number(row(0)), F.lit("],["), number(row(1)), F.lit("]]"))
    sources = F.to_json(F.array(snap(0), snap(1)))
    doc = F.concat(F.lit('{"code":"Ok","durations":'), grid, F.lit(',"distances":'), grid, F.lit(',"sources":'), sources, F.lit("}"))
    out = views.parse_route_table(table(spark, sf_dir, "customer").select(key.alias("id"), doc.alias("p")), "id", "p")
    return out.select("id", F.col("origin").cast("long").alias("origin"), "seconds", "status")


@query("SELECT strftime(ts::TIMESTAMP AT TIME ZONE 'UTC' AT TIME ZONE 'America/Los_Angeles', '%Y-%m') AS period, event_type, count(*) AS calls FROM events GROUP BY 1, 2")
def stream_monthly_calls(spark, sf_dir):
    return streams.drain(streams.monthly_calls(_events(spark, sf_dir), "ts", ["event_type"]), "complete").select("period", "event_type", "calls")


@query("""
WITH c AS (SELECT c_custkey AS id, k, (c_custkey * (k + 3) * 37 % 600)::DOUBLE AS m, (c_custkey + k) % 2 = 0 AS num, CASE WHEN (c_custkey + k) % 3 = 0 THEN 1.0 ELSE 0.0 END AS share FROM customer, (SELECT unnest(range(3)) AS k)),
r AS (SELECT *, CASE WHEN m <= 100 AND num AND share >= 0.5 THEN 0 WHEN m <= 150 AND (num OR share >= 0.6) THEN 1 WHEN m <= 500 AND share >= 0.5 THEN 2 END AS rank FROM c)
SELECT id, 'p' || k AS place, ['exact', 'probable', 'weak'][rank + 1] AS confidence, m AS meters FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY rank, m, k) AS rn FROM r WHERE rank IS NOT NULL) WHERE rn = 1
""")
def best_places(spark, sf_dir):
    key, k = F.col("c_custkey"), F.col("k")
    c = table(spark, sf_dir, "customer").select(key, F.explode(F.array(*map(F.lit, range(3)))).alias("k")).select(
        key.alias("id"), F.concat(F.lit("p"), k.cast("string")).alias("place"), (key * (k + 3) * 37 % 600).cast("double").alias("meters"), ((key + k) % 2 == 0).alias("same_number"), F.array(F.lit("oak")).alias("query_words"),
        F.when((key + k) % 3 == 0, F.array(F.lit("oak"), F.lit("hill"))).otherwise(F.array(F.lit("elm"))).alias("place_words"))
    return quality.best_place(c, "id")


@query("""
SELECT p_brand, arg_min(v, {'d': abs(y - 2020), 'l': -y}) AS v, CAST(max(f) AS VARCHAR) AS newest FROM (SELECT p_brand, 2000 + p_partkey % 37 AS y, max(p_partkey) AS v, 'f' || max(2000 + p_partkey % 37) OVER () AS f FROM part GROUP BY p_brand, p_partkey % 37, p_partkey) GROUP BY 1
""".replace("max(p_partkey) AS v", "p_partkey AS v").replace("GROUP BY p_brand, p_partkey % 37, p_partkey", "").replace("arg_min(v, {'d': abs(y - 2020), 'l': -y})", "arg_min(v, abs(y - 2020) * 1000000000 - y * 100000 + v % 100000)"))
def nearest_years(spark, sf_dir):
    key = F.col("p_partkey")
    p = table(spark, sf_dir, "part").select("p_brand", (2000 + key % 37).alias("y"), key.alias("v")).groupBy("p_brand", "y").agg(F.min_by("v", F.struct(F.col("v") % 100_000, F.col("v"))).alias("v"))
    files = table(spark, sf_dir, "part").select(F.concat(F.lit("f"), (2000 + key % 37).cast("string")).alias("url"), (2000 + key % 37).alias("end_year"), F.lit("2020").alias("created"))
    return official.nearest_year(p, ["p_brand"], "y", "v", 2020).crossJoin(F.broadcast(official.latest_file(files).withColumnRenamed("url", "newest")))  # one row


@query("""
SELECT p_partkey AS id, p_partkey % 3 = 0 AND 1000 + p_partkey % 2000 <= 1800 AS may FROM part
""")
def price_prefilter(spark, sf_dir):
    key = F.col("p_partkey")
    m = F.create_map(F.when(key % 3 == 0, 1).otherwise(2), (1000 + key % 2000), F.lit(0), F.lit(0).cast("long"), F.lit(7), F.lit(None).cast("long"))
    return table(spark, sf_dir, "part").select(key.alias("id"), listings.may_qualify(m, (0, 1), 1800).alias("may"))


@query("SELECT l_suppkey, l_shipmode, len(a) > 1 AS varies, len(a) AS n, a[1] AS least FROM (SELECT l_suppkey, l_returnflag AS l_shipmode, list_sort(list(DISTINCT l_quantity)) AS a FROM lineitem GROUP BY 1, 2)")
def expense_labels(spark, sf_dir):
    g = listings.expense_rollup(table(spark, sf_dir, "lineitem").select("l_suppkey", F.col("l_returnflag").alias("l_shipmode"), "l_quantity"), ["l_suppkey"], "l_shipmode", "l_quantity")
    return g.select("l_suppkey", "l_shipmode", "varies", F.size("amounts").cast("long").alias("n"), F.get("amounts", 0).alias("least"))


@query(r"""
SELECT c_custkey AS id, CAST(round_even(c_custkey % 101 / 8::DOUBLE, 0) AS BIGINT) || '%' AS percent, (c_custkey % 5 - 2) / 2::DOUBLE AS sub, c_custkey % 7 BETWEEN 1 AND 5 AS valid, 'san jose' AS city, 'apt' || c_custkey AS unit, c_custkey || '' AS number, 'main st' AS street, CASE WHEN c_custkey % 3 > 0 THEN 1000.0 + c_custkey % 90 END::DOUBLE AS money,
  CASE WHEN c_custkey % 4 > 0 THEN 50.0 END::DOUBLE AS fees, (c_custkey % 40)::DOUBLE AS secs, CASE WHEN c_custkey % 5 > 0 THEN (c_custkey % 6) / 4::DOUBLE END AS ratio, CASE WHEN c_custkey % 11 < 4 THEN 'poor' WHEN c_custkey % 11 < 7 THEN 'mixed' ELSE 'good' END AS tone,
  c_custkey % 4 AS rank, CASE c_custkey % 4 WHEN 0 THEN '' WHEN 1 THEN 'a' WHEN 2 THEN 'a and b' ELSE 'a, b, and c' END AS listed, (c_custkey % 3 * 4)::DOUBLE AS norm, CASE c_custkey % 4 WHEN 0 THEN 0 WHEN 1 THEN 1 WHEN 2 THEN 2 ELSE NULL END AS beds FROM customer
""")
def scalar_functions(spark, sf_dir):
    key = F.col("c_custkey")
    text = key.cast("string")
    rent = F.concat(F.lit("$"), F.format_number(1000 + key % 90, 0))
    address = F.concat(text, F.lit(" main st"))
    return table(spark, sf_dir, "customer").select(
        key.alias("id"), S.percent_text(key % 101 / 800.0).alias("percent"), S.subscore_value(1 + key % 5).cast("double").alias("sub"), S.valid_subscore(key % 7).alias("valid"), S.normalize_city(F.lit("  San,Jose ")).alias("city"),
        S.unit_key(F.concat(F.lit("Apt #"), text)).alias("unit"), S.street_number(address).alias("number"), S.street_name(address).alias("street"), S.money(F.when(key % 3 > 0, rent).otherwise("call")).alias("money"),
        S.required_fees(F.lit(1000), F.when(key % 4 > 0, 1050.0).otherwise(900.0)).alias("fees"), S.parse_duration(F.concat((key % 40).cast("string"), F.lit("s"))).alias("secs"), S.crime_ratio((key % 6).cast("double"), F.when(key % 5 > 0, 4.0).otherwise(0.0)).alias("ratio"),
        S.score_tone(key % 11).alias("tone"), S.confidence_rank(pick(("insufficient", "low", "medium", "high"), key)).cast("long").alias("rank"), S.join_list(F.slice(F.array(F.lit("a"), F.lit("b"), F.lit("c")), 1, (key % 4).cast("int"))).alias("listed"),
        F.round(S.normalized_rating(key % 3 * 8, F.lit(10)), 2).alias("norm"), S.parse_beds(pick(("Studio", "1 bed", "2BR", "none"), key)).cast("long").alias("beds"))
