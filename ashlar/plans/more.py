"""Queries over combined assessments and views."""

from __future__ import annotations

from pyspark.sql import functions as F

from ashlar.operators import quality, themes, views
from ashlar.plans.matching import REVIEWS_AS_SQL, STATED_SQL, reviews
from ashlar.plans.pricing import NOW, now
from ashlar.plans.registry import query
from ashlar.session import table


@query("""
WITH r AS (SELECT d.source, d.lang, avg(l.quality) * 5 AS a FROM labels l JOIN documents d USING (doc_id) GROUP BY 1, 2),
b AS (SELECT source, max({'a': a, 'l': lang}) AS b, min({'a': a, 'l': lang}) AS w FROM r GROUP BY 1)
SELECT source, b.l AS best, w.l AS worst, round(b.a - w.a, 6) AS gap FROM b WHERE b.a - w.a >= 1
""")
def rating_conflicts(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", "source", "lang")
    r = table(spark, sf_dir, "labels").join(d, "doc_id").groupBy("source", "lang").agg((F.avg("quality") * 5).alias("average"))
    return quality.rating_conflict(r, ["source"], "lang", "average").select("source", "best", "worst", F.round("gap", 6).alias("gap"))


@query("SELECT user_id, CAST(sum(n) AS BIGINT) AS reviews, count(*) AS sources, round(max(n) / sum(n), 6) AS share FROM (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY 1, 2) GROUP BY 1")
def source_concentration(spark, sf_dir):
    out = quality.source_concentration(table(spark, sf_dir, "events").select("user_id", "event_type"), "user_id", "event_type")
    return out.select("user_id", "reviews", "sources", F.round("share", 6).alias("share"))


@query(f"""
WITH {REVIEWS_AS_SQL}, n AS (SELECT property, count(*) AS reviews, count(*) FILTER (published >= TIMESTAMP '{NOW}' - INTERVAL 17532 HOUR) AS recent FROM rv GROUP BY 1),
s AS (SELECT property, count(*) AS sources, max(c) / sum(c) AS share FROM (SELECT property, source, count(*) AS c FROM rv GROUP BY 1, 2) GROUP BY 1),
w AS (SELECT property, count(*) OVER (PARTITION BY property ORDER BY epoch(published) RANGE BETWEEN CURRENT ROW AND 1209600 FOLLOWING) AS c, count(*) OVER (PARTITION BY property) AS total FROM rv WHERE published IS NOT NULL),
b AS (SELECT property, max(c) >= 3 AND any_value(total) >= 5 AND max(c) / any_value(total) >= 0.4 AS burst FROM w GROUP BY 1),
d AS (SELECT DISTINCT property, true AS copies FROM rv WHERE k <> 10 GROUP BY property, k HAVING count(*) > 1),
c AS (SELECT property, min(published) AS earliest FROM rv JOIN {STATED_SQL} USING (k) WHERE theme = 'management_change' GROUP BY 1),
m AS (SELECT property, 2 * count(*) FILTER (published < earliest) > count(*) AS changed FROM rv JOIN c USING (property) GROUP BY 1),
r AS (SELECT property, max(a) - min(a) >= 1 AS clash FROM (SELECT property, source, avg(review % 5) + 1 AS a FROM rv GROUP BY 1, 2) GROUP BY 1),
f AS (SELECT *, coalesce(burst, false)::INT + coalesce(copies, false)::INT + coalesce(changed, false)::INT + coalesce(clash, false)::INT + (share > 0.8)::INT AS lowered,
  CASE WHEN reviews >= 15 AND recent >= 5 AND sources >= 2 AND share <= 0.8 THEN 2 WHEN reviews >= 8 AND recent >= 2 THEN 1 ELSE 0 END AS level
  FROM n JOIN s USING (property) LEFT JOIN b USING (property) LEFT JOIN d USING (property) LEFT JOIN m USING (property) LEFT JOIN r USING (property))
SELECT property, reviews, recent, sources, round(share, 4) AS share, ['low', 'medium', 'high'][level + 1] AS base, lowered, ['low', 'medium', 'high'][CASE WHEN recent = 0 THEN 0 ELSE greatest(0, level - lowered) END + 1] AS confidence FROM f
""")
def review_quality(spark, sf_dir):
    r = reviews(spark, sf_dir)
    ratings = r.groupBy("property", "source").agg((F.avg(F.col("review") % 5) + 1).alias("average"))
    return quality.review_quality(r, themes.mine(r, "review", "text"), ratings, now())


@query(f"""
WITH {REVIEWS_AS_SQL}, m AS (SELECT property, count(*) AS reports, avg(CASE WHEN review % 4 = 0 THEN 1.0 ELSE -1.0 END) AS net FROM rv WHERE review % 4 < 2 AND review % 7 > 0 GROUP BY 1),
a AS (SELECT DISTINCT property, CASE WHEN property % 5 > 0 THEN least(10, greatest(1, 5.5 - 2.25 * log2((1.0 + property % 7) / 4))) END AS v, CASE WHEN property % 7 > 0 THEN least(10, greatest(1, 5.5 - 2.25 * log2((10.0 + property % 30) / 22))) END AS q FROM rv),
o AS (SELECT property, (coalesce(v * 0.6, 0) + coalesce(q * 0.4, 0)) / nullif((v IS NOT NULL)::INT * 0.6 + (q IS NOT NULL)::INT * 0.4, 0) AS official, CASE WHEN reports >= 3 THEN round(net, 2) ELSE 0 END AS move FROM a LEFT JOIN m USING (property))
SELECT property, floor(official * 10 + 0.5 + 1e-9) / 10 AS official, move AS adjustment, CASE WHEN official IS NOT NULL THEN floor(least(10, greatest(1, official + move)) * 10 + 0.5 + 1e-9) / 10 END AS score, CASE WHEN official IS NULL THEN 'insufficient' ELSE 'low' END AS confidence FROM o
""")
def neighborhood_safety(spark, sf_dir):
    key = F.col("review")
    r = reviews(spark, sf_dir).withColumn("text", F.concat("text", F.when(key % 7 == 0, " Nothing else.").when(key % 4 == 0, " It is a safe neighborhood.").when(key % 4 == 1, " Dangerous area, sadly.").otherwise("")))
    m = themes.mine(r, "review", "text").where("category = 'neighborhood_safety'").join(r.select("review", "property"), "review")
    residents = m.groupBy("property").agg(F.count_distinct("review").alias("reports"), F.avg(F.when(F.col("polarity") == "positive", 1.0).otherwise(-1.0)).alias("net"))
    key = F.col("property")
    areas = r.select("property").distinct().select("property", F.when(key % 5 > 0, 1.0 + key % 7).alias("violent"), F.lit(4.0).alias("ref_violent"), F.when(key % 7 > 0, 10.0 + key % 30).alias("property_crime"), F.lit(22.0).alias("ref_property"))
    return quality.neighborhood_safety(areas, residents)


@query("""
SELECT c_custkey, m AS meters, CASE WHEN m <= 100 AND num AND share >= 0.5 THEN 'exact' WHEN m <= 150 AND (num OR share >= 0.6) THEN 'probable' WHEN m <= 500 AND share >= 0.5 THEN 'weak' END AS confidence
FROM (SELECT c_custkey, CAST(c_custkey * 13 % 600 AS DOUBLE) AS m, c_custkey % 3 = 0 AS num, (c_custkey % 10) / 10 AS share FROM customer)
""")
def place_confidence(spark, sf_dir):
    key = F.col("c_custkey")
    c = table(spark, sf_dir, "customer").select("c_custkey", (key * 13 % 600).cast("double").alias("meters"), (key % 3 == 0).alias("num"), (key % 10 / 10).alias("share"))
    return c.select("c_custkey", "meters", quality.place_confidence("meters", "num", "share").alias("confidence"))


@query("""
WITH s AS (SELECT n_nationkey AS id, CASE WHEN n_nationkey % 4 > 0 THEN n_name END AS name FROM nation)
SELECT s_suppkey, coalesce(name, CAST(sid AS VARCHAR), 'Unknown source') AS source_name FROM (SELECT s_suppkey, CASE WHEN s_suppkey % 9 > 0 THEN s_nationkey END AS sid FROM supplier) LEFT JOIN s ON sid = id
""")
def source_names(spark, sf_dir):
    n = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("string").alias("id"), F.when(F.col("n_nationkey") % 4 > 0, F.col("n_name")).alias("name"))
    s = table(spark, sf_dir, "supplier").select("s_suppkey", F.when(F.col("s_suppkey") % 9 > 0, F.col("s_nationkey").cast("string")).alias("source_id"))
    return views.source_names(s, n).select("s_suppkey", "source_name")


@query("""
WITH c AS (SELECT o_custkey, o_orderkey AS id, CASE WHEN o_orderstatus = 'F' THEN 'positive' WHEN o_orderstatus = 'O' THEN 'negative' ELSE 'neutral' END AS pol, o_totalprice AS w, o_orderkey % 7 AS ord, o_orderkey % 3 > 0 AS cur FROM orders),
r AS (SELECT *, row_number() OVER (PARTITION BY o_custkey, pol ORDER BY w DESC, ord, id) AS rn FROM c WHERE cur AND pol <> 'neutral')
SELECT k.o_custkey, CAST(p.id AS VARCHAR) AS best, CAST(n.id AS VARCHAR) AS worst FROM (SELECT DISTINCT o_custkey FROM c) k LEFT JOIN r p ON p.o_custkey = k.o_custkey AND p.pol = 'positive' AND p.rn = 1 LEFT JOIN r n ON n.o_custkey = k.o_custkey AND n.pol = 'negative' AND n.rn = 1
""")
def claim_highlights(spark, sf_dir):
    key = F.col("o_orderkey")
    pol = F.when(F.col("o_orderstatus") == "F", "positive").when(F.col("o_orderstatus") == "O", "negative").otherwise("neutral")
    c = table(spark, sf_dir, "orders").select("o_custkey", key.alias("claim_id"), key.cast("string").alias("text"), pol.alias("polarity"), F.col("o_totalprice").alias("weight"), (key % 7).alias("ordinal"), (key % 3 > 0).alias("is_current"))
    return views.highlights(c, "o_custkey")


@query("SELECT c_custkey, CASE WHEN c_custkey % 6 = 0 THEN 'not_checked' WHEN c_custkey % 5 = 0 THEN 'error' WHEN c_custkey % 4 = 0 THEN 'no_match' ELSE 'ok' END AS state FROM customer")
def panel_states(spark, sf_dir):
    key = F.col("c_custkey")
    return table(spark, sf_dir, "customer").select("c_custkey", views.panel_state(True, key % 6 != 0, key % 5 == 0, F.nullif((key % 4 != 0), F.lit(False))).alias("state"))


@query("""
SELECT event_id, coalesce(bool_or(event_type = 'error') OVER (PARTITION BY user_id, strftime(ts, '%Y-%m-%d') ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS skipped FROM events
""")
def stop_after_fatal(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", "user_id", "ts", F.date_format("ts", "yyyy-MM-dd").alias("day"), "event_type")
    return views.stop_after_fatal(e, ["user_id", "day"], [F.asc("ts"), F.asc("event_id")], F.col("event_type") == "error").select("event_id", "skipped")


@query("""
SELECT CAST(user_id AS BIGINT) AS run_id, array_to_string(list_sort(list(event_type || '=' || n)), ',') AS stats, CASE WHEN bool_or(event_type = 'error' AND n > 20) THEN 'failed' ELSE 'done' END AS status
FROM (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY 1, 2) GROUP BY 1
""")
def run_summary(spark, sf_dir):
    e = table(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.count("*").alias("n"))
    log = e.select(F.col("user_id").alias("run_id"), F.col("event_type").alias("counter"), "n", F.lit(None).cast("string").alias("note"), F.lit(0).alias("seq"), ((F.col("event_type") == "error") & (F.col("n") > 20)).alias("failed"))
    out = views.run_summary(log)
    return out.select("run_id", F.array_join(F.array_sort(F.transform(F.map_entries("stats"), lambda x: F.concat(x["key"], F.lit("="), x["value"].cast("string")))), ",").alias("stats"), "status")


@query("""SELECT p_partkey, '{"p_partkey":' || p_partkey || ',"p_name":"' || p_name || '","p_size":' || CASE WHEN p_size > 10 THEN p_size || '' ELSE 'null' END || '}' AS document FROM part""")
def served_documents(spark, sf_dir):
    p = table(spark, sf_dir, "part").select("p_partkey", "p_name", F.when(F.col("p_size") > 10, F.col("p_size")).alias("p_size"))
    return views.served_json(p, "p_partkey")
