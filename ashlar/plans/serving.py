"""Upserts, set operations, serving and series queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ashlar.operators import latest, serving, upserts
from ashlar.plans.registry import query
from ashlar.session import table


@query("""
WITH o AS (SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders WHERE o_orderpriority <> '1-URGENT'), n AS (SELECT o_orderkey, nullif(o_orderstatus, 'O') AS o_orderstatus, o_totalprice + 1 AS o_totalprice FROM orders WHERE o_orderstatus <> 'P')
SELECT o_orderkey, coalesce(n.o_orderstatus, o.o_orderstatus) AS o_orderstatus, round(coalesce(n.o_totalprice, o.o_totalprice), 2) AS o_totalprice FROM o FULL JOIN n USING (o_orderkey)
""")
def upsert_snapshot(spark, sf_dir):
    t = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice", "o_orderpriority")
    new = t.where("o_orderstatus <> 'P'").select("o_orderkey", F.nullif("o_orderstatus", F.lit("O")).alias("o_orderstatus"), (F.col("o_totalprice") + 1).alias("o_totalprice"))
    return upserts.upsert(t.where("o_orderpriority <> '1-URGENT'").drop("o_orderpriority"), new, ["o_orderkey"]).withColumn("o_totalprice", F.round("o_totalprice", 2))


@query("SELECT o_custkey, count(*) AS n FROM (SELECT DISTINCT o_custkey, o_orderpriority FROM orders WHERE o_orderstatus = 'F' AND (o_custkey, o_orderpriority) NOT IN (SELECT o_custkey, o_orderpriority FROM orders WHERE o_orderstatus = 'O')) GROUP BY 1")
def insert_missing(spark, sf_dir):
    t = table(spark, sf_dir, "orders").select("o_custkey", "o_orderpriority", "o_orderstatus")
    keys = ["o_custkey", "o_orderpriority"]
    return upserts.insert_missing(t.where("o_orderstatus = 'O'"), t.where("o_orderstatus = 'F'"), keys).groupBy("o_custkey").agg(F.count("*").alias("n"))


@query("""
WITH t AS (SELECT o_custkey, o_orderkey, o_orderdate, o_orderstatus = 'F' AS pref, nullif(o_orderpriority, '5-LOW') AS a, CASE WHEN o_totalprice > 200000 THEN o_orderkey END AS b FROM orders)
SELECT c.o_custkey, x.a AS priority, y.b AS big FROM (SELECT DISTINCT o_custkey FROM t) c
LEFT JOIN (SELECT o_custkey, a FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY pref DESC, o_orderdate DESC, o_orderkey DESC) AS rn FROM t WHERE a IS NOT NULL) WHERE rn = 1) x USING (o_custkey)
LEFT JOIN (SELECT o_custkey, b FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY pref DESC, o_orderdate DESC, o_orderkey DESC) AS rn FROM t WHERE b IS NOT NULL) WHERE rn = 1) y USING (o_custkey)
""")
def survivorship(spark, sf_dir):
    t = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderdate", (F.col("o_orderstatus") == "F").alias("pref"), F.nullif("o_orderpriority", F.lit("5-LOW")).alias("priority"), F.when(F.col("o_totalprice") > 200000, F.col("o_orderkey")).alias("big"))
    return upserts.survivors(t, "o_custkey", "pref", "o_orderdate", "o_orderkey", ["priority", "big"])


@query("""
WITH b AS (SELECT DISTINCT c_custkey AS k FROM customer WHERE c_mktsegment = 'BUILDING'), o AS (SELECT DISTINCT o_custkey AS k FROM orders WHERE o_totalprice > 100000)
SELECT 'union' AS op, count(*) AS n, CAST(sum(k) AS BIGINT) AS s FROM (SELECT k FROM b UNION SELECT k FROM o) UNION ALL SELECT 'except', count(*), CAST(coalesce(sum(k), 0) AS BIGINT) FROM (SELECT k FROM b EXCEPT SELECT k FROM o)
UNION ALL SELECT 'intersect', count(*), CAST(coalesce(sum(k), 0) AS BIGINT) FROM (SELECT k FROM b INTERSECT SELECT k FROM o)
""")
def set_ops(spark, sf_dir):
    b = table(spark, sf_dir, "customer").where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("k"))
    o = table(spark, sf_dir, "orders").where("o_totalprice > 100000").select(F.col("o_custkey").alias("k"))
    tally = lambda name, df: df.agg(F.count("*").alias("n"), F.coalesce(F.sum("k"), F.lit(0)).alias("s")).select(F.lit(name).alias("op"), "n", "s")
    return tally("union", b.union(o).distinct()).union(tally("except", b.subtract(o))).union(tally("intersect", b.intersect(o)))


@query("""
WITH t AS (SELECT c_custkey, c_mktsegment, CASE WHEN c_custkey % 4 > 0 THEN round(c_acctbal) END AS v FROM customer)
SELECT 'asc' AS dir, c_custkey, v, rank FROM (SELECT *, row_number() OVER (ORDER BY v ASC NULLS LAST, c_mktsegment, c_custkey) AS rank FROM t) WHERE rank <= 50
UNION ALL SELECT 'desc', c_custkey, v, rank FROM (SELECT *, row_number() OVER (ORDER BY v DESC NULLS LAST, c_mktsegment, c_custkey) AS rank FROM t) WHERE rank <= 50
""")
def null_last_topk(spark, sf_dir):
    """A top-50 report in both directions."""
    t = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment", F.when(F.col("c_custkey") % 4 > 0, F.round("c_acctbal")).alias("v"))
    ties = (F.asc("c_mktsegment"), F.asc("c_custkey"))
    one = lambda name, desc: serving.top_k(t, serving.order_null_last("v", desc, *ties), 50).select(F.lit(name).alias("dir"), "c_custkey", "v", "rank")
    return one("asc", False).union(one("desc", True))


@query("""
WITH t AS (SELECT p_partkey, p_name, p_brand, CASE WHEN p_size % 5 > 0 THEN p_retailprice END AS price, CASE WHEN p_size % 3 > 0 THEN p_size / 10.0 END AS stars, u FROM part
  JOIN (SELECT l_partkey, list_sort(list_distinct(list(CAST(l_quantity AS BIGINT)))) AS u FROM lineitem GROUP BY 1) ON l_partkey = p_partkey)
SELECT p_partkey, price, CAST(stars AS DOUBLE) AS stars FROM t WHERE (contains(lower(p_name), 'a') OR contains(lower(p_brand), 'a')) AND price >= 950 AND price <= 1600 AND (stars IS NULL OR stars >= 2) AND len(list_filter(u, lambda x: x BETWEEN 10 AND 12)) > 0
""")
def browse_filter(spark, sf_dir):
    u = table(spark, sf_dir, "lineitem").groupBy("l_partkey").agg(F.array_sort(F.collect_set(F.col("l_quantity").cast("long"))).alias("u"))
    p = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand", F.when(F.col("p_size") % 5 > 0, F.col("p_retailprice")).alias("price"), F.when(F.col("p_size") % 3 > 0, F.col("p_size") / 10.0).alias("stars"))
    t = p.join(u, p["p_partkey"] == u["l_partkey"])
    out = serving.browse(t, text=(["p_name", "p_brand"], "A"), at_least={"price": 950}, at_most={"price": 1600}, include_unrated=("stars", 2.0), within={"u": (10, 12)})
    return out.select("p_partkey", "price", "stars")


@query("SELECT array_to_string(list_sort(list_distinct(list(p_brand))), ',') AS brands, array_to_string(list_sort(list_distinct(list(p_size))), ',') AS sizes, min(p_retailprice) AS low, max(p_retailprice) AS high FROM part")
def facets(spark, sf_dir):
    p = table(spark, sf_dir, "part").select("p_brand", "p_size", "p_retailprice")
    f = serving.facets(p, ["p_brand", "p_size"])
    bounds = p.agg(F.min("p_retailprice").alias("low"), F.max("p_retailprice").alias("high"))
    one = f.crossJoin(bounds)  # one row each
    return one.select(F.array_join("p_brand", ",").alias("brands"), F.array_join(F.transform("p_size", lambda x: x.cast("string")), ",").alias("sizes"), "low", "high")


@query("""
SELECT user_id, day, count(*) AS calls, count(*) FILTER (rn <= 5) AS allowed FROM (SELECT *, strftime(ts, '%Y-%m-%d') AS day, row_number() OVER (PARTITION BY user_id, strftime(ts, '%Y-%m-%d') ORDER BY ts, event_id) AS rn FROM events) GROUP BY 1, 2
""")
def budget_ledger(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", "user_id", "ts", F.date_format("ts", "yyyy-MM-dd").alias("day"))
    out = latest.within_budget(e, ["user_id", "day"], [F.asc("ts"), F.asc("event_id")], budget=7, cap=5)
    return out.groupBy("user_id", "day").agg(F.count("*").alias("calls"), F.count_if("allowed").alias("allowed"))


@query("""
WITH r AS (SELECT user_id, event_type = 'error' AS bad, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events), g AS (SELECT *, sum(CASE WHEN bad THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY rn) AS run FROM r)
SELECT user_id, CAST(run AS BIGINT) AS island, count(*) AS length, min(rn) AS first_row, max(rn) AS last_row FROM g WHERE bad GROUP BY 1, 2 HAVING count(*) >= 3
""")
def circuit_breaker(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", "user_id", "ts", "event_type")
    return latest.islands(e, ["user_id"], [F.asc("ts"), F.asc("event_id")], F.col("event_type") == "error", 3)


@query("SELECT event_id, round(last_value(CASE WHEN event_type = 'purchase' THEN value END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING), 4) AS last_purchase FROM events")
def fill_down(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", "user_id", "ts", "event_type", "value")
    out = latest.fill_down(e, ["user_id"], [F.asc("ts"), F.asc("event_id")], F.when(F.col("event_type") == "purchase", F.col("value")), "last_purchase")
    return out.select("event_id", F.round("last_purchase", 4).alias("last_purchase"))


@query("""
SELECT s_suppkey, CASE WHEN s_acctbal > 2000 THEN 'primary' ELSE 'secondary' END AS provider, CAST(CASE WHEN s_acctbal > 2000 THEN s_suppkey % 50 ELSE 60 + s_suppkey % 9 END AS BIGINT) AS minutes FROM supplier WHERE s_acctbal > 2000 OR s_nationkey < 15
""")
def provider_fallback(spark, sf_dir):
    s, key = table(spark, sf_dir, "supplier"), F.col("s_suppkey")
    primary = s.select("s_suppkey", (key % 50).alias("minutes"), (F.col("s_acctbal") > 2000).alias("ok"))
    secondary = s.where("s_nationkey < 15").select("s_suppkey", (60 + key % 9).alias("minutes"), F.lit(True).alias("ok"))
    return upserts.fallback(primary, secondary, "s_suppkey", "ok").select("s_suppkey", "provider", F.col("minutes").cast("long").alias("minutes"))


@query("""
SELECT c_custkey, coalesce(n, 0) AS n_orders, coalesce(keys, '') AS keys, coalesce(t, 0) AS n_types FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n, string_agg(CAST(o_orderkey AS VARCHAR), ',' ORDER BY o_orderkey) AS keys, count(DISTINCT o_orderpriority) AS t FROM orders GROUP BY 1) ON o_custkey = c_custkey
""")
def detail_document(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"), "o_orderkey", "o_orderpriority")
    d = serving.nest(table(spark, sf_dir, "customer").select("c_custkey"), "c_custkey", orders=(o, ["o_orderkey", "o_orderpriority"]), types=(o.select("c_custkey", "o_orderpriority").distinct(), ["o_orderpriority"]))
    keys = F.array_join(F.transform("orders", lambda x: x["o_orderkey"].cast("string")), ",")
    return d.select("c_custkey", F.size("orders").cast("long").alias("n_orders"), keys.alias("keys"), F.size("types").cast("long").alias("n_types"))


@query("""
WITH p AS (SELECT c_custkey, round(37.2 + (c_custkey % 700) / 1000.0, 3) AS lat, round(-122.3 + (c_custkey % 30) / 100.0, 3) AS lon FROM customer)
SELECT CAST(lat AS DOUBLE) AS p_lat, CAST(lon AS DOUBLE) AS p_lon, count(*) AS n FROM p GROUP BY 1, 2
""")
def chunk_dedupe_fanout(spark, sf_dir):
    key = F.col("c_custkey")
    p = table(spark, sf_dir, "customer").select("c_custkey", F.round(37.2 + (key % 700) / 1000.0, 3).alias("lat"), F.round(-122.3 + (key % 30) / 100.0, 3).alias("lon"))
    points = serving.route_chunks(p, "lat", "lon", size=60, digits=3)
    back = p.join(points, (p["lat"] == points["p_lat"]) & (p["lon"] == points["p_lon"]))
    return back.groupBy("p_lat", "p_lon").agg(F.count("*").alias("n"))


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def variant_props(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return e.select("event_id", F.try_variant_get(F.try_parse_json("props"), "$.k", "bigint").alias("k"))
