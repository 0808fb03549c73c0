"""Price queries: lineitem is the price series of units (part, supplier); a price is l_extendedprice / l_quantity."""

from __future__ import annotations

from pyspark.sql import functions as F

from ashlar.functions.scalars import price_fresh, round_to
from ashlar.operators import latest, pricing
from ashlar.plans.registry import query
from ashlar.session import table

#: The clock of all queries over orders and prices.
NOW = "2001-08-02 00:00:00"
NOW_COL = f"TIMESTAMP_NTZ'{NOW}'"
ORDER = ["l_shipdate", "l_extendedprice", "l_orderkey", "l_linenumber", "l_quantity"]


def now():
    return F.expr(NOW_COL)


def newest():
    return [F.desc(c) for c in ORDER]


@query("""
SELECT l_partkey, l_suppkey, l_orderkey, l_linenumber, strftime(l_shipdate, '%Y-%m-%d') AS shipdate, l_extendedprice
FROM (SELECT *, row_number() OVER (PARTITION BY l_partkey, l_suppkey ORDER BY l_shipdate DESC, l_extendedprice DESC, l_orderkey DESC, l_linenumber DESC, l_quantity DESC) AS rn FROM lineitem) WHERE rn = 1
""")
def latest_price_per_unit(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").select("l_partkey", "l_suppkey", *ORDER)
    out = latest.latest_per_key(li, ["l_partkey", "l_suppkey"], newest())
    return out.select("l_partkey", "l_suppkey", "l_orderkey", "l_linenumber", F.date_format("l_shipdate", "yyyy-MM-dd").alias("shipdate"), "l_extendedprice")


@query("""
SELECT l_suppkey, count(*) AS rows_all, count(*) FILTER (l_shipdate >= top) AS rows_current
FROM (SELECT *, max(l_shipdate) OVER (PARTITION BY l_suppkey) AS top FROM lineitem) GROUP BY l_suppkey
""")
def current_flag(spark, sf_dir):
    li = latest.flag_current(table(spark, sf_dir, "lineitem").select("l_suppkey", "l_shipdate"), ["l_suppkey"], "l_shipdate")
    return li.groupBy("l_suppkey").agg(F.count("*").alias("rows_all"), F.count_if("is_current").alias("rows_current"))


@query("""
SELECT l_suppkey, l_orderkey, l_linenumber, l_extendedprice
FROM (SELECT *, rank() OVER (PARTITION BY l_suppkey ORDER BY l_shipdate DESC) AS rk FROM lineitem) WHERE rk = 1
""")
def latest_batch_with_ties(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").select("l_suppkey", "l_orderkey", "l_linenumber", "l_extendedprice", "l_shipdate")
    return latest.latest_batch(li, ["l_suppkey"], "l_shipdate").drop("l_shipdate")


@query(f"""
SELECT o_orderpriority, count(*) FILTER (a <= 72 * 3600) AS fresh_72h, count(*) FILTER (a <= 90 * 86400 AND (u IS NULL OR u <= 60 * 86400)) AS fresh_90d, count(*) AS n
FROM (SELECT o_orderpriority, date_diff('second', o_orderdate, TIMESTAMP '{NOW}') AS a,
  CASE WHEN o_orderstatus <> 'O' THEN date_diff('second', o_orderdate, TIMESTAMP '{NOW}') END AS u FROM orders) GROUP BY 1
""")
def price_freshness(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderpriority", "o_orderdate", F.when(F.col("o_orderstatus") != "O", F.col("o_orderdate")).alias("updated"))
    never = F.lit(None).cast("timestamp_ntz")
    return o.groupBy("o_orderpriority").agg(
        F.count_if(price_fresh("o_orderdate", never, now())).alias("fresh_72h"),
        F.count_if(price_fresh("o_orderdate", "updated", now(), hours=90 * 24, days=60)).alias("fresh_90d"), F.count("*").alias("n"))


@query("""
SELECT l_partkey, base_min, base_max, (base_min BETWEEN 500 AND 2000) OR (base_max BETWEEN 500 AND 2000) AS endpoint, base_min < 500 AND base_max > 2000 AS straddles
FROM (SELECT l_partkey, floor((min(l_extendedprice / l_quantity)) * 100.0 + 0.5 + 1e-6) / 100.0 AS base_min, floor((max(l_extendedprice / l_quantity)) * 100.0 + 0.5 + 1e-6) / 100.0 AS base_max FROM lineitem GROUP BY 1)
""")
def rent_endpoint_range(spark, sf_dir):
    price = F.col("l_extendedprice") / F.col("l_quantity")
    p = table(spark, sf_dir, "lineitem").groupBy("l_partkey").agg(round_to(F.min(price), 2).alias("base_min"), round_to(F.max(price), 2).alias("base_max"))
    return p.select("l_partkey", "base_min", "base_max", pricing.endpoint_in_range("base_min", "base_max", 500, 2000).alias("endpoint"), ((F.col("base_min") < 500) & (F.col("base_max") > 2000)).alias("straddles"))


CASCADE_SQL = f"""
SELECT o_orderkey, CASE WHEN r_name NOT IN ('ASIA', 'EUROPE', 'AMERICA') THEN 'excluded' WHEN c_mktsegment IN ('MACHINERY') THEN 'excluded' WHEN o_orderpriority LIKE '5%' THEN 'excluded'
  WHEN o_totalprice <= 1000 THEN 'no_price' WHEN date_diff('second', o_orderdate, TIMESTAMP '{NOW}') > 365 * 86400 THEN 'stale' ELSE 'included' END AS status,
  CASE WHEN r_name NOT IN ('ASIA', 'EUROPE', 'AMERICA') THEN 'geography' WHEN c_mktsegment IN ('MACHINERY') THEN 'property_type' WHEN o_orderpriority LIKE '5%' THEN 'eligibility'
  WHEN o_totalprice <= 1000 THEN 'price' WHEN date_diff('second', o_orderdate, TIMESTAMP '{NOW}') > 365 * 86400 THEN 'freshness' ELSE '' END AS reason
FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
"""


@query(CASCADE_SQL)
def hard_filter_cascade(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderpriority", "o_totalprice", "o_orderdate")
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_mktsegment")
    n, r = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    place = n.join(r, n["n_regionkey"] == r["r_regionkey"]).select("n_nationkey", "r_name")
    j = o.join(c.join(place, c["c_nationkey"] == place["n_nationkey"]), o["o_custkey"] == c["c_custkey"])
    out = pricing.cascade(
        (F.col("r_name").isin("ASIA", "EUROPE", "AMERICA"), "excluded", "geography"),
        (~F.col("c_mktsegment").isin("MACHINERY"), "excluded", "property_type"),
        (~F.col("o_orderpriority").startswith("5"), "excluded", "eligibility"),
        (F.col("o_totalprice") > 1000, "no_price", "price"),
        (price_fresh("o_orderdate", F.lit(None).cast("timestamp_ntz"), now(), hours=365 * 24), "stale", "freshness"),
    )
    return j.select("o_orderkey", out.alias("s")).select("o_orderkey", "s.status", "s.reason")


@query(f"SELECT status, reason, count(*) AS n FROM ({CASCADE_SQL}) GROUP BY ALL")
def status_histogram(spark, sf_dir):
    return hard_filter_cascade(spark, sf_dir).groupBy("status", "reason").agg(F.count("*").alias("n"))


POINTS_SQL = """
SELECT s_nationkey, p_size, floor((min(x)) * 100.0 + 0.5 + 1e-6) / 100.0 AS base_min, floor((max(x)) * 100.0 + 0.5 + 1e-6) / 100.0 AS base_max, array_to_string(list_slice(list_sort(list_distinct(list(p_type))), 1, 4), '|') AS labels, count(DISTINCT p_brand) AS n_units
FROM (SELECT s_nationkey, p_size, p_type, p_brand, l_extendedprice / l_quantity AS x FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey) GROUP BY 1, 2
"""


def _points(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").select("l_partkey", "l_suppkey", (F.col("l_extendedprice") / F.col("l_quantity")).alias("low"))
    p = table(spark, sf_dir, "part").select("p_partkey", "p_size", "p_type", "p_brand")
    s = table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    j = li.join(p, li["l_partkey"] == p["p_partkey"]).join(s, li["l_suppkey"] == s["s_suppkey"]).withColumn("high", F.col("low"))
    return pricing.price_points(j, ["s_nationkey", "p_size"], "low", "high", "p_type", "p_brand")


@query(POINTS_SQL)
def price_points(spark, sf_dir):
    return _points(spark, sf_dir).select("s_nationkey", "p_size", round_to("base_min", 2).alias("base_min"), round_to("base_max", 2).alias("base_max"), F.array_join("labels", "|").alias("labels"), F.size("unit_keys").cast("long").alias("n_units"))


@query("""
WITH p AS (SELECT l_linestatus || s_nationkey AS src, p_size, p_brand, floor((min(l_extendedprice / l_quantity)) * 100.0 + 0.5 + 1e-6) / 100.0 AS lo, floor((max(l_extendedprice / l_quantity)) * 100.0 + 0.5 + 1e-6) / 100.0 AS hi
  FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1, 2, 3)
SELECT a.p_brand, a.src AS a_src, b.src AS b_src, a.p_size AS a_p_size, b.p_size AS b_p_size, floor((greatest(b.lo - a.hi, a.lo - b.hi)) * 100.0 + 0.5 + 1e-6) / 100.0 AS difference
FROM p a JOIN p b ON a.p_brand = b.p_brand AND a.src < b.src AND abs(a.p_size - b.p_size) <= 0.02 * greatest(a.p_size, b.p_size)
WHERE greatest(b.lo - a.hi, a.lo - b.hi) > greatest(50, 0.02 * least(a.lo, b.lo))
""")
def price_conflicts(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").select("l_partkey", "l_suppkey", "l_linestatus", (F.col("l_extendedprice") / F.col("l_quantity")).alias("x"))
    p = table(spark, sf_dir, "part").select("p_partkey", "p_size", "p_brand")
    s = table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    j = li.join(p, li["l_partkey"] == p["p_partkey"]).join(s, li["l_suppkey"] == s["s_suppkey"]).withColumn("src", F.concat("l_linestatus", F.col("s_nationkey").cast("string")))
    points = j.groupBy("src", "p_size", "p_brand").agg(round_to(F.min("x"), 2).alias("base_min"), round_to(F.max("x"), 2).alias("base_max"), F.array().cast("array<string>").alias("unit_keys"))
    out = pricing.price_conflicts(points, "src", ["p_brand"], "p_size")
    return out.select("p_brand", "a_src", "b_src", "a_p_size", "b_p_size", round_to("difference", 2).alias("difference"))


@query("""
SELECT l_partkey, l_suppkey, count(*) AS n, count(*) FILTER (restricted) AS n_restricted FROM (
  SELECT *, bool_or(l_returnflag = 'R' AND l_linestatus = 'O') OVER (PARTITION BY l_partkey, l_suppkey) AS restricted FROM lineitem) GROUP BY 1, 2
""")
def restricted_propagation(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").select("l_partkey", "l_suppkey", "l_returnflag", "l_linestatus")
    out = pricing.spread_restrictions(li, ["l_partkey", "l_suppkey"], (F.col("l_returnflag") == "R") & (F.col("l_linestatus") == "O"))
    return out.groupBy("l_partkey", "l_suppkey").agg(F.count("*").alias("n"), F.count_if("restricted").alias("n_restricted"))


@query("""
WITH r AS (SELECT d.source, d.lang, avg(l.quality) * 5 AS r, count(*) AS n FROM labels l JOIN documents d USING (doc_id) GROUP BY 1, 2),
u AS (SELECT source, count(*) AS usable, count(*) FILTER (n >= 3 AND lang <> 'es') AS solid, min(r) FILTER (n >= 3 AND lang <> 'es' AND r < 4) AS lo,
  max(r) FILTER (n >= 3 AND lang <> 'es' AND r >= 4) AS hi, sum(r * n) FILTER (n >= 3 AND lang <> 'es') / sum(n) FILTER (n >= 3 AND lang <> 'es') AS pooled FROM r GROUP BY 1)
SELECT source, solid, round(pooled, 4) AS pooled, CASE WHEN usable = 0 THEN 'no_reviews' WHEN solid = 0 THEN 'insufficient' WHEN lo IS NULL THEN 'ok' WHEN hi IS NULL THEN 'low_rating'
  WHEN hi - lo >= 1 THEN 'conflict' WHEN pooled < 4 THEN 'low_rating' ELSE 'ok' END AS status FROM u
""")
def pooled_rating_decision(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", "source", "lang")
    r = table(spark, sf_dir, "labels").join(d, "doc_id").groupBy("source", "lang").agg((F.avg("quality") * 5).alias("average"), F.count("*").alias("n"))
    r = r.withColumn("confidence", F.when(F.col("lang") == "es", "weak").otherwise("exact"))
    return pricing.rating_decision(r, ["source"], "average", "n", "confidence", low=4.0)


@query("""
WITH f AS (SELECT l_partkey, l_suppkey, min(l_extendedprice / l_quantity) AS base, CASE WHEN min(l_tax) > 0.03 THEN min(l_tax) * 1000 END AS own FROM lineitem GROUP BY 1, 2),
d AS (SELECT l_partkey, sum(DISTINCT CAST(l_linenumber AS BIGINT)) * 10 AS declared FROM lineitem WHERE l_returnflag = 'A' GROUP BY 1)
SELECT l_partkey, floor(min(base + coalesce(own, declared, 0)) * 10000.0 + 0.5 + 1e-6) / 10000.0 AS total FROM f LEFT JOIN d USING (l_partkey) GROUP BY 1
""")
def cheapest_total(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    units = li.groupBy("l_partkey", "l_suppkey").agg(F.min(F.col("l_extendedprice") / F.col("l_quantity")).alias("base"), F.when(F.min("l_tax") > 0.03, F.min("l_tax") * 1000).alias("own"))
    fees = li.where("l_returnflag = 'A'").select("l_partkey", (F.col("l_linenumber") * 10).cast("double").alias("fee")).distinct()
    return pricing.cheapest_total(units, fees, "l_partkey", "base", "own", "fee").select("l_partkey", round_to("total", 4).alias("total"))


@query(f"""
WITH u AS (SELECT *, row_number() OVER (PARTITION BY l_partkey, l_suppkey ORDER BY l_shipdate DESC, l_extendedprice DESC, l_orderkey DESC, l_linenumber DESC, l_quantity DESC) AS rn FROM lineitem),
q AS (SELECT l_partkey, l_extendedprice / l_quantity AS price, date_diff('second', l_shipdate, TIMESTAMP '{NOW}') <= 400 * 86400 AS fresh, l_returnflag = 'R' AS restricted FROM u WHERE rn = 1)
SELECT p_partkey, p_brand, count(*) AS n_units, count(*) FILTER (fresh AND NOT restricted AND price BETWEEN 500 AND 20000) AS n_qualifying,
  CASE WHEN count(*) FILTER (fresh AND NOT restricted AND price BETWEEN 500 AND 20000) > 0 THEN 'verified' ELSE 'stale' END AS status
FROM q JOIN part ON l_partkey = p_partkey GROUP BY 1, 2
""")
def qualifying_parts(spark, sf_dir):
    """The flagship: parts with the state of their newest unit prices: fresh, in range, unrestricted."""
    li = table(spark, sf_dir, "lineitem").select("l_partkey", "l_suppkey", "l_returnflag", *ORDER)
    u = latest.latest_per_key(li, ["l_partkey", "l_suppkey"], newest())
    price = F.col("l_extendedprice") / F.col("l_quantity")
    fresh = price_fresh("l_shipdate", F.lit(None).cast("timestamp_ntz"), now(), hours=400 * 24)
    good = fresh & (F.col("l_returnflag") != "R") & pricing.endpoint_in_range(price, price, 500, 20000)
    g = u.groupBy("l_partkey").agg(F.count("*").alias("n_units"), F.count_if(good).alias("n_qualifying"))
    p = table(spark, sf_dir, "part").select("p_partkey", "p_brand")
    j = g.join(p, g["l_partkey"] == p["p_partkey"])
    return j.select("p_partkey", "p_brand", "n_units", "n_qualifying", pricing.verification_status(F.lit(False), F.col("n_qualifying") > 0, F.lit(True)).alias("status"))
