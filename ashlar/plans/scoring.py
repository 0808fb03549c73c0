"""Scoring queries: events are the mentions of users; purchase and signup speak for, error against, others are neutral."""

from __future__ import annotations

from pyspark.sql import functions as F

from ashlar.functions.scalars import commute_score as commute_column
from ashlar.functions.scalars import downgrade, rate_per_1000, ratio_score, recency_weight, round_to
from ashlar.operators import scoring
from ashlar.plans.pricing import NOW, now
from ashlar.plans.registry import query
from ashlar.session import table

#: Events' dates are put eight years wide, so that the bands of age have rows.
EVENTS_NOW = "2024-02-01 00:00:00"
AGED = "(ts - to_days(CAST(event_id % 3000 AS INTEGER)))"
WEIGHT = f"CASE WHEN a <= 2 THEN 1.0 WHEN a <= 4 THEN 0.6 WHEN a <= 7 THEN 0.3 ELSE 0.15 END"
ITEMS = f"""(SELECT event_id, user_id, event_type, value, p, pol, a, {WEIGHT} AS w FROM (SELECT *, {AGED} AS p, CASE WHEN event_type IN ('purchase', 'signup') THEN 1.0 WHEN event_type = 'error' THEN -1.0 ELSE 0.0 END AS pol,
  greatest(0, date_diff('microsecond', {AGED}, TIMESTAMP '{EVENTS_NOW}') / 1e6 / 86400 / 365.25) AS a FROM events))"""


def events_now():
    return F.expr(f"TIMESTAMP_NTZ'{EVENTS_NOW}'")


def items(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    aged = F.expr("timestampadd(DAY, -CAST(event_id % 3000 AS INT), ts)")
    pol = F.when(F.col("event_type").isin("purchase", "signup"), 1.0).when(F.col("event_type") == "error", -1.0).otherwise(0.0)
    e = e.withColumn("published", aged).withColumn("value", pol)
    return e.withColumn("influence", recency_weight("published", events_now()))


@query(f"""
SELECT user_id, round(net, 6) AS net, floor(greatest(1.0, least(10.0, 5.5 + 4.5 * net)) * 10 + 0.5 + 1e-9) / 10 AS score
FROM (SELECT user_id, sum(w * pol) / (sum(w) + 2) AS net FROM {ITEMS} GROUP BY 1)
""")
def net_sentiment_score(spark, sf_dir):
    g = items(spark, sf_dir).groupBy("user_id").agg(scoring.net_sentiment().alias("net"))
    return g.select("user_id", F.round("net", 6).alias("net"), scoring.sentiment_score(F.col("net")).alias("score"))


CONFIDENCE_SQL = f"""
WITH r AS (SELECT user_id, event_type, event_id % 7 AS review, w, a FROM {ITEMS}),
per AS (SELECT user_id, review, max(event_type) AS s, max(CASE WHEN a <= 2 THEN 1 ELSE 0 END) AS rec, sum(w) AS i, sum(CASE WHEN a > 4 THEN 1 ELSE 0 END) AS o, count(*) AS n FROM r GROUP BY 1, 2),
g AS (SELECT user_id, count(*) AS reviews, CAST(sum(rec) AS BIGINT) AS recent, count(DISTINCT s) AS sources, max(i) / sum(i) AS dom, sum(o) / sum(n) AS old FROM per GROUP BY 1),
l AS (SELECT *, CASE WHEN reviews < 3 THEN 'insufficient' WHEN reviews >= 7 AND recent >= 3 AND (sources >= 2 OR reviews >= 15) THEN 'high' WHEN reviews >= 5 THEN 'medium' ELSE 'low' END AS level FROM g)
SELECT user_id, reviews, recent, sources, round(dom, 6) AS dominant_share, round(old, 6) AS old_share, level,
  CASE WHEN dom > 0.25 OR old > 0.6 THEN CASE level WHEN 'high' THEN 'medium' WHEN 'medium' THEN 'low' ELSE level END ELSE level END AS confidence FROM l
"""


def _confidence(spark, sf_dir):
    rows = items(spark, sf_dir).withColumn("review", F.col("event_id") % 7)
    return scoring.evidence_confidence(rows, ["user_id"], "review", "event_type", "published", "influence", events_now(), high=7, high_recent=3, high_single=15, dominant=0.25, old=0.6)


@query(CONFIDENCE_SQL)
def confidence_ladder(spark, sf_dir):
    return _confidence(spark, sf_dir).select("user_id", "reviews", "recent", "sources", F.round("dominant_share", 6).alias("dominant_share"), F.round("old_share", 6).alias("old_share"), "level", "confidence")


@query(f"""
SELECT user_id, CASE WHEN confidence = 'high' AND recent < 8 THEN 'medium' WHEN confidence = 'medium' AND recent < 5 THEN 'low' WHEN confidence = 'low' AND recent < 3 THEN 'insufficient' ELSE confidence END AS confidence
FROM ({CONFIDENCE_SQL})
""")
def confidence_downgrade(spark, sf_dir):
    return _confidence(spark, sf_dir).select("user_id", downgrade("confidence", "recent").alias("confidence"))


@query(f"""
WITH g AS (SELECT user_id, event_type, CASE WHEN pol > 0 THEN 'positive' WHEN pol < 0 THEN 'negative' ELSE 'neutral' END AS polarity, count(DISTINCT event_id) AS reviews, sum(w) AS weight FROM {ITEMS} GROUP BY 1, 2, 3 HAVING count(DISTINCT event_id) >= 2)
SELECT user_id, event_type, polarity, reviews, CAST(round(weight, 4) AS DOUBLE) AS weight, row_number() OVER (PARTITION BY user_id ORDER BY reviews DESC, round(weight, 6) DESC, event_type, polarity) AS rank FROM g
""")
def theme_rollup_having(spark, sf_dir):
    rows = items(spark, sf_dir).withColumn("polarity", F.when(F.col("value") > 0, "positive").when(F.col("value") < 0, "negative").otherwise("neutral"))
    out = scoring.theme_rollup(rows, ["user_id"], "event_type", "polarity", "event_id", "influence", least=2)
    return out.select("user_id", "event_type", "polarity", "reviews", F.round("weight", 4).alias("weight"), "rank")


@query("""
WITH e AS (SELECT *, ts >= TIMESTAMP '2024-01-16' AS is_new FROM events),
t AS (SELECT user_id, count(DISTINCT event_id) FILTER (is_new) AS nn, count(DISTINCT event_id) FILTER (NOT is_new) AS oo FROM e GROUP BY 1),
p AS (SELECT user_id, event_type, count(DISTINCT event_id) FILTER (is_new) AS n, count(DISTINCT event_id) FILTER (NOT is_new) AS o FROM e GROUP BY 1, 2),
c AS (SELECT user_id, event_type, n / nn - o / oo AS change FROM p JOIN t USING (user_id) WHERE nn >= 3 AND oo >= 3)
SELECT * FROM (SELECT user_id, event_type, round(change, 6) AS change, row_number() OVER (PARTITION BY user_id ORDER BY round(abs(change), 9) DESC, event_type) AS rank FROM c WHERE abs(change) >= 0.05) WHERE rank <= 3
""")
def theme_trends(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "ts")
    out = scoring.theme_trends(e, ["user_id"], "event_type", "event_id", F.col("ts") >= F.expr("TIMESTAMP_NTZ'2024-01-16 00:00:00'"), change=0.05, top=3)
    return out.select("user_id", "event_type", F.round("change", 6).alias("change"), "rank")


@query("""
SELECT event_id, user_id, floor((value - mean) * 100.0 + 0.5 + 1e-6) / 100.0 AS off FROM (SELECT *, avg(value) OVER (PARTITION BY user_id) AS mean, count(*) OVER (PARTITION BY user_id) AS n FROM events) WHERE n >= 3 AND abs(value - mean) >= 40
""")
def rating_outliers(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", "user_id", "value")
    return scoring.outliers(e, ["user_id"], "value", 40.0).select("event_id", "user_id", round_to(F.col("value") - F.col("mean"), 2).alias("off"))


@query(f"""
WITH a AS (SELECT date_diff('microsecond', o_orderdate, TIMESTAMP '{NOW}') / 1e6 / 86400 / 365.25 AS a FROM orders),
b AS (SELECT CASE WHEN a IS NULL THEN 'unknown' WHEN a <= 2 THEN '0-2' WHEN a <= 4 THEN '2-4' WHEN a <= 7 THEN '4-7' ELSE '7+' END AS bucket FROM a)
SELECT n.bucket, count(b.bucket) AS n FROM (VALUES ('0-2'), ('2-4'), ('4-7'), ('7+'), ('unknown')) n(bucket) LEFT JOIN b USING (bucket) GROUP BY 1
""")
def age_histogram(spark, sf_dir):
    return scoring.age_histogram(table(spark, sf_dir, "orders").select("o_orderdate"), "o_orderdate", now())


@query("""
WITH e AS (SELECT event_id, user_id, epoch(date_trunc('second', ts)) AS s FROM events),
w AS (SELECT a.user_id, a.event_id, a.s, (SELECT count(*) FROM e b WHERE b.user_id = a.user_id AND b.s BETWEEN a.s AND a.s + 86400) AS n FROM e a),
r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, s, event_id) AS rn, count(*) OVER (PARTITION BY user_id) AS total FROM w)
SELECT user_id, n AS burst, event_id AS anchor, total FROM r WHERE rn = 1 AND n >= 3 AND total >= 5 AND n / total >= 0.08
""")
def review_burst(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", "user_id", "ts")
    return scoring.bursts(e, ["user_id"], "ts", "event_id", days=1, share=0.08).select("user_id", "burst", "anchor", "total")


@query("""
WITH g AS (SELECT o_custkey, floor((epoch(o_orderdate) - epoch(lag(o_orderdate) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey))) / 86400) AS gap FROM orders)
SELECT o_custkey, count(*) FILTER (gap <= 30) AS repeats, CAST(min(gap) AS BIGINT) AS least_gap FROM g GROUP BY 1 HAVING count(*) FILTER (gap <= 30) > 0
""")
def recurrence_gap(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_custkey", "o_orderdate", "o_orderkey")
    return scoring.recurrences(o, ["o_custkey"], "o_orderdate", "o_orderkey", 30)


CATEGORIES = list(scoring.CATEGORY_WEIGHTS)
PARTS = " UNION ALL ".join(f"SELECT c_custkey, {w} AS w, CASE WHEN (c_custkey * {k + 3}) % 7 < 4 THEN 1 + (c_custkey * {k + 5}) % 10 END AS s, (c_custkey + {k}) % 4 AS l FROM customer" for k, w in enumerate(scoring.CATEGORY_WEIGHTS.values()))


@query(f"""
WITH p AS ({PARTS}), g AS (SELECT c_custkey, count(*) FILTER (s IS NOT NULL AND l < 3) AS categories, round(coalesce(sum(w) FILTER (s IS NOT NULL AND l < 3), 0), 6) AS coverage,
  sum(w * s) FILTER (s IS NOT NULL AND l < 3) AS ws, round(sum(w * CASE l WHEN 0 THEN 1.0 WHEN 1 THEN 0.66 ELSE 0.33 END) FILTER (s IS NOT NULL AND l < 3), 6) AS ix FROM p GROUP BY 1)
SELECT c_custkey, categories, CAST(coverage AS DOUBLE) AS coverage, CAST(CASE WHEN categories >= 2 AND coverage >= 0.3 THEN floor(CAST(ws AS DOUBLE) / coverage * 10 + 0.5 + 1e-9) / 10 END AS DOUBLE) AS score,
  CASE WHEN NOT (categories >= 2 AND coverage >= 0.3) THEN 'insufficient' WHEN ix >= 0.7 THEN 'high' WHEN ix >= 0.45 THEN 'medium' ELSE 'low' END AS confidence FROM g
""")
def overall_score(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select("c_custkey")
    key = F.col("c_custkey")
    rows = F.explode(F.array(*(F.struct(
        F.lit(name).alias("category"), F.when((key * (k + 3)) % 7 < 4, (1 + (key * (k + 5)) % 10).cast("double")).alias("score"),
        F.element_at(F.array(*map(F.lit, ("high", "medium", "low", "insufficient"))), ((key + k) % 4 + 1).cast("int")).alias("confidence")) for k, name in enumerate(CATEGORIES))))
    p = c.select("c_custkey", rows.alias("x")).select("c_custkey", "x.*")
    return scoring.overall_score(p, "c_custkey", "category", "score", "confidence")


@query("""
WITH t AS (SELECT c_nationkey, count(*) AS orders FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1), n AS (SELECT c_nationkey, count(*) AS people FROM customer GROUP BY 1),
a AS (SELECT sum(orders) / (SELECT count(*) FROM customer) * 1000 AS ref FROM t)
SELECT n_name, round(orders * 1000 / people, 2) AS per_1000, round(greatest(1, least(10, 5.5 - 2.25 * log2((orders * 1000 / people) / ref))), 4) AS score
FROM nation JOIN n ON n_nationkey = n.c_nationkey JOIN t ON t.c_nationkey = n.c_nationkey, a
""")
def per_1000_vs_reference(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_custkey")
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    people = c.groupBy("c_nationkey").agg(F.count("*").alias("people"))
    orders = o.join(c, o["o_custkey"] == c["c_custkey"]).groupBy("c_nationkey").agg(F.count("*").alias("orders"))
    t = people.join(orders, "c_nationkey")
    ref = t.agg((F.sum("orders") * 1000 / F.sum("people")).alias("ref"))
    n = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    j = t.join(n, t["c_nationkey"] == n["n_nationkey"]).crossJoin(F.broadcast(ref))  # one row
    rate = F.col("orders") * 1000 / F.col("people")
    return j.select("n_name", rate_per_1000("orders", "people").alias("per_1000"), F.round(ratio_score(rate / F.col("ref")), 4).alias("score"))


@query("""
SELECT s_suppkey, basis, minutes, floor(greatest(1.0, least(10.0, 10.0 - 9.0 * (minutes - 10.0) / 35.0)) * 10 + 0.5 + 1e-9) / 10 AS score FROM (
  SELECT s_suppkey, CASE WHEN am IS NOT NULL AND pm IS NOT NULL THEN 'rush_average' WHEN am IS NOT NULL THEN 'am_rush' WHEN pm IS NOT NULL THEN 'pm_rush' ELSE 'free_flow' END AS basis, CAST(coalesce((am + pm) / 2, am, pm, ff) AS DOUBLE) AS minutes
  FROM (SELECT s_suppkey, CASE WHEN s_suppkey % 3 > 0 THEN 10 + s_suppkey % 41 END AS am, CASE WHEN s_suppkey % 4 > 0 THEN 12 + s_suppkey % 37 END AS pm, 5 + s_suppkey % 29 AS ff FROM supplier))
""")
def commute_score(spark, sf_dir):
    key = F.col("s_suppkey")
    s = table(spark, sf_dir, "supplier").select("s_suppkey", F.when(key % 3 > 0, 10 + key % 41).alias("am"), F.when(key % 4 > 0, 12 + key % 37).alias("pm"), (5 + key % 29).alias("ff"))
    basis = F.when(F.col("am").isNotNull() & F.col("pm").isNotNull(), "rush_average").when(F.col("am").isNotNull(), "am_rush").when(F.col("pm").isNotNull(), "pm_rush").otherwise("free_flow")
    minutes = F.coalesce((F.col("am") + F.col("pm")) / 2, F.col("am").cast("double"), F.col("pm").cast("double"), F.col("ff").cast("double"))
    return s.select("s_suppkey", basis.alias("basis"), minutes.alias("minutes")).withColumn("score", commute_column("minutes"))
