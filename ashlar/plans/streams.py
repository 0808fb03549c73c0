"""Streams over the events table, run to the end and held against their batch form."""

from __future__ import annotations

from pyspark.sql import functions as F

from ashlar.plans.registry import query
from ashlar.streaming import streams as S


def _events(spark, sf_dir):
    return S.read_stream(spark, f"{sf_dir}/events.parquet", "ts")


@query("SELECT strftime(time_bucket(INTERVAL 1 day, ts), '%Y-%m-%d') AS day, event_type, count(*) AS n, round(sum(value), 2) AS v FROM events GROUP BY 1, 2")
def stream_tumbling(spark, sf_dir):
    agg = S.tumbling(_events(spark, sf_dir), "ts", "1 day", "1 day", ["event_type"], F.count("*").alias("n"), F.sum("value").alias("v"))
    out = S.drain(agg, "complete")
    return out.select(F.date_format("window.start", "yyyy-MM-dd").alias("day"), "event_type", "n", F.round("v", 2).alias("v"))


@query("""
WITH g AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 2 hour THEN 0 ELSE 1 END AS fresh FROM events),
s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM g)
SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS began, count(*) AS n FROM s GROUP BY user_id, k
""")
def stream_sessions(spark, sf_dir):
    agg = S.sessions(_events(spark, sf_dir), "ts", "2 hours", "1 day", ["user_id"], F.count("*").alias("n"))
    out = S.drain(agg, "complete")
    return out.select("user_id", F.date_format("session_window.start", "yyyy-MM-dd HH:mm:ss").alias("began"), "n")


@query("SELECT event_id, user_id FROM events")
def stream_dedup(spark, sf_dir):
    e = _events(spark, sf_dir)
    twice = e.withColumn("copy", F.explode(F.array(F.lit(1), F.lit(2)))).drop("copy")
    return S.drain(S.first_seen(twice, "ts", "40 days", ["event_id"]).select("event_id", "user_id"))


@query("SELECT user_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn = 1")
def stream_latest(spark, sf_dir):
    return S.latest_by_key(_events(spark, sf_dir).select("user_id", "ts", "event_id"), ["user_id"], ["ts", "event_id"]).select("user_id", "event_id")


@query("""
SELECT strftime(d, '%Y-%m-%d') AS day, count(*) AS n FROM (SELECT unnest([time_bucket(INTERVAL 1 day, ts), time_bucket(INTERVAL 1 day, ts) - INTERVAL 1 day, time_bucket(INTERVAL 1 day, ts) - INTERVAL 2 day]) AS d FROM events) GROUP BY 1
""")
def stream_sliding(spark, sf_dir):
    agg = S.sliding(_events(spark, sf_dir), "ts", "3 days", "1 day", "1 day", [], F.count("*").alias("n"))
    return S.drain(agg, "complete").select(F.date_format("window.start", "yyyy-MM-dd").alias("day"), "n")


@query("""
WITH e AS (SELECT event_id AS call, 'u' || user_id % 17 AS source, ts, strftime(timezone('America/Los_Angeles', timezone('UTC', ts)), '%Y-%m') AS period, event_id % 3 > 0 AS failed FROM events),
n AS (SELECT *, row_number() OVER (PARTITION BY source, period ORDER BY ts, call) AS call_no, count(*) FILTER (NOT failed) OVER (PARTITION BY source, period ORDER BY ts, call ROWS UNBOUNDED PRECEDING) AS run FROM e),
r AS (SELECT *, count(*) FILTER (failed) OVER (PARTITION BY source, period, run ORDER BY call_no ROWS UNBOUNDED PRECEDING) AS bad FROM n),
s AS (SELECT source, period, min(call_no) AS stop FROM r WHERE bad >= 6 AND call_no <= 40 GROUP BY 1, 2)
SELECT source, call, period, call_no, CASE WHEN call_no > stop THEN 'breaker open' WHEN call_no > 40 THEN 'over budget' ELSE 'granted' END AS decision FROM n LEFT JOIN s USING (source, period)
""")
def stream_budgets(spark, sf_dir):
    """Decisions on every event as a call of its user's group, by a stream with state. Months that close are left out."""
    from ashlar.streaming import budgets
    from ashlar.tables import filesystem, shared_dir

    calls = _events(spark, sf_dir).select(F.concat(F.lit("u"), (F.col("user_id") % 17).cast("string")).alias("source"), F.col("event_id").alias("call"), F.col("ts").alias("at"), (F.col("event_id") % 3 > 0).alias("failed"))
    root = shared_dir(spark)
    fs, p = filesystem(spark, root)
    fs.deleteOnExit(p)
    return budgets.keep(budgets.ledger(calls, 40, 6, "40 days"), root).where("decision <> 'closed'")
