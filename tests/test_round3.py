"""What the third round's findings asked for."""

import random

from ashlar.operators import matching


def test_nearest_compares_places_not_rows(spark, monkeypatch):
    rnd = random.Random(1)
    spots = [(37.2 + rnd.randrange(40) / 1000, -122.3 + rnd.randrange(40) / 1000) for _ in range(60)]
    rows = [(k, *spots[rnd.randrange(60)]) for k in range(150)] + [(1000 + k, 37.5, -122.0) for k in range(400)] + [(2000, 38.5, -121.0), (2001, None, -121.0)]
    df = spark.createDataFrame(rows, "id long, lat double, lon double")
    seen = []
    pairs = matching.near_pairs
    monkeypatch.setattr(matching, "near_pairs", lambda a, b, *r: (seen.append(a.count() * b.count()), pairs(a, b, *r))[1])
    got = {r["id"]: (r["nearest"], round(r["meters"], 4)) for r in matching.nearest(df, "id", 1500.0).collect()}
    assert seen == [len({r[1:] for r in rows if r[1]}) ** 2]  # 400 rows at one place are one place
    want = pairs(df, df, 1500.0).where("a_id <> b_id").selectExpr("a_id", "struct(round(meters, 4) AS r, b_id AS b) AS m").groupBy("a_id").agg({"m": "min"}).collect()
    assert got == {r[0]: (r[1]["b"], r[1]["r"]) for r in want}
    assert got[1000] == (1001, 0.0) and got[1399] == (1000, 0.0) and 2000 not in got


def test_nearest_years_takes_the_least_by_the_sqls_order(spark, tmp_path):
    from parity import assert_same, connect

    from __spark_entry__ import oracle_sql, queries

    keys = [20 + 37 * k for k in range(6000)]
    spark.createDataFrame([(k, "b") for k in keys if k != 20], "p_partkey long, p_brand string").coalesce(1).write.parquet(str(tmp_path / "part.parquet"))
    assert_same(spark, connect(tmp_path), tmp_path, queries()["nearest_years"], oracle_sql()["nearest_years"])


def test_ornaments_of_dollar_signs_are_no_amounts(spark):
    from ashlar.functions import scalars as S

    texts = ["$$$ 170.11 word", "$$$ a; US$5", "one $$$ two $40 or $50", "$ 30"]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string")
    got = df.select("k", S.fee_items("t", S.F.lit(True)).alias("f")).selectExpr("k", "transform(f, x -> x.amount_text) AS a").orderBy("k").collect()
    assert [list(r["a"]) for r in got] == [[None], [None, "$5"], ["$40 or $50"], ["$ 30"]]


def test_a_row_just_at_the_gap_is_an_outlier_in_any_order(spark):
    import random

    from ashlar.operators import scoring

    rnd, rows = random.Random(2), []
    for g in range(200):  # the mean of cents is whole cents, and the last value is 40.00 above it
        cents = [rnd.randrange(0, 9000) for _ in range(40)]
        cents[0] += -sum(cents) % 40
        rows += [(g, c / 100, False) for c in cents]
        mean = sum(cents) // 40
        rows += [(g, (mean + 4000) / 100, True), (g, (mean - 4000) / 100, True)]
    df = spark.createDataFrame(rows, "g int, v double, edge boolean")
    assert scoring.outliers(df, ["g"], "v", 40.0).where("edge").count() == 400


def test_language_model_is_the_same_in_slices(monkeypatch):
    import numpy as np

    from ashlar.llm import language_id as L

    rnd = np.random.default_rng(3)
    rows = [L.grams("".join(map(chr, rnd.integers(97 + 5 * (k % 3), 110 + 5 * (k % 3), 60)))) for k in range(60)]
    whole = L.fit(rows, [f"l{k % 3}" for k in range(60)], 12)
    monkeypatch.setattr(L, "_CELLS", 600)
    peak = []
    product = L.product
    monkeypatch.setattr(L, "product", lambda r, v, d: (peak.append(d.size), product(r, v, d))[1])
    small = L.fit(rows, [f"l{k % 3}" for k in range(60)], 12)
    assert np.allclose(whole.weights, small.weights, atol=1e-4) and np.allclose(whole.bias, small.bias, atol=1e-4)
    assert max(peak) <= 600


def test_tasks_get_bounded_shares_of_rows(spark, monkeypatch):
    from pyspark.sql import functions as F

    from ashlar import tables
    from ashlar.operators import assessments, pricing, views

    monkeypatch.setattr(tables, "TASK_ROWS", 50)
    df = spark.range(2000).select((F.col("id") % 500).alias("k"), (F.col("id") % 7 == 0).alias("bad"))
    out = pricing.spread_restrictions(df, ["k"], F.col("bad"))
    assert out.rdd.getNumPartitions() == 40
    assert out.where("restricted").count() == len({k % 500 for k in range(0, 2000, 7)}) * 4
    index = views.evidence_index(spark.range(300).select("id", F.lit("a").alias("content")))
    found, missing = views.resolve_ids(spark.range(1000).select("id"), index)
    assert found.rdd.getNumPartitions() == missing.rdd.getNumPartitions() == 20 and (found.count(), missing.count()) == (300, 700)
    reviews = spark.range(400).selectExpr("id % 3 AS property", "id AS review", "'s' AS source", "timestamp'2025-01-01' AS published", "CAST(NULL AS map<string,double>) AS parts")
    mentions = reviews.selectExpr("review", "'noise' AS category", "'quiet' AS theme", "'positive' AS polarity")
    items = assessments.scored_items(mentions, reviews, F.lit("2026-01-01").cast("timestamp"))
    assert items.where("theme = 'quiet'").count() == 400
    assert items.rdd.getNumPartitions() >= 24
