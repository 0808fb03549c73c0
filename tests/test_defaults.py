"""Operators with their default limits: what is just inside and just outside of each."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from ashlar.operators import pricing, scoring

NOW = datetime(2026, 10, 3, 12)


def now():
    return F.expr("TIMESTAMP_NTZ'2026-10-03 12:00:00'")


def confidence(spark, rows):
    df = spark.createDataFrame([(1, k, s, None if d is None else NOW - timedelta(days=d), w) for k, (s, d, w) in enumerate(rows)], "e int, r int, s string, t timestamp_ntz, i double")
    return scoring.evidence_confidence(df, ["e"], "r", "s", "t", "i", now()).first().confidence


@pytest.mark.parametrize("rows, want", [
    ([("a", 10, 1.0)] * 2, "insufficient"),
    ([("a", 10, 1.0)] * 3, "low"),
    ([("a", 10, 1.0)] * 5, "medium"),
    ([("a", 10, 1.0)] * 4 + [("b", 900, 1.0)] * 4, "high"),
    ([("a", 10, 1.0)] * 3 + [("b", 900, 1.0)] * 5, "medium"),
    ([("a", 10, 1.0)] * 11, "medium"),
    ([("a", 10, 1.0)] * 12, "high"),
    ([("a", 10, 1.0)] * 4 + [("a", 10, 4.0)], "medium"),
    ([("a", 10, 1.0)] * 4 + [("a", 10, 4.1)], "low"),
    ([("a", 1500, 1.0)] * 7 + [("a", 10, 1.0)] * 3, "medium"),
    ([("a", 1500, 1.0)] * 8 + [("a", 10, 1.0)] * 3, "low"),
    ([("a", None, 1.0)] * 5, "medium"),
])
def test_confidence(spark, rows, want):
    assert confidence(spark, rows) == want


def test_trends(spark):
    rows = [(e, f"{e}-{k}", theme, new) for e, new_hits, old_hits, size in ((1, 3, 0, 3), (2, 1, 1, 3), (3, 2, 0, 2)) for new, hits in ((True, new_hits), (False, old_hits))
            for k in range(size * new, size * (new + 1)) for theme in (["noise"] if k - size * new < hits else ["other"])]
    df = spark.createDataFrame(rows, "e int, r string, theme string, new boolean")
    got = scoring.theme_trends(df, ["e"], "theme", "r", F.col("new")).collect()
    assert sorted((t.e, t.theme, round(t.change, 6)) for t in got) == [(1, "noise", 1.0), (1, "other", -1.0)]


@pytest.mark.parametrize("days, want", [([0, 14, 100, 200, 300], []), ([0, 7, 14, 200, 300], [(3, 5)]), ([0, 7, 15, 200, 300], []), ([0, 7, 14, 200], []), ([0, 7, 14, 100, 200, 300, 400, 500], [])])
def test_bursts(spark, days, want):
    df = spark.createDataFrame([(1, k, NOW + timedelta(days=d)) for k, d in enumerate(days)], "e int, r int, t timestamp_ntz")
    assert [(b.burst, b.total) for b in scoring.bursts(df, ["e"], "t", "r", 14).collect()] == want


@pytest.mark.parametrize("ratings, want", [
    ([(3.0, 3, "exact")], "ok"), ([(2.99, 3, "exact")], "low_rating"), ([(2.0, 2, "exact")], "insufficient"), ([(2.0, 9, "weak")], "insufficient"), ([], "no_reviews"),
    ([(3.5, 9, "exact"), (2.5, 9, "probable")], "conflict"), ([(3.4, 90, "exact"), (2.5, 3, "exact")], "ok"), ([(3.4, 3, "exact"), (2.5, 90, "exact")], "low_rating"),
])
def test_rating_decision(spark, ratings, want):
    rows = [(1, a, n, c) for a, n, c in ratings] or [(1, None, 0, "exact")]
    df = spark.createDataFrame(rows, "e int, average double, n int, confidence string")
    assert pricing.rating_decision(df, ["e"], "average", "n", "confidence").first().status == want
