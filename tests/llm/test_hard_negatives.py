import math
import random

import numpy as np
import pytest
from parity import assert_same, connect
from pyspark.sql import functions as F

from ashlar.llm import hard_negatives
from ashlar.llm.hard_negatives import SQL, build, kmeans, mine, op13_hard_negatives, search

FOLDER = "/root/testdata/sf0.001"
COLUMNS = "vec_id long, embedding array<float>, label int, score int, x string, list string"


def test_same_as_sql(spark):
    assert_same(spark, connect(FOLDER), FOLDER, op13_hard_negatives, SQL)


def brute(rows, positives=5, negatives=10):
    """All anchors against all rows, by the definition."""
    kept = []
    for i, v, label, *_ in rows:
        if label is None or not v or any(c is None or not math.isfinite(c) for c in v):
            continue
        kept.append((i, [math.floor(256 * float(np.float32(c))) for c in v], (label + 1) % 10 if i is not None and i % 7 == 0 else label))
    first = lambda r: (-r[0], r[1] is None, r[1] or 0)
    out = []
    for at, (i, v, label) in enumerate(kept):
        if i is None or i % 100:
            continue
        scored = [(sum(a * b for a, b in zip(v, w)), j, m) for k, (j, w, m) in enumerate(kept) if k != at]
        for p, j, _ in sorted((r for r in scored if r[2] == label), key=first)[:positives]:
            found = sorted((r for r in scored if r[2] != label and 30 * p <= 100 * r[0] <= 90 * p), key=first)[:negatives]
            out += [(i, j, rank, r[1], p, r[0]) for rank, r in enumerate(found, 1)]
    return sorted(out, key=str)


def relabelled(df):
    return df.withColumn("label", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")))


def run(spark, rows, **options):
    df = relabelled(spark.createDataFrame([(*r, 0, "x", "y") for r in rows], COLUMNS).repartition(3))
    return sorted(map(tuple, mine(df, F.col("vec_id") % 100 == 0, **options).collect()), key=str)


SMALL = dict(rows_a_list=20, block=7, tile=3, blocks_a_task=4, sample_rows=60)


@pytest.mark.parametrize("options", [{}, SMALL])
def test_against_brute_force(spark, options):
    rng = random.Random(4)
    rows = []
    for k in range(400):
        near = [math.sin(k % 5 + d) for d in range(6)]
        rows.append((k * 25, [c + rng.gauss(0, 0.4) for c in near], rng.choice([0, 1, 2, 9])))
    rows += [(5000 + 100 * k, [0.5] * 6, k % 2) for k in range(40)]  # one very common vector
    rows += [(None, [0.4, 0.5, 0.6, 0.1, 0.2, 0.3], 1)] * 3 + [(300, [0.5, 0.5, 0.5, 0.5, 0.5, 0.4], 1)] * 2
    rows += [(700, None, 1), (800, [1.0] * 6, None), (900, [1.0, None, 1.0, 1.0, 1.0, 1.0], 1), (1000, [float("nan")] * 6, 1), (1100, [float("inf")] * 6, 1)]
    want = brute(rows)
    assert len(want) > 300 and run(spark, rows, **options) == want


def test_negative_scores_few_rows_and_none(spark):
    rows = [(0, [1.0, 0.0], 1), (1, [-1.0, 0.0], 1), (2, [-0.5, 0.0], 0), (100, [0.0, 1.0], 3)]
    assert run(spark, rows) == brute(rows) == []
    assert run(spark, [(0, [1.0, 0.0], 0), (3, [0.0, 0.5], 1), (4, [0.0, 1.0], 2)]) == [(0, 3, 1, 4, 0, 0)]  # a window of 0 alone
    for none in ([(0, None, 1)], [(1, [1.0], 1)], [(100, [1.0], 1)]):
        assert run(spark, none) == []


def test_entries_that_no_float_product_holds(spark):
    rows = [(100 * k, [2.0**10 * math.cos(k), 2.0**10 * math.sin(k), 2.0**14 / (k + 1)], k % 3) for k in range(30)]
    assert run(spark, rows, **SMALL) == brute(rows)
    with pytest.raises(ValueError, match="longs"):
        run(spark, [(0, [1e12, 0.0], 1), (1, [1.0, 1.0], 1)])


def test_lists_hold_all_rows_and_bounds_skip_most(spark, monkeypatch):
    rng = np.random.default_rng(5)
    centers = np.eye(8) * 4
    x = [(int(k), [int(c) for c in np.rint(256 * (centers[k % 8] + rng.normal(0, 0.05, 8)))], int(k % 8)) for k in range(800)]
    df = spark.createDataFrame(x, "id long, x array<long>, label long").withColumn("anchor", F.col("id") < 8)
    index = build(df, rows_a_list=50, block=40, sample_rows=400)
    assert index.rows.count() == 800 and index.blocks.count() <= index.blocks_in_all
    far = index.rows.groupBy("list").agg(F.max("far").alias("far")).collect()
    assert all(index.lists.radii[r["list"]] >= math.sqrt(r["far"]) for r in far)
    wants = index.rows.where("anchor").select(F.col("row").alias("key"), F.lit(0).cast("long").alias("want"), "label", "list", "x", F.lit(-(1 << 62)).alias("low"), F.lit(1 << 62).alias("high"))
    sent = []
    monkeypatch.setattr(hard_negatives, "discard", lambda df: sent.append(df.where("list >= 0").select("tile", "list").count()))
    found = search(index, wants, True, 3, tile=1).collect()
    assert len(found) == 24 and sent[0] <= 8 * len(index.lists.centers) / 4


def test_kmeans():
    x = np.array([[0, 0], [0, 1], [9, 9], [9, 10], [9, 9]])
    assert sorted(map(tuple, kmeans(x, 2))) == [(0, 0), (9, 9)]
    assert len(kmeans(x, 10)) == 4 and kmeans(x[:1], 3).tolist() == [[0, 0]]
