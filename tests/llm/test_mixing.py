import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from ashlar.llm import mixing


def size(t):
    return len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))


def slow_targets(sizes, weights, share=1.5, most=2):
    caps, out = [most * s for s in sizes], [0.0] * len(sizes)
    lo, hi = 0.0, 1e9
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if sum(min(c, mid * w) for c, w in zip(caps, weights)) < share * sum(sizes) else (lo, mid)
    return [min(c, hi * w) for c, w in zip(caps, weights)]


@pytest.mark.parametrize("sizes", [[100, 100, 100], [1000, 1, 1], [1, 1, 1000], [0, 5, 7, 1000, 3], [10] * 20])
def test_targets(sizes):
    weights = [(5.0, 2.0, 1.0)[k % 3] for k in range(len(sizes))]
    assert mixing.targets(sizes, weights) == pytest.approx(slow_targets(sizes, weights), rel=1e-6)


@pytest.mark.parametrize("n", [1, 2, 3, 17, 64, 1000])
def test_permutation(n):
    x = np.arange(n)
    y = mixing.permute(x, n, 99)
    assert sorted(y) == list(range(n)) and (mixing.permute(y, n, 99, back=True) == x).all()
    assert n < 50 or (y != x).sum() > n // 2


def test_group_counts_add_up():
    quota, sizes = np.array([100, 7, 0, 300]), [50] * 8 + [7]
    got = [mixing.group_counts(quota, sizes, g, 3) for g in range(9)]
    assert [int(c.sum()) for c, _ in got] == sizes
    before = np.zeros(4, np.int64)
    for counts, first in got:
        assert (first == before).all() and (counts >= 0).all()
        before = before + counts
    assert before.tolist() == quota.tolist()


def test_many_sources(spark, docs):
    """20,000 sources: the mix gives each its target, and no task holds more than a row of counts."""
    df = spark.range(20_000).selectExpr("id AS doc_id", "repeat(concat('w', id % 97, ' '), 1 + CAST(id % 5 AS int)) AS text", "'en' AS lang", "concat('s', id) AS source", "1L AS n_chars")
    pieces, rows, sources = mixing.mix(df)
    got = mixing.taken(pieces, rows).groupBy("source").sum("sum").collect()
    want = {s.name: s.words for s in sources}
    assert len(want) == 20_000 and {r[0]: r[1] for r in got} == want


@pytest.mark.parametrize(("words", "target"), [(1000, 1500.0), (1000, 2000.0), (1000, 1.0), (1000, 999.6), (7, 9.0), (64, 128.0), (65, 97.0), (1, 2.0), (130, 131.0)])
def test_slots_give_the_target(words, target):
    s = mixing.Source("a", words, target, 64, 5)
    _, block, take = s.picked(0, s.slots)
    assert take.sum() == round(target) and (take > 0).all()
    assert max(Counter(block.tolist()).values()) <= 2
    parts = [s.picked(k, min(k + 3, s.slots)) for k in range(0, s.slots, 3)]
    assert np.array_equal(np.concatenate([p[1] for p in parts]), block) and np.array_equal(np.concatenate([p[2] for p in parts]), take)


ROWS = [(k, " ".join(f"w{k}_{j}" for j in range(1 + k * 37 % 211)), ("big", "b", "c", None, "é")[min(4, k % 9 // 2 if k % 3 else 0)]) for k in range(150)] + [(900, None, "b"), (901, "", "only empty"), (902, " \t", None), (None, "x y z", "b"), (5, "again with that id", "big")]


@pytest.fixture
def mixed(spark, docs):
    df = docs(ROWS + [ROWS[7], ROWS[7]]).withColumn("first", F.lit(1)).withColumn("number", F.lit(1))
    return df, mixing.mix(df, block=16, shard_slots=50)


def test_mix(mixed):
    df, (pieces, rows, sources) = mixed
    got = mixing.taken(pieces, rows).collect()
    all_rows = ROWS + [ROWS[7], ROWS[7]]
    assert len(got) == len(all_rows)
    sums = defaultdict(int)
    for _, t, s in all_rows:
        sums[s] += size(t)
    order = sorted(sums, key=lambda s: (s is None, (s or "").encode()))
    aims = dict(zip(order, slow_targets([sums[s] for s in order], [(5.0, 2.0, 1.0)[k % 3] for k in range(len(order))])))
    took = defaultdict(int)
    for r in got:
        assert r["sum"] <= 2 * r["size"] and r["source_size"] == sums[r["source"]] and r["target"] == pytest.approx(aims[r["source"]])
        took[r["source"]] += r["sum"]
    assert all(abs(took[s] - aims[s]) <= 0.5 + 1e-6 for s in order)
    assert sorted((r["id"], r["size"]) for r in got if r["id"] is not None) == sorted((d, size(t)) for d, t, _ in all_rows if d is not None)


def test_slots_are_filled_once(mixed):
    _, (pieces, _, _) = mixed
    fill = defaultdict(int)
    for r in pieces.collect():
        assert r["at"] + r["z"] - r["a"] <= 16
        fill[r["shard"], r["slot"]] += r["z"] - r["a"]
    shards = Counter(s for s, _ in fill)
    assert sorted(shards.values())[1:] == [50] * (len(shards) - 1)
    assert Counter(fill.values())[16] > 0.8 * len(fill)


def test_reruns_agree(spark, docs, mixed):
    df, (pieces, rows, _) = mixed
    one = sorted(map(tuple, mixing.taken(pieces, rows).select("id", "first", "sum").collect()), key=str)
    again = mixing.mix(df.repartition(7).orderBy(F.desc("n_chars")), block=16, shard_slots=50)
    assert sorted(map(tuple, mixing.taken(again[0], again[1]).select("id", "first", "sum").collect()), key=str) == one


def test_documents_of_the_mix(spark, docs):
    df = docs(ROWS)
    pieces, rows, _ = mixing.mix(df, block=16, shard_slots=50)
    want = {(r["id"], r["key"]): r["sum"] for r in mixing.taken(pieces, rows).collect()}
    out = mixing.mixed_documents(df, block=16, shard_slots=50)
    assert out.columns == df.columns
    got, texts = defaultdict(int), {(d, s): t for d, t, s in ROWS}
    for r in out.withColumn("k", F.xxhash64("text")).collect():
        got[r.doc_id, r.source] += size(r.text)
        assert r.n_chars == len(r.text) and set(r.text.split()) <= set(" ".join(t or "" for d, t, s in ROWS if d == r.doc_id).split())
        full = texts.get((r.doc_id, r.source))
        assert size(r.text) < size(full) or r.text == full or r.doc_id == 5
    assert sum(got.values()) == sum(want.values())


def test_repeated_rows_keep_their_words(docs):
    df = docs([(1, "a b c", "s"), (1, "a b c", "s"), (2, "d e", "t")])
    out = mixing.mixed_documents(df, block=2)
    pieces, rows, _ = mixing.mix(df, block=2)
    assert sum(size(r.text) for r in out.collect()) == sum(r["sum"] for r in mixing.taken(pieces, rows).collect())


def test_empty(docs):
    pieces, rows, _ = mixing.mix(docs([]))
    assert mixing.taken(pieces, rows).count() == 0 and mixing.mixed_documents(docs([(1, None, "s"), (2, "", None)])).count() == 0


def test_slices():
    assert mixing.slice_words("  a b\n c ", [(0, 3)]) == "  a b\n c " and mixing.slice_words(" a b c", [(0, 1), (2, 3)]) == " a c" and mixing.slice_words("", [(0, 0)]) == ""
