import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as P
from ashlar.llm import mixing, sharding
from test_near_copies import brute

LETTERS = {"xa": "abcdeio", "xb": "fghijklo"}
PASSAGE = "one two three four five six seven eight nine ten eleven twelve"


@pytest.fixture
def data(spark, folder):
    rnd = random.Random(8)
    rows = []
    for k in range(160):
        lang = rnd.choice(list(LETTERS))
        text = " ".join("".join(rnd.choice(LETTERS[lang]) for _ in range(rnd.randint(2, 7))) for _ in range(rnd.randint(30, 80)))
        rows.append((k, text, lang, f"s{k % 4}"))
    rows += [(200, rows[3][1], "xa", "s0"), (201, rows[3][1].upper(), "xa", "s1"), (202, rows[5][1] + " " + PASSAGE, "xa", "s1"), (206, f"abcd cab {PASSAGE} dead", "xa", "s1"), (203, "12 34 !!", None, "s2"), (204, None, None, None), (205, "", "xa", "s3")]
    docs = spark.createDataFrame([(*r, None if r[1] is None else len(r[1])) for r in rows], "doc_id long, text string, lang string, source string, n_chars long")
    bench = spark.createDataFrame([(1, PASSAGE), (2, None)], "item_id long, text string")
    return folder(documents=docs, benchmark=bench), rows


def test_stages_against_plain_steps(spark, data):
    path, rows = data
    docs = spark.read.parquet(f"{path}/documents.parquet")
    columns = docs.columns
    kept = {r[0] for r in rows}
    seen = {}
    for name, stage in P.STAGES:
        docs = P.cut(stage(spark, docs, path))
        seen[name] = docs
        if name != P.STAGES[-1][0]:
            assert docs.columns == columns
    assert {r.doc_id for r in seen["language ID"].collect()} == kept - {203, 204, 205}
    left = sorted((r[0], r[1]) for r in rows if r[0] not in (203, 204, 205))
    near = {r.doc_id for r in seen["SimHash near-dedup"].collect()}
    assert near == {left[k][0] for k in brute([t for _, t in left])} and not near & {200, 201, 202} and 206 in near
    clean = {r.doc_id for r in seen["benchmark decontamination"].collect()}
    assert clean == near - {206}
    words = lambda df: df.groupBy("source").agg(F.sum(mixing.word_count(F.col("text"))).alias("n"))
    have = {r.source: r.n for r in words(seen["benchmark decontamination"]).collect()}
    aims = mixing.targets([have[s] for s in sorted(have)], [5.0, 2.0, 1.0, 5.0])
    took = {r.source: r.n for r in words(seen["mixing"]).collect()}
    assert [took.get(s, 0) for s in sorted(have)] == [round(a) for a in aims]
    last = seen["sharding"]
    assert sorted(map(str, last.select(columns).collect())) == sorted(map(str, seen["mixing"].collect()))
    assert last.where("shard is null").count() == 0


def test_run(spark, data):
    path, _ = data
    out = P.run(spark, path)
    assert out.count() > 0 and P.ORACLE_SQL is None and len(P.STAGES) == 5
    assert sharding.TARGET_BYTES > 0
