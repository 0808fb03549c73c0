import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from ashlar.llm import simhash


def slow_fingerprint(text):
    words = re.findall(rb"[^\x20\x09-\x0D]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode()))
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    h = [xxhash.xxh64_intdigest(s, seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def slow_components(rows):
    fps = [(d, slow_fingerprint(t)) for d, t in rows]
    root = list(range(len(fps)))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i][1] ^ fps[j][1]).bit_count() <= 4:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    ids = {}
    for k, (d, _) in enumerate(fps):
        if d is not None:
            ids[find(k)] = min(ids.get(find(k), d), d)
    return sorted(((d, fp, ids.get(find(k))) for k, (d, fp) in enumerate(fps)), key=str)


def corpus():
    rnd = random.Random(3)
    words = ["w%d" % k for k in range(300)]
    texts = [None, "", " \t\n", "One", "two Words", "É É é x", "A b C d", "a B c D"]
    for _ in range(40):
        base = [rnd.choice(words) for _ in range(rnd.randint(5, 400))]
        texts.append(" ".join(base))
        for _ in range(rnd.randint(0, 3)):
            near = list(base)
            near[rnd.randrange(len(near))] = "changed"
            texts.append("\n".join(near))
    rows = list(enumerate(texts)) + [(5, texts[20]), (None, texts[30]), (None, "alone in the world with a null id")]
    rnd.shuffle(rows)
    return rows


def test_against_brute_force(spark, docs):
    rows = corpus()
    df = docs([(d, t, None) for d, t in rows]).withColumn("fp", F.lit(1)).withColumn("id", F.lit(1))
    got = sorted(((r.id, r.fp & (2**64 - 1), r.component) for r in simhash.near_components(df).collect()), key=str)
    assert got == slow_components(rows)


def test_dense_groups(spark):
    rnd = np.random.default_rng(5)
    base = rnd.integers(0, 2**63, 6, dtype=np.uint64)
    fps = {int(b) ^ sum(1 << int(k) for k in rnd.choice(64, rnd.integers(0, 7), replace=False)) for b in base for _ in range(60)}
    signed = [x - 2**64 if x >= 2**63 else x for x in fps]
    df = spark.createDataFrame([(x,) for x in signed], "fp long")
    edges = [(r.u & (2**64 - 1), r.v & (2**64 - 1)) for r in simhash.links(df, tile=16).collect()]
    assert all((u ^ v).bit_count() <= 4 for u, v in edges)
    root = {x: x for x in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for u, v in edges:
        root[find(u)] = find(v)
    got = {x: find(x) for x in fps}
    for x in fps:
        for y in fps:
            if (x ^ y).bit_count() <= 4:
                assert got[x] == got[y]


def test_long_text_in_pieces(monkeypatch):
    text = " ".join(str(k % 97) for k in range(1000))
    want = slow_fingerprint(text)
    monkeypatch.setattr(simhash, "_CHUNK", 64)
    assert simhash.fingerprint(text) == want


@pytest.mark.parametrize("rows", [[], [(1, "a"), (1, "a"), (2, "a"), (None, "b c d e f g")]])
def test_drop(spark, docs, rows):
    got = simhash.drop_near_copies(docs([(d, t, "s") for d, t in rows]))
    assert got.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    assert sorted((r.doc_id for r in got.collect()), key=str) == ([1, None] if rows else [])


def test_drop_tells_rows_of_one_id_apart(docs):
    a, b, c = (" ".join(f"{x}{k}" for k in range(60)) for x in "abc")
    drop = lambda rows: sorted(((r.doc_id, r.text) for r in simhash.drop_near_copies(docs([(d, t, "s") for d, t in rows])).collect()), key=str)
    assert drop([(None, a), (None, b), (2, b)]) == [(2, b), (None, a)]
    assert drop([(5, a), (5, b), (2, b)]) == [(2, b), (5, a)]
    assert drop([(5, a), (5, a), (5, c), (7, c), (9, a)]) == [(5, a), (5, c)]
