import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from ashlar.llm import sharding, suffix_dedup

# -- sharding


@pytest.fixture
def store(spark, tmp_path):
    return sharding.ShardStore(spark, f"file://{tmp_path}/store", target_bytes=40_000, fan_in=3)


def arrival(docs, n, seed):
    rnd = random.Random(seed)
    return docs([(k, rnd.randbytes(60).hex(), "s") for k in range(n)]).repartition(1)


def test_append_and_compact(spark, docs, store):
    for k in range(7):
        store.append(arrival(docs, 60, k))
    before = store.manifest()
    assert before["version"] == 7 and len(before["shards"]) == 7
    want = sorted(map(tuple, store.read().drop("shard", "tier").collect()))
    store.compact()
    after = store.manifest()
    assert len(after["shards"]) < 4 and sum(s["rows"] for s in after["shards"]) == 420 and max(s["bytes"] for s in after["shards"]) < 2 * 40_000
    assert sorted(map(tuple, store.read().drop("shard", "tier").collect())) == want
    assert sorted(map(tuple, store.read(version=7).drop("shard", "tier").collect())) == want
    assert store.vacuum() == 0 and store.vacuum(0) == 7 and sorted(map(tuple, store.read().drop("shard", "tier").collect())) == want


def test_large_shards_are_left_alone(docs, store):
    store.append(arrival(docs, 900, 1))
    big = {s["path"] for s in store.manifest()["shards"]}
    for k in range(3):
        store.append(arrival(docs, 10, k))
    store.compact()
    left = {s["path"] for s in store.manifest()["shards"]}
    assert big <= left and len(left) == 2


def test_two_writers(docs, store):
    store.append(arrival(docs, 5, 1))
    now = store.manifest()
    store.append(arrival(docs, 5, 2))
    with pytest.raises(sharding.CommitConflict):
        store._commit(now["version"], now["schema"], now["shards"])
    assert store.version() == 2 and store.read().count() == 10


def test_vacuum_spares_a_writer_that_has_not_committed(docs, store):
    store.append(arrival(docs, 5, 1))
    now = store.manifest()
    late = store._write(arrival(docs, 7, 2))
    sharding.shard(arrival(docs, 0, 3), store.root)
    now = store.manifest()
    store._commit(now["version"], now["schema"], now["shards"] + late)
    assert store.read().count() == 12


def test_a_version_whose_files_are_gone_is_not_committed(docs, store):
    store.append(arrival(docs, 5, 1))
    now, late = store.manifest(), store._write(arrival(docs, 7, 2))
    assert store.vacuum(0) == 1
    with pytest.raises(sharding.CommitConflict):
        store._commit(now["version"], now["schema"], now["shards"] + late)
    assert store.version() == 1 and store.read().count() == 5


def test_many_threads_commit_one_version(docs, store):
    from concurrent.futures import ThreadPoolExecutor

    store.append(arrival(docs, 5, 1))
    now = store.manifest()

    def commit(_):
        try:
            return store._commit(now["version"], now["schema"], now["shards"])["version"]
        except sharding.CommitConflict:
            return None

    with ThreadPoolExecutor(8) as pool:
        assert [v for v in pool.map(commit, range(16)) if v] == [2]
    assert not [s for s in store.fs.listStatus(store._path()) if "draft" in s.getPath().getName()]


def test_query_against_the_files(spark, docs, folder):
    """op3 read with another reader: each row once, in the file it names, whose size gives the tier."""
    import math
    import pathlib

    import pyarrow.parquet as pq

    rows = [(k, None if k % 7 == 0 else f"text {k} " * (k % 50), "s") for k in range(900)]
    path = folder(documents=docs(rows).repartition(9))
    out = sharding.op3_sharding(spark, path)
    got = out.collect()
    files = {pathlib.Path(f.removeprefix("file://").removeprefix("file:")) for f in out.inputFiles()}
    held = {f.name: {(r["doc_id"], r["text"]) for r in pq.read_table(f).to_pylist()} for f in files if f.name in {r.shard for r in got}}
    assert sorted((r.doc_id, r.shard) for r in got) == sorted((d, name) for name, rs in held.items() for d, _ in rs) and len(got) == 900
    texts = dict((d, t) for d, t, _ in rows)
    assert all(r.text_sha256 == (None if texts[r.doc_id] is None else hashlib.sha256(texts[r.doc_id].encode()).hexdigest()) for r in got)
    size = {f.name: f.stat().st_size for f in files}
    assert all(r.tier == max(0, math.floor(math.log(size[r.shard] / (1 << 20), 4))) for r in got) and len({r.version for r in got}) == 1


@pytest.mark.parametrize("parts,folder_", [(1, None), (5, None), (None, "/root/testdata/sf0.001"), (None, "/root/testdata/sf0.01")])
def test_each_version_by_another_reader(spark, docs, parts, folder_):
    """The manifests, replayed with json and pyarrow: each version holds what has arrived, whole, merges change nothing, and the last holds merged shards."""
    import json
    import pathlib

    import pyarrow.parquet as pq

    df = spark.read.parquet(f"{folder_}/documents.parquet") if folder_ else docs([(None if k % 5 == 0 else k, f"text {k}" * (k % 9), "s") for k in range(400)]).repartition(parts)
    store = sharding.shard_arrivals(df, "doc_id", vacuum=False)
    root = pathlib.Path(store.root.removeprefix("file://").removeprefix("file:"))
    versions = [json.loads(f.read_text()) for f in sorted(root.glob("manifest-*.json"))]
    assert [v["version"] for v in versions] == list(range(1, len(versions) + 1)) and len(versions) > sharding.ARRIVALS
    came = df.select("doc_id", "text", F.pmod(F.xxhash64("doc_id"), F.lit(sharding.ARRIVALS)).alias("k")).collect()
    arrived, merges, before = 0, 0, {}
    for v in versions:
        now = {s["path"]: sorted(((r["doc_id"], r["text"]) for r in pq.read_table(root / s["path"], columns=["doc_id", "text"]).to_pylist()), key=str) for s in v["shards"]}
        assert {s["path"]: s["rows"] for s in v["shards"]} == {p: len(rows) for p, rows in now.items()}
        if gone := set(before) - set(now):
            merges += 1
            new = set(now) - set(before)
            assert len(gone) >= store.fan_in and len(new) < len(gone)
            assert sorted((r for p in gone for r in before[p]), key=str) == sorted((r for p in new for r in now[p]), key=str)
        else:
            arrived += 1
        assert sorted((r for rows in now.values() for r in rows), key=str) == sorted(((r.doc_id, r.text) for r in came if r.k < arrived), key=str)
        before = now
    assert arrived == sharding.ARRIVALS and merges >= (1 if parts == 1 or folder_ else 2)
    assert any(s["path"].split("/")[0] not in {p.split("/")[0] for w in versions[:3] for p in (x["path"] for x in w["shards"])} for s in versions[-1]["shards"])


def test_odd_tables(spark, docs, tmp_path):
    df = docs([(1, None, None), (None, "", "s"), (1, "x" * 200_000, "s"), (2, "a", "s"), (2, "a", "s")]).withColumn("shard", F.lit("mine")).withColumn("tier", F.lit(9))
    out = sharding.shard(df).read()
    assert out.columns == [*df.columns, "_shard", "_tier"]
    assert sorted(map(str, out.select(df.columns).collect())) == sorted(map(str, df.collect()))
    empty = sharding.shard(df.limit(0)).read()
    assert empty.count() == 0 and empty.columns == out.columns


def test_other_columns_are_refused(docs, store):
    store.append(arrival(docs, 2, 1))
    with pytest.raises(ValueError):
        store.append(arrival(docs, 2, 1).drop("lang"))


# -- suffixes


def brute(rows, t=50):
    first = {}
    for d, x in rows:
        if d is not None:
            for k in range(len(x) - t + 1):
                w = x[k : k + t]
                first[w] = min(first.get(w, d), d)
    out = []
    for d, x in rows:
        cov = bytearray(len(x))
        for k in range(len(x) - t + 1) if d is not None else ():
            if first[x[k : k + t]] < d:
                cov[k : k + t] = b"\1" * t
        kept = bytes(c for c, v in zip(x, cov) if not v)
        runs = sum(1 for k in range(len(cov)) if cov[k] and (not k or not cov[k - 1]))
        out.append((d, len(x), sum(cov), runs, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def check(docs, rows):
    got = suffix_dedup.suffix_dedup(docs([(d, t, None) for d, t in rows]).withColumn("th", F.lit(1)).withColumn("digits", F.lit(1))).collect()
    assert sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, hashlib.sha256(bytes(r.kept)).hexdigest()) for r in got), key=str) == brute([(d, (t or "").encode()) for d, t in rows])


def made(seed, alphabet="ab é", n=60):
    rnd = random.Random(seed)
    word = lambda k: "".join(rnd.choice(alphabet) for _ in range(k))
    parts = [word(rnd.randint(20, 160)) for _ in range(8)]
    rows = [(rnd.randint(0, 40), "".join(rnd.choice(parts) if rnd.random() < 0.5 else word(rnd.randint(0, 90)) for _ in range(rnd.randint(0, 6)))) for _ in range(n)]
    return rows + rows[:3] + [(None, rows[4][1]), (3, None), (3, ""), (99, "x" * 49), (98, "y" * 50), (97, "y" * 51), (96, "z" * 400), (95, "z" * 75), (94, "ab" * 300), (93, "ba" * 40)]


@pytest.mark.parametrize("seed", range(3))
def test_suffixes(spark, docs, seed):
    check(docs, made(seed, "ab é" if seed else "abcdefghij "))


def test_small_chunks_and_many_buckets(spark, docs, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "CHUNK", 128)
    monkeypatch.setattr(suffix_dedup, "BUCKET_BYTES", 700)
    check(docs, made(9))


def test_shared_passage(spark, docs):
    rnd = random.Random(4)
    passage = "".join(rnd.choice("abcdefgh ") for _ in range(300))
    check(docs, [(k, rnd.randbytes(40).hex() + passage + rnd.randbytes(40).hex() if k % 3 else rnd.randbytes(100).hex()) for k in range(150)])


def test_no_suffixes(docs):
    assert suffix_dedup.suffix_dedup(docs([])).count() == 0


def test_radix_passes_against_sorting():
    """The order is that of the bytes, but in groups of one document; what neighbours share is counted."""
    rnd = np.random.default_rng(1)
    for kinds in (2, 3, 40):
        pool = rnd.integers(0, 2, (kinds, suffix_dedup.THRESHOLD), dtype=np.uint8) * 255
        strings = pool[rnd.integers(0, kinds, 300)]
        strings[::7, -1] = 7
        order, shared = suffix_dedup.ordered(strings, np.arange(300))
        rows = [bytes(strings[k]) for k in order]
        assert rows == sorted(map(bytes, strings))
        assert shared.tolist() == [0] + [next((i for i in range(len(a)) if a[i] != b[i]), len(a)) for a, b in zip(rows, rows[1:])]
        order, _ = suffix_dedup.ordered(strings, np.zeros(300, int))
        assert [bytes(strings[k])[:8] for k in order] == sorted(bytes(x)[:8] for x in strings)


def test_one_passage_in_every_document(docs):
    rnd = random.Random(6)
    passage = "".join(rnd.choice("abcdefgh ") for _ in range(120))
    check(docs, [(k, f"{rnd.random()}{passage}{rnd.random()}") for k in range(400)])
