"""What the third round's findings asked for of the suffix-array dedup: its disk."""

import random
import time

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pytest

from ashlar.llm import suffix_dedup as S


def shuffled(spark):
    """Sizes of the shuffle files that are there, by name."""
    files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().mkString("\n").split("\n")
    of = spark._jvm.java.io.File
    return {f: of(f).length() for f in files if f.endswith(".data") and "shuffle_" in f}


def texts(n=300):
    rnd = random.Random(5)
    word = lambda k: "".join(rnd.choice("abcdefgh ") for _ in range(k))
    parts = [word(300) for _ in range(n // 3)]
    return [(k, word(900) + parts[k % len(parts)] + word(900), None) for k in range(n)]


def test_earlier_shuffles_do_not_stay(spark, docs, monkeypatch):
    rows, before, wrote, cut = docs(texts()), set(shuffled(spark)), [], S.cut
    monkeypatch.setattr(S, "cut", lambda df: (cut(df), wrote.append(df))[0])
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    old = spark.conf.get(key, None)
    out = S.suffix_dedup(rows)
    until = time.time() + 20
    while (left := sum(size for f, size in shuffled(spark).items() if f not in before)) > 1000 and time.time() < until:  # they go in the background; a sum for each task of the first count stays
        time.sleep(0.2)
    assert len(wrote) == 2 and left <= 1000 and spark.conf.get(key, None) == old
    assert out.where("n_removed >= 300").count() == 200 == out.where("n_removed > 0").count()


def test_rows_between_passes_are_small(docs):
    """Bytes that go through the two shuffles, for each key and for each key with its surroundings."""
    table = docs(texts()).select("doc_id", "text").toArrow().combine_chunks()
    data, offsets = S._bytes_of(table["text"])
    piece, _, _, _, h = S.digits(data, offsets)
    first = list(S._first_pass(2)(iter(table.to_batches())))
    assert sum(len(x.as_py() or b"") for b in first for n in ("digits", "who", "ids") for x in b.column(n)) < 8 * len(h)  # 8 for the hash alone before
    shared = [S._marks(h[piece == k]).view(np.int32) for k in range(len(table))]
    todo = table.append_column("th", table["doc_id"]).append_column("digits", [shared]).select(["doc_id", "th", "text", "digits"])
    second = list(S._second_pass(2)(iter(todo.to_batches())))
    assert sum(len(x.as_py() or b"") for b in second for n in ("spans", "packed") for x in b.column(n)) < 36 * len(h)


def test_windows_are_unpacked_as_they_were_packed():
    rnd = np.random.default_rng(3)
    for n, named in ((1, 1), (500, 40)):
        o1 = rnd.integers(0, S._SPREAD + 1, n)
        offsets = np.column_stack([o1, rnd.integers(o1, S._SPREAD + 1)]).astype(np.uint8)
        around = rnd.integers(1, 256, (n, S._WIDTH), dtype=np.uint8)
        around[~S._in_use(offsets)] = 0
        whole = np.concatenate([around, offsets], axis=1)
        entry, place = rnd.integers(0, named, n), rnd.integers(0, 2**31 - 1, n)
        doc, th = (rnd.integers(-(2**63), 2**63 - 1, named) for _ in range(2))
        for a, b in zip(S._as_packed(S._packed(whole, entry, place, doc, th)), (whole, entry, place, doc, th), strict=True):
            assert (a == b).all() and len(a) == len(b)
        least = np.minimum(offsets[:, 0], offsets[:, 1]).astype(np.int64)
        spans = S._spans(place, least, offsets[:, 1].astype(np.int64))
        a, size = spans >> S._LENGTH, spans & ((1 << S._LENGTH) - 1)
        assert (a == place - offsets[:, 1]).all() and (size == offsets[:, 1] - least + S.THRESHOLD).all()


def covered(rows, buckets):
    """What the passes find in rows (id, bytes), in this process, where their sizes can be set."""
    each = lambda batches, work, t=pa.Table.from_batches: pa.concat_tables([work(t(batches).filter(pc.field("dest") == d)) for d in sorted({x for b in batches for x in b["dest"].to_pylist()})])
    cols = {"doc_id": pa.array([d for d, _ in rows], pa.int64()), "text": pa.array([x for _, x in rows], pa.binary())}
    left = each(list(S._first_pass(buckets)(iter(pa.table(cols).to_batches(9)))), S._left_over)
    of = {d: [] for d, _ in rows}
    for d, x in zip(left["doc_id"].to_pylist(), left["digit"].to_pylist()):
        of[d].append(x)
    todo = pa.table({"doc_id": cols["doc_id"], "th": pa.array(range(len(rows)), pa.int64()), "text": cols["text"], "digits": pa.array([of[d] for d, _ in rows], pa.list_(pa.int32()))})
    found = each(list(S._second_pass(buckets)(iter(todo.to_batches(9)))), S._full_depth)
    th, span = found["th"].to_numpy(), found["span"].to_numpy()
    return [S.merged(np.column_stack([a := span[th == k] >> S._LENGTH, a + (span[th == k] & 127)])).tolist() for k in range(len(rows))]


@pytest.mark.parametrize(("gathered", "chunk", "many", "buckets"), [(250_000, 1 << 21, 0xFFFF, 1), (1, 1 << 21, 0xFFFF, 3), (40, 300, 0xFFFF, 7), (250_000, 400, 9, 2)])
def test_windows_gathered_a_few_at_a_time(monkeypatch, gathered, chunk, many, buckets):
    rnd = random.Random(gathered)
    parts = [bytes(rnd.choice(b"ab c") for _ in range(rnd.randint(30, 160))) for _ in range(9)]
    rows = [(rnd.randint(-3, 50), b"".join(rnd.choice(parts) if rnd.random() < 0.6 else rnd.randbytes(40) for _ in range(rnd.randint(1, 6)))) for _ in range(70)]
    for name, value in (("GATHERED", gathered), ("CHUNK", chunk), ("_MANY", np.uint16(many))):
        monkeypatch.setattr(S, name, value)
    rows, first, want = [(d, x) for d, x in rows if len(x) >= S.THRESHOLD], {}, []
    for d, x in rows:
        for k in range(len(x) - S.THRESHOLD + 1):
            w = x[k : k + S.THRESHOLD]
            first[w] = min(first.get(w, d), d)
    for d, x in rows:
        at = [k for k in range(len(x) - S.THRESHOLD + 1) if first[x[k : k + S.THRESHOLD]] < d]
        want.append(S.merged(np.array([[k, k + S.THRESHOLD] for k in at], np.int64)).tolist())
    assert covered(rows, buckets) == want and any(want)
