import os

import pytest
from pyspark.sql import functions as F

from ashlar.sources.reference_files import contents, decoded, in_time, no_files, refreshed

CASES = [
    ("año, 東京".encode(), "año, 東京", "utf-8", False), ("﻿año".encode(), "año", "utf-8 with mark", False), ("año".encode("latin-1"), "año", "latin-1", False), (b"", "", "utf-8", False),
    ("abc東".encode()[:-1], "abc", "utf-8", True), ("abé\U0001f600".encode()[:-3], "abé", "utf-8", True), ("x\U0001f600".encode()[:-1], "x", "utf-8", True), (b"caf\xe9", "café", "latin-1", False), (b"caf\xe9 au lait", "café au lait", "latin-1", False), (b"\xff\xfe", "ÿþ", "latin-1", False), (b"plain\r\n", "plain\r\n", "utf-8", False),
]


def test_decoding(spark):
    df = spark.createDataFrame([(k, bytearray(b)) for k, (b, *_) in enumerate(CASES)] + [(99, None)], "k int, b binary")
    got = {r["k"]: r["d"] for r in df.select("k", decoded("b").alias("d")).collect()}
    assert got.pop(99) is None
    assert {k: tuple(d) for k, d in got.items()} == {k: tuple(rest) for k, (_, *rest) in enumerate(CASES)}


@pytest.fixture
def folder(tmp_path):
    for name, text in (("a.csv", "año".encode()), ("b.csv", "año".encode("latin-1")), ("c.csv", b"same"), ("d.csv", b"same"), ("e.txt", b"no")):
        (tmp_path / name).write_bytes(text)
    return tmp_path


def test_only_changed_files_are_read(spark, folder):
    at = lambda day: F.lit(f"2026-01-{day:02} 00:00:00").cast("timestamp")
    names = lambda paths: [p.rsplit("/", 1)[-1] for p in paths]
    first, read = refreshed(spark, f"file://{folder}", no_files(spark), at(1), "*.csv")
    kept = spark.createDataFrame(first.collect(), first.schema)
    assert names(read) == ["a.csv", "b.csv", "c.csv", "d.csv"] and {r["text"] for r in kept.collect()} == {"año", "same"}
    assert refreshed(spark, f"file://{folder}", kept, at(2), "*.csv")[1] == []
    (folder / "b.csv").write_bytes(b"new one")
    os.utime(folder / "b.csv", (2_000_000_000, 2_000_000_000))
    (folder / "d.csv").unlink()
    (folder / "f.csv").write_bytes(b"f")
    second, read = refreshed(spark, f"file://{folder}", kept, at(9), "*.csv")
    assert names(read) == ["b.csv", "f.csv"]
    assert sorted((names([r["path"]])[0], r["text"]) for r in second.collect()) == [("a.csv", "año"), ("b.csv", "new one"), ("c.csv", "same"), ("f.csv", "f")]
    assert sorted(names(r["path"] for r in in_time(second, at(10), 3).collect())) == ["b.csv", "f.csv"]
    assert sorted(map(len, (r["paths"] for r in contents(kept).collect()))) == [1, 1, 2]
