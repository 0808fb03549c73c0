import hashlib
import os
from collections import defaultdict

import pytest
from parity import assert_same, connect
from pyspark.sql import functions as F

from ashlar.llm import exact_dedup, line_dedup, queries

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")
@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_same_as_sql(spark, name):
    assert_same(spark, connect(FOLDER), FOLDER, queries.QUERIES[name], queries.ORACLE_SQL[name])


TEXTS = ["Abc", "aBC", None, "", "ÀB", "àb", "x" * 5000, "X" * 5000, "x" * 4999 + "y", "abc", "abc"]


def lower(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")


@pytest.mark.parametrize("digest", [True, False])
def test_exact(spark, docs, digest):
    rows = [(k % 9, t, None) for k, t in enumerate(TEXTS)] + [(None, "abc", "s")]
    df = docs(rows).withColumn("n", F.lit(1)).withColumn("ph", F.lit(2)).withColumn("id", F.lit(3))
    got = exact_dedup.exact_dedup(df, digest=digest).collect()
    groups = defaultdict(list)
    for d, t, _ in rows:
        groups[lower(t)].append(d)
    want = []
    for d, t, _ in rows:
        g = groups[lower(t)]
        keep = max(x for x in g if x is not None)
        want.append((d, keep, len(g), d == keep))
    key = lambda r: tuple((x is None, x) for x in r)
    assert sorted([(r.doc_id, r.keep_id, r.group_size, r.kept) for r in got], key=key) == sorted(want, key=key)
    if digest:
        assert {bytes(r.full_hash) for r in got} == {hashlib.sha256(lower(t).encode()).digest() for _, t, _ in rows}


def test_exact_empty(spark, docs):
    assert exact_dedup.exact_dedup(docs([]), digest=True).count() == 0


def test_exact_large_group(spark, docs):
    df = spark.range(5000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 > 0, F.lit("Same")).otherwise(F.col("id").cast("string")).alias("text"))
    got = exact_dedup.exact_dedup(df)
    assert got.where("kept").count() == 1668
    assert got.where("group_size > 1").select("keep_id").distinct().collect()[0][0] == 4999


def brute_lines(rows, k=3):
    split = [None if t is None else t.split("\n") for _, t in rows]
    first, gone = {}, [set() for _ in rows]
    order = sorted((i for i in range(len(rows)) if split[i] is not None), key=lambda i: rows[i][0])
    for i in order:
        for p in range(len(split[i]) - k + 1):
            w = tuple(split[i][p : p + k])
            if first.setdefault(w, (i, p)) != (i, p):
                gone[i] |= set(range(p, p + k))
    return [None if s is None else "\n".join(x for n, x in enumerate(s) if n not in g) for s, g in zip(split, gone)]


def test_lines(spark, docs):
    rows = [(1, "a\nb\nc\nd"), (2, "x\na\nb\nc\ny"), (3, "b\nc\nd\nb\nc\nd"), (4, None), (5, ""), (6, "a\nb"), (7, "z\nz\nz\nz\nz"), (8, "\n\n\n\n"), (9, "x\na\nb\nc\nd\nq")]
    got = {r.doc_id: r for r in line_dedup.line_dedup(docs([(d, t, None) for d, t in rows]).withColumn("pos", F.lit(0)).withColumn("runs", F.lit(0))).collect()}
    for (d, t), kept in zip(rows, brute_lines(rows)):
        assert got[d].kept_text == kept, d
        assert got[d].n_lines == (0 if t is None else t.count("\n") + 1)
    assert got[3].n_removed == 6 and got[3].n_runs == 1 and got[2].n_runs == 1 and got[1].n_runs == 0


def test_repeated_rows_are_later_occurrences(spark, docs):
    rows = [(1, "a\nb\nc\nd")] * 2 + [(None, "p\nq\nr")] * 3 + [(2, "x\ny")] * 2 + [(3, None)] * 2 + [(None, "a\nb\nc\nz"), (4, "k\nl\nm\n" * 3000)]
    got = sorted(((r.doc_id, r.n_lines, r.n_removed, r.n_runs, r.kept_text) for r in line_dedup.line_dedup(docs([(d, t, None) for d, t in rows])).collect()), key=str)
    seen, want = set(), []
    for d, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "") if r[1] != "a\nb\nc\nz" else (False, -1, "")):
        ls, gone = (t.split("\n") if t is not None else []), set()
        for p in range(len(ls) - 2):
            w = tuple(ls[p : p + 3])
            if w in seen:
                gone |= {p, p + 1, p + 2}
            seen.add(w)
        runs = sum(1 for k in gone if k - 1 not in gone)
        want.append((d, len(ls), len(gone), runs, None if t is None else "\n".join(x for k, x in enumerate(ls) if k not in gone)))
    assert got == sorted(want, key=str)


def test_lines_agree_with_the_sql_on_repeats(spark, docs, folder):
    rows = [(1, "a\nb\nc\nd", None), (1, "a\nb\nc\nd", None), (None, "e\nf\ng", None), (None, "e\nf\ng", None), (2, None, None), (3, "", None), (2, "b\nc\nd\ne\nf\ng", None)]
    path = folder(documents=docs(rows))
    # In the SQL nulls come last, here first: compared as if they were the smallest ids.
    sql = line_dedup.SQL.replace("ORDER BY doc_id, pos", "ORDER BY doc_id NULLS FIRST, pos")
    assert_same(spark, connect(path), path, line_dedup.op2_line_dedup, sql)


def test_each_pass_reads_what_the_one_before_left(spark, docs, monkeypatch):
    """Rows of a length of their own have no prefix hash, and those of a prefix of their own no full hash."""
    same, written = "x" * 200, []
    rows = [(1, "a", None), (2, "bb", None), (3, same + "1", None), (4, same + "2", None), (5, "y" * 201, None), (6, same.upper() + "1", None)]
    monkeypatch.setattr(exact_dedup, "cut", lambda df: written.append(df) or df)
    got = {r.doc_id: r for r in exact_dedup.exact_dedup(docs(rows)).collect()}
    lengths, prefixes, left = written
    assert [r.n for r in lengths.collect()] == [201]
    assert [(r.n, r["rows"]) for r in prefixes.collect()] == [(201, 3)]
    left = {r.id: r for r in left.collect()}
    assert {k for k, r in left.items() if r.ph is not None} == {3, 4, 5, 6} and {k for k, r in left.items() if r.full_hash is not None} == {3, 4, 6}
    assert {k: (r.keep_id, r.group_size) for k, r in got.items()} == {1: (1, 1), 2: (2, 1), 3: (6, 2), 4: (4, 1), 5: (5, 1), 6: (6, 2)}


def test_lines_empty(docs):
    assert line_dedup.line_dedup(docs([])).count() == 0
