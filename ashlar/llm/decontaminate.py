"""Benchmark decontamination: one Aho-Corasick automaton over the windows of all benchmark items; each text is scanned once.

The automaton reads words as codes of three characters: a window of ten words takes thirty states at most, however long the words are.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import repeat

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ashlar.llm.common import cut, small_batches, table, tidy
from ashlar.tables import discard

WINDOW = 10
#: Bytes of benchmark text in one automaton, which takes a worker about 180 times as much. A larger benchmark is dealt to several, and the texts scanned
#: once for each, one after the other.
BLOCK_BYTES = 1 << 20

_WORDS = re.compile(rb"[0-9A-Za-z\x80-\xff]+")
#: Words are ASCII letters and digits and all bytes from 0x80; A-Z becomes a-z; every other byte separates.
_NORMAL = bytes((b | 0x20) if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256))


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(_NORMAL).split()


def windows_of(words: list[bytes], size: int = WINDOW) -> set[tuple[bytes, ...]]:
    if not words:
        return set()
    return {tuple(words[i : i + size]) for i in range(max(1, len(words) - size + 1))}


class Windows:
    """All windows of items: a code for each word they use, and the automaton over the codes, which maps each to (number of words, indexes of the items that hold it)."""

    def __init__(self, items: list[tuple[str, str | None]], size: int = WINDOW):
        self.names = [name for name, _ in items]
        self.letters: dict[bytes, str] = {}
        held: dict[str, list[int]] = {}
        for k, (_, text) in enumerate(items):
            for w in windows_of(words_of(text), size):
                held.setdefault("".join(self.letters.setdefault(x, _code(len(self.letters))) for x in w), []).append(k)
        self.auto = ahocorasick.Automaton()
        for w, ks in held.items():
            self.auto.add_word(w, (len(w) // 3, tuple(ks)))
        if held:
            self.auto.make_automaton()

    def scan(self, text: str | None) -> tuple[int, list[tuple[int, int]], set[int]]:
        """Number of words, merged runs [first, last) of hit words, and the items found, in one pass over the text. Codes are equally long, so a
        match's end tells the word; one that ends inside a code is none. Words that no window uses have a code of their own."""
        words = words_of(text)
        if not words or not len(self.auto):
            return len(words), [], set()
        hits = [(e // 3 + 1, v) for e, v in self.auto.iter("".join(map(self.letters.get, words, repeat("\0\0\0")))) if e % 3 == 2]
        if not hits:
            return len(words), [], set()
        return len(words), merged((e - v[0], e) for e, v in hits), {k for _, v in hits for k in v[1]}


def _code(k: int) -> str:
    """Three characters that stand for the k-th word. They are few kinds, as the automaton tries a state's ways on one by one; there are codes for 1.03 million
    words, more than a block has."""
    return chr(1 + k // 10201) + chr(1 + k // 101 % 101) + chr(1 + k % 101)


def merged(spans) -> list[tuple[int, int]]:
    """Spans [first, last) joined where they overlap or touch."""
    runs: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if runs and a <= runs[-1][1]:
            runs[-1] = (runs[-1][0], max(b, runs[-1][1]))
        else:
            runs.append((a, b))
    return runs


def blocks_of(benchmark: DataFrame, id_col: str, text_col: str, block_bytes: int) -> Iterator[list[tuple[str, str | None]]]:
    """The benchmark in blocks, each small enough for one automaton; one at a time in the driver. Its size is asked for first, never assumed."""
    rows = benchmark.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text")).where("text IS NOT NULL")
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(1, -(-size // block_bytes))
    dealt = rows if n == 1 else cut(rows.withColumn("block", F.pmod(F.xxhash64("id", "text"), F.lit(n))).repartition("block"))
    for k in range(n):
        block = dealt if n == 1 else dealt.where(F.col("block") == k).select("id", "text")
        yield sorted(map(tuple, block.collect()), key=lambda r: (r[0] or "", r[1]))


_HITS = pa.struct([("n_words", pa.int64()), ("runs", pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64())]))), ("items", pa.list_(pa.string()))])
_HITS_SQL = "struct<n_words:long,runs:array<struct<first:long,last:long>>,items:array<string>>"


def _row(windows: Windows, text: str | None) -> dict:
    n, runs, found = windows.scan(text)
    return {"n_words": n, "runs": [{"first": a, "last": z} for a, z in runs], "items": sorted({windows.names[k] for k in found} - {None})}


def _added(new: dict, old: dict) -> dict:
    """What two scans of a text found."""
    if not old["runs"] and not old["items"]:
        return new
    runs = merged((r["first"], r["last"]) for r in new["runs"] + old["runs"])
    return {"n_words": new["n_words"], "runs": [{"first": a, "last": z} for a, z in runs], "items": sorted({*new["items"], *old["items"]})}


def scanned(df: DataFrame, benchmark: DataFrame, text_col: str, item_col: str = "item_id", item_text: str = "text", size: int = WINDOW, block_bytes: int = BLOCK_BYTES, hits_col: str = "__hits") -> DataFrame:
    """df with a struct of n_words, runs (of hit words) and items (sorted distinct item ids as strings) for each row. One task, one automaton: with several blocks, each scan's rows
    are written to the shared folder before the next, which adds to what was found."""
    at, out, before = df.columns.index(text_col), df, None
    names, n = df.columns, len(df.columns)
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema), f"`{hits_col}` {_HITS_SQL}"])
    with small_batches(df.sparkSession):
        for items in blocks_of(benchmark, item_col, item_text, block_bytes):
            sent = df.sparkSession.sparkContext.broadcast(items)  # at most block_bytes and one item

            def run(batches: Iterator[pa.RecordBatch], sent=sent, width=len(out.columns)) -> Iterator[pa.RecordBatch]:
                windows = Windows(sent.value, size)
                for b in batches:
                    rows = [_row(windows, t) for t in b.column(at).to_pylist()]
                    if width > n:
                        rows = [_added(new, old) for new, old in zip(rows, b.column(n).to_pylist())]
                    yield pa.RecordBatch.from_arrays([*b.columns[:n], pa.array(rows, _HITS)], names=[*names, hits_col])

            if before is not None:
                out = cut(out)
                if before.columns != df.columns:
                    discard(before)
            before, out = out, out.mapInArrow(tidy(run), schema)
    return out


def find_hits(df: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """id_col, n_words, n_hit, runs (array of hit word runs [first, last)), items (sorted distinct item ids as strings).

    One row for each input row. A null text has no words. An item without words never occurs; a null item id is left out of
    `items` but its text counts as found. An empty benchmark finds nothing; an empty table gives an empty result.
    The benchmark is broadcast in blocks of about block_bytes of text (one block in the usual case); with more, the texts are scanned once for each.
    Other columns are not read.
    """
    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    out = scanned(rows, benchmark, "text", **options)
    n_hit = F.aggregate("__hits.runs", F.lit(0).cast("long"), lambda a, r: a + r["last"] - r["first"])
    return out.select(F.col("id").alias(id_col), "__hits.n_words", n_hit.alias("n_hit"), "__hits.runs", "__hits.items")


def remove_hits(df: DataFrame, benchmark: DataFrame, text_col: str = "text", **options) -> DataFrame:
    """df with every run of hit words cut out of text_col, all other columns and characters as they were: word numbers are
    mapped back to offsets in the original text. Rows without a hit pass unchanged; a text that was all hit words keeps what
    stood around them. Rows keep all their columns, whatever they are called."""
    at, n = df.columns.index(text_col), len(df.columns)

    def run(batches):
        for b in batches:
            column = b.column(at)
            cleaned = [_without([(r["first"], r["last"]) for r in h["runs"]], t) for t, h in zip(column.to_pylist(), b.column(n).to_pylist())]
            yield pa.RecordBatch.from_arrays([*b.columns[:at], pa.array(cleaned, column.type), *b.columns[at + 1 : n]], schema=pa.schema(list(b.schema)[:n]))

    return scanned(df, benchmark, text_col, **options).mapInArrow(run, df.schema)


def drop_contaminated(df: DataFrame, benchmark: DataFrame, text_col: str = "text", **options) -> DataFrame:
    """df without the rows whose text holds a whole window of the benchmark. Null and wordless texts stay. All columns are kept."""
    out = scanned(df, benchmark, text_col, **options)
    return out.where(F.size("__hits.runs") == 0).select(*(F.col(f"`{c}`") for c in df.columns))


def _without(runs: list[tuple[int, int]], text: str | None) -> str | None:
    if not runs:
        return text
    raw = text.encode()
    places = [m.span() for m in _WORDS.finditer(raw)]
    kept, at = [], 0
    for a, z in runs:
        kept.append(raw[at : places[a][0]])
        at = places[z - 1][1]
    return b"".join([*kept, raw[at:]]).decode()


def op5_decontaminate(spark, sf_dir: str) -> DataFrame:
    """Every row of documents with its hits against the whole benchmark."""
    hits = find_hits(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return hits.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


SQL = r"""
WITH d AS (SELECT doc_id, row_number() OVER () AS r, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bw AS (SELECT DISTINCT item, least(10, len(w)) AS n, array_to_string(list_slice(w, i, i + least(10, len(w)) - 1), ' ') AS x
  FROM (SELECT *, unnest(range(1, greatest(1, len(w) - 9) + 1)) AS i FROM b WHERE len(w) > 0)),
dw AS (SELECT r, i, n, array_to_string(list_slice(w, i, i + n - 1), ' ') AS x
  FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM bw) WHERE len(w) >= n)),
h AS (SELECT r, i, dw.n, item FROM dw JOIN bw ON dw.n = bw.n AND dw.x = bw.x),
hit AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS p FROM h) GROUP BY r),
its AS (SELECT r, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS items FROM h GROUP BY r)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (r) LEFT JOIN its USING (r)
"""
