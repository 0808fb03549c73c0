"""Line dedup by overlapping windows of three lines. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ashlar.llm.common import cut, skew_join, table

LINES = 3


def line_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lines: int = LINES) -> DataFrame:
    """A row for each input row: id_col, kept_text, n_lines, n_removed, n_runs (maximal runs of removed lines).

    A window is `lines` consecutive lines of a text, split at line feeds; its key is the XXH64 and the Murmur3 hash of
    the lines and their lengths. Of the rows of a window, wherever they are, the first by (id, hash of the text, line number) stays; every
    line that a later one covers is removed, overlaps merged into runs, and the lines between the runs joined again.
    Texts of fewer lines have no window and stay whole. A window that repeats inside one text is a repeat too.

    Windows are counted before they are shuffled further, by map-side aggregation, and a very common window's rows are
    spread by skew_join. Only the numbers of covered lines are gathered for a text.

    A null text has no lines and stays null. Null ids come first in the order, as the smallest. Of rows that repeat with id
    and text one is the first; all windows of the others are repeats, so of those all lines go. Empty in, empty out.
    Other columns are not read.
    """
    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).withColumn("th", F.xxhash64(F.coalesce("text", F.lit(""))))
    split = rows.where(F.col("text").isNotNull()).select("id", "th", F.split("text", "\n", -1).alias("ls"))
    hashed = split.select("id", "th", F.transform("ls", lambda x: F.struct(F.xxhash64(x).alias("a"), F.hash(x, F.length(x)).alias("b"))).alias("hs")).where(F.size("hs") >= lines)
    last = F.size("hs") - lines
    pos = hashed.select("id", "th", "hs", F.explode(F.sequence(F.lit(0), last)).alias("pos"))
    parts = [F.col("hs")[F.col("pos") + i] for i in range(lines)]
    windows = pos.select("id", "th", "pos", F.xxhash64(*(p["a"] for p in parts)).alias("k"), F.hash(*(p["b"] for p in parts)).alias("k2"))
    windows = cut(windows)
    firsts = cut(windows.groupBy("k", "k2").agg(F.min(F.struct("id", "th", "pos")).alias("first"), F.count("*").alias("n")).where("n > 1"))
    total = firsts.agg(F.sum("n")).first()[0] or 0
    joined = skew_join(windows, firsts, ["k", "k2"], "n", total).where("n is not null")
    later = joined.where(~F.struct("id", "th", "pos").eqNullSafe(F.col("first"))).select("id", "th", "pos").distinct()

    order = Window.partitionBy("id", "th").orderBy("pos")
    starts = later.withColumn("new", (F.col("pos") - F.lag("pos", 1, -1000).over(order) > lines).cast("int"))
    runs = starts.withColumn("run", F.sum("new").over(order)).groupBy("id", "th", "run").agg(F.min("pos").alias("a"), (F.max("pos") + lines).alias("z"))
    runs = runs.groupBy("id", "th").agg(F.array_sort(F.collect_list(F.struct("a", "z"))).alias("runs"))
    copies = cut(rows.groupBy("id", "th").agg(F.count("*").alias("copies")).where("copies > 1"))
    known = runs.withColumn("copies", F.lit(None).cast("long")).unionByName(copies.withColumn("runs", F.lit(None).cast(runs.schema["runs"].dataType)))
    known = known.groupBy(F.col("id").alias("__id"), F.col("th").alias("__th")).agg(F.max("runs").alias("runs"), F.max("copies").alias("copies"))
    both = rows.join(known, F.col("id").eqNullSafe(F.col("__id")) & (F.col("th") == F.col("__th")), "left")
    out = both.where("copies is null").select("id", "text", "runs", F.lit(1).cast("long").alias("copy"))
    if not copies.isEmpty():
        one = both.where("copies is not null").groupBy("id", "th").agg(*(F.first(c).alias(c) for c in ("text", "runs", "copies")))
        out = out.unionByName(one.select("id", "text", "runs", F.explode(F.sequence(F.lit(1).cast("long"), "copies")).alias("copy")))

    ls = F.split("text", "\n", -1)
    n = F.when(F.col("text").isNull(), 0).otherwise(F.size(ls))
    whole = F.array(F.struct(F.lit(0).alias("a"), F.size(ls).alias("z")))
    out = out.withColumn("runs", F.when((F.col("copy") > 1) & (n >= lines), whole).otherwise(F.col("runs")))
    cuts = F.col("runs")
    gaps = F.filter(
        F.transform(F.sequence(F.lit(0), F.size(cuts)), lambda i: F.struct(
            F.when(i == 0, 0).otherwise(F.get(cuts, i - 1)["z"]).alias("a"),
            F.when(i == F.size(cuts), n).otherwise(F.get(cuts, i)["a"]).alias("z"))),
        lambda g: g["z"] > g["a"])
    kept = F.array_join(F.flatten(F.transform(gaps, lambda g: F.slice(F.col("ls"), g["a"] + 1, g["z"] - g["a"]))), "\n")
    removed = F.aggregate("runs", F.lit(0), lambda s, r: s + r["z"] - r["a"])
    return out.withColumn("ls", ls).select(
        F.col("id").alias(id_col),
        F.when(F.col("runs").isNull(), F.col("text")).otherwise(kept).alias("kept_text"),
        n.cast("long").alias("n_lines"),
        F.coalesce(removed, F.lit(0)).cast("long").alias("n_removed"),
        F.coalesce(F.size(F.when(F.col("runs").isNotNull(), F.col("runs"))), F.lit(0)).cast("long").alias("n_runs"),
    )


def op2_line_dedup(spark, sf_dir: str) -> DataFrame:
    """Every row of documents: its lines, how many were removed in how many runs, and a digest of those kept."""
    out = line_dedup(table(spark, sf_dir, "documents"))
    runs = F.greatest("n_runs", F.lit(0))
    return out.select("doc_id", "n_lines", "n_removed", runs.alias("n_runs"), F.sha2(F.coalesce("kept_text", F.lit("")), 256).alias("kept_sha256"))


SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, text, string_split(text, chr(10)) AS ls FROM documents),
p AS (SELECT r, doc_id, unnest(range(1, len(ls) - 1)) AS pos, ls FROM d WHERE len(ls) >= 3),
w AS (SELECT r, doc_id, pos, row_number() OVER (PARTITION BY ls[pos], ls[pos + 1], ls[pos + 2] ORDER BY doc_id, pos) AS k FROM p),
c AS (SELECT DISTINCT r, unnest(range(pos, pos + 3)) AS line FROM w WHERE k > 1),
l AS (SELECT r, unnest(ls) AS x, unnest(range(1, len(ls) + 1)) AS line FROM d),
m AS (SELECT l.r, l.line, l.x, c.line IS NOT NULL AS gone FROM l LEFT JOIN c ON c.r = l.r AND c.line = l.line),
g AS (SELECT *, gone AND NOT coalesce(lag(gone) OVER (PARTITION BY r ORDER BY line), false) AS starts FROM m),
a AS (SELECT r, count(*) AS n_lines, count(*) FILTER (gone) AS n_removed, count(*) FILTER (starts) AS n_runs, coalesce(string_agg(x, chr(10) ORDER BY line) FILTER (NOT gone), '') AS kept FROM g GROUP BY r)
SELECT doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(n_removed, 0) AS n_removed, coalesce(n_runs, 0) AS n_runs, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN a USING (r)
"""
