"""Exact dedup by progressive refinement: length, then prefix hash, then full hash. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ashlar.llm.common import ascii_lower, cut, skew_join, table

PREFIX_CHARS = 128
#: Lengths below this that repeat are listed, in at most so many rows; longer texts all go on to the second pass.
LISTED_LENGTHS = 1 << 20


def exact_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", prefix_chars: int = PREFIX_CHARS, digest: bool = False) -> DataFrame:
    """Groups of equal texts (A-Z lower-cased); of each group the row with the largest id stays.

    Returns a row for each input row: id_col, keep_id, group_size, kept; with `digest` also full_hash (binary
    SHA-256 of the normalised text of every row, else it is null where no other row has the length and the prefix).

    Three passes, each over what the one before left: counts by byte length; counts by (length, hash of the first
    prefix_chars characters) of rows whose length repeats, no other row's prefix is hashed; SHA-256 of the full text of rows whose (length, prefix) pair
    repeats. The first two read and shuffle numbers alone. Equal means an equal length, prefix hash and SHA-256.
    With `digest` the hash of every other row is computed too, as a column that no pass looks at, and the 32 bytes are shuffled in place of the text.

    Nulls count as empty texts. A null id never wins against another id; a group of null ids keeps null. Rows that repeat with
    their id are all in the group, and all rows with keep_id as id are `kept`. An empty table gives an empty result.
    Other columns are not read, so their names cannot clash.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = df.select(F.col(id_col).alias("id"), text.alias("text"), F.octet_length(text).alias("n"))
    repeated = cut(rows.groupBy("n").agg(F.count("*").alias("many")).where(f"many > 1 and n < {LISTED_LENGTHS}").select("n", F.lit(True).alias("again")))
    # At most LISTED_LENGTHS numbers, whatever the input, so rows meet them where they are and no text moves.
    rows = rows.join(F.broadcast(repeated), "n", "left").withColumn("goes_on", F.coalesce("again", F.col("n") >= LISTED_LENGTHS))
    prefix = F.xxhash64(ascii_lower(F.substring("text", 1, prefix_chars)))
    rows = rows.select("id", "text", "n", F.when(F.col("goes_on"), prefix).alias("ph"))
    by_prefix = cut(rows.where("ph is not null").groupBy("n", "ph").agg(F.count("*").alias("rows")).where("rows > 1"))
    total = by_prefix.agg(F.sum("rows")).first()[0] or 0

    full = F.unhex(F.sha2(ascii_lower(F.col("text")), 256))
    if digest:
        rows = rows.select("id", "n", "ph", full.alias("full_hash"))
        left = cut(skew_join(rows, by_prefix, ["n", "ph"], "rows", total))
    else:
        left = skew_join(rows, by_prefix, ["n", "ph"], "rows", total)
        left = cut(left.select("id", "n", "ph", F.when(F.col("rows").isNotNull(), full).alias("full_hash"), "rows"))
    groups = left.where(F.col("rows").isNotNull()).groupBy("n", "ph", "full_hash").agg(F.max("id").alias("keep"), F.count("*").alias("size"))
    out = skew_join(left.drop("rows"), groups.where("size > 1"), ["n", "ph", "full_hash"], "size", total)
    keep = F.when(F.col("size").isNull(), F.col("id")).otherwise(F.col("keep"))
    return out.select(
        F.col("id").alias(id_col),
        keep.alias("keep_id"),
        F.coalesce("size", F.lit(1)).cast("long").alias("group_size"),
        F.col("id").eqNullSafe(keep).alias("kept"),
        "full_hash",
    )


def op7_exact_dedup(spark, sf_dir: str) -> DataFrame:
    """Every row of documents with the row that stays in its place."""
    out = exact_dedup(table(spark, sf_dir, "documents"), digest=True)
    return out.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("full_hash")).alias("text_sha256"))


SQL = """
WITH t AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS x FROM documents)
SELECT doc_id, max(doc_id) OVER (PARTITION BY x) AS keep_id, count(*) OVER (PARTITION BY x) AS group_size,
  doc_id = max(doc_id) OVER (PARTITION BY x) AS kept, sha256(x) AS text_sha256
FROM t
"""
