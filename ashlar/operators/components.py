"""Connected components over tables of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ashlar.tables import apart, cut, discard, skew_join

MOST_ROUNDS = 60


def _lowest(both: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Edges (u, v) with m, the smallest of u and of what it is linked to; and the written table that this reads. A node with very many edges is no one task's."""
    mins = cut(both.groupBy("u").agg(F.min("v").alias("low"), F.count("*").alias("n")))
    total = mins.agg(F.sum("n")).first()[0] or 0
    out = skew_join(both, mins, ["u"], "n", total)
    return out.select("u", "v", F.least("u", "low").alias("m")), mins


def components(edges: DataFrame) -> DataFrame:
    """node, root: for each end of an edge (u, v), the smallest node of its component. Self-edges and repeats are allowed.

    Alternating large and small stars: in each round every node is linked to the smallest node it knows of, first by its
    larger neighbours, then by its smaller ones; rounds grow with the logarithm of a component's width. Each round's edges
    are written to the shared folder, so lineage stays short. No component is gathered anywhere.
    """
    now = cut(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    ends = edges.select(F.col("u").alias("node")).union(edges.select("v")).distinct()
    seen = None
    for _ in range(MOST_ROUNDS):
        both, by_large = _lowest(now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v"))))
        large = cut(both.where("v > u and v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
        down, by_small = _lowest(large)
        down = down.where("u <> v")
        small = down.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(down.where("u <> m").select("u", F.col("m").alias("v")))
        old, now = now, cut(small.distinct())
        discard(old, large, by_large, by_small)
        sums = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.bit_xor(F.xxhash64("u", "v", F.lit(1)))).first()
        if sums == seen:
            break
        seen = sums
    else:
        raise RuntimeError("components did not settle")
    return ends.join(apart(now.select(F.col("u").alias("node"), F.col("v").alias("root")), sums[0]), "node", "left").select("node", F.coalesce("root", "node").alias("root"))
