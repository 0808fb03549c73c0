"""Audit of claims against the evidence they cite."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Kinds of evidence that some categories ask for.
CATEGORY_KINDS = {"commute": ("commute_fact",), "neighborhood_safety": ("safety_fact", "review")}


def supports(kind, categories, category) -> Column:
    """Whether evidence can support a category: its kind must be allowed, and a review must be of the category."""
    listed = F.array_contains(categories, category)
    kinds = F.element_at(F.create_map(*(x for k, v in CATEGORY_KINDS.items() for x in (F.lit(k), F.array(*map(F.lit, v))))), category)
    return F.when(kinds.isNotNull() & ~F.array_contains(kinds, kind), False).when(kind == "review", listed).otherwise(kinds.isNotNull() | listed)


def classify_references(refs: DataFrame, evidence: DataFrame, evidence_id: str, owner: str, fits: Column) -> DataFrame:
    """Adds `verdict` to references (with `owner`): missing, wrong_owner, unsupported or valid. Evidence has evidence_id, `__owner`, and what `fits` reads."""
    j = refs.join(evidence, evidence_id, "left")
    verdict = F.when(F.col("__owner").isNull(), "missing").when(F.col("__owner") != F.col(owner), "wrong_owner").when(~F.coalesce(fits, F.lit(False)), "unsupported").otherwise("valid")
    return j.withColumn("verdict", verdict)


def audit_claims(refs: DataFrame, claim: list[str], published: str, now: Column, days: int = 730) -> DataFrame:
    """Per claim, from classified references: counts by verdict; kept if one is valid; `qualified` if all valid ones are known to be older than `days`."""
    ok = F.col("verdict") == "valid"
    old = F.timestamp_diff("SECOND", F.col(published), now) > days * 86400
    g = refs.groupBy(*claim).agg(
        F.count_if(F.col("verdict") == "missing").alias("missing"), F.count_if(F.col("verdict") == "wrong_owner").alias("wrong_owner"),
        F.count_if(F.col("verdict") == "unsupported").alias("unsupported"), F.count_if(ok).alias("valid"), F.count_if(ok & F.coalesce(old, F.lit(False))).alias("__old"),
    )
    return g.withColumn("kept", F.col("valid") > 0).withColumn("qualified", (F.col("valid") > 0) & (F.col("__old") == F.col("valid"))).drop("__old")
