"""What is shown: evidence items, cards, claims in order, map points, routes, runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ashlar.functions.scalars import age_label
from ashlar.operators.scoring import CATEGORY_WEIGHTS
from ashlar.tables import dealt, tasks_for


def source_names(df: DataFrame, sources: DataFrame, source: str = "source_id", out: str = "source_name") -> DataFrame:
    """df with its sources' names: the id where a name is unknown, and a plain text where there is no id."""
    s = sources.select(F.col("id").alias("__id"), F.col("name").alias("__name"))
    return df.join(s, F.col(source) == F.col("__id"), "left").withColumn(out, F.coalesce("__name", source, F.lit("Unknown source"))).drop("__id", "__name")


def evidence_items(df: DataFrame, now: Column) -> DataFrame:
    """Evidence as items; rating, reviewer and age of reviews alone."""
    review = F.col("kind") == "review"
    return df.select("id", "kind", "source_name", "content", *(F.when(review, F.col(x)).alias(x) for x in ("rating", "reviewer")), F.when(review, age_label("published", now)).alias("age"))


def assessment_cards(entities: DataFrame, assessments: DataFrame, entity: str) -> DataFrame:
    """One row for each entity and category, in order; those not evaluated say so."""
    cats = F.explode(F.array(*(F.struct(F.lit(k).alias("ordinal"), F.lit(c).alias("category")) for k, c in enumerate(CATEGORY_WEIGHTS))))
    all_ = entities.select(entity, cats.alias("c")).select(entity, "c.*")
    return all_.join(assessments, [entity, "category"], "left").withColumn("confidence", F.coalesce("confidence", F.lit("insufficient"))).withColumn("summary", F.coalesce("summary", F.lit("Not evaluated yet.")))


def claim_order() -> list[Column]:
    """Current ones first, then negative, positive and neutral, by weight, theme and text."""
    rank = F.when(F.col("polarity") == "negative", 0).when(F.col("polarity") == "positive", 1).otherwise(2)
    return [F.desc("is_current"), rank.asc(), F.desc("weight"), F.asc("theme"), F.asc("text")]


def highlights(claims: DataFrame, entity: str) -> DataFrame:
    """Per entity: its strongest current claim for and against; ties by category, then claim."""
    rank = lambda p: F.min_by("text", F.when(F.col("is_current") & (F.col("polarity") == p), F.struct(-F.col("weight"), F.col("ordinal"), F.col("claim_id"))))
    return claims.groupBy(entity).agg(rank("positive").alias("best"), rank("negative").alias("worst"))


def evidence_index(*parts: DataFrame) -> DataFrame:
    """The union of evidence lists by id; of one id the row of the last list stays."""
    all_ = None
    for k, p in enumerate(parts):
        p = p.withColumn("__part", F.lit(k))
        all_ = p if all_ is None else all_.unionByName(p, allowMissingColumns=True)
    all_ = dealt(all_, ["id"], tasks_for(all_.count(), all_.sparkSession))
    rest = [c for c in all_.columns if c not in ("__part", "id")]
    w = Window.partitionBy("id").orderBy(F.desc("__part"), *(F.to_json(F.struct(c)) for c in rest))  # by their content, whatever their types are
    return all_.withColumn("__rn", F.row_number().over(w)).where("__rn = 1").drop("__rn", "__part")


def resolve_ids(refs: DataFrame, index: DataFrame) -> tuple[DataFrame, DataFrame]:
    """References with their evidence, and those without any."""
    refs = dealt(refs, ["id"], tasks_for(refs.count(), refs.sparkSession))
    return refs.join(index, "id"), refs.join(index.select("id"), "id", "left_anti")


def map_points(df: DataFrame) -> DataFrame:
    """Rows with coordinates, labelled by total, else base price."""
    price = F.coalesce(F.col("total").cast("double"), F.col("base").cast("double"))
    return df.where("lat is not null and lon is not null").select("id", "lat", "lon", F.coalesce(F.concat(F.lit("$"), F.format_number(price, 0)), F.lit("N/A")).alias("label"))


def theme_counts(counts: Column) -> Column:
    """Entries of a map of counts that are positive, the largest first."""
    entries = F.filter(F.map_entries(counts), lambda e: e["value"] > 0)
    return F.transform(F.array_sort(F.transform(entries, lambda e: F.struct((-e["value"]).alias("n"), e["key"].alias("theme")))), lambda e: F.struct(e["theme"].alias("theme"), (-e["n"]).alias("n")))


def panel_state(configured: bool, checked: Column, error: Column, matched: Column) -> Column:
    """not_configured, not_checked, error, no_match or ok."""
    if not configured:
        return F.lit("not_configured")
    yes = lambda x: F.coalesce(x, F.lit(False))
    return F.when(~yes(checked), "not_checked").when(yes(error), "error").when(~yes(matched), "no_match").otherwise("ok")


def parse_route_table(df: DataFrame, key: str, payload: str, most_snap: float = 300.0) -> DataFrame:
    """Rows of a routing table's answer (JSON): origin number, seconds, meters, status. No route: insufficient; an origin moved by over 300 m: low."""
    kind = "struct<code:string,durations:array<array<double>>,distances:array<array<double>>,sources:array<struct<distance:double,location:array<double>>>>"
    j = df.select(key, F.from_json(payload, kind).alias("p"))
    n = j.select(key, F.posexplode(F.arrays_zip(F.col("p.durations"), F.col("p.distances"), F.col("p.sources"))).alias("origin", "r"))
    s, m, snap = F.get(F.col("r.durations"), 0), F.get(F.col("r.distances"), 0), F.col("r.sources.distance")
    status = F.when(s.isNull() | m.isNull(), "insufficient").when(snap > most_snap, "low").otherwise("ok")
    return n.select(key, "origin", s.alias("seconds"), m.alias("meters"), status.alias("status"))


def stop_after_fatal(df: DataFrame, group: list[str], order: list[Column], fatal: Column) -> DataFrame:
    """Rows of a batch with `skipped`: whether a fatal one came before."""
    w = Window.partitionBy(*group).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumn("skipped", F.coalesce(F.max(fatal).over(w), F.lit(False)))


def run_summary(log: DataFrame) -> DataFrame:
    """Per run: counters, notes in order, and its status: failed if it says so, else done."""
    counts = log.where("counter is not null").groupBy("run_id", "counter").agg(F.sum("n").alias("n")).groupBy("run_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("counter", "n")))).alias("stats"))
    notes = log.groupBy("run_id").agg(F.array_distinct(F.transform(F.array_sort(F.collect_list(F.when(F.col("note").isNotNull(), F.struct("seq", "note")))), lambda x: x["note"])).alias("notes"), F.max("failed").alias("failed"))
    return notes.join(counts, "run_id", "left").select("run_id", "stats", "notes", F.when(F.col("failed"), "failed").otherwise("done").alias("status"))


def served_json(df: DataFrame, key: str) -> DataFrame:
    """key and a JSON document of each row, unknown values written as null: what an endpoint would answer with."""
    return df.select(key, F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}).alias("document"))
