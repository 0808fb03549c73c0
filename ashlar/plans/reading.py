"""Queries of requests answered from recorded replies, of workbooks' cells and of platforms' pages, all made of the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ashlar.plans.registry import query
from ashlar.session import table
from ashlar.sources import listings, pages, replay, sheets
from ashlar.sources.sites import SITES
from ashlar.tables import spread


def _requests(spark, sf_dir):
    key = F.col("c_custkey")
    host = F.concat(F.lit("https://h"), (key % 9).cast("string"), F.lit(".test/"))
    return table(spark, sf_dir, "customer").select(key.alias("ordinal"), F.concat(host, F.lit("p"), key.cast("string")).alias("url"), F.concat(F.lit("h"), (key % 9).cast("string"), F.lit(".test")).alias("host"), host.alias("__site"))


@query("""
WITH r AS (SELECT c_custkey AS k, 'https://h' || c_custkey % 9 || '.test/' AS site, c_custkey % 9 AS h FROM customer),
x AS (SELECT *, CASE WHEN h = 8 AND k % 7 = 6 THEN 6 WHEN k % 7 = 6 THEN 0 ELSE k % 7 END AS kind FROM r),
s AS (SELECT h, min(k) AS stop FROM x WHERE kind = 6 GROUP BY 1), y AS (SELECT x.*, coalesce(k <= stop, true) AS made FROM x LEFT JOIN s USING (h))
SELECT k AS ordinal, CASE WHEN NOT made THEN 'skipped' WHEN kind IN (0, 1, 2) THEN 'ok' WHEN kind = 6 THEN 'blocked' ELSE 'failed' END AS outcome,
  CASE WHEN NOT made THEN 'blocked earlier' WHEN kind = 3 THEN 'HTTP 404' WHEN kind = 4 THEN 'redirect to another host' WHEN kind = 5 THEN 'HTTP 503' WHEN kind = 6 THEN 'HTTP 403' END AS reason,
  CASE WHEN NOT made THEN NULL WHEN kind = 1 THEN site || 'q' || k WHEN kind = 4 THEN 'https://other.test/' ELSE site || 'p' || k END AS final_url,
  CASE WHEN made AND kind IN (0, 1, 2) THEN sha256('page ' || k) END AS sha256, CASE WHEN NOT made THEN 0 WHEN kind IN (1, 2) THEN 2 WHEN kind = 5 THEN 3 ELSE 1 END AS calls FROM y
""")
def recorded_requests(spark, sf_dir):
    r = _requests(spark, sf_dir)
    key, none = F.col("ordinal"), F.lit(None).cast("string")
    kind = F.when((key % 9 == 8) & (key % 7 == 6), 6).when(key % 7 == 6, 0).otherwise(key % 7)
    body = F.concat(F.lit("page "), key.cast("string"))
    beside = F.concat(F.lit("q"), key.cast("string"))

    def reply(attempt: int, status: int, url=F.col("url"), location=none, text=none):
        return F.struct(url.alias("url"), F.lit(attempt).alias("attempt"), F.lit(status).alias("status"), location.alias("location"), text.alias("body"))

    got = (
        F.when(kind == 0, F.array(reply(1, 200, text=body))).when(kind == 1, F.array(reply(1, 302, location=beside), reply(1, 200, F.concat("__site", beside), text=body)))
        .when(kind == 2, F.array(reply(1, 500), reply(2, 200, text=body))).when(kind == 3, F.array(reply(1, 404))).when(kind == 4, F.array(reply(1, 301, location=F.lit("https://other.test/"))))
        .when(kind == 5, F.array(reply(1, 503), reply(2, 503), reply(3, 503))).otherwise(F.array(reply(1, 403)))
    )
    out = replay.fetch_recorded(r.select("ordinal", "url"), r.select(F.explode(got).alias("g")).select("g.*"))
    return out.select("ordinal", "outcome", "reason", "final_url", "sha256", "calls")


@query("SELECT c_custkey AS ordinal, 'h' || c_custkey % 9 || '.test' AS host, true AS kept FROM customer")
def paced_requests(spark, sf_dir):
    from pyspark.sql.window import Window

    p = replay.paced(_requests(spark, sf_dir).select("ordinal", "host"), {"h1.test": 8.0}, 4.0)
    gap = F.col("starts_at") - F.lag("starts_at").over(Window.partitionBy("host").orderBy("ordinal"))
    least = F.when(F.col("host") == "h1.test", 8.0).otherwise(4.0)
    return p.select("ordinal", "host", F.coalesce(gap.between(least - 1e-6, least * 1.25 + 1e-6), F.col("starts_at") == 0).alias("kept"))


@query("""
SELECT DATE '2026-01-01' AS as_of, CAST(999999 AS BIGINT) AS state_residents, r_name AS county, n_name AS name, CAST(n_nationkey * 100 + 2 AS BIGINT) AS residents FROM nation JOIN region ON n_regionkey = r_regionkey
UNION ALL SELECT DATE '2026-01-01', 999999, r_name, r_name, r_regionkey * 1000 + 2 FROM region WHERE r_name = 'ASIA'
""")
def workbook_residents(spark, sf_dir):
    """Regions stand for counties and nations for their cities, on sheets as workbooks have them."""
    def cell(sheet: str, number: int, row, col: int, text=None, value=None):
        as_ = lambda x, kind: (x if hasattr(x, "alias") else F.lit(x)).cast(kind)
        return F.struct(F.lit("f").alias("file"), F.lit(number).alias("sheet_no"), F.lit(sheet).alias("sheet"), as_(row, "int").alias("row"), F.lit(col).alias("col"), as_(text, "string").alias("text"), as_(value, "double").alias("number"))

    def line(sheet: str, number: int, row, name, value):
        return [cell(sheet, number, row, 0, name), cell(sheet, number, row, 1, None, value + 1), cell(sheet, number, row, 3, None, value + 2)]

    upper, lower = ("County 1", 1), ("City 1", 2)
    heads = [cell(*s, 2, col, f"Estimate 1/1/{year}") for s in (upper, lower) for col, year in ((1, 2025), (3, 2026))]
    fixed = [*heads, cell(*upper, 1, 0, "Residents"), *line(*upper, 3, "All", F.lit(999997)), *line(*lower, 3, "All", F.lit(999997))]
    r, n = F.col("r_regionkey"), F.col("n_nationkey")
    region = [*line(*upper, 10 + r, "r_name", r * 1000), *line(*lower, 100 * r + 10, "r_name", r * 1000), *line(*lower, 100 * r + 99, "Unincorporated", r)]
    region = [F.struct(x["file"], x["sheet_no"], x["sheet"], x["row"], x["col"], F.when(x["text"] == "r_name", F.col("r_name")).otherwise(x["text"]).alias("text"), x["number"]) for x in region]
    nation = line(*lower, 100 * F.col("n_regionkey") + 20 + n, F.concat(F.lit(" "), "n_name"), n * 100)
    parts = [spark.range(1).select(F.explode(F.array(*fixed)).alias("x")), table(spark, sf_dir, "region").select(F.explode(F.array(*region)).alias("x")), table(spark, sf_dir, "nation").select(F.explode(F.array(*nation)).alias("x"))]
    cells = parts[0].select("x.*").union(parts[1].select("x.*")).union(parts[2].select("x.*"))
    return sheets.population(cells, "County", "City", 2027, "All", ("ASIA",))


@query("""
SELECT p_partkey AS id, 'platform_1' AS platform, 'u' || p_partkey AS unit_key, 'unit' AS kind, p_partkey % 3 AS beds, (1000 + p_partkey)::DOUBLE AS base_min, (1010.5 + p_partkey)::DOUBLE AS total, '2026-01-0' || (p_partkey % 9 + 1) AS available_on FROM part WHERE p_partkey % 3 > 0
UNION ALL SELECT p_partkey, 'platform_2', CASE WHEN p_partkey % 4 = 3 THEN 'plan' ELSE 'v' || p_partkey END, CASE WHEN p_partkey % 4 = 3 THEN 'floorplan' ELSE 'unit' END, p_partkey % 4, (CASE WHEN p_partkey % 2 = 0 THEN 900 ELSE 1000 END + p_partkey)::DOUBLE,
  CASE WHEN p_partkey % 2 = 0 THEN (1000 + p_partkey)::DOUBLE END, '1970-01-02' FROM part
""")
def platform_units(spark, sf_dir):
    key = F.col("id")
    p = spread(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id")), ["id"])
    price = F.when(key % 3 > 0, F.struct(F.struct((key + 1000).alias("price"), (key + 1010.5).alias("totalPrice")).alias("prices")))
    day = F.concat(F.lit("2026-01-0"), (key % 9 + 1).cast("string"), F.lit("T00:00:00"))
    unit = F.struct(F.concat(F.lit("u"), key.cast("string")).alias("unitId"), (key % 3).alias("bedroomNumber"), price.alias("startingAtPricesUnfurnished"), day.alias("availableDateUnfurnished"))
    first = F.concat(F.lit("<script>Fusion.globalContent="), F.to_json(F.struct(F.lit("AVB-1").alias("communityId"), F.array(unit).alias("units"))), F.lit(";Fusion.x=1</script>"))
    fees = F.struct((key + 1000).alias("priceLow"), (key % 2 == 0).alias("pricingReflectFees"), F.struct((key + 900).alias("low_no_fees")).alias("adjusted"))
    rest = ((key % 4).alias("bedrooms"), fees.alias("price_entity"), F.lit(86_400).alias("available_date"))
    plan = F.array(F.struct(F.lit("plan").alias("id"), *rest))
    units = F.when(key % 4 < 3, F.array(F.struct(F.concat(F.lit("v"), key.cast("string")).alias("id_value"), *rest)))
    second = F.concat(F.lit('<script id="jd-fp-data-script-app">'), F.to_json(F.struct(plan.alias("floorplans"), units.alias("units"))), F.lit("</script>"))
    out = None
    for name, page in (("platform_1", first), ("platform_2", second)):
        read = pages.read_pages(p.withColumn("page", page), "id", "page", listings.LISTING, listings.read_listings(SITES[name]))
        rows = read.select("id", F.lit(name).alias("platform"), F.explode("units").alias("u")).select("id", "platform", "u.unit_key", "u.kind", "u.beds", "u.base_min", "u.total", "u.available_on")
        out = rows if out is None else out.union(rows)
    return out
