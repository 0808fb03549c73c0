"""Queries of what listings disclose, over documents made of the part table."""

from __future__ import annotations

from pyspark.sql import functions as F

from ashlar.plans.registry import query
from ashlar.plans.screening import pick
from ashlar.session import table
from ashlar.sources import disclosures
from ashlar.tables import spread


def _part(spark, sf_dir):
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), "p_brand")


@query("""
WITH p AS (SELECT p_partkey AS id, p_partkey % 900 + 100 AS n FROM part)
SELECT id, 0 AS pos, 'trash' AS fee_type, 'Trash $' || n || '/mo' AS description, n AS amount, '$' || n AS amount_text, true AS recurring, CAST(NULL AS BOOLEAN) AS mandatory FROM p WHERE id % 2 = 0
UNION ALL SELECT id, CASE WHEN id % 2 = 0 THEN 1 ELSE 0 END, 'deposit', 'Security deposit: $' || n, n, '$' || n, false, true FROM p
UNION ALL SELECT id, CASE WHEN id % 2 = 0 THEN 2 ELSE 1 END, 'one_time', 'Move-in fees: one of several kinds', NULL, 'one of several kinds', false, NULL FROM p WHERE id % 3 = 0
UNION ALL SELECT id, 1 + (id % 2 = 0)::INT + (id % 3 = 0)::INT, 'parking', 'Parking: garage ($' || n || ')', n, '$' || n, NULL, NULL FROM p WHERE id % 5 = 0
UNION ALL SELECT id, 1 + (id % 2 = 0)::INT + (id % 3 = 0)::INT + (id % 5 = 0)::INT, 'pet', 'Pet rent: $' || n || '/month (only if you have a pet)', n, '$' || n, true, false FROM p WHERE id % 7 = 0
""")
def listing_text_fees(spark, sf_dir):
    key = F.col("id")
    n = (key % 900 + 100).cast("int")
    text = n.cast("string")
    spot = F.struct(F.lit(" garage ").alias("comment"), n.alias("space_fee"))
    p = _part(spark, sf_dir).select("id", F.to_json(F.struct(
        F.when(key % 2 == 0, F.concat(F.lit("Trash $"), text, F.lit("/mo"))).alias("additional_fees_text"), F.concat(F.lit("$$"), text).alias("deposit_fee_text"), F.lit(" ").alias("application_fee_text"),
        F.when(key % 3 == 0, "one of several kinds").alias("move_in_fees_text"), F.when(key % 5 == 0, F.array(spot)).alias("parking"), F.struct(F.struct(F.when(key % 7 == 0, n).alias("rent")).alias("general")).alias("pet_policies"))).alias("doc"))
    return p.select("id", F.posexplode(disclosures.text_fees("doc")).alias("pos", "f")).select("id", "pos", "f.*")


@query("""
WITH p AS (SELECT p_partkey AS id, p_partkey % 900 + 100 AS n FROM part)
SELECT id, 'one_time' AS fee_type, 'Admin fee: $' || n AS description, n AS amount, false AS recurring, true AS mandatory FROM p
UNION ALL SELECT id, 'amenity', 'Amenity fee (Per Month): $50', 50, true, NULL FROM p WHERE id % 2 = 0
UNION ALL SELECT id, 'pet', 'Pet rent (Cats): $35/month (only if you have a pet)', 35, true, false FROM p WHERE id % 3 = 0
UNION ALL SELECT id, 'parking', 'Parking (type not stated), ask us', NULL, NULL, NULL FROM p WHERE id % 5 = 0
UNION ALL SELECT id, 'deposit', 'Security deposit (A1): $' || n, n, false, true FROM p UNION ALL SELECT id, 'deposit', 'Security deposit (unit 7): $500', 500, false, true FROM p WHERE id % 4 = 0
""")
def listing_nested_fees(spark, sf_dir):
    key = F.col("id")
    n = (key % 900 + 100).cast("double")
    pet = F.struct(F.lit(" Cats ").alias("label"), F.lit(35.0).alias("additionalRent"))
    plan = F.struct(F.lit("A1").alias("name"), n.alias("deposit"), F.when(key % 4 == 0, F.array(F.struct(F.lit("7").alias("unitId"), F.lit(500.0).alias("deposit")))).alias("units"))
    p = _part(spark, sf_dir).select("id", F.to_json(F.struct(
        F.struct(n.alias("adminFee"), F.when(key % 2 == 0, F.struct(F.lit(50.0).alias("fee"), F.lit("Per Month").alias("feeType"))).alias("amenity")).alias("fees"), F.when(key % 3 == 0, F.array(pet, pet)).alias("petPolicies"),
        F.when(key % 5 == 0, F.array(F.struct(F.lit("ask  us").alias("comments")))).alias("parking"), F.array(plan).alias("floorPlans"))).alias("doc"))
    return p.select("id", F.explode(disclosures.nested_fees("doc")).alias("f")).select("id", "f.fee_type", "f.description", "f.amount", "f.recurring", "f.mandatory")


@query("""
SELECT p_partkey AS id, ['Six weeks free', '', 'Base rent $100 off', 'New gym', 'Prices include a $500 gift', 'Total monthly price, discounted', '', 'Prices include savings'][p_partkey % 8 + 1] AS promotions, ['', 'Prices include required fees', '', '', '', '', 'Pricing is subject to change', ''][p_partkey % 8 + 1] AS disclosures,
  CASE p_partkey % 3 WHEN 0 THEN 'Zillow Group' END AS network, p_partkey % 3 > 0 AS independent, concat_ws('; ', CASE p_partkey % 3 WHEN 0 THEN 'tplsource: Zillow' WHEN 1 THEN 'tplsource: other' END, CASE WHEN p_partkey % 2 = 0 THEN 'feed: x' END) AS signals FROM part
""")
def listing_deals(spark, sf_dir):
    key = F.col("id")
    doc = F.to_json(F.struct(pick(("Zillow", "other", None), key).alias("tplsource"), F.struct(F.when(key % 2 == 0, "x").alias("feed")).alias("mlsInfo")))
    deal = pick(("Six  weeks free", "Prices include required fees", "Base rent $100 off", "New gym", "Prices include a $500 gift", "Total monthly price, discounted", "Pricing is subject to change", "Prices include savings"), key)
    p = _part(spark, sf_dir).select("id", disclosures.split_deals(F.array(deal, F.lit(" "), deal)).alias("d"), disclosures.feed_provenance(doc).alias("f"))
    return p.select("id", F.array_join("d.promotions", "; ").alias("promotions"), F.array_join("d.disclosures", "; ").alias("disclosures"), "f.network", "f.independent", F.array_join("f.signals", "; ").alias("signals"))


@query("""
SELECT p_partkey AS id, CASE p_partkey % 4 WHEN 0 THEN 'a={"x":' || p_partkey || '}' WHEN 1 THEN 'b=[1]' ELSE '' END AS bodies FROM part
""")
def cached_bodies(spark, sf_dir):
    key = F.col("id")
    body = F.when(key % 4 == 0, F.create_map(F.lit("a"), F.concat(F.lit('{}&&{"x":'), key.cast("string"), F.lit("}")))).when(key % 4 == 1, F.create_map(F.lit("b"), F.lit("[1]"))).when(key % 4 == 2, F.create_map(F.lit("c"), F.lit("{}&&{bad"))).otherwise(F.create_map(F.lit("d"), F.lit("")))
    p = _part(spark, sf_dir).select("id", disclosures.cached_bodies(F.to_json(body)).alias("m"))
    return p.select("id", F.array_join(F.transform(F.map_entries("m"), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ",").alias("bodies"))


@query("""
SELECT l_orderkey, type_id, CASE WHEN NOT t THEN price END AS base, CASE WHEN t THEN price::DOUBLE END AS total FROM (SELECT l_orderkey, l_partkey % 3 AS type_id, l_orderkey % 2 = 0 AS t, CAST(floor(l_extendedprice) AS BIGINT) AS price,
  row_number() OVER (PARTITION BY l_orderkey, l_partkey % 3 ORDER BY l_linenumber, floor(l_extendedprice)) AS rn FROM lineitem) WHERE rn = 1
""")
def listing_unit_types(spark, sf_dir):
    key = F.col("l_orderkey")
    g = table(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_linenumber").alias("ordinal"), (F.col("l_partkey") % 3).alias("type_id"), F.floor("l_extendedprice").alias("price"), (key % 2 == 0).alias("total_only"))
    return disclosures.unit_types(g, "l_orderkey", "total_only")


@query("""
SELECT id, beds, price FROM (SELECT p_partkey AS id, unnest(range(0, 2)) AS beds, 1500 + p_partkey % 300 AS price FROM part WHERE p_partkey % 3 = 0)
UNION ALL SELECT id, beds, price FROM (SELECT p_partkey AS id, unnest(range(1, p_partkey % 4 + 2)) AS beds, 1400 AS price FROM part WHERE p_partkey % 3 = 1)
""")
def stub_prices(spark, sf_dir):
    key = F.col("id")
    price = (1500 + key % 300).cast("int")
    given = F.when(key % 3 == 0, F.create_map(F.lit(0), price, F.lit(1), price, F.lit(2), F.lit(0)))
    p = _part(spark, sf_dir).select("id", given.alias("m"), F.when(key % 3 == 1, 1400).alias("low"), F.lit(1).alias("a"), (key % 4 + 1).cast("int").alias("z"))
    return p.select("id", F.explode(disclosures.stub_prices("m", "low", "a", "z")).alias("beds", "price"))


@query("""
SELECT p_partkey AS id, 'The published total monthly price adds these required monthly charges to base rent, at their minimum amounts: Trash ($' || p_partkey % 50 + 1 || '); Pets ($10; applies only to residents with pets).' AS text FROM part WHERE p_partkey % 2 = 0
""")
def total_compositions(spark, sf_dir):
    p, key = _part(spark, sf_dir), F.col("id")
    trash = (key % 50 + 1).cast("double")

    def rows(names: tuple[str, ...], *values):
        return F.explode(F.array(*(F.struct(*((v if hasattr(v, "alias") else F.lit(v)).alias(n) for n, v in zip(names, row))) for row in values)))

    units = p.select("id", rows(("unit", "ordinal", "extra"), ("u1", 1, 0.0), ("u2", 2, trash + 10 + key % 2), ("u3", 3, 5.0)).alias("u")).select("id", "u.*")
    shown = F.concat(F.lit("$"), (key % 50 + 1).cast("string"))
    amounts = p.select("id", F.lit("u2").alias("unit"), rows(("expense", "least", "shown"), ("1", trash, shown), ("2", 10.0, "$10"), ("3", 99.0, "$99")).alias("x")).select("id", "unit", "x.*")
    kinds = rows(("expense", "label", "frequency", "required", "category"), ("1", "Trash", "month", True, "utilities"), ("2", "Pets", "month", True, "pets"), ("3", "Gym", "month", False, "other"))
    definitions = p.select("id", kinds.alias("d")).select("id", "d.*")
    return disclosures.total_composition(units, amounts, definitions, "id")


#: A listing's costs: each of the calculator's sections for some parts, with one amount, a span, or a text; sections of the page's own, with titles that tell their kind; items that are none.
_COSTS = """concat('{"rentalCostsAndFees":{"costAndFeeCalculator":{"fees":{"monthlyRequiredFees":[{"fee":{"displayValue":" Trash ","min":', p_size, ',"max":', p_size + p_partkey % 2, ',"amount":{"value":9}}},7,{"fee":{"displayValue":"Base Rent","min":1}},{"fee":null}],',
'"oneTimeRequiredFees":', CASE WHEN p_partkey % 3 = 0 THEN concat('[{"fee":{"displayValue":"Security Deposit","amount":{"value":"', p_partkey % 900, '"}}}]') ELSE '"none"' END,
',"oneTimeOptionalFees":[{"fee":{"displayValue":"', p_brand, '","amount":{"displayText":" ', CASE WHEN p_partkey % 2 = 0 THEN '$1,250.50 ' ELSE 'from $5 up' END, '"}}}]}},',
'"rentalFeeSections":[{"sectionTitle":"', CASE p_partkey % 3 WHEN 0 THEN 'Required Monthly' WHEN 1 THEN 'Optional one-time costs' ELSE '' END, '","rentalFees":[{"title":"Parking","formattedValue":"$', p_partkey % 500 + 1, '"},{"title":" ","formattedValue":"$3"},{"title":"Storage","formattedValue":"ask"}]},{"rentalFees":{}}]}}')"""


@query(f"""
WITH p AS (SELECT p_partkey AS id, p_size AS s, p_brand AS b, ({_COSTS})::JSON->'$.rentalCostsAndFees' AS j FROM part),
c AS (SELECT id, n, o, json_extract(j, '$.costAndFeeCalculator.fees.' || n || '[' || k || '].fee') AS f, o * 100 + k AS pos FROM
  (SELECT *, unnest(range(CASE WHEN json_type(j, '$.costAndFeeCalculator.fees.' || n) = 'ARRAY' THEN json_array_length(j, '$.costAndFeeCalculator.fees.' || n)::BIGINT ELSE 0 END)) AS k
   FROM p, (VALUES ('monthlyRequiredFees', 0), ('oneTimeRequiredFees', 1), ('monthlyOptionalFees', 2), ('oneTimeOptionalFees', 3)) x(n, o))),
v AS (SELECT id, pos, o, trim(f->>'$.displayValue') AS name, nullif(trim(f->>'$.amount.displayText'), '') AS said, coalesce((f->>'$.min')::BIGINT, (f->>'$.amount.value')::BIGINT) AS low, coalesce((f->>'$.max')::BIGINT, (f->>'$.min')::BIGINT, (f->>'$.amount.value')::BIGINT) AS high FROM c),
u AS (SELECT id, pos, name, said, low, high, o IN (0, 2) AS recurring, o < 2 AS mandatory, ['required monthly fee', 'required one-time fee', 'optional monthly fee', 'optional one-time fee'][o + 1] AS section FROM v
  UNION ALL SELECT id, 1000 + k, trim(x->>'$.title'), nullif(trim(x->>'$.formattedValue'), ''), NULL, NULL, CASE WHEN contains(t, 'monthly') THEN true WHEN contains(t, 'one-time') THEN false END, CASE WHEN contains(t, 'required') THEN true WHEN contains(t, 'optional') THEN false END, coalesce(nullif(t, ''), 'fee')
  FROM (SELECT id, k, lower(j->>'$.rentalFeeSections[0].sectionTitle') AS t, json_extract(j, '$.rentalFeeSections[0].rentalFees[' || k || ']') AS x FROM (SELECT *, unnest(range(3)) AS k FROM p))),
w AS (SELECT *, regexp_extract(said, '^\$([0-9,.]+)$', 1) AS m FROM u WHERE name <> '' AND lower(name) <> 'base rent'),
z AS (SELECT *, CASE WHEN low IS NOT NULL THEN CASE WHEN low = high THEN low END WHEN m <> '' THEN round_even(replace(m, ',', '')::DOUBLE, 0)::BIGINT END AS amount,
  CASE WHEN low = high THEN '$' || low WHEN low IS NOT NULL THEN '$' || low || '–$' || high WHEN contains(said, '$') THEN said END AS amount_text FROM w)
SELECT id, row_number() OVER (PARTITION BY id ORDER BY pos) - 1 AS pos, CASE WHEN recurring = false THEN CASE WHEN contains(lower(name), 'deposit') THEN 'deposit' ELSE 'one_time' END WHEN name = 'Trash' THEN 'trash' WHEN name = 'Parking' THEN 'parking' WHEN name = 'Storage' THEN 'storage' ELSE 'other' END AS fee_type,
  name || ' (' || section || '): ' || coalesce(amount_text, said, 'amount not stated') AS description, amount, amount_text, recurring, mandatory FROM z
""")
def listing_calculator_fees(spark, sf_dir):
    p = spread(table(spark, sf_dir, "part").select("p_partkey", "p_size", "p_brand"), ["p_partkey"]).select(F.col("p_partkey").alias("id"), F.expr(_COSTS).alias("doc"))
    return p.select("id", F.posexplode(disclosures.calculator_fees("doc")).alias("pos", "f")).select("id", "pos", "f.*")
