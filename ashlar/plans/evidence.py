"""Queries of assessments, their audit and storage, of what a run writes, and of themes in whole texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ashlar.functions import scalars as S
from ashlar.operators import assessments, cards, writes
from ashlar.operators.scoring import CATEGORY_WEIGHTS
from ashlar.plans.matching import FEES, FEES_SQL, REVIEWS, mined
from ashlar.plans.matching import STATED_SQL as STATED_TEXTS_SQL
from ashlar.plans.pricing import NOW, now
from ashlar.plans.registry import query
from ashlar.plans.screening import NOTE_SQL, pick
from ashlar.session import table

#: Reviews are orders, properties their customers by 300; each review mentions two of these.
STATED = (
    ("noise", "quiet", "positive"), ("noise", "thin_walls", "negative"), ("noise", "train", "negative"), ("management", "helpful_staff", "positive"), ("management", "maintenance", "negative"), ("pests", "cockroaches", "negative"),
    ("pests", "no_pests", "positive"), ("building_safety", "package_theft", "negative"), ("building_safety", "secure_building", "positive"), ("other_issues", "parking", "negative"), ("other_issues", "mold", "negative"),
    ("management", "management_change", "neutral"),
)
_STATED_SQL = ", ".join(f"{{'c': '{c}', 't': '{t}', 'p': '{p}'}}" for c, t, p in STATED)
_AGE = f"greatest(0, date_diff('second', published, TIMESTAMP '{NOW}')) / 86400 / 365.25"

REVIEWS_SQL = f"""
rv AS (SELECT o_custkey % 300 AS property, o_orderkey AS review, 's' || o_orderkey % 3 AS source, CASE WHEN o_orderkey % 11 > 0 THEN o_orderdate END AS published FROM orders),
m AS (SELECT DISTINCT review, s.c AS category, s.t AS theme, s.p AS polarity FROM (SELECT o_orderkey AS review, unnest([l[o_orderkey % 12 + 1], l[(o_orderkey * 7 + 3) % 12 + 1]]) AS s FROM (SELECT o_orderkey, [{_STATED_SQL}] AS l FROM orders))),
pt AS (SELECT review, category, avg(raw) AS raw FROM (SELECT o_orderkey AS review, 'noise' AS category, 1.0 + o_orderkey % 5 AS raw FROM orders WHERE o_orderkey % 4 = 0
  UNION ALL SELECT o_orderkey, 'management', 1.0 + o_orderkey % 6 FROM orders WHERE o_orderkey % 5 = 0 UNION ALL SELECT o_orderkey, 'management', 0.0 + o_orderkey % 7 FROM orders WHERE o_orderkey % 6 = 0) WHERE raw BETWEEN 1 AND 5 GROUP BY 1, 2),
ch AS (SELECT property, min(published) AS changed FROM m JOIN rv USING (review) WHERE theme = 'management_change' GROUP BY 1),
i0 AS (SELECT review, category, theme, polarity, CASE WHEN polarity = 'positive' THEN 1.0 ELSE -1.0 END AS value, coalesce(map {{'cockroaches': 1.8, 'package_theft': 1.3, 'rodents': 1.6}}[theme], 1.0) AS severity, NULL AS raw FROM m WHERE polarity <> 'neutral'
  UNION ALL SELECT review, category, 'subscore', CASE WHEN raw > 3 THEN 'positive' WHEN raw < 3 THEN 'negative' ELSE 'neutral' END, (raw - 3) / 2, 1.0, raw FROM pt),
it AS (SELECT *, published IS NOT NULL AND {_AGE} <= 2 AS new, published IS NOT NULL AND {_AGE} > 4 AS old, CASE WHEN published IS NULL THEN 0.3 WHEN {_AGE} <= 2 THEN 1.0 WHEN {_AGE} <= 4 THEN 0.6 WHEN {_AGE} <= 7 THEN 0.3 ELSE 0.15 END
  * CASE WHEN category = 'management' AND published < changed THEN 0.5 ELSE 1.0 END AS w FROM i0 JOIN rv USING (review) LEFT JOIN ch USING (property))
"""


def _reviews(spark, sf_dir):
    key = F.col("o_orderkey")
    parts = F.map_filter(F.create_map(F.lit("noise"), F.when(key % 4 == 0, 1.0 + key % 5), F.lit("maintenance"), F.when(key % 5 == 0, 1.0 + key % 6), F.lit("management"), F.when(key % 6 == 0, 0.0 + key % 7), F.lit("charm"), F.lit(5.0)), lambda k, v: v.isNotNull())
    return table(spark, sf_dir, "orders").select((F.col("o_custkey") % 300).alias("property"), key.alias("review"), F.concat(F.lit("s"), (key % 3).cast("string")).alias("source"), F.when(key % 11 > 0, F.col("o_orderdate")).alias("published"), parts.alias("parts"))


def _mentions(spark, sf_dir):
    key = F.col("o_orderkey")
    said = F.array(*(F.struct(F.lit(c).alias("category"), F.lit(t).alias("theme"), F.lit(p).alias("polarity")) for c, t, p in STATED))
    two = F.array(F.element_at(said, (key % 12 + 1).cast("int")), F.element_at(said, ((key * 7 + 3) % 12 + 1).cast("int")))
    return table(spark, sf_dir, "orders").select(key.alias("review"), F.explode(two).alias("s")).select("review", "s.*")


def _items(spark, sf_dir):
    return assessments.scored_items(_mentions(spark, sf_dir), _reviews(spark, sf_dir), now())


@query(f"WITH {REVIEWS_SQL} SELECT property, category, theme, polarity, count(*) AS n, round(sum(w)::DOUBLE, 4) AS weight, round(sum(w * severity * value)::DOUBLE, 4) AS pull, round(avg(raw)::DOUBLE, 4) AS raw FROM it GROUP BY 1, 2, 3, 4")
def scored_items(spark, sf_dir):
    g = _items(spark, sf_dir).groupBy("property", "category", "theme", "polarity")
    return g.agg(F.count("*").alias("n"), F.round(F.sum("weight"), 4).alias("weight"), F.round(F.sum(F.col("influence") * F.col("value")), 4).alias("pull"), F.round(F.avg("raw"), 4).alias("raw"))


EVALUATION_SQL = f"""
{REVIEWS_SQL}, per AS (SELECT property, category, review, max(source) AS source, bool_or(new) AS new, sum(w * severity)::DOUBLE AS i, sum(w * severity * value)::DOUBLE AS v, count(*) FILTER (old) AS o, count(*) AS n, bool_or(polarity = 'positive') AS pos, bool_or(polarity = 'negative') AS neg FROM it GROUP BY 1, 2, 3),
g AS (SELECT property, category, count(*) AS reviews, count(*) FILTER (new) AS recent, count(DISTINCT source) AS sources, max(i) / sum(i) AS dom, sum(o) / sum(n) AS old, sum(v) / (sum(i) + 2) AS net, count(*) FILTER (pos) AS positive, count(*) FILTER (neg) AS negative FROM per GROUP BY 1, 2),
l AS (SELECT *, CASE WHEN reviews >= 8 AND recent >= 4 AND (sources >= 2 OR reviews >= 12) THEN 'high' WHEN reviews >= 5 THEN 'medium' ELSE 'low' END AS level FROM g),
b AS (SELECT property, category, analyzed FROM (SELECT property, count(*) AS analyzed FROM rv GROUP BY 1), (SELECT unnest(['noise', 'management', 'pests', 'building_safety', 'other_issues']) AS category)),
ev AS (SELECT property, category, analyzed, coalesce(reviews, 0) AS reviews, coalesce(recent, 0) AS recent, coalesce(positive, 0) AS positive, coalesce(negative, 0) AS negative, floor(net * 1000000.0::DOUBLE + 0.5::DOUBLE + 0.000001::DOUBLE) / 1000000.0::DOUBLE AS net,
  CASE WHEN reviews >= 3 THEN floor(least(10.0, greatest(1.0, 5.5 + 4.5 * net)) * 10 + 0.5 + 1e-9) / 10 END AS score,
  CASE WHEN coalesce(reviews, 0) < 3 THEN 'insufficient' WHEN round(dom, 9) > 0.5 OR round(old, 9) > 0.7 THEN CASE level WHEN 'high' THEN 'medium' ELSE 'low' END ELSE level END AS confidence FROM b LEFT JOIN l USING (property, category))
"""


@query(f"WITH {EVALUATION_SQL} SELECT * FROM ev")
def category_evaluation(spark, sf_dir):
    return assessments.evaluate(_items(spark, sf_dir), _reviews(spark, sf_dir), now()).drop("summary")


@query(f"""
WITH {REVIEWS_SQL}, per AS (SELECT property, category, theme, polarity, review, min(published) AS d, sum(w)::DOUBLE AS w FROM it WHERE theme <> 'subscore' GROUP BY ALL),
g AS (SELECT property, category, theme, polarity, count(*) AS n, count(d) AS known, sum(w) AS w, count(*) FILTER (d IS NOT NULL AND {_AGE.replace('published', 'd')} <= 2) AS recent, string_agg(review, ',' ORDER BY d DESC NULLS LAST, review) AS cited,
  CASE WHEN min(year(d)) = max(year(d)) THEN min(year(d)) || '' ELSE min(year(d)) || '–' || max(year(d)) END AS span FROM per GROUP BY 1, 2, 3, 4)
SELECT property, category, theme, polarity, round(w, 3) AS weight, cited, recent > 0 AS is_current, n || CASE WHEN n = 1 THEN ' review mentions ' ELSE ' reviews mention ' END || replace(theme, '_', ' ') || ' (' || {NOTE_SQL} || ').' AS text FROM g
""")
def theme_claims(spark, sf_dir):
    c = assessments.theme_claims(_items(spark, sf_dir), now()).where("theme <> 'subscore'")
    return c.select("property", "category", "theme", "polarity", "weight", F.array_join(F.transform("evidence", lambda x: x.cast("string")), ",").alias("cited"), "is_current", "text")


@query(f"""
WITH {EVALUATION_SQL}
SELECT property, category, CASE WHEN reviews = 0 THEN 'Insufficient evidence to reliably evaluate ' || label || '. None of the ' || analyzed || ' collected reviews discuss ' || label || '.'
  WHEN reviews < 3 THEN 'Insufficient evidence to reliably evaluate ' || label || '. Only ' || reviews || ' of ' || analyzed || ' collected reviews ' || CASE WHEN reviews = 1 THEN 'discusses ' ELSE 'discuss ' END || label || '.' END AS summary
FROM (SELECT *, replace(category, '_', ' ') AS label FROM ev) WHERE reviews < 3 AND analyzed > 1
""")
def insufficient_summaries(spark, sf_dir):
    out = assessments.evaluate(_items(spark, sf_dir), _reviews(spark, sf_dir), now())
    return out.where("reviews < 3 and analyzed > 1").select("property", "category", "summary")


ISSUES_SQL = f"""
{REVIEWS_SQL}, ip AS (SELECT property, theme, count(*) AS n, count(published) AS known, count(*) FILTER (published IS NOT NULL AND {_AGE} <= 2) AS recent, sum(CASE WHEN published IS NULL THEN 0.3 WHEN {_AGE} <= 2 THEN 1.0 WHEN {_AGE} <= 4 THEN 0.6 WHEN {_AGE} <= 7 THEN 0.3 ELSE 0.15 END)::DOUBLE AS w,
  CASE WHEN min(year(published)) = max(year(published)) THEN min(year(published)) || '' ELSE min(year(published)) || '–' || max(year(published)) END AS span FROM m JOIN rv USING (review) WHERE category = 'other_issues' GROUP BY 1, 2),
iss AS (SELECT *, CASE WHEN n < 2 THEN 'isolated' WHEN recent > 0 THEN 'recurring_current' ELSE 'recurring_old' END AS status FROM ip)
"""


@query(f"""
WITH {ISSUES_SQL}
SELECT property, theme, n AS reviews, recent, status, round(w, 3) AS weight, row_number() OVER (PARTITION BY property ORDER BY list_position(['recurring_current', 'recurring_old', 'isolated'], status), n DESC, theme) AS place,
  n || CASE WHEN n = 1 THEN ' review mentions ' ELSE ' reviews mention ' END || theme || ' — ' || CASE status WHEN 'isolated' THEN 'isolated anecdote' WHEN 'recurring_current' THEN 'recurring current issue' ELSE 'recurring but old issue' END || ' (' || {NOTE_SQL} || ').' AS text FROM iss
""")
def issue_patterns(spark, sf_dir):
    from pyspark.sql.window import Window

    p = assessments.issue_patterns(_mentions(spark, sf_dir), _reviews(spark, sf_dir), now())
    return p.withColumn("place", F.row_number().over(Window.partitionBy("property").orderBy(*cards.issue_order())).cast("long"))


@query(f"""
WITH {ISSUES_SQL}, t AS (SELECT property, count(*) AS texts FROM rv GROUP BY 1),
s AS (SELECT property, string_agg(theme || ', ' || n || ' reviews', '; ' ORDER BY n DESC, theme) FILTER (status = 'recurring_current') AS cur, string_agg(theme || ', ' || n || ' reviews', '; ' ORDER BY n DESC, theme) FILTER (status = 'recurring_old') AS old,
  count(*) FILTER (status = 'recurring_current') AS nc, count(*) FILTER (status = 'recurring_old') AS no_, count(*) FILTER (status = 'isolated') AS ni FROM iss GROUP BY 1),
j AS (SELECT t.property, texts, cur, old, coalesce(nc, 0) AS nc, coalesce(no_, 0) AS no_, coalesce(ni, 0) AS ni FROM t LEFT JOIN s USING (property))
SELECT property, texts, CASE WHEN texts >= 5 THEN floor(greatest(1.0, 10 - 1.5 * nc - 0.75 * no_) * 10 + 0.5 + 1e-9) / 10 END AS score, CASE WHEN texts < 5 THEN 'Insufficient evidence to evaluate other recurring issues.' ELSE 'Across ' || texts || ' reviews with text, '
  || CASE WHEN nc + no_ = 0 THEN 'none of the issues raised recurred across multiple reviews; issues reviewers did not write about cannot be ruled out.'
    ELSE 'reviewers describe ' || concat_ws(' and ', CASE WHEN nc > 0 THEN nc || ' recurring current ' || CASE WHEN nc = 1 THEN 'issue' ELSE 'issues' END || ' (' || cur || ')' END, CASE WHEN no_ > 0 THEN no_ || ' recurring but older ' || CASE WHEN no_ = 1 THEN 'issue' ELSE 'issues' END || ' (' || old || ')' END) || '.' END
  || CASE WHEN ni = 1 THEN ' 1 isolated complaint is listed separately and does not affect the score.' WHEN ni > 1 THEN ' ' || ni || ' isolated complaints are listed separately and do not affect the score.' ELSE '' END
  || CASE WHEN no_ > 0 AND nc = 0 THEN ' All recurring issues come from reviews older than 2 years and may no longer apply.' ELSE '' END END AS summary FROM j
""")
def issue_assessments(spark, sf_dir):
    r = _reviews(spark, sf_dir)
    texts = r.groupBy("property").agg(F.count("*").alias("texts"))
    return assessments.issue_assessments(assessments.issue_patterns(_mentions(spark, sf_dir), r, now()), texts)


@query(f"""
WITH {REVIEWS_SQL}, c AS (SELECT property, polarity, theme, count(DISTINCT review) AS n FROM m JOIN rv USING (review) WHERE polarity <> 'neutral' GROUP BY 1, 2, 3),
k AS (SELECT *, row_number() OVER (PARTITION BY property, polarity ORDER BY n DESC, theme) AS k FROM c),
l AS (SELECT property, string_agg(replace(theme, '_', ' ') || ' (' || n || CASE WHEN n = 1 THEN ' review)' ELSE ' reviews)' END, '; ' ORDER BY k) FILTER (polarity = 'negative') AS bad, string_agg(replace(theme, '_', ' ') || ' (' || n || CASE WHEN n = 1 THEN ' review)' ELSE ' reviews)' END, '; ' ORDER BY k) FILTER (polarity = 'positive') AS good FROM k WHERE k <= 6 GROUP BY 1),
t AS (SELECT property, count(*) AS reviews, bool_and(published IS NOT NULL AND date_diff('second', published, TIMESTAMP '{NOW}') > 730 * 86400) AS old FROM rv GROUP BY 1)
SELECT t.property, reviews, CASE WHEN l.property IS NULL THEN 'No specific complaints or praise topics found in the review texts.' ELSE 'Complaints: ' || coalesce(bad, 'none identified') || '. Praise: ' || coalesce(good, 'none identified') || '.' END || CASE WHEN old THEN ' All of these reviews are more than 2 years old.' ELSE '' END AS text FROM t LEFT JOIN l USING (property)
""")
def comments_summaries(spark, sf_dir):
    r = _reviews(spark, sf_dir).withColumn("text", F.lit("said"))
    return cards.comments_summary(_mentions(spark, sf_dir).join(r.select("review", "property"), "review"), r, "property", now())


@query(f"""
WITH {REVIEWS_SQL} SELECT property, theme, min(review) AS review, strftime(min(published), '%Y-%m-%d') AS published FROM m JOIN rv USING (review) WHERE theme IN ('cockroaches', 'mold') GROUP BY 1, 2 HAVING count(*) = 1
""")
def single_allegations(spark, sf_dir):
    out = assessments.single_allegations(_mentions(spark, sf_dir), _reviews(spark, sf_dir))
    return out.select("property", "theme", "review", F.date_format("published", "yyyy-MM-dd").alias("published"))


# -- audit and storage: claims are orders, their evidence lines of orders


AUDIT_SQL = f"""
a AS (SELECT o_custkey AS property, 'noise' AS category, CASE WHEN o_custkey % 5 > 0 THEN 6.0 END AS score, ['high', 'medium', 'low', 'insufficient'][CASE WHEN o_custkey % 5 > 0 THEN o_custkey % 3 + 1 ELSE 4 END] AS confidence, count(*) AS evidence, CASE WHEN o_custkey % 4 = 0 THEN 'The place is quiet.' ELSE 'Mixed.' END AS summary FROM orders GROUP BY o_custkey),
c AS (SELECT o_custkey AS property, 'noise' AS category, o_orderkey AS claim, ['positive', 'negative', 'neutral'][o_orderkey % 3 + 1] AS polarity, 'claim ' || o_orderkey AS text, o_orderkey % 2 = 0 AS is_current FROM orders),
r AS (SELECT DISTINCT o_custkey AS property, 'noise' AS category, l_orderkey AS claim, CASE l_linenumber WHEN 6 THEN -1 WHEN 5 THEN l_orderkey % 50 + 1 ELSE l_orderkey END AS evidence_id FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE l_orderkey % 7 > 0),
e AS (SELECT o_orderkey AS evidence_id, o_custkey AS owner, CASE WHEN o_orderstatus = 'P' THEN 'price' ELSE 'review' END AS kind, CASE WHEN o_orderkey % 6 > 0 THEN ['noise'] ELSE ['pests'] END AS categories, o_orderdate AS published, o_orderkey % 5 > 0 AS has_url FROM orders),
v AS (SELECT r.*, e.*, CASE WHEN e.evidence_id IS NULL THEN 'missing' WHEN owner <> property THEN 'wrong_owner' WHEN NOT list_contains(categories, 'noise') THEN 'unsupported' ELSE 'valid' END AS verdict FROM r LEFT JOIN e ON e.evidence_id = r.evidence_id),
pc AS (SELECT claim, count(*) AS n, count(*) FILTER (kind = 'review') AS revs, count(*) FILTER (kind = 'review' AND date_diff('second', published, TIMESTAMP '{NOW}') > 730 * 86400) AS olds, min(year(published)) FILTER (kind = 'review') AS y1, max(year(published)) FILTER (kind = 'review') AS y2 FROM v WHERE verdict = 'valid' GROUP BY 1),
k AS (SELECT c.*, n, is_current AND revs > 0 AND revs = olds AS stale, CASE WHEN y1 = y2 THEN y1 || '' ELSE y1 || '–' || y2 END AS span FROM c JOIN pc USING (claim)),
tl AS (SELECT property, count(*) AS claims, count(*) FILTER (polarity = 'positive') AS pos FROM k GROUP BY 1),
s1 AS (SELECT a.*, coalesce(claims, 0) AS claims, coalesce(pos, 0) AS pos, score IS NOT NULL AND coalesce(claims, 0) = 0 AS bare FROM a LEFT JOIN tl USING (property)),
s2 AS (SELECT *, CASE WHEN bare THEN 'Insufficient evidence to reliably evaluate noise.' ELSE summary END AS t1, CASE WHEN NOT bare THEN score END AS sc FROM s1),
s3 AS (SELECT *, pos = 0 AND t1 = 'The place is quiet.' AS silent, CASE WHEN sc IS NULL THEN 'insufficient' WHEN confidence = 'high' AND evidence < 8 THEN 'medium' WHEN confidence = 'medium' AND evidence < 5 THEN 'low' WHEN confidence = 'low' AND evidence < 3 THEN 'insufficient' ELSE confidence END AS level FROM s2)
"""


def _audited(spark, sf_dir):
    o, key, cust = table(spark, sf_dir, "orders"), F.col("o_orderkey"), F.col("o_custkey")
    noise = F.lit("noise").alias("category")
    a = o.groupBy(cust.alias("property")).agg(F.count("*").alias("evidence"))
    p = F.col("property")
    a = a.select("property", noise, F.when(p % 5 > 0, 6.0).alias("score"), F.when(p % 5 > 0, pick(("high", "medium", "low"), p)).otherwise("insufficient").alias("confidence"), "evidence", F.when(p % 4 == 0, "The place is quiet.").otherwise("Mixed.").alias("summary"))
    c = o.select(cust.alias("property"), noise, key.alias("claim"), pick(("positive", "negative", "neutral"), key).alias("polarity"), F.concat(F.lit("claim "), key.cast("string")).alias("text"), (key % 2 == 0).alias("is_current"))
    line, lk = F.col("l_linenumber"), F.col("l_orderkey")
    r = table(spark, sf_dir, "lineitem").where(lk % 7 > 0).select(lk.alias("claim"), F.when(line == 6, F.lit(-1)).when(line == 5, lk % 50 + 1).otherwise(lk).cast("long").alias("evidence_id")).distinct()
    r = r.join(o.select(key.alias("claim"), cust.alias("property")), "claim").select("property", noise, "claim", "evidence_id")
    e = o.select(key.alias("evidence_id"), cust.alias("owner"), F.when(F.col("o_orderstatus") == "P", "price").otherwise("review").alias("kind"), F.when(key % 6 > 0, F.array(F.lit("noise"))).otherwise(F.array(F.lit("pests"))).alias("categories"), F.col("o_orderdate").alias("published"), (key % 5 > 0).alias("has_url"))
    return assessments.audited(a, c, r, e, now())


@query(f"""
WITH {AUDIT_SQL}
SELECT property, 'evidence_exists' AS check_name, 'removed_reference' AS action, count(*) AS n FROM v WHERE verdict = 'missing' GROUP BY 1
UNION ALL SELECT property, 'source_attribution', 'removed_reference', count(*) FROM v WHERE verdict = 'wrong_owner' GROUP BY 1
UNION ALL SELECT property, 'evidence_supports_claim', 'removed_reference', count(*) FROM v WHERE verdict = 'unsupported' GROUP BY 1
UNION ALL SELECT property, 'source_url', 'noted', count(*) FROM v WHERE verdict = 'valid' AND NOT has_url GROUP BY 1
UNION ALL SELECT property, 'no_fabricated_claims', 'removed_claim', count(*) FROM c WHERE claim NOT IN (SELECT claim FROM pc) GROUP BY 1
UNION ALL SELECT property, 'old_evidence_qualified', 'added_qualifier', count(*) FROM k WHERE stale GROUP BY 1
UNION ALL SELECT property, 'missing_evidence_not_positive', 'removed_score', 1 FROM s3 WHERE bare
UNION ALL SELECT property, 'missing_evidence_not_positive', 'rewrote_summary', 1 FROM s3 WHERE silent
UNION ALL SELECT property, 'weak_evidence_confidence', 'downgraded_confidence', 1 FROM s3 WHERE sc IS NOT NULL AND level <> confidence
""")
def audit_findings(spark, sf_dir):
    _, _, findings = _audited(spark, sf_dir)
    return findings.groupBy("property", "check_name", "action").agg(F.count("*").alias("n"))


@query(f"""
WITH {AUDIT_SQL}, n AS (SELECT property, count(*) FILTER (verdict <> 'valid') AS bad FROM v GROUP BY 1), cx AS (SELECT property, count(*) FILTER (claim NOT IN (SELECT claim FROM pc)) AS gone FROM c GROUP BY 1), st AS (SELECT property, count(*) FILTER (stale) AS stale FROM k GROUP BY 1)
SELECT s3.property, CASE WHEN level <> 'insufficient' THEN sc::DOUBLE END AS score, level AS confidence, CASE WHEN silent THEN 'Insufficient positive evidence; the absence of complaints is not treated as evidence about noise.' ELSE t1 END AS summary,
  CASE WHEN coalesce(bad, 0) + coalesce(gone, 0) + coalesce(stale, 0) > 0 OR bare OR silent OR (sc IS NOT NULL AND level <> confidence) THEN 'corrected' ELSE 'passed' END AS audit_status
FROM s3 LEFT JOIN n USING (property) LEFT JOIN cx USING (property) LEFT JOIN st USING (property)
""")
def audited_assessments(spark, sf_dir):
    a, _, _ = _audited(spark, sf_dir)
    return a.select("property", "score", "confidence", "summary", "audit_status")


@query(f"WITH {AUDIT_SQL} SELECT claim, CASE WHEN stale THEN text || ' (based on reviews from ' || span || ')' ELSE text END AS text, is_current AND NOT stale AS is_current, n AS n_evidence FROM k")
def audited_claims(spark, sf_dir):
    _, c, _ = _audited(spark, sf_dir)
    return c.select("claim", "text", "is_current", F.size("evidence_ids").cast("long").alias("n_evidence"))


@query(f"""
WITH {AUDIT_SQL}, new AS (SELECT claim, property, unnest(l.x) AS evidence_id FROM (SELECT v.claim, v.property, {{'x': list_sort(list(DISTINCT v.evidence_id))}} AS l FROM (SELECT claim, property, r_evidence AS evidence_id FROM (SELECT claim, property, evidence_id AS r_evidence, verdict FROM (SELECT claim, property, owner, verdict, e_id AS evidence_id FROM (SELECT v.claim, v.property, v.owner, v.verdict, CASE WHEN v.verdict = 'valid' THEN v.evidence_id END AS e_id FROM v)) WHERE verdict = 'valid')) v GROUP BY 1, 2))
SELECT 'new' AS kind, property, count(*) AS n FROM new WHERE property % 2 = 0 GROUP BY 2 UNION ALL SELECT 'old', o_custkey, count(*) FROM orders WHERE o_custkey % 3 = 0 AND NOT (o_custkey % 2 = 0) GROUP BY 2
""")
def stored_lineage(spark, sf_dir):
    """Lineage after a write of the even properties: their old links are gone, those of others stay."""
    a, c, f = _audited(spark, sf_dir)
    even = lambda df: df.where("property % 2 = 0")
    old = table(spark, sf_dir, "orders").where("o_custkey % 3 = 0").select(F.col("o_custkey").alias("property"), F.lit(-1).cast("long").alias("claim"), F.lit(0).alias("ordinal"), F.col("o_orderkey").alias("evidence_id"))
    out = assessments.persisted({"lineage": old}, even(a), even(c), even(f))["lineage"]
    return out.groupBy(F.when(F.col("claim") == -1, "old").otherwise("new").alias("kind"), "property").agg(F.count("*").alias("n"))


# -- what a run writes


LISTINGS_SQL = """
l AS (SELECT p_partkey AS property, 's' || p_partkey % 2 AS source, p_partkey || '' AS listing, sha1(p_name || p_partkey) AS sha, p_partkey % 4 = 0 AS promoted, 1500 + p_partkey % 700 AS rent, p_partkey % 3 AS many FROM part),
u AS (SELECT *, unnest(range(1, many + 2)) AS k FROM l)
"""


def _listings(spark, sf_dir):
    key = F.col("p_partkey")
    unit = lambda k: F.struct(
        k.cast("string").alias("unit_key"), F.lit(None).cast("string").alias("label"), F.lit("Plan").alias("floorplan"), F.lit("unit").alias("kind"), F.lit(1).alias("beds"), F.lit(1.0).alias("baths"), F.lit(500).alias("sqft_min"), F.lit(500).alias("sqft_max"),
        (1500 + key % 700).alias("base_min"), (1500 + key % 700).alias("base_max"), F.lit(None).cast("double").alias("total"), F.lit(None).cast("double").alias("fees"), F.lit(12).alias("months"), F.lit(None).cast("timestamp_ntz").alias("updated"))
    fee = F.struct(F.lit("pet").alias("fee_type"), F.lit("Pet rent").alias("description"), F.lit(50).alias("amount"), F.lit("$50").alias("amount_text"), (key % 2 == 0).alias("recurring"), F.lit(None).cast("boolean").alias("mandatory"))
    fact = F.struct(F.lit("year").alias("key"), F.lit("Year built").alias("title"), F.lit("1990").alias("content"))
    return table(spark, sf_dir, "part").select(
        key.alias("property"), F.concat(F.lit("s"), (key % 2).cast("string")).alias("source"), key.cast("string").alias("listing"), F.lit("https://a.com").alias("url"), F.col("p_name").alias("name"), F.sha1(F.concat("p_name", key.cast("string"))).alias("sha"),
        F.expr("TIMESTAMP_NTZ'2001-08-01 00:00:00'").alias("collected"), F.when(key % 4 == 0, F.array(F.lit("8 weeks free"))).otherwise(F.array().cast("array<string>")).alias("promotions"),
        F.when(key % 5 == 0, F.array(fact)).alias("facts"), F.transform(F.sequence(F.lit(1), (key % 3 + 1).cast("int")), unit).alias("units"), F.when(key % 6 == 0, F.array(fee, fee)).alias("fees"))


@query(f"""
WITH {LISTINGS_SQL}, pr AS (SELECT 'ev_' || left(sha1(concat_ws(chr(31), 'price', source, listing, k, sha)), 20) AS id, rent, promoted FROM u)
SELECT id, rent AS base, CASE WHEN promoted THEN CAST(round_even(rent * (52 - 8) / 52::DOUBLE, 0) AS BIGINT) END AS effective, '1 bedroom, floor plan Plan: advertised base rent $' || format('{{:,}}', rent) || '; 12-month lease; 500 sq ft' AS content FROM pr
""")
def listing_prices(spark, sf_dir):
    """Prices after the same listings were stored twice: the second time adds none."""
    rows = _listings(spark, sf_dir)
    twice = writes.store_listings(writes.listing_rows(rows), rows)
    return twice["prices"].select("id", F.col("base_min").alias("base"), "effective", "content")


@query(f"""
WITH {LISTINGS_SQL}
SELECT 'links' AS kind, count(*) AS n FROM l UNION ALL SELECT 'facts', count(*) FROM l WHERE property % 5 = 0 UNION ALL SELECT 'units', count(*) FROM u UNION ALL SELECT 'prices', count(*) FROM u UNION ALL SELECT 'fees', count(*) FROM l WHERE property % 6 = 0
""")
def listing_tables(spark, sf_dir):
    out = None
    for kind, df in writes.store_listings({}, _listings(spark, sf_dir)).items():
        one = df.agg(F.count("*").alias("n")).select(F.lit(kind).alias("kind"), "n")
        out = one if out is None else out.unionByName(one)
    return out


@query("""
WITH p AS (SELECT c_custkey AS property, lower(trim(['Alviso', 'San Jose ', 'Fremont', 'Elsewhere'][c_custkey % 4 + 1])) AS city FROM customer), a AS (SELECT * FROM (VALUES ('san jose', 5.25), ('fremont', NULL)) t(city, violent))
SELECT property, 'ev_' || left(sha1(concat_ws(chr(31), 'safety', property, 'City of ' || a.city, 2024, 'https://d')), 20) AS id, 'Reported crime in City of ' || a.city || ' (2024)' AS title,
  'City of ' || a.city || ' 2024: ' || CASE WHEN violent IS NULL THEN 'unknown' ELSE printf('%.2f', violent::DOUBLE) END || ' violent and 10.50 property crimes per 1,000 residents' AS content
FROM p JOIN a ON a.city = CASE WHEN p.city = 'alviso' THEN 'san jose' ELSE p.city END
""")
def area_evidence(spark, sf_dir):
    key = F.col("c_custkey")
    p = table(spark, sf_dir, "customer").select(key.alias("property"), pick(("Alviso", "San Jose ", "Fremont", "Elsewhere"), key).alias("city"))
    a = spark.createDataFrame([("san jose", "City of san jose", 5.25), ("fremont", "City of fremont", None)], "city string, jurisdiction string, violent double")
    a = a.select("*", F.lit(2024).alias("year"), F.lit(10.5).alias("property_crime"), F.lit(None).cast("string").alias("reason"), F.lit("https://d").alias("url"), F.lit("2025-01-01").alias("retrieved"))
    return writes.area_evidence(p, a).select("property", "id", "title", "content")


@query("""
WITH n AS (SELECT o_custkey AS property, max_by({'s': o_orderstatus, 'd': CASE WHEN o_orderkey % 3 > 0 THEN o_totalprice END}, o_orderdate + to_seconds(o_orderkey)) AS x FROM orders WHERE o_custkey % 2 = 0 GROUP BY 1)
SELECT property, x.s AS status, x.d AS details FROM n UNION ALL SELECT c_custkey, 'old', 1.0 FROM customer WHERE c_custkey NOT IN (SELECT property FROM n)
""")
def match_outcomes(spark, sf_dir):
    old = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("property"), F.lit("old").alias("status"), F.expr("TIMESTAMP_NTZ'1990-01-01 00:00:00'").alias("checked"), F.lit(1.0).alias("details"))
    new = table(spark, sf_dir, "orders").where("o_custkey % 2 = 0").select(F.col("o_custkey").alias("property"), F.col("o_orderstatus").alias("status"), F.expr("timestampadd(SECOND, CAST(o_orderkey AS INT), o_orderdate)").alias("checked"), F.when(F.col("o_orderkey") % 3 > 0, F.col("o_totalprice")).alias("details"))
    return writes.match_outcomes(old, new).select("property", "status", "details")


@query("""
WITH u AS (SELECT p_brand AS e, p_size > 20 AS q, p_size % 3 AS beds, 1500 + p_partkey % 900 AS low, CASE WHEN p_partkey % 4 > 0 THEN 1500 + p_partkey % 900 + p_partkey % 2 * 100 END AS high, 400 + p_partkey % 500 AS s, p_partkey % 50 = 0 AS promo FROM part), g AS (
SELECT e, count(*) FILTER (beds = 0) AS st, count(*) FILTER (beds > 0) AS ot, min(low) AS rent_min, max(coalesce(high, low)) AS rent_max, bool_or(promo) AS promo, min(s) AS sqft_min, max(s + 10) AS sqft_max,
  len(list_distinct(list_filter(flatten(list([low, high])), lambda r: r BETWEEN 1600 AND 2000))) AS rents FROM u WHERE q GROUP BY 1)
SELECT p.e, CASE WHEN st > 0 AND ot > 0 THEN 'studio,1br' WHEN st > 0 THEN 'studio' WHEN ot > 0 THEN '1br' ELSE '' END AS unit_types, rent_min, rent_max, coalesce(promo, false) AS has_promotion, sqft_min, sqft_max, coalesce(rents, 0) AS n_rents,
  CASE WHEN ascii(right(p.e, 1)) % 2 = 0 THEN 7.5 END AS noise, CASE WHEN ascii(right(p.e, 1)) % 2 = 0 THEN 'high' ELSE 'insufficient' END AS noise_confidence, 'a,b' AS sources
FROM (SELECT DISTINCT e FROM u) p LEFT JOIN g USING (e)
""")
def summary_cards(spark, sf_dir):
    key = F.col("p_partkey")
    u = table(spark, sf_dir, "part").select(
        F.col("p_brand").alias("e"), (F.col("p_size") > 20).alias("qualifies"), (F.col("p_size") % 3).alias("beds"), (1500 + key % 900).alias("base_min"), F.when(key % 4 > 0, 1500 + key % 900 + key % 2 * 100).alias("base_max"), (400 + key % 500).alias("sqft_min"),
        (410 + key % 500).alias("sqft_max"), (key % 50 == 0).alias("promotional"), F.lit("2001").alias("collected"))
    e = u.select("e").distinct()
    a = e.where(F.ascii(F.right("e", F.lit(1))) % 2 == 0).select("e", F.lit("noise").alias("category"), F.lit(7.5).alias("score"), F.lit("high").alias("confidence"))
    s = e.select("e", F.explode(F.array(F.lit("b"), F.lit("a"), F.lit("b"))).alias("source"))
    out = cards.summary_cards(e, u, a, s, "e", (1600, 2000))
    assert all(k in out.columns for k in CATEGORY_WEIGHTS)
    return out.select("e", F.array_join("unit_types", ",").alias("unit_types"), "rent_min", "rent_max", "has_promotion", "sqft_min", "sqft_max", F.greatest(F.lit(0), F.size("qualifying_rents")).cast("long").alias("n_rents"), "noise", "noise_confidence", F.array_join("sources", ",").alias("sources"))


@query(f"""
WITH {REVIEWS_SQL}, c AS (SELECT property, polarity, theme, count(*) AS n, row_number() OVER (PARTITION BY property, polarity ORDER BY count(*) DESC, theme) AS k FROM m JOIN rv USING (review) GROUP BY 1, 2, 3),
t AS (SELECT property, string_agg(theme, ',' ORDER BY k) FILTER (polarity = 'positive') AS good, string_agg(theme, ',' ORDER BY k) FILTER (polarity = 'negative') AS bad FROM c WHERE k <= 5 GROUP BY 1), n AS (SELECT property, count(*) AS n FROM rv GROUP BY 1)
SELECT p.property, coalesce(n, 0) AS n_reviews, CASE WHEN p.property % 3 = 0 THEN 'high' ELSE 'insufficient' END AS confidence, CASE WHEN p.property % 3 = 0 THEN 'Good data.' WHEN n IS NULL THEN 'Review data: No reviews found' ELSE 'Not evaluated yet.' END AS summary, coalesce(good, '') AS praised, coalesce(bad, '') AS criticized
FROM (SELECT unnest(range(400)) AS property) p LEFT JOIN n USING (property) LEFT JOIN t USING (property)
""")
def review_panels(spark, sf_dir):
    r = _reviews(spark, sf_dir)
    e = spark.range(400).select(F.col("id").alias("property"))
    q = e.where("property % 3 = 0").select("property", F.lit("high").alias("confidence"), F.lit("Good data.").alias("summary"))
    t = _mentions(spark, sf_dir).distinct().join(r.select("review", "property"), "review").groupBy("property", "theme", "polarity").agg(F.count("*").alias("reviews"))
    out = cards.review_panel(e, r, q, t, "property")
    return out.withColumns({"praised": F.array_join("praised", ","), "criticized": F.array_join("criticized", ",")})


# -- whole texts


@query(f"SELECT doc_id, category, theme, polarity, excerpt, recurring FROM documents JOIN {STATED_TEXTS_SQL} ON doc_id % 12 = k")
def document_themes(spark, sf_dir):
    """Themes in the whole text of every document with a review at its end, those that hold."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.concat(F.coalesce("text", F.lit("")), F.lit("\n"), pick(REVIEWS, F.col("doc_id"))).alias("text"))
    return assessments.classified(d, "doc_id", "text")


@query(f"SELECT doc_id, fee_type, description, CAST(amount AS BIGINT) AS amount, amount_text, recurring, said AS mandatory FROM documents JOIN {FEES_SQL} ON doc_id % 5 = k WHERE amount_text IS NOT NULL")
def document_fees(spark, sf_dir):
    """The amounts of money that fees state in the whole text of every document with a list of fees at its end."""
    text = F.concat(F.coalesce("text", F.lit("")), F.lit("; "), pick(FEES, F.col("doc_id")))
    d = table(spark, sf_dir, "documents").select("doc_id", F.explode(S.fee_items(text, F.lit(None).cast("boolean"))).alias("f"))
    return d.where("f.amount_text is not null").select("doc_id", "f.*")


@query()
def evaluated_properties(spark, sf_dir):
    """All categories of every property by the registered evaluators, from mentions classified once."""
    return assessments.evaluate_all(_reviews(spark, sf_dir), _mentions(spark, sf_dir), now())



@query(f"""
WITH {REVIEWS_SQL}, g AS (SELECT property, polarity, theme, count(DISTINCT review) AS reviews, count(DISTINCT CASE WHEN new THEN review END) AS recent FROM it WHERE polarity <> 'neutral' GROUP BY 1, 2, 3 HAVING count(DISTINCT review) >= 2)
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY property, polarity ORDER BY reviews DESC, theme) AS rank FROM g) WHERE rank <= 5
""")
def review_intelligence(spark, sf_dir):
    return cards.intelligence(_items(spark, sf_dir), "property", now())


@query("""
WITH e AS (SELECT o_orderkey AS id, o_custkey AS property, CASE WHEN o_orderkey % 4 = 0 THEN 'review_summary' WHEN o_orderkey % 4 = 1 THEN 'price' ELSE 'review' END AS kind, 'text ' || o_orderkey AS text, o_orderdate AS d FROM orders)
SELECT property, id AS evidence_id, id % 5 + 1 AS rating, text, false AS is_summary FROM e WHERE kind = 'review'
UNION ALL SELECT property, id, NULL, text, true FROM (SELECT *, row_number() OVER (PARTITION BY property ORDER BY d DESC, id DESC) AS rn FROM e WHERE kind = 'review_summary') WHERE rn = 1
""")
def review_inputs(spark, sf_dir):
    key = F.col("o_orderkey")
    o = table(spark, sf_dir, "orders")
    kind = F.when(key % 4 == 0, "review_summary").when(key % 4 == 1, "price").otherwise("review")
    e = o.select(F.col("o_custkey").alias("property"), key.alias("evidence_id"), kind.alias("kind"), F.lit("s").alias("source"), F.concat(F.lit("text "), key.cast("string")).alias("content"), F.col("o_orderdate").alias("published"), F.col("o_orderdate").alias("collected"))
    r = o.select(F.col("o_custkey").alias("property"), key.alias("evidence_id"), (key % 5 + 1).alias("rating"))
    return cards.review_inputs(r, e, "property").select("property", "evidence_id", "rating", "text", "is_summary")


@query("""
WITH l AS (SELECT o_custkey AS id, max(o_orderkey) AS last FROM orders WHERE o_orderkey % 3 = 0 GROUP BY 1), n AS (SELECT o_custkey AS id, count(*) AS n, sum(o_totalprice) AS t FROM orders GROUP BY 1)
SELECT c_custkey AS id, last AS last_order, coalesce(n, 0) AS n_orders, round(coalesce(t, 0), 2) AS total FROM customer LEFT JOIN l ON l.id = c_custkey LEFT JOIN n ON n.id = c_custkey
""")
def entity_context(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("id"), "o_orderkey", "o_totalprice")
    e = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"))
    out = cards.context(e, "id", {"latest": (o.where("o_orderkey % 3 = 0"), ["o_orderkey"])}, {"orders": o})
    total = F.aggregate("orders", F.lit(0.0), lambda a, x: a + x["o_totalprice"])
    return out.select("id", F.col("latest.o_orderkey").alias("last_order"), F.size("orders").cast("long").alias("n_orders"), F.round(total, 2).alias("total"))


# -- mined reviews

#: The reviews of the customer table and what they state, in place of the orders'.
MINED_SQL = f"""
rv AS (SELECT c_custkey % 40 AS property, c_custkey AS review, 's' || c_custkey % 3 AS source, CASE WHEN c_custkey % 11 > 0 THEN TIMESTAMP '2001-08-01 00:00:00' - to_days((c_custkey * 37 % 3000)::INT) END AS published FROM customer),
m AS (SELECT c_custkey AS review, category, theme, polarity FROM customer JOIN {STATED_TEXTS_SQL} ON c_custkey * 7 % 12 = k),
pt AS (SELECT 0::BIGINT AS review, '' AS category, 0.0 AS raw WHERE false),
""" + REVIEWS_SQL[REVIEWS_SQL.index("ch AS (") :]


@query(f"WITH {EVALUATION_SQL.replace(REVIEWS_SQL, MINED_SQL)} SELECT * FROM ev")
def category_scores(spark, sf_dir):
    r, m = mined(spark, sf_dir)
    return assessments.evaluate(assessments.scored_items(m, r, now()), r, now()).drop("summary")


@query(f"""
WITH {ISSUES_SQL.replace(REVIEWS_SQL, MINED_SQL)}, t AS (SELECT property, count(*) AS texts FROM rv GROUP BY 1), s AS (SELECT property, count(*) FILTER (status = 'recurring_current') AS nc, count(*) FILTER (status = 'recurring_old') AS old FROM iss GROUP BY 1)
SELECT property, texts, CASE WHEN texts >= 5 THEN floor(greatest(1.0, 10 - 1.5 * coalesce(nc, 0) - 0.75 * coalesce(old, 0)) * 10 + 0.5 + 1e-9) / 10 END AS score FROM t LEFT JOIN s USING (property)
""")
def issue_scores(spark, sf_dir):
    r, m = mined(spark, sf_dir)
    return assessments.issue_assessments(assessments.issue_patterns(m, r, now()), r.groupBy("property").agg(F.count("*").alias("texts"))).drop("summary")
