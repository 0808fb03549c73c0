from datetime import datetime

import pytest
from pyspark.sql import functions as F

from ashlar.operators import assessments, cards, screening, writes


def now():
    return F.expr("TIMESTAMP_NTZ'2026-10-03 12:00:00'")


REVIEWS = "property long, review string, source string, published timestamp_ntz, parts map<string,double>"


def day(year, month=1):
    return datetime(year, month, 1)


def test_summary_in_words(spark):
    reviews = spark.createDataFrame([(1, f"r{k}", "a" if k % 2 else "b", day(2026 - k), {"noise": 2.0} if k == 0 else None) for k in range(5)] + [(2, "x", "a", None, None)], REVIEWS)
    mentions = spark.createDataFrame([("r0", "noise", "thin_walls", "negative"), ("r1", "noise", "thin_walls", "negative"), ("r1", "noise", "thin_walls", "negative"), ("r2", "noise", "quiet", "positive"), ("x", "noise", "quiet", "positive")],
                                     "review string, category string, theme string, polarity string")
    items = assessments.scored_items(mentions, reviews, now())
    got = {(r.property, r.category): r for r in assessments.evaluate(items, reviews, now(), ("noise", "pests")).collect()}
    r = got[1, "noise"]
    assert (r.analyzed, r.reviews, r.recent, r.positive, r.negative) == (5, 3, 2, 1, 2)
    assert r.summary == ("Of 3 reviews discussing noise (2 from the last 2 years; 5 reviews analyzed), 2 mention thin walls, 1 mentions quiet, and 1 includes a resident noise sub-rating averaging 2.0/5."
                         " Evidence is mixed: 2 reviews include negative and 1 includes positive noise evidence.")
    pull = (-1 - 1 + 0.6 - 0.5) / (1 + 1 + 0.6 + 1 + 2)
    assert r.score == pytest.approx(int((5.5 + 4.5 * pull) * 10 + 0.5) / 10) and r.confidence == "low"
    assert got[1, "pests"].summary == "Insufficient evidence to reliably evaluate pests. None of the 5 collected reviews discuss pests." and got[1, "pests"].score is None
    assert got[2, "noise"].summary == "Insufficient evidence to reliably evaluate noise. Only 1 of 1 collected review discusses noise."
    assert got[2, "pests"].summary.endswith("The only collected review does not discuss pests.")
    claims = {(c.property, c.theme): c for c in assessments.theme_claims(items, now()).collect()}
    assert claims[1, "thin_walls"].text == "2 reviews mention thin walls (all from the last 2 years)." and claims[1, "thin_walls"].evidence == ["r0", "r1"]
    assert claims[1, "subscore"].text == "1 review gives an unfavorable resident noise sub-rating (average 2.0/5; from the last 2 years)."
    assert claims[1, "quiet"].text == "1 review mentions quiet (mention from 2024)." and not claims[1, "quiet"].is_current
    assert claims[2, "quiet"].text == "1 review mentions quiet (review date unavailable)."


def test_management_before_a_change_counts_half(spark):
    reviews = spark.createDataFrame([(1, "old", "a", day(2025), None), (1, "new", "a", day(2026), None), (1, "undated", "a", None, None)], REVIEWS)
    rows = [("new", "management", "management_change", "neutral")] + [(r, "management", "maintenance", "negative") for r in ("old", "new", "undated")]
    items = assessments.scored_items(spark.createDataFrame(rows, "review string, category string, theme string, polarity string"), reviews, now())
    assert {r.review: r.weight for r in items.collect()} == {"old": 0.5, "new": 1.0, "undated": 0.3}


def test_all_categories_have_an_evaluator(spark):
    reviews = spark.createDataFrame([(1, "a", "s", None, None)], REVIEWS)
    none = spark.createDataFrame([], "review string, category string, theme string, polarity string")
    drive = spark.createDataFrame([(1, "commute", 8.0, "high", 1, "A short drive.")], "property long, category string, score double, confidence string, evidence long, summary string")
    got = {r.category: r.score for r in assessments.evaluate_all(reviews, none, now(), drive).collect()}
    assert set(got) == {*assessments.EVALUATORS, "commute"} and got["commute"] == 8.0 and not [v for k, v in got.items() if k != "commute" and v]


def test_synthesizer_may_only_reword(spark):
    drafts = spark.createDataFrame([(1, "noise", 5.0, "old"), (2, "noise", 6.0, "kept")], "property long, category string, score double, summary string")
    keys = ["property", "category"]
    new = assessments.reworded(drafts, keys, lambda d: d.select(*keys, F.lit(9.0).alias("score"), F.when(F.col("property") == 1, "new").otherwise(" ").alias("summary")))
    assert sorted(map(tuple, new.collect())) == [(1, "noise", 5.0, "new"), (2, "noise", 6.0, "kept")] and assessments.reworded(drafts, keys) is drafts
    with pytest.raises(NotImplementedError):
        assessments.classified(drafts.select(F.col("property").alias("r"), F.col("summary").alias("x")), "r", "x", assessments.model_miner)


def test_storing_twice_adds_nothing(spark):
    unit = "struct<unit_key:string,label:string,floorplan:string,kind:string,beds:int,baths:double,sqft_min:int,sqft_max:int,base_min:int,base_max:int,total:double,fees:double,months:int,updated:timestamp_ntz>"
    schema = f"property long, source string, listing string, url string, name string, sha string, collected timestamp_ntz, promotions array<string>, facts array<struct<key:string,title:string,content:string>>, units array<{unit}>, fees array<struct<fee_type:string,description:string,amount:int,amount_text:string,recurring:boolean,mandatory:boolean>>"
    u = ("1", "A", None, "unit", 0, 1.0, 400, 450, 2000, 2100, 2150.5, 50.5, 12, None)
    rows = [(1, "s", "l", "u", "n", "x", day(2026), ["8 weeks free"], None, [u], [("pet", "Pet $50", 50, "$50", True, None)])]
    df = spark.createDataFrame(rows, schema)
    one = writes.store_listings({}, df)
    p = one["prices"].first()
    assert p.content == "Studio, unit A: advertised base rent $2,000–$2,100; published total $2,150.50 including $50.50 required monthly fees; 12-month lease; 400–450 sq ft"
    assert p.effective == round(2000 * 44 / 52) and p.promotional
    two = writes.store_listings(one, df)
    assert {k: v.count() for k, v in two.items()} == {"links": 1, "facts": 0, "units": 1, "prices": 1, "fees": 1}
    changed = writes.store_listings(one, spark.createDataFrame([(*rows[0][:4], "renamed", "y", *rows[0][6:])], schema))
    assert changed["prices"].count() == 2 and changed["fees"].count() == 2 and changed["links"].first().name == "renamed"


def test_routes_fall_back(spark):
    points = spark.createDataFrame([(1, 37.0, -122.0), (2, 37.0, -122.0), (3, 38.0, -122.0), (4, None, 1.0)], "id long, lat double, lon double")
    first = lambda c: c.select("p_lat", "p_lon", (F.col("p_lat") < 37.5).alias("ok"), F.lit(60.0).alias("seconds"), F.lit(1.0).alias("meters"))
    second = lambda c: c.select("p_lat", "p_lon", F.lit(True).alias("ok"), F.lit(90.0).alias("seconds"), F.lit(2.0).alias("meters"))
    assert sorted((r.id, r.seconds, r.provider) for r in writes.route_many(points, "id", [first, second]).collect()) == [(1, 60.0, "primary"), (2, 60.0, "primary"), (3, 90.0, "secondary")]


def test_summaries_of_reviews_are_refreshed(spark):
    new = spark.createDataFrame([(1, "p", "Fine.", day(2026)), (1, "p", None, day(2026))], "property long, place string, text string, fetched timestamp_ntz")
    old = spark.createDataFrame([], "id string, property long, text string, first_collected timestamp_ntz, collected timestamp_ntz")
    first = writes.summary_evidence(old, new)
    again = writes.summary_evidence(first, new.withColumn("fetched", F.expr("TIMESTAMP_NTZ'2027-01-01 00:00:00'"))).collect()
    assert len(again) == 1 and again[0].first_collected == day(2026) and again[0].collected == day(2027)


def test_small_predicates(spark):
    one = lambda *cs: list(spark.range(1).select(*cs).first())
    assert one(screening.same_site(F.lit("https://www.a.com/x"), F.lit("http://b.a.com")), screening.same_site(F.lit("https://a.com"), F.lit("https://ba.com")), screening.same_site(F.lit(None), F.lit("https://a.com"))) == [True, False, False]
    assert one(cards.clean_list(F.array(F.lit(" a  b "), F.lit("a b"), F.lit(""), F.lit("c"))))[0] == ["a b", "c"]
    assert one(screening.house_number(F.lit("12 Oak")), screening.house_number(F.lit("Oak 12"))) == ["12", None]


def test_what_summaries_imply(spark):
    from ashlar.operators.assessments import implies_good

    said = {"No known pests here.": True, "There are no complaints.": True, "It is a very quiet house": True, "PEST-FREE, they say": True, "Perfectly safe.": True, "No reported noise": True,
            "No data.": False, "Issues with noise": False, "Know noise": False, "safe": False, None: False, "No one reported issues": False}
    df = spark.createDataFrame([(k,) for k in said], "s string")
    assert {r["s"]: r["good"] for r in df.select("s", implies_good("s").alias("good")).collect()} == said


def test_who_is_excluded(spark):
    from ashlar.operators.screening import excluded_eligibility, restricted_unit

    rows = [(["Pool", "Low-Income housing"], "x", "Listed as Low-Income housing"), (["55 + living"], "x", "Listed as 55 + living"), (["62+"], None, "Listed as 62+"), (["5+ acres", "Seniority", "155+"], "Oak", None),
            (None, "Golden SENIOR homes", "Name indicates restricted eligibility: Golden SENIOR homes"), ([], "Age 55 place", "Name indicates restricted eligibility: Age 55 place"), ([None, "income limits apply"], "x", "Listed as income limits apply"), (None, "Affordable", None), (None, None, None)]
    df = spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], "k int, listed array<string>, name string, want string")
    assert [(r["got"], r["want"]) for r in df.select(excluded_eligibility("listed", "name").alias("got"), "want").collect()] == [(w, w) for _, _, w in rows]
    names = {"A1 (60% AMI)": True, "BMR-2": True, "below-market": True, "miami": False, None: False, "Incoming": False}
    df = spark.createDataFrame([(k,) for k in names], "n string")
    assert {r["n"]: r["no"] for r in df.select("n", restricted_unit("n").alias("no")).collect()} == names
