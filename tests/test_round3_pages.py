"""What the third round's findings asked for of pages and listings."""

import json
from unittest.mock import Mock

import pyarrow as pa

from ashlar import tables
from ashlar.sources import disclosures, pages


def _reader():
    def read(html):  # goes to the workers as it is: they don't know this module
        if html == "bad":
            raise ValueError("no page")
        return [tuple(r) for r in json.loads(html)]

    return read


PAGES = [(k, json.dumps([[k, "a"], [k + 1, None]])) for k in range(500)] + [(500, "bad"), (501, json.dumps([["no number", "b"]])), (502, json.dumps([[1, "c", 2]])), (503, json.dumps([])), (504, json.dumps([[7, "d"]]))]
ROWS = sorted([(k, k, "a") for k in range(500)] + [(k, k + 1, None) for k in range(500)] + [(504, 7, "d")], key=str)


def test_failing_pages_fail_alone(spark):
    good, failed = pages.read_pages_apart(spark.createDataFrame(PAGES, "id long, html string").coalesce(1), "id", "html", "n long, t string", _reader())
    assert sorted(map(tuple, good.collect()), key=str) == ROWS
    assert {r["id"]: r["reason"].split(":")[0] for r in failed.collect()} == {500: "ValueError", 501: "ArrowInvalid", 502: "ValueError"}


def test_pages_rows_become_columns_together(spark):
    df = Mock(schema=spark.createDataFrame([], "id long, html string").schema)
    df.select.return_value.mapInArrow = lambda run, schema: run
    run = pages._tried(df, "id", "html", "n long, t string", _reader())
    batches = list(run([pa.RecordBatch.from_pydict({"k": [r[0] for r in PAGES if r[0] != 501], "html": [r[1] for r in PAGES if r[0] != 501]})]))
    assert len(batches) == 3 and sum(b.num_rows for b in batches) == 1001 + 2  # two pages fail, all others' rows go together


def test_rows_of_small_files_are_spread(spark, monkeypatch):
    monkeypatch.setattr(tables, "TASK_ROWS", 50)
    assert tables.spread(spark.range(2000).coalesce(1), ["id"]).rdd.getNumPartitions() == 40


def test_listings_of_a_small_file_are_spread(spark, monkeypatch):
    from __spark_entry__ import SMOKE, queries

    monkeypatch.setattr(tables, "TASK_ROWS", 5)
    assert queries()["listing_calculator_fees"](spark, SMOKE).rdd.getNumPartitions() == 40  # of 200 parts


def test_compositions_are_dealt_and_not_broadcast(spark, monkeypatch):
    monkeypatch.setattr(tables, "TASK_ROWS", 50)
    ids = spark.range(400)
    units = ids.selectExpr("id", "'u' AS unit", "1 AS ordinal", "3.0D AS extra")
    amounts = ids.selectExpr("id", "'u' AS unit", "explode(array('1', '2')) AS expense", "1.5D AS least", "'$1.50' AS shown")
    definitions = ids.selectExpr("id", "explode(array('1', '2')) AS expense", "'Trash' AS label", "'month' AS frequency", "true AS required", "'x' AS category")
    out = disclosures.total_composition(units, amounts, definitions, "id")
    assert out.count() == 400 and "Trash ($1.50); Trash ($1.50)." in out.first()["text"]
    assert out.rdd.getNumPartitions() == 24
    assert "Broadcast" not in out._jdf.queryExecution().executedPlan().toString()
