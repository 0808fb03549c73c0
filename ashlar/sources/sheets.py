"""Workbooks (XLSX) as rows of cells, and the estimates of residents that such workbooks hold."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

CELLS = "file string, sheet_no int, sheet string, row int, col int, text string, number double"
_RELATION = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"
_DATE = r"(\d{1,2})/(\d{1,2})/(\d{4})"


def _local(tag: str) -> str:
    return tag.rsplit("}", 1)[-1]


def _texts(book: zipfile.ZipFile) -> list[str]:
    """The texts that cells share. A run of text may be cut into pieces; phonetic hints aren't part of it."""
    if "xl/sharedStrings.xml" not in book.namelist():
        return []
    out = []
    with book.open("xl/sharedStrings.xml") as f:
        for _, e in ElementTree.iterparse(f):
            if _local(e.tag) == "si":
                out.append(_inline(e))
                e.clear()
    return out


def _inline(e) -> str:
    return "".join(t.text or "" for part in e if _local(part.tag) in ("t", "r") for t in part.iter() if _local(t.tag) == "t")


def _column(name: str) -> int:
    at = 0
    for letter in re.match(r"[A-Z]*", name)[0]:
        at = at * 26 + ord(letter) - 64
    return at - 1


def cells_of(data: bytes) -> Iterator[tuple]:
    """(sheet number, sheet, row, column, text, number) of each cell that has a value; rows from 1, columns from 0. Numbers have no text, but what is written as text has no number."""
    with zipfile.ZipFile(io.BytesIO(data)) as book:
        shared = _texts(book)
        links = {e.get("Id"): e.get("Target") for e in ElementTree.fromstring(book.read("xl/_rels/workbook.xml.rels"))}
        sheets = [e for e in ElementTree.fromstring(book.read("xl/workbook.xml")).iter() if _local(e.tag) == "sheet"]
        for k, sheet in enumerate(sheets):
            target = links[sheet.get(_RELATION)]
            row = 0
            with book.open(target.lstrip("/") if target.startswith("/") else f"xl/{target}") as f:
                col = -1
                for event, e in ElementTree.iterparse(f, events=("start", "end")):
                    tag = _local(e.tag)
                    if tag == "row":
                        if event == "start":
                            row, col = int(e.get("r") or row + 1), -1
                        else:
                            e.clear()
                    elif tag == "c" and event == "end":
                        col = _column(e.get("r")) if e.get("r") else col + 1
                        value = next((v.text for v in e if _local(v.tag) == "v"), None)
                        kind = e.get("t", "n")
                        if kind == "inlineStr":
                            text = next((_inline(v) for v in e if _local(v.tag) == "is"), None)
                            number = None
                        elif value is None:
                            continue
                        else:
                            text = shared[int(value)] if kind == "s" else None if kind == "n" else value
                            number = float(value) if kind == "n" else None
                        if text is not None or number is not None:
                            yield k, sheet.get("name"), row, col, text, number


def read_workbooks(spark: SparkSession, path: str) -> DataFrame:
    """A row for each cell with a value of each workbook at a path. A workbook is read by one task; files that are no workbook are an error."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [part.split()[0] for part in CELLS.split(",")]
        for b in batches:
            for file, data in zip(b["path"], b["content"]):
                rows = [(file, *cell) for cell in cells_of(data)]
                yield pd.DataFrame(rows, columns=names).astype({"number": "float64"})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, CELLS)


def dated_table(cells: DataFrame, prefix: str) -> DataFrame:
    """file, row, name, values (map of date to whole number): the table under the first row with dates, on the first sheet whose name starts with a prefix. Only rows with a name in the
    first column and a whole number under every date count."""
    sheet = cells.where(F.col("sheet").startswith(prefix))
    first = sheet.groupBy("file").agg(F.min("sheet_no").alias("sheet_no"))
    sheet = sheet.join(first, ["file", "sheet_no"])
    found = F.regexp_extract("text", _DATE, 0)
    day = F.try_to_date(F.concat_ws("/", F.regexp_extract("text", _DATE, 3), F.regexp_extract("text", _DATE, 1), F.regexp_extract("text", _DATE, 2)), "yyyy/M/d")
    dates = sheet.where(F.coalesce(found, F.lit("")) != "").select("file", "row", "col", day.alias("day"))
    top = dates.groupBy("file").agg(F.min("row").alias("row"))
    heads = dates.join(top, ["file", "row"]).select("file", F.col("row").alias("head"), "col", "day")
    wide = heads.groupBy("file").agg(F.count("*").alias("n"))
    whole = F.col("number").isNotNull() & (F.col("number") == F.floor("number"))
    values = sheet.where(whole).join(heads, ["file", "col"]).where("row > head").groupBy("file", "row").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("day", F.col("number").cast("long"))))).alias("values"))
    names = sheet.where("col = 0").select("file", "row", F.trim("text").alias("name")).where("name <> ''")
    return names.join(values, ["file", "row"]).join(wide, "file").where("size(values) = n").drop("n")


def population(cells: DataFrame, counties: str, cities: str, target_year: int, state: str, consolidated: tuple[str, ...] = ()) -> DataFrame:
    """as_of, state_residents, county, name, residents: of the date nearest to a year, the later of two as near. In the cities' sheet a row that equals its county's opens that county;
    `unincorporated` and the state are no cities. consolidated: counties that are their own city. A city before any county is an error, other dates on the two sheets too."""
    county, city = dated_table(cells, counties), dated_table(cells, cities)
    nearest = F.array_min(F.transform(F.map_keys("values"), lambda d: F.struct(F.abs(F.year(d) - target_year).alias("off"), (-F.year(d)).alias("late"), d.alias("day"))))["day"]
    county, city = (t.withColumn("as_of", nearest) for t in (county, city))
    known = county.select("file", F.col("name").alias("__c"), F.col("values").alias("__v"))
    entries = lambda m: F.to_json(F.map_entries(m))
    j = city.where(F.col("name") != state).join(known, (city["file"] == known["file"]) & (F.col("name") == F.col("__c")), "left").select(city["file"], "row", "name", "values", "as_of", "__v")
    same = F.coalesce(entries("values") == entries("__v"), F.lit(False))
    w = Window.partitionBy("file").orderBy("row").rowsBetween(Window.unboundedPreceding, 0)
    under = j.withColumn("__own", same).withColumn("county", F.last(F.when(F.col("__own"), F.col("name")), ignorenulls=True).over(w)).where(~F.col("__own"))
    opened = F.coalesce("county", F.raise_error(F.concat(F.lit("a city before any county: "), F.col("name"))).cast("string"))
    value: Column = F.element_at("values", F.col("as_of"))
    rows = under.select("file", "as_of", opened.alias("county"), "name", value.alias("residents")).where(F.lower("name") != "unincorporated")
    alone = county.where(F.col("name").isin(*consolidated)).select("file", "as_of", F.col("name").alias("county"), "name", value.alias("residents"))
    whole = county.where(F.col("name") == state).select("file", F.col("as_of").alias("__day"), value.alias("state_residents"))
    agreed = F.when(F.col("as_of") == F.col("__day"), F.col("as_of")).otherwise(F.raise_error(F.lit("the sheets have different dates")).cast("date"))
    return rows.unionByName(alone).join(whole, "file").select(agreed.alias("as_of"), "state_residents", "county", "name", "residents")
