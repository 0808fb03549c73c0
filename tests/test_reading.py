import io
import zipfile
from datetime import date

import pytest
from pyspark.sql import functions as F

from ashlar.sources import pages, replay, sheets


def test_redirects_tries_and_blocks(spark):
    ok = "text"
    recorded = spark.createDataFrame([
        ("http://a/1", 1, 302, "/2", None), ("http://a/2", 1, 301, "3", None), ("http://a/3", 1, 200, None, ok), ("http://a/loop", 1, 302, "http://a/loop", None),
        ("http://b/1", 1, 500, None, None), ("http://b/1", 2, None, None, None), ("http://b/1", 3, 200, None, ok), ("http://b/1", 4, 404, None, None), ("http://b/2", 1, None, None, None),
        ("http://c/1", 1, 200, None, "x px-captcha"), ("http://c/2", 1, 200, None, ok), ("http://d/1", 1, 302, "http://ratelimited.x/", None), ("http://e/1", 1, 202, None, ok), ("http://f/1", 1, 302, "//f2/x", None)],
        "url string, attempt int, status int, location string, body string")
    asked = ["http://a/1", "http://a/loop", "http://b/1", "http://b/2", "http://c/2", "http://c/1", "http://c/2", "http://d/1", "http://e/1", "http://f/1", None, "http://none/", "http://a/3"]
    requests = spark.createDataFrame([(k, u, "kept") for k, u in enumerate(asked)], "ordinal int, url string, status_note string")
    got = {r.ordinal: (r.outcome, r.reason, r.final_url, r.calls) for r in replay.fetch_recorded(requests, recorded).collect()}
    assert got == {
        0: ("ok", None, "http://a/3", 3), 1: ("failed", "too many redirects", "http://a/loop", 5), 2: ("ok", None, "http://b/1", 3), 3: ("failed", "no connection", "http://b/2", 1), 4: ("ok", None, "http://c/2", 1),
        5: ("blocked", "challenge", "http://c/1", 1), 6: ("skipped", "blocked earlier", None, 0), 7: ("blocked", "redirected to http://ratelimited.x/", "http://ratelimited.x/", 1), 8: ("blocked", "HTTP 202", "http://e/1", 1),
        9: ("failed", "redirect to another host", "http://f2/x", 1), 10: ("failed", "no connection", None, 3), 11: ("failed", "no connection", "http://none/", 3), 12: ("ok", None, "http://a/3", 1)}
    assert replay.fetch_recorded(requests.limit(0), recorded).collect() == []


def test_robots_groups(spark):
    text = "User-agent: botanist\nDisallow: /\nUser-agent: mybot\n\nUser-agent: *\nCrawl-delay: 3\nDisallow: /x"
    rules = pages.robots_rules(spark.createDataFrame([("h", text), ("i", "User-agent: MyBot\nSitemap: z\n"), ("j", "User-agent: mybot\nDisallow:\nUser-agent: *\nDisallow: /")], "host string, text string"), "host", "text", "mybot/1.0 (x)")
    assert sorted(map(tuple, rules.collect())) == [("h", False, "/x")]


def test_robots_by_status(spark):
    df = spark.createDataFrame([(200,), (404,), (503,)], "status int")
    assert [r[0] for r in df.select(replay.robots_by_status(df)).collect()] == [None, True, False]


def _workbook(sheets_xml: dict[str, str], shared: list[str]) -> bytes:
    main, rel = "http://schemas.openxmlformats.org/spreadsheetml/2006/main", "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook xmlns="{main}" xmlns:r="{rel}"><sheets>' + "".join(f'<sheet name="{n}" sheetId="{k}" r:id="r{k}"/>' for k, n in enumerate(sheets_xml)) + "</sheets></workbook>")
        z.writestr("xl/_rels/workbook.xml.rels", "<Relationships>" + "".join(f'<Relationship Id="r{k}" Target="worksheets/s{k}.xml"/>' for k in range(len(sheets_xml))) + "</Relationships>")
        z.writestr("xl/sharedStrings.xml", f'<sst xmlns="{main}">' + "".join(f"<si><r><t>{s[:1]}</t></r><r><t>{s[1:]}</t></r><rPh><t>no</t></rPh></si>" for s in shared) + "</sst>")
        for k, x in enumerate(sheets_xml.values()):
            z.writestr(f"xl/worksheets/s{k}.xml", f'<worksheet xmlns="{main}"><sheetData>{x}</sheetData></worksheet>')
    return out.getvalue()


def test_workbook(spark, tmp_path):
    shared = ["1/1/2025", "All", "North", " Town ", "unincorporated"]

    def row(n, name, *values):
        return f'<row r="{n}"><c r="A{n}" t="s"><v>{name}</v></c>' + "".join(f'<c r="{"BC"[k]}{n}"><v>{v}</v></c>' for k, v in enumerate(values)) + "</row>"

    head = '<row r="2"><c r="B2" t="s"><v>0</v></c><c t="inlineStr"><is><t>on 1/1/2026</t></is></c></row>'
    county = head + row(3, 1, 100, 110) + row(4, 2, 50, 55)
    city = head + row(3, 1, 100, 110) + row(4, 2, 50, 55) + row(5, 3, 20, 25) + row(6, 4, 30, 30) + row(7, 3, 1.5, 2) + row(8, 3, 9)
    (tmp_path / "a.xlsx").write_bytes(_workbook({"About": '<row r="1"><c r="AB1"><v>7</v></c></row>', "CountyState 1": county, "CityCounty 1": city}, shared))
    cells = sheets.read_workbooks(spark, str(tmp_path / "*.xlsx"))
    assert [tuple(r)[1:] for r in cells.where("sheet_no = 0").collect()] == [(0, "About", 1, 27, None, 7.0)]
    assert cells.where("col = 0 and sheet_no = 2 and row = 5").first().text == " Town "
    got = sheets.population(cells, "County", "City", 2030, "All", ("North",))
    assert sorted(map(tuple, got.collect())) == [(date(2026, 1, 1), 110, "North", "North", 55), (date(2026, 1, 1), 110, "North", "Town", 25)]
    lost = cells.where(~((F.col("sheet_no") == 2) & (F.col("row") == 4)))
    with pytest.raises(Exception, match="a city before any county"):
        sheets.population(lost, "County", "City", 2030, "All").collect()
