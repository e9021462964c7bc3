import pytest
from pyspark.sql import functions as F

from tablelake.operators import dataset, links, reports

NUMBERED = """<table class=small><tr><td>menu</td></tr></table>
<table><caption>Table 1.&nbsp; Costs: 2003-04 and 2010-11</caption>
<tr><th rowspan=2>Item</th><th colspan=2>Total</th><th rowspan=2>Total</th><th></th></tr>
<tr><th>2003-04<sup>1</sup></th><th>2010-11</th><th></th></tr>
<tr><td>1</td><td>2</td><td>3</td><td>4</td><td></td></tr>
<tr><td>Public</td><td></td><td></td><td></td><td></td></tr>
<tr><td>&nbsp;&nbsp;All<sup>2</sup></td><td>1,000</td><td>(1.5)</td><td>†</td><td></td></tr>
<tr><td>One</td><td>5!</td><td></td><td>x</td><td></td><td>beyond</td></tr>
<tr><td>lonely</td></tr>
<tr><td colspan=5>dropped</td><td>x</td></tr>
<tr><td colspan=5>NOTE: a note</td><td></td></tr>
<tr><td></td><td> </td></tr>
</table><table class="Notes"><tr><td>SOURCE: IPEDS</td></tr><tr><td></td></tr></table>"""
PLAIN = """<table><tr><th>Year</th><th>Count</th></tr>
<tr><td>Fall 1999</td><td>1</td></tr><tr><td>2005-06</td><td>2</td></tr><tr><td>2006</td><td>3</td></tr>
<tr><td>2007</td><td>4</td></tr><tr><td>other</td><td>5</td></tr><tr><td>SOURCE: Integrated Postsecondary.</td></tr></table>"""
SNAPSHOT = """<table><caption>Kinds: Fall 2021 and 1990</caption><tr><th>Kind</th><th>Count</th></tr><tr><td>a</td><td>1</td></tr>
<tr><td>b</td><td>2</td></tr><tr><td>SOURCE: {}</td></tr></table>"""
PAGES = {
    "numbered": NUMBERED, "plain": PLAIN, "snapshot": SNAPSHOT.format("IPEDS"), "mixed": SNAPSHOT.format("IPEDS, HSLS"),
    "old": SNAPSHOT.format("IPEDS").replace("2021", "1991"), "short": "<table><tr><td>1</td></tr></table>", "empty": "",
    "broken": SNAPSHOT.format("IPEDS").replace("<td>b", "<td colspan=all>b"),
    "broken later": SNAPSHOT.format("IPEDS").replace("<td>2", "<td colspan=all>2"),
}


@pytest.fixture(scope="module")
def pages(spark):
    return spark.createDataFrame([(k, v, f"title of {k}") for k, v in PAGES.items()],
                                 "page_key string, html string, fallback_title string")


@pytest.fixture(scope="module")
def built(pages):
    return reports.build_reports(pages)


def test_outcomes(built):
    got = {r["page_key"]: r["status"] for r in built.outcomes.collect()}
    assert got == {
        "numbered": "written", "plain": "written", "snapshot": "written", "broken later": "written", "mixed": "other source",
        "old": "no data in range", "short": "failed", "empty": "failed", "broken": "failed"}


def test_numbered_table(built):
    row = built.reports.where("page_key = 'numbered'").head()
    # The second `Total` is renamed, the out-of-range column and the spacer go.
    assert row["columns"] == ["Item", "Total | 2010-11", "Total"]
    assert row["title"] == "Table 1. Costs: 2003-04 and 2010-11"
    assert row["footnotes"] == ["lonely", "NOTE: a note", "SOURCE: IPEDS"]
    assert (row["year_axis"], row["years"], row["dropped_rows"], row["dropped_columns"], row["row_count"]) == (
        "columns", [2010], 0, 1, 2)
    records = [(r["section"], r["indent"], r["row_label"], [(c["col_index"], c["value"]["num"], c["value"]["text"]) for c in r["cells"]])
               for r in row["records"]]
    assert records == [("Public", 1, "All", [(1, 1.5, None), (2, None, "†")]), ("Public", 0, "One", [(1, None, None), (2, None, "x")])]


def test_row_years(built):
    row = built.reports.where("page_key = 'plain'").head()
    assert (row["title"], row["year_axis"], row["years"], row["dropped_rows"]) == ("title of plain", "rows", [2005, 2006, 2007], 1)
    # The first row after the header is data.
    assert [r["row_label"] for r in row["records"]] == ["2005-06", "2006", "2007", "other"]


def test_everything_kept_on_request(pages):
    built = reports.build_reports(pages, target=None, lo=None, hi=None, max_rows=1)
    rows = {r["page_key"]: r for r in built.reports.collect()}
    assert set(rows) == {"numbered", "plain", "snapshot", "mixed", "old", "broken later"}
    assert rows["plain"]["row_count"] == 5 and len(rows["plain"]["records"]) == 1
    assert rows["numbered"]["columns"] == ["Item", "Total | 2003-04", "Total | 2010-11", "Total"]
    assert rows["mixed"]["source_surveys"] == ["IPEDS", "HSLS"] and rows["mixed"]["year_axis"] == "none"


def test_repeated_column_names(spark):
    heads = spark.createDataFrame([(list("abaa"),), ([],)], "names array<string>")
    got = [r["names"] for r in heads.select(reports.dedupe_names(F.col("names")).alias("names")).collect()]
    assert got == [["a", "b", "a (2)", "a (3)"], []]


def test_links(spark):
    html = """<ul><li><a>Chapter 2. No</a><ul><li><a href="d22/tables/dt22_201.10.asp">Table 201.10</a> no</li></ul></li>
    <li><a>Chapter 3. Schools.</a><ul>
      <li><a href="/programs/digest/d20/tables/dt20_301.10.asp?current=yes">Table 301.10.</a> First: 2020</li>
      <li><a href="http://10.1.1.1/programs/digest/d21/tables/DT21_302.5.asp#x">T</a>  Second</li>
      <li><a href="d20/tables/dt20_301.10.asp">again</a> Third</li><li><a href="x.asp">other</a></li></ul></li></ul>"""
    df = spark.createDataFrame([("p", html)], "page_key string, html string")
    got = links.link_index(df, "https://x.org/").orderBy("table_number").collect()
    assert [(r["table_number"], r["title"], r["page_url"], r["xlsx_url"], r["edition_year"], r["chapter"]) for r in got] == [
        ("301.10", "First: 2020", "https://x.org/d20/tables/dt20_301.10.asp", "https://x.org/d20/tables/xls/tabn301.10.xls",
         "2020", "Chapter 3. Schools"),
        ("302.5", "Second", "https://x.org/d21/tables/DT21_302.5.asp", "https://x.org/d21/tables/xls/tabn302.5.xlsx",
         "2021", "Chapter 3. Schools")]


def test_absent_chapter(spark):
    df = spark.createDataFrame([("p", "<ul><li><a>Chapter 30. No</a></li></ul>"), ("q", "<a>Chapter 3</a>"), ("r", None)], "page_key string, html string")
    for key in "pqr":
        with pytest.raises(Exception, match=f"chapter 3 not found on {key}"):
            links.link_index(df.where(F.col("page_key") == key), "https://x.org/").collect()
    assert links.link_index(df, "https://x.org/", absent="skip").collect() == []


INDEX = """<ul><li><a>Chapter 3. Schools</a><ul>
  <li><a href="d20/tables/dt20_1.1.asp">Table 1.1.</a> First: 2021</li><li><a href="d20/tables/dt20_2.2.asp">Table 2.2.</a> Gone</li>
  <li><a href="d20/tables/dt20_3.3.asp">Table 3.3.</a> Old: 1990</li><li><a href="d20/tables/dt20_4.4.asp">Table 4.4.</a> Mixed: 2021</li></ul></li></ul>"""


def test_dataset(spark):
    """Links meet pages; titles fall back to the link's, and years are judged by them; a lost page fails alone."""
    url = lambda n: f"https://x.org/d20/tables/dt20_{n}.asp"
    bare = SNAPSHOT.replace("<caption>Kinds: Fall 2021 and 1990</caption>", "")
    pages = [(url("1.1"), bare.format("IPEDS")), (url("1.1"), bare.format("IPEDS")), (url("3.3"), bare.format("IPEDS")),
             (url("4.4"), bare.format("IPEDS, HSLS")), ("https://x.org/unlinked", "<table>")]
    index = spark.createDataFrame([("i", "https://x.org/i", INDEX), ("j", "https://x.org/j", INDEX)], "page_key string, url string, html string")
    table = spark.createDataFrame(pages, "url string, html string")
    built = dataset.build_dataset(index, table, "https://x.org/")
    rows = built.entries.collect()
    assert len(rows) == 2 and {r["source"]["index_url"] for r in rows} == {"https://x.org/i", "https://x.org/j"}
    r = rows[0]
    assert (r["eval_id"], r["title"], r["chapter"], r["edition_year"], r["years"], r["year_axis"], r["row_count"], tuple(r["dropped"])) == (
        "digest_1.1", "First: 2021", "Chapter 3. Schools", "2020", [2021], "table", 2, (0, 0))
    assert r["source"]["xlsx_url"] == "https://x.org/d20/tables/xls/tabn1.1.xls" and r["footnotes"] == ["SOURCE: IPEDS"]
    assert {(r["table_number"], r["status"], r["detail"]) for r in built.outcomes.collect()} == {
        ("1.1", "written", "IPEDS"), ("2.2", "failed", "page not found"), ("3.3", "no data in range", "IPEDS"), ("4.4", "other source", "IPEDS+HSLS")}
    first = dataset.build_dataset(index, table, "https://x.org/", limit=2, max_rows=1)
    assert {(r["page_key"], r["table_number"]) for r in first.outcomes.collect()} == {(p, n) for p in "ij" for n in ("1.1", "2.2")}
    assert [(r["row_count"], len(r["records"])) for r in first.entries.collect()] == [(2, 1)] * 2
    assert {r["status"]: r["n"] for r in dataset.outcome_counts(built.outcomes).collect()} == {"written": 2, "failed": 2, "no data in range": 2, "other source": 2}


def test_wide_header_fails_alone(spark, pages):
    wide = "<table>" + "<tr><th colspan=3000000>x</th></tr>" * 3 + "</table>"
    both = pages.where("page_key = 'snapshot'").unionByName(spark.createDataFrame([("wide", wide, "t")], pages.schema))
    built = reports.build_reports(both).outcomes.collect()
    assert {(r["page_key"], r["status"]) for r in built} == {("snapshot", "written"), ("wide", "failed")}


def test_copies_of_a_page_count_once(spark, pages):
    copies = pages.where("page_key = 'plain'")
    for _ in range(4):
        copies = copies.unionByName(copies)
    built = reports.build_reports(copies.unionByName(pages.where("page_key = 'snapshot'")))
    assert {r["page_key"]: (r["row_count"], len(r["records"])) for r in built.reports.collect()} == {"plain": (4, 4), "snapshot": (2, 2)}
