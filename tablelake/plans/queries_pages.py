"""Report tables and link lists taken out of HTML pages.

Report pages are rendered from the derived report, one page per table, and
read back; the oracle is the report itself. The given pages, which hold no
report tables, run along.
"""
from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tablelake.functions.pages import page_key
from tablelake.operators import links, reports
from tablelake.plans import derived
from tablelake.plans.derived import CELLS_CTE
from tablelake.plans.registry import query
from tablelake.session import materialise
from tablelake.sources.html import extract_tables

PAGE = reports.PAGE
_YEARS = [f"{y}-{(y + 1) % 100:02d}" for y in range(2003, 2010)]
_COLUMNS = [f"{u} | {y}" for u in ("Urgent", "Reg- ular") for y in _YEARS]
# Region 0 has no column-number row, region 3 cites a second survey, region 4
# names its source in a table of its own. Some pages can have a broken span.
_HEAD = (
    '<tr><th rowspan="2">Item</th><th colspan="7">Urgent</th><th colspan=7>Reg- ular</th><th rowspan=2> </th></tr><tr>'
    + "".join(f"<th>{y}<sup>1</sup></th>" for y in _YEARS * 2) + "</tr>"
)
_NUMBERS = "<tr>" + "".join(f"<td>{i}</td>" for i in range(1, 16)) + "<td></td></tr>"
_HEADING_TAIL = "<td></td>" * 15 + "</tr>"


def rendered(tables, with_broken: bool = False):
    """`(page_key, html, fallback_title)`, one page per derived report table."""
    rows = derived.report_lines(tables, lambda raw: F.when(raw == "", "#").otherwise(raw).alias("raw")).withColumn(
        "by_column", F.map_from_entries(F.transform("cells", lambda c: F.struct(c["col_index"], c["raw"]))))
    values = F.transform(F.sequence(F.lit(1), F.lit(14)), lambda i: F.concat(
        F.lit("<td>"), F.coalesce(F.try_element_at("by_column", i), F.lit("")), F.lit("</td>")))
    line = F.concat(F.lit("<tr>\n<td>\t"), F.repeat(F.lit("&nbsp;"), F.col("indent") * 2), F.col("row_label"),
                    F.lit("<sup>\\2\\</sup></td>"), F.array_join(values, ""), F.lit("<td colspan=wide></td></tr>"))
    first = F.col("row_index") == F.min("row_index").over(
        Window.partitionBy("r_regionkey", "block", "section"))
    head = F.when(first, F.concat(F.lit("<tr><td><b>"), F.col("section"), F.lit("</b></td>"), F.lit(_HEADING_TAIL))).otherwise("")
    pages = rows.select("r_regionkey", "block", "table_number", "title", "row_index", F.concat(head, line).alias("line")).groupBy(
        "r_regionkey", "block", "table_number", "title").agg(F.array_join(F.transform(
            F.array_sort(F.collect_list(F.struct("row_index", "line"))), lambda s: s["line"]), "").alias("body"))
    region = F.substring("table_number", 2, 1)
    cited = F.when(region == "3", "IPEDS; Current Population Survey").otherwise("Integrated Postsecondary Data")
    source = F.concat(F.lit("SOURCE: "), cited)
    broken = F.substring_index("table_number", ".", -1).cast("int") % 7 == 3
    return pages.select(
        F.col("table_number").alias(PAGE),
        F.concat(
            F.lit('<html><body><table class="nav"><tr><td>Home<br>page</td></tr></table><script>var t = "<td>";</script>'
                  '<table class="data"><caption>'), F.regexp_replace("title", r"\. ", ".&nbsp; "), F.lit("</caption>"),
            F.lit(_HEAD), F.when(region == "0", "").otherwise(_NUMBERS), F.col("body"),
            F.lit('<tr><td colspan="16">NOTE: Sums of orders.</td></tr><tr><td></td></tr>'),
            F.when(region == "4", "").otherwise(F.concat(F.lit("<tr><td colspan=20>"), source, F.lit("</td></tr>"))),
            F.when(broken, "<tr><td colspan=wide>x</td><td></td></tr>").otherwise("") if with_broken else F.lit(""),
            F.lit("</table>"),
            F.when(region == "4", F.concat(F.lit('<table class="small FootNotes"><tr><td>'), source, F.lit("</td></tr></table>")))
            .otherwise(""), F.lit("</body></html>")).alias("html"),
        F.lit("untitled").alias("fallback_title"),
    )


def split(tables):
    return reports.split_header(reports.main_table(extract_tables(rendered(tables))))


def laid_out(tables):
    return reports.split_footnotes(reports.header_names(split(tables)))


_WHOLE = """CAST(split_part(table_number, '.', 2) AS INT) % 7 <> 3"""
_FIRST = "CASE WHEN substring(table_number, 2, 1) = '0' THEN 2 ELSE 3 END"
_LINES = f"""{CELLS_CTE},
numbered AS (SELECT *, {_FIRST} + row_index + dense_rank() OVER (PARTITION BY table_number ORDER BY section) AS line
             FROM report_rows)"""


_SOURCE_TEXT = """'SOURCE: ' || CASE substring(table_number, 2, 1) WHEN '3' THEN 'IPEDS; Current Population Survey'
  ELSE 'Integrated Postsecondary Data' END"""


@query("html_cells", f"""WITH {_LINES},
t AS (SELECT table_number, max(line) AS tail, substring(table_number, 2, 1) AS region FROM numbered GROUP BY table_number),
headings AS (SELECT table_number, section, min(line) - 1 AS line FROM numbered GROUP BY table_number, section),
every (table_number, table_pos, row_idx, cell_idx, tag, colspan, rowspan, full_text, text, indent) AS (
  SELECT table_number, 0, 0, 0, 'td', 1, 1, 'Home page', 'Home page', 0 FROM t
  UNION ALL SELECT table_number, 1, 0, i, 'th', c, r, x, x, 0 FROM t, (VALUES (0, 1, 2, 'Item'), (1, 7, 1, 'Urgent'), (2, 7, 1, 'Reg- ular'), (3, 1, 2, '')) v(i, c, r, x)
  UNION ALL SELECT table_number, 1, 1, i, 'th', 1, 1, y || ' 1', y, 0
    FROM t, (SELECT i, CAST(2003 + i % 7 AS VARCHAR) || '-' || lpad(CAST(4 + i % 7 AS VARCHAR), 2, '0') AS y FROM range(14) r(i))
  UNION ALL SELECT table_number, 1, 2, i, 'td', 1, 1, x, x, 0 FROM t, (SELECT i, CASE WHEN i < 15 THEN CAST(i + 1 AS VARCHAR) ELSE '' END AS x FROM range(16) r(i)) WHERE region <> '0'
  UNION ALL SELECT table_number, 1, line, i, 'td', 1, 1, CASE i WHEN 0 THEN section ELSE '' END, CASE i WHEN 0 THEN section ELSE '' END, 0 FROM headings, range(16) r(i)
  UNION ALL SELECT table_number, 1, line, 0, 'td', 1, 1, row_label || ' \\2\\', row_label, indent FROM numbered
  UNION ALL SELECT n.table_number, 1, n.line, i, 'td', 1, 1, coalesce(CASE c.raw WHEN '' THEN '#' ELSE c.raw END, ''), coalesce(CASE c.raw WHEN '' THEN '#' ELSE c.raw END, ''), 0
    FROM numbered n CROSS JOIN range(1, 15) r(i) LEFT JOIN cells c ON c.table_number = n.table_number AND c.row_index = n.row_index AND c.col_index = i
  UNION ALL SELECT table_number, 1, line, 15, 'td', -1, 1, '', '', 0 FROM numbered
  UNION ALL SELECT table_number, 1, tail + 1, 0, 'td', 16, 1, 'NOTE: Sums of orders.', 'NOTE: Sums of orders.', 0 FROM t
  UNION ALL SELECT table_number, 1, tail + 2, 0, 'td', 1, 1, '', '', 0 FROM t
  UNION ALL SELECT table_number, 1, tail + 3, 0, 'td', 20, 1, {_SOURCE_TEXT}, {_SOURCE_TEXT}, 0 FROM t WHERE region <> '4'
  UNION ALL SELECT table_number, 2, 0, 0, 'td', 1, 1, {_SOURCE_TEXT}, {_SOURCE_TEXT}, 0 FROM t WHERE region = '4')
SELECT table_number AS page_key, CAST(table_pos AS INT) AS table_pos, CAST(row_idx AS INT) AS row_idx, CAST(cell_idx AS INT) AS cell_idx, tag, CAST(colspan AS INT) AS colspan,
  CAST(rowspan AS INT) AS rowspan, full_text, text, CAST(indent AS INT) AS indent FROM every""")
def html_cells(tables):
    each = extract_tables(rendered(tables)).select(PAGE, F.explode("tables").alias("t"))
    rows = each.select(PAGE, F.col("t.pos").alias("table_pos"), F.explode("t.rows").alias("r"))
    cells = rows.select(PAGE, "table_pos", F.col("r.idx").alias("row_idx"), F.posexplode("r.cells").alias("cell_idx", "c"))
    return cells.select(PAGE, "table_pos", "row_idx", "cell_idx", "c.tag", F.coalesce("c.colspan", F.lit(-1)).alias("colspan"),
                        F.coalesce("c.rowspan", F.lit(-1)).alias("rowspan"), "c.full_text", "c.text", "c.indent")


@query("largest_table", f"""WITH {_LINES}
SELECT table_number AS page_key, 1 AS table_pos, CAST(count(*) + count(DISTINCT section) + {_FIRST} + 2
  + CASE WHEN substring(table_number, 2, 1) = '4' THEN 0 ELSE 1 END AS INT) AS n_rows
FROM numbered GROUP BY table_number""")
def largest_table(tables):
    found = reports.main_table(extract_tables(rendered(tables)))
    return found.select(PAGE, F.col("main.pos").alias("table_pos"), F.size("main.rows").alias("n_rows"))


@query("header_split", f"""WITH {_LINES}
SELECT DISTINCT table_number AS page_key, 2 AS split_at, {_FIRST} AS body_from FROM numbered""")
def header_split(tables):
    return split(tables).select(PAGE, "split_at", "body_from")


_COLUMN_VALUES = ", ".join(f"({i}, '{c}')" for i, c in enumerate(["Item", *_COLUMNS, "col_16"]))


@query("header_paths", f"""WITH {_LINES}
SELECT table_number AS page_key, col_index, column_name
FROM (SELECT DISTINCT table_number FROM numbered), (VALUES {_COLUMN_VALUES}) v(col_index, column_name)""")
def header_paths(tables):
    return reports.header_names(split(tables)).select(PAGE, F.posexplode("columns").alias("col_index", "column_name"))


@query("split_footnotes", f"""WITH {_LINES}, t AS (SELECT DISTINCT table_number FROM numbered)
SELECT table_number AS page_key, 0 AS at, 'NOTE: Sums of orders.' AS text, 'note' AS half FROM t
UNION ALL SELECT table_number, 1, {_SOURCE_TEXT}, 'note' FROM t WHERE substring(table_number, 2, 1) <> '4'
UNION ALL SELECT table_number, CAST(line - {_FIRST} AS INT), row_label, 'data' FROM numbered
UNION ALL SELECT table_number, CAST(min(line) - 1 - {_FIRST} AS INT), section, 'data' FROM numbered GROUP BY table_number, section""")
def split_footnotes(tables):
    """Both halves of a page in one array, so that no page is read twice."""
    line = lambda at, text, half: F.struct(at.alias("at"), text.alias("text"), F.lit(half).alias("half"))
    notes = F.transform("notes", lambda text, i: line(i, text, "note"))
    data = F.transform("data", lambda r, i: line(i, r["cells"][0]["text"], "data"))
    return laid_out(tables).select(PAGE, F.inline(F.concat(notes, data)))


@query("note_tables", f"""WITH {_LINES}
SELECT DISTINCT table_number AS page_key, 'NOTE: Sums of orders.' || ' // ' || {_SOURCE_TEXT} AS footnotes FROM numbered""")
def note_tables(tables):
    return laid_out(tables).select(PAGE, F.array_join(F.concat("notes", "other_notes"), " // ").alias("footnotes"))


@query("report_records", f"""WITH {_LINES}
SELECT n.table_number AS page_key, n.row_index, n.section, n.indent, n.row_label, c.col_index, c.column_name,
  coalesce(c.num, -1) AS num, CASE WHEN c.raw = '' THEN '#' ELSE coalesce(c.txt, '') END AS txt
FROM numbered n JOIN cells c ON c.table_number = n.table_number AND c.row_index = n.row_index""")
def report_records(tables):
    rows = reports.build_records(laid_out(tables)).select(PAGE, F.explode("records").alias("r")).select(PAGE, "r.*")
    cells = rows.select(PAGE, "row_index", "section", "indent", "row_label", F.explode("cells").alias("c"))
    return cells.select(
        PAGE, "row_index", "section", "indent", "row_label", "c.col_index", "c.column_name",
        F.coalesce("c.value.num", F.lit(-1.0)).alias("num"), F.coalesce("c.value.text", F.lit("")).alias("txt"),
    ).where("num <> -1 or txt <> ''")


def _all_pages(tables):
    given = tables.pages.select(page_key(F.col("url")).alias(PAGE), "html", F.col("url").alias("fallback_title"))
    return materialise(rendered(tables, with_broken=True), "rendered-pages").unionByName(given)



@query("build_report_dataset", f"""WITH {_LINES},
kept AS (SELECT n.table_number, n.title, count(*) AS row_count, min(n.row_index) AS low FROM numbered n
         WHERE substring(n.table_number, 2, 1) <> '3' AND {_WHOLE.replace("table_number", "n.table_number")} GROUP BY ALL)
SELECT k.table_number AS page_key, k.title, 'IPEDS' AS surveys, 'columns' AS year_axis, '2004,2005,2006,2007,2008,2009' AS years,
  0 AS dropped_rows, 2 AS dropped_columns, 13 AS n_columns, k.row_count, s.n_values, s.total, 2 AS n_notes
FROM kept k JOIN (
  SELECT table_number, count(*) AS n_values, round(CAST(sum(CAST(num AS DECIMAL(18,2))) AS DOUBLE), 2) AS total FROM cells
  WHERE column_name NOT LIKE '%2003-04' GROUP BY table_number) s ON s.table_number = k.table_number""")
def build_report_dataset(tables):
    built = reports.build_reports(_all_pages(tables)).reports
    values = F.flatten(F.transform("records", lambda r: F.transform(r["cells"], lambda c: c["value"])))
    given = F.filter("values", lambda v: v["num"].isNotNull() | v["text"].isNotNull())
    cents = F.aggregate("values", F.lit(0).cast("decimal(30,2)"), lambda total, v: (
        total + F.coalesce(v["num"], F.lit(0.0)).cast("decimal(18,2)")).cast("decimal(30,2)"))
    return built.withColumn("values", values).select(
        PAGE, "title", F.array_join("source_surveys", "+").alias("surveys"), "year_axis",
        F.array_join(F.col("years").cast("array<string>"), ",").alias("years"), "dropped_rows", "dropped_columns",
        F.size("columns").alias("n_columns"), "row_count", F.size(given).cast("bigint").alias("n_values"),
        F.round(cents.cast("double"), 2).alias("total"), F.size("footnotes").alias("n_notes"))


@query("page_outcomes", f"""WITH {CELLS_CTE}, t AS (SELECT DISTINCT table_number FROM report_rows)
SELECT status, count(*) AS n FROM (
  SELECT CASE WHEN NOT {_WHOLE} THEN 'failed' WHEN substring(table_number, 2, 1) = '3' THEN 'other source' ELSE 'written' END AS status FROM t
  UNION ALL SELECT 'failed' FROM (SELECT DISTINCT url FROM pages) u) GROUP BY status""")
def page_outcomes(tables):
    return reports.build_reports(_all_pages(tables)).outcomes.groupBy("status").agg(F.count(F.lit(1)).alias("n"))


# ---- link lists ---------------------------------------------------------------------
BASE_URL = "https://tables.example.org/"


def index_pages(tables):
    """Each given page with two chapters of table links in front of its own links."""
    number = F.col("page_id").cast("string")
    link = lambda edition, n, query="": F.concat(
        F.lit(f'<li><a href="d{edition}/tables/dt{edition}_30'), n, F.lit(f'.asp{query}">Table 30'), n, F.lit("</a> Title of "),
        n, F.lit("</li>"))
    far = F.concat(F.lit('<li>See <a href="http://10.0.0.1/programs/digest/d19/tables/dt19_20'), number,
                   F.lit('.15.asp?current=yes">Table 20</a></li>'))
    return tables.pages.select(
        page_key(F.col("url")).alias(PAGE), "page_id",
        F.concat(
            F.lit("<ul><li><a href='#'>Chapter 1. Other</a><ul>"), link(22, F.lit("1.10")), F.lit("</ul></li>"),
            F.lit("<li><a href='#'>Chapter 3.  Level of <i>schools</i>.</a><ul>"), link(22, F.concat(number, F.lit(".10")), "?current=yes"),
            link(22, F.concat(number, F.lit(".10"))), far, F.lit("<li><a href='/notes.asp'>notes</a></li></ul></li></ul>"),
            F.col("html")).alias("html"))


@query("link_index", f"""
SELECT substring(sha256(url), 1, 16) || '.html' AS page_key, '30' || page_id || '.10' AS table_number, 'Title of ' || page_id || '.10' AS title,
  '{BASE_URL}d22/tables/dt22_30' || page_id || '.10.asp' AS page_url, '{BASE_URL}d22/tables/xls/tabn30' || page_id || '.10.xlsx' AS xlsx_url,
  '2022' AS edition_year, 'Chapter 3. Level of schools ' AS chapter FROM (SELECT url, min(page_id) AS page_id FROM pages GROUP BY url) p
UNION ALL
SELECT substring(sha256(url), 1, 16) || '.html', '20' || page_id || '.15', 'See Table 20',
  '{BASE_URL}d19/tables/dt19_20' || page_id || '.15.asp', '{BASE_URL}d19/tables/xls/tabn20' || page_id || '.15.xls',
  '2019', 'Chapter 3. Level of schools ' FROM (SELECT url, min(page_id) AS page_id FROM pages GROUP BY url) p""")
def link_index(tables):
    """Of pages with one URL the first counts."""
    return links.link_index(index_pages(tables), BASE_URL, first="page_id").drop("anchor_pos")
