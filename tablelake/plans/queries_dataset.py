"""Dataset entries from index pages and table pages, and questions over them."""
from __future__ import annotations

from pyspark.sql import functions as F

from tablelake.operators import dataset, questions
from tablelake.operators.cells import index_cells
from tablelake.plans import derived
from tablelake.plans.derived import CELLS_CTE
from tablelake.plans.queries_pages import BASE_URL, rendered
from tablelake.plans.registry import query
from tablelake.session import materialise

LIMIT = 20
INDEX_URL = "https://tables.example.org/index/"


def index_pages(tables):
    """One index page for 50 report tables of a region, with a chapter of theirs, one of others, and a link without a page."""
    number = derived.table_numbers(tables)
    block = F.substring_index("table_number", ".", -1).cast("int")
    key = F.concat(F.substring("table_number", 2, 1), F.lit("-"), F.floor(block / 50).cast("string"))
    link = F.concat(F.lit('<li><a href="d22/tables/dt22_'), "table_number", F.lit('.asp?current=yes">Table '), "table_number", F.lit("</a> Linked title</li>"))
    listed = F.transform(F.array_sort(F.collect_list(F.struct(block.alias("block"), link.alias("link")))), lambda s: s["link"])
    pages = number.groupBy(key.alias("page_key")).agg(F.array_join(listed, "").alias("links"))
    lost = '<li><a href="d22/tables/dt22_99.9.asp">Table 99.9</a> Lost</li>'
    return pages.select("page_key", F.concat(F.lit(INDEX_URL), "page_key").alias("url"), F.concat(
        F.lit(f"<ul><li><a>Chapter 1. No</a><ul>{lost}</ul></li><li><a>Chapter 3.  Orders.</a><ul>{lost}"), "links", F.lit("</ul></li></ul>")).alias("html"))


def table_pages(tables):
    """The rendered report tables by URL, together with the given pages."""
    pages = rendered(tables, with_broken=True).select(
        F.concat(F.lit(f"{BASE_URL}d22/tables/dt22_"), "page_key", F.lit(".asp")).alias("url"), "html")
    return materialise(pages, "table-pages").unionByName(tables.pages.select("url", "html"))


def built(tables, limit=None):
    return dataset.build_dataset(index_pages(tables), table_pages(tables), BASE_URL, limit=limit)


_KEY = "substring(table_number, 2, 1) || '-' || CAST(CAST(floor(CAST(split_part(table_number, '.', 2) AS INT) / 50) AS INT) AS VARCHAR)"
_STATUS = """CASE WHEN CAST(split_part(table_number, '.', 2) AS INT) % 7 = 3 THEN 'failed' WHEN substring(table_number, 2, 1) = '3'
  THEN 'other source' ELSE 'written' END"""
# nth counts the tables of an index page, for queries over its first links: the link without a page comes first, so LIMIT leaves one table less.
_ENTRIES = f"""WITH {CELLS_CTE},
linked AS (SELECT *, row_number() OVER (PARTITION BY index_key ORDER BY block) AS nth FROM (
  SELECT DISTINCT table_number, title, {_KEY} AS index_key, CAST(split_part(table_number, '.', 2) AS INT) AS block, {_STATUS} AS status FROM report_rows))"""


@query("dataset_entries", f"""{_ENTRIES}
SELECT 'digest_' || l.table_number AS eval_id, l.table_number, 'Chapter 3. Orders' AS chapter, '2022' AS edition_year, l.title,
  '{INDEX_URL}' || index_key AS index_url, '{BASE_URL}d22/tables/dt22_' || l.table_number || '.asp' AS page_url,
  '{BASE_URL}d22/tables/xls/tabn' || l.table_number || '.xlsx' AS xlsx_url, 'IPEDS' AS surveys, '2004,2005,2006,2007,2008,2009' AS years, 'columns' AS year_axis,
  0 AS dropped_rows, 2 AS dropped_columns, 13 AS n_columns, r.row_count, 2 AS n_notes, s.row_index, s.section, s.row_label, s.indent,
  s.col_index, s.column_name, s.num, s.txt
FROM linked l JOIN (SELECT table_number, count(*) AS row_count FROM report_rows GROUP BY table_number) r ON r.table_number = l.table_number
JOIN (SELECT n.table_number, n.row_index, n.section, n.row_label, n.indent, CAST(CASE WHEN c.col_index < 8 THEN c.col_index - 1 ELSE c.col_index - 2 END AS INT) AS col_index,
        c.column_name, coalesce(c.num, -1) AS num, CASE WHEN c.raw = '' THEN '#' ELSE coalesce(c.txt, '') END AS txt
      FROM report_rows n JOIN cells c ON c.table_number = n.table_number AND c.row_index = n.row_index WHERE c.column_name NOT LIKE '%2003-04') s
  ON s.table_number = l.table_number
WHERE l.status = 'written'""")
def dataset_entries(tables):
    entries = built(tables).entries
    told = entries.select(
        "eval_id", "table_number", "chapter", "edition_year", "title", "source.*", F.array_join("source_surveys", "+").alias("surveys"),
        F.array_join(F.col("years").cast("array<string>"), ",").alias("years"), "year_axis", F.col("dropped.rows").alias("dropped_rows"),
        F.col("dropped.columns").alias("dropped_columns"), F.size("columns").alias("n_columns"), "row_count", F.size("footnotes").alias("n_notes"),
        F.explode("records").alias("r"))
    head = [c for c in told.columns if c != "r"]
    cells = told.select(*head, "r.row_index", "r.section", "r.row_label", "r.indent", F.explode("r.cells").alias("c"))
    return cells.select(*head, "row_index", "section", "row_label", "indent", "c.col_index", "c.column_name",
                        F.coalesce("c.value.num", F.lit(-1.0)).alias("num"), F.coalesce("c.value.text", F.lit("")).alias("txt")).where("num <> -1 or txt <> ''")


@query("dataset_outcomes", f"""{_ENTRIES}
SELECT index_key AS page_key, table_number, '{BASE_URL}d22/tables/dt22_' || table_number || '.asp' AS page_url, status,
  CASE status WHEN 'failed' THEN 'span is not a number' WHEN 'written' THEN 'IPEDS' ELSE 'IPEDS+CPS' END AS detail FROM linked WHERE nth < {LIMIT}
UNION ALL SELECT DISTINCT index_key, '99.9', '{BASE_URL}d22/tables/dt22_99.9.asp', 'failed', 'page not found' FROM linked""")
def dataset_outcomes(tables):
    out = built(tables, LIMIT).outcomes
    return out.select("page_key", "table_number", "page_url", "status", F.regexp_replace("detail", r" in row \d+$", "").alias("detail"))


@query("pages_to_questions", f"""{_ENTRIES},
kept AS (SELECT * FROM cells WHERE column_name NOT LIKE '%2003-04')
SELECT 'digest_' || u.table_number || '::lookup::r' || lpad(CAST(u.row_index AS VARCHAR), 4, '0') || '::c'
    || lpad(CAST(CASE WHEN u.col_index < 8 THEN u.col_index - 1 ELSE u.col_index - 2 END AS VARCHAR), 2, '0') AS id,
  u.table_number, '2022' AS edition_year, coalesce(u.num, -1) AS answer_num, coalesce(u.txt, '') AS answer_label
FROM usable u JOIN linked l ON l.table_number = u.table_number WHERE l.status = 'written' AND u.column_name NOT LIKE '%2003-04'""")
def pages_to_questions(tables):
    """The whole way: index pages, table pages, entries, cells, questions."""
    cells = index_cells(dataset.entry_records(built(tables).entries))
    asked = questions.lookup_candidates(cells)
    return asked.select("id", "table_number", "edition_year", F.coalesce("answer_num", F.lit(-1.0)).alias("answer_num"),
                        F.coalesce("answer_label", F.lit("")).alias("answer_label"))
