"""Test inputs derived from the given tables.

The SQL here is read by both engines, so it is limited to what both accept. Report tables, which are the largest, have a Spark form of their own.
Everything grows with the tables it is derived from. A report table covers
300 customers of one region, and its cells are sums over fixed breakdowns, so
each table stays small while their number grows.
"""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tablelake.functions.values import parse_value
from tablelake.session import materialise

# ---- hierarchical report cells -------------------------------------------
# Years are moved into 2003-2009, so that some fall outside the covered range.
REPORT_SQL = """
WITH base AS (
  SELECT r.r_regionkey, r.r_name, n.n_name, c.c_mktsegment,
         CAST(floor(c.c_custkey / 300) AS BIGINT) AS block,
         CASE o.o_orderstatus WHEN 'O' THEN 'Open' WHEN 'F' THEN 'Filled' ELSE 'Pending' END AS section,
         CASE WHEN o.o_orderpriority < '3' THEN 'Urgent' ELSE 'Reg- ular' END AS urgency,
         CAST(year(o.o_orderdate) AS INT) + 8 AS y, CAST(o.o_totalprice AS DECIMAL(18,2)) AS price
  FROM orders o JOIN customer c ON c.c_custkey = o.o_custkey
  JOIN nation n ON n.n_nationkey = c.c_nationkey
  JOIN region r ON r.r_regionkey = n.n_regionkey),
g AS (
  SELECT r_regionkey, block, section, urgency, y, r_name, n_name, c_mktsegment,
         CAST(grouping(r_name) + grouping(n_name) + grouping(c_mktsegment) AS INT) AS lvl, sum(price) AS total
  FROM base
  GROUP BY GROUPING SETS ((r_regionkey, block, section, urgency, y), (r_regionkey, block, section, urgency, y, r_name),
    (r_regionkey, block, section, urgency, y, r_name, n_name),
    (r_regionkey, block, section, urgency, y, r_name, n_name, c_mktsegment))),
named AS (
  SELECT '3' || CAST(r_regionkey AS STRING) || '.' || CAST(block AS STRING) AS table_number, r_regionkey, section,
         CASE lvl WHEN 3 THEN 'Total' WHEN 2 THEN r_name WHEN 1 THEN n_name ELSE c_mktsegment END AS row_label,
         CASE lvl WHEN 3 THEN 2 WHEN 2 THEN 0 WHEN 1 THEN 1 ELSE 2 END AS indent,
         coalesce(r_name, '') || '/' || coalesce(n_name, '') || '/' || coalesce(c_mktsegment, '') AS sort_key,
         urgency || ' | ' || CAST(y AS STRING) || '-' || lpad(CAST((y + 1) % 100 AS STRING), 2, '0') AS column_name,
         CASE urgency WHEN 'Urgent' THEN 1 ELSE 8 END + y - 2003 AS col_index,
         CAST(total AS DECIMAL(18,2)) AS total, CAST(total * 100 AS BIGINT) AS cents
  FROM g)
SELECT table_number,
       'Table ' || table_number || '. ' || CASE r_regionkey WHEN 0 THEN 'Number' WHEN 1 THEN 'Percent change' WHEN 2
         THEN 'Dollars' WHEN 3 THEN 'Ratio' ELSE 'Value' END ||
         ' of orders, by nation and mar- ket: Fall 2003 and 2004-05' AS title,
       CAST(dense_rank() OVER (PARTITION BY table_number ORDER BY section, sort_key) - 1 AS INT) AS row_index,
       section, row_label, indent, CAST(col_index AS INT) AS col_index, column_name,
       CASE WHEN cents % 23 = 0 THEN '†' WHEN cents % 29 = 0 THEN '—' WHEN cents % 31 = 0 THEN ''
            WHEN cents % 37 = 0 THEN 'withheld' ELSE CAST(total AS STRING) END AS raw
FROM named"""


# The same rows for Spark, put together by table: orders go through one shuffle, by table, and rows are numbered instead of cells.
_URGENCY_SQL = "CASE WHEN o_orderpriority < '3' THEN 'Urgent' ELSE 'Reg- ular' END"
_YEAR_SQL = "CAST(year(o_orderdate) AS INT) + 8"
_ORDERS_SQL = f"""
SELECT r.r_regionkey, r.r_name, n.n_name, c.c_mktsegment, CAST(floor(c.c_custkey / 300) AS BIGINT) AS block,
       CASE o.o_orderstatus WHEN 'O' THEN 'Open' WHEN 'F' THEN 'Filled' ELSE 'Pending' END AS section,
       {_URGENCY_SQL} AS urgency, {_YEAR_SQL} AS y, CAST(CAST(o.o_totalprice AS DECIMAL(18,2)) * 100 AS BIGINT) AS cents
FROM orders o JOIN customer c ON c.c_custkey = o.o_custkey
JOIN nation n ON n.n_nationkey = c.c_nationkey
JOIN region r ON r.r_regionkey = n.n_regionkey"""
_TABLE = ("r_regionkey", "block")
_NUMBER_SQL = "'3' || CAST(r_regionkey AS STRING) || '.' || CAST(block AS STRING)"
_TITLE_SQL = """'Table ' || table_number || '. ' || CASE r_regionkey WHEN 0 THEN 'Number' WHEN 1 THEN 'Percent change' WHEN 2
  THEN 'Dollars' WHEN 3 THEN 'Ratio' ELSE 'Value' END || ' of orders, by nation and mar- ket: Fall 2003 and 2004-05'"""
# The columns that orders of any table have: two for each year.
_COLUMNS_SQL = f"""
SELECT urgency, y, CAST(CASE urgency WHEN 'Urgent' THEN 1 ELSE 8 END + y - 2003 AS INT) AS col_index,
       urgency || ' | ' || CAST(y AS STRING) || '-' || lpad(CAST((y + 1) % 100 AS STRING), 2, '0') AS column_name
FROM (SELECT DISTINCT {_URGENCY_SQL} AS urgency, {_YEAR_SQL} AS y FROM orders) ORDER BY col_index NULLS LAST, column_name"""


def _raw(cents: Column) -> Column:
    # Two decimals by whole numbers: a division of decimals costs more than all the rest of a cell.
    whole, part = F.call_function("div", F.abs(cents), F.lit(100)).cast("string"), F.lpad((F.abs(cents) % 100).cast("string"), 2, "0")
    shown = F.concat(F.when(cents < 0, "-").otherwise(""), whole, F.lit("."), part)
    return F.when(cents % 23 == 0, "†").when(cents % 29 == 0, "—").when(cents % 31 == 0, "").when(cents % 37 == 0, "withheld").otherwise(shown)


def report_lines(tables, cell: Callable[[Column], Column] = lambda raw: raw.alias("raw")) -> DataFrame:
    """One row per report row: `r_regionkey, block, table_number, title, row_index, section, row_label, indent, cells`.

    `cells` holds `col_index, column_name` and what `cell` makes of the raw value, in this order. Rows stay partitioned by the first two columns.
    Orders are summed up by row, with a sum and a count for each of the columns: cells of a row need not be collected and sorted.
    """
    names = ("r_name", "n_name", "c_mktsegment")
    none = F.lit(None).cast("string")
    level = lambda lvl: F.struct(F.lit(lvl).alias("lvl"), *[(F.col(c) if i < 3 - lvl else none).alias(c) for i, c in enumerate(names)])
    columns = tables.sql(_COLUMNS_SQL).collect() or [dict.fromkeys(("urgency", "y", "col_index", "column_name"))]
    totals = [f"{what}_{i}" for i in range(len(columns)) for what in ("cents", "n")]
    here = [F.col("urgency").eqNullSafe(F.lit(c["urgency"])) & F.col("y").eqNullSafe(F.lit(c["y"]).cast("int")) for c in columns]
    tally = [a for i, at in enumerate(here) for a in (F.sum(F.when(at, F.col("cents"))).alias(f"cents_{i}"), F.count(F.when(at, 1)).alias(f"n_{i}"))]
    least = tables.sql(_ORDERS_SQL).repartition(*_TABLE).groupBy(*_TABLE, "section", *names).agg(*tally)
    by = [*_TABLE, "section", "lvl", *names]
    levels = least.select(*_TABLE, "section", *totals, F.explode(F.array(*map(level, range(4)))).alias("l")).select(*_TABLE, "section", "l.*", *totals)
    sums = levels.groupBy(*by).agg(*[F.sum(t).alias(t) for t in totals])
    every = F.array(*[F.struct(F.lit(c["col_index"]).cast("int").alias("col_index"), F.lit(c["column_name"]).cast("string").alias("column_name"),
                               F.col(f"cents_{i}").alias("cents"), F.col(f"n_{i}").alias("n")) for i, c in enumerate(columns)])
    told = F.transform(F.filter(every, lambda c: c["n"] > 0), lambda c: F.struct(c["col_index"], c["column_name"], cell(_raw(c["cents"]))))
    lines = sums.select(*by, told.alias("cells"))
    order = Window.partitionBy(*_TABLE).orderBy("section", F.concat_ws("/", *[F.coalesce(c, F.lit("")) for c in names]))
    return lines.select(
        *_TABLE, F.expr(_NUMBER_SQL).alias("table_number"), (F.dense_rank().over(order) - 1).alias("row_index"), "section",
        F.expr("CASE lvl WHEN 3 THEN 'Total' WHEN 2 THEN r_name WHEN 1 THEN n_name ELSE c_mktsegment END").alias("row_label"),
        F.expr("CASE lvl WHEN 3 THEN 2 WHEN 2 THEN 0 WHEN 1 THEN 1 ELSE 2 END").alias("indent"), "cells",
    ).withColumn("title", F.expr(_TITLE_SQL))


def table_numbers(tables) -> DataFrame:
    """The `table_number` of every report table."""
    return tables.sql(_ORDERS_SQL).select(*_TABLE).distinct().select(F.expr(_NUMBER_SQL).alias("table_number"))


def report_records(tables) -> DataFrame:
    """One record per report row with its cells in an array (at most 14 of them), written once."""
    records = (
        report_lines(tables, lambda raw: parse_value(raw).alias("value")).drop(*_TABLE)
        .withColumn("table_years", F.array(F.lit(2003), F.lit(2004)))
        .withColumn("edition_year", F.lit("2022"))
        .withColumn("page_url", F.concat(F.lit("https://tables.example.org/d22/tables/dt22_"),
                                         F.col("table_number"), F.lit(".asp")))
    )
    return materialise(records, "report-records")


def report_rows(tables) -> DataFrame:
    """`table_number, row_index, section, indent, row_label`, written once."""
    rows = report_lines(tables).select("table_number", "row_index", "section", "indent", "row_label").distinct()
    return materialise(rows, "report-rows")


# DuckDB side: numbers and texts of the raw cells, rows, and ancestor chains by
# definition (nearest shallower rows with nothing as shallow in between).
CELLS_CTE = f"""report AS ({REPORT_SQL}),
cells AS (
  SELECT *, CASE WHEN raw IN ('†', '—', '', 'withheld') THEN NULL ELSE CAST(raw AS DOUBLE) END AS num,
         CASE WHEN raw IN ('†', '—', 'withheld') THEN raw END AS txt FROM report),
report_rows AS (SELECT DISTINCT table_number, title, row_index, section, indent, row_label FROM report),
pairs AS (
  SELECT r.table_number, r.row_index, a.row_index AS a_index, a.row_label AS a_label,
         NOT EXISTS (SELECT 1 FROM report_rows b WHERE b.table_number = r.table_number
                     AND b.row_index > a.row_index AND b.row_index < r.row_index AND b.indent <= a.indent) AS near
  FROM report_rows r JOIN report_rows a
    ON a.table_number = r.table_number AND a.row_index < r.row_index AND a.indent < r.indent),
chains AS (
  SELECT r.*, coalesce(p.chain, '') AS chain
  FROM report_rows r LEFT JOIN (
    SELECT table_number, row_index, string_agg(a_label, ' > ' ORDER BY a_index) AS chain
    FROM pairs WHERE near GROUP BY table_number, row_index) p
  ON p.table_number = r.table_number AND p.row_index = r.row_index),
ids AS (SELECT table_number, section, chain, row_label FROM chains GROUP BY ALL HAVING count(*) = 1),
usable AS (
  SELECT c.*, h.chain FROM cells c
  JOIN chains h ON h.table_number = c.table_number AND h.row_index = c.row_index
  JOIN ids i ON i.table_number = h.table_number AND i.section = h.section AND i.chain = h.chain
            AND i.row_label = h.row_label
  WHERE c.num IS NOT NULL OR c.txt = 'withheld')"""


# ---- catalogs --------------------------------------------------------------
# One catalog entry per part; its variables come from the part's order lines.
TABLES_META_SQL = """
SELECT CAST(2004 + p_partkey % 20 AS INT) AS year,
       CASE WHEN p_partkey % 17 = 0 THEN 'DRV' || CAST(p_partkey AS STRING) WHEN p_partkey % 19 = 0
         THEN 'dfr_' || CAST(p_partkey AS STRING) WHEN p_partkey % 101 = 0 THEN NULL
         ELSE 'EF' || CAST(p_partkey AS STRING) END AS tablename,
       CASE WHEN p_partkey % 13 = 0 THEN NULL ELSE p_name END AS tabletitle,
       CASE WHEN p_partkey % 7 = 0 THEN '' ELSE p_type END AS description,
       CASE WHEN p_partkey % 11 = 0 THEN NULL ELSE p_brand END AS yearcoverage,
       CASE WHEN p_partkey % 3 = 0 THEN p_brand || ' in short' END AS description_summary
FROM part"""

VARTABLE_META_SQL = """
SELECT CAST(2004 + l_partkey % 20 AS INT) AS year,
       CASE WHEN l_linenumber % 2 = 0 THEN 'EF' ELSE 'ef' END || CAST(l_partkey AS STRING) AS tablename,
       CAST(l_orderkey AS BIGINT) AS varnumber,
       CASE WHEN l_orderkey % 5 = 0 THEN NULL ELSE CAST(l_suppkey AS BIGINT) END AS varorder,
       CASE WHEN l_orderkey % 3 = 0 THEN 'Qty' ELSE 'QTY' END || CAST(l_linenumber AS STRING) AS varname,
       l_returnflag || l_linestatus AS vartitle, l_returnflag || ' ' || CAST(l_orderkey AS STRING) AS longdescription
FROM lineitem"""

VALUESETS_META_SQL = """
SELECT 2023 AS year, 'ORDERS2023' AS tablename, 'O_OrderStatus' AS varname,
       CAST(ascii(o_orderstatus) AS INT) AS valueorder, o_orderstatus AS codevalue, 'Status ' || o_orderstatus AS valuelabel
FROM orders GROUP BY o_orderstatus
UNION ALL
SELECT 2023, 'ORDERS2023', 'o_orderpriority', NULL, o_orderpriority, 'Priority ' || substring(o_orderpriority, 3)
FROM orders WHERE o_orderpriority <> '5-LOW' GROUP BY o_orderpriority
UNION ALL
SELECT 2023, 'PART2023', 'p_size', CASE WHEN p_size % 10 = 0 THEN 1 END, CAST(p_size AS STRING),
       'Size ' || CAST(p_size AS STRING)
FROM part GROUP BY p_size
UNION ALL
SELECT 2023, 'LABELS2023', 'quality', quality, CAST(quality AS STRING), CASE quality WHEN 1 THEN 'good' ELSE 'poor' END
FROM labels GROUP BY quality
UNION ALL
SELECT 2023, 'LABELS2023', 'toxic', toxic, CAST(toxic AS STRING), CASE toxic WHEN 1 THEN 'toxic' ELSE 'clean' END
FROM labels GROUP BY toxic"""

# Source table names as a yearly export would list them, one per customer.
LISTING_SQL = """
SELECT 'survey' || CAST(2004 + c_custkey % 20 AS STRING) || '.accdb' AS file_name,
       CASE c_custkey % 12 WHEN 0 THEN 'Tables' || lpad(CAST(c_custkey % 100 AS STRING), 2, '0')
         WHEN 1 THEN 'Tables' || lpad(CAST(c_custkey % 100 AS STRING), 2, '0') || '_RV'
         WHEN 2 THEN 'DRVGR' || CAST(c_custkey AS STRING) WHEN 3 THEN 'dfr_' || CAST(c_custkey AS STRING)
         WHEN 4 THEN 'HD' || CAST(c_custkey AS STRING)
         WHEN 5 THEN 'VALUESETS' || lpad(CAST(c_custkey % 100 AS STRING), 2, '0')
         WHEN 6 THEN 'Tables' || lpad(CAST(c_custkey % 100 AS STRING), 2, '0') || 'x'
         WHEN 7 THEN ' ' || c_mktsegment || ' ' || CAST(c_custkey AS STRING) || ' '
         WHEN 8 THEN 'hd' || CAST(c_custkey - 4 AS STRING)
         WHEN 9 THEN 'vartable' || lpad(CAST(c_custkey % 100 AS STRING), 2, '0')
         WHEN 10 THEN 'NewVariables' || lpad(CAST(c_custkey % 100 AS STRING), 2, '0') || '_rv'
         ELSE '  ' END AS source_table
FROM customer"""

# Loaded tables: the registry after such a listing was ingested.
REGISTRY_SQL = """
SELECT CASE s_suppkey % 6 WHEN 0 THEN 'tables' || lpad(CAST(s_suppkey % 100 AS STRING), 2, '0') || '_meta'
         WHEN 1 THEN 'vartable' || lpad(CAST(s_suppkey % 100 AS STRING), 2, '0') || '_meta'
         WHEN 2 THEN 'valuesets' || lpad(CAST(s_suppkey % 100 AS STRING), 2, '0') || '_meta'
         WHEN 3 THEN 'HD' || CAST(2000 + s_suppkey % 100 AS STRING)
         WHEN 4 THEN 'Tables_Old' || lpad(CAST(s_suppkey % 100 AS STRING), 2, '0') || '_META'
         ELSE 'EF' || CAST(s_suppkey AS STRING) || 'meta' END AS table_name,
       CAST(2000 + s_suppkey % 100 AS INT) AS year
FROM supplier"""
