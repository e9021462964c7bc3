"""Hierarchies, cells, rankings, samples and question candidates."""
from __future__ import annotations

from pyspark.sql import functions as F

from tablelake.fixed_values import QUOTAS, STOPWORDS
from tablelake.functions.text import describe, row_path
from tablelake.functions.years import cell_years
from tablelake.operators import cells, hierarchy, questions, ranking, reports, sampling
from tablelake.plans import derived
from tablelake.plans.derived import CELLS_CTE
from tablelake.plans.registry import query


def indexed(tables):
    return cells.index_cells(derived.report_records(tables))


def chain():
    return F.array_join("ancestors", " > ").alias("chain")


# ---- hierarchy ---------------------------------------------------------------
@query("row_ancestors", f"WITH {CELLS_CTE} SELECT table_number, row_index, row_label, chain FROM chains")
def row_ancestors(tables):
    rows = derived.report_rows(tables)
    return hierarchy.with_ancestors(rows).select("table_number", "row_index", "row_label", chain())


@query("section_carry_forward", f"""
WITH {CELLS_CTE} SELECT table_number, row_index * 2 + 1 AS line, row_label, section FROM report_rows""")
def section_carry_forward(tables):
    """Section names are moved into heading rows of their own, then carried down again."""
    rows = derived.report_rows(tables)
    plain = rows.select("table_number", (F.col("row_index") * 2 + 1).alias("line"), "row_label",
                        F.lit(False).alias("is_heading"))
    heads = rows.groupBy("table_number", "section").agg((F.min("row_index") * 2).alias("line")).select(
        "table_number", "line", F.col("section").alias("row_label"), F.lit(True).alias("is_heading"))
    return hierarchy.carry_section(plain.unionByName(heads), index="line")


@query("unique_row_keys", f"""
WITH {CELLS_CTE}
SELECT table_number, chain, row_label, min(row_index) AS row_index FROM chains GROUP BY ALL HAVING count(*) = 1""")
def unique_row_keys(tables):
    """Without their sections, rows of different sections share keys."""
    rows = derived.report_rows(tables)
    rows = hierarchy.with_ancestors(rows).withColumn("section", F.lit("")).drop("indent")
    return cells.unique_rows(rows).select("table_number", chain(), "row_label", "row_index")


@query("unpivot_cells", f"""
WITH {CELLS_CTE} SELECT table_number, row_index, col_index, column_name, coalesce(num, -1) AS num, coalesce(txt, '') AS txt
FROM cells WHERE num IS NOT NULL OR txt = 'withheld'""")
def unpivot(tables):
    return cells.unpivot_cells(derived.report_records(tables)).select(
        "table_number", "row_index", "col_index", "column_name", F.coalesce("value.num", F.lit(-1.0)).alias("num"),
        F.coalesce("value.text", F.lit("")).alias("txt"))


@query("index_cells", f"""
WITH {CELLS_CTE} SELECT table_number, row_index, col_index, section, chain, row_label, column_name,
  coalesce(num, -1) AS num, coalesce(txt, '') AS txt FROM usable""")
def index_cells(tables):
    return indexed(tables).select(
        "table_number", "row_index", "col_index", "section", chain(), "row_label", "column_name",
        F.coalesce("value.num", F.lit(-1.0)).alias("num"), F.coalesce("value.text", F.lit("")).alias("txt"))


@query("row_path", f"""
WITH {CELLS_CTE} SELECT table_number, row_index, CASE WHEN chain = '' THEN row_label ELSE chain || ' > ' || row_label END AS path
FROM chains""")
def path(tables):
    rows = derived.report_rows(tables)
    return hierarchy.with_ancestors(rows).select(
        "table_number", "row_index", row_path(F.col("ancestors"), F.col("row_label")).alias("path"))


@query("cell_years", """
SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN '1999,2004' WHEN 1 THEN CAST(year(o_orderdate) AS VARCHAR)
  WHEN 2 THEN '2010' WHEN 3 THEN '1998,2011' ELSE '2003,2004' END AS years FROM orders""")
def years_of_cells(tables):
    k, none = F.col("o_orderkey") % 5, F.lit("none")
    found = cell_years(
        F.when(k == 0, "2004-05 to 1999 and 2004").otherwise(F.col("o_orderpriority")),
        F.when(k <= 1, F.concat(F.lit("Fall "), F.year("o_orderdate").cast("string"))).otherwise(none),
        F.when(k <= 2, "2010-11").otherwise(none),
        F.array(F.when(k <= 3, "2011 on").otherwise(none), F.lit("since"), F.when(k <= 3, "1998").otherwise(none)),
        F.array(F.lit(2004), F.lit(2003), F.lit(2004)))
    return tables.orders.select("o_orderkey", F.array_join(found.cast("array<string>"), ",").alias("years"))


@query("describe_cell", """
SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN 'name: ' || p_name || chr(10) || 'size: ' || p_size
  WHEN 1 THEN 'name: ' || p_name || chr(10) || 'brand: ' || p_brand || chr(10) || 'size: ' || p_size
  ELSE 'name: ' || p_name || chr(10) || 'size: ' || p_size END AS lines FROM part""")
def describe_cell(tables):
    brand = F.when(F.col("p_partkey") % 3 == 0, F.lit(None)).when(F.col("p_partkey") % 3 == 1, F.col("p_brand")).otherwise("")
    return tables.part.select("p_partkey", describe(
        ("name", F.col("p_name")), ("brand", brand), ("size", F.col("p_size").cast("string"))).alias("lines"))


# ---- ranking -------------------------------------------------------------------
_MEMBERS = f"""{CELLS_CTE},
members AS (SELECT * FROM usable WHERE num IS NOT NULL AND row_label <> 'Total'),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY table_number, col_index, section, chain ORDER BY num DESC, row_index) AS rk,
    count(*) OVER (PARTITION BY table_number, col_index, section, chain) AS n_members,
    md5('0|' || table_number || '|' || col_index || '|' || section || '|' || replace(chain, ' > ', '>') || '|' || row_label) AS draw
  FROM members),
groups AS (
  SELECT table_number, title, col_index, column_name, section, chain, max(n_members) AS n_members,
    max(CASE WHEN rk = 1 THEN row_label END) AS top_label, max(CASE WHEN rk = 1 THEN num END) AS top_value,
    max(CASE WHEN rk = 2 THEN num END) AS second_value,
    string_agg(row_label, '; ' ORDER BY draw) FILTER (WHERE rk <= 5) AS options,
    array_agg(row_label ORDER BY draw) FILTER (WHERE rk <= 5) AS option_list
  FROM placed GROUP BY ALL),
eligible AS (
  SELECT *, (top_value - second_value) / abs(top_value) AS margin FROM groups
  WHERE n_members >= 3 AND top_value > 0 AND (top_value - second_value) / abs(top_value) > 0.02)"""


@query("rank_groups", f"""
WITH {_MEMBERS}
SELECT table_number, col_index, section, chain, count(*) AS n_members, max(num) AS top_value, min(num) AS low_value
FROM members GROUP BY ALL""")
def rank_groups(tables):
    return ranking.rank_groups(indexed(tables)).withColumn("chain", chain()).drop("ancestors")


@query("rank_margin", f"""
WITH {_MEMBERS}
SELECT table_number, col_index, section, chain, top_label, top_value, round(margin, 4) AS margin FROM eligible""")
def rank_margin(tables):
    lead = F.get("ranked", F.lit(0))
    return ranking.rank_eligible(ranking.rank_members(indexed(tables))).select(
        "table_number", "col_index", "section", chain(), lead["label"].alias("top_label"),
        lead["value"].alias("top_value"), F.round("margin", 4).alias("margin"))


@query("rank_options", f"WITH {_MEMBERS} SELECT table_number, col_index, section, chain, options FROM eligible")
def rank_options(tables):
    ranked = questions.rank_candidates(indexed(tables))
    return ranked.select("table_number", F.expr("int(substring(split(id, '::')[2], 2))").alias("col_index"), "group.section",
                         F.array_join("group.ancestors", " > ").alias("chain"), F.array_join("options", "; ").alias("options"))


# ---- candidates ------------------------------------------------------------------
_TOPIC = "lower(split_part(regexp_replace(title, '^Table\\s+[\\d.]+\\.\\s*', ''), ':', 1))"
_SUBJECT = "split_part(regexp_replace(title, '^Table\\s+[\\d.]+\\.\\s*', ''), ':', 1)"
_UNIT = """CASE WHEN contains(lower(title), 'percent') THEN 'percent' WHEN contains(lower(title), 'dollar') THEN 'dollars'
  WHEN contains(lower(title), 'ratio') THEN 'ratio' ELSE 'count' END"""
_COL = "replace(split_part(column_name, ' | ', 1), '- ', '-')"
_YEAR = "split_part(column_name, ' | ', 2)"
_ROW = "CASE WHEN chain = '' THEN row_label ELSE chain || ' > ' || row_label END"
_STOP = ", ".join(f"'{w}'" for w in STOPWORDS)
_TOKENS = ("list_filter(regexp_split_to_array(lower({}), '[^A-Za-z0-9\\-]+'), "
           f"lambda w: length(w) > 2 AND w NOT IN ({_STOP}))")

_LOOKUPS = f"""
SELECT 'digest_' || table_number || '::lookup::r' || printf('%04d', row_index) || '::c' || printf('%02d', col_index) AS id,
  'lookup' AS question_type, table_number, section, chain, row_label, column_name, num, txt,
  CASE WHEN num IS NULL THEN 'label' ELSE 'number' END AS answer_type, {_UNIT} AS unit, substring({_YEAR}, 1, 4) AS years,
  'question_type: lookup' || chr(10) || 'table: ' || {_SUBJECT} || chr(10) || 'section: ' || section || chr(10) || 'row: ' || {_ROW}
    || chr(10) || 'column: ' || {_COL} || chr(10) || 'year: ' || {_YEAR} || chr(10) || 'unit: ' || {_UNIT} AS descriptor,
  'In NCES data on ' || {_TOPIC} || ' (' || section || '), what figure is reported for ' || {_ROW} || ' under ' || {_COL}
    || ' in ' || {_YEAR} || '?' AS template,
  array_to_string(list_concat({_TOKENS.format(_ROW)}, {_TOKENS.format(_COL)}), ' ') AS tokens
FROM usable"""


_RANKS = f"""
SELECT id || CASE WHEN count(*) OVER (PARTITION BY id) > 1 THEN '::' || mark ELSE '' END AS id, * EXCLUDE (id, mark) FROM (
SELECT 'digest_' || table_number || '::rank::c' || printf('%02d', col_index) || '::' || lower(section) ||
    CASE WHEN chain = '' THEN '' ELSE '::' || left(replace(replace(replace(lower(chain), ' > ', '-'), '_', '-'), ' ', '-'), 24) END AS id,
  left(md5(section || '|' || replace(chain, ' > ', '>')), 8) AS mark,
  'rank' AS question_type, table_number, section, chain, column_name, top_label AS answer_label, {_UNIT} AS unit,
  substring({_YEAR}, 1, 4) AS years, round(margin, 4) AS margin, options,
  'question_type: rank (multiple choice, ask which option is highest)' || chr(10) || 'table: ' || {_SUBJECT} || chr(10) ||
    'section: ' || section || chr(10) || CASE WHEN chain = '' THEN '' ELSE 'group: ' || chain || chr(10) END || 'column: ' || {_COL}
    || chr(10) || 'year: ' || {_YEAR} || chr(10) || 'unit: ' || {_UNIT} || chr(10) || 'options: ' || options AS descriptor,
  'In NCES data on ' || {_TOPIC} || ' (' || section || '), which of the following had the highest ' || {_COL} || ' in ' || {_YEAR}
    || ': ' || array_to_string(option_list[:-2], ', ') || ', or ' || option_list[-1] || '?' AS template
FROM eligible)"""


@query("lookup_candidates", f"WITH {CELLS_CTE} SELECT id, question_type, answer_type, unit, years, descriptor, template, tokens, coalesce(num, -1) AS num, coalesce(txt, '') AS txt FROM ({_LOOKUPS})")
def lookup_candidates(tables):
    records = derived.report_records(tables)
    columns = questions.column_wordings(records.select(F.explode("cells.column_name").alias("column_name")))
    return questions.lookup_candidates(cells.index_cells(records, per_row=questions.row_context), columns).select(
        "id", "question_type", "answer_type", "unit", F.array_join(F.col("years").cast("array<string>"), ",").alias("years"),
        "descriptor", "template", F.array_join("required_tokens", " ").alias("tokens"),
        F.coalesce("answer_num", F.lit(-1.0)).alias("num"), F.coalesce("answer_label", F.lit("")).alias("txt"))


@query("rank_candidates", f"WITH {_MEMBERS} SELECT id, question_type, answer_label, unit, years, margin, options, descriptor, template FROM ({_RANKS})")
def rank_candidates(tables):
    return questions.rank_candidates(indexed(tables)).select(
        "id", "question_type", "answer_label", "unit", F.array_join(F.col("years").cast("array<string>"), ",").alias("years"),
        "margin", F.array_join("options", "; ").alias("options"), "descriptor", "template")


# ---- samples ------------------------------------------------------------------------
@query("sample_per_table", """
SELECT l_suppkey, l_orderkey, l_linenumber FROM lineitem
QUALIFY row_number() OVER (PARTITION BY l_suppkey ORDER BY md5('7|' || l_orderkey || '|' || l_linenumber), l_orderkey, l_linenumber) <= 10""")
def sample_per_table(tables):
    return sampling.sample_per_group(
        tables.lineitem.select("l_suppkey", "l_orderkey", "l_linenumber"), ["l_suppkey"], ["l_orderkey", "l_linenumber"],
        n=10, seed=7)


_POOL = """
SELECT CAST(o_orderkey AS STRING) AS id, CASE WHEN o_orderkey % 3 = 0 THEN 'rank' ELSE 'lookup' END AS question_type,
       CAST(CASE WHEN o_orderkey % 4 = 0 THEN 1 ELSE o_custkey % 1000 END AS STRING) AS table_number
FROM orders"""


@query("quota_sample", f"""
WITH pool AS (SELECT *, md5('3|' || id) AS draw FROM ({_POOL})),
l AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY table_number ORDER BY draw) AS rk FROM pool WHERE question_type = 'lookup')
      WHERE rk <= 5 ORDER BY draw LIMIT 400),
r AS (SELECT * FROM (
        SELECT p.*, row_number() OVER (PARTITION BY p.table_number ORDER BY draw) AS rk,
               5 - (SELECT count(*) FROM l WHERE l.table_number = p.table_number) AS free
        FROM pool p WHERE question_type = 'rank')
      WHERE rk <= free ORDER BY draw LIMIT 100)
SELECT id, question_type, table_number FROM l UNION ALL SELECT id, question_type, table_number FROM r""")
def quota_sample(tables):
    return sampling.quota_sample(tables.sql(_POOL), QUOTAS, seed=3)


@query("scale_quotas", """
SELECT p_size, greatest(1, CAST(round_even(400.0 * p_size / 500, 0) AS BIGINT)) AS lookup,
       greatest(1, CAST(round_even(100.0 * p_size / 500, 0) AS BIGINT)) AS rank, count(*) AS n FROM part GROUP BY ALL""")
def scale_quotas(tables):
    quota = lambda n: sampling.scaled_quota(F.lit(float(n)), F.lit(500), F.col("p_size"))
    return tables.part.groupBy("p_size", quota(400).alias("lookup"), quota(100).alias("rank")).agg(
        F.count(F.lit(1)).alias("n"))


@query("limit_per_table", """
SELECT * FROM (
  SELECT l_orderkey, l_linenumber, l_partkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS rk,
         count(*) OVER (PARTITION BY l_orderkey) AS row_count FROM lineitem) WHERE rk <= 3""")
def limit_per_table(tables):
    counts = tables.lineitem.groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("row_count"))
    order = [F.col("l_linenumber"), F.col("l_partkey"), F.col("l_suppkey")]
    return sampling.limit_per(tables.lineitem, ["l_orderkey"], order, 3, rank="rk").select(
        "l_orderkey", "l_linenumber", "l_partkey", "rk").join(counts, "l_orderkey")


# ---- headers and years of report tables ------------------------------------------------
@query("dedupe_headers", """
SELECT CAST(floor(p_partkey / 20) AS BIGINT) AS block, p_partkey, p_type ||
  CASE WHEN row_number() OVER w > 1 THEN ' (' || row_number() OVER w || ')' ELSE '' END AS column_name
FROM part WINDOW w AS (PARTITION BY floor(p_partkey / 20), p_type ORDER BY p_partkey)""")
def dedupe_headers(tables):
    names = tables.part.groupBy(F.floor(F.col("p_partkey") / 20).alias("block")).agg(
        F.array_sort(F.collect_list(F.struct("p_partkey", "p_type"))).alias("parts"))
    both = F.arrays_zip(F.col("parts.p_partkey").alias("p_partkey"), reports.dedupe_names(F.col("parts.p_type")).alias("column_name"))
    return names.select("block", F.inline(both))


# Every table gets two unnamed columns at the end, one of them filled in odd regions; rows of
# every fourth index name a year in regions above 2.
_YEARLY = """CASE WHEN substring(table_number, 2, 1) > '2' AND row_index % 4 = 0
  THEN row_label || ', ' || CAST(2001 + row_index % 5 AS STRING) ELSE row_label END"""


def report_pages(tables):
    """The derived report as parsed pages: `page_key, title, columns, records`."""
    records = derived.report_records(tables).select(
        F.col("table_number").alias(reports.PAGE), "title", "row_index", "section", "indent",
        F.expr(_YEARLY).alias("row_label"), "cells")
    filled = F.when(F.substring(reports.PAGE, 2, 1).isin("1", "3") & (F.col("row_index") == 0), 1.0)

    def cell(position, num):
        value = F.struct(num.alias("num"), F.lit(None).cast("string").alias("text"), num.isNotNull().alias("is_int"))
        return F.struct(F.lit(position).alias("col_index"), F.lit(f"col_{position + 1}").alias("column_name"),
                        value.alias("value"))

    extra = F.array(cell(15, filled), cell(16, F.lit(None).cast("double")))
    names = ["Item"] + [f"{u} | {y}-{(y + 1) % 100:02d}" for u in ("Urgent", "Reg- ular") for y in range(2003, 2010)]
    row = F.struct("row_index", "section", "indent", "row_label", F.concat("cells", extra).alias("cells"))
    return records.groupBy(reports.PAGE, "title").agg(F.array_sort(F.collect_list(row)).alias("records")).withColumn(
        "columns", F.array(*[F.lit(n) for n in [*names, "col_16", "col_17"]]))


def page_cells(pages, *more):
    """One row per cell of parsed pages, the empty ones too."""
    rows = pages.select(reports.PAGE, *more, F.explode("records").alias("r")).select(reports.PAGE, *more, "r.row_index", "r.row_label", F.explode("r.cells").alias("c"))
    return rows.select(reports.PAGE, *more, "row_index", "row_label", "c.column_name", "c.col_index", F.coalesce("c.value.num", F.lit(-1.0)).alias("num"))


# All cells of the pages above, with the place they have in the year-labelled rows.
_WIDE = f"""WITH {CELLS_CTE},
wide AS (
  SELECT table_number, row_index, col_index, column_name, coalesce(num, -1) AS num FROM cells
  UNION ALL SELECT table_number, row_index, 15, 'col_16', CASE WHEN row_index = 0 AND substring(table_number, 2, 1) IN ('1', '3') THEN 1 ELSE -1 END
  FROM report_rows)"""


@query("drop_spacers", f"""{_WIDE}
SELECT w.table_number AS page_key, CASE WHEN substring(w.table_number, 2, 1) IN ('1', '3') THEN 16 ELSE 15 END AS n_columns, w.row_index,
  {_YEARLY.replace("AS STRING", "AS VARCHAR").replace("row_index", "w.row_index").replace("table_number", "w.table_number")} AS row_label, w.column_name, w.col_index, w.num
FROM wide w JOIN report_rows r ON r.table_number = w.table_number AND r.row_index = w.row_index
WHERE w.col_index < 15 OR substring(w.table_number, 2, 1) IN ('1', '3')""")
def drop_spacers(tables):
    cut = reports.drop_spacers(report_pages(tables))
    return page_cells(cut.withColumn("n_columns", F.size("columns")), "n_columns")


_PRUNED = f"""WITH {CELLS_CTE},
labelled AS (SELECT *, CASE WHEN substring(table_number, 2, 1) > '2' AND row_index % 4 = 0 THEN 2001 + row_index % 5 END AS y FROM report_rows),
axes AS (SELECT table_number, title, count(y) AS n_yearly, count(*) AS n_rows FROM labelled GROUP BY ALL),
marked AS (SELECT l.*, n_yearly > 3 AND y IS NOT NULL AND NOT y BETWEEN 2004 AND 2008 AS out FROM labelled l JOIN axes USING (table_number))"""


@query("year_axis", f"""{_PRUNED}
SELECT table_number AS page_key, CASE WHEN n_yearly > 3 THEN 'both' ELSE 'columns' END AS year_axis FROM axes""")
def year_axis(tables):
    return reports.prune_years(report_pages(tables), 2004, 2008).select(reports.PAGE, "year_axis")


@query("year_prune", f"""{_PRUNED},
kept AS (SELECT *, row_number() OVER (PARTITION BY table_number ORDER BY row_index) - 1 AS place FROM marked WHERE NOT out)
SELECT m.table_number AS page_key, CAST(m.place AS INT) AS row_index, {_YEARLY.replace("AS STRING", "AS VARCHAR")} AS row_label, c.column_name,
       CASE WHEN c.col_index < 8 THEN c.col_index - 1 ELSE c.col_index - 3 END AS col_index, coalesce(c.num, -1) AS num
FROM kept m JOIN (SELECT table_number AS t, row_index AS i, col_index, column_name, num FROM cells) c ON c.t = m.table_number AND c.i = m.row_index
WHERE c.column_name NOT LIKE '%2003-04' AND c.column_name NOT LIKE '%2009-10'
UNION ALL
SELECT m.table_number, CAST(m.place AS INT), {_YEARLY.replace("AS STRING", "AS VARCHAR")}, 'col_16', 11, CASE WHEN row_index = 0 THEN 1 ELSE -1 END
FROM kept m WHERE substring(table_number, 2, 1) IN ('1', '3')
  AND EXISTS (SELECT 1 FROM kept k WHERE k.table_number = m.table_number AND k.row_index = 0)""")
def year_prune(tables):
    return page_cells(reports.prune_years(report_pages(tables), 2004, 2008))


@query("table_years", f"""{_PRUNED}
SELECT table_number AS page_key, (SELECT string_agg(DISTINCT y, ',' ORDER BY y) FROM (
         SELECT unnest([2004, 2005, 2006, 2007, 2008]) AS y)) AS years,
       (SELECT count(*) FROM marked m WHERE m.table_number = axes.table_number AND m.out) AS dropped_rows, 4 AS dropped_columns,
       CASE WHEN substring(table_number, 2, 1) IN ('1', '3')
              AND NOT (substring(table_number, 2, 1) = '3' AND EXISTS (SELECT 1 FROM marked m WHERE m.table_number = axes.table_number AND m.row_index = 0 AND m.out))
            THEN 12 ELSE 11 END AS n_columns, 1 AS kept
FROM axes""")
def table_years(tables):
    return reports.prune_years(report_pages(tables), 2004, 2008).select(
        reports.PAGE, F.array_join(F.col("years").cast("array<string>"), ",").alias("years"), "dropped_rows",
        "dropped_columns", F.size("columns").alias("n_columns"), F.col("kept").cast("int").alias("kept"))
