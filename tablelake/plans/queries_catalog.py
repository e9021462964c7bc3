"""Table selection, catalogs and code lists."""
from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tablelake.functions.text import context_text
from tablelake.functions.years import two_digit_year
from tablelake.operators import catalog, enrich, selection
from tablelake.plans import derived
from tablelake.plans.registry import query
from tablelake.session import materialise, shared_folder
from tablelake.sources import sink

_SELECTED = f"""
SELECT file_name, trim(source_table) AS source_table FROM ({derived.LISTING_SQL})
WHERE trim(source_table) <> '' AND NOT starts_with(upper(trim(source_table)), 'DRV')
  AND NOT starts_with(upper(trim(source_table)), 'DFR')
  AND NOT regexp_matches(lower(trim(source_table)), '^(tables|valuesets|sectiontable|filenames|vartable|newvariables)[0-9][0-9]_rv$')"""
_CLASSIFIED = f"""
SELECT *, CASE WHEN is_meta THEN lower(source_table || '_meta') ELSE source_table END AS dest
FROM (SELECT *, regexp_matches(lower(source_table), '^(tables|valuesets|sectiontable|filenames|vartable|newvariables)[0-9][0-9]$') AS is_meta
      FROM ({_SELECTED}))"""


def _selected(tables):
    return selection.select_tables(tables.sql(derived.LISTING_SQL))


@query("select_tables", _SELECTED)
def select_tables(tables):
    return _selected(tables)


@query("classify_tables", _CLASSIFIED)
def classify_tables(tables):
    return selection.classify_tables(_selected(tables))


@query("dest_collisions", f"""
SELECT lower(dest) AS dest, count(*) AS n_sources, min(file_name) AS first_source, max(file_name) AS last_source
FROM ({_CLASSIFIED}) GROUP BY lower(dest) HAVING count(*) > 1""")
def dest_collisions(tables):
    return selection.collisions(selection.classify_tables(_selected(tables)))


@query("catalog_prune", f"""
SELECT * FROM ({derived.TABLES_META_SQL})
WHERE tablename IS NULL OR NOT (upper(tablename) LIKE 'DRV%' OR upper(tablename) LIKE 'DFR%')""")
def catalog_prune(tables):
    return selection.prune_catalog(tables.sql(derived.TABLES_META_SQL))


@query("catalog_lower_keys", f"""
SELECT year, tablename, lower(varname) AS varname, count(*) AS n FROM ({derived.VARTABLE_META_SQL}) GROUP BY ALL""")
def catalog_lower_keys(tables):
    lowered = selection.lower_keys(tables.sql(derived.VARTABLE_META_SQL))
    return lowered.groupBy("year", "tablename", "varname").agg(F.count(F.lit(1)).alias("n"))


@query("meta_table_count", f"""
SELECT count(*) AS n_meta_tables FROM ({derived.REGISTRY_SQL}) WHERE table_name LIKE '%!_meta' ESCAPE '!'""")
def meta_table_count(tables):
    return sink.count_meta(tables.sql(derived.REGISTRY_SQL))


@query("enrich_targets", f"""
SELECT table_name FROM ({derived.REGISTRY_SQL}) WHERE lower(table_name) LIKE 'tables%!_meta' ESCAPE '!'""")
def enrich_targets(tables):
    return enrich.enrich_targets(tables.sql(derived.REGISTRY_SQL))


@query("two_digit_year", """
SELECT CAST(year(o_orderdate) + 10 AS INT) AS year, printf('%02d', (year(o_orderdate) + 10) % 100) AS yy, count(*) AS n
FROM orders GROUP BY ALL""")
def two_digit(tables):
    year = F.year("o_orderdate") + 10
    return tables.orders.select(year.alias("year"), two_digit_year(year).alias("yy")).groupBy("year", "yy").agg(
        F.count(F.lit(1)).alias("n"))


@query("meta_tables_by_year", f"""
SELECT y AS for_year, table_name FROM ({derived.REGISTRY_SQL}) r, (SELECT DISTINCT year AS y FROM ({derived.REGISTRY_SQL})) d
WHERE table_name LIKE '%' || printf('%02d', y % 100) || '!_meta' ESCAPE '!' AND r.year = d.y""")
def meta_tables_by_year(tables):
    registry = tables.sql(derived.REGISTRY_SQL)
    return catalog.meta_tables(registry, F.col("year")).select(F.col("year").alias("for_year"), "table_name")


@query("find_meta_table", f"""
SELECT min(table_name) AS table_name FROM ({derived.REGISTRY_SQL}) WHERE lower(table_name) LIKE '%tables%04!_meta' ESCAPE '!'
HAVING min(table_name) IS NOT NULL""")
def find_meta_table(tables):
    return catalog.find_meta(tables.sql(derived.REGISTRY_SQL), "tables", 2004)


@query("has_column", f"""
SELECT table_name, bool_or(column_name = 'qty3') AS has_column FROM (
  SELECT tablename AS table_name, lower(varname) AS column_name FROM ({derived.VARTABLE_META_SQL})) GROUP BY table_name""")
def has_column(tables):
    columns = tables.sql(derived.VARTABLE_META_SQL).select(
        F.col("tablename").alias("table_name"), F.lower("varname").alias("column_name"))
    return catalog.tables_with_column(columns, "qty3")


@query("table_descriptions", f"""
SELECT year, tablename, max(concat_ws(chr(10), nullif(tabletitle, ''), nullif(coalesce(description_summary, description), ''))) AS description_text
FROM ({derived.TABLES_META_SQL}) GROUP BY year, tablename""")
def table_descriptions(tables):
    return catalog.table_descriptions(tables.sql(derived.TABLES_META_SQL))


@query("column_descriptions", f"""
SELECT year, lower(tablename) AS table_key, varname, tablename, varnumber, coalesce(varorder, -1) AS varorder, vartitle, longdescription
FROM ({derived.VARTABLE_META_SQL})
QUALIFY row_number() OVER (PARTITION BY year, lower(tablename), varname
  ORDER BY (varorder IS NULL) DESC, varorder DESC, (varnumber IS NULL) DESC, varnumber DESC, vartitle DESC, longdescription DESC) = 1""")
def column_descriptions(tables):
    found = catalog.column_descriptions(tables.sql(derived.VARTABLE_META_SQL))
    return found.withColumn("varorder", F.coalesce("varorder", F.lit(-1).cast("bigint")))


_POSITIONS = f"""
SELECT year, tablename, varname, codevalue, valuelabel, CAST(row_number() OVER (
    PARTITION BY year, tablename, varname ORDER BY valueorder NULLS LAST,
    CASE WHEN regexp_matches(codevalue, '^\\s*-?[0-9]+(\\.[0-9]+)?\\s*$') THEN CAST(trim(codevalue) AS DECIMAL(38,10)) END NULLS LAST,
    codevalue NULLS LAST, valuelabel) AS INT) AS position
FROM ({derived.VALUESETS_META_SQL})"""


@query("valueset_lookup", f"""
SELECT codevalue, valuelabel, '  ' || codevalue || ' — ' || valuelabel AS line, position FROM ({_POSITIONS})
WHERE lower(tablename) = 'orders2023' AND lower(varname) = 'o_orderstatus'""")
def valueset_lookup(tables):
    values = tables.sql(derived.VALUESETS_META_SQL)
    found = catalog.valueset(values, 2023, " orders2023 ", "O_ORDERSTATUS")
    place = catalog.code_positions(values).where("lower(tablename) = 'orders2023'").select(
        "codevalue", "valuelabel", "position")
    return found.join(place, ["codevalue", "valuelabel"])


@query("natural_code_sort", _POSITIONS)
def natural_code_sort(tables):
    return catalog.code_positions(tables.sql(derived.VALUESETS_META_SQL)).drop("valueorder")


@query("decode_codes", f"""
SELECT o.o_orderkey, o.o_orderstatus, o.o_orderpriority, s.valuelabel AS o_orderstatus_label,
       coalesce(p.valuelabel, 'unlisted') AS o_orderpriority_label
FROM orders o
LEFT JOIN ({derived.VALUESETS_META_SQL}) s ON s.codevalue = o.o_orderstatus AND lower(s.varname) = 'o_orderstatus'
LEFT JOIN ({derived.VALUESETS_META_SQL}) p ON p.codevalue = o.o_orderpriority AND lower(p.varname) = 'o_orderpriority'""")
def decode_codes(tables):
    values = materialise(tables.sql(derived.VALUESETS_META_SQL), "valuesets")
    coded = tables.orders.select("o_orderkey", "o_orderstatus", "o_orderpriority")
    decoded = catalog.decode_codes(coded, values, 2023, "ORDERS2023", ["o_orderstatus", "o_orderpriority"])
    return decoded.withColumn("o_orderpriority_label", F.coalesce("o_orderpriority_label", F.lit("unlisted")))


@query("catalog_drilldown", f"""
WITH v AS (SELECT year, lower(tablename) AS table_key, lower(varname) AS var_key, max(vartitle) AS vartitle
           FROM ({derived.VARTABLE_META_SQL}) GROUP BY ALL),
c AS (SELECT year, lower(tablename) AS table_key, lower(varname) AS var_key, count(*) AS n_codes
      FROM (SELECT year, tablename, varname, vartitle FROM ({derived.VARTABLE_META_SQL}) WHERE varorder IS NOT NULL) GROUP BY ALL),
t AS (SELECT year, lower(tablename) AS table_key, max(tabletitle) AS tabletitle FROM ({derived.TABLES_META_SQL})
      WHERE tablename IS NOT NULL GROUP BY ALL)
SELECT t.year, t.table_key, coalesce(t.tabletitle, '') AS tabletitle, v.var_key, v.vartitle, coalesce(c.n_codes, 0) AS n_codes
FROM t JOIN v ON v.year = t.year AND v.table_key = t.table_key
LEFT JOIN c ON c.year = t.year AND c.table_key = t.table_key AND c.var_key = v.var_key""")
def catalog_drilldown(tables):
    variables = tables.sql(derived.VARTABLE_META_SQL)
    codes = variables.where("varorder is not null").select("year", "tablename", "varname")
    out = catalog.drilldown(tables.sql(derived.TABLES_META_SQL), variables, codes)
    return out.withColumn("tabletitle", F.coalesce("tabletitle", F.lit("")))


@query("enrich_context", f"""
SELECT 'Table title: ' || coalesce(nullif(tabletitle, ''), '(none)') || chr(10) || 'Year coverage: ' ||
       coalesce(nullif(yearcoverage, ''), '(none)') || chr(10) || chr(10) || 'Description:' || chr(10) || description AS context
FROM ({derived.TABLES_META_SQL})""")
def enrich_context(tables):
    return tables.sql(derived.TABLES_META_SQL).select(
        context_text(F.col("tabletitle"), F.col("yearcoverage"), F.col("description")).alias("context"))


def summarise(batch):
    """Stand-in for a model call: the last word of the description, upper case; none for short ones."""
    words = batch["description"].str.split().str[-1].str.upper()
    return words.where(words.str.len() > 4, None)


_SUMMARISED = f"""
SELECT year, tablename, coalesce(tabletitle, '') AS tabletitle, description, CASE WHEN description_summary IS NOT NULL THEN description_summary
  WHEN trim(description) <> '' AND length(upper(split_part(description, ' ', -1))) > 4
  THEN upper(split_part(description, ' ', -1)) ELSE '' END AS description_summary
FROM ({derived.TABLES_META_SQL})"""


@query("enrich_resume", _SUMMARISED)
def enrich_resume(tables):
    filled = enrich.fill_missing(tables.sql(derived.TABLES_META_SQL), "description_summary",
                                 ["tabletitle", "yearcoverage", "description"], summarise, "description")
    return filled.select("year", "tablename", F.coalesce("tabletitle", F.lit("")).alias("tabletitle"), "description",
                         F.coalesce("description_summary", F.lit("")).alias("description_summary"))


@query("enrich_ledger", f"""
SELECT *, (SELECT count(*) FROM ({derived.TABLES_META_SQL}) WHERE description_summary IS NULL AND trim(description) <> ''
           AND length(upper(split_part(description, ' ', -1))) > 4) AS n_updated FROM ({_SUMMARISED})""")
def enrich_ledger(tables):
    """A run that fails half-way, and one that asks for the rest."""
    rows = materialise(enrich.with_row_key(tables.sql(derived.TABLES_META_SQL)), "catalog")
    ledger, inputs = f"{shared_folder(tables.spark)}/ledger-{uuid.uuid4().hex}", ["tabletitle", "yearcoverage", "description"]

    def tiring(batch):
        if batch["description"].str.contains("BRASS").any():
            raise RuntimeError("no answer")
        return summarise(batch)

    first = enrich.fill_durably(rows, "row_key", "description_summary", inputs, tiring, "description", ledger)
    second = enrich.fill_durably(rows, "row_key", "description_summary", inputs, summarise, "description", ledger)
    return second.table.select(
        "year", "tablename", F.coalesce("tabletitle", F.lit("")).alias("tabletitle"), "description",
        F.coalesce("description_summary", F.lit("")).alias("description_summary"), F.lit(first.updated + second.updated).cast("bigint").alias("n_updated"))


@query("enrich_add_column", f"""
SELECT year, tablename, description, CASE WHEN trim(description) <> '' AND length(upper(split_part(description, ' ', -1))) > 4
  THEN upper(split_part(description, ' ', -1)) ELSE '' END AS description_summary FROM ({derived.TABLES_META_SQL})""")
def enrich_add_column(tables):
    """A table that has no such column yet."""
    bare = tables.sql(derived.TABLES_META_SQL).drop("description_summary")
    filled = enrich.fill_missing(bare, "description_summary", ["description"], summarise, "description")
    return filled.select("year", "tablename", "description", F.coalesce("description_summary", F.lit("")).alias("description_summary"))


@query("surrogate_key", """
SELECT sha256('{"event_type":"' || event_type || '","user_id":' || coalesce(CAST(user_id AS VARCHAR), 'null') ||
         ',"day":"' || CAST(day AS VARCHAR) || '","mark":' || coalesce('"' || mark || '"', 'null') || '}') || '-' ||
       row_number() OVER (PARTITION BY event_type, user_id, day, mark) AS row_key, event_type, user_id
FROM (SELECT CASE WHEN event_id % 3 = 0 THEN 'view' ELSE event_type END AS event_type,
             CASE WHEN event_id % 3 <> 0 THEN user_id END AS user_id,
             CASE WHEN event_id % 3 = 0 THEN DATE '2020-01-01' ELSE CAST(ts AS DATE) END AS day,
             CASE WHEN event_id % 3 = 1 THEN '#N' END AS mark FROM events)""")
def surrogate_key(tables):
    """A third of the rows are one row; others hold NULLs, and a mark where the others have NULL."""
    third = F.col("event_id") % 3
    keyless = tables.events.select(
        F.when(third == 0, "view").otherwise(F.col("event_type")).alias("event_type"),
        F.when(third != 0, F.col("user_id")).alias("user_id"),
        F.when(third == 0, F.lit("2020-01-01").cast("date")).otherwise(F.col("ts").cast("date")).alias("day"),
        F.when(third == 1, "#N").alias("mark"))
    return enrich.with_row_key(keyless).select("row_key", "event_type", "user_id")
