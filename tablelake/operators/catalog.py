"""Catalog lookups: tables, variables, code lists, and decoding by them."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tablelake.fixed_values import NO_VALUE_SET, VALUE_SET_HEAD, VALUE_SET_LINE
from tablelake.functions.years import two_digit_year

CODE_NUMBER = r"^\s*-?[0-9]+(\.[0-9]+)?\s*$"


def meta_tables(registry: DataFrame, year: Column | int) -> DataFrame:
    """Registry rows named `..<YY>_meta`, the spelling as stored."""
    year = F.lit(year) if isinstance(year, int) else year
    return registry.where(F.endswith("table_name", F.concat(two_digit_year(year), F.lit("_meta"))))


def find_meta(registry: DataFrame, kind: str, year: Column | int) -> DataFrame:
    """First registry name like `..<kind>..<YY>_meta`, case aside; no row when none fits."""
    year = F.lit(year) if isinstance(year, int) else year
    name = F.lower("table_name")
    fits = name.contains(kind.lower()) & F.endswith(name, F.concat(two_digit_year(year), F.lit("_meta"))) & (
        F.instr(name, F.lit(kind.lower())) + len(kind) <= F.length(name) - 6)
    return registry.where(fits).agg(F.min("table_name").alias("table_name")).where("table_name is not null")


def tables_with_column(columns: DataFrame, column: str) -> DataFrame:
    """Per table of the column registry: does it list exactly this name?"""
    return columns.groupBy("table_name").agg(F.bool_or(F.col("column_name") == column).alias("has_column"))


def has_column(columns: DataFrame, table: str, column: str) -> bool:
    """The same for one table; names are compared as spelled."""
    return not tables_with_column(columns.where(F.col("table_name") == table), column).where("has_column").isEmpty()


def description_text(title: Column, description: Column, summary: Column | None = None) -> Column:
    """Title and the shorter of the descriptions on file, one line each, blanks left out."""
    body = description if summary is None else F.coalesce(summary, description)
    return F.concat_ws("\n", F.nullif(title, F.lit("")), F.nullif(body, F.lit("")))


def table_descriptions(tables: DataFrame, year: int | None = None) -> DataFrame:
    """`(year, tablename, description_text)`; of repeated names the greatest text is kept.

    The source order of repeats is undefined, so any fixed choice will do.
    """
    chosen = tables if year is None else tables.where(F.col("year") == year)
    summary = F.col("description_summary") if "description_summary" in tables.columns else None
    text = description_text(F.col("tabletitle"), F.col("description"), summary)
    return chosen.groupBy("year", "tablename").agg(F.max(text).alias("description_text"))


def column_descriptions(variables: DataFrame, year: int | None = None, table: str | None = None) -> DataFrame:
    """Variables of a table (or of all); of a repeated name the last in catalog order is kept."""
    chosen = variables if year is None else variables.where(F.col("year") == year)
    if table is not None:
        chosen = chosen.where(F.lower("tablename") == table.strip().lower())
    # Unordered rows come last, so they win over numbered ones.
    order = F.struct(
        F.col("varorder").isNull(), F.col("varorder"), F.col("varnumber").isNull(), F.col("varnumber"),
        F.col("vartitle"), F.col("longdescription"))
    kept = F.max_by(F.struct("tablename", "varnumber", "varorder", "vartitle", "longdescription"), order)
    return (
        chosen.groupBy("year", F.lower("tablename").alias("table_key"), "varname")
        .agg(kept.alias("v")).select("year", "table_key", "varname", "v.*")
    )


def code_order(order: str = "valueorder", code: str = "codevalue") -> list[Column]:
    """Catalog order, then numeric codes by value, then text; missing keys last."""
    number = F.when(F.col(code).rlike(CODE_NUMBER), F.trim(code).try_cast("decimal(38,10)"))
    return [F.col(order).asc_nulls_last(), number.asc_nulls_last(), F.col(code).asc_nulls_last()]


def code_positions(values: DataFrame) -> DataFrame:
    """Adds each code's `position` in its variable's code list.

    A code list is the legend of one column; repeats are removed first, so a
    window group holds distinct codes only.
    """
    window = Window.partitionBy("year", "tablename", "varname").orderBy(*code_order(), "valuelabel")
    return values.distinct().withColumn("position", F.row_number().over(window))


def valueset(values: DataFrame, year: int, table: str, var: str) -> DataFrame:
    """Code list of one column in display order, with its display line."""
    return (
        values.where((F.col("year") == year) & (F.lower("tablename") == table.strip().lower())
                     & (F.lower("varname") == var.lower()))
        .orderBy(*code_order())
        .select("codevalue", "valuelabel", F.format_string(VALUE_SET_LINE, "codevalue", "valuelabel").alias("line"))
    )


def valueset_text(values: DataFrame, year: int, table: str, var: str) -> str:
    """The code list as the text a reader is shown; a code list is small by nature."""
    lines = [row["line"] for row in valueset(values, year, table, var).collect()]
    named = {"table": table.strip(), "var": var, "year": year}
    if not lines:
        return NO_VALUE_SET.format(**named)
    return "\n".join([VALUE_SET_HEAD.format(**named), *lines])


def decode_codes(df: DataFrame, values: DataFrame, year: int, table: str, columns: Sequence[str]) -> DataFrame:
    """Adds `<column>_label` per coded column; a code without a label keeps NULL.

    `values` should come from storage: its file size then tells Catalyst that
    the code list can be broadcast, and the coded rows are never shuffled on
    a handful of hot codes.
    """
    lists = values.where((F.col("year") == year) & (F.lower("tablename") == table.lower()))
    for column in columns:
        legend = lists.where(F.lower("varname") == column.lower()).groupBy(
            F.col("codevalue").alias("_code")).agg(F.min("valuelabel").alias(f"{column}_label"))
        df = df.join(legend, F.col(column).cast("string") == F.col("_code"), "left").drop("_code")
    return df


def with_attributes(df: DataFrame, entities: DataFrame, key: str, entity_key: str) -> DataFrame:
    """Entity attributes joined onto any table that carries the entity's id."""
    return df.join(entities, df[key] == entities[entity_key])


def drilldown(tables: DataFrame, variables: DataFrame, values: DataFrame) -> DataFrame:
    """Per year and table: its variables, each with the size of its code list.

    Both catalogs shrink to one row per variable before they meet.
    """
    codes = values.groupBy("year", F.lower("tablename").alias("table_key"), F.lower("varname").alias("var_key")).agg(
        F.count(F.lit(1)).alias("n_codes"))
    named = variables.groupBy("year", F.lower("tablename").alias("table_key"), F.lower("varname").alias("var_key")).agg(
        F.max("vartitle").alias("vartitle"))
    listed = tables.where("tablename is not null").groupBy("year", F.lower("tablename").alias("table_key")).agg(
        F.max("tabletitle").alias("tabletitle"))
    return (
        listed.join(named, ["year", "table_key"])
        .join(codes, ["year", "table_key", "var_key"], "left")
        .withColumn("n_codes", F.coalesce("n_codes", F.lit(0)))
    )
