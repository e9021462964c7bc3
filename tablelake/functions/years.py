"""Years in labels, titles and table names."""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tablelake.fixed_values import MAX_CATALOG_YEAR, MIN_CATALOG_YEAR, YEAR_PATTERN
from tablelake.functions.text import let


def parse_years(c: Column) -> Column:
    """Start years named in a text, in order, repeats kept (`1999-2000` -> 1999). A text without their centuries is not searched."""
    found = F.regexp_extract_all(c, F.lit("(?U)" + YEAR_PATTERN), 1)
    return F.when(c.contains("19") | c.contains("20"), F.transform(found, lambda y: y.cast("int"))).otherwise(F.array().cast("array<int>"))


def years_all_in(years: Column, lo: int, hi: int) -> Column:
    """Strict: at least one year, and none outside the range."""
    return (F.size(years) > 0) & F.forall(years, lambda y: y.between(lo, hi))


def years_any_in(years: Column, lo: int, hi: int) -> Column:
    return F.exists(years, lambda y: y.between(lo, hi))


def years_within(years: Column, lo: int, hi: int) -> Column:
    """Sorted distinct years that lie in the range."""
    return F.array_sort(F.array_distinct(F.filter(years, lambda y: y.between(lo, hi))))


def cell_years(column: Column, label: Column, section: Column, ancestors: Column,
               table_years: Column) -> Column:
    """Years of a cell from the most specific text that names any."""
    return F.coalesce(years_of_column(column), years_of_row(label, section, ancestors, table_years))


def _in_order(years: Column) -> Column:
    """Each year once, in order."""
    return let(years, lambda y: F.when(F.size(y) > 1, F.array_sort(F.array_distinct(y))).otherwise(y))


def years_of_row(label: Column, section: Column, ancestors: Column, table_years: Column) -> Column:
    """Years of a row's cells whose columns name none."""
    def or_else(years: Column, less: Column) -> Column:
        return let(years, lambda y: F.when(F.size(y) > 0, y).otherwise(less))

    found = F.coalesce(table_years, F.array().cast("array<int>"))
    for text in (F.array_join(ancestors, " "), section, label):
        found = or_else(parse_years(text), found)
    return _in_order(found)


def years_of_column(column: Column) -> Column:
    """Years that a column names; NULL when it names none."""
    return let(_in_order(parse_years(column)), lambda y: F.when(F.size(y) > 0, y))


def two_digit_year(year: Column) -> Column:
    """`2023` -> `23`; anything but a four-digit survey year is an error."""
    checked = F.when(
        year.between(MIN_CATALOG_YEAR, MAX_CATALOG_YEAR),
        F.lpad(F.pmod(year, F.lit(100)).cast("string"), 2, "0"),
    )
    problem = F.concat(
        F.lit(f"year must be between {MIN_CATALOG_YEAR} and {MAX_CATALOG_YEAR}, got "),
        F.coalesce(year.cast("string"), F.lit("NULL")),
    )
    return F.coalesce(checked, F.raise_error(problem).cast("string"))


def academic_year_label(year: Column) -> Column:
    """`1999` -> `1999-00`."""
    return F.format_string("%d-%02d", year, F.pmod(year + 1, F.lit(100)))
