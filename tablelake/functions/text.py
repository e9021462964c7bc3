"""Label and text expressions. All stay inside the JVM."""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tablelake.fixed_values import STOPWORDS, TOTAL_LABEL, YEAR_LABEL

# Whitespace as the source texts use it: Unicode spaces plus the C0 separators.
SPACE = r"[\s\x1c-\x1f]"
_SPACES = "".join(c for c in map(chr, range(0x3001)) if c.isspace())


def let(value: Column, body) -> Column:
    """`body(value)` with `value` evaluated once, for values that are costly and used often."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def strip(c: Column) -> Column:
    """Whitespace of any kind removed from both ends."""
    return F.trim(c, F.lit(_SPACES))


def clean_text(c: Column) -> Column:
    """One space for each run of whitespace (no-break spaces too), ends trimmed."""
    return F.trim(F.regexp_replace(c, rf"(?U){SPACE}+", " "))


def is_total(label: Column) -> Column:
    return label.rlike("(?iU)" + TOTAL_LABEL)


def is_year_label(label: Column) -> Column:
    return (label.contains("19") | label.contains("20")) & label.rlike("(?U)" + YEAR_LABEL)


def topic(title: Column) -> Column:
    """Subject of a title: no table number in front, nothing after the last colon."""
    named = F.regexp_replace(title, r"(?U)^Table\s+[\d.]+\.\s*", "")
    return strip(F.regexp_replace(named, r":[^:]*\z", ""))


def unhyphenate(c: Column) -> Column:
    """`Non- profit` -> `Non-profit`. A text without a dash is not searched."""
    return F.when(c.contains("-"), F.regexp_replace(c, r"(?U)(\w)-\s+(?=[a-z])", "$1-")).otherwise(F.coalesce(c, F.lit("")))


def header_parts(column: Column) -> Column:
    parts = F.transform(F.split(column, r"\|"), strip)
    return F.filter(parts, lambda p: p != "")


def column_path(column: Column, drop_years: Column | bool = False) -> Column:
    """Levels of a `a | b` header, optionally without those that are only a year."""
    parts = F.transform(header_parts(column), unhyphenate)
    if isinstance(drop_years, bool):
        return F.filter(parts, lambda p: ~is_year_label(p)) if drop_years else parts
    return let(drop_years, lambda drop: F.filter(parts, lambda p: ~(drop & is_year_label(p))))


def year_label(column: Column, years: Column) -> Column:
    """The column's own year wording, else its first two years joined by a dash."""
    return F.coalesce(own_year_label(column), F.array_join(F.slice(years.cast("array<string>"), 1, 2), "-"))


def own_year_label(column: Column) -> Column:
    """The last level of a header that is only a year; NULL without any."""
    return F.try_element_at(F.filter(header_parts(F.coalesce(column, F.lit(""))), is_year_label), F.lit(-1))


def padded(number: Column, width: int) -> Column:
    """`%0<width>d` of a number; the slow general format is left to those that it does not fit."""
    return F.when(number.between(0, 10 ** width - 1), F.lpad(number.cast("string"), width, "0")).otherwise(F.format_string(f"%0{width}d", number))


def row_path(ancestors: Column, label: Column) -> Column:
    return F.array_join(F.concat(ancestors, F.array(label)), " > ")


UNITS = ("percent", "dollars", "ratio", "count")


def unit_rank(text: Column) -> Column:
    """Place in UNITS of the first unit that a text names."""
    text = F.lower(F.coalesce(text, F.lit("")))
    return (
        F.when(text.contains("percent") | text.contains("%"), 0)
        .when(text.contains("dollar") | text.contains("salary") | text.contains("tuition"), 1)
        .when(text.contains("ratio"), 2)
        .otherwise(3)
    )


def unit_at(rank: Column) -> Column:
    return F.get(F.array(*map(F.lit, UNITS)), rank)


def infer_unit(column: Column, title: Column) -> Column:
    return unit_at(F.least(unit_rank(column), unit_rank(title)))


def describe(*pairs: tuple[str, Column]) -> Column:
    """`key: value` lines; NULL and empty values leave no line."""
    lines = [F.when(value != "", F.concat(F.lit(f"{key}: "), value)) for key, value in pairs]
    return F.concat_ws("\n", *lines)


def distinctive_tokens(c: Column) -> Column:
    """Lower-case words of three letters or more that are not stopwords, in order."""
    words = F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit(r"[A-Za-z0-9\-]{3,}"), F.lit(0))
    return F.filter(words, lambda w: ~w.isin(*STOPWORDS))


def normalize_label(c: Column) -> Column:
    """Lower case, letters and digits only, single spaces. NULL reads as `none`."""
    lowered = F.lower(F.coalesce(c, F.lit("None")))
    return clean_text(F.regexp_replace(lowered, r"(?U)[^a-z0-9\s]", " "))


def slug(c: Column, length: int) -> Column:
    """Lower-case words joined by dashes, cut to `length`."""
    dashed = F.regexp_replace(F.lower(c), "[^a-z0-9]+", "-")
    return F.substring(F.regexp_replace(dashed, "^-+|-+$", ""), 1, length)


def context_text(title: Column, coverage: Column, body: Column) -> Column:
    """What a summariser is told about one table."""
    stated = lambda c: F.coalesce(F.nullif(c, F.lit("")), F.lit("(none)"))
    return F.concat(
        F.lit("Table title: "), stated(title),
        F.lit("\nYear coverage: "), stated(coverage),
        F.lit("\n\nDescription:\n"), body,
    )
