"""Cell values, number coercion, and the predicates that judge answers."""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tablelake.fixed_values import (MISSING_MARKERS, NUMBER_TOKEN, QUALIFIER_THRESHOLD)
from tablelake.functions.text import let, normalize_label, strip

# What reads as a number. Spark's own cast would also take `5d` and `1f`.
_DIGITS = r"[0-9]+(?:_[0-9]+)*"
_NUMBER = (rf"[+-]?(?:(?:{_DIGITS}\.?(?:{_DIGITS})?|\.{_DIGITS})(?:[eE][+-]?{_DIGITS})?"
           r"|[iI][nN][fF](?:[iI][nN][iI][tT][yY])?|[nN][aA][nN])")
_WHOLE = rf"^\s*({_NUMBER})\s*$"
# In a cell a number may stand in brackets (both or none) and be flagged by `!`.
_PLAIN = r"^-?[0-9]+(?:\.[0-9]+)?\z"
_CELL = rf"^(?=\s*\(.*\)\s*!*\s*$|[^()]*$)\s*\(?\s*({_NUMBER})\s*\)?\s*!*\s*$"


def _as_double(number: Column) -> Column:
    """NULL for the empty text a pattern without a match leaves; casting that would be slow."""
    return F.when(number != "", F.when(number.contains("_"), F.translate(number, "_", "")).otherwise(number).try_cast("double"))


def to_number(text: Column) -> Column:
    """Double, or NULL when the text is not a number as a whole."""
    return let(F.regexp_extract(text, "(?U)" + _WHOLE, 1), _as_double)


def parse_value(raw: Column) -> Column:
    """`struct(num, text, is_int)`: a number, or the marker/text; all NULL when blank.

    Parentheses mark standard errors and are only unwrapped, never negated.
    The pattern that finds the number runs once per cell, and not at all on plain digits, which are a number as they are.
    """
    def judged(number: Column) -> Column:
        return let(_as_double(number), lambda num: F.struct(
            num.alias("num"),
            F.when(num.isNull(), F.nullif(strip(raw), F.lit(""))).alias("text"),
            (num.isNotNull() & number.rlike("^-?[0-9]+$")).alias("is_int"),
        ))

    plain = F.struct(raw.try_cast("double").alias("num"), F.lit(None).cast("string").alias("text"), (~raw.contains(".")).alias("is_int"))
    found = F.regexp_extract(F.translate(raw, ",$", ""), "(?U)" + _CELL, 1)
    return F.when(raw.rlike(_PLAIN), plain).otherwise(let(F.coalesce(found, F.lit("")), judged))


def is_number(value: Column) -> Column:
    return value["num"].isNotNull()


def usable(value: Column) -> Column:
    """A number, or a text that is neither blank nor a missing marker."""
    bare = strip(F.coalesce(value["text"], F.lit("")))
    return is_number(value) | ((bare != "") & ~bare.isin(*MISSING_MARKERS))


def coerce_number(answer: Column) -> Column:
    """A predicted number, tolerating `$1,234` and `45.6%`."""
    return to_number(F.regexp_replace(answer, r"(?U)[,$%\s]", ""))


def within_tolerance(got: Column, want: Column, tolerance: Column) -> Column:
    """Inclusive relative tolerance; a wanted zero must be met exactly."""
    close = F.abs(got - want) <= F.abs(want) * tolerance
    return F.coalesce(close & ~F.isnan(got) & ~F.isnan(want), F.lit(False))


def same_label(got: Column, want: Column) -> Column:
    return normalize_label(got) == normalize_label(want)


def leaks_answer(question: Column, answer: Column, years: Column) -> Column:
    """Does a number in the question equal the numeric answer, years aside?"""
    tokens = F.regexp_extract_all(question, F.lit(NUMBER_TOKEN), F.lit(0))
    numbers = F.transform(tokens, lambda t: F.replace(t, F.lit(","), F.lit("")).try_cast("double"))
    allowed = F.coalesce(years, F.array().cast("array<int>")).cast("array<double>")
    hit = F.exists(numbers, lambda n: (n == answer) & ~F.array_contains(allowed, n))
    return F.coalesce(F.when(answer.isNotNull(), hit), F.lit(False))


def qualifiers_kept(question: Column, tokens: Column, years: Column,
                    threshold: float = QUALIFIER_THRESHOLD) -> Column:
    """Enough of the distinct tokens survive, and one of the years does."""
    stem = lambda t: F.when((F.length(t) > 3) & t.endswith("s"),
                            t.substr(F.lit(1), F.length(t) - 1)).otherwise(t)

    def judged(text: Column, wanted: Column) -> Column:
        kept = F.filter(wanted, lambda t: F.contains(text, stem(t)))
        enough = (F.size(wanted) == 0) | (F.size(kept) / F.nullif(F.size(wanted), F.lit(0)) >= threshold)
        dated = (F.size(years) == 0) | F.exists(years, lambda y: F.contains(text, y.cast("string")))
        return enough & dated

    # The text is put in order once, not once for each token looked for.
    ordered = F.regexp_replace(F.lower(F.coalesce(question, F.lit(""))), r"(?U)[,\s]+", " ")
    return let(ordered, lambda text: let(F.array_distinct(tokens), lambda wanted: judged(text, wanted)))
