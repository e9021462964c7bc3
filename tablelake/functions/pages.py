"""Page bodies, page keys and source notes."""
from __future__ import annotations

import re
from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from tablelake.fixed_values import SURVEY_PATTERNS
from tablelake.functions.text import let

# Windows-1252 differs from Latin-1 in this block only; unassigned codes read as U+FFFD.
_LATIN_BLOCK = bytes(range(0x80, 0xA0)).decode("latin-1")
_WINDOWS_BLOCK = bytes(range(0x80, 0xA0)).decode("cp1252", errors="replace")


def decode_body(body: Column) -> Column:
    """Text of a page body: UTF-8 when valid, else Windows-1252."""
    utf8 = body.cast("string")
    single_byte = F.translate(F.decode(body, "ISO-8859-1"), _LATIN_BLOCK, _WINDOWS_BLOCK)
    return F.when(F.is_valid_utf8(utf8), utf8).otherwise(single_byte)


def page_key(url: Column) -> Column:
    return F.concat(F.substring(F.sha2(url, 256), 1, 16), F.lit(".html"))


# Letters that equal an ASCII letter when case is ignored, but do not lower to it.
_FOLD_FROM, _FOLD_TO = "\u0130\u0131\u017f\u212a", "iisk"


def matches_any_case(text: Column, folded: Column, pattern: str) -> Column:
    """Case-insensitive search. Alternatives of plain ASCII words are looked up in
    `folded`, which costs a fraction of running the pattern over a long text."""
    words = pattern.split("|")
    if pattern.isascii() and not any(re.search(r"[\\.^$*+?{}\[\]()]", w) for w in words) and all(words):
        found = [F.contains(folded, F.lit(w.lower())) for w in words]
        return found[0] if len(found) == 1 else reduce(lambda a, b: a | b, found)
    return text.rlike(f"(?iu){pattern}")


def classify_sources(footnotes: Column, patterns: Mapping[str, str] = SURVEY_PATTERNS) -> Column:
    """Names of the surveys the SOURCE footnotes cite, in the order of `patterns`."""
    cited = F.filter(footnotes, lambda f: f.rlike(r"(?iU)^\s*source"))
    text = F.array_join(cited, " ")
    # Bound first, so that the notes are joined once.
    odd = reduce(lambda a, b: a | b, [F.contains(text, F.lit(c)) for c in _FOLD_FROM])
    folded = F.lower(F.when(odd, F.translate(text, _FOLD_FROM, _FOLD_TO)).otherwise(text))
    both = F.struct(text.alias("text"), folded.alias("folded"))
    return let(both, lambda t: F.array_compact(F.array(*[
        F.when(matches_any_case(t["text"], t["folded"], p), F.lit(name)) for name, p in patterns.items()])))


def only_source(surveys: Column, target: str) -> Column:
    return surveys == F.array(F.lit(target))
