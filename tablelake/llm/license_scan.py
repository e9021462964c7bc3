"""License scans by conditional compression.

A text is one sequence of words: line breaks and comment marks between them don't count, so a notice may stand in a paragraph or be wrapped.
Around the cue words of each template, windows about as long as the template are slid by word, and those that hold enough of its words in
order (longest common subsequence, bit-parallel) are cut to their tightest span. Spans are compressed alone and with the template as a zstandard
raw dictionary, and ranked by the bytes saved against what the template alone costs. The exact differences in wording go with the result: words of the
template that are absent and words that are not the template's.
"""
from __future__ import annotations

import difflib
import heapq
import math
import re
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablelake.llm.common import only

# ---- fixed values: wording of license notices, and words that mark a candidate line ----
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0",
    "MIT": "Released under the MIT License",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3",
    "GPL-2.0": "This work is licensed under the GNU General Public License, version 2",
    "LGPL-3.0": "This work is licensed under the GNU Lesser General Public License, version 3",
    "AGPL-3.0": "This work is licensed under the GNU Affero General Public License, version 3",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0",
    "BSD-3-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "CC-BY-4.0": "Licensed under CC BY 4.0",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0",
    "CC0-1.0": "To the extent possible under law, the author has waived all copyright and related rights to this work",
}
#: Longer wordings of some of them: grants and usual source headers.
HEADERS = {
    "MIT": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction",
    "GPL-3.0": "under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License",
    "GPL-2.0": "under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License",
    "LGPL-3.0": "under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License",
    "AGPL-3.0": "under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License",
}
#: Names without which a wording is not the license's (a near spelling will do): "released under the new license" is not MIT.
PROPER = {"apache", "mit", "gnu", "mozilla", "cc"}
#: Words that are never cues while a wording has others.
COMMON = {"the", "this", "that", "and", "with", "without", "under", "use", "are", "has", "all", "any", "work", "terms", "subject", "following", "forms", "form", "version", "to", "of", "is", "in", "or", "by"}
# ---- end of fixed values ----

LEVEL = 19
#: Share of the template's own compressed size that it must save on a span, and of its words that must be there.
LEAST_SAVED, LEAST_WORDS = 0.25, 0.8

_WORD = re.compile(r"[^\W_]+(?:[.-][^\W_]+)*")
#: Comment marks that are words; other marks are none.
_MARK = re.compile(r"^[ \t]*(?:rem|dnl)(?=[ \t])", re.I | re.M)


class Wording:
    """A template's words, its cues, and its compressor."""

    def __init__(self, name: str, text: str):
        self.name, self.words = name, _WORD.findall(text.lower())
        self.n = len(self.words)
        self.least = max(1, math.ceil(LEAST_WORDS * self.n))
        #: Words of the longest span: the template's, as many others, and a few.
        self.width = 2 * self.n + 4
        self.masks: dict[str, int] = {}
        for i, w in enumerate(self.words):
            self.masks[w] = self.masks.get(w, 0) | 1 << i
        # No span can hold enough of the words without one of these: lacking them all is one word too many.
        order = sorted(self.masks, key=lambda w: (w in COMMON, not w.isalpha(), -len(w), w))
        self.cues = set(order[: self.n - self.least + 1])
        data = " ".join(self.words).encode()
        self.given = zstandard.ZstdCompressor(level=LEVEL, dict_data=zstandard.ZstdCompressionDict(data, dict_type=zstandard.DICT_TYPE_RAWCONTENT))
        self.cost = len(zstandard.ZstdCompressor(level=LEVEL).compress(data))

    def best(self, words: list[str], start: int, stop: int) -> tuple[int, int]:
        """`(common, end)`: most words in order of any span from `start`, at most `width` long and before `stop`, and where the shortest such ends."""
        ones = (1 << self.n) - 1
        v, common, end = ones, 0, start
        for at in range(start, min(stop, start + self.width)):
            if u := v & self.masks.get(words[at], 0):
                v = (v + u | v - u) & ones
                if (now := self.n - v.bit_count()) > common:
                    common, end = now, at + 1
        return common, end

    def spans(self, words: list[str]) -> list[tuple[int, int]]:
        """Spans of `words`, none overlapping another, that hold enough of the template's: most words first, then the shortest."""
        starts: set[int] = set()
        low = 0
        for cue in (i for i, w in enumerate(words) if w in self.cues):
            a, b = max(low, cue - self.width + 1), cue + 1
            near = words[max(0, cue - self.width + 1) : cue + self.width]
            if len(self.masks.keys() & near) >= len(self.masks) - (self.n - self.least):
                starts.update(i for i in range(a, b) if words[i] in self.masks)
                low = b
        heap, taken = [], [False] * len(words) if starts else []

        def push(start: int, stop: int) -> None:
            common, end = self.best(words, start, stop)
            if common >= self.least:
                heapq.heappush(heap, (-common, end - start, start))

        for start in starts:
            push(start, len(words))
        out = []
        while heap:
            _, length, start = heapq.heappop(heap)
            met = next((i for i in range(start, start + length) if taken[i]), None)
            if met is None:
                taken[start : start + length] = [True] * length
                out.append((start, start + length))
            elif met > start:
                push(start, met)  # what is left before a span taken already
        return out


class Scanner:
    """All wordings of all templates, and the comparison of wordings."""

    def __init__(self, templates: dict[str, str]):
        self.wordings = [Wording(n, t) for n in sorted(templates) for t in (templates[n], HEADERS.get(n)) if t]
        self.alone = zstandard.ZstdCompressor(level=LEVEL)
        self.known: dict[tuple, tuple] = {}

    def differences(self, own: list[str], want: list[str]) -> tuple[list[str], list[str]]:
        """`(absent, extra)` words of a span by a longest common subsequence with the template's."""
        best = [[0] * (len(want) + 1) for _ in range(len(own) + 1)]
        for i in range(len(own) - 1, -1, -1):
            for j in range(len(want) - 1, -1, -1):
                best[i][j] = best[i + 1][j + 1] + 1 if own[i] == want[j] else max(best[i + 1][j], best[i][j + 1])
        i = j = 0
        absent, extra = [], []
        while i < len(own) and j < len(want):
            if own[i] == want[j]:
                i, j = i + 1, j + 1
            elif best[i + 1][j] >= best[i][j + 1]:
                extra.append(own[i])
                i += 1
            else:
                absent.append(want[j])
                j += 1
        return absent + want[j:], extra + own[i:]

    def judge(self, words: list[str], wording: Wording):
        """`(saved, absent, extra)` of a span, or None."""
        key = (id(wording), *words)
        if key not in self.known:
            if len(self.known) > 10_000:
                self.known.clear()
            data = " ".join(words).encode()
            saved = (len(self.alone.compress(data)) - len(wording.given.compress(data))) / wording.cost
            absent, extra = self.differences(words, wording.words)
            named = all(difflib.get_close_matches(w, extra, 1, 0.75) for w in PROPER.intersection(absent))
            self.known[key] = (saved, absent, extra) if saved >= LEAST_SAVED and named else None
        return self.known[key]

    def notices(self, text: str) -> list[tuple]:
        """`(start, end, license, saved, absent, extra)` of the notices of a text by place, in code points.

        Of spans that lie within one another, and of overlapping ones of one license, the best stays: a word-for-word one, then the one that saves most.
        A span that overlaps a better one of another license stays if it has words of its own, as in "CC BY 4.0 and CC BY-SA 4.0".
        """
        found = list(_WORD.finditer(_MARK.sub(lambda m: " " * len(m[0]), text)))
        words = [m[0].lower() for m in found]
        have, spans = set(words), []
        for wording in self.wordings:
            if have.isdisjoint(wording.cues):
                continue
            for a, b in wording.spans(words):
                if (judged := self.judge(words[a:b], wording)) is not None:
                    saved, absent, extra = judged
                    spans.append((bool(absent or extra), -saved, wording.name, a, b, absent, extra, wording))
        kept = []
        for span in sorted(spans, key=lambda x: x[:5]):
            if not any(self._explained(words, span, other) for other in kept):
                kept.append(span)
        return [(found[a].start(), found[b - 1].end(), name, -lost, absent, extra) for _, lost, name, a, b, absent, extra, _ in sorted(kept, key=lambda x: x[3:5])]

    def _explained(self, words: list[str], span: tuple, better: tuple) -> bool:
        """Whether a better span holds this one, overlaps it with the same license, or has enough of its words while one stray word is outside."""
        (_, _, name, a, b, *_, wording), (_, _, other, c, d, *_) = span, better
        if c <= a and b <= d or name == other and a < d and c < b:
            return True
        if a >= d or c >= b or max(wording.best(words, i, min(b, d))[0] for i in range(max(a, c), min(b, d))) < wording.least:
            return False
        joined = b > d and words[d] in ("or", "and")
        return not joined and all(wording.best(words, i, stop)[0] < 2 for at, stop in ((a, c), (d, b)) for i in range(at, stop))


def cue(templates: dict[str, str]) -> str:
    """A pattern that every text with a notice matches."""
    words = sorted({c for w in Scanner(templates).wordings for c in w.cues})
    return r"(?iu)(?<![\p{L}\p{N}])(?:" + "|".join(re.escape(w) for w in words) + r")(?![\p{L}\p{N}])" if words else r"(?!)"


SCHEMA = "start long, end long, license string, saved double, absent string, extra string, exact boolean"


def scan(docs: DataFrame, templates: dict[str, str] = TEMPLATES) -> DataFrame:
    """License notices in every row of `docs` (`doc_id`, `text`), one row each, wherever in the text they stand.

    Returns `doc_id, start, end` (of the notice's words, in code points, end exclusive), `license, saved` (bytes that the template saves on the
    span, as a share of its own compressed size), `absent` and `extra` (words of the template not there, and words between that are not its, space-joined)
    and `exact` (neither). Null and empty texts, and texts without a confirmed span, give no row; repeated rows give theirs each. Other
    columns are not read.
    """
    rows = only(docs, "doc_id", "text")
    kind = rows.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(templates)
        for batch in batches:
            out, of = [], []
            for row, text in enumerate(batch.column(1).to_pylist()):
                for start, end, name, saved, absent, extra in scanner.notices(text or ""):
                    of.append(row)
                    out.append((start, end, name, saved, " ".join(absent), " ".join(extra), not absent and not extra))
            columns = list(zip(*out)) or [()] * 7
            types = [pa.int64(), pa.int64(), pa.string(), pa.float64(), pa.string(), pa.string(), pa.bool_()]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(of, pa.int64())), *[pa.array(c, t) for c, t in zip(columns, types)]],
                                             ["doc_id", "start", "end", "license", "saved", "absent", "extra", "exact"])

    return rows.where(F.col("text").rlike(cue(templates))).mapInArrow(run, f"doc_id {kind}, {SCHEMA}")
