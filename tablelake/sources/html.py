"""Tables and links of HTML pages.

Reading tags needs a tokeniser, so this is one of the few steps that runs in
Python workers, batch by batch over Arrow. It only cuts a page into tables and
anchors, one row per page; what they mean is decided by column expressions
afterwards. Work and output of a page stay in proportion to its length: texts
are cut out of one list of pieces, spans are kept as intervals.
"""
from __future__ import annotations

import heapq
import re
from collections import Counter
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablelake.fixed_values import HEADER_SCAN_ROWS
from tablelake.session import materialise

_VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
_UNREAD = frozenset(("script", "style", "template"))

#: Pages go back to Spark as soon as so many characters of them have been read.
BATCH_CHARACTERS = 1 << 19
#: Header columns and stretches of a table, for each character of its page, beyond which the page is refused.
GRID_SHARE = 16
#: Characters of an anchor's text that headings are told and named by.
LEAD = 256

TABLE_FIELDS = (
    "tables array<struct<pos:int,class:string,caption:string,rows:array<struct<idx:int,text:string,"
    "cells:array<struct<tag:string,colspan:int,rowspan:int,full_text:string,text:string,indent:int>>,"
    "grid:array<struct<width:int,text:string>>>>>>, error string"
)
ANCHOR_FIELDS = (
    "anchors array<struct<pos:int,href:string,lead:string,item:int,label:string,item_text:string>>, "
    "items array<struct<first:int,last:int>>"
)
_CELL = pa.struct([("tag", pa.string()), ("colspan", pa.int32()), ("rowspan", pa.int32()),
                   ("full_text", pa.string()), ("text", pa.string()), ("indent", pa.int32())])
_ROW = pa.struct([("idx", pa.int32()), ("text", pa.string()), ("cells", pa.list_(_CELL)),
                  ("grid", pa.list_(pa.struct([("width", pa.int32()), ("text", pa.string())])))])
_TABLE = pa.struct([("pos", pa.int32()), ("class", pa.string()), ("caption", pa.string()), ("rows", pa.list_(_ROW))])
_ANCHOR = pa.struct([("pos", pa.int32()), ("href", pa.string()), ("lead", pa.string()), ("item", pa.int32()),
                     ("label", pa.string()), ("item_text", pa.string())])
_ITEM = pa.struct([("first", pa.int32()), ("last", pa.int32())])


class _Node:
    """An element whose text or children are wanted later. Its text are the pieces from `start` to `end`."""

    __slots__ = ("tag", "attrs", "children", "sup", "pos", "caption", "start", "end", "first", "last")

    def __init__(self, tag, attrs, sup, pos, start, first):
        self.tag, self.attrs, self.sup, self.pos, self.start, self.first = tag, attrs, sup, pos, start, first
        self.children, self.caption, self.end, self.last = [], None, None, None


class PageReader(HTMLParser):
    """Collects tables (rows, cells), anchors and list items; an item holds the anchors from `first` to before `last`."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.open: list[tuple[str, _Node | None]] = []
        self.count: Counter = Counter()
        self.inside: dict[str, list[_Node]] = {"table": [], "tr": [], "li": []}
        self.pieces: list[str] = []
        self.marks: list[int] = []
        self.tables: list[_Node] = []
        self.items: list[_Node] = []
        self.anchors: list[tuple[_Node, _Node | None]] = []

    def handle_starttag(self, tag, attrs):
        if tag in _VOID:
            return
        node, inside = None, self.inside
        if tag in ("table", "tr", "td", "th", "caption", "a", "li"):
            pos = len(self.tables) if tag == "table" else len(self.items)
            node = _Node(tag, dict(attrs), self.count["sup"], pos, len(self.pieces), len(self.anchors))
        if tag == "table":
            self.tables.append(node)
        elif tag == "tr":
            for table in inside["table"]:
                table.children.append(node)
        elif tag in ("td", "th"):
            for row in inside["tr"]:
                row.children.append(node)
        elif tag == "caption":
            for table in inside["table"]:
                table.caption = table.caption or node
        elif tag == "li":
            self.items.append(node)
        elif tag == "a":
            self.anchors.append((node, inside["li"][-1] if inside["li"] else None))
        if tag in inside:
            inside[tag].append(node)
        self.count[tag] += 1
        self.open.append((tag, node))

    def _close_last(self) -> str:
        tag, node = self.open.pop()
        self.count[tag] -= 1
        if tag in self.inside:
            self.inside[tag].pop()
        if node is not None:
            node.end, node.last = len(self.pieces), len(self.anchors)
        return tag

    def handle_endtag(self, tag):
        if self.count[tag]:
            while self._close_last() != tag:
                pass

    def handle_data(self, data):
        if not (self.open and self.open[-1][0] in _UNREAD):
            self.pieces.append(data)
            self.marks.append(self.count["sup"])

    def close(self):
        super().close()
        while self.open:
            self._close_last()

    def text(self, node: _Node) -> str:
        return _squeeze(self.pieces[node.start : node.end])

    def unmarked(self, node: _Node) -> str:
        """Text without footnote marks: pieces inside more `<sup>` than the element itself."""
        marks = self.marks[node.start : node.end]
        return _squeeze([t for t, mark in zip(self.pieces[node.start : node.end], marks) if mark <= node.sup])

    def indent(self, node: _Node) -> int:
        """Two leading spaces (plain or no-break) make one level; tabs and newlines do not count."""
        raw = "".join(self.pieces[node.start : node.end]).replace("\t", "").replace("\n", "")
        return (len(raw) - len(raw.lstrip("\xa0 "))) // 2

    def lead(self, node: _Node) -> str:
        """The first LEAD characters of the text, without reading the rest of it."""
        size, out = 8, ""
        while node.start < node.end:
            pieces = self.pieces[node.start : min(node.end, node.start + size)]
            out = _squeeze([p[: 16 * LEAD] for p in pieces]) or _squeeze(pieces)
            if len(out) >= LEAD or node.start + size >= node.end:
                break
            size *= 4
        return out[:LEAD]


def _squeeze(pieces: list[str]) -> str:
    return " ".join((pieces[0] if len(pieces) == 1 else " ".join(pieces)).split())


def _read(html: str) -> PageReader:
    reader = PageReader()
    reader.feed(html or "")
    reader.close()
    return reader


def _span(cell: _Node, name: str) -> int | None:
    """A missing or empty span is 1; None when it is not a number."""
    try:
        return int(cell.attrs.get(name) or 1)
    except ValueError:
        return None


def _stretches(painted: list[tuple[int, int, str]], width: int) -> list[dict]:
    """Columns 0 to `width` as stretches with one text, of intervals `from, to, text` the last one over a column: a sweep over their ends."""
    cuts = sorted({0, width, *(x for start, end, _ in painted for x in (start, end))})
    coming = sorted(range(len(painted)), key=lambda i: painted[i][0])
    over, out, k = [], [], 0
    for a, b in zip(cuts, cuts[1:]):
        while k < len(coming) and painted[coming[k]][0] <= a:
            heapq.heappush(over, -coming[k])
            k += 1
        while over and painted[-over[0]][1] <= a:
            heapq.heappop(over)
        out.append({"width": b - a, "text": painted[-over[0]][2] if over else ""})
    return out


class _Grid:
    """Places the cells of header rows left to right past the columns that spans from above hold."""

    def __init__(self, most: int):
        self.held: list[tuple[int, int, int, str]] = []
        self.row = self.size = 0
        self.most = most

    def place(self, cells: list[dict]) -> list[dict]:
        """The next row as stretches of columns. Spans may overlap; the later cell is seen."""
        self.held = [h for h in self.held if h[2] > self.row]
        taken = sorted((start, end) for start, end, _, _ in self.held)
        own, col, width, k = [], 0, 0, 0
        for cell in cells:
            while k < len(taken) and taken[k][0] <= col:
                col = max(col, taken[k][1])
                k += 1
            across = 1 if cell["colspan"] is None else cell["colspan"]
            down = 1 if cell["rowspan"] is None else cell["rowspan"]
            if across > 0 and down > 0:
                own.append((col, col + across, self.row + down, cell["text"]))
            if across < 0:
                k = 0
            col += across
            width = max(width, col)
        self.held += own
        width = max([width, *(end for _, end, _, _ in self.held)])
        out = _stretches([(start, end, text) for start, end, _, text in self.held], width) if width else []
        self.row += 1
        self.size += width + len(out)
        if self.size > self.most:
            raise ValueError(f"a header of {self.size} columns and cells")
        return out


def _cell(page: PageReader, cell: _Node) -> dict:
    """A cell's fields; one without marks, or without a space in front, has no second text and no indent to be worked out."""
    pieces, marks = page.pieces[cell.start : cell.end], page.marks[cell.start : cell.end]
    full = _squeeze(pieces)
    text = page.unmarked(cell) if marks and max(marks) > cell.sup else full
    indent = page.indent(cell) if pieces and not (pieces[0] and pieces[0][0] > " " and pieces[0][0] != "\xa0") else 0
    return {"tag": cell.tag, "colspan": _span(cell, "colspan") if cell.attrs else 1, "rowspan": _span(cell, "rowspan") if cell.attrs else 1,
            "full_text": full, "text": text, "indent": indent}


def _cells(page: PageReader, row: _Node) -> list[dict]:
    return [_cell(page, cell) for cell in row.children]


def page_tables(html: str) -> tuple[list[dict] | None, str | None]:
    """`(tables, error)`; a page that cannot be read has the error alone. A table's rows include those of tables inside it."""
    try:
        page, out = _read(html), []
        for table in page.tables:
            grid, heading, rows = _Grid(GRID_SHARE * len(html) + 64), True, []
            for idx, row in enumerate(table.children):
                cells = _cells(page, row)
                # Only rows that may belong to the header need their grid place.
                heading = heading and bool(cells) and all(c["tag"] == "th" for c in cells)
                placed = grid.place(cells) if cells and (heading or idx < HEADER_SCAN_ROWS) else None
                rows.append({"idx": idx, "text": page.text(row), "cells": cells, "grid": placed})
            caption = page.text(table.caption) if table.caption else None
            out.append({"pos": table.pos, "class": table.attrs.get("class"), "caption": caption, "rows": rows})
        return out, None
    except (AssertionError, ValueError) as problem:
        return None, f"unreadable page: {problem}"


def page_anchors(html: str, wanted: str = "") -> tuple[list[dict], list[dict]]:
    """`(anchors, items)`: anchors in order with the number of their innermost list item, items with the anchors they hold.

    Only anchors whose href has `wanted` carry their texts and their item's, so nested anchors do not repeat them.
    """
    page, has = _read(html), re.compile(wanted, re.IGNORECASE | re.ASCII).search
    anchors = []
    for pos, (node, item) in enumerate(page.anchors):
        href = node.attrs.get("href")
        named = href is not None and has(href)
        anchors.append({"pos": pos, "href": href, "lead": page.lead(node), "item": item.pos if item else None,
                        "label": page.text(node) if named else None, "item_text": page.text(item) if named and item else None})
    return anchors, [{"first": item.first, "last": item.last} for item in page.items]


def _map_pages(pages: DataFrame, html: str, fields: str, types: list, read) -> DataFrame:
    """`pages` with `html` replaced by what `read` makes of it, in batches of bounded text."""
    kept = [c for c in pages.columns if c != html]
    names = [*kept, *re.findall(r"(?:^|, )(\w+) (?=array|string)", fields)]

    def run(batches):
        for batch in batches:
            rest = [batch.column(i) for i in range(len(kept))]
            texts, first, size, held = batch.column(len(kept)), 0, 0, []
            for at in range(batch.num_rows):
                text = texts[at].as_py()
                held.append(read(text))
                size += len(text or "")
                if size >= BATCH_CHARACTERS or at == batch.num_rows - 1:
                    made = [pa.array(c, t) for c, t in zip(zip(*held), types)]
                    yield pa.RecordBatch.from_arrays([*(c.slice(first, at + 1 - first) for c in rest), *made], names)
                    first, size, held = at + 1, 0, []

    chosen = pages.select(*[pages[f"`{c}`"] for c in kept], pages[f"`{html}`"])
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in chosen.schema.fields[:-1])
    return chosen.mapInArrow(run, ", ".join(filter(None, (schema, fields))))


def extract_tables(pages: DataFrame, html: str = "html") -> DataFrame:
    """`pages` with `tables` and `error` in place of `html`: one row per page, every table with its rows and cells."""
    return _map_pages(pages, html, TABLE_FIELDS, [pa.list_(_TABLE), pa.string()], page_tables)


def extract_anchors(pages: DataFrame, wanted: str, html: str = "html") -> DataFrame:
    """`pages` with `anchors` and `items` in place of `html`, one row per page."""
    return _map_pages(pages, html, ANCHOR_FIELDS, [pa.list_(_ANCHOR), pa.list_(_ITEM)], lambda text: page_anchors(text, wanted))


def one_per_key(pages: DataFrame, key: str = "page_key", first: str | None = None) -> DataFrame:
    """One page per key, the one with the least value in the column `first` if given. Copies of a page, however many, shrink map-side.

    Repeated keys are found on keys alone and written, so that only their pages go through the shuffle; a null key is a key.
    """
    counts = pages.groupBy(F.col(key).alias("_key")).agg(F.count(F.lit(1)).alias("n"))
    repeated = materialise(counts.where("n > 1").select("_key"), "repeated-pages")
    same = pages[key].eqNullSafe(repeated["_key"])
    rest = sorted((c for c in pages.columns if c != key), key=lambda c: c != first)
    copies = pages.join(repeated, same, "left_semi").groupBy(key).agg(F.min(F.struct(*rest)).alias("page")).select(key, "page.*")
    return pages.join(repeated, same, "left_anti").unionByName(copies)
