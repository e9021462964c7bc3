"""Published report pages -> records with headers, sections, notes and years.

A page is one row from the parser on: its tables are arrays of rows, and each step below is a set of column expressions over
that row. Nothing is regrouped or joined on the way, so pages need no shuffle, and one page is bounded by the text it came from.
"""
from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablelake.fixed_values import (HEADER_SCAN_ROWS, MIN_ROW_YEAR_LABELS, NOTE_PREFIX,
                                    PLACEHOLDER_COLUMN, TARGET_SURVEY, YEAR_MAX, YEAR_MIN)
from tablelake.functions.pages import classify_sources, only_source
from tablelake.functions.values import parse_value
from tablelake.functions.years import parse_years, years_all_in, years_any_in, years_within
from tablelake.operators.once import computed_once
from tablelake.session import materialise
from tablelake.sources.html import extract_tables, one_per_key

PAGE = "page_key"
#: Rows a data table has at least.
LEAST_ROWS = 3
_NO_INTS = "array<int>"


def _none(kind: str) -> Column:
    return F.array().cast(kind)


def _step(df: DataFrame, **values: Column) -> DataFrame:
    """Adds the columns (or replaces them), each computed once."""
    names = list(values)
    step = computed_once(df, "_step", F.struct(*[v.alias(n) for n, v in values.items()]))
    kept = [F.col(f"`{c}`") for c in df.columns if c not in values]
    return step.select(*kept, *[F.col("_step")[n].alias(n) for n in names])


def _where(array: Column, test) -> Column:
    """Positions (from 0) of the elements that pass `test(element, position)`."""
    return F.array_compact(F.transform(array, lambda x, i: F.when(test(x, i), i)))


# ---- the table of a page -----------------------------------------------------------
def main_table(pages: DataFrame) -> DataFrame:
    """Takes `main`, the table with the most rows (the first one on ties), and `other_notes`, the rows of note tables, out of `tables`.

    `main` is null where no table has LEAST_ROWS rows.
    """
    best = F.array_max(F.transform("tables", lambda t: F.struct(F.size(t["rows"]).alias("n"), (-t["pos"]).alias("first"))))
    pages = _step(pages, best=best)
    is_best = lambda t: t["pos"] == -F.col("best")["first"]
    notes = F.filter("tables", lambda t: ~is_best(t) & F.lower(F.coalesce(t["class"], F.lit(""))).contains("note"))
    texts = F.flatten(F.transform(notes, lambda t: F.filter(F.transform(t["rows"], lambda r: r["text"]), lambda x: x != "")))
    main = F.when(F.col("best")["n"] >= LEAST_ROWS, F.get(F.filter("tables", is_best), F.lit(0)))
    return _step(pages, main=main, other_notes=F.coalesce(texts, _none("array<string>"))).drop("best", "tables")


def is_column_number_row(cells: Column) -> Column:
    """Do the cells, blanks at the end aside, read 1, 2, .. n (n at least 2)?"""
    texts = F.transform(cells, lambda c: c["full_text"])
    used = F.array_max(F.transform(texts, lambda t, i: F.when(t != "", i + 1).otherwise(F.lit(0))))
    texts = F.slice(texts, F.lit(1), F.greatest(used, F.lit(0)))
    numbered = F.forall(F.transform(texts, lambda t, i: (
        t.rlike("^[0-9]+$") & (t.try_cast("bigint") == i + 1))), lambda ok: F.coalesce(ok, F.lit(False)))
    return F.coalesce((used >= 2) & numbered, F.lit(False))


def split_header(pages: DataFrame) -> DataFrame:
    """Adds `split_at` (rows of `main` before it head the table) and `body_from`.

    Without a column-number row the leading all-`th` rows are the header, and
    the row after them is data.
    """
    rows = F.col("main")["rows"]
    numbered = F.array_min(_where(F.slice(rows, 1, HEADER_SCAN_ROWS), lambda r, i: is_column_number_row(r["cells"])))
    all_th = lambda r: (F.size(r["cells"]) > 0) & F.forall(r["cells"], lambda c: c["tag"] == "th")
    first_body = F.array_min(_where(rows, lambda r, i: ~all_th(r)))
    pages = _step(pages, numbered=numbered)
    return _step(pages, split_at=F.coalesce("numbered", first_body, F.size(rows)).cast("int")).withColumn(
        "body_from", F.coalesce(F.col("numbered") + 1, F.col("split_at"))).drop("numbered")


def level_path(levels: Column) -> Column:
    """Header levels joined by ` | `; blanks and repeats of the level above are skipped."""
    named = F.filter(levels, lambda t: t != "")
    kept = F.filter(named, lambda t, i: (i == 0) | (t != F.get(named, i - 1)))
    return F.array_join(kept, " | ")


def dedupe_names(names: Column) -> Column:
    """The n-th repeat of a name in an array gets ` (n)`, from the second on."""
    by_name = F.array_sort(F.transform(names, lambda x, i: F.struct(x.alias("name"), i.alias("at"))))
    sorted_names = F.transform(by_name, lambda s: s["name"])
    nth = lambda s, i: i - F.array_position(sorted_names, s["name"]).cast("int") + 2
    numbered = F.transform(by_name, lambda s, i: F.struct(s["at"].alias("at"), F.when(
        nth(s, i) > 1, F.concat(s["name"], F.lit(" ("), nth(s, i).cast("string"), F.lit(")"))).otherwise(s["name"]).alias("name")))
    return F.transform(F.array_sort(numbered), lambda s: s["name"])


def header_names(pages: DataFrame) -> DataFrame:
    """Adds `columns`, the names of all columns: the texts over each, from the stretches of the header rows."""
    heads = F.filter(F.slice(F.col("main")["rows"], F.lit(1), F.col("split_at")), lambda r: r["grid"].isNotNull())
    levels = F.transform(heads, lambda r: F.flatten(F.transform(r["grid"], lambda g: F.array_repeat(g["text"], g["width"]))))
    pages = _step(pages, levels=levels)
    width = F.coalesce(F.array_max(F.transform("levels", lambda x: F.size(x))), F.lit(0))
    every = F.when(width > 0, F.sequence(F.lit(0), width - 1)).otherwise(_none(_NO_INTS))
    path = lambda i: level_path(F.transform("levels", lambda x: F.coalesce(F.get(x, i), F.lit(""))))
    pages = _step(pages, columns=F.transform(every, lambda i: F.coalesce(
        F.nullif(path(i), F.lit("")), F.concat(F.lit("col_"), (i + 1).cast("string")))))
    return _step(pages, columns=dedupe_names(F.col("columns"))).drop("levels")


def bad_spans(pages: DataFrame) -> Column:
    """What keeps a table from being laid out: a span that is read is no number."""
    first = lambda r: F.get(r["cells"], F.lit(0))
    head = lambda r, i: (i < F.col("split_at")) & F.exists(r["cells"], lambda c: c["colspan"].isNull() | c["rowspan"].isNull())
    body = lambda r, i: (i >= F.col("body_from")) & (r["text"] != "") & (F.size(r["cells"]) > 1) & first(r)["colspan"].isNull()
    at = F.array_min(_where(pages["main"]["rows"], lambda r, i: head(r, i) | body(r, i)))
    return F.when(at.isNotNull(), F.concat(F.lit("span is not a number in row "), at.cast("string")))


def split_footnotes(pages: DataFrame) -> DataFrame:
    """Adds `notes` (texts of footnote rows) and `data` (data rows) of the body; other table-wide rows are dropped.

    A single cell is a note whatever it says, since nothing tells such a
    section row from a note.
    """
    body = F.filter(F.col("main")["rows"], lambda r, i: (
        (i >= F.col("body_from")) & (F.size(r["cells"]) > 0) & (r["text"] != "")))
    single = lambda r: F.size(r["cells"]) == 1
    spans = lambda r: single(r) | (F.get(r["cells"], F.lit(0))["colspan"] >= F.size("columns"))
    pages = _step(pages, body=body)
    note = lambda r: spans(r) & (single(r) | r["text"].rlike("(?U)" + NOTE_PREFIX))
    return _step(pages, notes=F.transform(F.filter("body", note), lambda r: r["text"]),
                 data=F.filter("body", lambda r: ~spans(r))).drop("body")


def build_records(pages: DataFrame) -> DataFrame:
    """Adds `records` made of `data`: `row_index, section, indent, row_label, cells`.

    A row with a label and no values heads the rows up to the next such row. Values beyond the last column are cut.
    """
    rows = _step(pages, lines=F.transform("data", lambda r: F.struct(
        F.get(r["cells"], F.lit(0))["indent"].alias("indent"), F.get(r["cells"], F.lit(0))["text"].alias("label"),
        F.transform(F.slice(r["cells"], F.lit(2), F.greatest(F.size(r["cells"]), F.lit(1))), lambda c: c["text"]).alias("values"))))
    heading = lambda x: F.forall(x["values"], lambda v: v == "")
    start = F.array(F.struct(F.lit(-1).alias("at"), F.lit("").alias("label")))
    heads = F.array_compact(F.transform("lines", lambda x, i: F.when(heading(x), F.struct(i.alias("at"), x["label"].alias("label")))))
    rows = _step(rows, heads=F.concat(start, heads))
    cell = lambda v, i: F.struct((i + 1).alias("col_index"), F.get(F.col("columns"), i + 1).alias("column_name"), parse_value(v).alias("value"))
    until = lambda k: F.coalesce(F.get("heads", k + 1)["at"], F.size("lines"))
    under = lambda h, k: F.transform(
        F.slice("lines", h["at"] + 2, until(k) - h["at"] - 1),
        lambda x: F.struct(h["label"].alias("section"), x["indent"].alias("indent"), x["label"].alias("row_label"),
                           F.transform(F.slice(x["values"], F.lit(1), F.greatest(F.size("columns") - 1, F.lit(0))), cell).alias("cells")))
    rows = _step(rows, found=F.flatten(F.transform("heads", under)))
    numbered = F.transform("found", lambda r, i: F.struct(i.alias("row_index"), r["section"], r["indent"], r["row_label"], r["cells"]))
    return _step(rows, records=numbered).drop("lines", "heads", "found", "data")


def _last_filled(records: Column) -> Column:
    """The last column with a value in any record; null without one."""
    filled = lambda r: F.filter(r["cells"], lambda c: c["value"]["num"].isNotNull() | c["value"]["text"].isNotNull())
    return F.array_max(F.transform(records, lambda r: F.array_max(F.transform(filled(r), lambda c: c["col_index"]))))


def _with_cells(record: Column, cells: Column) -> Column:
    return F.struct(record["row_index"], record["section"], record["indent"], record["row_label"], cells.alias("cells"))


def drop_spacers(pages: DataFrame) -> DataFrame:
    """Cuts unnamed columns without values from the right end of `columns` and `records`, up to the first other one."""
    named = F.array_max(_where(F.col("columns"), lambda name, i: (i == 0) | ~name.rlike(PLACEHOLDER_COLUMN)))
    pages = _step(pages, last_col=F.greatest(named, F.coalesce(_last_filled(F.col("records")), F.lit(0))))
    cut = F.transform("records", lambda r: _with_cells(r, F.filter(r["cells"], lambda c: c["col_index"] <= F.col("last_col"))))
    return _step(pages, columns=F.slice("columns", F.lit(1), F.col("last_col") + 1), records=cut).drop("last_col")


def year_axis(column_years: Column, rows_with_years: Column) -> Column:
    """Where a table carries its years, given those of its columns and its yearly row count."""
    cols = F.exists(column_years, lambda y: F.size(y) > 0)
    rows = rows_with_years > MIN_ROW_YEAR_LABELS
    return (F.when(cols & rows, "both").when(cols, "columns").when(rows, "rows").otherwise("table"))


def prune_years(pages: DataFrame, lo: int = YEAR_MIN, hi: int = YEAR_MAX) -> DataFrame:
    """Cuts rows and columns whose years leave [lo, hi] out of `records` and `columns` (read with `title`).

    Only axes that carry years are pruned, and labels without a year stay. Adds `years`, `year_axis`, `dropped_rows`, `dropped_columns`
    and `kept`.
    """
    pages = _step(
        pages, row_years=F.transform("records", lambda r: parse_years(r["row_label"])),
        column_years=F.transform("columns", lambda c, i: F.when(i > 0, parse_years(c)).otherwise(_none(_NO_INTS))))
    dated = F.size(F.filter("row_years", lambda y: F.size(y) > 0))
    pages = _step(pages, year_axis=year_axis(F.col("column_years"), dated))
    wrong = lambda y: (F.size(y) > 0) & ~years_all_in(y, lo, hi)
    by_rows, by_title = F.col("year_axis").isin("rows", "both"), F.col("year_axis") == "table"
    pages = _step(
        pages,
        bad_columns=F.when(by_title, _none(_NO_INTS)).otherwise(_where(F.col("column_years"), lambda y, i: wrong(y)).cast(_NO_INTS)),
        live_rows=F.when(by_rows, _where(F.col("row_years"), lambda y, i: ~wrong(y))).otherwise(
            _where(F.col("row_years"), lambda y, i: F.lit(True))))
    good = lambda i: ~F.array_contains("bad_columns", i)
    pages = _step(
        pages, dropped_rows=F.size("records") - F.size("live_rows"), dropped_columns=F.size("bad_columns"),
        kept_rows=F.transform("live_rows", lambda i: F.get("records", i)),
        kept_years=F.flatten(F.transform("live_rows", lambda i: F.get("row_years", i))),
        live=F.filter(F.sequence(F.lit(0), F.greatest(F.size("columns") - 1, F.lit(0))), good))
    pages = _step(pages, kept_rows=F.transform("kept_rows", lambda r: _with_cells(r, F.filter(r["cells"], lambda c: good(c["col_index"])))))
    named = F.array_max(F.filter("live", lambda i: (i == 0) | ~F.get("columns", i).rlike(PLACEHOLDER_COLUMN)))
    pages = _step(pages, last_col=F.greatest(named, F.coalesce(_last_filled(F.col("kept_rows")), F.lit(0))))
    pages = _step(pages, live=F.when(by_title, F.col("live")).otherwise(F.filter("live", lambda i: i <= F.col("last_col"))))
    place = lambda c: F.array_position("live", c["col_index"]).cast("int") - 1
    moved = lambda r: F.filter(F.transform(r["cells"], lambda c: F.struct(
        place(c).alias("col_index"), c["column_name"], c["value"])), lambda c: c["col_index"] >= 0)
    title_years = parse_years(F.col("title"))
    pages = _step(pages, axis_years=years_within(F.concat(
        F.flatten(F.transform("live", lambda i: F.get("column_years", i))), F.col("kept_years")), lo, hi), title_years=title_years)
    return _step(
        pages,
        columns=F.transform("live", lambda i: F.get("columns", i)),
        records=F.transform("kept_rows", lambda r, i: F.struct(
            i.alias("row_index"), r["section"], r["indent"], r["row_label"], moved(r).alias("cells"))),
        years=F.when(by_title | (F.size("axis_years") == 0), years_within(F.col("title_years"), lo, hi)).otherwise(F.col("axis_years")),
        kept=F.when(by_title, years_any_in(F.col("title_years"), lo, hi)).otherwise(
            (F.size("kept_rows") > 0) & (F.size("live") > 1)),
    ).drop("row_years", "column_years", "bad_columns", "live_rows", "kept_rows", "kept_years", "live", "last_col", "axis_years", "title_years")


# ---- whole pages -------------------------------------------------------------------
def parse_pages(pages: DataFrame) -> DataFrame:
    """Pages (with `html`) -> one row each, `html` replaced by `caption, columns, records, footnotes, error`.

    A page that cannot be read or laid out has its error and nothing else; one without data rows has no records.
    """
    read = split_header(main_table(extract_tables(pages)))
    read = header_names(_step(read, error=F.coalesce("error", bad_spans(read))))
    laid_out = drop_spacers(build_records(split_footnotes(read)))
    whole = F.col("error").isNull() & F.col("main").isNotNull() & (F.size("columns") > 0)
    carried = [f"`{c}`" for c in pages.columns if c != "html"]
    return laid_out.select(
        *carried, F.col("main")["caption"].alias("caption"), "columns",
        F.when(whole, F.col("records")).alias("records"),
        F.coalesce(F.concat("notes", "other_notes"), _none("array<string>")).alias("footnotes"), "error")


def judge(parsed: DataFrame, fallback_title: Column, target: str | None = TARGET_SURVEY, lo: int | None = YEAR_MIN,
          hi: int | None = YEAR_MAX, max_rows: int | None = None) -> DataFrame:
    """Parsed pages with title, sources and years, and with `status` and `detail`: what became of each.

    `target` keeps tables citing just that survey (None: all); `lo`/`hi` prune years (None: keep all). `row_count` counts
    all rows left, `records` holds `max_rows` of them.
    """
    named = _step(parsed, title=F.coalesce("caption", fallback_title), source_surveys=classify_sources(F.col("footnotes"))).drop("caption")
    if lo is not None and hi is not None:
        named = prune_years(named.withColumn("had_rows", F.size("records") > 0), lo, hi)
    else:
        named = named.withColumns({"had_rows": F.size("records") > 0, "years": _none(_NO_INTS), "year_axis": F.lit("none"),
                                   "dropped_rows": F.lit(0), "dropped_columns": F.lit(0), "kept": F.lit(True)})
    surveys = F.coalesce(F.nullif(F.array_join("source_surveys", "+"), F.lit("")), F.lit("unknown"))
    failed = F.col("error").isNotNull() | ~F.coalesce("had_rows", F.lit(False))
    other = ~only_source(F.col("source_surveys"), target) if target is not None else F.lit(False)
    status = F.when(failed, "failed").when(other, "other source").when(~F.col("kept"), "no data in range").otherwise("written")
    judged = _step(named, status=status)
    pruned = F.col("status").isin("written", "no data in range")
    shown = F.col("records") if max_rows is None else F.slice("records", 1, max_rows)
    return judged.withColumns({
        "detail": F.when(F.col("error").isNotNull(), F.col("error")).when(F.col("status") == "failed", "no data rows parsed").otherwise(surveys),
        "row_count": F.size("records").cast("bigint"), "records": shown,
        "dropped_rows": F.when(pruned, F.col("dropped_rows")).otherwise(0),
        "dropped_columns": F.when(pruned, F.col("dropped_columns")).otherwise(0),
    }).drop("error", "had_rows", "kept")


@dataclass
class ReportBuild:
    """`reports`: one nested row per kept table. `outcomes`: what became of each page."""

    reports: DataFrame
    outcomes: DataFrame


def build_reports(pages: DataFrame, target: str | None = TARGET_SURVEY, lo: int | None = YEAR_MIN,
                  hi: int | None = YEAR_MAX, max_rows: int | None = None) -> ReportBuild:
    """Pages `(page_key, html, fallback_title, ..)` -> report tables.

    Of pages with one key a single copy counts. A page that cannot be read, or has no data rows, fails alone. Further page columns are
    carried into `reports`. Pages are parsed once, and written once for the two results.
    """
    judged = materialise(judge(parse_pages(one_per_key(pages)), F.col("fallback_title"), target, lo, hi, max_rows), "report-pages")
    outcomes = judged.select(PAGE, "status", "detail", "dropped_rows", "dropped_columns")
    return ReportBuild(judged.where("status = 'written'").drop("status", "detail"), outcomes)
