import random
import time
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablelake.operators import ingest
from tablelake.sources import export, jsonl, runs, sink
from tablelake.sources.html import page_anchors, page_tables
from tablelake.operators.panel import read_year_panel, schema_drift, year_panel

LISTING = """CREATE TABLE [X]
 (
	[UNITID]		Long Integer,
	[INSTNM]		Text (240),
	[OPEN]		Boolean NOT NULL,
	[AMOUNT]		Currency NOT NULL,
	[AT]		DateTime (Short),
	[MEMO]		Memo/Hyperlink (255)
);
	[LATER]		Text (1),"""


def listing(spark, text=LISTING, table="X"):
    lines = [(table, i, line) for i, line in enumerate(text.splitlines())]
    return export.parse_listing(spark.createDataFrame(lines, "table_name string, line_no int, line string"))


def test_listing_and_schema(spark):
    schema = export.table_schema(listing(spark), "X")
    assert [(f.name, f.dataType.simpleString()) for f in schema] == [
        ("UNITID", "int"), ("INSTNM", "string"), ("OPEN", "boolean"), ("AMOUNT", "decimal(19,4)"),
        ("AT", "timestamp_ntz"), ("MEMO", "string")]
    with pytest.raises(ValueError, match="no columns"):
        export.table_schema(listing(spark, "CREATE TABLE [X]\n"), "X")


def test_unmapped_type(spark):
    with pytest.raises(ValueError, match="unmapped"):
        export.source_type("Complex")
    odd = spark.createDataFrame([("Complex",)], "type string")
    with pytest.raises(Exception, match="unmapped source type: Complex"):
        export.with_source_types(odd).collect()


def test_export_scan(spark, tmp_path):
    (tmp_path / "x2023.csv").write_text(
        'UNITID,INSTNM,OPEN,AMOUNT,AT,MEMO\n'
        '1,"a ""q"" é",1,12.5000,2023-01-02 03:04:05,"two\nlines, one"\n'
        '2,"",0,,,\n3,,,0.1,,""\n', encoding="utf-8")
    df = export.read_export(spark, str(tmp_path), export.table_schema(listing(spark), "X"))
    rows = [tuple(r) for r in df.select("unitid", "instnm", "open", F.col("amount").cast("string"), F.col("at").cast("string"), "memo")
            .orderBy("unitid").collect()]
    assert df.columns == ["unitid", "instnm", "open", "amount", "at", "memo"]
    assert rows == [(1, 'a "q" é', True, "12.5000", "2023-01-02 03:04:05", "two\nlines, one"),
                    (2, "", False, None, None, None), (3, None, None, "0.1000", None, "")]


def test_only_declared_memos_hold_line_breaks(spark, tmp_path):
    (tmp_path / "a.csv").write_text('NAME\n"x\ny"\n')
    memo = T.StructType([T.StructField("NAME", T.StringType(), metadata={"source_type": "Memo/Hyperlink (255)"})])
    plain = T.StructType([T.StructField("NAME", T.StringType())])
    assert export.read_export(spark, str(tmp_path), memo).collect() == [("x\ny",)]
    assert export.read_export(spark, str(tmp_path), plain).count() != 1


def test_export_without_memo_stays_splittable(spark, tmp_path):
    (tmp_path / "a.csv").write_text("UNITID\n1\n2\n")
    schema = T.StructType([T.StructField("UNITID", T.IntegerType())])
    assert export.read_export(spark, str(tmp_path), schema).count() == 2
    (tmp_path / "b.csv").write_text("UNITID\nx\n")
    with pytest.raises(Exception):
        export.read_export(spark, str(tmp_path), schema).collect()


def test_lower_columns_refuses_clashes(spark):
    spark.conf.set("spark.sql.caseSensitive", "true")
    try:
        with pytest.raises(ValueError, match="differ only by case"):
            export.lower_columns(spark.createDataFrame([(1, 2)], "A int, a int"))
    finally:
        spark.conf.set("spark.sql.caseSensitive", "false")


def test_discovery(spark, tmp_path):
    for name in ("HD2021.CSV", "EF2022.csv", "readme.txt"):
        (tmp_path / name).write_text("a\n1\n")
    found = export.discover_exports(spark, str(tmp_path)).orderBy("file_name").collect()
    assert [(r["file_name"], r["year"]) for r in found] == [("EF2022.csv", 2022), ("HD2021.CSV", 2021)]


def test_sink_refuses_then_replaces(spark, tmp_path):
    df = spark.range(3)
    sink.write_table(df, str(tmp_path), "t")
    assert sink.table_exists(spark, str(tmp_path), "t") and not sink.table_exists(spark, str(tmp_path), "u")
    with pytest.raises(Exception):
        sink.write_table(df, str(tmp_path), "t")
    sink.write_table(spark.range(5), str(tmp_path), "t", replace=True)
    assert sink.read_table(spark, str(tmp_path), "t").count() == 5
    registry = spark.createDataFrame([("tables23_meta",), ("HD2023",), ("tables23xmeta",)], "table_name string")
    assert sink.count_meta(registry).head()[0] == 1
    with pytest.raises(RuntimeError):
        sink.refuse_if_loaded(registry, replace=False)
    sink.refuse_if_loaded(registry, replace=True)


def test_jsonl_last_line_wins(spark, tmp_path):
    (tmp_path / "p.jsonl").write_text(
        '{"id": "a", "answer": 1}\n\n   \n{"id": "b", "answer": "x é"}\n{"id": "a", "answer": 3906914}\n{"id": "c", "answer": null}\n')
    got = jsonl.read_jsonl(spark, str(tmp_path), "id string, answer string", key="id").collect()
    assert {r["id"]: r["answer"] for r in got} == {"a": "3906914", "b": "x é", "c": None}


def test_panel(spark):
    a, b = spark.createDataFrame([(1, "x")], "id int, s string"), spark.createDataFrame([(2,)], "id int")
    assert sorted(tuple(r) for r in year_panel({2021: a, 2022: b}).select("id", "s", "year").collect()) == [
        (1, "x", 2021), (2, None, 2022)]
    c = spark.createDataFrame([("3",)], "id string")
    with pytest.raises(ValueError, match="types differ"):
        year_panel({2021: a, 2023: c})
    assert schema_drift(spark, {2021: a, 2023: c}).collect()[0]["types"] == ["int", "string"]


def read_tables(html):
    tables, error = page_tables(html)
    assert error is None
    return tables


def test_page_tables():
    html = """<table class="a b"><caption>T <sup>1</sup></caption>
      <tr><th rowspan=2>A<th colspan="2">B</th></tr><tr><td>c<td>d</tr>
      <tr><td>&nbsp;&nbsp;\n x<sup>2</sup></td><td><b>1</b>2<script>no</script></td><td colspan=bad>3</td></tr><tr></tr></table>"""
    [table] = read_tables(html)
    assert (table["pos"], table["class"], table["caption"], [(r["idx"], len(r["cells"])) for r in table["rows"]]) == (
        0, "a b", "T 1", [(0, 2), (1, 2), (2, 3), (3, 0)])
    # Unclosed cells nest, as the tree of tags has it.
    assert [c["full_text"] for c in table["rows"][0]["cells"]] == ["A B", "B"]
    assert [(c["text"], c["full_text"], c["indent"], c["colspan"]) for c in table["rows"][2]["cells"]] == [
        ("x", "x 2", 1, 1), ("1 2", "1 2", 0, 1), ("3", "3", 0, None)]
    indents = [c["indent"] for c in read_tables("<table><tr><td>    x<td>\t\n  x<td>x<td> x<td></table>")[0]["rows"][0]["cells"]]
    assert indents == [2, 1, 0, 0, 0]


def over(html):
    """The texts over each column, row by row."""
    return [[g["text"] for g in r["grid"] for _ in range(g["width"])] for r in read_tables(html)[0]["rows"]]


def test_spans_place_cells():
    assert over("<table><tr><th rowspan=2>a</th><th colspan=2>b</th><th rowspan='2'>c</th></tr><tr><th>d</th><th>e</th></tr></table>") == [
        list("abbc"), list("adec")]
    # A wide cell runs over a column held from above and is seen there; spans of 0 take no place; a gap stays blank.
    assert over("<table><tr><th>a</th><th rowspan=3>b</th></tr><tr><th colspan=3>c</th></tr><tr><th colspan=0>x</th><th>d</th></tr></table>") == [
        ["a", "b"], ["c", "c", "c"], ["d", "b"]]
    assert over("<table><tr><th rowspan=2>a</th><th>b</th><th rowspan=2>c</th></tr><tr></tr><tr><th rowspan=0>d</th></tr></table>".replace("<tr></tr>", "")) == [
        ["a", "b", "c"], ["a", "", "c"]]


def test_grids_against_a_cell_by_cell_layout():
    rng = random.Random(8)
    for _ in range(60):
        rows = [[(rng.choice([0, 1, 1, 2, 3, 7]), rng.choice([0, 1, 1, 2, 3]), f"{r}.{k}") for k in range(rng.randrange(1, 6))] for r in range(4)]
        html = "<table>" + "".join("<tr>" + "".join(f"<th colspan={c} rowspan={d}>{t}</th>" for c, d, t in row) + "</tr>" for row in rows) + "</table>"
        grid, width = {}, [0] * 4
        for r, row in enumerate(rows):
            col = 0
            for c, d, t in row:
                while (r, col) in grid:
                    col += 1
                for y in range(r, r + d):
                    for x in range(col, col + c):
                        grid[y, x] = t
                col += c
                width[r] = max(width[r], col)
        got = over(html)
        for r in range(4):
            full = max([width[r], *(x + 1 for y, x in grid if y == r)])
            assert got[r] == [grid.get((r, x), "") for x in range(full)]


def test_work_stays_in_proportion_to_the_page():
    """Spans far beyond the page fail alone and at once; nested anchors and cells are read in one pass."""
    start = time.perf_counter()
    assert page_tables("<table>" + "<tr><th colspan=3000000>x</th></tr>" * 3 + "</table>")[1].startswith("unreadable page: a header of")
    assert page_tables("<table><tr>" + "<th rowspan=900000>x</th>" * 2000 + "</tr></table>")[0]
    assert page_tables("<table><tr>" + "<th rowspan=9000>x</th>" * 2000 + "</tr>" + "<tr><th>x</th></tr>" * 4000 + "</table>")[1].startswith("unreadable page: a header of")
    anchors, items = page_anchors("<ul><li>" + "<a>x" * 100_000)
    assert len(anchors) == 100_000 and items == [{"first": 0, "last": 100_000}]
    assert time.perf_counter() - start < 30


def test_nested_tables_count_for_both():
    html = "<table><tr><td><table><tr><td>in</td></tr></table></td></tr></table>"
    assert [[[c["full_text"] for c in r["cells"]] for r in t["rows"]] for t in read_tables(html)] == [[["in", "in"], ["in"]], [["in"]]]


def test_anchors():
    html = "<ul><li><a href=x>Chapter 3</a><ul><li>see <a href='y'>Y</a> more</li></ul></li></ul><a>z</a>"
    anchors, items = page_anchors(html, "Y")
    assert [(a["pos"], a["href"], a["lead"], a["item"], a["label"], a["item_text"]) for a in anchors] == [
        (0, "x", "Chapter 3", 0, None, None), (1, "y", "Y", 1, "Y", "see Y more"), (2, None, "z", None, None, None)]
    assert items == [{"first": 0, "last": 2}, {"first": 1, "last": 2}]


def test_appended_runs_win(spark, tmp_path):
    from tablelake.sources.jsonl import read_jsonl, write_jsonl

    path = f"{tmp_path}/set"
    for run, parts in enumerate((5, 2, 7)):
        rows = spark.range(run * 10, 60).selectExpr("cast(id as string) as id", f"'{run}' as answer").repartition(parts)
        write_jsonl(rows, path, "append" if run else "errorifexists")
    got = {r["id"]: r["answer"] for r in read_jsonl(spark, path, "id string, answer string", key="id").collect()}
    assert got == {str(i): str(min(2, i // 10)) for i in range(60)}


def test_one_page_per_key(spark):
    from tablelake.sources.html import one_per_key

    rows = [("a", "x"), ("b", "z"), ("b", "y"), ("b", "y"), (None, "v"), (None, "u")]
    got = one_per_key(spark.createDataFrame(rows, "page_key string, html string"))
    assert {tuple(r) for r in got.collect()} == {("a", "x"), ("b", "y"), (None, "u")} and got.count() == 3
    assert one_per_key(spark.createDataFrame([], "page_key string, html string")).count() == 0


def test_the_first_copy_of_a_page_counts(spark):
    from tablelake.operators.links import link_index

    html = """<ul><li><a>Chapter 3</a><ul><li><a href="d22/tables/dt22_{0}.asp">T</a></li></ul></li></ul>"""
    pages = spark.createDataFrame([("p", n, html.format(n)) for n in (10, 9, 11)] + [("q", 10, html.format(8))], "page_key string, page_id bigint, html string")
    got = link_index(pages, "https://x.org/", first="page_id")
    assert {(r["page_key"], r["table_number"]) for r in got.collect()} == {("p", "9"), ("q", "8")}


def failing(df):
    return df.select(F.when(F.col("id") == 3, F.raise_error(F.lit("broken")).cast("bigint")).otherwise(F.col("id")).alias("id"))


def test_a_failed_replacement_leaves_the_table(spark, tmp_path):
    root = str(tmp_path)
    sink.write_table(spark.range(3), root, "t")
    with pytest.raises(Exception, match="broken"):
        sink.write_table(failing(spark.range(9)), root, "t", replace=True)
    assert sink.read_table(spark, root, "t").count() == 3
    # A replacement may read the table that it replaces.
    sink.write_table(sink.read_table(spark, root, "t").unionByName(spark.range(10, 12)), root, "t", replace=True)
    assert sink.read_table(spark, root, "t").count() == 5
    with pytest.raises(FileNotFoundError):
        sink.read_table(spark, root, "u")


def test_runs_are_numbered_and_failed_ones_unread(spark, tmp_path):
    path = f"{tmp_path}/r"
    assert runs.read(spark, path, schema="id long").count() == 0 and runs.committed(spark, path) == []
    assert runs.commit(spark.range(2), path) == 1
    with pytest.raises(Exception, match="broken"):
        runs.commit(failing(spark.range(9)), path)
    assert runs.committed(spark, path) == [1] and runs.commit(spark.range(5, 8), path) == 2
    assert sorted((r["id"], r["run"]) for r in runs.read(spark, path).select("id", runs.run_number().alias("run")).collect()) == [
        (0, 1), (1, 1), (5, 2), (6, 2), (7, 2)]
    assert runs.commit(spark.range(1), path, replace=True) == 3 and runs.read(spark, path).count() == 1
    assert runs.commit(spark.range(1), path) == 4 and runs.committed(spark, path) == [3, 4]


def test_ingest_guards(spark, tmp_path):
    tables = {"Tables23": spark.createDataFrame([("HD", "X"), ("drv1", "Y")], "TableName string, VarName string"), "HD2023": spark.range(2).toDF("UNITID")}
    listing = spark.createDataFrame([("a.accdb", n) for n in tables], "file_name string, source_table string")
    loaded = ingest.ingest(listing, lambda _, n: tables[n], str(tmp_path))
    assert {r["table_name"] for r in loaded.collect()} == {"tables23_meta", "HD2023"}
    assert [tuple(r) for r in sink.read_table(spark, str(tmp_path), "tables23_meta").collect()] == [("HD", "x")]
    with pytest.raises(RuntimeError, match="already loaded"):
        ingest.ingest(listing, lambda _, n: tables[n], str(tmp_path))
    twice = listing.unionByName(spark.createDataFrame([("b.accdb", "hd2023")], listing.schema))
    with pytest.raises(ValueError, match="claimed by"):
        ingest.ingest(twice, lambda _, n: tables[n], str(tmp_path), replace=True)
    with pytest.raises(Exception, match="broken"):
        ingest.ingest(listing, lambda _, n: failing(spark.range(9)), str(tmp_path), replace=True)
    assert sink.read_table(spark, str(tmp_path), "HD2023").count() == 2


def test_year_folders_in_one_scan(spark, tmp_path):
    root = f"{tmp_path}/p"
    spark.createDataFrame([(1, "a")], "id int, late string").write.parquet(f"{root}/year=2023")
    spark.createDataFrame([(2,), (3,)], "id int").write.parquet(f"{root}/year=2021")
    panel = read_year_panel(spark, root)
    assert sorted((r["id"], r["late"], r["year"]) for r in panel.collect()) == [(1, "a", 2023), (2, None, 2021), (3, None, 2021)]
    assert panel._jdf.queryExecution().executedPlan().toString().count("FileScan parquet") == 1
    spark.createDataFrame([("x",)], "id string").write.parquet(f"{root}/year=2022")
    with pytest.raises(Exception, match="(?i)merge"):
        read_year_panel(spark, root).collect()
