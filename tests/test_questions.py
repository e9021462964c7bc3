import pytest
from pyspark.sql import functions as F

from tablelake.operators import cells, checking, grading, questions
from test_structure import RECORD, record

TITLE = "Table 301.10. Enrollment, by non- profit control: Fall 2021"


@pytest.fixture(scope="module")
def indexed(spark):
    rows = [record("301.10", i, d, label, float(v), "note" if i else 12.0, section="Public")
            for i, (d, label, v) in enumerate([(2, "Total", 50), (0, "All", 40), (1, "Men", 30), (1, "Women", 10), (1, "Other", 5)])]
    df = spark.createDataFrame(rows, RECORD).withColumns({
        "title": F.lit(TITLE), "table_years": F.array(F.lit(2021)), "edition_year": F.lit("2022"), "page_url": F.lit("u"),
        "cells": F.transform("cells", lambda c: c.withField("column_name", F.when(c["col_index"] == 1, "Count | 2020-21").otherwise("2019")))})
    return cells.index_cells(df)


def test_lookup_wording(indexed):
    row = questions.lookup_candidates(indexed).where("id = 'digest_301.10::lookup::r0002::c01'").head()
    assert row["template"] == ("In NCES data on enrollment, by non- profit control (Public), what figure is reported for "
                               "All > Men under Count in 2020-21?")
    assert row["descriptor"].splitlines() == [
        "question_type: lookup", "table: Enrollment, by non- profit control", "section: Public", "row: All > Men", "column: Count",
        "year: 2020-21", "unit: count"]
    assert (row["answer_num"], row["years"], row["required_tokens"]) == (30.0, [2020], ["all", "men", "count"])
    bare = questions.lookup_candidates(indexed).where("id = 'digest_301.10::lookup::r0003::c02'").head()
    assert bare["template"].endswith("for All > Women in 2019?") and bare["answer_type"] == "label" and bare["answer_label"] == "note"


def test_rank_wording(indexed):
    row = questions.rank_candidates(indexed).head()
    assert row["id"] == "digest_301.10::rank::c01::public::all" and row["answer_label"] == "Men"
    assert sorted(row["options"]) == ["Men", "Other", "Women"] and row["margin"] == pytest.approx(0.6667)
    first, second, third = row["options"]
    assert row["template"].endswith(f"which of the following had the highest Count in 2020-21: {first}, {second}, or {third}?")
    assert [(c["label"], c["value"]) for c in row["group"]["candidates"]] == [("Men", 30.0), ("Women", 10.0), ("Other", 5.0)]


def test_shared_rank_ids_are_told_apart(spark):
    long = "an ancestor label of well over two dozen letters"
    rows = [("1", 3 * g + i, 1, "", [long + str(g)], f"m{g}{i}", (10.0 ** i, None, False), "c", "T", [2021], "2022", "u")
            for g in range(2) for i in range(3)]
    df = spark.createDataFrame(rows, "table_number string, row_index int, col_index int, section string, ancestors array<string>, "
                                     "row_label string, value struct<num:double,text:string,is_int:boolean>, column_name string, "
                                     "title string, table_years array<int>, edition_year string, page_url string")
    ids = [r["id"] for r in questions.rank_candidates(df).collect()]
    assert len(set(ids)) == 2 and all(i.startswith("digest_1::rank::c01::all::an-ancestor-label-of-wel::") for i in ids)


def test_wording_is_checked_retried_and_replaced(spark):
    rows = [(q, f"d {q}", f"template {q}", 7.0, [2021], ["men", "public"]) for q in ("good", "leak", "lossy", "yearless", "empty", "late")]
    df = spark.createDataFrame(rows, "id string, descriptor string, template string, answer_num double, years array<int>, "
                                     "required_tokens array<string>")
    said = {"good": '"public men in 2021?"', "leak": "public men in 2021, 7.0?", "lossy": "men in 2021", "yearless": "public men", "empty": "  "}

    def fn(batch):
        assert list(batch.columns) == ["id", "descriptor", "attempt"]
        return batch["id"].map(said).fillna("men and public, 2021")

    got = {r["id"]: (r["question"], r["phrasing"]) for r in questions.word_questions(df, fn).collect()}
    assert got.pop("good") == ("public men in 2021?", "llm") and got.pop("late") == ("men and public, 2021", "llm")
    assert got == {q: (f"template {q}", "template") for q in ("leak", "lossy", "yearless", "empty")}

    def failing(batch):
        raise RuntimeError("no backend")

    with pytest.raises(Exception, match="no backend"):
        questions.word_questions(df, failing).collect()


def test_own_set_re_derives(indexed):
    lookups = questions.lookup_candidates(indexed).select(
        "id", "table_number", "cell.section", "cell.ancestors", "cell.row_label", "cell.column_name", "answer_num", "answer_label",
        F.col("template").alias("question"), "years")
    ranks = questions.rank_candidates(indexed).select(
        "id", "table_number", "group.section", "group.ancestors", "group.column_name", "answer_label", "options")
    tables = indexed.select("table_number").distinct()
    assert checking.check_questions(lookups, ranks, indexed, tables).collect() == []
    wrong = lookups.withColumn("answer_num", F.col("answer_num") + 1)
    assert checking.check_questions(wrong, ranks, indexed, tables).count() == lookups.where("answer_num is not null").count()
    assert checking.check_questions(lookups, ranks, indexed, tables.where("false")).count() == lookups.count() + ranks.count()


def test_grading(spark):
    q = spark.createDataFrame([
        ("a", "lookup", "number", 100.0, None, 0.01), ("b", "lookup", "number", 100.0, None, 0.01), ("c", "lookup", "number", 0.0, None, 0.01),
        ("d", "rank", "label", None, "New York", 0.0), ("e", "rank", "label", None, "X", 0.0), ("f", "rank", "label", None, "X", 0.0),
        ("g", "lookup", "number", 3906914.0, None, 0.01)],
        "id string, question_type string, answer_type string, answer_num double, answer_label string, tolerance double")
    p = spark.createDataFrame([("a", "$101"), ("b", "many"), ("c", "0.5"), ("d", "new-york!"), ("e", None), ("g", "4,906,914")],
                              "id string, answer string")
    graded = grading.grade(q, p)
    assert {r["id"]: (r["correct"], r["reason"]) for r in graded.collect()} == {
        "a": (True, ""), "b": (False, "not a number: 'many'"), "c": (False, "0.5 vs 0 (+inf%)"), "d": (True, ""),
        "e": (False, "None vs 'X'"), "f": (False, "no prediction"), "g": (False, "4.90691e+06 vs 3.90691e+06 (+25.60%)")}
    assert sorted((r["question_type"] or "all", r["n_correct"], r["n_questions"], r["n_missing"]) for r in grading.accuracy(graded).collect()) == [
        ("all", 2, 7, 1), ("lookup", 1, 4, 0), ("rank", 1, 3, 1)]
    assert [(r["line"], r["total"]) for r in grading.failures(graded, 2).collect()] == [("[lookup] b: not a number: 'many'", 5), ("[lookup] c: 0.5 vs 0 (+inf%)", 5)]


def test_resuming(spark):
    chosen = spark.createDataFrame([("a",), ("b",)], "id string")
    existing = spark.createDataFrame([("b", "old"), ("z", "gone")], "id string, question string")
    done, todo = questions.resume(chosen, existing)
    assert [tuple(r) for r in done.collect()] == [("b", "old")] and [r["id"] for r in todo.collect()] == ["a"]


def test_wording_goes_on_where_it_stopped(spark, tmp_path):
    """Wordings of a call that failed half-way are not asked for again."""
    df = spark.createDataFrame([(f"q{i}", f"d{i}", "t", None, [], []) for i in range(40)], "id string, descriptor string, template string, "
                               "answer_num double, years array<int>, required_tokens array<string>").repartition(8)
    log = tmp_path / "asked"

    def wording(most):
        def fn(batch):
            if most and log.exists() and len(log.read_text().split()) >= most:
                raise RuntimeError("no backend")
            with open(log, "a") as file:
                file.write("".join(f"{i}\n" for i in batch["id"]))
            return "say " + batch["id"]
        return fn

    rows_per_batch = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "4")
    with pytest.raises(RuntimeError, match="no backend"):
        questions.word_questions(df, wording(8), queue=f"{tmp_path}/queue")
    assert 0 < len(log.read_text().split()) < 40
    got = questions.word_questions(df, wording(None), queue=f"{tmp_path}/queue").collect()
    assert {(r["id"], r["question"], r["phrasing"]) for r in got} == {(f"q{i}", f"say q{i}", "llm") for i in range(40)}
    assert sorted(log.read_text().split()) == sorted(f"q{i}" for i in range(40))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", rows_per_batch)
