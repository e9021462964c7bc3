import math
import random

import pytest
from conftest import column
from pyspark.sql import functions as F

from tablelake.functions import text, values, years
from tablelake.functions.pages import classify_sources, decode_body
from tablelake.operators.grading import six_digits


@pytest.mark.parametrize("raw, num, shown, is_int", [
    ("1,234", 1234.0, None, True), ("$5", 5.0, None, True), ("12!", 12.0, None, True), ("12 !", 12.0, None, True),
    ("(1.2)", 1.2, None, False), ("(-3)", -3.0, None, True), ("-5", -5.0, None, True), ("+5", 5.0, None, False),
    ("5.", 5.0, None, False), (".5", 0.5, None, False), ("1e5", 1e5, None, False), ("1_000", 1000.0, None, False),
    ("†", None, "†", False), ("—", None, "—", False), ("(†)", None, "(†)", False), ("!", None, "!", False),
    ("", None, None, False), ("   ", None, None, False), ("abc", None, "abc", False), ("5d", None, "5d", False),
    ("--5", None, "--5", False), ("(5", None, "(5", False), ("5)", None, "5)", False), (" n/a ", None, "n/a", False),
    ("1 2", None, "1 2", False),
])
def test_parse_value(spark, raw, num, shown, is_int):
    got = column(spark, [raw], values.parse_value)[0]
    assert (got["num"], got["text"], got["is_int"]) == (num, shown, is_int)


def test_usable(spark):
    got = column(spark, ["7", "†", "", "text", "-", None], lambda c: values.usable(values.parse_value(c)))
    assert got == [True, False, False, True, False, False]


def test_coerce_number(spark):
    got = column(spark, ["$1,234", "45.6%", " 7 ", "1e3", "abc", "", None, "true", "5d"], values.coerce_number)
    assert got == [1234.0, 45.6, 7.0, 1000.0, None, None, None, None, None]


def test_tolerance_is_inclusive_and_zero_is_exact(spark):
    rows = [(101.0, 100.0, 0.01, True), (101.1, 100.0, 0.01, False), (0.0, 0.0, 0.01, True), (0.001, 0.0, 0.01, False),
            (float("nan"), 1.0, 0.01, False), (None, 1.0, 0.01, False)]
    df = spark.createDataFrame(rows, "got double, want double, tol double, ok boolean")
    assert all(r["ok"] == r["x"] for r in df.withColumn(
        "x", values.within_tolerance(F.col("got"), F.col("want"), F.col("tol"))).collect())


def test_labels(spark):
    assert column(spark, [" U.S.  Total! ", None, "É1"], text.normalize_label) == ["u s total", "none", "1"]


def test_six_digits_reads_like_the_general_format(spark):
    random.seed(5)
    numbers = [random.choice([1, -1]) * random.random() * 10 ** random.randint(-7, 12) for _ in range(300)]
    numbers += [0.0, 1.0, 1234.5, 999999.0, 1e6, 100000.0, 0.0001, 123456.0, 3906914.0]
    assert column(spark, numbers, six_digits, "double") == [f"{x:,.6g}" for x in numbers]


def test_years(spark):
    labels = ["2021-22", "1999-2000", "2010-11 to 2020-21", "Fall 2021 and 2020-21", "20215", None, "x2010", "1899", "2010 - 11"]
    assert column(spark, labels, years.parse_years) == [
        [2021], [1999], [2010, 2020], [2021, 2020], [], [], [], [], [2010]]


def test_year_guard(spark):
    assert column(spark, [2000, 2023, 2100], years.two_digit_year, "int") == ["00", "23", "00"]
    with pytest.raises(Exception, match="between 2000 and 2100"):
        column(spark, [1923], years.two_digit_year, "int")


def test_total_and_year_labels(spark):
    labels = [" Total", "All students", "Allied", "U.S. mean", "us", "Usage", "50 states", "Nationality", "National mean"]
    assert column(spark, labels, text.is_total) == [True, True, False, True, True, False, True, False, True]
    labels = ["2019", " 2019-20 ", "1999-2000", "Fall 2019", "20199", "2019-2"]
    assert column(spark, labels, text.is_year_label) == [True, True, True, False, False, False]


def test_titles_and_hyphens(spark):
    titles = ["Table 301.10. Enrollment: by sex: Fall 2021", "Enrollment", "Table 3. A:", "Table 3"]
    assert column(spark, titles, text.topic) == ["Enrollment: by sex", "Enrollment", "A", "Table 3"]
    assert column(spark, ["Non-  profit and For- Profit", "é- a", None], text.unhyphenate) == [
        "Non-profit and For- Profit", "é-a", ""]


def test_leaks(spark):
    df = spark.createDataFrame([
        ("was it 1,234.0?", 1234.0, [2021]), ("in 2021?", 2021.0, [2021]), ("in 2021?", 0.0, [2021]), ("-5 or so", -5.0, []),
        ("a-1", 1.0, None), (None, 1.0, []), ("7", None, []),
    ], "q string, a double, y array<int>")
    got = [r["x"] for r in df.select(values.leaks_answer(F.col("q"), F.col("a"), F.col("y")).alias("x")).collect()]
    assert got == [True, False, False, True, False, False, False]


def test_qualifiers(spark):
    df = spark.createDataFrame([
        ("public institution males in 2021", ["males", "males", "institutions", "public"], [2021]),
        ("public institutions", ["public"], [2021]), ("nothing", ["public", "private"], []), ("x", [], []),
    ], "q string, t array<string>, y array<int>")
    got = [r["x"] for r in df.select(values.qualifiers_kept(F.col("q"), F.col("t"), F.col("y")).alias("x")).collect()]
    assert got == [True, False, False, True]


def test_decode_body(spark):
    bodies = ["† é".encode("utf-8"), "† – é".encode("cp1252"), b"\x81x", b""]
    got = column(spark, [bytearray(b) for b in bodies], decode_body, "binary")
    assert got == ["† é", "† – é", "�x", ""]


def test_sources(spark):
    notes = [["NOTE: CPS: Current Population Survey", " source: ipeds, and bps: 04"], ["SOURCE: İpeds"], ["x"], []]
    got = column(spark, notes, classify_sources, "array<string>")
    assert got == [["IPEDS", "BPS"], ["IPEDS"], [], []]


def test_source_patterns_may_be_expressions(spark):
    got = column(spark, [["SOURCE: Survey 12"], ["SOURCE: survey x"]],
                 lambda c: classify_sources(c, {"a": r"survey \d+", "b": "x"}), "array<string>")
    assert got == [["a"], ["b"]]


def test_nan_is_a_number(spark):
    assert math.isnan(column(spark, ["nan"], values.to_number)[0])
