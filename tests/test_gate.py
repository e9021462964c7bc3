import pytest

from tablelake.plans.sqlgate import StatementRejected, render, run_sql


@pytest.fixture(autouse=True)
def table(spark):
    spark.range(1000).selectExpr("id", "id % 3 AS g").createOrReplaceTempView("HD2023")


@pytest.mark.parametrize("text", [
    'SELECT id FROM "HD2023" WHERE g = 1', "  with a as (select 1 as x) select * from a", "Select count(*) from hd2023",
    "select * from hd2023 where id in (select max(id) from hd2023)",
    "select 'insert into t; drop table x' as quoted",
])
def test_queries_pass(spark, text):
    assert run_sql(spark, text).count() > 0


@pytest.mark.parametrize("text", [
    "INSERT INTO HD2023 VALUES (1, 2)", "EXPLAIN SELECT 1", "-- note\nSELECT 1", "DROP VIEW HD2023", "SET a = 1", "",
    "WITH a AS (SELECT 1 AS id, 2 AS g) INSERT INTO HD2023 SELECT * FROM a",
    "select reflect('java.lang.Math', 'abs', -1)", "select * from (select java_method('java.lang.Math', 'abs', -1) as x)",
    "select 1 where exists (select reflect('java.lang.Math', 'abs', -1))",
    "select transform(id) using 'cat' as (x) from hd2023",
])
def test_other_statements_do_not(spark, text):
    with pytest.raises(StatementRejected):
        run_sql(spark, text)


@pytest.mark.parametrize("text", ["select 1; select 2", "select * from parquet.`/tmp/x`", "select nope from hd2023"])
def test_errors_are_the_engines(spark, text):
    with pytest.raises(Exception) as problem:
        run_sql(spark, text)
    assert not isinstance(problem.value, StatementRejected)
    assert render(spark, text).startswith("SQL Error: ")
    assert spark.conf.get("spark.sql.runSQLOnFiles") == "true"


def test_cap_and_messages(spark):
    assert run_sql(spark, "select * from hd2023").count() == 501
    assert run_sql(spark, "select * from hd2023", cap=None).count() == 1000
    assert "[Truncated: only the first 500 rows are shown." in render(spark, "select id from hd2023")
    assert "Truncated" not in render(spark, "select id from hd2023 limit 500")
    assert render(spark, "select id from hd2023 where id < 0") == "Query executed successfully, but returned no rows."
    assert render(spark, "delete from hd2023") == "Error: Only SELECT or WITH (CTE) statements are allowed."


def test_last_of_repeated_names_is_kept(spark):
    df = run_sql(spark, "select 1 as a, 2 as b, 3 as a")
    assert [tuple(r) for r in df.collect()] == [(3, 2)] and df.columns == ["a", "b"]


def test_value_set_text(spark):
    from tablelake.operators.catalog import valueset_text

    values = spark.createDataFrame(
        [(2023, "HD2023", "CONTROL", order, code, f"label {code}") for order, code in ((None, "10"), (None, "9"), (None, "x"), (1, "z"))],
        "year int, tablename string, varname string, valueorder int, codevalue string, valuelabel string")
    assert valueset_text(values, 2023, " hd2023 ", "control") == (
        "Value set for hd2023.control (year 2023):\n  z — label z\n  9 — label 9\n  10 — label 10\n  x — label x")
    assert valueset_text(values, 2022, "HD2023", "control").startswith("No value set found for column 'control' in table 'HD2023'")


def test_gates_do_not_open_each_other(spark):
    """Statements judged at the same time, and a caller who allows paths in its own session."""
    from concurrent.futures import ThreadPoolExecutor

    texts = ["select * from parquet.`/tmp/x`", "select count(*) from hd2023"] * 8
    with ThreadPoolExecutor(8) as pool:
        shown = list(pool.map(lambda t: render(spark, t), texts))
    assert all(s.startswith("SQL Error: ") for s in shown[::2]) and all("1000" in s for s in shown[1::2])
    assert spark.conf.get("spark.sql.runSQLOnFiles", "true") == "true"
