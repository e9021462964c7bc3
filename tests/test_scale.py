"""Work that must not be done twice: read off the plans."""
import math

import __spark_entry__ as entry
import pytest
from conftest import SMALL, column
from pyspark.sql import functions as F

from tablelake.functions import values
from tablelake.operators import cells, grading, hierarchy, questions
from tablelake.plans import derived
from tablelake.session import configure
from tablelake.sources.tables import Tables


def plan(df, kind="optimizedPlan"):
    return getattr(df._jdf.queryExecution(), kind)().toString()


def test_pages_are_parsed_once(spark):
    assert plan(entry.queries()["split_footnotes"](spark, SMALL)).count("MapInArrow") == 1


def test_a_prediction_is_read_once(spark):
    asked = spark.createDataFrame([("a", 2.0, None, "number", 0.0)], "id string, answer_num double, answer_label string, answer_type string, tolerance double")
    graded = grading.grade(asked, spark.createDataFrame([("a", "$3")], "id string, answer string"))
    assert plan(graded).count("[,$%") == 1 and graded.first()["reason"] == "3 vs 2 (+50.00%)"


def test_endless_numbers(spark):
    assert column(spark, [math.nan, math.inf, -math.inf, None, 2.5], grading.six_digits, "double")[:3] == ["nan", "inf", "-inf"]


def test_report_tables_take_one_shuffle_by_table(spark):
    lines = derived.report_lines(Tables(configure(spark), SMALL))
    shuffles = [x for x in plan(lines, "executedPlan").splitlines() if "Exchange hashpartitioning" in x]
    assert len([x for x in shuffles if "custkey" not in x]) == 1


def test_report_lines_are_the_report(spark):
    tables = Tables(configure(spark), SMALL)
    names = ["table_number", "title", "row_index", "section", "row_label", "indent", "col_index", "column_name", "raw"]
    lines = derived.report_lines(tables)
    got = lines.select(*[c for c in lines.columns if c != "cells"], F.inline("cells")).select(*names)
    want = tables.sql(derived.REPORT_SQL).select(*names)
    assert got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty() and not got.isEmpty()


def test_a_wording_is_put_in_order_once(spark):
    asked = spark.createDataFrame([("Tell, me  2004", ["tell", "tells"], [2004])], "q string, t array<string>, y array<int>")
    kept = asked.select(values.qualifiers_kept(F.col("q"), F.col("t"), F.col("y")).alias("k"))
    assert plan(kept, "analyzed").count("[,\\s]+") == 1 and kept.first()["k"]


@pytest.mark.parametrize("raw, num, is_int", [("-12", -12.0, True), ("1.50", 1.5, False), ("1,234", 1234.0, True), ("12 !", 12.0, True), ("1_0", 10.0, False)])
def test_plain_and_other_numbers(spark, raw, num, is_int):
    assert column(spark, [raw], lambda c: values.parse_value(c)["num"]) == [num]
    assert column(spark, [raw], lambda c: values.parse_value(c)["is_int"]) == [is_int]


def test_cells_of_a_row_are_summed_up_not_collected(spark):
    assert "collect_list" not in plan(derived.report_lines(Tables(configure(spark), SMALL)))


class OddOrders(Tables):
    """The small tables with orders of negative, unknown or no price, no date or unseen years; or with no orders at all."""

    def __init__(self, spark, rows):
        super().__init__(spark, SMALL)
        at = F.col("o_orderkey") % 50
        self.orders = self.__getattr__("orders").where(F.lit(rows)).withColumns({
            "o_totalprice": F.when(at == 0, -F.col("o_totalprice")).when(at == 1, -0.05).when(at == 2, None).when(at == 3, 0.07).otherwise(F.col("o_totalprice")),
            "o_orderdate": F.when(at == 4, None).when(at == 5, F.timestamp_add("YEAR", F.lit(9), "o_orderdate")).otherwise(F.col("o_orderdate")),
            "o_orderpriority": F.when(at != 6, F.col("o_orderpriority"))})


@pytest.mark.parametrize("rows", [True, False])
def test_report_lines_of_odd_orders(spark, rows):
    tables = OddOrders(configure(spark), rows)
    names = ["table_number", "row_index", "row_label", "indent", "col_index", "column_name", "raw"]
    lines = derived.report_lines(tables)
    got = lines.select(*[c for c in lines.columns if c != "cells"], F.inline("cells")).select(*names)
    want = tables.sql(derived.REPORT_SQL).select(*names)
    assert got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty() and got.isEmpty() != rows


def test_tables_of_one_block_are_read_once(spark):
    rows = derived.report_rows(Tables(configure(spark), SMALL))
    climbed = plan(hierarchy.with_ancestors(rows))
    assert "CoGroups" not in climbed and climbed.count("MapInArrow") == 1


def test_rows_and_columns_are_worded_once(spark):
    """The same candidates, with no pattern left to be looked for in each cell."""
    records = derived.report_records(Tables(configure(spark), SMALL))
    odd = F.transform("cells", lambda c: c.withField("column_name", F.when(c["col_index"] == 2, None).when(c["col_index"] == 3, "Per- cent | all").when(
        c["col_index"] == 4, "| 2004 | 1999-00").otherwise(c["column_name"])))
    records = records.withColumn("cells", odd).withColumn("row_label", F.when(F.col("row_index") % 7 == 0, "Since 2004, then 1999").otherwise(F.col("row_label")))
    columns = questions.column_wordings(records.select(F.explode("cells.column_name").alias("column_name")))
    once = questions.lookup_candidates(cells.index_cells(records, per_row=questions.row_context), columns)
    each = questions.lookup_candidates(cells.index_cells(records))
    assert once.columns == each.columns and not once.isEmpty()
    assert once.exceptAll(each).isEmpty() and each.exceptAll(once).isEmpty()
    assert "regexp" not in plan(once).split("Generate explode")[0].lower()
