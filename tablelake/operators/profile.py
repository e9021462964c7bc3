"""Counts a run reports about itself."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def skip_reasons(tables: DataFrame) -> DataFrame:
    """How many tables were skipped per combination of surveys, most frequent first."""
    reason = F.coalesce(F.nullif(F.array_join("surveys", "+"), F.lit("")), F.lit("unknown"))
    return (
        tables.groupBy(reason.alias("reason")).agg(F.count(F.lit(1)).alias("n_tables"))
        .orderBy(F.desc("n_tables"), "reason")
    )


def run_totals(outcomes: DataFrame) -> DataFrame:
    return outcomes.agg(
        F.count_if(F.col("status") == "written").alias("n_written"),
        F.count_if(F.col("status") == "failed").alias("n_failed"),
        F.count_if(F.col("status") == "other source").alias("n_other_source"),
        F.count_if(F.col("status") == "no data in range").alias("n_out_of_range"),
        F.coalesce(F.sum("dropped_rows"), F.lit(0)).alias("dropped_rows"),
        F.coalesce(F.sum("dropped_columns"), F.lit(0)).alias("dropped_columns"),
    )


def set_profile(questions: DataFrame) -> DataFrame:
    """`(measure, name, n)`: by type, by phrasing, distinct tables, most per table.

    One pass: everything is summed up from counts per type, phrasing and table.
    """
    fine = questions.groupBy("question_type", "phrasing", "table_number").agg(F.count(F.lit(1)).alias("n"))
    grouped = fine.groupingSets(
        [["question_type"], ["phrasing"], ["table_number"]], "question_type", "phrasing", "table_number",
    ).agg(F.sum("n").alias("n"), F.grouping_id().alias("level"))
    measure = F.when(F.col("level") == 3, "type").when(F.col("level") == 5, "phrasing").otherwise("table")
    named = grouped.select(
        measure.alias("measure"),
        F.when(measure != "table", F.coalesce("question_type", "phrasing")).alias("name"), "n")
    return (
        named.groupBy("measure", "name")
        .agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("groups"), F.max("n").alias("most"))
        .select(F.explode(F.when(F.col("measure") == "table", F.array(
            _entry(F.lit("tables"), F.lit("distinct"), F.col("groups")),
            _entry(F.lit("tables"), F.lit("max per table"), F.col("most")),
        )).otherwise(F.array(_entry(F.col("measure"), F.col("name"), F.col("total"))))).alias("p"))
        .select("p.*")
    )


def _entry(measure, name, n):
    return F.struct(measure.alias("measure"), name.alias("name"), n.alias("n"))
