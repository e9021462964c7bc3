"""Re-derive stored answers from the cells they came from."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablelake.functions.text import unhyphenate
from tablelake.functions.values import leaks_answer
from tablelake.operators.ranking import rank_eligible, rank_members

# Questions are few next to cells, so cells stream past them; hits are then
# counted per question and joined back.


def check_lookup(questions: DataFrame, cells: DataFrame) -> DataFrame:
    """`(id, n_hits, found_num, found_text, failure)` for lookup questions.

    Questions carry `table_number, section, ancestors, row_label, column_name,
    answer_num, answer_label`.
    """
    key = ["table_number", "section", "ancestors", "row_label", "column_name"]
    hits = cells.select(*key, "value").join(questions.select("id", *key), key)
    found = hits.groupBy("id").agg(
        F.count(F.lit(1)).alias("n_hits"),
        F.max("value.num").alias("found_num"), F.max("value.text").alias("found_text"))
    out = questions.join(found, "id", "left").withColumn("n_hits", F.coalesce("n_hits", F.lit(0)))
    same = F.col("found_num").eqNullSafe(F.col("answer_num")) & F.col("found_text").eqNullSafe(F.col("answer_label"))
    shown = F.coalesce(F.col("found_num").cast("string"), F.col("found_text"))
    stored = F.coalesce(F.col("answer_num").cast("string"), F.col("answer_label"))
    return out.select(
        "id", "n_hits", "found_num", "found_text",
        F.when(F.col("n_hits") != 1, F.format_string("%d rows match its coordinates", "n_hits"))
        .when(~same, F.concat_ws(" != ", shown, stored)).alias("failure"))


def check_rank(questions: DataFrame, cells: DataFrame) -> DataFrame:
    """`(id, top_label, failure)`: the group is rebuilt and every rule applied again.

    Questions carry `table_number, section, ancestors, column_name,
    answer_label, options`.
    """
    key = ["table_number", "section", "ancestors", "column_name"]
    members = rank_members(cells.join(questions.select("id", *key), key))
    ranked = rank_eligible(members, key=("id",)).select(
        "id", unhyphenate(F.get("ranked", F.lit(0))["label"]).alias("top_label"))
    out = questions.join(ranked, "id", "left")
    return out.select(
        "id", "top_label",
        F.when(F.col("top_label").isNull(), "ranking group no longer qualifies")
        .when(F.col("top_label") != F.col("answer_label"),
              F.concat(F.lit("top is "), F.col("top_label"), F.lit(", recorded "), F.col("answer_label")))
        .when((F.size("options") > 0) & ~F.array_contains("options", F.col("answer_label")),
              "answer is not among the options offered").alias("failure"))


def check_orphans(questions: DataFrame, tables: DataFrame) -> DataFrame:
    """Questions whose table is not in the source."""
    return questions.join(tables.select("table_number"), "table_number", "left_anti").select(
        "id", F.lit("table not in source").alias("failure"))


def check_leaks(questions: DataFrame) -> DataFrame:
    leaking = leaks_answer(F.col("question"), F.col("answer_num"), F.col("years"))
    return questions.where(leaking).select("id", F.lit("question contains its own answer").alias("failure"))


def check_questions(lookups: DataFrame, ranks: DataFrame, cells: DataFrame, tables: DataFrame) -> DataFrame:
    """All failures `(id, failure)` of a question set; empty when every answer re-derives."""
    def sourced(questions):
        return questions.join(tables.select("table_number"), "table_number", "left_semi")

    parts = [
        check_orphans(lookups, tables), check_orphans(ranks, tables),
        check_lookup(sourced(lookups), cells).select("id", "failure"),
        check_rank(sourced(ranks), cells).select("id", "failure"),
        check_leaks(sourced(lookups)),
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out.where("failure is not null")
