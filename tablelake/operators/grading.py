"""Predictions against questions."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablelake.functions.text import let
from tablelake.functions.values import coerce_number, same_label, within_tolerance
from tablelake.operators.once import computed_once


def six_digits(number: Column) -> Column:
    """Six significant digits, thousands grouped, trailing zeros cut; far magnitudes as powers of ten."""
    cut = lambda c: let(c, lambda x: F.when(x.contains("."), F.regexp_replace(x, r"\.?0+$", "")).otherwise(x))

    def written(shown: Column) -> Column:
        mantissa, sign = F.substring_index(shown, "e", 1), F.substring_index(shown, "e", -1)
        plain = lambda power: cut(F.call_function("format_number", shown.try_cast("decimal(38,15)"), F.greatest(5 - power, F.lit(0))))
        return let(sign.try_cast("int"), lambda power: F.when(power.between(-4, 5), plain(power)).otherwise(
            F.concat(cut(mantissa), F.lit("e"), sign)))

    endless = F.when(F.isnan(number), "nan").when(number == float("inf"), "inf").when(number == float("-inf"), "-inf")
    return F.coalesce(endless, let(F.format_string("%.5e", number), written))


def grade(questions: DataFrame, predictions: DataFrame) -> DataFrame:
    """Every question with `present`, `correct` and the `reason` of a failure.

    `predictions` holds one row per id (see `last_wins`), `answer` as text. A
    NULL prediction is wrong; only an absent one is missing.
    """
    given = predictions.select("id", F.col("answer").alias("predicted"), F.lit(True).alias("present"))
    joined = questions.join(given, "id", "left").withColumn("present", F.coalesce("present", F.lit(False)))
    numeric = F.col("answer_type") == "number"
    # The number is read once, and the row is judged once, however often the reason names them.
    joined = computed_once(joined, "_got", F.when(numeric, coerce_number(F.col("predicted"))))
    got, want = F.col("_got"), F.col("answer_num")
    right = F.when(numeric, within_tolerance(got, want, F.coalesce("tolerance", F.lit(0.0)))).otherwise(
        same_label(F.col("predicted"), F.col("answer_label")))
    quoted = lambda c: F.coalesce(F.concat(F.lit("'"), c, F.lit("'")), F.lit("None"))
    off = F.when(want == 0, "+inf%").otherwise(
        F.format_string("%+.2f%%", (got - want) / F.nullif(want, F.lit(0.0)) * 100))
    reason = (
        F.when(~F.col("present"), "no prediction")
        .when(F.col("correct"), "")
        .when(numeric & got.isNull(), F.concat(F.lit("not a number: "), quoted(F.col("predicted"))))
        .when(numeric, F.concat(six_digits(got), F.lit(" vs "), six_digits(want), F.lit(" ("), off, F.lit(")")))
        .otherwise(F.concat(quoted(F.col("predicted")), F.lit(" vs "), quoted(F.col("answer_label"))))
    )
    judged = computed_once(joined, "correct", F.coalesce(F.col("present") & right, F.lit(False)))
    return judged.withColumn("reason", reason).drop("_got")


def accuracy(graded: DataFrame) -> DataFrame:
    """Hits, totals and missing answers per question type, and over all (`question_type` NULL), also of no questions."""
    sums = (
        F.count(F.lit(1)).alias("n_questions"),
        F.count_if("correct").alias("n_correct"),
        F.count_if(~F.col("present")).alias("n_missing"),
    )
    over_all = graded.agg(*sums).withColumn("question_type", F.lit(None).cast("string"))
    return graded.groupBy("question_type").agg(*sums).unionByName(over_all).withColumn(
        "accuracy", F.try_divide("n_correct", "n_questions"))


def failures(graded: DataFrame, n: int, order: str = "id") -> DataFrame:
    """First `n` failures in question order, as report lines, with the number of all failures in `total`."""
    line = F.concat(F.lit("["), F.col("question_type"), F.lit("] "), F.col("id"), F.lit(": "), F.col("reason"))
    failed = graded.where(~F.col("correct")).select("id", F.col(order).alias("_order"), line.alias("line"))
    return failed.sparkSession.sql(
        f"SELECT id, line, (SELECT count(*) FROM {{failed}}) AS total FROM {{failed}} ORDER BY _order LIMIT {int(n)}", failed=failed)
