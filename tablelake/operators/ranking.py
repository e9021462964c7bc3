"""Sibling groups and the rankings they allow."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tablelake.fixed_values import MAX_RANK_OPTIONS, MIN_RANK_OPTIONS, RANK_MARGIN
from tablelake.functions.text import is_total, is_year_label
from tablelake.functions.values import is_number

GROUP_KEY = ("table_number", "col_index", "section", "ancestors")


def rank_members(cells: DataFrame) -> DataFrame:
    """Numeric cells of rows that do not total their siblings."""
    return cells.where(is_number(F.col("value")) & ~is_total(F.col("row_label")))


def rank_groups(cells: DataFrame, key: Sequence[str] = GROUP_KEY) -> DataFrame:
    """One row per sibling group with its size and value range."""
    num = F.col("value.num")
    return rank_members(cells).groupBy(*key).agg(
        F.count(F.lit(1)).alias("n_members"),
        F.max(num).alias("top_value"),
        F.min(num).alias("low_value"),
    )


def rank_eligible(members: DataFrame, key: Sequence[str] = GROUP_KEY, carry: Sequence[str] = (),
                  min_n: int = MIN_RANK_OPTIONS, max_n: int = MAX_RANK_OPTIONS,
                  margin: float = RANK_MARGIN) -> DataFrame:
    """Groups that can be ranked fairly, with their top options and the margin.

    The top `max_n` decide everything: rows labelled by a year sort first, so
    one of them anywhere in the group shows up at the top and disqualifies it.
    Keeping a few rows per group lets Spark limit groups before the shuffle.
    """
    num = F.col("value.num")
    yearly = is_year_label(F.col("row_label"))
    order = Window.partitionBy(*key).orderBy(yearly.desc(), num.desc(), F.col("row_index"))
    top = members.withColumn("_rank", F.row_number().over(order)).where(F.col("_rank") <= max_n)
    ranked = top.groupBy(*key).agg(
        F.array_sort(F.collect_list(F.struct(
            F.col("_rank").alias("rank"), F.col("row_label").alias("label"), num.alias("value"),
            yearly.alias("yearly"), *carry,
        ))).alias("ranked"))
    first, second = F.get("ranked", F.lit(0)), F.get("ranked", F.lit(1))
    gap = (first["value"] - second["value"]) / F.abs(F.nullif(first["value"], F.lit(0.0)))
    return ranked.where(
        (F.size("ranked") >= min_n) & ~first["yearly"] & (first["value"] > 0)
    ).withColumn("margin", gap).where(F.col("margin") > margin)
