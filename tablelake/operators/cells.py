"""Addressable cells: rows with a unique key, one row per usable value."""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablelake.functions.values import usable
from tablelake.operators.blocked import BLOCK
from tablelake.operators.hierarchy import with_ancestors

ROW_KEY = ("table_number", "section", "ancestors", "row_label")


def unique_rows(rows: DataFrame, key: tuple[str, ...] = ROW_KEY) -> DataFrame:
    """Rows whose key occurs once; rows with an empty label are dropped.

    Copies are counted by an aggregate that carries one row along, so a key
    repeated by a third of all rows shrinks to one record per map task.
    """
    rest = [c for c in rows.columns if c not in key]
    return (
        rows.groupBy(*key)
        .agg(F.count(F.lit(1)).alias("_copies"), *[F.any_value(c).alias(c) for c in rest])
        .where((F.col("_copies") == 1) & (F.coalesce(F.col("row_label"), F.lit("")) != ""))
        .drop("_copies")
    )


def unpivot_cells(rows: DataFrame) -> DataFrame:
    """One row per usable value of `cells`; the stub column (0) is no value."""
    return (
        rows.select(*[c for c in rows.columns if c != "cells"], F.explode("cells").alias("cell"))
        .select("*", "cell.*").drop("cell")
        .where((F.col("col_index") > 0) & usable(F.col("value")))
    )


def index_cells(records: DataFrame, block: int | None = BLOCK,
                per_row: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Report records -> every answerable cell of every uniquely addressed row.

    Keys are worked out on row coordinates alone, so the cells themselves are
    shuffled once, to meet the keys of their rows. `per_row` adds columns to
    rows before their cells are taken apart, once for all cells of a row.
    """
    named = records.withColumns({
        "section": F.coalesce("section", F.lit("")),
        "row_label": F.coalesce("row_label", F.lit("")),
    })
    narrow = named.select("table_number", "row_index", "section", "indent", "row_label")
    keys = unique_rows(with_ancestors(narrow, block=block).drop("indent"))
    wide = named.drop("section", "row_label")
    rows = wide.join(keys, ["table_number", "row_index"])
    return unpivot_cells(per_row(rows) if per_row else rows)
