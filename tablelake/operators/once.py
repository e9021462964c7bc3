"""Columns that are computed once, however many later steps read them."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def computed_once(df: DataFrame, name: str, value: Column) -> DataFrame:
    """Adds `name`, kept apart from the filters and expressions that use it.

    Catalyst would copy the whole expression into each of its uses, filters
    included; it does not do so across a generator.
    """
    return df.select("*", F.explode(F.array(value)).alias(name))
