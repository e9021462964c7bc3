"""Yearly tables of one kind stacked into a panel."""
from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def schema_drift(spark: SparkSession, yearly: Mapping[int, DataFrame]) -> DataFrame:
    """Columns whose type is not the same in all years that have them."""
    seen = [(name, dtype, year) for year, df in sorted(yearly.items()) for name, dtype in df.dtypes]
    listed = spark.createDataFrame(seen, "column_name string, type string, year int")
    return (
        listed.groupBy("column_name")
        .agg(F.array_sort(F.collect_set("type")).alias("types"), F.min("year").alias("first_year"),
             F.max("year").alias("last_year"))
        .where(F.size("types") > 1)
    )


def year_panel(yearly: Mapping[int, DataFrame]) -> DataFrame:
    """All years with a `year` column; columns a year lacks are NULL. Types must agree."""
    kinds: dict[str, set[str]] = {}
    for df in yearly.values():
        for name, dtype in df.dtypes:
            kinds.setdefault(name, set()).add(dtype)
    clash = sorted(name for name, types in kinds.items() if len(types) > 1)
    if clash:
        raise ValueError(f"types differ between years: {', '.join(clash)}")
    stamped = [df.withColumn("year", F.lit(year)) for year, df in sorted(yearly.items())]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), stamped)


def read_year_panel(spark: SparkSession, root: str) -> DataFrame:
    """The panel of tables stored as `<root>/year=<year>`: one scan of all years, pruned by year.

    Columns a year lacks are NULL, and types that differ between years are an error, as in `year_panel`. Schemas come from
    the files' own footers, read as a Spark job.
    """
    return spark.read.option("mergeSchema", "true").option("basePath", root).parquet(root)
