"""Loaded tables on storage: refuse, create, replace."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablelake.sources import runs


def write_table(df: DataFrame, root: str, name: str, replace: bool = False,
                partition_by: tuple[str, ...] = ()) -> str:
    """Write one table; an existing one is an error unless `replace`.

    A replaced table is read as it was until the new one is whole, also by the job that writes it; a failed replacement leaves it so.
    """
    path = f"{root.rstrip('/')}/{name}"
    if not replace and table_exists(df.sparkSession, root, name):
        raise FileExistsError(f"{path} is there already")
    runs.commit(df, path, replace=True, partition_by=partition_by)
    return path


def read_table(spark: SparkSession, root: str, name: str) -> DataFrame:
    return runs.read(spark, f"{root.rstrip('/')}/{name}")


def table_exists(spark: SparkSession, root: str, name: str) -> bool:
    return bool(runs.committed(spark, f"{root.rstrip('/')}/{name}"))


def count_meta(registry: DataFrame) -> DataFrame:
    """How many catalog tables an earlier run left behind."""
    return registry.agg(
        F.count_if(F.col("table_name").like(r"%\_meta")).alias("n_meta_tables"))


def refuse_if_loaded(registry: DataFrame, replace: bool) -> None:
    found = count_meta(registry).head()["n_meta_tables"]
    if found and not replace:
        raise RuntimeError(f"{found} catalog tables are already loaded; pass replace=True to rebuild them")
