"""Loading the tables that yearly exports list, with every guard in its place."""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tablelake.operators.selection import classify_tables, lower_keys, prune_catalog, refuse_collisions, select_tables
from tablelake.session import materialise
from tablelake.sources import runs
from tablelake.sources.export import lower_columns
from tablelake.sources.sink import refuse_if_loaded, write_table

REGISTRY = "registry"
REGISTRY_FIELDS = "table_name string, file_name string, source_table string, is_meta boolean"


def registry(spark: SparkSession, root: str) -> DataFrame:
    """Tables loaded under `root`; none yet is an empty one."""
    return runs.read(spark, f"{root.rstrip('/')}/{REGISTRY}", schema=REGISTRY_FIELDS)


def ingest(listing: DataFrame, read: Callable[[str, str], DataFrame], root: str, replace: bool = False) -> DataFrame:
    """Loads the tables of `listing` (`file_name, source_table`) and returns the registry.

    A catalog left by an earlier load is refused unless `replace`, and so are two sources of one name, before anything is read. `read(file_name,
    source_table)` gives a table's rows. Rollups and revised catalogs are left out; catalogs drop the rows of left-out tables and get
    lower-case variable names; all columns are lower-cased. The registry is replaced last: a load that fails leaves every table of the last one readable, those it had
    already replaced in their new version.
    """
    spark = listing.sparkSession
    refuse_if_loaded(registry(spark, root), replace)
    chosen = materialise(classify_tables(select_tables(listing)).select("file_name", "source_table", "is_meta", "dest"), "ingest-tables")
    refuse_collisions(chosen)
    # One row per table of the exports, each a job of its own.
    for row in chosen.orderBy("file_name", "source_table").collect():
        table = lower_columns(read(row["file_name"], row["source_table"]))
        if row["is_meta"]:
            table = lower_keys(prune_catalog(table))
        write_table(table, root, row["dest"], replace=replace)
    loaded = chosen.selectExpr("dest AS table_name", "file_name", "source_table", "is_meta")
    runs.commit(loaded, f"{root.rstrip('/')}/{REGISTRY}", replace=True)
    return registry(spark, root)
