"""Which source tables are loaded, and under which name."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablelake.fixed_values import CATALOG_KINDS, EXCLUDED_PREFIXES

_KINDS = "|".join(CATALOG_KINDS)


def has_prefix(name: Column, prefixes: Sequence[str] = EXCLUDED_PREFIXES) -> Column:
    return F.upper(name).rlike("^(?:" + "|".join(prefixes) + ")")


def is_meta(name: Column) -> Column:
    return name.rlike(rf"(?i)^(?:{_KINDS})\d{{2}}$")


def is_revised(name: Column) -> Column:
    return name.rlike(rf"(?i)^(?:{_KINDS})\d{{2}}_RV$")


def select_tables(listing: DataFrame, name: str = "source_table",
                  excluded: Sequence[str] = EXCLUDED_PREFIXES) -> DataFrame:
    """Without blank names, computed rollups and revised catalogs."""
    trimmed = listing.withColumn(name, F.trim(name)).where(F.col(name) != "")
    return trimmed.where(~has_prefix(F.col(name), excluded) & ~is_revised(F.col(name)))


def classify_tables(listing: DataFrame, name: str = "source_table") -> DataFrame:
    """Adds `is_meta` and the destination name `dest`."""
    meta = is_meta(F.col(name))
    return listing.withColumns({
        "is_meta": meta,
        "dest": F.when(meta, F.lower(F.concat(F.col(name), F.lit("_meta")))).otherwise(F.col(name)),
    })


def collisions(classified: DataFrame, source: str = "file_name") -> DataFrame:
    """Destinations claimed more than once, upper and lower case being one name.

    Counts and the first and last claimant, rather than a list that a
    much-claimed name would let grow without bound.
    """
    return (
        classified.groupBy(F.lower("dest").alias("dest"))
        .agg(F.count(F.lit(1)).alias("n_sources"), F.min(source).alias("first_source"),
             F.max(source).alias("last_source"))
        .where("n_sources > 1")
    )


def refuse_collisions(classified: DataFrame, source: str = "file_name") -> None:
    found = collisions(classified, source).orderBy("dest").limit(1).collect()
    if found:
        row = found[0]
        raise ValueError(f"{row['dest']} is claimed by {row['first_source']} and {row['last_source']}")


def prune_catalog(catalog: DataFrame, excluded: Sequence[str] = EXCLUDED_PREFIXES) -> DataFrame:
    """Catalog rows of excluded tables go; rows without a table name stay."""
    if "tablename" not in catalog.columns:
        return catalog
    return catalog.where(~F.coalesce(has_prefix(F.col("tablename"), excluded), F.lit(False)))


def lower_keys(catalog: DataFrame, column: str = "varname") -> DataFrame:
    if column not in catalog.columns:
        return catalog
    return catalog.withColumn(column, F.lower(column))
