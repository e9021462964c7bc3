"""Seeded samples: per table, by quota, and limits per group.

Order comes from `md5(seed|id)`, so a seed picks the same rows on any cluster
layout. All cuts are top-k per group or overall, which Spark applies per map
task before anything is shuffled.
"""
from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tablelake.fixed_values import CANDIDATES_PER_TABLE, PER_TABLE_CAP
from tablelake.session import materialise


def seeded(seed: int, *parts: Column) -> Column:
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *parts))


def limit_per(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int,
              rank: str | None = None) -> DataFrame:
    """First `n` rows of each group."""
    name = rank or "_rank"
    window = Window.partitionBy(*keys).orderBy(*order)
    out = df.withColumn(name, F.row_number().over(window)).where(F.col(name) <= n)
    return out if rank else out.drop(name)


def sample_per_group(df: DataFrame, keys: Sequence[str], ident: Sequence[str],
                     n: int = CANDIDATES_PER_TABLE, seed: int = 0) -> DataFrame:
    draw = seeded(seed, *[F.col(c).cast("string") for c in ident])
    return limit_per(df, keys, [draw, *[F.col(c) for c in ident]], n)


def scale_quotas(quotas: Mapping[str, int], limit: int) -> dict[str, int]:
    """Quotas for a smaller set, proportions kept, at least one of each."""
    total = sum(quotas.values())
    return {name: max(1, round(quota * limit / total)) for name, quota in quotas.items()}


def scaled_quota(quota: Column, total: Column, limit: Column) -> Column:
    return F.greatest(F.lit(1).cast("bigint"), F.bround(quota * limit / total).cast("bigint"))


def quota_sample(df: DataFrame, quotas: Mapping[str, int], cap: int = PER_TABLE_CAP, seed: int = 0,
                 kind: str = "question_type", table: str = "table_number", ident: str = "id") -> DataFrame:
    """Fill each kind's quota in turn; one table gives at most `cap` over all kinds.

    A kind's quota is a plain top-k over the rows its tables may still give,
    so no window spans the whole set; each step holds no more than the quota,
    and writes it, as later steps count what their tables have given.
    """
    draw = seeded(seed, F.col(ident))
    chosen: DataFrame | None = None
    for name, quota in quotas.items():
        pool = limit_per(df.where(F.col(kind) == name), [table], [draw, F.col(ident)], cap, rank="_rank")
        if chosen is not None:
            taken = chosen.groupBy(table).agg(F.count(F.lit(1)).alias("_taken"))
            pool = (
                pool.join(taken, table, "left")
                .where(F.col("_rank") <= F.lit(cap) - F.coalesce("_taken", F.lit(0)))
                .drop("_taken")
            )
        picked = materialise(pool.drop("_rank").orderBy(draw, F.col(ident)).limit(quota), "quota-picked")
        chosen = picked if chosen is None else chosen.unionByName(picked)
    return chosen
