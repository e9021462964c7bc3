"""Exact order statistics and bag operations without a group's rows, or a key's copies, in one task."""
from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tablelake.session import materialise

#: Ranges that a stretch of values is cut into in one round.
RANGES = 1024
#: Copies of a row dealt out by one task.
COPIES = 1 << 16


def exact_percentiles(df: DataFrame, group: str, value: str, shares: Mapping[str, float]) -> DataFrame:
    """`group` and a column per entry of `shares`: the exact percentile of `value`, between the two nearest values in proportion.

    Selection by counting: rows are counted per group and value once; a round then cuts the stretch that holds a wanted rank into RANGES, sums their
    counts and goes on in the range that crosses the rank, until its ends meet. A task sees counts of ranges, never a group's values.
    NULL and NaN values do not count; groups without any have NULL. A NULL group is a group.
    """
    named = df.select(F.col(group).alias("g"), F.col(value).cast("double").alias("v"))
    counts = materialise(named.where("v IS NOT NULL AND NOT isnan(v)").groupBy("g", "v").agg(F.count(F.lit(1)).alias("n")), "value-counts")
    total = counts.groupBy("g").agg(F.sum("n").alias("total"), F.min("v").alias("lo"), F.max("v").alias("hi"))
    wanted = F.array(*[F.struct(F.lit(name).alias("name"), F.lit(float(p)).alias("p")) for name, p in shares.items()])
    asked = total.select("*", F.explode(wanted).alias("w")).select("g", "lo", "hi", "w.name", (F.col("w.p") * (F.col("total") - 1)).alias("at"))
    ends = F.array(F.floor("at"), F.ceil("at"))
    open_ = materialise(asked.select("g", "name", "at", "lo", "hi", F.lit(0).cast("bigint").alias("before"), F.explode(F.array_distinct(ends)).alias("rank")), "ranks")
    while open_.where("lo < hi").limit(1).count():
        stretches = open_.where("lo < hi").select("g", "lo", "hi").distinct()
        place = F.least(F.floor((F.col("v") - F.col("lo")) / ((F.col("hi") - F.col("lo")) / RANGES)), F.lit(RANGES - 1))
        met = counts.join(stretches, counts["g"].eqNullSafe(stretches["g"]) & counts["v"].between(F.col("lo"), F.col("hi"))).select(stretches["g"], "lo", "hi", "v", "n")
        cut = met.groupBy("g", "lo", "hi", place.alias("r")).agg(F.sum("n").alias("n"), F.min("v").alias("low"), F.max("v").alias("high"))
        upto = F.sum("n").over(Window.partitionBy("g", "lo", "hi").orderBy("r"))  # at most RANGES rows
        cut = materialise(cut.withColumn("upto", upto).withColumnsRenamed({"g": "g2", "lo": "lo2", "hi": "hi2"}), "ranges")
        same = open_["g"].eqNullSafe(cut["g2"]) & (open_["lo"] == cut["lo2"]) & (open_["hi"] == cut["hi2"])
        inside = (F.col("rank") >= F.col("before") + F.col("upto") - F.col("n")) & (F.col("rank") < F.col("before") + F.col("upto"))
        found = open_.where("lo < hi").join(cut, same).where(inside).select(
            "g", "name", "at", F.col("low").alias("lo"), F.col("high").alias("hi"), (F.col("before") + F.col("upto") - F.col("n")).alias("before"), "rank")
        open_ = materialise(found.unionByName(open_.where("lo >= hi")), "ranks")
    low, high = F.min_by("lo", "rank"), F.max_by("lo", "rank")
    each = open_.groupBy("g", "name").agg((low + (high - low) * F.max(F.col("at") - F.floor("at"))).alias("value"))
    out = each.groupBy("g").agg(*[F.max(F.when(F.col("name") == name, F.col("value"))).alias(name) for name in shares])
    groups = named.select(F.col("g").alias("_all")).distinct()
    return groups.join(out, groups["_all"].eqNullSafe(out["g"]), "left").select(F.col("_all").alias(group), *shares)


def _dealt(counted: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Each row `n` times, in runs that go to different tasks."""
    runs = counted.where("n > 0").withColumn("_run", F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("n") - 1) / COPIES))))
    runs = runs.repartition(*columns, "_run")
    size = F.least(F.lit(COPIES), F.col("n") - F.col("_run") * COPIES).cast("int")
    return runs.select(*columns, F.explode(F.array_repeat(F.lit(True), size)).alias("_copy")).select(*columns)


def _bag(left: DataFrame, right: DataFrame, times: Column) -> DataFrame:
    columns = left.columns
    both = left.select("*", F.lit(1).alias("_l"), F.lit(0).alias("_r")).union(right.select("*", F.lit(0), F.lit(1)))
    # Counted map-side: a row that a third of the input repeats is one row per task before the shuffle.
    counted = both.groupBy(*columns).agg(F.sum("_l").alias("_l"), F.sum("_r").alias("_r"))
    return _dealt(counted.select(*columns, times.alias("n")), columns)


def except_all(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows of `left` as many times as it holds them more often than `right`."""
    return _bag(left, right, F.col("_l") - F.col("_r"))


def intersect_all(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows of both as many times as the one that holds them less often."""
    return _bag(left, right, F.least("_l", "_r"))
