"""JSON Lines: one object per line, last duplicate key wins."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablelake.sources import runs


def read_jsonl(spark: SparkSession, path: str, schema: T.StructType | str, key: str | None = None) -> DataFrame:
    """Typed objects; blank lines are skipped. With `key`, later lines replace earlier ones.

    Later is a later appended run, then a higher part number, then a place further down the file. Of a set written by `write_jsonl` the finished
    runs are read, of any other folder all files.
    """
    file = F.col("_metadata.file_path")
    part = F.coalesce(F.regexp_extract(file, r"/part-(\d+)[^/]*$", 1).try_cast("long"), F.lit(-1))
    lines = spark.read.option("recursiveFileLookup", "true").text(runs.folders(spark, path) or path).select(
        "value",
        F.struct(
            runs.run_number().alias("run"), part.alias("part"), file.alias("file"), F.col("_metadata.file_block_start"),
            F.monotonically_increasing_id(),
        ).alias("line_order"),
    )
    parsed = lines.where(F.trim("value") != "").select(
        F.from_json("value", schema, {"mode": "FAILFAST"}).alias("record"), "line_order")
    if key is None:
        return parsed.select("record.*")
    return last_wins(parsed, f"record.{key}", "line_order").select("record.*")


def last_wins(df: DataFrame, key: str, order: str) -> DataFrame:
    """The row with the highest `order` per key.

    An aggregate, not a window: repeats of a hot key collapse before the shuffle.
    """
    record = F.struct(*[F.col(c) for c in df.columns])
    return (
        df.groupBy(F.col(key).alias("_key"))
        .agg(F.max_by(record, F.col(order)).alias("_last"))
        .select("_last.*")
    )


def write_jsonl(df: DataFrame, path: str, mode: str = "errorifexists") -> int:
    """Writes a numbered run and returns its number: `overwrite` for data sets, `append` for sets that grow run by run.

    A run is read once it is whole. With `errorifexists` there must be none yet.
    """
    if mode not in ("append", "overwrite", "errorifexists"):
        raise ValueError(f"unknown mode {mode}")
    if mode == "errorifexists" and runs.committed(df.sparkSession, path):
        raise FileExistsError(f"{path} is there already")
    return runs.commit(df, path, replace=mode == "overwrite", form="json")
