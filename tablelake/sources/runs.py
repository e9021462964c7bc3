"""Numbered runs: folders of data and a log that says which of them count.

A run's data is written first, its line in the log after it, so a run that failed half-way is never read and its number is
given to the next one. A replacing run hides the ones before it at the moment its line is written; until then they are read as before.
"""
from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LOG = "run long, base long"


def committed(spark: SparkSession, path: str) -> list[int]:
    """Numbers of the runs that count, ascending: the last replacing one and those after it. A row per run is read."""
    try:
        log = spark.read.schema(LOG).json(f"{path.rstrip('/')}/log/*")
        lines = [(r["run"], r["base"]) for r in log.collect()]
    except AnalysisException as problem:
        if problem.getCondition() != "PATH_NOT_FOUND":
            raise
        return []
    base = max((b for _, b in lines), default=0)
    return sorted(run for run, _ in lines if run >= base)


def _folder(path: str, run: int) -> str:
    return f"{path.rstrip('/')}/data/run-{run:012d}"


def commit(df: DataFrame, path: str, replace: bool = False, form: str = "parquet", partition_by: tuple[str, ...] = ()) -> int:
    """Writes `df` as the next run and then its line in the log; returns its number.

    `replace` hides all runs before it. `df` may read the runs that are there. Of two writers at once one fails, as both claim a line of the log.
    """
    spark = df.sparkSession
    before = committed(spark, path)
    run = max(before, default=0) + 1
    # Only a run without a line in the log can have left something in this folder.
    df.write.mode("overwrite").partitionBy(*partition_by).format(form).save(_folder(path, run))
    base = run if replace or not before else before[0]
    spark.createDataFrame([(run, base)], LOG).coalesce(1).write.mode("errorifexists").json(f"{path.rstrip('/')}/log/{run:012d}")
    return run


def folders(spark: SparkSession, path: str) -> list[str]:
    """Folders of the runs that count, in order."""
    return [_folder(path, run) for run in committed(spark, path)]


def read(spark: SparkSession, path: str, form: str = "parquet", schema: str | None = None) -> DataFrame:
    """Rows of all runs that count. No run at all is an error unless a schema says what an empty table looks like."""
    found = folders(spark, path)
    if not found and schema is None:
        raise FileNotFoundError(f"no finished run in {path}")
    reader = spark.read.format(form)
    if schema is not None:
        reader = reader.schema(schema)
    return reader.load(found) if found else spark.createDataFrame([], schema)


def run_number(file: str = "_metadata.file_path"):
    """The run that a row was read from."""
    return F.coalesce(F.regexp_extract(F.col(file), r"/run-(\d+)/", 1).try_cast("long"), F.lit(-1))
