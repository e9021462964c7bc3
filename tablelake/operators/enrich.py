"""Filling a column by a user function, resumably and without keys."""
from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablelake.functions.text import strip
from tablelake.session import materialise
from tablelake.sources import runs

COPIES_PER_TASK = 65536
#: Rows whose values are lost with the driver, at most.
ROWS_PER_ROUND = 1 << 20
LEDGER = "row_key string, value string"


def enrich_targets(registry: DataFrame) -> DataFrame:
    """Table catalogs of all years, by name."""
    name = F.lower("table_name")
    return registry.where(name.startswith("tables") & name.endswith("_meta")).select("table_name").orderBy("table_name")


def answered(df: DataFrame, fn: Callable[[pd.DataFrame], pd.Series], keep: Sequence[str], out: str = "value") -> DataFrame:
    """`keep` columns of `df` with `out`, what `fn` says of a batch of the others, and `problem`, why it said nothing.

    An error does not end the job, so that what other batches have been told is not lost: its own batch and the rest of its task stay unanswered.
    """
    asked = [c for c in df.columns if c not in keep]

    def run(batches):
        problem = None
        for batch in batches:
            told = batch[list(keep)].copy()
            told[out] = None
            if problem is None:
                try:
                    told[out] = fn(batch[asked])
                except Exception as error:  # noqa: BLE001 - handed on to the driver with the rows it concerns
                    problem = f"{type(error).__name__}: {error}"
            told["problem"] = problem
            yield told

    schema = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keep)
    return df.select(*keep, *asked).mapInPandas(run, f"{schema}, `{out}` string, problem string")


def _pending(df: DataFrame, out_col: str, required: str):
    return F.col(out_col).isNull() & (strip(F.coalesce(required, F.lit(""))) != "")


def with_column(df: DataFrame, out_col: str) -> DataFrame:
    """`df` with a text column of that name, added where absent."""
    return df if out_col in df.columns else df.withColumn(out_col, F.lit(None).cast("string"))


def fill_missing(df: DataFrame, out_col: str, inputs: Sequence[str],
                 fn: Callable[[pd.DataFrame], pd.Series], required: str) -> DataFrame:
    """`out_col` computed where it is NULL and `required` is not blank.

    The column is added when absent. Rows `fn` answers with None stay pending,
    so writing the result and calling again continues where a run stopped.
    Only the inputs of pending rows go to Python, and the table is read once. An error of `fn` fails the job: see `fill_durably`.
    """
    df = with_column(df, out_col)

    @F.pandas_udf("string")
    def call(asked: pd.DataFrame) -> pd.Series:
        rows = asked["pending"]
        out = pd.Series([None] * len(asked), dtype=object)
        if rows.any():
            out[rows] = fn(asked.loc[rows, list(inputs)].reset_index(drop=True)).to_numpy()
        return out

    pending = _pending(df, out_col, required)
    asked = F.struct(pending.alias("pending"), *[F.when(pending, F.col(c)).alias(c) for c in inputs])
    return df.withColumn(out_col, F.coalesce(F.col(out_col), call(asked)))


@dataclass
class Filled:
    """`table` with all values known by now; values this call added; an error that stopped it short, if any."""

    table: DataFrame
    updated: int
    problem: str | None


def fill_durably(df: DataFrame, key: str, out_col: str, inputs: Sequence[str], fn: Callable[[pd.DataFrame], pd.Series],
                 required: str, ledger: str, per_round: int = ROWS_PER_ROUND) -> Filled:
    """As `fill_missing`, with every value kept in a ledger as soon as its round of `per_round` rows is through.

    `key` names the rows (see `with_row_key`). Rows without a value in the table or the ledger are dealt into rounds by key; a round asks `fn`, and its
    answers are a run of the ledger (`row_key, value`), also when `fn` failed for some rows. Then no further round is begun. Calling again asks for the rest
    only. Only the key and the inputs of pending rows go to Python.
    """
    spark = df.sparkSession
    df = with_column(df, out_col)
    known = lambda: runs.read(spark, ledger, schema=LEDGER)
    waiting = df.where(_pending(df, out_col, required)).select(F.col(key).cast("string").alias("row_key"), *inputs)
    waiting = materialise(waiting.join(known(), "row_key", "left_anti"), "ledger-pending")
    rounds, updated, problem = max(1, -(-waiting.count() // per_round)), 0, None
    for part in range(rounds):
        mine = waiting.where(F.pmod(F.xxhash64("row_key"), F.lit(rounds)) == part)
        told = materialise(answered(mine, fn, ["row_key"]), "ledger-round")
        n, problem = told.agg(F.count("value"), F.min("problem")).first()
        if n:
            runs.commit(told.where("value IS NOT NULL").select("row_key", "value"), ledger)
            updated += n
        if problem is not None:
            break
    values = known().groupBy("row_key").agg(F.max("value").alias("_value")).withColumnRenamed("row_key", "_row_key")
    met = df.join(values, F.col(key).cast("string") == F.col("_row_key"), "left")
    return Filled(met.withColumn(out_col, F.coalesce(out_col, "_value")).select(*df.columns), updated, problem)


def row_hash(df: DataFrame, columns: Sequence[str] | None = None):
    """SHA-256 over the row as JSON, which keeps NULL, empty texts and separators inside texts apart."""
    row = F.struct(*[F.col(c) for c in columns or df.columns])
    return F.sha2(F.to_json(row, {"ignoreNullFields": "false"}), 256)


def with_row_key(df: DataFrame, key: str = "row_key") -> DataFrame:
    """A stable key for rows without one: content hash plus the copy's number.

    Identical rows are interchangeable, so they are counted once (map-side) and
    dealt out again in runs of `COPIES_PER_TASK` to other tasks, instead of
    being numbered in one window.
    """
    counted = df.groupBy(*df.columns).agg(F.count(F.lit(1)).alias("_n"))
    runs = counted.withColumn("_run", F.explode(
        F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("_n") - 1) / COPIES_PER_TASK))))
    runs = runs.withColumn("_hash", row_hash(df)).repartition("_hash", "_run")
    copies = runs.withColumn("_copy", F.explode(F.sequence(
        F.col("_run") * COPIES_PER_TASK + 1, F.least(F.col("_n"), (F.col("_run") + 1) * COPIES_PER_TASK))))
    return copies.withColumn(key, F.concat_ws("-", "_hash", F.col("_copy").cast("string"))).drop("_n", "_run", "_hash", "_copy")
