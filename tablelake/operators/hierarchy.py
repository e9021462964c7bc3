"""Row hierarchy of report tables: ancestors by indent, sections carried down."""
from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablelake.operators.blocked import BLOCK, running_last
from tablelake.session import materialise


# ---- ancestors ------------------------------------------------------------------
# A stretch of rows leaves a stack of open rows (level, label), levels rising. Stretches merge associatively: of the stack
# before, only rows shallower than everything in the next stretch stay open. So stretches are summed up in blocks, the
# sums are scanned in blocks of their own, and no task sees more than a block.
_OPEN = pa.list_(pa.struct([("level", pa.int32()), ("label", pa.string())]))
_OPEN_SQL = "array<struct<level:int,label:string>>"


def _merged(stack: list, least: int, more: list) -> list:
    """The stack after rows whose shallowest level is `least` and that leave `more` open. `stack` is changed."""
    while stack and stack[-1]["level"] >= least:
        stack.pop()
    stack.extend(more)
    return stack


def _sum_up(keys: Sequence[str], at: str):
    """One row per block: what its stretches, in order, leave open, and their shallowest level."""

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("_order")
        stack: list = []
        for least, more in zip(table.column("_least").to_pylist(), table.column("_open").to_pylist()):
            _merged(stack, least, more)
        first = table.slice(0, 1).select([*keys, at])
        return first.append_column("_least", pa.array([pc.min(table.column("_least")).as_py()], pa.int32())).append_column("_open", pa.array([stack], _OPEN))

    return run


def _carried(sums: DataFrame, keys: Sequence[str], block: int, depth: int) -> DataFrame:
    """What is open before each block, of the sums of all blocks (`_at`): scanned in blocks of blocks while `depth` lasts."""
    groups = sums.withColumn("_order", F.col("_at")).withColumn("_above", F.floor(F.col("_at") / block) if depth else F.lit(0).cast("bigint"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in sums.select(*keys).schema)

    def before(table: pa.Table, above: pa.Table) -> pa.Table:
        table = table.sort_by("_order")
        stack = list(above.column("_open")[0].as_py()) if above.num_rows else []
        opened = []
        for least, more in zip(table.column("_least").to_pylist(), table.column("_open").to_pylist()):
            opened.append(list(stack))
            _merged(stack, least, more)
        return table.select([*keys, "_at"]).append_column("_open", pa.array(opened, _OPEN))

    by = [*keys, "_above"]
    if depth:
        upper = groups.groupBy(*by).applyInArrow(_sum_up(keys, "_above"), f"{schema}, _above bigint, _least int, _open {_OPEN_SQL}")
        upper = _carried(upper.withColumnRenamed("_above", "_at"), keys, block, depth - 1).withColumnRenamed("_at", "_above")
    else:
        upper = groups.select(*by, "_open").where(F.lit(False))
    return groups.groupBy(*by).cogroup(upper.groupBy(*by)).applyInArrow(before, f"{schema}, _at bigint, _open {_OPEN_SQL}")


def with_ancestors(rows: DataFrame, keys: Sequence[str] = ("table_number",), index: str = "row_index",
                   indent: str = "indent", label: str = "row_label",
                   block: int | None = BLOCK) -> DataFrame:
    """Adds `ancestors`, the labels a row is nested under, outermost first.

    Per depth below the row's own, the nearest earlier row of that depth is an
    ancestor unless a shallower row came in between. Sections do not reset the
    chain. Levels may be any whole numbers: a chain is one array, whatever the deepest indent. Tables of any length are
    scanned in blocks of `block` index values; None takes each table as one block.
    A task reads its rows in order, whatever the number of tables; only tables of several blocks are summed up before.
    """
    level = F.coalesce(F.col(indent), F.lit(0)).cast("int")
    marked = rows.withColumns({
        "_at": F.floor(F.col(index) / block).cast("bigint") if block else F.lit(0).cast("bigint"),
        "_order": F.col(index).cast("bigint"), "_least": level, "_label": F.coalesce(F.col(label), F.lit(""))})
    by, names = [*keys, "_at"], rows.columns
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    placed = marked.withColumn("_open", F.lit(None).cast(_OPEN_SQL))
    if block:
        before = _open_before(marked, keys, block)
        # What is open before a block is a line of its own ahead of the block's rows.
        placed = placed if before is None else placed.unionByName(before, allowMissingColumns=True)

    def climb(batches):
        place, stack = None, []
        for batch in batches:
            held, chains = [], []
            places = zip(*[batch.column(c).to_pylist() for c in by])
            for here, opened, own_level, own_label in zip(places, *[batch.column(c).to_pylist() for c in ("_open", "_least", "_label")]):
                if here != place:
                    place, stack = here, []
                held.append(opened is None)
                if opened is not None:
                    stack = [(x["level"], x["label"]) for x in opened]
                    continue
                while stack and stack[-1][0] >= own_level:
                    stack.pop()
                chains.append([x[1] for x in stack])
                stack.append((own_level, own_label))
            own = batch.select(names) if all(held) else batch.select(names).filter(pa.array(held))
            yield pa.RecordBatch.from_arrays([*own.columns, pa.array(chains, pa.list_(pa.string()))], names=[*names, "ancestors"])

    ordered = placed.repartition(*by).sortWithinPartitions(*by, F.col("_open").isNull(), "_order")
    return ordered.mapInArrow(climb, f"{schema}, ancestors array<string>")


def _open_before(marked: DataFrame, keys: Sequence[str], block: int) -> DataFrame | None:
    """What is open before each block of the tables that have several; None where there are no such tables."""
    spans = marked.groupBy(*keys).agg(F.min("_at").alias("_first"), F.max("_at").alias("_last")).where("_first < _last")
    tables = materialise(spans.drop("_first"), "long-tables")
    if tables.isEmpty():
        return None
    named = tables.withColumnsRenamed({c: f"_table_{c}" for c in keys})
    same = reduce(and_, [F.col(c).eqNullSafe(F.col(f"_table_{c}")) for c in keys])
    key_schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in marked.select(*keys).schema)
    own = F.array(F.struct(F.col("_least").alias("level"), F.col("_label").alias("label")))
    rows = marked.join(named, same, "left_semi").select(*keys, "_at", "_order", "_least", own.alias("_open"))
    sums = rows.groupBy(*keys, "_at").applyInArrow(_sum_up(keys, "_at"), f"{key_schema}, _at bigint, _least int, _open {_OPEN_SQL}")
    return _carried(materialise(sums, "open-rows"), keys, block, 1)


def carry_section(rows: DataFrame, keys: Sequence[str] = ("table_number",), index: str = "row_index",
                  label: str = "row_label", is_heading: str = "is_heading",
                  block: int | None = BLOCK) -> DataFrame:
    """Rows under the label of the nearest heading row above; heading rows go."""
    heading = F.when(F.col(is_heading), F.coalesce(F.col(label), F.lit("")))
    out = running_last(rows, keys, index, {"section": heading}, inclusive=True, block=block)
    return (
        out.where(~F.col(is_heading))
        .withColumn("section", F.coalesce("section", F.lit("")))
        .drop(is_heading)
    )
