"""Running values along an ordered group without holding the group in one task."""
from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

BLOCK = 4096


def running_last(df: DataFrame, keys: Sequence[str], index: str, values: Mapping[str, Column],
                 inclusive: bool, block: int | None = BLOCK, levels: int = 2) -> DataFrame:
    """Adds, per name in `values`, the last non-NULL value so far within `keys`.

    `index` numbers the rows of a group. Rows are windowed in blocks of
    `block` consecutive index values, so a group of any size spreads over many
    tasks; what earlier blocks end with is carried in through a table with one
    row per block, which is itself scanned in blocks while `levels` last.
    Pass `block=None` where groups are known to be small.
    """
    end = Window.currentRow if inclusive else -1
    if block is None or levels == 0:
        frame = Window.partitionBy(*keys).orderBy(index).rowsBetween(Window.unboundedPreceding, end)
        return df.withColumns({n: F.last(v, ignorenulls=True).over(frame) for n, v in values.items()})

    at = "_block"
    while at in df.columns:
        at += "_"
    blocked = df.withColumn(at, F.floor(F.col(index) / block))
    frame = Window.partitionBy(*keys, at).orderBy(index).rowsBetween(Window.unboundedPreceding, end)
    local = blocked.withColumns({n: F.last(v, ignorenulls=True).over(frame) for n, v in values.items()})

    ends = blocked.groupBy(*keys, at).agg(
        *[F.max_by(v, F.when(v.isNotNull(), F.col(index))).alias(n) for n, v in values.items()])
    carried = running_last(ends, keys, at, {f"_in_{n}": F.col(n) for n in values},
                           inclusive=False, block=block, levels=levels - 1)
    carried = carried.select(*keys, at, *[f"_in_{n}" for n in values])
    out = local.join(carried, [*keys, at], "left")
    out = out.withColumns({n: F.coalesce(F.col(n), F.col(f"_in_{n}")) for n in values})
    return out.drop(at, *[f"_in_{n}" for n in values])
