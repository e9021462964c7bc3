"""Sharding by fixed virtual slots.

Rows are hashed into a fixed number of virtual slots, bytes are summed per slot, and a versioned map assigns slots to
shards. The map is a small table (one row per slot); rebalancing and growing edit it and never rehash rows.
"""
from __future__ import annotations

import heapq

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tablelake.llm.common import byte_size, only
from tablelake.session import materialise

SLOTS = 8192
#: Bytes that a row counts for besides its text.
ROW_BYTES = 16


def virtual_slot(doc_id: Column, text_crc: Column, slots: int = SLOTS) -> Column:
    """Slot of a row. The text's checksum spreads rows that share an id or have none; equal rows share a slot."""
    return F.pmod(F.xxhash64(doc_id, text_crc), F.lit(slots)).cast("int")


def sized(docs: DataFrame, slots: int = SLOTS) -> DataFrame:
    """`doc_id, size, text_crc32, vslot` of every row, written once: the text is read a single time."""
    docs = only(docs, "doc_id", "text")
    crc = F.crc32(F.encode("text", "UTF-8"))
    rows = docs.select("doc_id", (byte_size(F.col("text")) + ROW_BYTES).alias("size"), crc.alias("text_crc32"))
    return materialise(rows.withColumn("vslot", virtual_slot(F.col("doc_id"), F.col("text_crc32"), slots)), "sharding-rows")


def slot_bytes(rows: DataFrame) -> dict[int, tuple[int, int]]:
    """Bytes and rows per slot: at most one entry per slot, whatever the input."""
    got = rows.groupBy("vslot").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("n")).collect()
    return {r["vslot"]: (r["bytes"], r["n"]) for r in got}


def first_map(weights: dict[int, int], shards: int, slots: int = SLOTS) -> list[int]:
    """Version 1 of a map, slot -> shard: slots by falling bytes, each to the shard with least bytes so far."""
    load = [(0, shard) for shard in range(shards)]
    out = [0] * slots
    for slot in sorted(range(slots), key=lambda s: (-weights.get(s, 0), s)):
        got, shard = heapq.heappop(load)
        out[slot] = shard
        heapq.heappush(load, (got + weights.get(slot, 0), shard))
    return out


def rebalanced(assigned: list[int], weights: dict[int, int], shards: int) -> list[int]:
    """The map's next version for new slot bytes or more shards.

    Slots move from the heaviest shard to the lightest as long as a move narrows the gap; all others stay. With
    one shard more, slots move only into it if the map was balanced before.
    """
    out, load = list(assigned), [0] * shards
    held: dict[int, list[tuple[int, int]]] = {s: [] for s in range(shards)}
    for slot, shard in enumerate(out):
        load[shard] += weights.get(slot, 0)
        held[shard].append((weights.get(slot, 0), slot))
    while True:
        heavy, light = max(range(shards), key=lambda s: (load[s], -s)), min(range(shards), key=lambda s: (load[s], s))
        gap = load[heavy] - load[light]
        best = max((x for x in held[heavy] if 0 < x[0] < gap), key=lambda x: (min(x[0], gap - x[0]), -x[1]), default=None)
        if best is None:
            return out
        held[heavy].remove(best)
        held[light].append(best)
        out[best[1]] = light
        load[heavy] -= best[0]
        load[light] += best[0]


def map_table(spark: SparkSession, assigned: list[int], counts: dict[int, int], version: int) -> DataFrame:
    """`vslot, shard, start, version`: start is the number of rows of the shard in earlier slots."""
    at: dict[int, int] = {}
    rows = []
    for slot, shard in enumerate(assigned):
        rows.append((slot, shard, at.get(shard, 0), version))
        at[shard] = at.get(shard, 0) + counts.get(slot, 0)
    return materialise(spark.createDataFrame(rows, "vslot int, shard int, start long, version int").coalesce(1), "shard-map")


def shard(docs: DataFrame, shards: int, slots: int = SLOTS) -> DataFrame:
    """Every row of `docs` (`doc_id`, `text`) with its shard under the law `bytes`.

    Returns `doc_id, size, text_crc32, law, shard, slot, grown_shard, vslot, map_version`. `size` is the UTF-8 bytes of the text
    plus 16; `slot` is the row's place in its shard, gapless from 0; `grown_shard` is null under this law. A null text has
    no bytes and a null checksum; null ids are hashed like others. Repeated rows all stay, in one virtual slot. An empty table gives
    no rows. The map has one row per virtual slot, so its broadcast does not grow with the data; a slot's rows are
    numbered in a window that holds 1/slots of the rows.
    """
    rows = sized(docs, slots)
    sums = slot_bytes(rows)
    assigned = first_map({s: b for s, (b, _) in sums.items()}, shards, slots)
    table = map_table(docs.sparkSession, assigned, {s: n for s, (_, n) in sums.items()}, version=1)
    place = F.row_number().over(Window.partitionBy("vslot").orderBy("doc_id", "text_crc32", "size")) - 1
    return rows.withColumn("place", place).join(F.broadcast(table), "vslot").select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("start") + F.col("place")).cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"), "vslot", F.col("version").alias("map_version"))
