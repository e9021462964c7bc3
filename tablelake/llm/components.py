"""Distributed connected components: blocks of edges contracted in tasks, then alternating large and small stars."""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablelake.llm.common import gathered
from tablelake.session import materialise


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges of a block of bounded size replaced by one edge from each node to the least node that the block links it to."""
    for batch in gathered(batches):
        a, b = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        ids, ends = np.unique(np.concatenate([a, b]), return_inverse=True)
        x, y = ends[: len(a)], ends[len(a) :]
        label = np.arange(len(ids))
        while len(x):
            least = np.minimum(label[x], label[y])
            np.minimum.at(label, label[x], least)
            np.minimum.at(label, label[y], least)
            while (label[label] != label).any():
                label = label[label]
            apart = label[x] != label[y]
            x, y = x[apart], y[apart]
        moved = np.flatnonzero(label != np.arange(len(ids)))
        yield pa.RecordBatch.from_arrays([pa.array(ids[moved], pa.int64()), pa.array(ids[label[moved]], pa.int64())], ["a", "b"])


#: A key with more rows than this, and more than one in HUBS of all, is a hub.
HUB_ROWS, HUBS = 1000, 256


def beside(many: DataFrame, one: DataFrame, key: str, count: str) -> DataFrame:
    """`many` joined by `key` with `one`, a written table with a row for each key that counts the key's rows in `many` as `count`.

    Fewer than HUBS keys can hold more than one row in HUBS: their rows of `one` are broadcast, so that the rows of a
    hub stay where they are; all other rows meet in a shuffle.
    """
    total, most = one.agg(F.sum(count), F.max(count)).first()
    if not total or most <= (least := max(HUB_ROWS, total // HUBS)):
        return many.join(one, key)
    hubs = F.broadcast(one.where(F.col(count) > least))
    others = many.join(hubs.select(key), key, "left_anti").join(one.where(F.col(count) <= least), key)
    return many.join(hubs, key).unionByName(others)


def _star(pairs: DataFrame, small: bool) -> DataFrame:
    """Links each node's neighbours to the least id around it.

    Large star: of both directions, neighbours above the node move to the least. Small star: the node and its lesser
    neighbours move to the least. The least per node is a partial aggregate, so a hub shrinks before it is shuffled,
    and its edges meet a broadcast row.
    """
    if small:
        # (u, v) with v < u
        links = pairs.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    else:
        links = pairs.select(F.col("a").alias("u"), F.col("b").alias("v")).union(pairs.select(F.col("b"), F.col("a")))
    least = links.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("held")).withColumn("m", F.least("u", "m"))
    least = materialise(least, "component-least")
    met = beside(links, least, "u", "held")
    if small:
        out = met.select(F.col("v").alias("a"), F.col("m").alias("b")).union(least.select("u", "m"))
    else:
        out = met.where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))
    return out.where("a <> b").distinct()


def _settled(edges: DataFrame) -> bool:
    """Whether every node with an edge to a lesser one has no other such edge, and nothing has an edge to it."""
    child = F.struct(F.col("a").alias("id"), F.col("b").alias("to"))
    parent = F.struct(F.col("b").alias("id"), F.lit(None).cast("long").alias("to"))
    ends = edges.select(F.explode(F.array(child, parent)).alias("e")).select("e.*")
    nodes = ends.groupBy("id").agg(F.min("to").alias("lo"), F.max("to").alias("hi"), F.max(F.col("to").isNull()).alias("parent"))
    return nodes.agg(F.count_if(F.expr("lo <> hi OR (lo IS NOT NULL AND parent)"))).first()[0] == 0


def components(edges: DataFrame) -> DataFrame:
    """`id, component` for every id on an edge (`a`, `b`, long); the component is named by its least id.

    Each round is written to the shared folder, so a lost executor costs a re-read. Before a round's stars the edges are
    contracted block by block, which leaves few rounds; they end when only stars are left. Self-loops, repeated
    edges and nulls are allowed; an id that occurs only on a self-loop or beside a null is not returned.
    """
    current = materialise(edges.where("a <> b").select(F.col("a").cast("long"), F.col("b").cast("long")), "component-edges")
    while True:
        current = materialise(current.mapInArrow(_contract, "a long, b long"), "component-stars")
        if _settled(current):
            break
        current = materialise(_star(_star(current, small=False), small=True), "component-edges")
    leaves = current.select(F.col("a").alias("id"), F.col("b").alias("component"))
    return leaves.union(current.select("b", "b")).distinct()
