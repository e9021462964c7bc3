"""Near duplicates among embeddings: random-hyperplane sign hashing in several tables, exact cosine, components.

Equal vectors are one class from the start. Every class gets one bucket per table; buckets are cut into blocks of bounded
size, each pair of blocks is compared by one matrix product, and only links per vector and links to the least come out, no pairs.
"""
from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablelake.llm.common import only, parts
from tablelake.llm.components import components
from tablelake.session import materialise

COSINE = 0.95
#: Wanted chance that a pair at the threshold meets in some table.
RECALL = 0.995
#: Classes that a bucket should hold by chance, and those of a block.
PER_BUCKET, BLOCK = 32, 512
SEED = 20


def tables_for(n: int, cosine: float = COSINE, recall: float = RECALL) -> tuple[int, int]:
    """`(bits, tables)`: bits grow with log2 of the classes; tables make up for what more bits miss."""
    bits = min(30, max(6, math.ceil(math.log2(max(1, n) / PER_BUCKET))))
    meet = (1 - math.acos(cosine) / math.pi) ** bits
    return bits, math.ceil(math.log(1 - recall) / math.log(1 - meet))


def _signs(x: np.ndarray, bits: int, tables: int) -> np.ndarray:
    """Bucket of every vector in each table."""
    planes = np.random.default_rng([SEED, x.shape[1]]).standard_normal((x.shape[1], bits * tables))
    on = (x @ planes > 0).reshape(len(x), tables, bits)
    return (on * (1 << np.arange(bits, dtype=np.int64))).sum(axis=2)


def _hash(bits: int, tables: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths = batch.column(1).value_lengths().to_numpy(zero_copy_only=False)
            for length in np.unique(lengths):  # vectors of other lengths are never similar
                rows = np.flatnonzero(lengths == length)
                part = batch.take(pa.array(rows))
                x = part.column(1).flatten().to_numpy().reshape(len(rows), int(length))
                signs = _signs(x, bits, tables)
                at = np.tile(np.arange(tables, dtype=np.int32), len(rows))
                of = np.repeat(np.arange(len(rows)), tables)
                wide = part.take(pa.array(of))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(at), pa.array(signs.ravel() * 4096 + int(length) % 4096), wide.column(0), wide.column(1), wide.column(2)],
                    ["t", "bucket", "k", "v", "n"])

    return run


def _compare(bits: int, tables: int, cosine: float):
    """Rows come sorted by table, bucket and block pair; runs of one are compared together."""

    def links(run: pa.Table) -> Iterator[pa.RecordBatch]:
        k, n = run.column("k").to_numpy(), run.column("n").to_numpy()
        if len(k) < 2:
            return
        x = run.column("v").combine_chunks().flatten().to_numpy().reshape(len(k), -1)
        t, second = int(run.column("t")[0].as_py()), run.column("second").to_numpy(zero_copy_only=False)
        norms = np.sqrt((x * x).sum(axis=1))
        near = (x @ x.T) / (norms[:, None] * norms[None, :]) >= cosine
        if run.column("i")[0].as_py() != run.column("j")[0].as_py():
            near &= second[:, None] != second[None, :]  # pairs inside one block belong to another task
        np.fill_diagonal(near, False)
        if t and near.any():  # a pair belongs to the first table in which it meets
            signs = _signs(x, bits, tables)[:, :t]
            a, b = np.nonzero(near)
            met = (signs[a] == signs[b]).any(axis=1)
            near[a[met], b[met]] = False
        if not near.any():
            return
        counts = near @ n
        label, linked = np.arange(len(k)), near | np.eye(len(k), dtype=bool)
        while True:
            lower = np.where(linked, label[None, :], len(k)).min(axis=1)
            if (lower == label).all():
                break
            label = lower
        some = counts > 0
        yield pa.RecordBatch.from_arrays([pa.array(k[some]), pa.array(k[label[some]]), pa.array(counts[some].astype(np.int64))], ["a", "b", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            table = pa.concat_tables([held, table]) if held is not None else table
            key = np.stack([table.column(c).to_numpy() for c in ("t", "bucket", "i", "j", "w")], axis=1)
            heads = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]).any(axis=1)])) if len(key) else np.zeros(0, int)
            for a, b in zip(heads, heads[1:]):
                yield from links(table.slice(a, b - a))
            held = table.slice(heads[-1]) if len(heads) else None
        if held is not None:
            yield from links(held)

    return run


def embedding_components(vectors: DataFrame, id_column: str = "vec_id", vector_column: str = "embedding", cosine: float = COSINE) -> DataFrame:
    """Every row with its links and component under cosine >= `cosine`: `vec_id, n_links, component_id, kept`.

    Vectors that are null, empty, zero or hold null or non-finite components link with nothing. Equal vectors
    (repeated rows among them) link with each other. `component_id` is the least id reachable by links, its own included; `kept` tells
    whether it is the row's own. A null id links like others and names no component unless all its ids are null. Vectors of
    different lengths never link. Pairs at the threshold are found with probability RECALL at least; none below it is linked.
    """
    rows = only(vectors, id_column, vector_column).toDF("vec_id", "x")
    rows = rows.select(F.col("vec_id").cast("long"), F.col("x").cast("array<double>").alias("v"))
    bad = F.exists("v", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf"))) | ~F.exists("v", lambda c: c != 0)
    usable = F.col("v").isNotNull() & ~F.coalesce(bad, F.lit(True))
    # Negative zeros are zeros; one scale for each vector keeps squares finite.
    scaled = F.transform("v", lambda c: c / F.array_max(F.transform("v", lambda d: F.abs(d))) + F.lit(0.0))
    rows = materialise(rows.select("vec_id", F.when(usable, F.xxhash64("v")).alias("k"), F.when(usable, scaled).alias("v")), "embedding-rows")
    classes = materialise(rows.where("k IS NOT NULL").groupBy("k").agg(F.first("v").alias("v"), F.count(F.lit(1)).alias("n")), "embedding-classes")
    bits, tables = tables_for(classes.count(), cosine)
    hashed = classes.select("k", "v", "n").mapInArrow(_hash(bits, tables), "t int, bucket long, k long, v array<double>, n long")
    held = materialise(hashed.groupBy("t", "bucket").agg(F.count(F.lit(1)).alias("held")).where("held > 1"), "embedding-buckets")
    blocks = F.ceil(F.col("held") / BLOCK).cast("int")
    dealt = hashed.join(held, ["t", "bucket"]).withColumn("blocks", blocks).withColumn("own", F.pmod(F.xxhash64("k"), F.col("blocks")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select("t", "bucket", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), F.size("v").alias("w"), (F.col("own") > F.col("other")).alias("second"), "k", "v", "n")
    keys = ["t", "bucket", "i", "j", "w"]
    spread = dealt.repartition(max(parts(vectors.sparkSession), 8), *keys).sortWithinPartitions(*keys)
    links = materialise(spread.mapInArrow(_compare(bits, tables, cosine), "a long, b long, n long"), "embedding-links")
    others = links.groupBy("a").agg(F.sum("n").alias("others"))
    label = components(links.select("a", "b"))
    per_class = classes.select("k", "n").join(others, classes["k"] == others["a"], "left").join(label, classes["k"] == label["id"], "left")
    per_class = materialise(per_class.select("k", (F.col("n") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"), F.coalesce("component", "k").alias("c")), "embedding-components")
    placed = materialise(rows.select("vec_id", "k").join(per_class.withColumnRenamed("k", "q"), F.col("k") == F.col("q"), "left"), "embedding-placed")
    least = placed.where("c IS NOT NULL").groupBy("c").agg(F.min("vec_id").alias("least"))
    out = placed.join(least, "c", "left").withColumn("component_id", F.coalesce("least", "vec_id"))
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), "component_id", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)).alias("kept"))
