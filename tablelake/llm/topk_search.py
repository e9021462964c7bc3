"""Exact top-k search by inner product: the three-phase uniform threshold over vertical lists.

Vectors are cut into slices of components, and each slice of each block of rows is a list of local scores (partial inner
products). Phase 1 gathers the k best local entries of every list and scores those rows fully; the k-th best full score of a
query is a safe cutoff. Phase 2 broadcasts the cutoffs: a row that reaches the cutoff has a local score of at least
cutoff / slices in some slice, so the entries from there on are sufficient. Phase 3 resolves what the entries don't hold, the
scores of their rows in the other slices, and ranks. Queries are taken in blocks of bounded size.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tablelake.llm.common import only, parts
from tablelake.session import materialise

SLICES = 2
#: Queries whose slices go to every task at once: bounds the broadcast at this many rows of components.
QUERY_BLOCK = 4096
#: Rows scored at a time in a task.
ROW_BLOCK = 1024


def usable(vectors: DataFrame, id_column: str, vector_column: str, scale: int = 256) -> DataFrame:
    """`id, v`: components as floor(scale * x). Rows with a null id, a null vector, or null or non-finite components are out.

    Rows that repeat an id all stay, each with its vector. An empty vector takes part with score 0.
    """
    rows = only(vectors, id_column, vector_column).toDF("id", "x").select("id", F.col("x").cast("array<double>").alias("x"))
    bad = F.exists("x", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    rows = rows.where(F.col("id").isNotNull() & F.col("x").isNotNull()).where(~bad)
    return rows.select(F.col("id").cast("long"), F.transform("x", lambda v: F.floor(v * scale)).alias("v"))


def _matrix(column) -> np.ndarray:
    """A list column as rows of whole numbers; shorter rows end in zeros."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    lengths = column.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    flat = column.flatten().to_numpy(zero_copy_only=False)
    out = np.zeros((len(lengths), max(1, int(lengths.max(initial=0)))), np.int64)
    out[np.repeat(np.arange(len(lengths)), lengths), np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths)] = flat
    return out


def _product(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Exact integer products: by double precision where no sum can reach 2^53, else in 64-bit integers."""
    width = max(q.shape[1], x.shape[1])
    q, x = (np.pad(m, ((0, 0), (0, width - m.shape[1]))) for m in (q, x))
    if float(np.abs(q).max(initial=0)) * float(np.abs(x).max(initial=0)) * width < 2**53:
        return (q.astype(np.float64) @ x.astype(np.float64).T).astype(np.int64)
    return q @ x.T


def _slices(v: np.ndarray, slices: int) -> list[np.ndarray]:
    edges = np.linspace(0, v.shape[1], slices + 1).astype(int)
    return [v[:, a:b] for a, b in zip(edges, edges[1:])]


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    for batch in batches:
        for low in range(0, batch.num_rows, ROW_BLOCK):
            part = batch.slice(low, ROW_BLOCK)
            yield part.column(0).to_numpy(), _matrix(part.column(1))


def _best(score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Columns of the k best of every row, ties to smaller ids; ids ascend."""
    if score.shape[1] <= k:
        return np.tile(np.arange(score.shape[1]), (len(score), 1))
    return np.argsort(-score, axis=1, kind="stable")[:, :k]


def _phase1(queries: list, k: int, slices: int):
    """Per task: rows among the k best of any local list of a query, with their full scores; the best k of them."""
    qid, q = queries

    def run(batches):
        top: list[tuple[np.ndarray, np.ndarray]] = [(np.zeros(0, np.int64), np.zeros(0, np.int64))] * len(qid)
        for ids, x in _blocks(batches):
            order = np.argsort(ids, kind="stable")
            ids, x = ids[order], x[order]
            width = max(q.shape[1], x.shape[1])
            pieces = [np.pad(m, ((0, 0), (0, width - m.shape[1]))) for m in (q, x)]
            local = [_product(a, b) for a, b in zip(_slices(pieces[0], slices), _slices(pieces[1], slices))]
            full = sum(local)
            own = qid[:, None] == ids[None, :]
            chosen = np.concatenate([_best(np.where(own, np.iinfo(np.int64).min // 2, s), ids, k) for s in local], axis=1)
            for i in range(len(qid)):
                cols = np.unique(chosen[i])
                cols = cols[~own[i, cols]]
                who, what = np.concatenate([top[i][0], ids[cols]]), np.concatenate([top[i][1], full[i, cols]])
                keep = np.lexsort((who, -what))[:k]
                top[i] = (who[keep], what[keep])
        n = [len(t[0]) for t in top]
        if sum(n):
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(qid, n)), pa.array(np.concatenate([t[0] for t in top])), pa.array(np.concatenate([t[1] for t in top]))], ["query_id", "id", "score"])

    return run


def _phase2(queries: list, cutoffs: np.ndarray, slices: int, width: int):
    """Entries of each local list from cutoff / slices on; a list is one slice of a row block."""
    qid, q = queries

    def run(batches):
        for ids, x in _blocks(batches):
            wide = max(width, q.shape[1], x.shape[1])
            pieces = [np.pad(m, ((0, 0), (0, wide - m.shape[1]))) for m in (q, x)]
            hit = np.zeros((len(qid), len(ids)), bool)
            local = []
            for a, b in zip(_slices(pieces[0], slices), _slices(pieces[1], slices)):
                local.append(_product(a, b))
                hit |= local[-1] * slices >= cutoffs[:, None]
            hit &= qid[:, None] != ids[None, :]
            rows, cols = np.nonzero(hit)
            # Phase 3 for these entries: the other slices' scores are looked up where the row is, and the sum decides.
            score = sum(s[rows, cols] for s in local)
            enough = score >= cutoffs[rows]
            if enough.any():
                yield pa.RecordBatch.from_arrays([pa.array(qid[rows[enough]]), pa.array(ids[cols[enough]]), pa.array(score[enough])], ["query_id", "id", "score"])

    return run


ENTRY = "query_id long, id long, score long"


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 5, slices: int = SLICES) -> DataFrame:
    """`query_id, rank, vec_id, score`: each query's k highest integer inner products over all rows but its own.

    `vectors` and `queries` hold `id, v` with whole-number vectors (see `usable`). Ties go to the smaller id; a query with
    fewer other rows gets all of them. Rows that repeat an id are ranked each, so an id can come at several ranks, and none of them is a match of a query of that id.
    Queries that repeat an id share its k ranks, over all pairs of one of them and another row. Queries are worked off in blocks of QUERY_BLOCK, each
    a scan of the rows. Scores are exact while they fit 64 bits.
    """
    spark = vectors.sparkSession
    vectors = materialise(vectors.select("id", "v").repartition(parts(spark)), "topk-rows")
    queries = materialise(queries.select(F.monotonically_increasing_id().alias("row"), F.col("id").alias("qid"), "v"), "topk-queries")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))
    out, last = None, None
    while True:
        ahead = queries if last is None else queries.where(F.col("row") > last)
        block = ahead.orderBy("row").limit(QUERY_BLOCK).toArrow()  # bounded: one block of queries
        if not block.num_rows:
            break
        own = [block.column("qid").to_numpy(), _matrix(block.column("v"))]
        last = int(block.column("row").to_numpy().max())
        gathered = vectors.mapInArrow(_phase1(own, k, slices), ENTRY).withColumn("rank", rank).where(F.col("rank") <= k)
        # One row per query of the block.
        known = {r["query_id"]: r["low"] for r in gathered.groupBy("query_id").agg(F.min("score").alias("low"), F.count(F.lit(1)).alias("n")).where(F.col("n") >= k).collect()}
        lowest = np.iinfo(np.int64).min // (4 * slices)
        cutoffs = np.array([known.get(int(i), lowest) for i in own[0]], np.int64)
        entries = vectors.mapInArrow(_phase2(own, cutoffs, slices, own[1].shape[1]), ENTRY)
        found = materialise(entries.withColumn("rank", rank).where(F.col("rank") <= k).drop("rank"), "topk-found")
        out = found if out is None else out.unionByName(found)
    if out is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    # Queries of one id may have been in several blocks.
    return out.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias("vec_id"), "score")
