"""Mixing sources to target weights by Pfair scheduling.

Documents of a source form blocks. Of sources flowing at their weights, a used-up one stopping and the others going on at weights rescaled,
a source's j-th block (from 0) flows between two points of time. It is released at the slot where the first one falls and due by the slot where the
second has passed: floor(j / w) and ceil((j + 1) / w) as long as no source is used up. In every slot the released block of earliest deadline goes,
which meets all deadlines, so that each source is less than one block off the flow at any slot. All of it is exact, in whole numbers and fractions.

The schedule depends on the sources' numbers of blocks alone. One task walks it slot by slot, holds two entries per source, and writes a row per
block; rows of documents meet their block in a join.
"""
from __future__ import annotations

import bisect
import heapq
from collections.abc import Iterator
from fractions import Fraction
from math import lcm

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablelake.llm.common import only, parts
from tablelake.session import materialise

#: Documents of a block.
BLOCK = 32
#: Sources that a call takes unless told otherwise: more of them are often a wrong column.
MOST_SOURCES = 512
#: Power of a source's blocks that it weighs in the query and in the pipeline: small sources come at more than their share, until used up.
TEMPER = 0.5
#: Rows of a source that are numbered in one task, at most and in expectation, and the fewest buckets a source is cut into.
BUCKET_ROWS, LEAST_BUCKETS = 1 << 16, 64
#: Rows of an Arrow batch of the schedule.
BATCH = 8192


def whole_parts(weights: dict, total: int) -> dict:
    """Weights as whole numbers, at least 1, that add up to `total` (largest remainders)."""
    scale = sum(weights.values())
    exact = {s: w * total / scale for s, w in weights.items()}
    out = {s: max(1, int(x)) for s, x in exact.items()}
    order = sorted(exact, key=lambda s: (int(exact[s]) - exact[s], str(s)))
    while (gap := total - sum(out.values())) != 0:
        for s in order if gap > 0 else sorted(out, key=lambda s: (-out[s], str(s))):
            if gap == 0:
                break
            if gap > 0 or out[s] > 1:
                out[s] += 1 if gap > 0 else -1
                gap += -1 if gap > 0 else 1
    return out


def walk(blocks: dict, weights: dict) -> Iterator[tuple]:
    """`(source, j, release, deadline)` by slot: earliest deadline first among the released, as many slots as blocks.

    Weights are whole numbers or fractions above 0. At slot t a source has had floor or ceil of its flow: see the module.
    """
    names = sorted((s for s in blocks if blocks[s]), key=str)
    count = [blocks[s] for s in names]
    exact = [Fraction(weights[s]) for s in names]
    scale = lcm(*(w.denominator for w in exact))
    weight = [int(w * scale) for w in exact]
    # Ends of sources by time, and the flow between them: slots gone by sources used up, and the weight of the others.
    ends = sorted(range(len(names)), key=lambda i: Fraction(count[i], weight[i]))
    nears = [count[i] / weight[i] for i in ends]
    gone, active = [0], [sum(weight)]
    for i in ends:
        gone.append(gone[-1] + count[i])
        active.append(active[-1] - weight[i])

    def at(i: int, j: int) -> tuple[int, int]:
        """Whole slots, and the next whole slot, of the time at which `j` blocks of source `i` have flowed."""
        k = bisect.bisect_left(nears, j / weight[i])
        while k and j * weight[ends[k - 1]] < count[ends[k - 1]] * weight[i]:
            k -= 1
        while k < len(ends) and j * weight[ends[k]] > count[ends[k]] * weight[i]:
            k += 1
        whole, rest = divmod(active[k] * j, weight[i])
        return gone[k] + whole, gone[k] + whole + (rest > 0)

    def upcoming(i: int, j: int, release: int) -> tuple:
        after, deadline = at(i, j + 1)
        return release, deadline, i, j, after

    future = [upcoming(i, 0, 0) for i in range(len(names))]
    heapq.heapify(future)
    ready: list[tuple] = []
    for t in range(sum(count)):
        while future and future[0][0] <= t:
            release, deadline, i, j, after = future[0]
            heapq.heappush(ready, (deadline, i, j, release))
            if j + 1 < count[i]:
                heapq.heapreplace(future, upcoming(i, j + 1, after))
            else:
                heapq.heappop(future)
        deadline, i, j, release = heapq.heappop(ready)
        yield names[i], j, release, deadline


def frame(counts: dict) -> list[tuple]:
    """`walk` of sources that weigh as many blocks as they have."""
    return list(walk(counts, counts))


def target_weights(blocks: dict, weights: dict | float | None) -> dict:
    """Exact weights of all sources: see `schedule`."""
    if weights is None:
        return {s: Fraction(n) for s, n in blocks.items()}
    if not isinstance(weights, dict):
        return {s: Fraction(max(1, round(1024 * n**weights)), 1024) for s, n in blocks.items()}
    named = {s: Fraction(w) for s, w in weights.items() if w > 0}
    return {s: named.get(s) or min(named.values(), default=Fraction(1)) / 1000 for s in blocks}


def _number(docs: DataFrame, source: Column, name: str, total: int) -> DataFrame:
    """`docs` (`total` rows) with `name`: a gapless number from 0 of each row among those of its source.

    A source is cut into buckets by hash; rows are numbered within a bucket and buckets start where the ones before end,
    so a source of any size is no task of its own. Their number follows from the rows alone: no setting changes the mix.
    """
    bucket = F.pmod(F.xxhash64("__h"), F.lit(max(LEAST_BUCKETS, 1 << (total // BUCKET_ROWS).bit_length())))
    keyed = docs.withColumns({"__s": source, "__b": bucket})
    counts = materialise(keyed.groupBy("__s", "__b").agg(F.count(F.lit(1)).alias("n")), "mixing-buckets")
    before = Window.partitionBy("__s").orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(F.col("__s").alias("__s2"), F.col("__b").alias("__b2"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("__start"))
    place = F.row_number().over(Window.partitionBy("__s", "__b").orderBy("__h")) - 1
    return keyed.withColumn("__place", place).join(starts, (F.col("__s") == F.col("__s2")) & (F.col("__b") == F.col("__b2"))).withColumn(name, F.col("__start") + F.col("__place")).drop("__b", "__b2", "__s2", "__start", "__place")


SLOTS = "p_source string, p_block long, p_slot long, p_release long, p_deadline long"


def _slots(sources: DataFrame, weights: dict | float | None) -> DataFrame:
    """A row per block of `sources` (`s`, `n` rows): where it comes in the mix."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks = {s: -(-n // BLOCK) for batch in batches for s, n in zip(*(c.to_pylist() for c in batch.columns))}
        out: list[tuple] = []

        def packed() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64() if k else pa.string()) for k, c in enumerate(zip(*out))],
                                              ["p_source", "p_block", "p_slot", "p_release", "p_deadline"])

        for slot, (s, j, release, deadline) in enumerate(walk(blocks, target_weights(blocks, weights)) if blocks else ()):
            out.append((s, j, slot, release, deadline))
            if len(out) == BATCH:
                yield packed()
                out = []
        if out:
            yield packed()

    return sources.coalesce(1).mapInArrow(run, SLOTS)


def _source(docs: DataFrame) -> Column:
    return F.coalesce(docs["source"].cast("string"), F.lit(""))


def schedule(docs: DataFrame, weights: dict[str, float] | float | None = None, most_sources: int | None = MOST_SOURCES) -> DataFrame:
    """Where every row of `docs` (`doc_id`, `text`, `source`) comes in the mix.

    Returns `doc_id, source, block` (number in its source), `slot` (of the block in the mix, gapless from 0), `release` and `deadline` (the slots
    between which Pfair puts it), `position` (of the row, ascending with slot). Without `weights` (source -> weight) a source weighs
    as many blocks as it has, so that every stretch of the mix has the table's own shares; with a number it weighs its blocks to that power, in
    1024ths (tempered shares; 0 for equal ones). Sources not named in `weights` weigh a thousandth of the least. Every row occurs once: when a source is
    used up the others go on. A null source is the empty name. Rows of a source come in hashed order; repeated rows
    stay. More than `most_sources` sources are refused; None takes any number.
    """
    rows = only(docs, "doc_id", "text", "source")
    rows = rows.select("doc_id", _source(rows).alias("source"), F.xxhash64("doc_id", "text").alias("__h"))
    rows = materialise(rows, "mixing-rows")
    placed = _place(rows, F.col("source"), weights, most_sources)
    return placed.select("doc_id", "source", F.col("__block").alias("block"), F.col("__slot").alias("slot"), F.col("__release").alias("release"),
                         F.col("__deadline").alias("deadline"), (F.col("__slot") * BLOCK + F.col("__n") % BLOCK).alias("position"))


def _place(rows: DataFrame, source: Column, weights: dict[str, float] | float | None, most_sources: int | None) -> DataFrame:
    sources = materialise(rows.groupBy(source.alias("s")).agg(F.count(F.lit(1)).alias("n")), "mixing-sources")
    n, total = sources.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    if most_sources is not None and n > most_sources:
        raise ValueError(f"{n} sources; mix at most {most_sources}, or map them to groups first")
    slots = materialise(_slots(sources, weights), "mixing-slots")
    numbered = _number(rows, source, "__n", total).withColumn("__block", F.floor(F.col("__n") / BLOCK))
    met = numbered.join(slots, (F.col("__s") == F.col("p_source")) & (F.col("__block") == F.col("p_block")))
    out = met.withColumnsRenamed({"p_slot": "__slot", "p_release": "__release", "p_deadline": "__deadline"})
    return out.drop("p_source", "p_block", "__s")


def mix(docs: DataFrame, weights: dict[str, float] | float | None = None, position: str | None = None, most_sources: int | None = MOST_SOURCES) -> DataFrame:
    """`docs` in the order of the mix: range-partitioned by position and sorted, all rows and columns as they were.

    With `position` a column of that name, which `docs` must not have, tells the place in the mix; equal rows share theirs.
    """
    if position in docs.columns:
        raise ValueError(f"{position} is a column already")
    # The user's row travels as one column, so that no name of its own meets one of these.
    keyed = docs.select(F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("row"), F.xxhash64(docs["doc_id"], docs["text"]).alias("__h"), _source(docs).alias("__src"))
    # Only ids go through the numbering; texts are dealt out once, by position.
    rows = materialise(keyed.select("__h", "__src").distinct(), "mixing-rows")  # equal rows share a place
    placed = _place(rows, F.col("__src"), weights, most_sources).select(F.col("__h").alias("__h2"), F.col("__src").alias("__src2"), "__slot", F.col("__n").alias("__in"))
    met = keyed.join(placed, (F.col("__h") == F.col("__h2")) & (F.col("__src") == F.col("__src2")))
    ordered = met.select("row", (F.col("__slot") * BLOCK + F.col("__in") % BLOCK).alias("at"))
    ordered = ordered.repartitionByRange(parts(docs.sparkSession), "at").sortWithinPartitions("at")
    return ordered.select("row.*", *[F.col("at").alias(position)] if position else [])
