"""How document filters interact: what each removes, repeats and loses under every order of application.

Four filters look at a text alone; the fifth drops repeats of a text. Repeats are found behind a counting Bloom sketch: every
task counts the hashes of its own texts, sketches merge segment by segment, and a text whose counters are not all above one
is surely unique. Only the others are shuffled, in full, for the least id of each text. Flags then become additive counts of
failure masks, from which all orders follow without another look at the documents.
"""
from __future__ import annotations

from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablelake.llm.common import mix, only
from tablelake.session import materialise

FILTERS = "ABCDE"
REPEAT = 1 << FILTERS.index("E")
#: Counters of one segment; a text's counters all lie in one.
SEGMENT = 1 << 22
#: Counters for each row of the table, and counters that a text raises.
PER_ROW, PROBES = 8, 3
#: A merged sketch up to this size (one bit a counter: some 30 million rows) is broadcast. A larger one stays a table.
MOST_BROADCAST = 32 << 20
#: Hashes that a task counts before it hands on a sketch.
HELD = 1 << 20


def text_failures(text: Column) -> Column:
    """Bits of the filters A to D that a text fails: few words, few distinct words, many capitals, odd characters."""
    words = F.array_remove(F.split(text, r"[\x20\x09-\x0D]+"), "")
    capitals = F.length(text) - F.length(F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", ""))
    failed = (
        F.size(words) < 200,
        F.size(F.array_distinct(words)) * 100 < F.size(words) * 50,
        capitals * 100 > F.length(text) * 3,
        text.rlike(r"[#$%&*|]"),
    )
    return sum((F.when(test, 1 << bit).otherwise(0) for bit, test in enumerate(failed)), F.lit(0))


# ---- counting Bloom sketch ---------------------------------------------------
def segments(rows: int) -> int:
    return max(1, -(-rows * PER_ROW // SEGMENT))


def probes(hashes: np.ndarray, count: int) -> tuple[np.ndarray, np.ndarray]:
    """The segment of each hash, and its counters there."""
    h = mix(hashes.astype(np.int64).view(np.uint64))
    at = np.stack([mix(h + np.uint64(i + 1)) % np.uint64(SEGMENT) for i in range(PROBES)])
    return (h % np.uint64(count)).astype(np.int64), at.astype(np.int64)


SKETCH = "segment int, places binary, counts binary"


def _counted(count: int):
    """Sketches of a task's hashes: by segment, the counters raised and by how much (two means more than one)."""

    def flush(held: list[np.ndarray]) -> pa.RecordBatch:
        hashes, n = np.unique(np.concatenate(held), return_counts=True)
        segment, at = probes(hashes, count)
        cell, where = np.unique((segment * SEGMENT + at).ravel(), return_inverse=True)
        raised = np.minimum(np.bincount(where, np.tile(np.minimum(n, 2), PROBES)), 2).astype(np.uint8)
        cuts = np.append(np.flatnonzero(np.diff(cell // SEGMENT, prepend=-1)), len(cell))
        rows = [(int(cell[a] // SEGMENT), (cell[a:b] % SEGMENT).astype(np.uint32).tobytes(), raised[a:b].tobytes()) for a, b in zip(cuts, cuts[1:])]
        columns = list(zip(*rows))
        return pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int32()), pa.array(columns[1], pa.binary()), pa.array(columns[2], pa.binary())],
                                          ["segment", "places", "counts"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, total = [], 0
        for batch in batches:
            held.append(batch.column(0).to_numpy())
            total += len(held[-1])
            if total >= HELD:
                yield flush(held)
                held, total = [], 0
        if total:
            yield flush(held)

    return run


def _merged(table: pa.Table) -> pa.Table:
    """One segment: the sum of its sketches, kept as one bit per counter that is above one."""
    counters = np.zeros(SEGMENT, np.uint8)
    for row in table.select(["places", "counts"]).to_batches():
        for places, counts in zip(row.column(0), row.column(1)):
            at = np.frombuffer(places.as_py(), np.uint32)
            counters[at] = np.minimum(counters[at] + np.frombuffer(counts.as_py(), np.uint8), 2)
    segment = table.column("segment").slice(0, 1).cast(pa.int32())
    return pa.table({"segment": segment, "bits": pa.array([np.packbits(counters > 1).tobytes()], pa.binary())})


def sketch(hashes: DataFrame, count: int) -> DataFrame:
    """`segment, bits` for a column of hashes (long), one row per segment that any hash falls in."""
    counted = hashes.mapInArrow(_counted(count), SKETCH)
    return materialise(counted.groupBy("segment").applyInArrow(_merged, "segment int, bits binary"), "bloom-sketch")


def _above_one(bits: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Whether all counters of each hash (a column of `at`) are above one."""
    return ((bits[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1).all(axis=0)


def _looked_up(count: int):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        hashes = left.column("h").to_numpy()
        if not len(hashes):
            return pa.table({"h": pa.array([], pa.int64())})
        bits = np.frombuffer(right.column("bits")[0].as_py(), np.uint8)
        return pa.table({"h": pa.array(hashes[_above_one(bits, probes(hashes, count)[1])], pa.int64())})

    return run


def maybe_repeated(rows: DataFrame, count: int, bits: DataFrame) -> DataFrame:
    """Those of `rows` (hash in `h`) that the sketch does not clear as unique.

    A sketch within MOST_BROADCAST goes to every task. Beyond it the distinct hashes meet their segment in a shuffle, and rows are
    kept by a semi-join on the hash.
    """
    if count * SEGMENT // 8 > MOST_BROADCAST:
        segment = F.pandas_udf(lambda h: pd.Series(probes(h.to_numpy(), count)[0].astype(np.int32)), "int")
        asked = rows.select("h").distinct().withColumn("segment", segment("h"))
        found = asked.groupBy("segment").cogroup(bits.groupBy("segment")).applyInArrow(_looked_up(count), "h long")
        return rows.join(found, "h", "left_semi")
    held = {r["segment"]: np.frombuffer(r["bits"], np.uint8) for r in bits.collect()}
    sent = rows.sparkSession.sparkContext.broadcast(held)

    @F.pandas_udf("boolean")
    def seen_again(h: pd.Series) -> pd.Series:
        hashes, out = h.to_numpy(), np.zeros(len(h), bool)
        segment, at = probes(hashes, count)
        for s in np.unique(segment):
            out[segment == s] = _above_one(sent.value[s], at[:, segment == s])
        return pd.Series(out)

    return rows.where(seen_again("h"))


# ---- flags and counts ----------------------------------------------------------
def flags(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """`(rows, repeats)`: every row's `doc_id, part, mask` under filters A to D, and those of `rows` whose text a smaller id has.

    Both are written tables. Texts are compared in full; a 32-byte digest only names the groups, and the job fails
    should one digest stand for two texts.
    """
    docs = only(docs, "doc_id", "text", "lang")
    docs = docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text"), F.coalesce("lang", F.lit("")).alias("part"))
    docs = docs.withColumn("h", F.xxhash64("text"))
    digest = F.unhex(F.sha2(F.encode("text", "UTF-8"), 256)).alias("digest")
    rows = materialise(docs.select("doc_id", "part", text_failures(F.col("text")).alias("mask"), "h", digest), "audit-rows")
    count = segments(rows.count())
    bits = sketch(rows.select("h"), count)
    # A frequent text is one row per task before it is shuffled.
    least = maybe_repeated(docs, count, bits).groupBy("text").agg(F.min("doc_id").alias("doc_id")).select("doc_id", digest)
    named = least.groupBy("digest").agg(F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("texts"))
    first = named.where(F.when(F.col("texts") > 1, F.raise_error(F.lit("two texts share a digest")).cast("boolean")).otherwise(True))
    again = maybe_repeated(rows, count, bits).where("doc_id IS NOT NULL")
    repeats = again.join(first.select("digest", "doc_id"), ["digest", "doc_id"], "left_anti").select("doc_id", "part", "mask")
    return rows.select("doc_id", "part", "mask"), materialise(repeats, "audit-repeats")


def mask_counts(rows: DataFrame, repeats: DataFrame, labels: DataFrame) -> DataFrame:
    """`part, mask, n, good, toxic`: documents by part and exact set of failed filters. A repeat moves from its mask to that with E."""
    one = F.lit(1).cast("long").alias("n")
    moved = repeats.select("doc_id", "part", "mask", (-F.lit(1)).cast("long").alias("n")).union(
        repeats.select("doc_id", "part", (F.col("mask") + REPEAT).alias("mask"), one))
    counts = rows.select("doc_id", "part", "mask", one).union(moved).groupBy("doc_id", "part", "mask").agg(F.sum("n").alias("n"))
    labels = only(labels, "doc_id", "quality", "toxic").where("doc_id IS NOT NULL AND (quality = 1 OR toxic = 1)").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(
        F.max(F.coalesce(F.col("quality") == 1, F.lit(False))).alias("good"), F.max(F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("toxic"))
    among = lambda flag: F.coalesce(F.sum(F.when(F.col(flag), F.col("n"))), F.lit(0)).alias(flag)
    return counts.join(labels, "doc_id", "left").groupBy("part", "mask").agg(F.sum("n").alias("n"), among("good"), among("toxic")).where("n <> 0")


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Effect of the filters on `docs` (`doc_id`, `text`, `lang`) in each of their 120 orders, by part (language).

    Filters: A under 200 words; B less than half of the words distinct; C more than 3 % capitals; D any of `#$%&*|`; E the text
    of a smaller id. Returns, for each part, order and step, `part, filter_order, step, kept, removed, redundant, unique_fails, good_lost,
    toxic_lost, shapley`. A null text is empty, a null language the empty part. A null id is neither smaller nor a repeat, and has no label; rows
    repeating the least id of a text are no repeats of it. A document labelled several times counts as good or toxic if any label says so. Every row
    counts. An empty table gives no rows. Extra columns are not read.
    """
    rows, repeats = flags(docs)
    # At most 32 masks per part from here on.
    cells = materialise(mask_counts(rows, repeats, labels), "audit-cells")
    orders = F.split(F.lit(",".join(map("".join, permutations(FILTERS)))), ",")
    steps = cells.withColumn("filter_order", F.explode(orders)).withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(len(FILTERS)))))
    bit_at = lambda i: F.expr(f"shiftleft(1, instr('{FILTERS}', substring(filter_order, {i}, 1)) - 1)")
    places = range(1, len(FILTERS) + 1)
    own = sum((F.when(F.col("step") == i, bit_at(i)).otherwise(0) for i in places), F.lit(0))
    before = sum((F.when(F.col("step") > i, bit_at(i)).otherwise(0) for i in places), F.lit(0))
    steps = steps.withColumn("own", own).withColumn("before", before)
    fails, gone = F.col("mask").bitwiseAND(F.col("own")) != 0, F.col("mask").bitwiseAND(F.col("before")) != 0
    total = lambda test, what: F.coalesce(F.sum(F.when(test, what)), F.lit(0)).cast("long")
    n, here = F.col("n"), fails & ~gone
    # In 120 / |mask| of the orders a document's failures start with this filter.
    share = F.expr("n * (120 div bit_count(greatest(mask, 1)))")
    return steps.groupBy("part", "filter_order", "step").agg(
        total(~fails & ~gone, n).alias("kept"), total(here, n).alias("removed"), total(fails & gone, n).alias("redundant"),
        total(F.col("mask") == F.col("own"), n).alias("unique_fails"), total(here, F.col("good")).alias("good_lost"),
        total(here, F.col("toxic")).alias("toxic_lost"), total(fails, share).alias("shapley"))
