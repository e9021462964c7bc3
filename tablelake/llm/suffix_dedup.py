"""Removing long byte strings that a corpus holds more than once, with a logarithmic family of suffix arrays.

Suffixes are sampled by content: of every LENGTH bytes, the suffix whose first GRAM bytes hash least stands for the string, so that
equal strings choose the same suffix. A batch's suffix array holds its sampled suffixes in the order of the hashes of their first
GRAM bytes, then of all bytes that the strings they stand for reach over (their surroundings). A new batch is merge-scanned
against each level of the index, and levels of equal size merge, so an entry is rewritten a logarithmic number of times.

Suffixes with equal surroundings settle all their strings at once. Where only the first GRAM bytes are shared, the surroundings are
fetched, sorted as suffixes to the right and to the left, and compared by their common prefixes, byte for byte.
"""
from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablelake.llm.common import byte_size, from_planes, mix, only, pack_sorted, planes, text_bytes, unpack_sorted
from tablelake.llm.packing import squeeze, unsqueeze
from tablelake.session import materialise

#: Bytes of a repeated string, and the first bytes by which suffixes are sampled.
LENGTH, GRAM = 400, 160
#: Strings that a sampled suffix can stand for: it begins at most so many bytes, less one, after them.
REACH = LENGTH - GRAM + 1
#: Text bytes of a block (one longer text is a block of its own), and string starts looked at in one step.
BLOCK_BYTES, STEP = 4 << 20, 1 << 18
#: Sampled suffixes of a bucket, a range of hashes, in expectation; blocks whose suffixes meet a bucket's answer in one task.
BUCKET, RUNS = 250_000, 1024
#: Bits of the hash of the first bytes. It only finds candidates; the surroundings' hash has 64 more.
HASH_BITS = 48
#: Batches that a whole table is dealt into.
BATCHES = 4
#: Different surroundings of one hash that are compared in one task. Beyond it, strings are counted one by one in a shuffle.
MOST = 50_000
#: Bytes of surroundings compared in one task, in expectation.
COMPARED = 4 << 20
_TABLE = mix(np.arange(1, 257, dtype=np.uint64))
_BASE = np.uint64(0xD1342543DE82EF95)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))


# ---- sampled suffixes of a block -----------------------------------------------------
def _powers(base: np.uint64, n: int) -> np.ndarray:
    return np.cumprod(np.concatenate([[np.uint64(1)], np.full(n - 1, base, np.uint64)]), dtype=np.uint64)


class Hashes:
    """Hashes of any stretch of some bytes, from running sums."""

    up = down = np.ones(1, np.uint64)

    def __init__(self, data: np.ndarray):
        if len(Hashes.up) <= len(data):
            Hashes.up, Hashes.down = _powers(_BASE, len(data) + 1), _powers(_INVERSE, len(data) + 1)
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_TABLE[data] * Hashes.up[: len(data)], out=self.sums[1:])

    def of(self, begin, end) -> np.ndarray:
        return mix((self.sums[end] - self.sums[begin]) * Hashes.down[begin])

    def every(self, n: int) -> np.ndarray:
        """Hashes of all stretches of n bytes."""
        return mix((self.sums[n:] - self.sums[:-n]) * Hashes.down[: len(self.sums) - n])


def _least(values: np.ndarray, width: int) -> np.ndarray:
    """The least of every `width` values in a row: prefix and suffix minima of stretches of that width."""
    n = len(values) - width + 1
    padded = np.full(-(-len(values) // width) * width, np.iinfo(np.uint64).max, np.uint64)
    padded[: len(values)] = values
    rows = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(rows, axis=1).ravel()
    behind = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[:n], ahead[width - 1 : width - 1 + n])


def sampled(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sampled suffixes of texts that lie end to end: rows of `hash, surroundings, place, first, last` (uint64).

    A suffix at `place` stands for the strings that begin `last` to `first` bytes before it (`last <= first`). Of suffixes with equal
    hashes the leftmost counts, so the choice depends on a string's bytes alone.
    """
    starts = np.zeros(len(data) + 1, np.int32)
    long = np.diff(offsets) >= LENGTH
    np.add.at(starts, offsets[:-1][long], 1)
    np.add.at(starts, offsets[1:][long] - LENGTH + 1, -1)
    valid = np.cumsum(starts[:-1], dtype=np.int32) > 0
    found = []
    for a in range(0, max(0, len(data) - LENGTH + 1), STEP):
        b = min(a + STEP, len(data) - LENGTH + 1)
        ok = valid[a:b]
        if not ok.any():
            continue
        hashes = Hashes(data[a : b + LENGTH - 1])
        every = hashes.every(GRAM)
        low = np.uint64((1 << (STEP.bit_length() + 1)) - 1)
        chosen = (_least(every & ~low | np.arange(len(every), dtype=np.uint64), REACH) & low).astype(np.int64)
        new = ok.copy()
        new[1:] &= (chosen[1:] != chosen[:-1]) | ~ok[:-1]
        end = ok.copy()
        end[:-1] &= (chosen[1:] != chosen[:-1]) | ~ok[1:]
        begin, end = np.flatnonzero(new), np.flatnonzero(end)
        place = chosen[begin]
        first, last = (place - begin).astype(np.uint64), (place - end).astype(np.uint64)
        around = mix(hashes.of(begin, end + LENGTH) + first * np.uint64(LENGTH) + last)
        # Chosen hashes are small ones; mixed again they spread over all buckets.
        found.append(np.stack([mix(every[place]) >> np.uint64(64 - HASH_BITS), around, (place + a).astype(np.uint64), first, last], axis=1))
    return np.concatenate(found) if found else np.zeros((0, 5), np.uint64)


BLOCK = "block long, ids array<long>, offsets binary, data binary, bucket int, keys binary, body binary"
BLOCK_ARROW = pa.schema([("block", pa.int64()), ("ids", pa.list_(pa.int64())), ("offsets", pa.binary()), ("data", pa.binary()),
                         ("bucket", pa.int32()), ("keys", pa.binary()), ("body", pa.binary())])


def _table(rows: list[tuple], schema: pa.Schema) -> pa.Table:
    columns = list(zip(*rows)) or [()] * len(schema)
    return pa.table([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)


def pack_keys(hashes: np.ndarray, around: np.ndarray, *more: np.ndarray) -> bytes:
    return squeeze(pack_sorted(hashes), around.tobytes(), *[planes(m) for m in more])


def unpack_keys(packed: bytes) -> tuple[np.ndarray, ...]:
    hashes, around, *more = unsqueeze(packed)
    return unpack_sorted(hashes), np.frombuffer(around, np.uint64), *[from_planes(m, np.int64) for m in more]


def _packed_block(block: int, ids: list, texts: list, buckets: int) -> pa.Table:
    """One row with the texts of a block, and one per bucket with its sampled suffixes there."""
    data, offsets = text_bytes(pa.array(texts, pa.large_string()))
    rows = [(block, ids, planes(np.diff(offsets)), squeeze(data.tobytes()), None, None, None)]
    hashes, around, place, first, last = sampled(data, offsets).T
    order = np.lexsort((around, hashes))
    bucket = ((hashes[order] * np.uint64(buckets)) >> np.uint64(HASH_BITS)).astype(np.int64)
    cuts = np.append(np.flatnonzero(np.diff(bucket, prepend=-1)), len(bucket))
    for a, b in zip(cuts, cuts[1:]):
        part = order[a:b]
        body = squeeze(planes(place[part]), planes(first[part].astype(np.uint16)), planes(last[part].astype(np.uint16)))
        rows.append((block, None, None, None, int(bucket[a]), pack_keys(hashes[part], around[part]), body))
    return _table(rows, BLOCK_ARROW)


def _blocks(buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        ids, texts, size = [], [], 0
        for batch in batches:
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ids.append(i)
                texts.append(text)
                size += 64 + 2 * len(text or "")
                if size >= 2 * BLOCK_BYTES:
                    yield from _packed_block(number, ids, texts, buckets).to_batches()
                    ids, texts, size, number = [], [], 0, number + 1
        if ids:
            yield from _packed_block(number, ids, texts, buckets).to_batches()

    return run


# ---- suffix arrays, levels, merge scans --------------------------------------------------
ARRAY = "bucket int, entries binary"
ARRAY_ARROW = pa.schema([("bucket", pa.int32()), ("entries", pa.binary())])


def _sum_up(parts: list[tuple[np.ndarray, ...]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted distinct entries `hash, surroundings, count` of several sorted runs."""
    hashes, around, count = (np.concatenate(c) for c in zip(*parts))
    order = np.lexsort((around, hashes))
    hashes, around, count = hashes[order], around[order], count[order]
    new = np.ones(len(hashes), bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (around[1:] != around[:-1])
    firsts = np.flatnonzero(new)
    return hashes[firsts], around[firsts], np.add.reduceat(count, firsts) if len(firsts) else count


def _array(table: pa.Table) -> pa.Table:
    """A bucket of a batch's suffix array from its blocks' runs."""
    parts = [unpack_keys(k.as_py()) for k in table.column("keys")]
    entries = _sum_up([(h, a, np.ones(len(h), np.int64)) for h, a in parts])
    return _table([(table.column("bucket")[0].as_py(), pack_keys(*entries))], ARRAY_ARROW)


def _merge(table: pa.Table) -> pa.Table:
    return _table([(table.column("bucket")[0].as_py(), pack_keys(*_sum_up([unpack_keys(e.as_py()) for e in table.column("entries")])))], ARRAY_ARROW)


def _in_both(left: pa.Table, right: pa.Table) -> pa.Table:
    """Merge scan of a bucket of two suffix arrays: hashes that both hold."""
    if not (left.num_rows and right.num_rows):
        return _table([], ARRAY_ARROW)
    x, y = (unpack_keys(t.column("entries")[0].as_py())[0] for t in (left, right))
    both = np.intersect1d(x, y)
    return _table([(left.column("bucket")[0].as_py(), pack_sorted(both))], ARRAY_ARROW)


def _twice(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Hashes that one suffix array holds more than once."""
    for batch in batches:
        rows = []
        for bucket, entries in zip(batch.column(0), batch.column(1)):
            hashes, _, count = unpack_keys(entries.as_py())
            same = np.zeros(len(hashes), bool)
            same[1:] = hashes[1:] == hashes[:-1]
            rows.append((bucket.as_py(), pack_sorted(np.unique(hashes[same | (count > 1)]))))
        yield from _table(rows, ARRAY_ARROW).to_batches()


@dataclass
class Index:
    """A family of suffix arrays by size: `levels` holds `(batches, table)`, sizes falling. Tables lie in the shared folder."""

    levels: list[tuple[int, DataFrame]] = field(default_factory=list)

    def append(self, runs: DataFrame) -> DataFrame:
        """Adds a batch (`bucket, keys` of its blocks) and returns the hashes it shares with the index or holds twice.

        The result is `bucket, entries`, a sorted array per bucket and level. Levels of equal size merge until all sizes differ.
        """
        batch = materialise(runs.groupBy("bucket").applyInArrow(_array, ARRAY), "suffix-array")
        found = batch.mapInArrow(_twice, ARRAY)
        for _, level in self.levels:
            found = found.union(batch.groupBy("bucket").cogroup(level.groupBy("bucket")).applyInArrow(_in_both, ARRAY))
        size = 1
        while self.levels and self.levels[-1][0] == size:
            _, level = self.levels.pop()
            batch, size = materialise(batch.union(level).groupBy("bucket").applyInArrow(_merge, ARRAY), "suffix-level"), 2 * size
        self.levels.append((size, batch))
        return found

    def entries(self) -> DataFrame:
        """`bucket, entries` of all levels."""
        out = self.levels[0][1]
        for _, level in self.levels[1:]:
            out = out.union(level)
        return out


# ---- repeated suffixes ---------------------------------------------------------------
def _shared(left: pa.Table, right: pa.Table) -> pa.Table:
    """Entries of a bucket over all levels whose hash a merge scan found: `hash, surroundings, count, entries of that hash`."""
    if not (left.num_rows and right.num_rows):
        return _table([], ARRAY_ARROW)
    hashes, around, count = _sum_up([unpack_keys(e.as_py()) for e in left.column("entries")])
    found = np.unique(np.concatenate([unpack_sorted(e.as_py()) for e in right.column("entries")]))
    kept = np.isin(hashes, found)
    hashes, around, count = hashes[kept], around[kept], count[kept]
    _, where, many = np.unique(hashes, return_inverse=True, return_counts=True)
    return _table([(left.column("bucket")[0].as_py(), pack_keys(hashes, around, count, many[where].astype(np.int64)))], ARRAY_ARROW)


MARKS = "block long, spans binary, hash long, around long, alone boolean, hot boolean, place long, first int, last int"
MARKS_ARROW = pa.schema([("block", pa.int64()), ("spans", pa.binary()), ("hash", pa.int64()), ("around", pa.int64()), ("alone", pa.bool_()), ("hot", pa.bool_()),
                         ("place", pa.int64()), ("first", pa.int32()), ("last", pa.int32())])


def pack_spans(begin: np.ndarray, end: np.ndarray) -> bytes:
    order = np.argsort(begin, kind="stable")
    return squeeze(pack_sorted(begin[order].astype(np.uint64)), planes((end - begin)[order].astype(np.int64)))


def unpack_spans(packed: bytes) -> tuple[np.ndarray, np.ndarray]:
    begin, size = unsqueeze(packed)
    begin = unpack_sorted(begin).astype(np.int64)
    return begin, begin + from_planes(size, np.int64)


def _marks(left: pa.Table, right: pa.Table) -> pa.Table:
    """Blocks' runs of one bucket with its shared entries: spans of strings settled by their surroundings, and suffixes to compare.

    Of suffixes with equal surroundings one is handed on for comparison.
    """
    if not (left.num_rows and right.num_rows):
        return _table([], MARKS_ARROW)
    hashes, around, count, many = unpack_keys(right.column("entries")[0].as_py())
    key = mix(hashes) ^ around  # 64 bits to search by; the pair is compared after
    order = np.argsort(key)
    handed, rows = np.zeros(len(hashes), bool), []
    for block, keys, body in zip(*(left.column(c) for c in ("block", "keys", "body"))):
        h, a = unpack_keys(keys.as_py())
        place, first, last = (from_planes(p, t).astype(np.int64) for p, t in zip(unsqueeze(body.as_py()), (np.uint64, np.uint16, np.uint16)))
        if not len(hashes):
            continue
        at = order[np.minimum(np.searchsorted(key[order], mix(h) ^ a), len(order) - 1)]
        hit = (hashes[at] == h) & (around[at] == a)
        at, place, first, last = at[hit], place[hit], first[hit], last[hit]
        twin = count[at] > 1
        if twin.any():
            rows.append((block.as_py(), pack_spans((place - first)[twin], (place - last)[twin] + LENGTH), *[None] * 7))
        _, once = np.unique(at, return_index=True)
        once = once[(many[at[once]] > 1) & ~handed[at[once]]]
        handed[at[once]] = True
        x = at[once]
        columns = (hashes[x].astype(np.int64), around[x].view(np.int64), count[x] == 1, many[x] > MOST, place[once], first[once], last[once])
        rows += [(block.as_py(), None, *row) for row in zip(*(c.tolist() for c in columns))]
    return _table(rows, MARKS_ARROW)


FETCHED = "hash long, alone boolean, hot boolean, block long, place long, first int, last int, bytes binary"
FETCHED_ARROW = pa.schema([("hash", pa.int64()), ("alone", pa.bool_()), ("hot", pa.bool_()), ("block", pa.int64()), ("place", pa.int64()), ("first", pa.int32()), ("last", pa.int32()), ("bytes", pa.binary())])


def _fetched(left: pa.Table, right: pa.Table) -> pa.Table:
    """Surroundings of the suffixes of a block that are to be compared."""
    rows = []
    if left.num_rows and right.num_rows:
        data = unsqueeze(left.column("data")[0].as_py())[0]
        for r in right.to_pylist():
            rows.append((r["hash"], r["alone"], r["hot"], r["block"], r["place"], r["first"], r["last"], data[r["place"] - r["first"] : r["place"] - r["last"] + LENGTH]))
    return _table(rows, FETCHED_ARROW)


SPANS = "block long, spans binary"
SPANS_ARROW = pa.schema([("block", pa.int64()), ("spans", pa.binary())])


def _ordered(group: np.ndarray, rows: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A suffix array of `rows` (bytes, `size` of each valid) within groups, and the common prefix of each with the one before (0 over groups).

    Of rows equal as far as the shorter goes, the shorter comes first, so it parts no longer ones.
    """
    keyed = np.concatenate([group.astype(">u8").view(np.uint8).reshape(-1, 8), rows, size.astype(">u4").view(np.uint8).reshape(-1, 4)], axis=1)
    order = np.argsort(np.ascontiguousarray(keyed).view(f"V{keyed.shape[1]}").ravel(), kind="stable")
    common = np.zeros(len(order), np.int64)
    if len(order) > 1:
        x, y = rows[order[1:]], rows[order[:-1]]
        differ = x != y
        first = np.where(differ.any(axis=1), differ.argmax(axis=1), rows.shape[1])
        first = np.minimum(first, np.minimum(size[order[1:]], size[order[:-1]]))
        common[1:] = np.where(group[order[1:]] == group[order[:-1]], first, -1)
    common[:1] = -1
    return order, common


def repeated_offsets(group: np.ndarray, texts: list[bytes], first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Which strings of each suffix another suffix of its group has as well: `[suffix, bytes that the string begins before it]`.

    A string that begins d bytes before is shared if LENGTH - d bytes to the right and d bytes to the left are: two suffix arrays give
    stretches of suffixes that share so many bytes, for every d.
    """
    n = len(texts)
    right, left = np.zeros((n, LENGTH), np.uint8), np.zeros((n, REACH - 1), np.uint8)
    for i, text in enumerate(texts):
        row, f = np.frombuffer(text, np.uint8), int(first[i])
        right[i, : len(row) - f] = row[f:]
        left[i, :f] = row[:f][::-1]
    found = np.zeros((n, REACH), bool)
    right_order, right_common = _ordered(group, right, LENGTH - last)
    left_order, left_common = _ordered(group, left, first)
    x, y = np.empty(n, np.int64), np.empty(n, np.int64)
    for d in range(int(last.min()) if n else 0, int(first.max()) + 1 if n else 0):
        x[right_order] = np.cumsum(right_common < LENGTH - d)
        y[left_order] = np.cumsum(left_common < d)
        has = np.flatnonzero((last <= d) & (d <= first))
        _, where, many = np.unique(x[has] * (n + 1) + y[has], return_inverse=True, return_counts=True)
        found[has, d] = many[where] > 1
    return found


def _compared(table: pa.Table) -> pa.Table:
    """Spans of strings that suffixes of the same hash share, for those with no twin in all their surroundings."""
    if not table.num_rows:
        return _table([], SPANS_ARROW)
    group, place, block = (table.column(c).to_numpy() for c in ("hash", "place", "block"))
    first, last = (table.column(c).to_numpy().astype(np.int64) for c in ("first", "last"))
    found = repeated_offsets(group.astype(np.uint64), table.column("bytes").to_pylist(), first, last)
    found &= table.column("alone").to_numpy(zero_copy_only=False)[:, None]
    edges = np.diff(np.pad(found, ((0, 0), (1, 1))).astype(np.int8), axis=1)
    (i, low), (_, high) = np.nonzero(edges == 1), np.nonzero(edges == -1)
    begin, end = place[i] - high + 1, place[i] - low + LENGTH
    rows = [(int(b), pack_spans(begin[block[i] == b], end[block[i] == b])) for b in np.unique(block[i])]
    return _table(rows, SPANS_ARROW)


STRINGS = "h1 long, h2 long, block long, begin long"


def _strings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Every string of hot suffixes by a hash of its own, in 128 bits."""
    for batch in batches:
        out = []
        for r in batch.to_pylist():
            row = np.frombuffer(r["bytes"], np.uint8)
            one, two = Hashes(row).every(LENGTH), Hashes(row ^ np.uint8(0xA5)).every(LENGTH)
            out.append((one.view(np.int64), two.view(np.int64), np.full(len(one), r["block"]), r["place"] - r["first"] + np.arange(len(one))))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out)], ["h1", "h2", "block", "begin"])


def _single_spans(table: pa.Table) -> pa.Table:
    begin = table.column("begin").to_numpy()
    return _table([(table.column("block")[0].as_py(), pack_spans(begin, begin + LENGTH))], SPANS_ARROW)


# ---- cutting ------------------------------------------------------------------------
CUT = "doc_id long, n_bytes long, kept binary, spans array<struct<begin:long,end:long>>"
CUT_ARROW = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("kept", pa.binary()), ("spans", pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())])))])


def _joined(spans: list[tuple[np.ndarray, np.ndarray]], edges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Overlapping and touching spans as one, in order; none goes on over an edge."""
    begin, end = (np.concatenate([s[i] for s in spans]) if spans else np.zeros(0, np.int64) for i in (0, 1))
    order = np.argsort(begin, kind="stable")
    begin, end = begin[order], np.maximum.accumulate(end[order]) if len(order) else end
    new = np.ones(len(begin), bool)
    new[1:] = (begin[1:] > end[:-1]) | np.isin(begin[1:], edges)
    firsts = np.flatnonzero(new)
    return begin[firsts], end[np.append(firsts[1:], len(begin)) - 1] if len(firsts) else end


def _cut(left: pa.Table, right: pa.Table) -> pa.Table:
    """Documents of a block without the bytes that any span covers."""
    rows = []
    if left.num_rows:
        data = memoryview(unsqueeze(left.column("data")[0].as_py())[0])
        sizes = from_planes(left.column("offsets")[0].as_py(), np.int64)
        ends = np.cumsum(sizes)
        begin, end = _joined([unpack_spans(packed.as_py()) for packed in right.column("spans")], ends)
        # Spans lie within documents; where two documents' spans touch, each keeps its own.
        firsts, lasts = np.searchsorted(begin, ends - sizes), np.searchsorted(begin, ends)
        for i, size, stop, x, y in zip(left.column("ids")[0].as_py(), sizes.tolist(), ends.tolist(), firsts.tolist(), lasts.tolist()):
            spans, kept, at = list(zip(begin[x:y].tolist(), end[x:y].tolist())), [], stop - size
            for a, b in spans:
                kept.append(data[at:a])
                at = b
            rows.append((i, size, b"".join([*kept, data[at:stop]]), [(a - stop + size, b - stop + size) for a, b in spans]))
    return _table(rows, CUT_ARROW)


def cut_repeats(docs: DataFrame, batches: int = BATCHES) -> DataFrame:
    """Every text of `docs` (`doc_id`, `text`) without the bytes of any string of 400 that the table holds elsewhere too.

    Strings are looked for in the texts as given, do not reach over documents, and may overlap; all their places are cut, the first
    too. Returns `doc_id, n_bytes, kept, spans` for every row: the size of the text in UTF-8, the bytes that are left, and the runs cut
    out, by their bytes in the text as given. A character can be cut in two, so `kept` is binary. A null text is empty; a null id stands
    for a document like others, as do repeated rows, which are copies of each other. Texts under 400 bytes lose nothing. An empty table gives no rows.
    Extra columns are not read. `batches` only says in how many steps the index grows, not what is found.
    """
    docs = only(docs, "doc_id", "text").select(F.col("doc_id").cast("long"), "text")
    total = docs.agg(F.sum(byte_size(F.col("text")))).first()[0] or 0
    buckets = max(1, -(-2 * total // (REACH + 1) // BUCKET))
    table = materialise(docs.mapInArrow(_blocks(buckets), BLOCK), "suffix-blocks")
    texts = table.where("ids IS NOT NULL").select("block", "ids", "offsets", "data")
    runs = table.where("bucket IS NOT NULL").select("block", "bucket", "keys", "body")
    index = Index()
    found = [index.append(runs.where(F.pmod(F.xxhash64("block"), F.lit(batches)) == b).select("bucket", "keys")) for b in range(batches)]
    hits = found[0]
    for more in found[1:]:
        hits = hits.union(more)
    shared = materialise(index.entries().groupBy("bucket").cogroup(hits.groupBy("bucket")).applyInArrow(_shared, ARRAY), "suffix-shared")
    salts = max(1, -(-total // BLOCK_BYTES // RUNS))
    spread = shared.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))).groupBy("bucket", "salt")
    salted = runs.withColumn("salt", F.pmod(F.xxhash64("block"), F.lit(salts)).cast("int")).groupBy("bucket", "salt")
    marks = materialise(salted.cogroup(spread).applyInArrow(_marks, MARKS), "suffix-marks")
    # Of suffixes with equal surroundings one is enough, whichever task handed it on.
    one = F.min(F.struct("block", "place", "first", "last", "alone", "hot")).alias("one")
    compare = marks.where("spans IS NULL").groupBy("hash", "around").agg(one).select("hash", "one.*")
    fetched = materialise(texts.select("block", "data").groupBy("block").cogroup(compare.groupBy("block")).applyInArrow(_fetched, FETCHED), "suffix-fetched")
    size = fetched.agg(F.sum(F.octet_length("bytes"))).first()[0] or 0
    part = F.pmod(F.xxhash64("hash"), F.lit(max(1, -(-size // COMPARED))))
    compared = fetched.where("NOT hot").groupBy(part).applyInArrow(_compared, SPANS)
    strings = fetched.where("hot").select("bytes", "block", "place", "first").mapInArrow(_strings, STRINGS)
    twice = strings.groupBy("h1", "h2").count().where("count > 1").select("h1", "h2")
    single = strings.join(twice, ["h1", "h2"], "left_semi").select("block", "begin").groupBy("block").applyInArrow(_single_spans, SPANS)
    spans = marks.where("spans IS NOT NULL").select("block", "spans").union(compared).union(single)
    return texts.groupBy("block").cogroup(spans.groupBy("block")).applyInArrow(_cut, CUT)


def digests() -> list[Column]:
    """`n_bytes, n_removed, n_spans, kept_sha256` of rows of `cut_repeats`."""
    kept, size = F.col("kept"), F.col("n_bytes")
    return [size, (size - F.octet_length(kept)).alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2(kept, 256).alias("kept_sha256")]


def deduplicate(docs: DataFrame, batches: int = BATCHES) -> DataFrame:
    """`doc_id, n_bytes, n_removed, n_spans, kept_sha256`: what `cut_repeats` does to each row, in numbers."""
    return cut_repeats(docs, batches).select("doc_id", *digests())
