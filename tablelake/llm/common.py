"""Helpers shared by the operators of this package: vectorised words, byte planes, dealt-out numbering."""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Texts are cut into words this many bytes at a time (one longer text is taken whole), which bounds a worker's memory.
CHUNK_BYTES = 1 << 20
_BASE = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (splitmix64), element by element."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def mix_one(x: int) -> int:
    """`mix` of one number, modulo 2^64."""
    x &= (1 << 64) - 1
    x = (x ^ x >> 30) * 0xBF58476D1CE4E5B9 & (1 << 64) - 1
    x = (x ^ x >> 27) * 0x94D049BB133111EB & (1 << 64) - 1
    return x ^ x >> 31


def distinct(x: np.ndarray) -> np.ndarray:
    """The values of `x`, ascending, each once. For the many short arrays of a batch, where `np.unique` costs more."""
    x = np.sort(x)
    if len(x) < 2:
        return x
    fresh = x[1:] != x[:-1]
    return x if fresh.all() else x[np.concatenate([[True], fresh])]


class _Powers:
    """Powers of the hash base and of its inverse, as many as the longest chunk so far asked for."""

    def __init__(self):
        self.up = self.down = np.ones(1, np.uint64)

    def of(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            inverse = np.uint64(pow(int(_BASE), -1, 1 << 64))
            self.up, self.down = (np.cumprod(np.concatenate([[np.uint64(1)], np.full(n - 1, b, np.uint64)]), dtype=np.uint64)
                                  for b in (_BASE, inverse))
        return self.up[:n], self.down[:n]


_POWERS = _Powers()


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts end to end, and where each begins (one more for the end). Null counts as empty."""
    texts = texts.combine_chunks() if isinstance(texts, pa.ChunkedArray) else texts
    texts = texts.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    data = texts.buffers()[2] if len(texts) else None
    whole = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return whole[offsets[0] : offsets[-1]], offsets - offsets[0]


def word_hashes(texts: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """`(row of the first text, word hashes, where each text's words begin)` by chunks of texts.

    Words are maximal runs of bytes other than space and 0x09-0x0D, with A-Z lower-cased.
    """
    data, offsets = text_bytes(texts)
    first = 0
    while first < len(offsets) - 1:
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + CHUNK_BYTES, "right")) - 1)
        part, own = data[offsets[first] : offsets[last]].copy(), offsets[first : last + 1] - offsets[first]
        yield first, *_hashed(part, own)
        first = last


def _hashed(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    starts, ends = word_bounds(data, offsets)
    data[(data - np.uint8(65)) < 26] += np.uint8(32)
    up, down = _POWERS.of(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[:-1], out=sums[1:])
    hashes = mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))
    return hashes, np.searchsorted(starts, offsets)


def word_bounds(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where words begin and end; no word reaches over the end of its text."""
    inner = ~((data == 32) | ((data - np.uint8(9)) < 5))
    begins, ends = inner.copy(), inner.copy()
    begins[1:] &= ~inner[:-1]
    ends[:-1] &= ~inner[1:]
    edges = offsets[(offsets > 0) & (offsets < len(data))]
    begins[edges] = inner[edges]
    ends[edges - 1] = inner[edges - 1]
    return np.flatnonzero(begins), np.flatnonzero(ends) + 1


def gathered(batches: Iterator[pa.RecordBatch], size: int = 16 << 20) -> Iterator[pa.RecordBatch]:
    """Batches put together until they hold `size` bytes."""
    held, total = [], 0
    for batch in batches:
        held.append(batch)
        total += batch.nbytes
        if total >= size:
            yield pa.concat_batches(held)
            held, total = [], 0
    if held:
        yield pa.concat_batches(held)


def planes(values: np.ndarray) -> bytes:
    """Fixed-width integers byte plane by byte plane, so that a compressor finds the high zeros together."""
    return np.ascontiguousarray(values).view(np.uint8).reshape(len(values), values.dtype.itemsize).T.tobytes()


def from_planes(data: bytes, dtype) -> np.ndarray:
    width = np.dtype(dtype).itemsize
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(width, -1).T).view(dtype).ravel()


def pack_sorted(keys: np.ndarray) -> bytes:
    """Ascending unsigned 64-bit keys as the byte planes of their differences."""
    return planes(np.diff(keys, prepend=np.uint64(0)).astype(np.uint64))


def unpack_sorted(data: bytes) -> np.ndarray:
    return np.cumsum(from_planes(data, np.uint64), dtype=np.uint64)


def parts(spark: SparkSession) -> int:
    """The session's number of shuffle partitions."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def doc_hash(*columns: Column | str) -> Column:
    """Deals rows out evenly, also those of one id with different texts."""
    return F.xxhash64(*columns)


def byte_size(text: Column) -> Column:
    """Length of a text in UTF-8 bytes; null has none."""
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long")


def crc32_mod(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id written as text, modulo `modulus`. A null id counts as the empty text."""
    return F.crc32(F.encode(F.coalesce(doc_id.cast("string"), F.lit("")), "UTF-8")) % modulus


def only(df: DataFrame, *names: str) -> DataFrame:
    """The named columns by position in the schema, so that odd other names don't matter."""
    return df.select(*[df[f"`{name}`"] for name in names])
