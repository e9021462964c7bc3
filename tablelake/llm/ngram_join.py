"""Jaccard self-join of texts on five-word shingles by universe-partition pigeonhole.

A set's shingles (64-bit hashes) are split into segments by hash; the number of segments depends on the size band. Two sets
that differ in at most H shingles share an identical segment if the smaller has more than H points, a point being a
non-empty segment. A segment dealt a one-deletion neighbourhood counts two points: it is indexed whole and
with each shingle left out, so sets that differ in it by one shingle still meet. `allocate` chooses for
each size band how many segments there are and which of them get a neighbourhood, by expected cost; very small sets index
every shingle. A band in which some set falls short of its points is indexed anew shingle by shingle.

A set may have more points than it needs. A signature held by few sets gives all their pairs; of those held by many a set
skips its dearest, as many as it has points to spare, and probes only the rest. All members of a probed signature are compared
with one prober. Where that leaves a prober and a member in different components that could be similar by triangle
inequality, the sets that meet in such signatures are compared in blocks, which count common shingles by matrix product and give
links only, no pairs. Identical sets are one class from the start, and every link is verified exactly on whole texts.
"""
from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablelake.llm.common import byte_size, distinct, from_planes, gathered, mix, mix_one, only, pack_sorted, parts, planes, unpack_sorted, word_hashes
from tablelake.llm.components import beside, components
from tablelake.session import materialise

WORDS = 5
#: Signatures with up to this many sets give all pairs at once.
FEW = 8
#: Sets and text bytes of a block when many sets are compared with each other.
BLOCK, BLOCK_BYTES = 512, 16 << 20
#: Text bytes per index shard, and ranges of signatures that it is settled in, one after the other.
SHARD_BYTES, RANGES = 16 << 20, 4
#: Most partitions of the index; beyond them a partition holds several shards.
PARTITIONS = 20_000
#: Bits of a signature beyond those that number the bytes of all texts.
SPARE_BITS = 18
#: Weight of a one-shingle segment (as frequent as its shingle) against one more signature.
HEAT = 4.0
#: Bands up to this size index every shingle.
TINY = 24


# ---- size bands and allocation ----------------------------------------------
@functools.cache
def band_starts() -> np.ndarray:
    """Least size of each band; starts grow by 25/16, so a set's partners of 4/5 its size are at most one band below."""
    starts = [1]
    while starts[-1] < 1 << 40:
        starts.append(-(-starts[-1] * 25 // 16))
    return np.array(starts)


def most_errors(total: int) -> int:
    """Largest symmetric difference of two sets with `total` elements together and 100 * common >= 80 * union."""
    return total - 2 * -(-4 * total // 9)


@functools.lru_cache(1 << 16)
def need(size: int) -> int:
    """Points that the smaller set must have: one more than it may differ by from any set not smaller."""
    top = size * 5 // 4
    return max(most_errors(size + b) for b in range(max(size, top - 8), top + 1)) + 1


@functools.cache
def allocate(band: int, heat: float = HEAT) -> tuple[int, int]:
    """`(segments, segments with a one-deletion neighbourhood)` of a size band at least expected cost; (0, 0): by shingle.

    A choice is allowed if sets of every size in the band have the points they need by eight standard deviations. Cost: the
    signatures of the largest set plus `heat` for every one-shingle segment that has no neighbourhood.
    """
    low, high = int(band_starts()[band]), int(band_starts()[band + 1]) - 1
    if high <= TINY:
        return 0, 0
    sizes = np.unique(np.linspace(low, high, 16).astype(int))
    wanted = np.array([need(int(s)) for s in sizes])
    best, cost = (0, 0), (1 + heat) * high
    for share in (0.0, 0.25, 0.5, 1.0):
        for m in np.unique(np.geomspace(max(2, high / 12), high, 60).astype(int)):
            x = sizes / m
            filled, single = 1 - np.exp(-x), x * np.exp(-x)
            points = m * (filled + share * (filled - single))
            spread = np.sqrt(m * np.exp(-x) * np.maximum(1 - (1 + x) * np.exp(-x), 0.02)) * (1 + share)
            if (points - 8 * spread < wanted).any():
                continue
            c = m * filled[-1] + share * high + heat * m * single[-1] * (1 - share)
            if c < cost:
                best, cost = (int(m), int(round(share * m))), c
            break
    return best


# ---- sets and signatures (numpy, inside tasks) -------------------------------
def shingle_sets(texts: pa.Array) -> Iterator[tuple[int, np.ndarray]]:
    """`(row, ascending distinct shingle hashes)` of every text."""
    k = np.uint64(0xD6E8FEB86659FD93)
    for first, words, begins in word_hashes(texts):
        rolled = words[: max(0, len(words) - WORDS + 1)].copy()
        for j in range(1, WORDS):
            rolled = rolled * k + words[j : j + len(rolled)]
        rolled = mix(rolled)
        for i in range(len(begins) - 1):
            a, b = int(begins[i]), int(begins[i + 1])
            if b - a >= WORDS:
                yield first + i, distinct(rolled[a : b - WORDS + 1])
            elif b > a:  # the whole sequence is one shingle
                total = np.array([b - a], np.uint64)
                for j in range(a, b):
                    total = total * k + words[j : j + 1]
                yield first + i, mix(total)
            else:
                yield first + i, words[:0]


def set_key(shingles: np.ndarray) -> int:
    """64-bit fingerprint of a set, the name of its class."""
    total = int(mix(shingles ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64)) + len(shingles)
    key = mix_one(total)
    return key - (1 << 64) if key >> 63 else key


@functools.cache
def band_mark(band: int) -> np.ndarray:
    """Tells the signatures of a band from those of others."""
    return mix(np.array([band * 2 + 1], np.uint64))


def signatures(shingles: np.ndarray, band: int, segments: int, near: int) -> tuple[np.ndarray, int]:
    """Signatures of a set in a band, and its points. A segment's signature is a mixed sum, so leaving one out is a difference."""
    base = band_mark(band)
    if not segments:
        return mix(shingles ^ base), len(shingles)
    values = mix(shingles + base)
    segment = (shingles >> np.uint64(20)) % np.uint64(segments)
    # Two bytes are sorted by counting.
    order = np.argsort(segment.astype(np.uint16) if segments <= 1 << 16 else segment, kind="stable")
    segment, values = segment[order], values[order]
    heads = np.concatenate([[0], np.flatnonzero(segment[1:] != segment[:-1]) + 1])
    sums = np.add.reduceat(values, heads)
    names = segment[heads] * np.uint64(0x2545F4914F6CDD1D)
    out = [mix(sums ^ names ^ base)]
    if not near:
        return out[0], len(heads)
    sizes = np.diff(heads, append=len(segment))
    wide = (segment[heads] < near) & (sizes > 1)
    if wide.any():
        of = np.repeat(np.arange(len(heads)), sizes)
        of, left = of[np.repeat(wide, sizes)], values[np.repeat(wide, sizes)]
        out.append(mix((sums[of] - left) ^ names[of] ^ base))
    return np.concatenate(out), len(heads) + int(wide.sum())


def signature_bits(total: int) -> int:
    """Bits that signatures of `total` text bytes are cut to: few meet by chance, and sorted ones lie close together."""
    return min(64, max(40, total.bit_length() + SPARE_BITS))


def _meta(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        n, key = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows, np.int64)
        for row, shingles in shingle_sets(batch.column(1)):
            n[row], key[row] = len(shingles), set_key(shingles)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n), pa.array(key), batch.column(2)], ["doc_id", "n_shingles", "k", "h"])


PAIR = "shard int, sig long, a long, b long, na int, nb int, kind string, payload binary"
NAMES = ["shard", "sig", "a", "b", "na", "nb", "kind", "payload"]


def _rows(kind: str, n: int, **columns) -> pa.RecordBatch:
    types = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.string(), pa.binary()]
    arrays = [pa.array([kind] * n, t) if name == "kind" else pa.array(columns[name], t) if name in columns else pa.nulls(n, t) for name, t in zip(NAMES, types)]
    return pa.RecordBatch.from_arrays(arrays, NAMES)


def _index(batches: Iterator[pa.RecordBatch], shards: int, bits: int, heat: float, by_shingle: frozenset) -> Iterator[pa.RecordBatch]:
    """Signature postings of texts, packed by index shard, a batch of texts at a time.

    Of a signature that more than FEW sets of a batch hold, only the least goes on; the others are linked to it here.
    Signatures are cut to `bits`: those that meet by chance add candidates, and in one set they cost it their points.
    """
    for batch in gathered(batches):
        sigs, short = [], set()
        held = []  # key, size, points to spare (-1: only the larger of a pair) of each set in each of its bands
        for _, shingles in shingle_sets(batch.column(0)):
            size = len(shingles)
            if not size:
                continue
            key, own = set_key(shingles), int(np.searchsorted(band_starts(), size, "right")) - 1
            below = own and 4 * size <= 5 * (int(band_starts()[own]) - 1)
            for band in (own, own - 1) if below else (own,):
                if by_shingle and band not in by_shingle:
                    continue
                segments, near = (0, 0) if by_shingle else allocate(band, heat)
                found, points = signatures(shingles, band, segments, near)
                whole = len(found)
                found = distinct(found >> np.uint64(64 - bits))
                spare = points - 2 * (whole - len(found)) - need(size)
                if band == own and spare < 0:
                    short.add(band)
                sigs.append(found)
                held.append((key, size, -1 if band != own else max(0, spare) // (2 if near else 1)))
        for band in short:
            yield _rows("short", 1, shard=[-1], na=[band])
        if not sigs:
            continue
        yield from _meet(sigs, np.array(held, np.int64), shards, bits)


def _runs(sigs: np.ndarray, who: np.ndarray, keys: np.ndarray):
    """Postings by signature and key, each once; where runs of a signature begin, and their lengths. `keys` ascend with the numbers of sets `who`, as these do as they come."""
    order = np.argsort(sigs, kind="stable")
    sigs, who = sigs[order], who[order]
    same = sigs[1:] == sigs[:-1]
    twice = np.zeros(len(sigs), bool)
    twice[1:] = same & (keys[who[1:]] == keys[who[:-1]])
    sigs, who = sigs[~twice], who[~twice]
    heads = np.flatnonzero(np.concatenate([[True], sigs[1:] != sigs[:-1]])) if len(sigs) else np.zeros(0, int)
    return sigs, who, heads, np.diff(heads, append=len(sigs))


def _members(sigs, held, who, inside) -> Iterator[pa.RecordBatch]:
    """Postings of signatures held by many."""
    if inside.any():
        held = held[who[inside]]
        yield _rows("member", len(held), sig=sigs[inside].view(np.int64), a=held[:, 0], na=held[:, 1].astype(np.int32), nb=held[:, 2].astype(np.int32))


def _by_key(held: np.ndarray) -> np.ndarray:
    """The order of sets by key; of one key, the set in its own band comes first."""
    return np.lexsort((-held[:, 2], held[:, 1], held[:, 0]))


def _meet(sigs: list[np.ndarray], held: np.ndarray, shards: int, bits: int) -> Iterator[pa.RecordBatch]:
    """Map side: of a signature that many hold only one posting goes on, marked; the rest is packed by shard, a range of signatures.

    `sigs` has the signatures of each of the sets `held`.
    """
    order = _by_key(held)
    held, sigs = held[order], [sigs[i] for i in order.tolist()]
    # Copies, in key, size and points to spare, are one set.
    number = np.cumsum(np.concatenate([[False], (held[1:] != held[:-1]).any(axis=1)]))
    who = np.repeat(number, [len(x) for x in sigs]).astype(np.int32)
    held = held[np.searchsorted(number, np.arange(number[-1] + 1))]
    sigs, who, heads, lengths = _runs(np.concatenate(sigs), who, held[:, 0])
    many = np.repeat(lengths > FEW, lengths)
    yield from _members(sigs, held, who, many)
    keep = ~many
    keep[heads] = True
    sigs, who, many = sigs[keep], who[keep], many[keep]
    shard = ((sigs >> np.uint64(bits - 32)) * np.uint64(shards) >> np.uint64(32)).astype(np.int64)
    cuts = np.append(np.flatnonzero(np.diff(shard, prepend=-1)), len(shard))
    pack = zstandard.ZstdCompressor(level=1).compress
    at = np.zeros(len(held), np.uint32)
    for low, high in zip(cuts[:-1], cuts[1:]):
        own = distinct(who[low:high])
        at[own] = np.arange(len(own))
        head = np.array([high - low, len(own)], np.int64).tobytes()
        body = pack_sorted(sigs[low:high]) + planes(at[who[low:high]]) + np.packbits(many[low:high]).tobytes() + planes(held[own].ravel())
        yield _rows("index", 1, shard=[int(shard[low])], payload=[head + pack(body)])


def _unpack(payload: bytes):
    """`(signatures, which set holds each, marks, sets)`."""
    n, m = map(int, np.frombuffer(payload, np.int64, 2))
    body = zstandard.ZstdDecompressor().decompress(payload[16:])
    at, cut = 0, []
    for width in (8 * n, 4 * n, (n + 7) // 8, 24 * m):
        cut.append(body[at : at + width])
        at += width
    marks = np.unpackbits(np.frombuffer(cut[2], np.uint8), count=n).astype(bool)
    return unpack_sorted(cut[0]), from_planes(cut[1], np.uint32), marks, from_planes(cut[3], np.int64).reshape(m, 3)


def _shard(payloads: list[bytes]) -> Iterator[pa.RecordBatch]:
    """One index shard: all pairs of signatures that few hold, the postings of the others; a range of signatures at a time."""
    posted = [_unpack(p) for p in payloads]
    low, high = min(int(p[0][0]) for p in posted), max(int(p[0][-1]) for p in posted)
    ends = np.array([low + (high - low) * i // RANGES for i in range(1, RANGES)], np.uint64)
    cuts = [[0, *np.searchsorted(p[0], ends, "right"), len(p[0])] for p in posted]
    held = np.concatenate([sets for *_, sets in posted])
    order = _by_key(held)
    held, place = held[order], np.zeros(len(held), np.int32)
    place[order] = np.arange(len(order))
    firsts = np.cumsum([0, *(len(sets) for *_, sets in posted)])
    for i in range(RANGES):
        own = [(s[c[i] : c[i + 1]], place[first + who[c[i] : c[i + 1]].astype(np.int64)], marks[c[i] : c[i + 1]]) for (s, who, marks, _), c, first in zip(posted, cuts, firsts)]
        sigs, who, already = map(np.concatenate, zip(*own))
        if len(sigs):
            yield from _settle(sigs, who, held, already)


def _settle(sigs, who, held, already) -> Iterator[pa.RecordBatch]:
    hot = np.unique(sigs[already])
    order = np.argsort(who, kind="stable")
    sigs, who, heads, lengths = _runs(sigs[order], who[order], held[:, 0])
    many = (lengths > FEW) | np.isin(sigs[heads], hot)
    yield from _members(sigs, held, who, np.repeat(many, lengths))
    few = np.flatnonzero(~many & (lengths > 1))
    a, b = [heads[:0]], [heads[:0]]
    for step in range(1, FEW):
        ok = heads[few[lengths[few] > step]]
        for back in range(step):
            a.append(ok + back)
            b.append(ok + step)
    yield from _pairs(held[who[np.concatenate(a)]], held[who[np.concatenate(b)]])


def _pairs(a: np.ndarray, b: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Distinct pairs whose sizes allow a link; least key first, as postings are sorted."""
    able = 5 * np.minimum(a[:, 1], b[:, 1]) >= 4 * np.maximum(a[:, 1], b[:, 1])
    pairs = np.unique(np.stack([a[able, 0], b[able, 0]], axis=1), axis=0)
    if len(pairs):
        yield _rows("pair", len(pairs), a=pairs[:, 0], b=pairs[:, 1])


# ---- verification -----------------------------------------------------------
def _keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keys = np.zeros(batch.num_rows, np.int64)
        for row, shingles in shingle_sets(batch.column(0)):
            keys[row] = set_key(shingles)
        yield pa.RecordBatch.from_arrays([pa.array(keys), batch.column(0)], ["k", "text"])


def _common(a: np.ndarray, b: np.ndarray) -> int:
    """How many values two arrays share that hold each of theirs once."""
    both = np.sort(np.concatenate([a, b]))
    return int(np.count_nonzero(both[1:] == both[:-1]))


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        # A text on many pairs of the batch is cut into shingles once.
        sides = [np.unique(batch.column(i).to_numpy(), return_index=True, return_inverse=True) for i in (0, 1)]
        (left, l), (right, r) = ((dict(shingle_sets(batch.column(2 + i).take(pa.array(first)))), at.tolist()) for i, (_, first, at) in enumerate(sides))
        common = [_common(left[l[i]], right[r[i]]) for i in range(batch.num_rows)]
        total = [len(left[l[i]]) + len(right[r[i]]) - c for i, c in enumerate(common)]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(common, pa.int64()), pa.array(total, pa.int64())], ["a", "b", "common", "total"])


def _verify(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """`a, b, common, total` of pairs of classes, counted on the whole texts."""
    first = pairs.select("a", "b").join(texts.select(F.col("k").alias("a"), F.col("text").alias("ta")), "a")
    both = first.join(texts.select(F.col("k").alias("b"), F.col("text").alias("tb")), "b").select("a", "b", "ta", "tb")
    return both.mapInArrow(_compare, "a long, b long, common long, total long")


# ---- the operator -----------------------------------------------------------
def _wanted(docs: DataFrame, classes: DataFrame, pairs: DataFrame) -> DataFrame:
    """`k, text` of the classes on candidate pairs, one text each, written once."""
    keys = pairs.select(F.explode(F.array("a", "b")).alias("k")).distinct()
    ids = classes.join(keys, "k", "left_semi").select(F.col("rep").alias("doc_id"), F.col("k").alias("own"))
    read = docs.join(ids, docs["doc_id"].eqNullSafe(ids["doc_id"]), "left_semi").select("text")
    texts = read.mapInArrow(_keyed, "k long, text string").join(keys, "k", "left_semi")
    # Rows of one doc_id may differ, and a class may come twice: keep one text for each.
    return materialise(texts.groupBy("k").agg(F.max("text").alias("text")), "ngram-texts")


def link_sets(docs: DataFrame, heat: float = HEAT) -> tuple[DataFrame, DataFrame]:
    """`(sets, edges)`: `doc_id, n_shingles, k, h` for every row, and edges `a, b` between different sets (keys k).

    The edges have the components of the verified links; a set may be joined to its component's least key instead of to those it is similar to.
    """
    spark = docs.sparkSession
    docs = only(docs, "doc_id", "text").withColumn("doc_id", F.col("doc_id").cast("long"))
    keyed = docs.select("doc_id", "text", _text_key(docs).alias("h"))
    sets = materialise(keyed.mapInArrow(_meta, "doc_id long, n_shingles long, k long, h long"), "ngram-sets")
    classes = sets.where("n_shingles > 0").groupBy("k").agg(F.min("doc_id").alias("rep"), F.first("n_shingles").alias("n"))
    total = docs.agg(F.sum(byte_size(F.col("text")))).first()[0] or 0
    shards, bits = max(parts(spark), -(-total // SHARD_BYTES)), signature_bits(total)
    dealt_to = max(parts(spark), min(shards, PARTITIONS))
    texts = docs.select("text")

    def found(by_shingle: frozenset = frozenset()) -> DataFrame:
        posted = texts.mapInArrow(lambda b: _index(b, shards, bits, heat, by_shingle), PAIR)
        # Pairs and members made on the map side pass through the same exchange, dealt out by their own keys.
        dealt = posted.withColumn("shard", F.coalesce("shard", F.pmod(F.xxhash64("sig", "a", "b"), F.lit(shards)).cast("int")))
        return materialise(dealt.repartition(dealt_to, "shard").groupBy("shard").applyInArrow(_shard_rows, PAIR), "ngram-candidates")

    candidates = found()
    short = frozenset(r["na"] for r in candidates.where("kind = 'short'").select("na").distinct().collect())  # bands, some forty
    if short:
        candidates = candidates.unionByName(found(short))
    pairs = candidates.where("kind = 'pair'").select("a", "b").distinct()
    members = materialise(candidates.where("kind = 'member'").select("sig", F.col("a").alias("k"), F.col("na").alias("n"), F.col("nb").alias("spare")).distinct(), "ngram-postings")
    members = materialise(_probed(members), "ngram-members")
    pairs = materialise(pairs, "ngram-pairs")
    wanted = _wanted(docs, classes, pairs.union(members.select("k", "k")))
    tested = materialise(_verify(pairs, wanted), "ngram-tested")
    return sets, _rounds(members, tested, wanted)


def _shard_rows(table: pa.Table) -> pa.Table:
    """Packed postings meet; rows that need no meeting go through."""
    posted = pc.equal(table.column("kind"), "index")
    through = table.filter(pc.invert(posted))
    met = table.filter(posted)
    found = [pa.Table.from_batches([x]).cast(table.schema) for x in _shard(met.column("payload").to_pylist())] if met.num_rows else []
    return pa.concat_tables([through, *found])


def _probed(members: DataFrame) -> DataFrame:
    """`sig, k, n, prober` of the signatures that some set must probe.

    A set that holds more signatures of many than it has points to spare probes the least held ones of them, as many as
    it lacks. The window runs over one set's signatures.
    """
    held = materialise(members.groupBy("sig").agg(F.count(F.lit(1)).alias("held")), "ngram-held")
    own = Window.partitionBy("k")
    ranked = beside(members, held, "sig", "held").withColumns({
        "rank": F.row_number().over(own.orderBy(F.col("spare") < 0, "held", "sig")),
        "lacks": F.count_if(F.col("spare") >= 0).over(own) - F.col("spare"),
    })
    ranked = materialise(ranked.select("sig", "k", "n", ((F.col("spare") >= 0) & (F.col("rank") <= F.col("lacks"))).alias("prober")), "ngram-probes")
    probed = materialise(held.join(ranked.where("prober").select("sig").distinct(), "sig", "left_semi"), "ngram-probed")
    return beside(ranked, probed, "sig", "held").drop("held")


def _torn(members: DataFrame, label: DataFrame) -> DataFrame:
    """`sig, k, n, prober, centre` of the signatures whose members are in several components; centre: the least prober."""
    placed = materialise(members.join(label, members["k"] == label["id"], "left").select("sig", "k", "n", "prober", F.coalesce("component", "k").alias("c")), "ngram-placed")
    torn = placed.groupBy("sig").agg(F.count(F.lit(1)).alias("held"), F.min("c").alias("lo"), F.max("c").alias("hi"), F.min(F.when(F.col("prober"), F.col("k"))).alias("centre"))
    torn = materialise(torn.where("lo <> hi AND centre IS NOT NULL").select("sig", "centre", "held"), "ngram-centres")
    return materialise(beside(placed.drop("c"), torn, "sig", "held").drop("held"), "ngram-torn")


def _rounds(members: DataFrame, tested: DataFrame, texts: DataFrame) -> DataFrame:
    """Edges `a, b` with the components of all verified links, when all signatures of many are settled.

    First all members of a signature are compared with its least prober. What is close to that shares its component, and is
    done with unless some other member is near enough to the prober to be similar to what is close to it (distance up to 2/5).
    What is still torn is compared in blocks.
    """
    linked = F.expr("100 * common >= 80 * total")
    label = components(tested.where(linked).select("a", "b"))
    left = _torn(members, label)
    ends = {"a": F.least("centre", "k"), "b": F.greatest("centre", "k")}
    star = left.where("k <> centre").withColumns(ends)
    asked = star.select("a", "b").distinct().join(tested, ["a", "b"], "left_anti")
    asked = materialise(_verify(asked, texts), "ngram-tested")
    # The components so far stand for the links that made them.
    label = components(_forest(label).union(asked.where(linked).select("a", "b")))
    seen = star.join(tested.unionByName(asked).select("a", "b", (F.lit(1) - F.col("common") / F.col("total")).alias("d")), ["a", "b"])
    seen = materialise(seen.select("sig", "k", "n", "prober", "d"), "ngram-seen")
    between = seen.groupBy("sig").agg(F.count(F.lit(1)).alias("held"), F.max((F.col("d") > 0.2) & (F.col("d") < 0.4001)).alias("between"))
    between = materialise(between, "ngram-between")
    rest = materialise(beside(seen, between, "sig", "held").where("d > 0.2 OR between").select("sig", "k", "n", "prober"), "ngram-members")
    left = _torn(rest, label)
    return _forest(label).union(_in_blocks(left, texts))


def _forest(label: DataFrame) -> DataFrame:
    return label.where("id <> component").select(F.col("id").alias("a"), F.col("component").alias("b"))


def _in_blocks(left: DataFrame, texts: DataFrame) -> DataFrame:
    """Links between sets that meet, directly or by others, in torn signatures.

    A group of such sets is dealt into blocks of bounded size, and each pair of blocks is one task, which links
    every set of a component among its own to the component's least.
    """
    group = components(left.where("k <> centre").select(F.col("k").alias("a"), F.col("centre").alias("b")))
    held = materialise(group.join(texts, group["id"] == texts["k"]).select(F.col("component").alias("g"), "k", "text"), "ngram-held")
    size = held.groupBy("g").agg(F.greatest(F.ceil(F.count(F.lit(1)) / BLOCK), F.ceil(F.sum(byte_size(F.col("text"))) / BLOCK_BYTES)).cast("int").alias("blocks"))
    dealt = held.join(size, "g").withColumn("own", F.pmod(F.xxhash64("k"), F.col("blocks")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select("g", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), (F.col("own") > F.col("other")).alias("second"), "k", "text")
    return dealt.groupBy("g", "i", "j").applyInArrow(_block_links, "a long, b long")


def _block_links(table: pa.Table) -> pa.Table:
    keys, second = table.column("k").to_numpy(), table.column("second").to_numpy()
    n = len(keys)
    sets = [shingles for _, shingles in shingle_sets(table.column("text"))]
    sizes = np.array([len(x) for x in sets])
    _, at, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(n), sizes)
    shared = times[at] > 1
    row, at = row[shared], np.unique(at[shared], return_inverse=True)[1] if shared.any() else at[:0]
    common = np.zeros((n, n), np.float32)
    for low in range(0, int(at.max()) + 1 if len(at) else 0, 4096):
        here = (at >= low) & (at < low + 4096)
        has = np.zeros((n, 4096), np.float32)
        has[row[here], at[here] - low] = 1
        common += has @ has.T
    whole = common.astype(np.int64)
    near = 100 * whole >= 80 * (sizes[:, None] + sizes[None, :] - whole)
    if table.column("i")[0].as_py() != table.column("j")[0].as_py():
        near &= second[:, None] != second[None, :]  # pairs inside one block belong to another task
    np.fill_diagonal(near, True)
    label = np.arange(n)
    while True:
        lower = np.where(near, label[None, :], n).min(axis=1)
        lower = np.minimum(lower, label)[np.minimum(lower, label)]
        if (lower == label).all():
            break
        label = lower
    moved = label != np.arange(n)
    return pa.table({"a": pa.array(keys[label[moved]], pa.int64()), "b": pa.array(keys[moved], pa.int64())})


def ngram_components(docs: DataFrame, heat: float = HEAT) -> DataFrame:
    """Every row of `docs` (`doc_id`, `text`) with its set's size and component under five-word Jaccard >= 0.8.

    Returns `doc_id, n_shingles, component_id`: the least doc_id reachable by links, its own included. Null or wordless texts have
    an empty set and stand alone; with fewer than five words the whole sequence is the one shingle. Equal texts share a
    component. Rows with a null doc_id link like others but name no component unless all its ids are null. Other
    columns are not read. Sets are told apart by 64-bit fingerprints of their shingles.
    """
    sets, edges = link_sets(docs, heat)
    label = components(edges)
    placed = materialise(
        sets.join(label, sets["k"] == label["id"], "left")
        .select("doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.coalesce("component", "k")).alias("c")), "ngram-placed")
    least = placed.where("c IS NOT NULL").groupBy("c").agg(F.min("doc_id").alias("component_id"))
    joined = placed.join(least, "c", "left")
    return joined.select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))


def keep_one(docs: DataFrame, heat: float = HEAT) -> DataFrame:
    """One row of each component of `docs`, with all its columns.

    The row with the least doc_id stays (null last), of several such rows the one whose text hashes least. Rows without words
    are linked with nothing and stay. Rows that agree in doc_id and text are one document, so one of them stays.
    """
    sets, edges = link_sets(docs, heat)
    label = components(edges)
    own = F.when(F.col("n_shingles") > 0, F.coalesce("component", "k"))
    placed = sets.join(label, sets["k"] == label["id"], "left").select("doc_id", "h", own.alias("c"))
    first = placed.where("c IS NOT NULL").groupBy("c").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "h")).alias("r"))
    stay = first.select("r.doc_id", "r.h").union(placed.where("c IS NULL").select("doc_id", "h")).distinct()
    stay = materialise(stay.select(_id(F.col("doc_id")).alias("__own_id"), F.col("h").alias("__own_h")), "ngram-stay")
    keys = {"__own_id": _id(docs["doc_id"]), "__own_h": _text_key(docs)}
    return docs.withColumns(keys).join(stay, list(keys)).dropDuplicates(list(keys)).select(*[f"`{c}`" for c in docs.columns])


def _id(doc_id: Column) -> Column:
    return F.coalesce(doc_id.cast("long"), F.lit(-1 << 63))


def _text_key(docs: DataFrame) -> Column:
    """Tells rows of one doc_id apart."""
    return F.xxhash64(docs["text"], docs["doc_id"])
