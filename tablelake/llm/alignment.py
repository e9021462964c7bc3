"""Aligning the tokens of two tokenizers over a corpus, with counts of every linked id pair.

Documents are tokenised once, in blocks of bounded size. A block's pair-document records are sorted by id of the second side, then of the first,
cut into a fixed number of radix partitions by that second id, and written as zstd runs: a head (pairs and how often the
block holds them) and a body (which documents hold them). Heads alone are merged k ways, in rounds of bounded width, to corpus-wide counts; their
order puts all pairs of a second-side id together, which gives its highest count on the way. Counts then meet the runs
again, partition by partition, and each run sends its documents' sums back to the block.
"""
from __future__ import annotations

import hashlib
import heapq
import json
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablelake.llm.common import from_planes, only, pack_sorted, planes, unpack_sorted
from tablelake.session import materialise

A_FILE, B_FILE = "/opt/tokenizers/byte_bpe_50k.json", "/opt/tokenizers/piece_bpe_32k.model"
#: Characters of a block's texts (one longer text is a block of its own), and bits of a document's number in it.
BLOCK_CHARS, DOC_BITS = 8 << 20, 20
#: Radix partitions of the pairs (a power of two): fixed, as ids are bounded by the vocabularies.
RADIX_BITS = 6
#: Bits of an id in a pair.
ID_BITS = 20
#: Runs merged in one task, and runs that meet the counts in one task.
FAN, RUNS = 64, 256
#: Pairs of a run looked at in one step of a merge.
STEP = 1 << 16
#: Units whose tokens a task remembers between blocks; beyond that it starts anew.
REMEMBERED = 300_000
MARK = "▁"
#: The byte-level tokenizer's cut of a text into words, and the characters below which all Unicode tables agree on it.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
LATIN_END = "ɐ"


# ---- two tokenizers --------------------------------------------------------------
def _byte_of_character() -> dict[str, int]:
    """The byte-level alphabet: printable bytes stand for themselves, the others for characters from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


class Pair:
    """Both tokenizers: ids of texts, and how many bytes each id stands for. Loaded once per worker; files are not copied."""

    def __init__(self, a_file: str, b_file: str):
        import sentencepiece
        import tiktoken
        import tokenizers

        self.slow = tokenizers.Tokenizer.from_file(a_file)
        self.slow.encode_special_tokens = True  # their strings in a text are plain text
        with open(a_file, encoding="utf-8") as file:
            model = json.load(file)["model"]
        byte_of = _byte_of_character()
        self.a_bytes = {i: bytes(byte_of[c] for c in piece) for piece, i in model["vocab"].items()}
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        # Ids in the order of the merges make both libraries merge alike.
        ranked = all(model["vocab"][x + y] == 256 + i for i, (x, y) in enumerate(merges))
        self.fast = tiktoken.Encoding("a", pat_str=WORDS, mergeable_ranks={b: i for i, b in self.a_bytes.items()}, special_tokens={}) if ranked else None
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_file)
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.b_bytes = {i: bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace(MARK, " ").encode() for i, p in enumerate(pieces)}
        self.b_space = self.b.piece_to_id(MARK)
        #: Whether no piece goes on over a space after anything else, so that texts can be cut there.
        self.cuts = not any(re.search(f"[^{MARK}]{MARK}", p) for p in pieces)

    def a_ids(self, text: str) -> list[int]:
        if self.fast is not None and (text.isascii() or max(text) < LATIN_END):
            return self.fast.encode_ordinary(text)
        return self.slow.encode(text, add_special_tokens=False).ids

    def b_ids(self, texts: list[str]) -> list[list[int]]:
        """Ids of texts that begin with a space, which the tokenizer adds itself."""
        out = self.b.encode([t[1:] for t in texts], num_threads=1)
        return [ids if len(t) > 1 else [self.b_space] for t, ids in zip(texts, out)]

    def units(self, text: str) -> list[str]:
        """A text (with its leading space) cut before spaces that follow anything but white space: neither tokenizer has a token across."""
        if not self.cuts:
            return [text]
        if re.search(r"\s ", text):
            return re.split(r"(?<=\S)(?= )", text)
        return [" " + word for word in text[1:].split(" ")]


class Units(dict):
    """Numbers of units, given on first sight, with their tokens, groups and links once `learn` has run."""

    def __init__(self, pair: Pair):
        super().__init__()
        self.pair, self.new = pair, []
        self.groups: list[str] = []
        self.n_a = self.n_b = self.n_links = self.start = np.zeros(0, np.int64)
        self.sound = np.zeros(0, bool)
        self.links = np.zeros(0, np.uint64)

    def __missing__(self, unit: str) -> int:
        self[unit] = number = len(self)
        self.new.append(unit)
        return number

    def learn(self) -> None:
        """Tokens, groups and links of the units met since the last call."""
        new, self.new = self.new, []
        pair, seen, links, groups = self.pair, [], [], []
        bytes_a, bytes_b = pair.a_bytes, pair.b_bytes
        for unit, x, y in zip(new, map(pair.a_ids, new), pair.b_ids(new)):
            text = unit.encode()
            if b"".join(map(bytes_b.__getitem__, y)) != text or b"".join(map(bytes_a.__getitem__, x)) != text:
                seen.append((0, 0, 0, False))
                groups.append("")
                continue
            if len(x) == 1 or len(y) == 1:
                cut = [(x, y)]
            else:
                cut = list(_cut(x, y, [len(bytes_a[i]) for i in x], [len(bytes_b[i]) for i in y]))
            groups.append(";".join([f"{','.join(map(str, p))}|{','.join(map(str, q))}" for p, q in cut]))
            links += [q[-1] << ID_BITS | p[-1] for p, q in cut]
            seen.append((len(x), len(y), len(cut), True))
        if not new:
            return
        n_a, n_b, n_links, sound = (np.array(c) for c in zip(*seen))
        start = np.cumsum(n_links) - n_links + len(self.links)
        for name, add in (("n_a", n_a), ("n_b", n_b), ("n_links", n_links), ("sound", sound), ("start", start), ("links", np.array(links, np.uint64))):
            setattr(self, name, np.concatenate([getattr(self, name), add]))
        self.groups += groups


def _cut(x: list[int], y: list[int], of_x: list[int], of_y: list[int]) -> Iterator[tuple[list[int], list[int]]]:
    """Groups of two id lists of equally many bytes, cut where tokens of both end."""
    p = q = i = j = end_x = end_y = 0
    while i < len(x):
        end_x += of_x[i]
        i += 1
        while end_y < end_x:
            end_y += of_y[j]
            j += 1
        if end_x == end_y:
            yield x[p:i], y[q:j]
            p, q = i, j


# ---- runs ------------------------------------------------------------------------
_COUNT = np.int64


def _squeeze(*parts: bytes) -> bytes:
    return zstandard.ZstdCompressor(level=3).compress(b"".join(len(p).to_bytes(8, "little") + p for p in parts))


def _parts(packed: bytes) -> list[bytes]:
    data, out, at = zstandard.ZstdDecompressor().decompress(packed), [], 0
    while at < len(data):
        n = int.from_bytes(data[at : at + 8], "little")
        out.append(data[at + 8 : at + 8 + n])
        at += 8 + n
    return out


def pack_head(pairs: np.ndarray, counts: np.ndarray) -> bytes:
    return _squeeze(pack_sorted(pairs), planes(counts.astype(_COUNT)))


def unpack_head(packed: bytes) -> tuple[np.ndarray, np.ndarray]:
    pairs, counts = _parts(packed)
    return unpack_sorted(pairs), from_planes(counts, _COUNT)


def runs(pairs: np.ndarray, docs: np.ndarray) -> Iterator[tuple[int, bytes, bytes]]:
    """`(radix, head, body)` of a block's links, an entry each: sorted by radix of the second id, second id, first id, document."""
    radix = (pairs >> np.uint64(ID_BITS)) & np.uint64((1 << RADIX_BITS) - 1)
    # Radix and second id share bits: the id's upper bits follow the radix.
    upper = pairs >> np.uint64(ID_BITS + RADIX_BITS)
    key = ((radix << np.uint64(ID_BITS - RADIX_BITS) | upper) << np.uint64(ID_BITS) | pairs & np.uint64((1 << ID_BITS) - 1)) << np.uint64(DOC_BITS) | docs.astype(np.uint64)
    record, times = np.unique(key, return_counts=True)
    pair, doc = record >> np.uint64(DOC_BITS), (record & np.uint64((1 << DOC_BITS) - 1)).astype(np.int64)
    of = (pair >> np.uint64(2 * ID_BITS - RADIX_BITS)).astype(np.int64)
    cuts = np.append(np.flatnonzero(np.diff(of, prepend=-1)), len(of))
    for a, b in zip(cuts, cuts[1:]):
        firsts = np.flatnonzero(np.diff(pair[a:b], prepend=np.uint64(0xFFFFFFFFFFFFFFFF)))
        held = np.diff(np.append(firsts, b - a))
        steps = np.diff(doc[a:b], prepend=0)
        steps[firsts] = doc[a:b][firsts]
        body = _squeeze(planes(held.astype(np.uint32)), planes(steps.astype(np.uint32)), planes(times[a:b].astype(np.uint32)))
        yield int(of[a]), pack_head(pair[a:b][firsts], np.add.reduceat(times[a:b], firsts)), body


def unpack_body(packed: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """`(place of each record's pair in the head, document, times)`."""
    held, steps, times = (from_planes(p, np.uint32).astype(np.int64) for p in _parts(packed))
    upto = np.cumsum(steps)
    firsts = np.cumsum(held) - held
    before = np.repeat(upto[firsts] - steps[firsts], held)
    return np.repeat(np.arange(len(held)), held), upto - before, times


def merged(heads: Iterable[tuple[np.ndarray, np.ndarray]]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """k-way merge of ascending pairs with counts, in ascending stretches.

    A heap holds the last pair of each run's next stretch; up to the least of these all runs are complete.
    """
    held = [h for h in heads if len(h[0])]
    at = [0] * len(held)
    heap = [(int(pairs[min(STEP, len(pairs)) - 1]), r) for r, (pairs, _) in enumerate(held)]
    heapq.heapify(heap)
    while heap:
        bound = heap[0][0]
        taken = []
        for r, (pairs, counts) in enumerate(held):
            end = at[r] + int(np.searchsorted(pairs[at[r] : at[r] + STEP], np.uint64(bound), "right"))
            if end > at[r]:
                taken.append((pairs[at[r] : end], counts[at[r] : end]))
                at[r] = end
        while heap and heap[0][0] == bound:
            _, r = heapq.heappop(heap)
            if at[r] < len(held[r][0]):
                heapq.heappush(heap, (int(held[r][0][min(at[r] + STEP, len(held[r][0])) - 1]), r))
        pairs, where = np.unique(np.concatenate([p for p, _ in taken]), return_inverse=True)
        counts = np.zeros(len(pairs), _COUNT)
        np.add.at(counts, where, np.concatenate([c for _, c in taken]))
        yield pairs, counts


# ---- tasks -----------------------------------------------------------------------
BLOCK_ARROW = pa.schema([("block", pa.int64()), ("doc", pa.int32()), ("doc_id", pa.int64()), ("n_a", pa.int64()), ("n_b", pa.int64()), ("n_links", pa.int64()),
                         ("sha", pa.binary()), ("radix", pa.int32()), ("head", pa.binary()), ("body", pa.binary())])
BLOCK = "block long, doc int, doc_id long, n_a long, n_b long, n_links long, sha binary, radix int, head binary, body binary"


def _table(rows: list[tuple], schema: pa.Schema) -> pa.Table:
    columns = list(zip(*rows)) or [()] * len(schema)
    return pa.table([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)


def tokenised(block: int, ids: list, texts: list, units: Units) -> pa.Table:
    """One row per document and one per run of a block."""
    numbers, cuts = [], [0]
    for text in texts:
        if text:
            numbers += map(units.__getitem__, units.pair.units(" " + text))
        cuts.append(len(numbers))
    units.learn()
    number, doc = np.array(numbers, np.int64), np.repeat(np.arange(len(texts)), np.diff(cuts))
    sound = np.bincount(doc[~units.sound[number]], minlength=len(texts)) == 0
    kept = sound[doc]
    sums = [np.bincount(doc[kept], held[number[kept]], len(texts)).astype(np.int64).tolist() for held in (units.n_a, units.n_b, units.n_links)]
    name = units.groups.__getitem__
    shas = [hashlib.sha256(";".join(map(name, numbers[a:b])).encode()).digest() if b > a and good else None for a, b, good in zip(cuts, cuts[1:], sound)]
    rows = [(block, d, i, *x, None, None, None) for d, (i, *x) in enumerate(zip(ids, *sums, shas))]
    times = units.n_links[number] * kept
    upto = np.cumsum(times)
    place = np.repeat(units.start[number] - upto + times, times) + np.arange(upto[-1] if len(upto) else 0)
    rows += [(block, *[None] * 6, *run) for run in runs(units.links[place], np.repeat(doc, times))]
    return _table(rows, BLOCK_ARROW)


def _blocks(a_file: str, b_file: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair, units, number = None, None, TaskContext.get().partitionId() << 32
        ids, texts, size = [], [], 0

        def flush():
            nonlocal pair, units, number, ids, texts, size
            pair = pair or Pair(a_file, b_file)
            units = units if units is not None and len(units) < REMEMBERED else Units(pair)
            yield from tokenised(number, ids, texts, units).to_batches()
            ids, texts, size, number = [], [], 0, number + 1

        for batch in batches:
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                text = text.as_py()
                ids.append(i)
                texts.append(text)
                size += len(text or "")
                if size >= BLOCK_CHARS or len(ids) >> DOC_BITS:
                    yield from flush()
        if ids:
            yield from flush()

    return run


HEAD_ARROW = pa.schema([("radix", pa.int32()), ("part", pa.int64()), ("head", pa.binary())])


def _merge_heads(key: tuple, table: pa.Table) -> pa.Table:
    stretches = list(merged(unpack_head(h.as_py()) for h in table.column("head")))
    head = pack_head(*(np.concatenate(x) for x in zip(*stretches)))
    return _table([(key[0].as_py(), key[1].as_py(), head)], HEAD_ARROW)


SUM_ARROW = pa.schema([("block", pa.int64()), ("sums", pa.binary())])


def _contributions(left: pa.Table, right: pa.Table) -> pa.Table:
    """Runs of one radix partition with its counts: for each run, its documents' sums of counts and numbers of best links."""
    rows = []
    if left.num_rows:
        pairs, counts = unpack_head(right.column("head")[0].as_py())
        second = pairs >> np.uint64(ID_BITS)
        firsts = np.flatnonzero(np.diff(second, prepend=np.uint64(0xFFFFFFFFFFFFFFFF)))
        most = np.repeat(np.maximum.reduceat(counts, firsts), np.diff(np.append(firsts, len(pairs))))
        best = counts == most
        for block, head, body in zip(*(left.column(c) for c in ("block", "head", "body"))):
            place, doc, times = unpack_body(body.as_py())
            at = np.searchsorted(pairs, unpack_head(head.as_py())[0])[place]
            docs, where = np.unique(doc, return_inverse=True)
            total, good = np.zeros(len(docs), np.int64), np.zeros(len(docs), np.int64)
            np.add.at(total, where, counts[at] * times)
            np.add.at(good, where, best[at] * times)
            rows.append((block.as_py(), _squeeze(pack_sorted(docs.astype(np.uint64)), planes(total), planes(good))))
    return _table(rows, SUM_ARROW)


RESULT = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"


def _finished(left: pa.Table, right: pa.Table) -> pa.Table:
    """Documents of a block with the sums that its runs sent back."""
    total, good = np.zeros(left.num_rows, np.int64), np.zeros(left.num_rows, np.int64)
    for packed in right.column("sums"):
        docs, sums, bests = _parts(packed.as_py())
        at = unpack_sorted(docs).astype(np.int64)
        total[at] += from_planes(sums, np.int64)
        good[at] += from_planes(bests, np.int64)
    doc = left.column("doc").to_numpy()
    sha = pa.array([s.hex() if s else "" for s in left.column("sha").to_pylist()], pa.string())
    links = left.column("n_links")
    return pa.table([left.column("doc_id"), left.column("n_a"), left.column("n_b"), links, links, pa.array(good[doc]), pa.array(total[doc]), sha],
                    names=["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"])


def align(docs: DataFrame, a_file: str = A_FILE, b_file: str = B_FILE) -> DataFrame:
    """Tokens of every text of `docs` (`doc_id`, `text`) by two tokenizers, cut into groups where tokens of both end.

    Returns `doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256` for every row. A link joins the two tokens that end a group, so there are
    as many links as groups. `count_sum` adds up, over a document's links, how often the corpus links that id pair; `n_best` counts the
    links whose pair is the most frequent of its second id, ties included. Texts that are null, empty, or that a tokenizer does not spell
    byte by byte (such as those with U+2581) have zeros and an empty checksum. Null ids and repeated rows are documents like others. An empty table
    gives no rows. Extra columns are not read.
    """
    docs = only(docs, "doc_id", "text").select(F.col("doc_id").cast("long"), "text")
    table = materialise(docs.mapInArrow(_blocks(a_file, b_file), BLOCK), "align-blocks")
    held = table.where("radix IS NOT NULL").select("block", "radix", "head", "body")
    blocks = table.agg(F.count_distinct("block")).first()[0]
    heads, left = held.select("radix", F.xxhash64("block").alias("part"), "head"), blocks
    while True:
        left = max(1, -(-left // FAN))
        heads = heads.select("radix", F.pmod("part", F.lit(left)).alias("part"), "head").groupBy("radix", "part").applyInArrow(_merge_heads, "radix int, part long, head binary")
        if left <= 1:
            break
    counts = materialise(heads, "align-counts")
    salts = max(1, -(-blocks // RUNS))
    salted = held.withColumn("salt", F.pmod(F.xxhash64("block"), F.lit(salts)).cast("int")).groupBy("radix", "salt")
    spread = counts.select("radix", "head", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt")).groupBy("radix", "salt")
    sums = salted.cogroup(spread).applyInArrow(_contributions, "block long, sums binary")
    documents = table.where("radix IS NULL").select("block", "doc", "doc_id", "n_a", "n_b", "n_links", "sha")
    return documents.groupBy("block").cogroup(sums.groupBy("block")).applyInArrow(_finished, RESULT)
