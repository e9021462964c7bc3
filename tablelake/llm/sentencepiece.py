"""SentencePiece encoding and decoding by shared-prefix Viterbi.

A text is cut into marked words (a run of word marks and what follows). The distinct marked words of a batch are sorted, which
is the depth-first order of their trie; forward scores are kept per character, and a word goes on from the prefix it shares with the word
before. Blocks of words take the same steps together, one place in the words after the other; long words go one by one. Segmentation maximises the sum of the vocabulary's piece scores; characters without a piece become byte pieces.
"""
from __future__ import annotations

import re
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablelake.llm.common import gathered, only

MARK = "▁"
MODEL = "/opt/tokenizers/piece_bpe_32k.model"
#: Marked words whose pieces a task remembers between batches; beyond that it starts anew.
REMEMBERED = 300_000
#: An unknown character scores so much less than the worst piece.
PENALTY = 10.0
#: Words up to this many characters are segmented in blocks of so many words; fewer than SINGLY go one by one.
SHORT, BLOCK, SINGLY = 48, 16_384, 64
_WORD = re.compile(f"{MARK}+[^{MARK}]*")
_SPREAD = np.uint64(0x9E3779B97F4A7C15)


class Suffixes:
    """Trie of the pieces read from their ends, as a hash table from (node, character) to node, with each node's score and piece id."""

    def __init__(self, ids: dict[str, int], scores: dict[str, float]):
        nodes, self.score, self.piece = {}, [-np.inf], [-1]
        for piece, i in ids.items():
            at = 0
            for c in reversed(piece):
                at = nodes.setdefault(at << 21 | ord(c), len(nodes) + 1)
                if at == len(self.score):
                    self.score.append(-np.inf)
                    self.piece.append(-1)
            self.score[at], self.piece[at] = scores[piece], i
        self.score, self.piece = np.array(self.score), np.array(self.piece, np.int32)
        size = max(4, (4 * len(nodes)).bit_length())
        self.shift = np.uint64(64 - size)
        self.keys, self.to = np.full(1 << size, -1), np.zeros(1 << size, np.int32)
        keys, to = np.array([*nodes], np.int64), np.array([*nodes.values()], np.int32)
        slots = self._slots(keys)
        while len(keys):
            free = self.keys[slots] < 0
            _, first = np.unique(np.where(free, slots, -1 - np.arange(len(slots))), return_index=True)
            first = first[free[first]]
            self.keys[slots[first]], self.to[slots[first]] = keys[first], to[first]
            left = np.ones(len(keys), bool)
            left[first] = False
            keys, to, slots = keys[left], to[left], (slots[left] + 1) & (len(self.keys) - 1)

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        return (keys.view(np.uint64) * _SPREAD >> self.shift).astype(np.int64)

    def step(self, nodes: np.ndarray, characters: np.ndarray) -> np.ndarray:
        """The nodes that `characters` lead to; 0: none."""
        keys = nodes << 21 | characters
        slots = self._slots(keys)
        found = self.keys[slots]
        out = np.where(found == keys, self.to[slots], 0).astype(np.int64)
        going = np.flatnonzero((found != keys) & (found >= 0))
        while len(going):
            slots[going] = (slots[going] + 1) & (len(self.keys) - 1)
            found = self.keys[slots[going]]
            hit = found == keys[going]
            out[going[hit]] = self.to[slots[going[hit]]]
            going = going[~hit & (found >= 0)]
        return out


@dataclass
class Vocabulary:
    """Scored pieces, byte pieces, and what each id stands for. Its size is the vocabulary's, whatever the texts."""

    ids: dict[str, int]
    scores: dict[str, float]
    byte_ids: list[int]
    surface: list[bytes]
    longest: int
    unknown: float
    suffixes: Suffixes = field(init=False)

    def __post_init__(self):
        self.suffixes = Suffixes(self.ids, self.scores)

    @classmethod
    def load(cls, path: str = MODEL) -> Vocabulary:
        """Reads a model with byte pieces and an identity normaliser; its path is a parameter, the file is not copied."""
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        ids, scores, byte_ids, surface = {}, {}, [0] * 256, []
        for i in range(model.get_piece_size()):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                byte_ids[int(piece[3:5], 16)] = i
                surface.append(bytes([int(piece[3:5], 16)]))
            elif model.is_control(i) or model.is_unknown(i):
                surface.append(b"")
            else:
                ids[piece], scores[piece] = i, model.get_score(i)
                surface.append(piece.replace(MARK, " ").encode())
        return cls(ids, scores, byte_ids, surface, max(map(len, ids)), min(scores.values()) - PENALTY)


def marked_words(text: str) -> list[str]:
    return _WORD.findall(MARK + text.replace(" ", MARK)) if text else []


def unmarked_words(text: str) -> list[str]:
    """Marked words without their first mark. Between single spaces, and without other marks, they are what lies between."""
    if MARK in text or "  " in text or text[:1] in ("", " ") or text[-1] == " ":
        return [w[1:] for w in marked_words(text)]
    return text.split(" ")


def segment(words: list[str], vocabulary: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all words end to end, and how many each word has; words ascend. Equal sums go to the segmentation whose last pieces are longest."""
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    counts, found, order = np.zeros(len(words), np.int64), [], []
    short, long = np.flatnonzero(sizes <= SHORT), np.flatnonzero(sizes > SHORT)
    blocks = [(short[low : low + BLOCK], _together) for low in range(0, len(short), BLOCK)]
    for rows, way in [(rows, way if len(rows) >= SINGLY else _singly) for rows, way in [*blocks, (long, _singly)]]:
        if len(rows):
            ids, counts[rows] = way([words[i] for i in rows.tolist()], vocabulary)
            found.append(ids)
            order.append(rows)
    if not order:
        return np.zeros(0, np.int32), counts
    ids, order = np.concatenate(found), np.concatenate(order)
    return (ids if len(found) == 1 else ids[np.argsort(np.repeat(order, counts[order]), kind="stable")]), counts


def _singly(words: list[str], vocabulary: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    scores, longest, unknown = vocabulary.scores, vocabulary.longest, vocabulary.unknown
    best, back, before, out, counts = [0.0], [0], "", [], []
    for word in words:
        shared, limit = 0, min(len(word), len(before))
        while shared < limit and word[shared] == before[shared]:
            shared += 1
        del best[shared + 1 :], back[shared + 1 :]
        for end in range(shared + 1, len(word) + 1):
            top, at = best[end - 1] + unknown, end - 1
            for start in range(end - 1, max(0, end - longest) - 1, -1):
                score = scores.get(word[start:end])
                if score is not None and (score := score + best[start]) >= top:
                    top, at = score, start
            best.append(top)
            back.append(at)
        before = word
        ids = _pieces(word, back, vocabulary)
        out += ids
        counts.append(len(ids))
    return np.array(out, np.int32), np.array(counts, np.int64)


def _pieces(word: str, back: list[int], vocabulary: Vocabulary) -> list[int]:
    out, end, ids = [], len(word), vocabulary.ids
    while end:
        start = back[end]
        piece = word[start:end]
        if piece in ids:
            out.append(ids[piece])
        else:
            out.extend(vocabulary.byte_ids[b] for b in reversed(piece.encode()))
        end = start
    return out[::-1]


def _together(words: list[str], vocabulary: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """As `_singly`, for words of up to SHORT characters at once: the scores of one place after the other, for all words."""
    suffixes, n = vocabulary.suffixes, len(words)
    lengths = np.fromiter(map(len, words), np.int64, n)
    most = int(lengths.max())
    letters = np.full((n, most), -1, np.int64)
    letters[np.arange(most) < lengths[:, None]] = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
    letters = np.ascontiguousarray(letters.T)
    shared = np.zeros(n, np.int64)  # with the word before
    shared[1:] = np.logical_and.accumulate((letters[:, 1:] == letters[:, :-1]) & (letters[:, 1:] >= 0), axis=0).sum(axis=0)
    single = np.array(vocabulary.byte_ids[:128], np.int32)  # of a character without a piece that is one byte
    best, back, piece = np.zeros((most + 1, n)), np.zeros((most + 1, n), np.int8), np.full((most + 1, n), -1, np.int32)
    for end in range(1, most + 1):
        new = (shared < end) & (lengths >= end)
        live = rows = np.flatnonzero(new)
        if not len(rows):
            continue
        letter = letters[end - 1][rows]
        top, at = best[end - 1][rows] + vocabulary.unknown, np.full(len(rows), end - 1, np.int8)
        own = np.where(letter < 128, single[np.minimum(letter, 127)], -1).astype(np.int32)
        to, nodes = np.arange(len(rows)), np.zeros(len(rows), np.int64)
        for start in range(end - 1, max(0, end - vocabulary.longest) - 1, -1):
            nodes = suffixes.step(nodes, letters[start][live])
            on = np.flatnonzero(nodes)
            if not len(on):
                break
            nodes, to, live = nodes[on], to[on], live[on]
            score = suffixes.score[nodes] + best[start][live]
            better = np.flatnonzero(score >= top[to])
            into = to[better]
            top[into], at[into], own[into] = score[better], start, suffixes.piece[nodes[better]]
        # A word has the scores of the last word that was new at this place.
        last = np.maximum(np.cumsum(new) - 1, 0)
        best[end], back[end], piece[end] = top[last], at[last], own[last]
    # Pieces from the last to the first, all words together.
    who, ends, found, plain = np.arange(n), lengths, [], np.ones(n, bool)
    while len(who):
        ids = piece[ends, who]
        plain[who[ids < 0]] = False
        found.append((who, ids))
        ends = back[ends, who].astype(np.int64)
        who, ends = who[ends > 0], ends[ends > 0]
    who, ids = (np.concatenate(x)[::-1] for x in zip(*found))
    order = np.argsort(who, kind="stable")
    who, ids, counts = who[order], ids[order], np.bincount(who, minlength=n)
    if plain.all():
        return ids, counts
    other = {i: _pieces(words[i], back[: lengths[i] + 1, i].tolist(), vocabulary) for i in np.flatnonzero(~plain).tolist()}
    counts[[*other]] = [len(x) for x in other.values()]
    out, kept = np.zeros(counts.sum(), np.int32), np.repeat(plain, counts)
    out[kept], out[~kept] = ids[plain[who]], np.fromiter(chain.from_iterable(other.values()), np.int32)
    return out, counts


def _taken(ids: np.ndarray, counts: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """The ids of `rows`, end to end."""
    many = counts[rows]
    before = (np.cumsum(counts) - counts)[rows] - (np.cumsum(many) - many)
    return ids[np.repeat(before, many) + np.arange(many.sum())]


class Encoder:
    """Encodes batches of texts, and remembers the pieces of marked words up to a bound."""

    def __init__(self, vocabulary: Vocabulary, remembered: int = REMEMBERED):
        self.vocabulary, self.remembered = vocabulary, remembered
        #: Row of each word without its first mark; the ids of all rows end to end, and how many each row has.
        self.known, self.ids, self.counts = {}, np.zeros(0, np.int32), np.zeros(0, np.int64)

    def encode(self, texts: list[str | None]) -> list[np.ndarray | None]:
        cut = [None if t is None else unmarked_words(t) for t in texts]
        words = [w for some in cut if some for w in some]
        distinct = set(words)
        if len(self.known) > self.remembered:  # what these texts hold stays
            kept = [w for w in distinct if w in self.known]
            rows = np.array([self.known[w] for w in kept], np.int64)
            self.ids, self.counts = _taken(self.ids, self.counts, rows), self.counts[rows]
            self.known = dict(zip(kept, range(len(kept))))
        new = sorted(distinct.difference(self.known))
        ids, counts = segment([MARK + w for w in new], self.vocabulary)
        self.known.update(zip(new, range(len(self.known), len(self.known) + len(new))))
        self.ids, self.counts = np.concatenate([self.ids, ids]), np.concatenate([self.counts, counts])
        rows = np.fromiter(map(self.known.__getitem__, words), np.int64, len(words))
        ends = np.concatenate([[0], np.cumsum(self.counts[rows])])
        all_ids = _taken(self.ids, self.counts, rows)
        out, at = [], 0
        for some in cut:
            out.append(None if some is None else all_ids[ends[at] : ends[at + len(some)]])
            at += len(some or ())
        return out

    def decode(self, ids: Iterable[int]) -> str:
        surface = self.vocabulary.surface
        text = b"".join([surface[i] for i in ids]).decode("utf-8", "replace")
        return text.removeprefix(" ")


def encode_column(docs: DataFrame, model: str = MODEL, name: str = "token_ids") -> DataFrame:
    """`docs` with `name`, the piece ids of `text`: null for a null text, empty for an empty one. All rows and columns stay.

    A column of that name that is there already is an error, not overwritten.
    """
    if name in docs.columns:
        raise ValueError(f"{name} is a column already")
    encoder = Encoder(Vocabulary.load(model))

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series(encoder.encode([None if t is None else t for t in texts]), dtype=object)

    run.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return docs.withColumn(name, F.pandas_udf(run, "array<int>")(docs["text"]))


def decode_column(docs: DataFrame, model: str = MODEL, ids: str = "token_ids", name: str = "decoded") -> DataFrame:
    """`docs` with `name`, the text that the ids stand for; null for null ids."""
    encoder = Encoder(Vocabulary.load(model))

    def run(rows: pd.Series) -> pd.Series:
        return pd.Series([None if r is None else encoder.decode(r) for r in rows], dtype=object)

    run.__annotations__ = {"rows": pd.Series, "return": pd.Series}
    return docs.withColumn(name, F.pandas_udf(run, "string")(docs[ids]))


def round_trips(docs: DataFrame, model: str = MODEL) -> DataFrame:
    """Digest of encoding and decoding every row of `docs` (`doc_id`, `text`).

    Returns `doc_id, n_words, n_pieces, ids_crc32` (of the ids as little-endian 32-bit numbers) and `exact`, whether decoding gives
    the text again, as it does unless the text holds the word mark itself. A null text has nulls and is exact. Repeated rows give
    equal results; other columns are not read.
    """
    encoder = Encoder(Vocabulary.load(model))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in gathered(batches, 4 << 20):
            texts = batch.column(1).to_pylist()
            ids = encoder.encode(texts)
            some = [x is not None for x in ids]
            yield pa.RecordBatch.from_arrays([
                batch.column(0),
                pa.array([(t.count(" ") + 1 if t else 0) if s else None for t, s in zip(texts, some)], pa.int64()),
                pa.array([len(x) if s else None for x, s in zip(ids, some)], pa.int64()),
                pa.array([zlib.crc32(x.tobytes()) if s else None for x, s in zip(ids, some)], pa.int64()),
                pa.array([encoder.decode(x.tolist()) == t if s else True for x, t, s in zip(ids, texts, some)])],
                ["doc_id", "n_words", "n_pieces", "ids_crc32", "exact"])

    rows = only(docs, "doc_id", "text")
    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, n_words long, n_pieces long, ids_crc32 long, exact boolean")
