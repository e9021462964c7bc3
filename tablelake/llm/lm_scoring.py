"""Scoring texts by a word bigram model with deleted interpolation.

P(w | v) mixes the maximum-likelihood estimates of bigram and unigram and the uniform one; the mixture weights depend on how often the
context v was seen (a bucket per power of two) and are learned by expectation-maximisation on counts of held-out training texts.

Texts are dealt into blocks of bounded size. A block asks for the counts of its distinct n-grams, packed by index shard; a shard adds up
what all blocks hold of a key and answers each in its own order. A frequent n-gram is thus one entry per block, and nothing that
grows with the corpus is broadcast or brought to the driver.
"""
from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablelake.llm.common import byte_size, crc32_mod, from_planes, mix, only, pack_sorted, parts, planes, unpack_sorted, word_hashes
from tablelake.session import materialise

#: Text bytes of a block (and about those behind an index shard).
BLOCK_BYTES = 6 << 20
#: Bits of a word's hash and of a bigram's. Word counts are exact but for 64-bit collisions; shorter bigram keys save shuffle, and
#: among n distinct bigrams about n / 2^56 share another's count.
WORD_BITS, PAIR_BITS = 64, 56
#: Of the training texts, one in so many is held out to learn the mixture weights.
HELD_OUT = 10
#: Context buckets (powers of two), and steps per power of two in which estimates are told apart by the weight learning.
BUCKETS, STEPS, LOWEST = 44, 4, 40
ROUNDS = 60
TEST, KEPT, HELD = 0, 1, 2
_END, _START = (mix(np.array([x], np.uint64))[0] for x in (101, 202))


# ---- n-grams of a block (numpy, inside tasks) --------------------------------
def grams(texts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """`(tokens, contexts, where each text's tokens begin)`: words, then one end, by text; the first context is the start."""
    tokens, begins, at = [], [], 0
    for _, words, cuts in word_hashes(texts):
        n = len(cuts) - 1
        ends = cuts[1:] + np.arange(n)  # one more token for each text before
        out = np.empty(len(words) + n, np.uint64)
        out[ends] = _END
        inner = np.ones(len(out), bool)
        inner[ends] = False
        out[inner] = words
        tokens.append(out)
        begins.append(at + cuts[:-1] + np.arange(n))
        at += len(out)
    tokens = np.concatenate(tokens) if tokens else np.zeros(0, np.uint64)
    begins = np.concatenate(begins) if begins else np.zeros(0, np.int64)
    contexts = np.empty_like(tokens)
    contexts[1:] = tokens[:-1]
    contexts[begins] = _START
    return tokens, contexts, begins


def _keys(tokens, contexts, begins):
    """Distinct unigrams (the start among them) and bigrams, ascending, with counts and every token's places in them."""
    single, where, n1 = np.unique(np.concatenate([tokens, contexts[begins]]), return_inverse=True, return_counts=True)
    double, pair, n2 = np.unique(mix(contexts * np.uint64(0x9E3779B97F4A7C15) + tokens) >> np.uint64(WORD_BITS - PAIR_BITS), return_inverse=True, return_counts=True)
    return (single, n1), (double, n2), where[: len(tokens)], pair


def _by_shard(keys: np.ndarray, shards: int, kind: int):
    """Parts of ascending keys by shard, each a range of hashes, so that differences stay small: `(shard, slice)`."""
    top = keys >> np.uint64((WORD_BITS if kind == 1 else PAIR_BITS) - 32)
    shard = ((top * np.uint64(shards)) >> np.uint64(32)).astype(np.int64)
    cuts = np.append(np.flatnonzero(np.diff(shard, prepend=-1)), len(keys))
    return [(int(shard[a]), slice(a, b)) for a, b in zip(cuts, cuts[1:])]


def _ask(shards: int):
    def run(table: pa.Table) -> pa.Table:
        rows = []
        if table.num_rows:
            block, role = table.column("block")[0].as_py(), table.column("role")[0].as_py()
            one, two, _, _ = _keys(*grams(table.column("text")))
            for kind, (keys, counts) in ((1, one), (2, two)):
                for shard, part in _by_shard(keys, shards, kind):
                    rows.append((shard, block, role, kind, part.stop - part.start, pack_sorted(keys[part]) + planes(counts[part].astype(np.uint32))))
        columns = list(zip(*rows)) or [()] * 6
        return pa.table([pa.array(c, f.type) for c, f in zip(columns, ASK_ARROW)], schema=ASK_ARROW)

    return run


ASK = "shard int, block long, role int, kind int, n long, payload binary"
ASK_ARROW = pa.schema([("shard", pa.int32()), ("block", pa.int64()), ("role", pa.int32()), ("kind", pa.int32()), ("n", pa.int64()), ("payload", pa.binary())])
ANSWER = "block long, shard int, kind int, payload binary, tokens long, held_tokens long, words long"
ANSWER_ARROW = pa.schema([("block", pa.int64()), ("shard", pa.int32()), ("kind", pa.int32()), ("payload", pa.binary()), ("tokens", pa.int64()), ("held_tokens", pa.int64()), ("words", pa.int64())])


def _answer(table: pa.Table) -> pa.Table:
    """One shard: counts over all training texts and over the held-out ones, for every block in its own order."""
    out = []
    for kind in (1, 2):
        asked = table.filter(pc.equal(table.column("kind"), kind)).to_pylist()
        if not asked:
            continue
        keys = [unpack_sorted(r["payload"][: 8 * r["n"]]) for r in asked]
        counts = [from_planes(r["payload"][8 * r["n"] :], np.uint32).astype(np.int64) for r in asked]
        every, at = np.unique(np.concatenate(keys), return_inverse=True)
        trained, held = np.zeros(len(every), np.int64), np.zeros(len(every), np.int64)
        cuts = np.cumsum([0, *map(len, keys)])
        for r, c, a, b in zip(asked, counts, cuts, cuts[1:]):
            if r["role"] != TEST:
                trained[at[a:b]] += c
            if r["role"] == HELD:
                held[at[a:b]] += c
        if kind == 1:
            real = every != _START
            out.append((-1, asked[0]["shard"], 0, b"", int(trained[real].sum()), int(held[real].sum()), int((trained[real] > 0).sum())))
        for r, a, b in zip(asked, cuts, cuts[1:]):
            body = planes(trained[at[a:b]]) + (planes(held[at[a:b]]) if r["role"] == HELD else b"")
            out.append((r["block"], r["shard"], kind, body, None, None, None))
    columns = list(zip(*out)) or [()] * 7
    return pa.table([pa.array(c, f.type) for c, f in zip(columns, ANSWER_ARROW)], schema=ANSWER_ARROW)


def _looked_up(texts, answers: pa.Table, shards: int, with_held: bool):
    """Tokens of a block with their counts: `(begins, c(w), c(v), c(vw))`, each an array or a pair (all training, held out)."""
    tokens, contexts, begins = grams(texts)
    one, two, where, pair = _keys(tokens, contexts, begins)
    got = {(r["kind"], r["shard"]): r["payload"] for r in answers.select(["kind", "shard", "payload"]).to_pylist()}

    def counts(kind: int, keys: np.ndarray):
        out = np.zeros((2, len(keys)), np.int64)
        for shard, part in _by_shard(keys, shards, kind):
            payload, n = got[kind, shard], part.stop - part.start
            out[0, part] = from_planes(payload[: 8 * n], np.int64)
            if with_held:
                out[1, part] = from_planes(payload[8 * n :], np.int64)
        return out

    single, double = counts(1, one[0]), counts(2, two[0])
    start = int(np.searchsorted(one[0], _START))
    before = np.empty_like(where)
    before[1:] = where[:-1]
    before[begins] = start
    return begins, single[:, where], single[:, before], double[:, pair]


# ---- mixture weights --------------------------------------------------------
def bucket(count: np.ndarray) -> np.ndarray:
    """0 for contexts never seen, else one more than the power of two of their count."""
    return np.minimum(np.ceil(np.log2(count + 1.0)).astype(np.int64), BUCKETS - 1)


def _step_of(f: np.ndarray) -> np.ndarray:
    """An estimate's step on the log scale; -1 for zero. Below 2^-LOWEST all are one step."""
    with np.errstate(divide="ignore"):
        return np.where(f > 0, np.clip(np.rint(-np.log2(np.where(f > 0, f, 1)) * STEPS), 0, LOWEST * STEPS), -1).astype(np.int64)


def _ratio(a: np.ndarray, b) -> np.ndarray:
    return np.divide(a, b, out=np.zeros(len(a)), where=np.asarray(b) > 0)


def _held_out_steps(shards: int, kept_tokens: int):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        cells = np.zeros((0, 3), np.int64), np.zeros(0, np.int64)
        if left.num_rows and right.num_rows:
            _, w, v, vw = _looked_up(left.column("text"), right, shards, True)
            w, v, vw = (x[0] - x[1] for x in (w, v, vw))  # what the kept texts hold
            cells = np.unique(np.stack([bucket(v), _step_of(_ratio(vw, v)), _step_of(_ratio(w, float(kept_tokens)))], axis=1), axis=0, return_counts=True)
        return pa.table({"b": cells[0][:, 0], "f2": cells[0][:, 1], "f1": cells[0][:, 2], "n": cells[1].astype(np.int64)})

    return run


def learn_weights(cells: np.ndarray, words: int) -> np.ndarray:
    """Mixture weights [bucket, (bigram, unigram, uniform)] by expectation-maximisation over rows `bucket, f2, f1, n`.

    A bucket without held-out tokens keeps the weights of the corpus as a whole.
    """
    uniform = 1.0 / (words + 1)
    size = lambda step: np.where(step < 0, 0.0, np.exp2(-step / STEPS))
    f = np.stack([size(cells[:, 1]), size(cells[:, 2]), np.full(len(cells), uniform)], axis=1)
    n, b = cells[:, 3].astype(float), cells[:, 0]

    def run(of: np.ndarray, rows: int, start: np.ndarray) -> np.ndarray:
        weights = start.copy()
        for _ in range(ROUNDS):
            share = weights[of] * f
            share *= (n / share.sum(axis=1))[:, None]
            total = np.stack([np.bincount(of, share[:, i], rows) for i in range(3)], axis=1) + 1e-3
            weights = total / total.sum(axis=1, keepdims=True)
        return weights

    start = np.full((1, 3), 1 / 3)
    if not len(cells):
        return np.repeat(start, BUCKETS, axis=0)
    whole = run(np.zeros(len(b), np.int64), 1, start)
    weights = np.repeat(whole, BUCKETS, axis=0)
    own = run(b, BUCKETS, weights)
    seen = np.bincount(b, n, BUCKETS) > 0
    weights[seen] = own[seen]
    return weights


# ---- scoring ----------------------------------------------------------------
def _score(shards: int, weights: np.ndarray, tokens: int, words: int):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        n = left.num_rows
        n_tokens, known, base, score = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n), np.zeros(n)
        if n:
            begins, w, v, vw = _looked_up(left.column("text"), right, shards, False)
            w, v, vw = w[0], v[0], vw[0]
            mixed = weights[bucket(v)]
            p = mixed[:, 0] * _ratio(vw, v) + mixed[:, 1] * (w / max(1, tokens)) + mixed[:, 2] / (words + 1)
            n_tokens = np.diff(begins, append=len(w))
            known = np.add.reduceat((w > 0).astype(np.int64), begins)
            base = np.add.reduceat(np.log10((w + 1) / (tokens + words + 1)), begins)
            score = np.add.reduceat(np.log10(p), begins)
        return pa.table({"doc_id": left.column("doc_id"), "held_out": left.column("held_out"), "n_tokens": n_tokens, "n_known": known,
                         "train_tokens": np.full(n, tokens, np.int64), "base_score": base, "score": score})

    return run


def score(docs: DataFrame) -> DataFrame:
    """Every row of `docs` (`doc_id`, `text`) scored by a model of the rows whose crc32(doc_id as text) mod 7 is not 2.

    Returns `doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score`; scores are log10 probabilities of the whole text, whose tokens are
    its lower-cased words and one end. A null text is empty: its one token is the end. A null id is hashed as the
    empty text. Repeated rows count and are scored each. With nothing to learn from, all words are unseen. Other columns are not read.
    """
    spark = docs.sparkSession
    rows = only(docs, "doc_id", "text")
    out = crc32_mod(F.col("doc_id"), 7) == 2
    held = F.pmod(F.xxhash64("doc_id", F.lit("held out")), F.lit(HELD_OUT)) == 0
    rows = rows.select(F.col("doc_id").cast("long"), "text", out.alias("held_out"), F.when(out, TEST).when(held, HELD).otherwise(KEPT).alias("role"))
    sizes = {r["role"]: r["n"] or 0 for r in rows.groupBy("role").agg(F.sum(byte_size(F.col("text")) + 1).alias("n")).collect()}
    total = sum(sizes.values())
    wanted = max(parts(spark), -(-total // BLOCK_BYTES))
    count = {role: max(1, -(-wanted * sizes.get(role, 0) // max(1, total))) for role in (TEST, KEPT, HELD)}
    shards = wanted
    of_role = F.when(F.col("role") == TEST, count[TEST]).when(F.col("role") == HELD, count[HELD]).otherwise(count[KEPT])
    # Blocks of the three roles are numbered apart.
    block = (F.pmod(F.xxhash64("doc_id", F.crc32(F.encode("text", "UTF-8"))), of_role) * 3 + F.col("role")).cast("long")
    dealt = rows.withColumn("block", block)
    asked = dealt.select("block", "role", "text").groupBy("block").applyInArrow(_ask(shards), ASK)
    answers = materialise(asked.groupBy("shard").applyInArrow(_answer, ANSWER), "lm-answers")
    sums = answers.where("block = -1").agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("tokens", "held_tokens", "words")]).first()
    answers = answers.where("block >= 0").select("block", "shard", "kind", "payload")
    steps = dealt.where(F.col("role") == HELD).select("block", "text").groupBy("block").cogroup(answers.where(F.col("block") % 3 == HELD).groupBy("block"))
    steps = steps.applyInArrow(_held_out_steps(shards, sums["tokens"] - sums["held_tokens"]), "b long, f2 long, f1 long, n long")
    # Bounded: at most BUCKETS * (LOWEST * STEPS + 2)^2 cells, whatever the corpus.
    cells = steps.groupBy("b", "f2", "f1").agg(F.sum("n").alias("n")).orderBy("b", "f2", "f1").toPandas().to_numpy(np.int64).reshape(-1, 4)
    weights = learn_weights(cells, sums["words"])
    scored = dealt.select("block", "doc_id", "held_out", "text").groupBy("block").cogroup(answers.groupBy("block"))
    return scored.applyInArrow(_score(shards, weights, sums["tokens"], sums["words"]),
                               "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
