"""Language identification by a bidirectional gated recurrent network over bytes.

The network reads a text in windows of WINDOW bytes, both ways, and labels every position; a text's probabilities are the mean
over its positions. It is trained here in numpy by backpropagation through time on windows of a bounded sample of labelled
rows. Gates and candidates use the softsign x / (1 + |x|), which numpy computes much faster than tanh.
"""
from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablelake.llm.common import crc32_mod, only, text_bytes

WINDOW = 64
HIDDEN = 8
#: Windows worked on together.
BATCH = 4096
#: Bounded training sample: rows per language, and windows of each.
ROWS_PER_LANGUAGE, WINDOWS_PER_ROW = 240, 4
EPOCHS = 6
SEED = 20
#: Pooled probability under which the pipeline rejects a text.
LEAST_SCORE = 0.4
UNKNOWN = "und"


def _soft(x: np.ndarray) -> np.ndarray:
    return x / (1 + np.abs(x))


def _slope(y: np.ndarray) -> np.ndarray:
    """Derivative of the softsign by its value."""
    return (1 - np.abs(y)) ** 2


@dataclass
class Network:
    """Weights of both directions (first axis) and of the output; `names` are the languages."""

    names: list[str]
    inputs: np.ndarray  # [2, 256, 3H]: what a byte adds to update, reset and candidate
    recur: np.ndarray  # [2, 3H, H]
    bias: np.ndarray  # [2, H, 1]: recurrent part of the candidate
    out: np.ndarray  # [L, 2H]
    out_bias: np.ndarray  # [L, 1]

    def parameters(self) -> list[np.ndarray]:
        return [self.inputs, self.recur, self.bias, self.out, self.out_bias]


def fresh(names: list[str], seed: int = SEED) -> Network:
    rng, h = np.random.default_rng(seed), HIDDEN
    draw = lambda *shape: (rng.standard_normal(shape) * 0.3).astype(np.float32)
    return Network(names, draw(2, 256, 3 * h), draw(2, 3 * h, h), draw(2, h, 1), draw(len(names), 2 * h), np.zeros((len(names), 1), np.float32))


def _step(net: Network, d: int, column: np.ndarray, h: np.ndarray):
    """One position of one direction: new state and what its gradient needs. Arrays are [features, windows]."""
    n = HIDDEN
    x = net.inputs[d][column].T
    u = net.recur[d] @ h
    gate = 0.5 + 0.5 * _soft(x[: 2 * n] + u[: 2 * n])
    z, r = gate[:n], gate[n:]
    inner = u[2 * n :] + net.bias[d]
    c = _soft(x[2 * n :] + r * inner)
    return c + z * (h - c), (z, r, c, inner, h)


def _states(net: Network, windows: np.ndarray, keep: bool):
    """States of every position, [2, T, H, N]; saved parts of every step if `keep`."""
    steps, n = windows.shape[1], len(windows)
    states, saved = np.empty((2, steps, HIDDEN, n), np.float32), []
    for d in (0, 1):
        h = np.zeros((HIDDEN, n), np.float32)
        for t in range(steps) if d == 0 else range(steps - 1, -1, -1):
            h, parts = _step(net, d, windows[:, t], h)
            states[d, t] = h
            if keep:
                saved.append((d, t, parts))
    return states, saved


def _softmax(logits: np.ndarray) -> np.ndarray:
    e = np.exp(logits - logits.max(axis=-2, keepdims=True))
    return e / e.sum(axis=-2, keepdims=True)


def probabilities(net: Network, windows: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Summed label probabilities of each window's first `lengths` positions, [N, L].

    The same steps as in `_states`, worked in place. The backward direction starts at the window's end, where shorter windows
    hold zeros.
    """
    n, h = len(windows), HIDDEN
    columns = np.ascontiguousarray(windows.T)
    states = np.empty((len(columns), 2 * h, n), np.float32)
    x, u, size = np.empty((3 * h, n), np.float32), np.empty((3 * h, n), np.float32), np.empty((2 * h, n), np.float32)
    for d in (0, 1):
        inputs, recur, state = np.ascontiguousarray(net.inputs[d].T), net.recur[d], np.zeros((h, n), np.float32)
        gate, small = x[: 2 * h], size[:h]
        c, z, r = u[2 * h :], x[:h], x[h : 2 * h]
        for t in range(len(columns)) if d == 0 else range(len(columns) - 1, -1, -1):
            np.take(inputs, columns[t], axis=1, out=x, mode="clip")
            np.matmul(recur, state, out=u)
            gate += u[: 2 * h]
            np.abs(gate, out=size)
            size += 1
            gate /= size
            gate *= 0.5
            gate += 0.5
            c += net.bias[d]
            c *= r
            c += x[2 * h :]
            np.abs(c, out=small)
            small += 1
            c /= small
            state -= c
            state *= z
            state += c
            states[t, d * h : (d + 1) * h] = state
    p = np.matmul(net.out, states)  # [T, L, N]; states lie between -1 and 1, so no exponential overflows
    p += net.out_bias
    np.exp(p, out=p)
    total = p.sum(axis=1)
    np.divide(np.arange(len(columns))[:, None] < lengths[None, :], total, out=total)
    p *= total[:, None, :]
    return p.sum(axis=0).T


def gradients(net: Network, windows: np.ndarray, lengths: np.ndarray, labels: np.ndarray) -> tuple[float, list[np.ndarray]]:
    """Mean cross-entropy over positions and its gradients, by backpropagation through time."""
    h, n = HIDDEN, len(windows)
    states, saved = _states(net, windows, True)
    logits = np.matmul(net.out[:, :h], states[0]) + np.matmul(net.out[:, h:], states[1]) + net.out_bias
    p = _softmax(logits)
    mask = (np.arange(windows.shape[1])[:, None] < lengths[None, :]).astype(np.float32)
    total = max(1.0, float(mask.sum()))
    loss = float(-(np.log(p[:, labels, np.arange(n)] + 1e-9) * mask).sum()) / total
    p[:, labels, np.arange(n)] -= 1
    delta = p * (mask / total)[:, None, :]  # [T, L, N]
    grads = [np.zeros_like(w) for w in net.parameters()]
    grads[3][:, :h] = np.einsum("tln,thn->lh", delta, states[0], optimize=True)
    grads[3][:, h:] = np.einsum("tln,thn->lh", delta, states[1], optimize=True)
    grads[4][:] = delta.sum(axis=(0, 2))[:, None]
    back = [np.matmul(net.out[:, :h].T, delta), np.matmul(net.out[:, h:].T, delta)]
    carry = [np.zeros((h, n), np.float32), np.zeros((h, n), np.float32)]
    for d, t, (z, r, c, inner, before) in reversed(saved):
        dh = back[d][t] + carry[d]
        dc = dh * (1 - z) * _slope(c)
        dz = dh * (before - c) * 0.5 * (1 - np.abs(2 * z - 1)) ** 2
        dr = dc * inner * 0.5 * (1 - np.abs(2 * r - 1)) ** 2
        du = np.concatenate([dz, dr, dc * r])
        dx = np.concatenate([dz, dr, dc])
        grads[1][d] += du @ before.T
        grads[2][d] += (dc * r).sum(axis=1, keepdims=True)
        hot = np.zeros((256, n), np.float32)
        hot[windows[:, t], np.arange(n)] = 1
        grads[0][d] += hot @ dx.T
        carry[d] = dh * z + net.recur[d].T @ du
    return loss, grads


def train(windows: np.ndarray, lengths: np.ndarray, labels: np.ndarray, names: list[str], epochs: int = EPOCHS, seed: int = SEED) -> Network:
    """Adam over shuffled batches; each language weighs the same, as every one has as many rows as it can give."""
    net, rng = fresh(names, seed), np.random.default_rng(seed + 1)
    first, second, t = [np.zeros_like(w) for w in net.parameters()], [np.zeros_like(w) for w in net.parameters()], 0
    size = max(16, min(128, len(windows) // 8 or 1))
    for _ in range(epochs):
        order = rng.permutation(len(windows))
        for low in range(0, len(order), size):
            part = order[low : low + size]
            _, grads = gradients(net, windows[part], lengths[part], labels[part])
            t += 1
            for w, g, m, v in zip(net.parameters(), grads, first, second):
                g = np.clip(g, -1, 1)
                m += 0.1 * (g - m)
                v += 0.002 * (g * g - v)
                w -= 0.02 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.998**t)) + 1e-7)
    return net


def cut(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """`(windows, lengths, row of each)`: whole texts in windows end to end, the last of each filled with zeros."""
    data, offsets = text_bytes(texts)
    size = np.diff(offsets)
    count = -(-size // WINDOW)
    row = np.repeat(np.arange(len(size)), count)
    begin = offsets[row] + (np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)) * WINDOW
    lengths = np.minimum(offsets[row + 1] - begin, WINDOW)
    at = begin[:, None] + np.arange(WINDOW)
    windows = np.where(np.arange(WINDOW) < lengths[:, None], data[np.minimum(at, max(0, len(data) - 1))] if len(data) else np.uint8(0), np.uint8(0))
    return windows, lengths, row


def pooled(net: Network, texts: pa.Array) -> np.ndarray:
    """Mean label probabilities of every text, [rows, L]; an empty text has zeros."""
    sums, sizes = np.zeros((len(texts), len(net.names))), np.zeros(len(texts))
    windows, lengths, row = cut(texts)
    for low in range(0, len(row), BATCH):
        part = slice(low, low + BATCH)
        np.add.at(sums, row[part], probabilities(net, windows[part], lengths[part]))
        np.add.at(sizes, row[part], lengths[part])
    return sums / np.maximum(sizes, 1)[:, None]


def _predict(net: Network):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size = np.cumsum(pc.binary_length(batch.column(1)).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64))
            low = 0
            while low < batch.num_rows:  # a few MB of text at a time
                start = size[low - 1] if low else 0
                high = max(low + 1, int(np.searchsorted(size, start + (2 << 20), "right")))
                part = batch.slice(low, high - low)
                p = pooled(net, part.column(1))
                names = np.array(net.names, object)[p.argmax(axis=1)] if net.names else np.array([UNKNOWN] * len(p), object)
                score = p.max(axis=1) if net.names else np.zeros(len(p))
                yield pa.RecordBatch.from_arrays([*part.columns[:1], *part.columns[2:], pa.array(names, pa.string()), pa.array(np.clip(score, 0, 1))], [*part.schema.names[:1], *part.schema.names[2:], "lang_pred", "score"])
                low = high

    return run


def training_set(docs: DataFrame, rows: int = ROWS_PER_LANGUAGE, windows: int = WINDOWS_PER_ROW) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[str]]:
    """Windows of a bounded sample: of each language the `rows` texts of least hash, and of each text windows spread over it.

    Held-out rows (crc32 of the id mod 4 is 2), rows without a language and texts without a letter are never read.
    """
    known = only(docs, "doc_id", "text", "lang").where((crc32_mod(F.col("doc_id"), 4) != 2) & F.col("lang").isNotNull() & has_letter(F.col("text")))
    order = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id", "text"))
    drawn = known.withColumn("draw", F.row_number().over(order)).where(F.col("draw") <= rows)
    size = F.length("text")
    spans = [F.substring("text", (size * i / windows).cast("int") + 1, F.lit(WINDOW)) for i in range(windows)]
    got = drawn.select("lang", F.explode(F.array_distinct(F.array(*spans))).alias("span")).orderBy("lang", "span").toArrow()
    names = sorted(set(got.column("lang").to_pylist()))
    x, lengths, row = cut(got.column("span"))
    label = np.array([names.index(v) for v in got.column("lang").to_pylist()], int)
    return x, lengths, label[row] if len(row) else label[:0], names


def has_letter(text: Column) -> Column:
    return F.coalesce(text.rlike(r"\p{L}"), F.lit(False))


def fit(docs: DataFrame) -> Network:
    x, lengths, labels, names = training_set(docs)
    return train(x, lengths, labels, names) if len(x) else fresh([])


def identify(docs: DataFrame, net: Network | None = None) -> DataFrame:
    """`doc_id, held_out, lang_pred, score` of every row of `docs` (`doc_id`, `text`, `lang`).

    `lang_pred` is one of the learned languages, `und` (score 0) where the text is null or has no letter, or where no row
    could be learned from; `score` is its pooled probability. `lang` is read only from rows that are not held out, to learn. A
    null id is hashed as the empty text. Repeated rows are predicted alike; other columns are not read.
    """
    net = net or fit(docs)
    rows = only(docs, "doc_id", "text")
    rows = rows.select("doc_id", "text", (crc32_mod(F.col("doc_id"), 4) == 2).alias("held_out"), has_letter(F.col("text")).alias("letters"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    out = rows.mapInArrow(_predict(net), f"doc_id {kind}, held_out boolean, letters boolean, lang_pred string, score double")
    return out.select("doc_id", "held_out", F.when(F.col("letters"), F.col("lang_pred")).otherwise(UNKNOWN).alias("lang_pred"), F.when(F.col("letters"), F.col("score")).otherwise(0.0).alias("score"))


def accepted(docs: DataFrame, least: float = LEAST_SCORE, net: Network | None = None) -> DataFrame:
    """The rows of `docs`, all columns, whose language is told with a pooled probability of `least` or more."""
    net = net or fit(docs)

    def judge(texts: pd.Series) -> pd.Series:
        return pd.Series(pooled(net, pa.array(texts, pa.string())).max(axis=1) if net.names else np.zeros(len(texts)))

    # Decided in the row itself: no join, and repeated rows or null ids need no care.
    return docs.where(has_letter(docs["text"])).where(F.pandas_udf(judge, "double")(docs["text"]) >= least)
