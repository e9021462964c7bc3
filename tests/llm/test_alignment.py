"""Alignment of two tokenizers against whole-text encodings and counts in plain Python."""
import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
import sentencepiece
import tokenizers

from tablelake.llm import alignment

SMALL = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
ODD = [None, "", " ", "  ", "a", " a", "a ", "a  b", "tab\t b \n\n  c", "x\n y\r\n z", "under▁mark", "zero\x00byte", "<s> and </s> <unk> <|endoftext|>", "日本語 テキスト 🙂 emoji", "nbsp  　 wide", "it's they'll I'VE 123,456.78",
       "é ﬁ ½ Ǆ", "\n", "a▁", "٣٤ अआ  ", "\x1c x \x85 y", "word " * 20_000, "x" * 3_000, " " * 50]


@pytest.fixture(scope="module")
def models():
    a = tokenizers.Tokenizer.from_file(alignment.A_FILE)
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=alignment.B_FILE), alignment.Pair(alignment.A_FILE, alignment.B_FILE)


def brute(rows, models):
    a, b, pair = models
    cut, count = [], Counter()
    for i, text in rows:
        groups, x, y = [], [], []
        if text:
            want = (" " + text).encode()
            x, y = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
            if b"".join(pair.a_bytes[t] for t in x) != want or b"".join(pair.b_bytes[t] for t in y) != want:
                x, y = [], []
            ends = [np.cumsum([len(of[t]) for t in ids]).tolist() for ids, of in ((x, pair.a_bytes), (y, pair.b_bytes))]
            p = q = 0
            for end in sorted(set(ends[0]) & set(ends[1])):
                i1, j1 = ends[0].index(end, p) + 1, ends[1].index(end, q) + 1
                groups.append((x[p:i1], y[q:j1]))
                p, q = i1, j1
        count.update((g[0][-1], g[1][-1]) for g in groups)
        cut.append((i, x, y, groups))
    most = defaultdict(int)
    for (_, y), n in count.items():
        most[y] = max(most[y], n)
    out = []
    for i, x, y, groups in cut:
        links = [(g[0][-1], g[1][-1]) for g in groups]
        text = ";".join(",".join(map(str, p)) + "|" + ",".join(map(str, q)) for p, q in groups)
        out.append((i, len(x), len(y), len(groups), len(links), sum(count[k] == most[k[1]] for k in links), sum(count[k] for k in links),
                    hashlib.sha256(text.encode()).hexdigest() if groups else ""))
    return sorted(out, key=repr)


@pytest.mark.parametrize("small", [False, True])
def test_alignment(spark, models, small, monkeypatch):
    """Odd texts, repeated rows and ids; then with tiny blocks, several merge rounds, several salts and a short memory of units."""
    rng = random.Random(2)
    rows = [(i, t) for i, t in enumerate(ODD)] + [(None, "a b"), (3, "a b"), (3, "a b")] + [(100 + i, rng.choice(ODD[1:20]) + " some words here, " + rng.choice(ODD[1:20])) for i in range(60)]
    if small:
        # Both are read on the driver.
        monkeypatch.setattr(alignment, "FAN", 2)
        monkeypatch.setattr(alignment, "RUNS", 3)
    docs = spark.createDataFrame([(i, t, 1, "x", 2) for i, t in rows], "doc_id long, text string, block int, head string, doc int").repartition(9)
    got = alignment.align(docs)
    assert got.columns == COLUMNS
    assert sorted((tuple(r) for r in got.collect()), key=repr) == brute(rows, models)
    if not small:
        assert alignment.align(docs.limit(0)).collect() == []


def test_given_documents(spark, models):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    want = brute([(r["doc_id"], r["text"]) for r in docs.collect()], models)
    assert sorted((tuple(r) for r in alignment.align(docs).collect()), key=repr) == want


def test_small_blocks_and_memory(models, monkeypatch):
    monkeypatch.setattr(alignment, "STEP", 3)
    rng = np.random.default_rng(1)
    pairs = (rng.integers(0, 300, 4000) << alignment.ID_BITS | rng.integers(0, 9, 4000)).astype(np.uint64)
    docs = np.sort(rng.integers(0, 50, 4000))
    want, got, heads = Counter(zip(pairs.tolist(), docs.tolist())), Counter(), []
    radix = lambda p: (p >> alignment.ID_BITS) & 63
    for part, head, body in alignment.runs(pairs, docs):
        keys, counts = alignment.unpack_head(head)
        place, doc, times = alignment.unpack_body(body)
        assert (np.diff(keys.astype(np.int64)) > 0).all() and counts.sum() == times.sum()
        mine = sorted({p for p in pairs.tolist() if radix(p) == part}, key=lambda p: (p >> alignment.ID_BITS, p & (1 << alignment.ID_BITS) - 1))
        got.update({(mine[k], d): t for k, d, t in zip(place.tolist(), doc.tolist(), times.tolist())})
        heads.append((keys, counts))
    assert got == want
    split = [(k[i::3], c[i::3]) for k, c in heads for i in range(3)]
    total = Counter()
    last = -1
    for keys, counts in alignment.merged([*split, *heads]):
        assert keys[0] > last
        last = int(keys[-1])
        total.update(dict(zip(keys.tolist(), counts.tolist())))
    assert sum(total.values()) == 8000 and all(total[int(k)] == 2 * int(c) for keys, counts in heads for k, c in zip(keys, counts))
