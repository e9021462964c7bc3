"""Long repeats against a dictionary of all strings, and the index family step by step."""
import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from tablelake.llm import suffix_dedup as sd

SMALL = "/root/testdata/sf0.001"


def brute(rows):
    texts = [(t or "").encode() for _, t in rows]
    seen = Counter(t[i : i + sd.LENGTH] for t in texts for i in range(len(t) - sd.LENGTH + 1))
    out = []
    for (i, _), t in zip(rows, texts):
        gone = np.zeros(len(t) + 1, bool)
        for a in range(len(t) - sd.LENGTH + 1):
            if seen[t[a : a + sd.LENGTH]] > 1:
                gone[a : a + sd.LENGTH] = True
        kept = bytes(b for b, g in zip(t, gone) if not g)
        spans = sum(bool(gone[k]) and (k == 0 or not gone[k - 1]) for k in range(len(t)))
        out.append((i, len(t), len(t) - len(kept), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


def made(rng):
    """Shared passages of lengths around the limit at all offsets, edits, overlaps, periods, zero bytes, copies."""
    letters = "abcdefghij é\x00 "
    word = lambda n: "".join(rng.choices(letters, k=n))
    passages = [word(n) for n in (300, 360, 399, 400, 401, 450, 800, 2500)]
    rows = []
    for i in range(70):
        text = word(rng.randrange(60))
        for _ in range(rng.randrange(4)):
            p = rng.choice(passages)
            a = rng.randrange(len(p) // 3)
            piece = p[a : len(p) - rng.randrange(len(p) // 3)] if rng.random() < 0.5 else p
            if rng.random() < 0.3:
                k = rng.randrange(len(piece))
                piece = piece[:k] + "#" + piece[k + 1 :]
            text += piece + word(rng.choice([0, 1, 30, 500]))
        rows.append((i, text))
    rows += [(80, "z" * 1500), (81, "z" * 399), (82, "ab" * 450), (83, "q" * 400), (84, None), (85, ""), (None, rows[3][1] + "tail"), (5, rows[5][1]), (5, rows[5][1]), (90, passages[7] * 3)]
    return rows


@pytest.mark.parametrize("hot", [False, True])
def test_repeats(spark, hot, monkeypatch):
    monkeypatch.setattr(sd, "BUCKET", 40)
    monkeypatch.setattr(sd, "COMPARED", 20_000)
    if hot:
        monkeypatch.setattr(sd, "RUNS", 1)
        monkeypatch.setattr(sd, "BLOCK_BYTES", 20_000)
    rows = made(random.Random(11 + hot))
    docs = spark.createDataFrame([(i, t, 1, "b", 2) for i, t in rows], "doc_id long, text string, block int, keys string, ids int").repartition(5)
    got = sd.deduplicate(docs, batches=5)
    assert got.columns == ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
    assert sorted(map(tuple, got.collect()), key=repr) == brute(rows)


def test_hot_suffixes_are_counted_by_string(spark):
    """The path for hashes with very many surroundings gives the same spans."""
    rows = made(random.Random(3))
    data, offsets = sd.text_bytes(sd.pa.array([t for _, t in rows], sd.pa.large_string()))
    hashes, _, place, first, last = sd.sampled(data, offsets).T
    raw = data.tobytes()
    rows = [(1, int(p - f), raw[int(p - f) : int(p - e) + sd.LENGTH]) for p, f, e in zip(place, first, last)]
    batch = sd.pa.RecordBatch.from_pylist([{"bytes": t, "block": b, "place": a, "first": 0} for b, a, t in rows])
    strings = [r for out in sd._strings([batch]) for r in out.to_pylist()]
    count = Counter((r["h1"], r["h2"]) for r in strings)
    real = Counter(raw[r["begin"] : r["begin"] + sd.LENGTH] for r in strings)
    assert all(count[r["h1"], r["h2"]] == real[raw[r["begin"] : r["begin"] + sd.LENGTH]] for r in strings) and max(real.values()) > 1
    # Every string stands behind one suffix.
    want = sum(max(0, int(b - a) - sd.LENGTH + 1) for a, b in zip(offsets, offsets[1:]))
    assert len(strings) == want and len({r["begin"] for r in strings}) == want and len(hashes) < want


def test_buckets_fill_evenly():
    rng = np.random.default_rng(5)
    data = rng.integers(97, 123, 400_000).astype(np.uint8)
    hashes = sd.sampled(data, np.array([0, len(data)]))[:, 0]
    held = np.bincount(((hashes * np.uint64(8)) >> np.uint64(sd.HASH_BITS)).astype(np.int64), minlength=8)
    assert held.min() > 0.7 * held.mean() and held.max() < 1.3 * held.mean()


def test_given_documents(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    want = brute(rows)
    assert sorted(map(tuple, sd.deduplicate(docs).collect()), key=repr) == want and any(r[2] for r in want)
    assert sorted(map(tuple, sd.deduplicate(docs, batches=1).collect()), key=repr) == want
    assert sd.deduplicate(docs.limit(0)).collect() == []


def test_index_family(spark):
    """Levels double in size; each append reports what the batch shares with the levels or holds twice."""
    rng = np.random.default_rng(2)
    index, seen = sd.Index(), set()
    for step in range(1, 7):
        keys = np.sort(rng.integers(0, 60, 12).astype(np.uint64))
        batch = spark.createDataFrame([(0, bytearray(sd.pack_keys(keys, np.arange(12, dtype=np.uint64))))], "bucket int, keys binary")
        found = {int(h) for r in index.append(batch).collect() for h in sd.unpack_sorted(bytes(r["entries"]))}
        own = keys.tolist()
        assert found == {h for h in own if h in seen or own.count(h) > 1}
        seen |= set(own)
        assert [n for n, _ in index.levels] == [1 << b for b in range(3, -1, -1) if step >> b & 1]
    total = sum(int(sd.unpack_keys(bytes(r["entries"]))[2].sum()) for r in index.entries().collect())
    assert total == 72


def test_texts_and_spans(spark):
    """The operator's own outputs: bytes left and runs cut out, of odd rows as well, with characters cut in two."""
    rows = made(random.Random(29)) + [(100, "x" + "ab" * 60 + "è" * 200 + "é tail"), (101, "y" + "ab" * 60 + "è" * 200 + "ê")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    out = sd.cut_repeats(docs)
    assert out.columns == ["doc_id", "n_bytes", "kept", "spans"]
    texts, got = Counter((i, (t or "").encode()) for i, t in rows), []
    for r in out.collect():
        spans, kept = [tuple(x) for x in r["spans"]], bytes(r["kept"])
        assert all(b - a >= sd.LENGTH for a, b in spans) and all(x[1] < y[0] for x, y in zip(spans, spans[1:]))
        got.append((r["doc_id"], r["n_bytes"], r["n_bytes"] - len(kept), len(spans), hashlib.sha256(kept).hexdigest()))
        cut = [t for i, t in texts if i == r["doc_id"] and len(t) == r["n_bytes"]]
        assert any(kept == b"".join(t[a:b] for a, b in zip([0, *(x[1] for x in spans)], [*(x[0] for x in spans), len(t)])) for t in cut)
    assert sorted(got, key=repr) == brute(rows)
    assert bytes(out.where("doc_id = 100").first()["kept"]) == b"x\xa9 tail"  # the first byte of é and ê is the same


def test_planted_passages(spark, tmp_path):
    """The query: passages of over 50 words in two documents are gone from both if they are of 400 bytes, clean documents stay as they are."""
    from tablelake.llm.queries import QUERIES

    rng = random.Random(41)
    words = lambda n: " ".join("".join(rng.choices("aeinorst", k=rng.randrange(2, 10))) for _ in range(n))
    passages = [words(rng.randrange(51, 120)) for _ in range(60)]
    rows, holds = [], {}
    for p in passages:
        for _ in range(2):
            holds[len(rows)] = p
            rows.append((len(rows), f"{words(rng.randrange(5, 90))} {p} {words(rng.randrange(5, 90))}"))
    rows += [(len(rows) + k, words(rng.randrange(40, 300))) for k in range(60)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    out = QUERIES["op13_suffix_dedup"](spark, str(tmp_path))
    assert out.columns == ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "text"]
    got, long = {r["doc_id"]: r for r in out.collect()}, 0
    for i, text in rows:
        # A neighbour of a passage is a space in both documents.
        gone = i in holds and len(holds[i]) + 2 >= sd.LENGTH
        long += gone
        assert (got[i]["n_removed"] > 0) == gone and (holds[i] in got[i]["text"] if i in holds and not gone else not gone or holds[i] not in got[i]["text"])
        assert gone or got[i]["text"] == text
        assert hashlib.sha256(got[i]["text"].encode()).hexdigest() == got[i]["kept_sha256"]
    assert 0 < long < len(holds)
