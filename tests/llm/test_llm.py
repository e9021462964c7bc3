"""The dealt operators against brute force, exact round trips and held-out accuracy, and on odd tables."""
import hashlib
import math
import random
import re
import textwrap
import zlib
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tablelake.llm import (
    components, embedding_dedup, language_id, license_scan, lm_scoring, mixing, ngram_join, pii, sentencepiece, sharding, topk_search,
)
from tablelake.llm.common import distinct, mix, mix_one

SMALL = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, k string, sig int, `a b` int"


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def table(spark, rows):
    """Documents with extra columns whose names the operators use inside."""
    return spark.createDataFrame([(i, t, lang, s, None, "k", 1, 2) for i, t, lang, s in rows], DOCS)


@pytest.fixture(scope="module")
def odd(spark):
    long = " ".join(f"w{i % 977}x{i % 31}" for i in range(60_000))
    rows = [(1, "Same words here, in this very order.", "en", "s"), (2, "Same words here, in this very order.", None, None), (2, "Same words here, in this very order.", None, None),
            (3, None, "en", "s"), (4, "", None, "s"), (None, "no id at all for this one here", "de", "t"), (None, None, None, None), (5, " \t\n ", "en", "s"), (6, long, "en", "s"), (7, long + " end", "en", "s"),
            (8, "one two", "en", "t"), (9, "ONE two", "en", "t"), (10, "!!! 123", "de", "t"), (2, "other text under an id used before", "de", "s")]
    return table(spark, rows)


@pytest.fixture(scope="module")
def empty(spark):
    return table(spark, [])


def shingles(text):
    w = words(text)
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def brute_components(rows):
    sets = [shingles(t) for _, t in rows]
    label = list(range(len(rows)))

    def find(i):
        while label[i] != i:
            i = label[i]
        return i

    where = defaultdict(list)
    for i, s in enumerate(sets):
        for x in s:
            where[x].append(i)
    for i, s in enumerate(sets):
        for j, c in Counter(j for x in s for j in where[x] if j < i).items():
            if 100 * c >= 80 * (len(s) + len(sets[j]) - c):
                a, b = find(i), find(j)
                label[max(a, b)] = min(a, b)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None and sets[i]:
            least[find(i)] = min(d, least.get(find(i), d))
    return sorted((repr(d), len(sets[i]), least.get(find(i), d) if sets[i] else d) for i, (d, _) in enumerate(rows))


@pytest.mark.parametrize("heat", [ngram_join.HEAT, 60.0])
def test_ngram_join(spark, odd, empty, heat, monkeypatch):
    """Families of near copies around the threshold, a line that most texts share, and odd rows."""
    rng = random.Random(7)
    vocabulary = [f"v{i}" for i in range(400)]
    rows = [tuple(r) for r in odd.select("doc_id", "text").collect()]
    for family in range(12):
        base = rng.choices(vocabulary, k=rng.choice([6, 12, 40, 90, 200]))
        for _ in range(14):
            copy = list(base)
            for _ in range(rng.randrange(1 + len(base) // 20)):
                copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
            rows.append((1000 + len(rows), " ".join((["the", "line", "that", "many", "texts", "share"] if family % 2 else []) + copy)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = ngram_join.ngram_components(docs, heat).collect()
    assert sorted((repr(r[0]), r[1], r[2]) for r in got) == brute_components(rows)
    if heat == ngram_join.HEAT:
        assert ngram_join.ngram_components(empty).collect() == []
        kept = ngram_join.keep_one(odd)
        assert kept.columns == odd.columns
        assert sorted(repr(r["doc_id"]) for r in kept.collect()) == sorted(map(repr, [1, 3, 4, None, None, 5, 6, 8, 10, 2]))
        monkeypatch.setattr(ngram_join, "BLOCK", 4)
        monkeypatch.setattr(components, "HUB_ROWS", 3)
        again = ngram_join.ngram_components(docs, heat).collect()
        assert sorted(map(tuple, again), key=repr) == sorted(map(tuple, got), key=repr)


def test_allocation_leaves_points_to_spare():
    rng = np.random.default_rng(3)
    for heat in (ngram_join.HEAT, 60.0):
        for size in (25, 40, 71, 150, 433, 2000):
            band = int(np.searchsorted(ngram_join.band_starts(), size, "right")) - 1
            for _ in range(5):
                _, points = ngram_join.signatures(np.unique(rng.integers(0, 2**63, size).astype(np.uint64)), band, *ngram_join.allocate(band, heat))
                assert points >= ngram_join.need(size)
    assert all(ngram_join.most_errors(a + b) < ngram_join.need(a) for a in range(1, 300) for b in range(a, a * 5 // 4 + 1))


def test_contracted_blocks():
    rng = random.Random(3)
    for n in (1, 2, 40, 300):
        for edges in ([(i, i + 1) for i in range(n)], [(rng.randrange(-n, n), rng.randrange(-n, n)) for _ in range(n)], []):
            rng.shuffle(edges)
            least = {x: x for e in edges for x in e}
            for _ in least:
                for a, b in edges:
                    least[a] = least[b] = min(least[a], least[b])
            block = pa.RecordBatch.from_arrays([pa.array([e[i] for e in edges], pa.int64()) for i in (0, 1)], ["a", "b"])
            got = [(r["a"], r["b"]) for out in components._contract([block]) for r in out.to_pylist()]
            assert sorted(got) == sorted((x, c) for x, c in least.items() if c != x)


@pytest.mark.parametrize("hub", [components.HUB_ROWS, 5])
def test_components(spark, hub, monkeypatch):
    monkeypatch.setattr(components, "HUB_ROWS", hub)
    rng = random.Random(5)
    edges = [(i, i + 1) for i in range(60)] + [(100, i) for i in range(101, 160)] + [(rng.randrange(200, 260), rng.randrange(200, 260)) for _ in range(40)]
    got = {r["id"]: r["component"] for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    label = {x: x for e in edges for x in e}
    for _ in label:
        for a, b in edges:
            label[a] = label[b] = min(label[a], label[b])
    assert got == {x: c for x, c in label.items() if any(x in e and e[0] != e[1] for e in edges)}
    assert components.components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_sharding(spark, odd, empty):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    for df, shards in ((docs, 40), (odd, 3)):
        rows, text = sharding.shard(df, shards).collect(), {r["doc_id"]: r["text"] for r in df.collect()}
        places = defaultdict(list)
        for r in rows:
            places[r["shard"]].append(r["slot"])
            assert r["law"] == "bytes" and r["grown_shard"] is None
        assert all(sorted(p) == list(range(len(p))) for p in places.values()) and len(rows) == df.count()
        if df is docs:
            assert all(r["size"] == len(text[r["doc_id"]].encode()) + 16 and r["text_crc32"] == zlib.crc32(text[r["doc_id"]].encode()) for r in rows)
            load = Counter()
            for r in rows:
                load[r["shard"]] += r["size"]
            assert max(load.values()) - min(load.values()) <= max(r["size"] for r in rows)
    assert sharding.shard(empty, 4).collect() == []


def test_slot_maps_are_edited():
    weights = {s: 100 + s % 7 for s in range(512)}
    first = sharding.first_map(weights, 8, 512)
    grown = sharding.rebalanced(first, weights, 9)
    assert all(b == a or b == 8 for a, b in zip(first, grown))
    load = Counter()
    for slot, shard in enumerate(grown):
        load[shard] += weights[slot]
    assert max(load.values()) - min(load.values()) <= 110


def test_language_id(spark, odd, empty):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    net = language_id.fit(docs)
    got = language_id.identify(docs, net).join(docs.select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in got if r["held_out"]]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) and 0 <= r["score"] <= 1 for r in got)
    assert len(got) == docs.count() and sum(r["lang_pred"] == r["lang"] for r in held) >= 0.95 * len(held)
    assert language_id.accepted(docs, net=net).count() >= 0.99 * docs.count()
    seen = [(r["lang_pred"], r["score"]) for r in language_id.identify(odd, net).where("doc_id IN (3, 4, 5, 10)").collect()]
    assert seen == [("und", 0.0)] * 4
    assert {r["lang_pred"] for r in language_id.identify(table(spark, [(1, "words", None, "s")])).collect()} == {"und"}
    assert language_id.identify(empty).collect() == [] and language_id.accepted(odd, net=net).columns == odd.columns


def test_network_gradients():
    """Backpropagation through time against finite differences, and the fast forward pass against the plain one."""
    rng = np.random.default_rng(1)
    net = language_id.fresh(["a", "b", "c"], 4)
    x, lengths, labels = rng.integers(0, 256, (5, 12)).astype(np.uint8), np.array([12, 7, 1, 12, 3]), np.array([0, 1, 2, 1, 0])
    for w, g in zip(net.parameters(), language_id.gradients(net, x, lengths, labels)[1]):
        at = np.unravel_index(np.argmax(np.abs(g)), g.shape)
        kept = w[at]
        w[at] = kept + 1e-2
        up = language_id.gradients(net, x, lengths, labels)[0]
        w[at] = kept - 1e-2
        down = language_id.gradients(net, x, lengths, labels)[0]
        w[at] = kept
        assert (up - down) / 2e-2 == pytest.approx(g[at], rel=0.05, abs=2e-4)
    p = language_id.probabilities(net, x, lengths)
    assert p.sum(axis=1) == pytest.approx(lengths, rel=1e-4)


def test_lm_scores(spark, odd, empty):
    for df in (spark.read.parquet(f"{SMALL}/documents.parquet"), odd):
        rows = [(r["doc_id"], words(r["text"]) + [None]) for r in df.collect()]
        out = [zlib.crc32(("" if d is None else str(d)).encode()) % 7 == 2 for d, _ in rows]
        count = Counter(w for (_, ws), o in zip(rows, out) if not o for w in ws)
        n, v = sum(count.values()), len(count)
        want = sorted((repr(d), o, len(ws), sum(count[w] > 0 for w in ws), n, round(sum(math.log10((count[w] + 1) / (n + v + 1)) for w in ws), 4)) for (d, ws), o in zip(rows, out))
        got = lm_scoring.score(df).collect()
        assert sorted((repr(r[0]), r[1], r[2], r[3], r[4], round(r[5], 4)) for r in got) == want
        assert all(r["score"] < 0 for r in got)
        held = [r for r in got if r["held_out"]]
        assert df is odd or sum(r["score"] for r in held) > sum(r["base_score"] for r in held)
    assert lm_scoring.score(empty).collect() == []


def test_mixture_weights_follow_the_better_estimate():
    cells = np.array([[3, 4, 40, 1000], [5, -1, 20, 1000]])
    weights = lm_scoring.learn_weights(cells, 1000)
    assert weights[3].argmax() == 0 and weights[5].argmax() == 1
    assert weights.sum(axis=1) == pytest.approx(np.ones(lm_scoring.BUCKETS)) and (weights > 0).all()


VECTORS = "vec_id long, embedding array<float>, id string, v int"


def test_top_k(spark):
    rng = np.random.default_rng(2)
    made = [(i, [float(x) for x in rng.normal(size=8).round(1)], "x", 1) for i in range(140)]
    made += [(200, made[0][1], "x", 1), (201, None, "x", 1), (250, [1.0, float("nan")], "x", 1), (300, [1.0, None], "x", 1), (None, made[0][1], "x", 1), made[3]]
    rows = topk_search.usable(spark.createDataFrame(made, VECTORS), "vec_id", "embedding")
    got = [tuple(r) for r in topk_search.top_k(rows, rows.where("id % 50 = 0"), 5).collect()]
    whole = {i: [math.floor(256 * float(np.float32(x))) for x in v] for i, v, _, _ in made if i is not None and v and all(x is not None and x == x for x in v)}
    want = []
    for q in (x for x in whole if x % 50 == 0):
        best = sorted((-sum(a * b for a, b in zip(whole[q], whole[c])), c) for c in whole if c != q)[:5]
        want += [(q, r + 1, c, -s) for r, (s, c) in enumerate(best)]
    assert sorted(got) == sorted(want)
    few = rows.where("id IN (50, 51)")
    assert [tuple(r)[:3] for r in topk_search.top_k(few, few.where("id = 50"), 5).collect()] == [(50, 1, 51)]
    assert topk_search.top_k(rows.where("id < 0"), rows.where("id < 0"), 5).collect() == []


def test_top_k_of_repeated_ids(spark, monkeypatch):
    import duckdb
    from tablelake.llm.queries import TOP_K_SQL, op4_top_k

    rng = np.random.default_rng(5)
    made = [(i // 2 % 120, [float(x) for x in rng.normal(size=6).round(1)], "x", 1) for i in range(300)]
    made += made[:7]
    embeddings = pa.table({"vec_id": [m[0] for m in made], "embedding": pa.array([m[1] for m in made], pa.list_(pa.float32()))})  # noqa: F841, read by name
    want = sorted(duckdb.sql(TOP_K_SQL).fetchall())
    for size in (topk_search.QUERY_BLOCK, 3):
        monkeypatch.setattr(topk_search, "QUERY_BLOCK", size)
        assert sorted(map(tuple, op4_top_k(spark.createDataFrame(made, VECTORS)).collect())) == want


def test_embedding_components(spark, monkeypatch):
    rng = np.random.default_rng(4)
    made = []
    for c in range(40):
        centre = rng.normal(size=32)
        made += [(len(made) + j, [float(x) for x in centre + rng.normal(size=32) * 0.12], "x", 1) for j in range(8)]
    made += [(1000 + i, made[0][1], "x", 1) for i in range(5)] + [(2000, None, "x", 1), (2001, [0.0] * 32, "x", 1), (2002, [float("inf")] * 32, "x", 1), (2003, [1.0], "x", 1), (2004, [], "x", 1)]
    x = np.array([np.array(v, np.float32).astype(float) for i, v, _, _ in made if i < 2000])
    x /= np.linalg.norm(x, axis=1)[:, None]
    near = x @ x.T >= 0.95
    degree = dict(zip([m[0] for m in made], near.sum(axis=1) - 1))
    for block in (512, 3):
        monkeypatch.setattr(embedding_dedup, "BLOCK", block)
        got = {r["vec_id"]: r for r in embedding_dedup.embedding_components(spark.createDataFrame(made, VECTORS)).collect()}
        assert all(got[i]["n_links"] <= d for i, d in degree.items())
        assert sum(r["n_links"] for r in got.values()) >= 0.98 * sum(degree.values())
        assert all(got[i]["n_links"] == 0 and got[i]["component_id"] == i and got[i]["kept"] for i in (2000, 2001, 2002, 2003, 2004))
        assert got[1004]["component_id"] == 0 and not got[1004]["kept"] and got[0]["kept"]
    assert embedding_dedup.embedding_components(spark.createDataFrame([], VECTORS)).collect() == []


PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
            "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def base_spans(text):
    def luhn(digits):
        return sum(int(c) if i % 2 == 0 else int(c) * 2 - 9 * (int(c) > 4) for i, c in enumerate(reversed(digits))) % 10 == 0

    out = []
    for k, (kind, pattern) in enumerate(PATTERNS.items()):
        for m in re.finditer(pattern, text or ""):
            d = re.sub("[^0-9]", "", m[0])
            if {"email": True, "ip": kind == "ip" and all(int(p) < 256 for p in m[0].split(".")), "card": 14 <= len(d) <= 19 and luhn(d), "phone": 10 <= len(d) <= 15}[kind]:
                out.append((m.start(), k, m.end(), kind))
    return sorted(out)


def test_pii(spark, odd, empty):
    texts = ["a..b@x.yy..z q@r", "a@b.c_d@e.f", "1.2.3.4.5.6.7.8 999.1.1.1 007.1.1.1", "4111 1111 1111 1111 4111--1111", "+1 (743) 555-3824 é +12345678901234567 +1 743 555 3824-",
             "x@y@z.w é@a.b", "1 " * 9000, "9" * 9000, "a.b." * 4000 + "@x.y", "q@" + "a." * 6000 + "b", ".@a.b %@c-.d a@-.- \U0001d4b3 u@v.w", "a@b.cd", "a@b.cd", "+1 555 010 0000 " * 700, None, ""]
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()] + [(10_000 + i, t) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r for r in pii.find(df).collect()}
    for i, text in rows:
        want = base_spans(text)
        joined = ",".join(f"{kind}:{a}:{b}" for a, _, b, kind in want)
        assert got[i]["base_sha256"] == hashlib.sha256(joined.encode()).hexdigest(), i
        assert [got[i][f"n_{k}"] for k in PATTERNS] == [sum(s[3] == k for s in want) for k in PATTERNS]
        assert {f"{kind}:{a}:{b}" for a, _, b, kind in want} <= set(got[i]["spans"].split(","))
    clean = {r["doc_id"]: r["text"] for r in pii.redact(df).collect()}
    assert len(clean) == len(rows) and clean[10_014] is None and clean[10_011] == "<EMAIL>"
    assert not any(base_spans(t) for t in clean.values())
    untouched = [i for i, t in rows if not got[i]["spans"]]
    assert all(clean[i] == dict(rows)[i] for i in untouched)
    assert pii.find(empty).collect() == [] and pii.redact(odd).columns == odd.columns and pii.redact(odd).count() == odd.count()
    clash = spark.createDataFrame([(1, "mail a@b.cd", 7, "x")], "`__pii` long, text string, c0 long, `__t_email` string")
    assert [tuple(r) for r in pii.redact(clash).collect()] == [(1, "mail <EMAIL>", 7, "x")]


def test_pii_trees_add_loose_formats(spark):
    rows = [(i, f"ring +1 (743) 555-{1000 + i} or 1.2.3.{i} or 12.34.56.999, no. 12345 67{i % 9}" * 2) for i in range(80)] + [(100, "please phone (555) 123-4567 now")]
    got = {r["doc_id"]: r for r in pii.find(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[100]["n_phone"] == 0 and got[100]["spans"] == "phone:13:27"


def test_mixing(spark, odd, empty):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").withColumn("source", F.when(F.col("doc_id") % 3 == 0, "hot").otherwise(F.col("source")))
    for weights in (None, {"hot": 1.0, "src1": 3.0}):
        rows = mixing.schedule(docs, weights).collect()
        blocks = {(r["source"], r["block"]): (r["slot"], r["release"], r["deadline"]) for r in rows}
        assert sorted(s for s, _, _ in blocks.values()) == list(range(len(blocks))) and len(rows) == docs.count()
        assert all(release <= slot < deadline for slot, release, deadline in blocks.values())
        assert len({r["position"] for r in rows}) == len(rows)
    assert mixing.mix(odd).count() == odd.count() and mixing.mix(odd).columns == odd.columns
    assert mixing.schedule(empty).collect() == [] and mixing.mix(empty).collect() == []
    with pytest.raises(ValueError):
        mixing.schedule(docs.withColumn("source", F.col("doc_id").cast("string"))).collect()


def test_pfair_deviation():
    for counts in ({"a": 700, "b": 300, "c": 24}, {"a": 1, "b": 1, "c": 1022}, {str(i): 32 for i in range(32)}):
        got = Counter()
        for t, (source, _, release, deadline) in enumerate(mixing.frame(counts)):
            assert release <= t < deadline
            got[source] += 1
            assert all(abs(got[s] - (t + 1) * n / sum(counts.values())) < 1 for s, n in counts.items())
    assert sum(mixing.whole_parts({"a": 1e-9, "b": 5, "c": 2}, 1024).values()) == 1024


def test_pfair_deviation_from_the_target_weights():
    cases = [({"a": 10_000, "b": 12_345}, None), ({"hot": 100_000, **{f"s{i}": 3 for i in range(200)}}, None), ({"a": 500, "b": 400, "c": 90, "d": 1}, {"a": 0.1, "b": 0.7, "c": 0.2}),
             ({str(i): i * i % 37 + 1 for i in range(60)}, {str(i): i % 7 + 0.3 for i in range(60)})]
    for blocks, weights in cases:
        whole = mixing.target_weights(blocks, weights)
        # The flow, source by source: (slot, blocks so far, share of a slot) from one end of a source to the next.
        flow, t, left = [], Fraction(0), {s: Fraction(n) for s, n in blocks.items()}
        while left:
            total = sum(whole[s] for s in left)
            step = min(left[s] * total / whole[s] for s in left)
            flow.append((t, {s: (blocks[s] - n, whole[s] / total) for s, n in left.items()}))
            left = {s: m for s, n in left.items() if (m := n - step * whole[s] / total)}
            t += step
        got, rows, k = Counter(), list(mixing.walk(blocks, whole)), 0
        assert {(s, j) for s, j, _, _ in rows} == {(s, j) for s, n in blocks.items() for j in range(n)} and len(rows) == sum(blocks.values())
        for t, (source, _, release, deadline) in enumerate(rows, 1):
            got[source] += 1
            assert release <= t - 1 < deadline
            while k + 1 < len(flow) and flow[k + 1][0] <= t:
                k += 1
            looked = flow[k][1] if len(rows) < 5000 or t % 997 == 0 else {source: flow[k][1][source]} if source in flow[k][1] else {}
            assert all(abs(got[s] - (n + (t - flow[k][0]) * w)) < 1 for s, (n, w) in looked.items())


def test_mix_to_target_shares(spark):
    rows = [(i, f"text {i}", "en", "big" if i % 10 else "small") for i in range(12_800)]
    docs = table(spark, rows)
    out = mixing.mix(docs, 0.5, position="p").select("source", "p").collect()
    assert len({r["p"] for r in out}) == len(rows)
    early = Counter(r["source"] for r in sorted(out, key=lambda r: r["p"])[:3200])
    assert abs(early["small"] / 3200 - 0.25) < 0.02  # 40 blocks to 360: weights of 1 to 3, where the table's share is a tenth
    assert mixing.target_weights({"a": 7, "b": 9}, 0) == {"a": 1, "b": 1}


def test_pipeline_rows_come_in_the_order_of_the_mix(spark, monkeypatch):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    monkeypatch.setattr(corpus_pipeline, "STAGES", [x for x in corpus_pipeline.STAGES if x[0] in ("pfair_mix", "sentencepiece")])
    got = [(r["doc_id"], r["text"]) for r in corpus_pipeline.run(spark, SMALL).collect()]
    place = {(r["doc_id"], r["text"]): r["p"] for r in mixing.mix(docs, mixing.TEMPER, position="p").collect()}
    assert len(got) == docs.count() and [place[g] for g in got] == sorted(place[g] for g in got)


def test_mixing_any_number_of_sources(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").withColumn("source", F.col("doc_id").cast("string"))
    import tablelake.llm.queries as registered

    rows = registered.op9_pfair_mix(docs).collect()
    assert len(rows) == docs.count() and len({r["source"] for r in rows}) > mixing.MOST_SOURCES
    assert all(r["release"] <= r["slot"] < r["deadline"] for r in rows)
    assert mixing.mix(docs, most_sources=None).count() == docs.count()


def unigram_library():
    """The library's own Viterbi over the same pieces: the model's type field set to unigram."""
    import sentencepiece as library

    raw = bytearray(open(sentencepiece.MODEL, "rb").read())

    def number(i):
        value = shift = 0
        while True:
            value |= (raw[i] & 127) << shift
            i, shift = i + 1, shift + 7
            if raw[i - 1] < 128:
                return value, i

    i = 0
    while i < len(raw):
        key, i = number(i)
        size, i = number(i)
        if key >> 3 == 2:  # the trainer's settings
            end = i + size
            while i < end:
                key, i = number(i)
                if key == 3 << 3:
                    raw[i] = 1
                if key & 7 == 0:
                    _, i = number(i)
                elif key & 7 == 2:
                    size, i = number(i)
                    i += size
                else:
                    i += 4
        else:
            i += size
    model = library.SentencePieceProcessor()
    model.load_from_serialized_proto(bytes(raw))
    return model


def test_sentencepiece(spark, odd, empty):
    encoder = sentencepiece.Encoder(sentencepiece.Vocabulary.load(), remembered=50)
    texts = [r["text"][:400] for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()] + ["Hello  world", " a", "a\nb", "", "x ", "é\U0001d4b3\x00", "ａ①  \t tab"]
    assert [encoder.decode(x.tolist()) for x in encoder.encode(texts)] == texts
    # The library passes over some better segmentations, which its own scores show: nearly all words agree, and none of
    # its segmentations beats ours. It also adds up in single precision, which an unknown character's score exceeds.
    library = unigram_library()
    whole = sorted({w for text in texts for w in text.split(" ") if w and not set(w) & set("\x00\n\t\U0001d4b3ａ①")})
    score = lambda ids: sum(library.get_score(int(i)) for i in ids)
    pairs = [(a.tolist(), b) for a, b in zip(encoder.encode(whole), library.encode(whole))]
    assert len(whole) > 1000 and all(a == b or score(a) > score(b) for a, b in pairs)
    assert sum(a == b for a, b in pairs) >= 0.98 * len(pairs)
    # Brute force over all segmentations of short words.
    vocabulary = encoder.vocabulary

    def best(word):
        return max([0.0] if not word else [vocabulary.scores[word[:n]] + best(word[n:]) for n in range(1, len(word) + 1) if word[:n] in vocabulary.scores])

    assert all(score(a) == best("\u2581" + w) for w, (a, _) in zip(whole, pairs) if len(w) <= 8)
    assert all(r["exact"] for r in sentencepiece.round_trips(odd).collect())
    both = sentencepiece.decode_column(sentencepiece.encode_column(odd))
    assert all(r["decoded"] == r["text"] for r in both.collect()) and both.columns[:-2] == odd.columns
    assert sentencepiece.round_trips(empty).collect() == []


def test_a_text_on_many_pairs_is_cut_once(monkeypatch):
    """Of a batch of pairs each text's shingles are made once a side, and counts are those of the sets."""
    texts = [" ".join(str((i * 3 + j) % 40) for j in range(30)) for i in range(6)] + ["", "one two", None]
    a, b = [i % 3 for i in range(60)], [i % len(texts) for i in range(60)]
    batch = pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array([texts[i] for i in a]), pa.array([texts[i] for i in b])], ["a", "b", "ta", "tb"])
    words = [(t or "").split() for t in texts]
    sets = [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set() for w in words]
    made, whole = [], ngram_join.shingle_sets
    monkeypatch.setattr(ngram_join, "shingle_sets", lambda t: (made.append(x) or x for x in whole(t)))
    (out,) = ngram_join._compare(iter([batch]))
    assert out.column("common").to_pylist() == [len(sets[i] & sets[j]) for i, j in zip(a, b)]
    assert out.column("total").to_pylist() == [len(sets[i] | sets[j]) for i, j in zip(a, b)]
    assert len(made) == 3 + len(texts)


def test_distinct_values_and_one_number_mixed():
    for values in ([], [7], [3, 3], [9, 1, 9, 2**63 + 1, 1]):
        x = np.array(values, np.uint64)
        assert distinct(x).tolist() == sorted(set(values)) and [mix_one(v) for v in values] == mix(x).tolist()


def test_sentencepiece_takes_words_in_blocks(spark, monkeypatch):
    """Blocks of words come out as words one by one do, and a full memory keeps the words in use."""
    vocabulary = sentencepiece.Vocabulary.load()
    letters = "abeizthr\u2581\u2581  \n.é\U0001f600\U0001d4b3\x00ÿ中1"
    made = ["".join(letters[(i * 7 + j * j * (i % 13 + 1)) % len(letters)] for j in range(i % 60)) for i in range(4000)]
    texts = [r["text"] for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]
    words = sorted({w for text in [*texts, *made] for w in sentencepiece.marked_words(text)})
    ids, counts = sentencepiece.segment(words, vocabulary)
    wanted, many = sentencepiece._singly(words, vocabulary)
    assert ids.tolist() == wanted.tolist() and counts.tolist() == many.tolist() and max(map(len, words)) > sentencepiece.SHORT
    single, asked, segment = sentencepiece._singly, [], sentencepiece.segment
    monkeypatch.setattr(sentencepiece, "_singly", lambda w, v: asked.extend(w) or single(w, v))
    encoder = sentencepiece.Encoder(vocabulary, remembered=50)
    first = [x.tolist() for x in encoder.encode(texts)]
    assert all(len(w) > sentencepiece.SHORT for w in asked)
    monkeypatch.setattr(sentencepiece, "segment", lambda w, v: asked.extend(w) or segment(w, v))
    asked.clear()
    assert [x.tolist() for x in encoder.encode(texts)] == first and not asked


def test_license_scan(spark, odd, empty):
    near = "Licensed under the Apache Licence, Version 2.0"
    rows = [(1, "x\nReleased under the MIT License.\ny"), (2, near), (3, "A driving license is needed here."), (4, None), (5, "Licensed under CC BY-NC 4.0."),
            (6, "w " * 3000 + "This work is licensed under the GNU General Public License, version 2. " + "w " * 3000), (6, "Licensed under the Apache License, Version 2.0")]
    got = {(r["doc_id"], r["license"], r["exact"]) for r in license_scan.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {(1, "MIT", True), (2, "Apache-2.0", False), (5, "CC-BY-NC-4.0", True), (6, "GPL-2.0", True), (6, "Apache-2.0", True)}
    assert license_scan.scan(odd).collect() == [] and license_scan.scan(empty).collect() == []
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    found = {r["doc_id"] for r in license_scan.scan(docs).collect()}
    assert found == {r["doc_id"] for r in docs.where(F.col("text").rlike("licensed under|Licensed under|Released under")).collect()}


def license_rows(text):
    return [(name, text[a:b], not absent and not extra) for a, b, name, _, absent, extra in license_scan.Scanner(license_scan.TEMPLATES).notices(text)]


def test_licenses_in_prose(spark):
    prose = "The harvest came late that year and nobody in the valley could say why the river had fallen so low before the rain. " * 5
    rows = [(i, f"{prose[:pad]} {text}, {prose[:pad]}") for i, text in enumerate(license_scan.TEMPLATES.values()) for pad in (0, 40, 80, 390)]
    got = license_scan.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    names, texts = list(license_scan.TEMPLATES), dict(rows)
    assert len(got) == len(rows) and all(r["license"] == names[r["doc_id"]] and r["exact"] for r in got)
    assert all(license_scan.TEMPLATES[r["license"]] in (t[r["start"] : r["end"]] for i, t in rows if i == r["doc_id"]) for r in got) and texts
    assert not license_rows("The album was released under the new license.") and not license_rows("Released under the Apache License.")


def test_wrapped_licenses():
    for wordings in (license_scan.TEMPLATES, license_scan.HEADERS):
        for name, text in wordings.items():
            for mark in ("", "# ", " * ", "// ", "REM "):
                for width in (24, 40, 60):
                    header = "\n".join(mark + line for line in textwrap.wrap(text, width))
                    assert [(n, exact) for n, _, exact in license_rows(f"first line\n{header}\nlast line")] == [(name, True)], (name, mark, width)


def test_licenses_of_one_line():
    both = "Licensed under the Apache License, Version 2.0. Released under the MIT License."
    assert [(n, e) for n, _, e in license_rows(both)] == [("Apache-2.0", True), ("MIT", True)]
    assert [n for n, _, _ in license_rows("Licensed under CC BY 4.0 and CC BY-SA 4.0.")] == ["CC-BY-4.0", "CC-BY-SA-4.0"]
    gpl = license_scan.TEMPLATES["GPL-2.0"]
    assert [n for n, _, _ in license_rows(gpl + " or version 3.")] == ["GPL-2.0", "GPL-3.0"]
    assert [n for n, _, _ in license_rows(gpl + ". 3 people signed.")] == ["GPL-2.0"]
    assert [n for n, _, _ in license_rows("Released under the MIT License. " * 3)] == ["MIT"] * 3


def test_pipeline(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    out = corpus_pipeline.run(spark, SMALL)
    assert out.columns == [*docs.columns, "token_ids"] and [n for n, _ in corpus_pipeline.STAGES][1] == "ngram_jaccard"
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    kept = {int(d) for d, n, c in brute_components(rows) if int(d) == c}
    got = {r["doc_id"]: r["text"] for r in out.collect()}
    assert set(got) <= kept and len(got) >= 0.98 * len(kept) and not any(base_spans(t) for t in got.values())


def test_mix_follows_from_the_data_alone(spark):
    """No setting of the session changes the schedule or the order of the mix, and no column of the user's is touched."""
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    odd_names = docs.withColumns({"__h": F.lit(1), "__src": F.lit("mine"), "__slot": F.lit(2), "at": F.lit(3), "row": F.lit(4)})
    before, seen = spark.conf.get("spark.sql.shuffle.partitions"), set()
    try:
        for n in ("4", "7", "211"):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            plan = sorted(map(tuple, mixing.schedule(docs, mixing.TEMPER, most_sources=None).collect()), key=repr)
            order = [tuple(r) for r in mixing.mix(odd_names, mixing.TEMPER, position="p").orderBy("p").collect()]
            seen.add(repr((plan, order)))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert len(seen) == 1
    assert {r[-6:-1] for r in order} == {(1, "mine", 2, 3, 4)}
    with pytest.raises(ValueError):
        mixing.mix(docs, position="text")
    with pytest.raises(ValueError):
        sentencepiece.encode_column(docs, name="text")
