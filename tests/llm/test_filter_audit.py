"""The filter audit against an application of all orders, one document at a time."""
import random
import re
from itertools import permutations

import pytest

from tablelake.llm import filter_audit

DOCS = "doc_id long, text string, lang string, part string, mask int, h long, n int"
LABELS = "doc_id long, quality int, toxic int, good int, n int"


def brute(docs, labels):
    fails = []
    for i, text, lang in docs:
        t = text or ""
        words = [w for w in re.split(r"[\x20\x09-\x0D]+", t) if w]
        fails.append({c for c, test in zip("ABCDE", (
            len(words) < 200, len(set(words)) * 100 < len(words) * 50, len(re.findall("[A-Z]", t)) * 100 > 3 * len(t), re.search(r"[#$%&*|]", t),
            i is not None and any(j is not None and j < i and (u or "") == t for j, u, _ in docs))) if test})
    out = set()
    for part in {lang or "" for _, _, lang in docs}:
        of = [(d[0], f) for d, f in zip(docs, fails) if (d[2] or "") == part]
        removed = dict.fromkeys("ABCDE", 0)
        rows = []
        for order in map("".join, permutations("ABCDE")):
            left = of
            for step, c in enumerate(order, 1):
                here = [x for x in left if c in x[1]]
                left = [x for x in left if c not in x[1]]
                removed[c] += len(here)
                hits = lambda k: sum(any(r[0] == d and r[k] == 1 for r in labels) for d, _ in here if d is not None)  # noqa: B023, E731
                rows.append((part, order, step, len(left), len(here), sum(c in f for _, f in of) - len(here), sum(f == {c} for _, f in of), hits(1), hits(2), c))
        out |= {(*r[:-1], removed[r[-1]]) for r in rows}
    return out


@pytest.fixture(scope="module")
def tables():
    rng = random.Random(4)
    pool = ["", None, "  \t", "A", "a & b", "Capital Letters Here", "x " * 250, " ".join(f"w{i}" for i in range(230)), " ".join(f"W{i}" for i in range(230)), "w# " + " ".join(f"w{i}" for i in range(300)),
            " ".join(f"w{i}" for i in range(60_000)), "é　ü " * 210]
    docs = [(rng.choice([None, *range(40)]), rng.choice(pool), rng.choice(["en", "de", None, ""])) for _ in range(90)] + [(7, "A", "en")] * 40
    labels = [(rng.choice([None, *range(60)]), rng.choice([0, 1, None]), rng.choice([0, 1, None])) for _ in range(60)]
    return docs, labels


@pytest.mark.parametrize("most", [filter_audit.MOST_BROADCAST, 0])
def test_audit(spark, tables, most, monkeypatch):
    monkeypatch.setattr(filter_audit, "MOST_BROADCAST", most)
    docs, labels = tables
    df = spark.createDataFrame([(*d, "p", 1, 2, 3) for d in docs], DOCS)
    got = filter_audit.audit(df, spark.createDataFrame([(*x, 5, 6) for x in labels], LABELS))
    assert got.columns == ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    rows = [tuple(r) for r in got.collect()]
    assert len(rows) == 600 * 3 and set(rows) == brute(docs, labels)


def test_empty_tables(spark, tables):
    nothing = spark.createDataFrame([], LABELS)
    assert filter_audit.audit(spark.createDataFrame([], DOCS), nothing).collect() == []
    docs = spark.createDataFrame([(*d, "p", 1, 2, 3) for d in tables[0][:20]], DOCS)
    assert {(r["good_lost"], r["toxic_lost"]) for r in filter_audit.audit(docs, nothing).collect()} == {(0, 0)}


def test_sketch_clears_unique_texts_only(spark):
    """Never clears a repeated hash, and clears nearly all others; several segments."""
    hashes = [(i * 7919,) for i in range(30_000)] + [(i * 7919,) for i in range(0, 30_000, 10)]
    rows = spark.createDataFrame(hashes, "h long").repartition(7)
    bits = filter_audit.sketch(rows, 3)
    assert bits.count() == 3
    left = {r["h"] for r in filter_audit.maybe_repeated(rows, 3, bits).collect()}
    assert left >= {i * 7919 for i in range(0, 30_000, 10)} and len(left) < 3_100
