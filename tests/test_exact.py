"""Exact percentiles and bag operations against plain Python."""
import random
from collections import Counter

import pytest

from tablelake.operators import exact


def percentile(values, p):
    values, at = sorted(values), p * (len(values) - 1)
    low, high = values[int(at)], values[min(int(at) + 1, len(values) - 1)]
    return low + (high - low) * (at - int(at))


@pytest.mark.parametrize("ranges", [50, 1024])
def test_percentiles(spark, ranges, monkeypatch):
    monkeypatch.setattr(exact, "RANGES", ranges)
    rng = random.Random(ranges)
    groups = {"one": [5.0], "ties": [1.0] * 50 + [2.0] * 7, "far": [rng.choice([-1e9, -3.5, 0.0, 1e-6, 2.0, 1e12]) for _ in range(60)],
              "many": [rng.gauss(0, 100) for _ in range(400)], None: [rng.random() for _ in range(9)]}
    rows = [(g, v) for g, vs in groups.items() for v in vs] + [("one", None), ("one", float("nan")), ("none", None)]
    shares = {"lowest": 0.0, "third": 1 / 3, "middle": 0.5, "most": 0.9, "highest": 1.0}
    got = {r["g"]: r for r in exact.exact_percentiles(spark.createDataFrame(rows, "g string, v double"), "g", "v", shares).collect()}
    assert set(got) == {*groups, "none"} and got["none"]["middle"] is None
    for g, values in groups.items():
        assert [got[g][name] for name in shares] == pytest.approx([percentile(values, p) for p in shares.values()], rel=1e-12, abs=1e-12)
    assert exact.exact_percentiles(spark.createDataFrame([], "g string, v double"), "g", "v", shares).collect() == []


@pytest.mark.parametrize("copies", [3, 1 << 16])
def test_bags(spark, copies, monkeypatch):
    monkeypatch.setattr(exact, "COPIES", copies)
    rng = random.Random(3)
    left, right = ([(rng.choice([1, 2, None]), rng.choice("ab")) for _ in range(n)] for n in (90, 40))
    a, b = (spark.createDataFrame(rows, "x int, y string") for rows in (left, right))
    count = Counter(left), Counter(right)
    assert Counter(map(tuple, exact.except_all(a, b).collect())) == count[0] - count[1]
    assert Counter(map(tuple, exact.intersect_all(a, b).collect())) == count[0] & count[1]
    assert exact.except_all(b.limit(0), a).collect() == []
