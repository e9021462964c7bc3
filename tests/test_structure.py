import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tablelake.operators import cells, hierarchy, ranking, sampling
from tablelake.operators.enrich import fill_durably, fill_missing, with_row_key

ROWS = "table_number string, row_index int, indent int, row_label string"


def walk(indents):
    """Ancestor chains by a stack of open rows."""
    out, stack = [], []
    for i, indent in enumerate(indents):
        while stack and stack[-1][0] >= indent:
            stack.pop()
        out.append([label for _, label in stack])
        stack.append((indent, f"r{i}"))
    return out


@pytest.mark.parametrize("indents", [[2, 0, 1, 1, 2, 0], [1, 1, 1], [0, 1, 2, 3], [0, 3, 1], [3, 2, 1, 0], [0]])
def test_ancestors_of_small_tables(spark, indents):
    rows = spark.createDataFrame([("t", i, d, f"r{i}") for i, d in enumerate(indents)], ROWS)
    got = hierarchy.with_ancestors(rows).orderBy("row_index").collect()
    assert [r["ancestors"] for r in got] == walk(indents)


@pytest.mark.parametrize("block", [1, 3, 4096, None])
def test_ancestors_across_blocks(spark, block):
    """One table holds most rows; chains must reach over any number of blocks."""
    random.seed(block or 0)
    tables = {f"t{n}": [random.choice([0, 1, 1, 2, 2, 3, 4]) for _ in range(120 if n == 0 else 5)] for n in range(8)}
    rows = spark.createDataFrame([(t, i, d, f"r{i}") for t, ds in tables.items() for i, d in enumerate(ds)], ROWS)
    got = hierarchy.with_ancestors(rows, block=block).collect()
    want = {(t, i): chain for t, ds in tables.items() for i, chain in enumerate(walk(ds))}
    assert {(r["table_number"], r["row_index"]): r["ancestors"] for r in got} == want
    assert len(got) == len(want)


def test_deep_indents_cost_no_more(spark):
    """Chains are arrays: levels in the thousands, negative ones and blocks of blocks."""
    random.seed(4)
    for levels in ([0, 5_000, 9_999], [-3, 0, 2_000_000_000], [1, 2, 3, 4, 5, 6, 7]):
        indents = [random.choice(levels) for _ in range(60)]
        rows = spark.createDataFrame([("t", i, d, f"r{i}", i * 2) for i, d in enumerate(indents)], ROWS + ", `odd name` int")
        got = hierarchy.with_ancestors(rows, block=2).orderBy("row_index").collect()
        assert [r["ancestors"] for r in got] == walk(indents) and [r["odd name"] for r in got] == [2 * i for i in range(60)]
    assert hierarchy.with_ancestors(rows.limit(0)).collect() == []


@pytest.mark.parametrize("block", [2, None])
def test_sections_across_blocks(spark, block):
    random.seed(1)
    lines = [(i, random.random() < 0.1, f"l{i}") for i in range(200)]
    want, current = {}, ""
    for i, heading, label in lines:
        if heading:
            current = label
        else:
            want[i] = current
    df = spark.createDataFrame([("t", *line) for line in lines],
                               "table_number string, row_index int, is_heading boolean, row_label string")
    got = hierarchy.carry_section(df, block=block).collect()
    assert {r["row_index"]: r["section"] for r in got} == want and len(got) == len(want)


def record(table, row, indent, label, *nums, section=""):
    values = [(i + 1, f"c{i + 1}", (n, None if isinstance(n, float) else str(n), False)
               if isinstance(n, float) or n is None else (None, n, False)) for i, n in enumerate(nums)]
    return (table, row, section, indent, label, values)


RECORD = ("table_number string, row_index int, section string, indent int, row_label string, "
          "cells array<struct<col_index:int,column_name:string,value:struct<num:double,text:string,is_int:boolean>>>")


def test_index_cells(spark):
    records = spark.createDataFrame([
        record("t", 0, 0, "A", 1.0, "†"), record("t", 1, 1, "x", 2.0, "word"), record("t", 2, 0, "B", 3.0, "-"),
        record("t", 3, 1, "x", 4.0, ""), record("t", 4, 0, "B", 5.0, "y"), record("t", 5, 0, "", 6.0, "z"),
        record("u", 0, 0, "B", 7.0, "z"),
    ], RECORD)
    got = {(r["table_number"], r["row_index"], r["col_index"], tuple(r["ancestors"])) for r in cells.index_cells(records).collect()}
    # Both `B` rows of t go, though not their children's distinct chains; u's own B stays.
    assert got == {("t", 0, 1, ()), ("t", 1, 1, ("A",)), ("t", 1, 2, ("A",)), ("t", 3, 1, ("B",)), ("u", 0, 1, ()), ("u", 0, 2, ())}


def members(spark, groups):
    rows = [(t, i, 1, "", [], label, (float(v), None, False)) for t, ms in groups.items() for i, (label, v) in enumerate(ms)]
    return spark.createDataFrame(rows, "table_number string, row_index int, col_index int, section string, "
                                       "ancestors array<string>, row_label string, value struct<num:double,text:string,is_int:boolean>")


def test_rankings(spark):
    groups = {
        "two": [("a", 9), ("b", 1)], "tie": [("a", 9), ("b", 9), ("c", 1)], "gap": [("a", 100), ("b", 98), ("c", 1)],
        "fair": [("b", 97), ("a", 100), ("c", 1)], "low": [("a", 0), ("b", -1), ("c", -2)],
        "years": [("a", 100), ("b", 50), ("c", 40), ("d", 30), ("e", 20), ("f", 10), ("2019-20", 1)],
        "totals": [("Total", 100), ("a", 9), ("b", 1), ("c", 5)], "ties below": [("a", 9), ("c", 1), ("b", 1)],
    }
    got = {r["table_number"]: [m["label"] for m in r["ranked"]]
           for r in ranking.rank_eligible(ranking.rank_members(members(spark, groups))).collect()}
    assert got == {"fair": ["a", "b", "c"], "totals": ["a", "c", "b"], "ties below": ["a", "c", "b"]}


def test_ranking_of_a_hot_group_keeps_its_top(spark):
    big = [(f"x{i}", i % 997) for i in range(5000)] + [("winner", 2000)]
    got = ranking.rank_eligible(ranking.rank_members(members(spark, {"t": big}))).collect()
    assert [m["label"] for m in got[0]["ranked"]][:1] == ["winner"] and len(got[0]["ranked"]) == 5


def greedy(rows, quotas, cap, draws):
    chosen, used = [], Counter()
    for kind, quota in quotas.items():
        taken = 0
        for ident, k, table in sorted((r for r in rows if r[1] == kind), key=lambda r: (draws[r[0]], r[0])):
            if taken >= quota:
                break
            if used[table] < cap:
                chosen.append(ident)
                used[table] += 1
                taken += 1
    return chosen


@pytest.mark.parametrize("seed", range(4))
def test_quota_sample_equals_the_greedy_loop(spark, seed):
    random.seed(seed)
    rows = [(f"q{i}", random.choice(["lookup", "rank"]), random.choice("aaaabcd")) for i in range(random.choice([5, 60, 200]))]
    df = spark.createDataFrame(rows, "id string, question_type string, table_number string")
    draws = {r["id"]: r["d"] for r in df.select("id", sampling.seeded(seed, F.col("id")).alias("d")).collect()}
    quotas = {"lookup": random.choice([3, 12, 500]), "rank": 5}
    got = [r["id"] for r in sampling.quota_sample(df, quotas, cap=3, seed=seed).collect()]
    assert sorted(got) == sorted(greedy(rows, quotas, 3, draws))


def test_scaled_quotas():
    assert sampling.scale_quotas({"lookup": 400, "rank": 100}, 20) == {"lookup": 16, "rank": 4}
    assert sampling.scale_quotas({"lookup": 400, "rank": 100}, 1) == {"lookup": 1, "rank": 1}


def test_row_keys_number_the_copies(spark, monkeypatch):
    monkeypatch.setattr("tablelake.operators.enrich.COPIES_PER_TASK", 4)
    df = spark.createDataFrame([("a", 1)] * 11 + [("b", None)] * 2 + [("b", 3)], "s string, n int")
    keys = [r["row_key"] for r in with_row_key(df).collect()]
    assert len(keys) == 14 and len(set(keys)) == 14
    assert sorted(k.split("-")[1] for k in keys) == sorted([str(i) for i in range(1, 12)] + ["1", "2", "1"])


def test_filling_resumes(spark):
    rows = [("a", "long text", None), ("b", " ", None), ("c", "done before", "kept"), ("d", "skip me", None), ("e", None, None)]
    df = spark.createDataFrame(rows, "k string, body string, summary string")

    def first_word(batch):
        words = batch["body"].str.split().str[0]
        return words.where(words != "skip", None)

    once = fill_missing(df, "summary", ["body"], first_word, "body")
    assert {r["k"]: r["summary"] for r in once.collect()} == {"a": "long", "b": None, "c": "kept", "d": None, "e": None}
    again = fill_missing(once, "summary", ["body"], lambda b: b["body"].str.upper(), "body")
    assert {r["k"]: r["summary"] for r in again.collect()} == {"a": "long", "b": None, "c": "kept", "d": "SKIP ME", "e": None}
    added = fill_missing(df.drop("summary"), "summary", ["body"], first_word, "body")
    assert {r["k"]: r["summary"] for r in added.collect()}["c"] == "done"


def test_row_keys_tell_rows_apart(spark):
    rows = [("\\N", "x"), (None, "x"), ("a\x1fb", "c"), ("a", "b\x1fc"), ("", None), (None, "")]
    keys = [r["row_key"] for r in with_row_key(spark.createDataFrame(rows, "a string, b string")).collect()]
    assert len(set(keys)) == len(rows)


def test_whitespace_of_any_kind_is_blank(spark):
    df = spark.createDataFrame([("a", "\n"), ("b", "\t "), ("c", "word")], "k string, body string")
    got = {r["k"]: r["s"] for r in fill_missing(df, "s", ["body"], lambda b: b["body"] + "!", "body").collect()}
    assert got == {"a": None, "b": None, "c": "word!"}


def test_accuracy_of_no_questions(spark):
    from tablelake.operators.grading import accuracy

    none = spark.createDataFrame([], "question_type string, correct boolean, present boolean")
    assert [(r["n_questions"], r["accuracy"]) for r in accuracy(none).collect()] == [(0, None)]


def test_values_paid_for_are_kept(spark, tmp_path):
    """A function that fails in the middle, twice; the last call asks for the rest only."""
    rows = [(f"k{i}", f"text {i}", None if i % 5 else "known") for i in range(60)] + [("blank", "  ", None), ("null", None, None)]
    df = spark.createDataFrame(rows, "key string, body string, summary string").repartition(6)
    ledger, log = f"{tmp_path}/ledger", tmp_path / "asked"

    def tiring(stop):
        def fn(batch):
            assert list(batch.columns) == ["body"]
            if stop and batch["body"].str.contains(stop).any():
                raise RuntimeError("tired")
            with open(log, "a") as file:
                file.write("".join(f"{b}\n" for b in batch["body"]))
            return batch["body"].str.upper()
        return fn

    first = fill_durably(df, "key", "summary", ["body"], tiring("text 7"), "body", ledger, per_round=20)
    assert first.problem == "RuntimeError: tired" and 0 < first.updated < 48
    assert first.table.where("summary IS NOT NULL").count() == first.updated + 12
    second = fill_durably(df, "key", "summary", ["body"], tiring(None), "body", ledger, per_round=20)
    assert second.problem is None and first.updated + second.updated == 48
    asked = log.read_text().split("\n")[:-1]
    assert len(asked) == len(set(asked)) == 48
    got = {r["key"]: r["summary"] for r in second.table.collect()}
    assert got == {k: s or (b.upper() if b and b.strip() else None) for k, b, s in rows}
    again = fill_durably(df.drop("summary"), "key", "summary", ["body"], tiring("never"), "body", f"{tmp_path}/other")
    assert again.updated == 60 and again.table.columns == df.columns
