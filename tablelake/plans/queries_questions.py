"""Question sets: records, wording, resuming, re-derivation and grading."""
from __future__ import annotations

import hashlib
import uuid

from pyspark.sql import functions as F

from tablelake.fixed_values import QUOTAS
from tablelake.operators import checking, grading, profile, questions, sampling
from tablelake.plans.queries_cells import _LOOKUPS, _MEMBERS, _RANKS, indexed
from tablelake.plans.registry import query
from tablelake.session import materialise, shared_folder
from tablelake.sources import runs

# A digit per id that decides how its prediction or record is altered.
_K = "(instr('0123456789abcdef', substring(md5(id), 1, 1)) - 1)"


def k():
    return F.instr(F.lit("0123456789abcdef"), F.substring(F.md5("id"), 1, 1)) - 1


# ---- records --------------------------------------------------------------------
def _selected(tables):
    """Candidates of all tables reduced to a set of 100 questions, template wording."""
    cells = materialise(indexed(tables), "cells")
    pool = sampling.sample_per_group(cells, ["table_number"], ["table_number", "row_index", "col_index"])
    lookups = questions.lookup_candidates(pool, questions.column_wordings(cells))
    ranks = sampling.sample_per_group(questions.rank_candidates(cells), ["table_number"], ["id"])
    every = materialise(lookups.unionByName(ranks, allowMissingColumns=True), "candidates")
    chosen = sampling.quota_sample(every, sampling.scale_quotas(QUOTAS, 100))
    return questions.to_records(questions.word_questions(chosen))


_SET = f"""WITH {_MEMBERS},
lookups AS (SELECT * FROM ({_LOOKUPS.replace("FROM usable", "FROM usable QUALIFY row_number() OVER (PARTITION BY table_number ORDER BY md5('0|' || table_number || '|' || row_index || '|' || col_index)) <= 10")})),
ranks AS (SELECT * FROM ({_RANKS}) QUALIFY row_number() OVER (PARTITION BY table_number ORDER BY md5('0|' || id)) <= 10),
l AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY table_number ORDER BY md5('0|' || id)) AS rk FROM lookups)
      WHERE rk <= 5 ORDER BY md5('0|' || id) LIMIT 80),
r AS (SELECT * FROM (SELECT s.*, row_number() OVER (PARTITION BY s.table_number ORDER BY md5('0|' || id)) AS rk,
             5 - (SELECT count(*) FROM l WHERE l.table_number = s.table_number) AS free FROM ranks s)
      WHERE rk <= free ORDER BY md5('0|' || id) LIMIT 20)"""


@query("question_records", f"""{_SET}
SELECT id, template AS question, coalesce(num, -1) AS answer_num, coalesce(txt, '') AS answer_label, answer_type,
  CASE answer_type WHEN 'number' THEN 0.01 ELSE 0.0 END::DOUBLE AS tolerance, question_type, unit, years, 'template' AS phrasing,
  descriptor, table_number, section, row_label AS first_label, -1.0::DOUBLE AS margin, '' AS options FROM l
UNION ALL
SELECT id, template, -1, answer_label, 'label', 0.0, question_type, unit, years, 'template', descriptor, table_number, section, answer_label,
  margin, options FROM r""")
def question_records(tables):
    p = F.col("provenance")
    return _selected(tables).select(
        "id", "question", F.coalesce("answer_num", F.lit(-1.0)).alias("answer_num"),
        F.coalesce("answer_label", F.lit("")).alias("answer_label"), "answer_type", "tolerance", "question_type", "unit",
        F.array_join(F.col("years").cast("array<string>"), ",").alias("years"), "phrasing", "descriptor",
        p["table_number"].alias("table_number"),
        F.coalesce(F.get(p["cells"], F.lit(0))["section"], p["group"]["section"]).alias("section"),
        F.coalesce(F.get(p["cells"], F.lit(0))["row_label"], F.get(p["group"]["candidates"], F.lit(0))["label"]).alias("first_label"),
        F.coalesce("margin", F.lit(-1.0)).alias("margin"),
        F.coalesce(F.array_join("options", "; "), F.lit("")).alias("options"))


@query("set_profile", f"""{_SET},
q AS (SELECT question_type, table_number FROM l UNION ALL SELECT question_type, table_number FROM r)
SELECT 'type' AS measure, question_type AS name, count(*) AS n FROM q GROUP BY question_type
UNION ALL SELECT 'phrasing', 'template', count(*) FROM q
UNION ALL SELECT 'tables', 'distinct', count(DISTINCT table_number) FROM q
UNION ALL SELECT 'tables', 'max per table', max(n) FROM (SELECT count(*) AS n FROM q GROUP BY table_number)""")
def set_profile(tables):
    return profile.set_profile(_selected(tables).select("question_type", "phrasing", "provenance.table_number"))


@query("word_questions", f"WITH {_MEMBERS} SELECT id, template AS question, 'template' AS phrasing FROM ({_RANKS})")
def word_questions(tables):
    return questions.word_questions(questions.rank_candidates(indexed(tables))).select("id", "question", "phrasing")


_SAID = "'Tell me: ' || replace(descriptor, chr(10), ' ')"


def stand_in(batch):
    """Wordings of a deterministic function: good ones, empty, leaking and lossy ones, some only at the first attempt."""
    digit = batch["id"].map(lambda i: int(hashlib.md5(i.encode()).hexdigest()[0], 16))
    hint = batch["descriptor"].str.rsplit("\n", n=1)
    good = "Tell me: " + hint.str[0].str.replace("\n", " ")
    first = batch["attempt"] == 1
    out = good.mask(first & digit.isin([3, 4]), "").mask(digit.isin([5, 6]), good + " " + hint.str[1])
    return ('"' + out.mask((first & digit.isin([7, 8])) | (digit == 9), "What is it?") + '"').mask(first & digit.isin([3]), None)


@query("word_questions_fn", f"""WITH {_MEMBERS},
every AS (
  SELECT *, {_K} AS k, {_SAID} AS said FROM (
    SELECT id, 'lookup' AS question_type, descriptor, template, num FROM ({_LOOKUPS})
    UNION ALL SELECT id, 'rank', descriptor, template, NULL FROM ({_RANKS}))),
judged AS (
  SELECT id, template, CASE WHEN k IN (5, 6) THEN said || ' ' || coalesce(CAST(CAST(num AS DECIMAL(18,2)) AS VARCHAR), 'words') ELSE said END AS said,
    CASE WHEN k = 9 OR (k IN (5, 6) AND num IS NOT NULL) THEN NULL WHEN k IN (3, 4, 7, 8) THEN 2 ELSE 1 END AS attempt,
    CASE WHEN k IN (3, 4) THEN 'empty' WHEN k IN (5, 6) AND num IS NOT NULL THEN 'leaks' WHEN k IN (7, 8, 9) THEN 'lossy' ELSE 'accepted' END AS first_verdict FROM every)
SELECT id, CASE WHEN attempt IS NULL THEN template ELSE said END AS question, CASE WHEN attempt IS NULL THEN 'template' ELSE 'llm' END AS phrasing,
  coalesce(attempt, 0) AS attempt, first_verdict FROM judged""")
def word_questions_fn(tables):
    """All candidates worded by a function, with the attempt that was accepted (0: none) and what became of the first."""
    cells = materialise(indexed(tables), "cells")
    every = questions.lookup_candidates(cells, questions.column_wordings(cells)).unionByName(questions.rank_candidates(cells), allowMissingColumns=True)
    hint = F.coalesce(F.col("answer_num").cast("decimal(18,2)").cast("string"), F.lit("words"))
    every = materialise(every.select("id", F.concat("descriptor", F.lit("\n"), hint).alias("descriptor"), "template", "answer_num", "required_tokens", "years"), "candidates")
    queue = f"{shared_folder(tables.spark)}/queue-{uuid.uuid4().hex}"
    worded = questions.word_questions(every, stand_in, queue=queue)
    log = runs.read(tables.spark, queue).groupBy("id").agg(
        F.max(F.when(F.col("verdict") == questions.ACCEPTED, F.col("attempt"))).alias("attempt"), F.min_by("verdict", "attempt").alias("first_verdict"))
    return worded.join(log, "id").select("id", "question", "phrasing", F.coalesce("attempt", F.lit(0)).alias("attempt"), "first_verdict")


@query("resume_anti_join", """
SELECT CAST(o_orderkey AS VARCHAR) AS id, CASE WHEN o_orderkey % 3 = 0 THEN 'kept ' || o_orderpriority ELSE 'new' END AS question
FROM orders WHERE o_orderstatus <> 'P'""")
def resume(tables):
    """Existing records of chosen ids are reused, others dropped, the rest made anew."""
    o = tables.orders.select(F.col("o_orderkey").cast("string").alias("id"), "o_orderkey", "o_orderstatus", "o_orderpriority")
    chosen = o.where("o_orderstatus <> 'P'").select("id")
    existing = o.where("o_orderkey % 3 = 0").select("id", F.concat(F.lit("kept "), F.col("o_orderpriority")).alias("question"))
    done, todo = questions.resume(chosen, existing)
    return done.unionByName(todo.withColumn("question", F.lit("new")))


# ---- re-derivation ------------------------------------------------------------------
def _lookup_questions(cells):
    q = questions.lookup_candidates(cells, questions.column_wordings(cells))
    return q.select("id", "table_number", "cell.section", "cell.ancestors", F.when(k() == 1, "nobody").otherwise(
        F.col("cell.row_label")).alias("row_label"), "cell.column_name",
        F.when(k() == 0, F.col("answer_num") + 1).otherwise(F.col("answer_num")).alias("answer_num"), "answer_label",
        F.col("template").alias("question"), "years")


@query("check_lookup", f"""
WITH {_MEMBERS}
SELECT id, CASE WHEN k = 1 THEN 0 ELSE 1 END AS n_hits, CASE WHEN k = 1 OR (k = 0 AND num IS NOT NULL) THEN 1 ELSE 0 END AS failed
FROM (SELECT *, {_K} AS k FROM ({_LOOKUPS}))""")
def check_lookup(tables):
    cells = materialise(indexed(tables), "cells")
    return checking.check_lookup(_lookup_questions(cells), cells).select(
        "id", "n_hits", F.col("failure").isNotNull().cast("int").alias("failed"))


def _rank_questions(cells):
    q = questions.rank_candidates(cells)
    return q.select("id", "table_number", "group.section", "group.ancestors",
                    F.when(k() == 2, "no column").otherwise(F.col("group.column_name")).alias("column_name"),
                    F.when(k() == 0, "nobody").otherwise(F.col("answer_label")).alias("answer_label"),
                    F.when(k() == 1, F.array(F.lit("other"))).otherwise(F.col("options")).alias("options"))


@query("check_rank", f"""
WITH {_MEMBERS}
SELECT id, CASE WHEN k = 2 THEN '' ELSE answer_label END AS top_label,
  CASE k WHEN 2 THEN 'ranking group no longer qualifies' WHEN 0 THEN 'top is ' || answer_label || ', recorded nobody'
    WHEN 1 THEN 'answer is not among the options offered' ELSE '' END AS failure
FROM (SELECT *, {_K} AS k FROM ({_RANKS}))""")
def check_rank(tables):
    cells = materialise(indexed(tables), "cells")
    return checking.check_rank(_rank_questions(cells), cells).select(
        "id", F.coalesce("top_label", F.lit("")).alias("top_label"), F.coalesce("failure", F.lit("")).alias("failure"))


@query("check_orphans", f"""
WITH {_MEMBERS} SELECT id, 'table not in source' AS failure FROM ({_RANKS}) WHERE substring(table_number, 1, 2) = '34'""")
def check_orphans(tables):
    cells = materialise(indexed(tables), "cells")
    known = cells.select("table_number").where("substring(table_number, 1, 2) <> '34'").distinct()
    return checking.check_orphans(questions.rank_candidates(cells), known)


@query("check_questions", f"""
WITH {_MEMBERS}
SELECT id, CASE WHEN substring(table_number, 1, 2) = '34' THEN 'table not in source' WHEN k = 1 THEN '0 rows match its coordinates'
       ELSE 'other' END AS failure
FROM (SELECT *, {_K} AS k FROM ({_LOOKUPS})) WHERE substring(table_number, 1, 2) = '34' OR k = 1 OR (k = 0 AND num IS NOT NULL)
UNION ALL
SELECT id, CASE WHEN substring(table_number, 1, 2) = '34' THEN 'table not in source' WHEN k = 2 THEN 'ranking group no longer qualifies'
       WHEN k = 1 THEN 'answer is not among the options offered' ELSE 'other' END
FROM (SELECT *, {_K} AS k FROM ({_RANKS})) WHERE substring(table_number, 1, 2) = '34' OR k <= 2""")
def check_questions(tables):
    cells = materialise(indexed(tables), "cells")
    known = cells.select("table_number").where("substring(table_number, 1, 2) <> '34'").distinct()
    lookups = materialise(_lookup_questions(cells), "lookups")
    ranks = materialise(_rank_questions(cells), "ranks")
    found = checking.check_questions(lookups, ranks, cells, known)
    differs = F.col("failure").contains(" != ") | F.col("failure").startswith("top is ")
    return found.withColumn("failure", F.when(differs, "other").otherwise(F.col("failure")))


# ---- grading -----------------------------------------------------------------------------
# Predictions for lookups (numbers and words) and rank questions: right, near, wrong, blank, absent.
_GUESS = f"""
SELECT id, CASE WHEN num IS NULL THEN CASE WHEN k < 5 THEN '  ' || upper(label) || '!' WHEN k = 5 THEN NULL ELSE 'no ' || label END ELSE CASE k
    WHEN 0 THEN CAST(d AS STRING) WHEN 1 THEN CAST(d * 1.005 AS STRING) WHEN 2 THEN CAST(d * 1.03 AS STRING)
    WHEN 3 THEN '$' || CAST(d AS STRING) WHEN 4 THEN CAST(d AS STRING) || ' %' WHEN 5 THEN 'unknown' WHEN 6 THEN NULL
    WHEN 8 THEN CAST(d * 1.01 AS STRING) WHEN 9 THEN CAST(d * 0.99 AS STRING) ELSE '-' || CAST(d AS STRING) END END AS answer
FROM (SELECT id, {_K} AS k, num, label, CAST(num AS DECIMAL(18,2)) AS d FROM {{source}}) g WHERE k <> 7"""


def _six(x: str) -> str:
    """Six significant digits of a double as text in DuckDB, with thousands set apart; over a million as a power of ten."""
    d = f"CAST(CAST({x} AS VARCHAR) AS DECIMAL(30,8))"
    power = f"(length(CAST(CAST(trunc(abs({d})) AS BIGINT) AS VARCHAR)) - 1)"
    cut = lambda t: f"regexp_replace(regexp_replace(CAST({t} AS VARCHAR), '(\\.\\d*?)0+$', '\\1'), '\\.$', '')"
    plain = " ".join(f"WHEN abs({d}) < 1{'0' * n} THEN {cut(f'round({d}, {6 - n})')}" for n in range(1, 7))
    apart = f"regexp_replace(CASE {plain} END, '^(-?\\d{{1,3}})(\\d{{3}})(\\.|$)', '\\1,\\2\\3')"
    mantissa = cut(f"round(CAST(CAST({d} AS VARCHAR) AS DECIMAL(38,14)) / CAST(pow(10, {power}) AS BIGINT), 5)")
    return f"CASE WHEN abs({d}) < 999999.5 THEN {apart} ELSE {mantissa} || 'e+' || lpad(CAST({power} AS VARCHAR), 2, '0') END"


_GRADED = f"""WITH {_MEMBERS},
q AS (SELECT id, 'lookup' AS question_type, num, CASE WHEN num IS NULL THEN 'withheld' END AS label FROM ({_LOOKUPS})
      UNION ALL SELECT id, 'rank', NULL, answer_label FROM ({_RANKS})),
p AS ({_GUESS.format(source="q")}),
j AS (SELECT q.*, p.answer, p.id IS NOT NULL AS present, TRY_CAST(regexp_replace(p.answer, '[,$%\\s]', '', 'g') AS DOUBLE) AS got FROM q LEFT JOIN p ON p.id = q.id),
c AS (
  SELECT *, CASE WHEN NOT present THEN false WHEN num IS NULL THEN coalesce(trim(regexp_replace(regexp_replace(lower(answer), '[^a-z0-9\\s]', ' ', 'g'), '\\s+', ' ', 'g')), 'none')
       = trim(regexp_replace(regexp_replace(lower(label), '[^a-z0-9\\s]', ' ', 'g'), '\\s+', ' ', 'g'))
     ELSE coalesce(abs(got - num) <= abs(num) * CAST(0.01 AS DOUBLE), false) END AS correct FROM j),
graded AS (
  SELECT *, CASE WHEN correct THEN '' WHEN NOT present THEN 'no prediction'
      WHEN num IS NULL THEN coalesce('''' || answer || '''', 'None') || ' vs ''' || label || ''''
      WHEN got IS NULL THEN 'not a number: ' || coalesce('''' || answer || '''', 'None')
      ELSE {_six("got")} || ' vs ' || {_six("num")} || ' (' || printf('%+.2f', (got - num) / num * 100) || '%)' END AS reason FROM c)"""


def _graded(tables):
    """Every lookup and every rank question of the derived report, graded."""
    cells = materialise(indexed(tables), "cells")
    asked = questions.lookup_candidates(cells, questions.column_wordings(cells)).unionByName(questions.rank_candidates(cells), allowMissingColumns=True)
    q = materialise(asked.select("id", "question_type", "answer_num", "answer_label", "answer_type", F.when(
        F.col("answer_type") == "number", 0.01).otherwise(0.0).alias("tolerance")), "questions")
    given = tables.spark.sql(_GUESS.format(source="{source}"), source=q.withColumnsRenamed({"answer_num": "num", "answer_label": "label"}))
    return grading.grade(q, given)


@query("grade_answers", f"{_GRADED} SELECT id, question_type, correct, reason FROM graded")
def grade_answers(tables):
    return _graded(tables).select("id", "question_type", "correct", "reason")


@query("grade_join", f"{_GRADED} SELECT id, question_type, present, coalesce(answer, '') AS predicted FROM graded")
def grade_join(tables):
    return _graded(tables).select("id", "question_type", "present", F.coalesce("predicted", F.lit("")).alias("predicted"))


@query("accuracy_rollup", f"""{_GRADED}
SELECT coalesce(question_type, 'all') AS question_type, count(*) AS n_questions, count(*) FILTER (WHERE correct) AS n_correct,
  count(*) FILTER (WHERE NOT present) AS n_missing, round(count(*) FILTER (WHERE correct) / count(*), 6) AS accuracy
FROM graded GROUP BY ROLLUP (question_type)""")
def accuracy_rollup(tables):
    return grading.accuracy(_graded(tables)).withColumns({
        "question_type": F.coalesce("question_type", F.lit("all")), "accuracy": F.round("accuracy", 6)})


@query("top_failures", f"""{_GRADED}
SELECT id, '[' || question_type || '] ' || id || ': ' || reason AS line, (SELECT count(*) FROM graded WHERE NOT correct) AS total
FROM graded WHERE NOT correct ORDER BY id LIMIT 25""")
def top_failures(tables):
    return grading.failures(materialise(_graded(tables), "graded"), 25)


@query("run_totals", """
SELECT count(*) FILTER (WHERE o_orderstatus = 'F') AS n_written, count(*) FILTER (WHERE o_orderstatus = 'O') AS n_failed,
  count(*) FILTER (WHERE o_orderstatus = 'P' AND o_custkey % 2 = 0) AS n_other_source,
  count(*) FILTER (WHERE o_orderstatus = 'P' AND o_custkey % 2 = 1) AS n_out_of_range,
  CAST(sum(o_custkey % 5) AS BIGINT) AS dropped_rows, CAST(sum(o_custkey % 3) AS BIGINT) AS dropped_columns FROM orders""")
def run_totals(tables):
    """Orders stand for pages, their status for what became of them."""
    status = (F.when(F.col("o_orderstatus") == "F", "written").when(F.col("o_orderstatus") == "O", "failed")
              .when(F.col("o_custkey") % 2 == 0, "other source").otherwise("no data in range"))
    return profile.run_totals(tables.orders.select(
        status.alias("status"), (F.col("o_custkey") % 5).alias("dropped_rows"), (F.col("o_custkey") % 3).alias("dropped_columns")))
