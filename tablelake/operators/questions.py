"""Question candidates over cells, their records, wording, and resuming a set."""
from __future__ import annotations

import uuid
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablelake.fixed_values import (ID_PREFIX, MAX_RANK_OPTIONS, PARAPHRASE_ATTEMPTS, PHRASED_BY_FUNCTION,
                                    PHRASED_BY_TEMPLATE, QUESTION_LEAD,
                                    RANK_QUESTION_TYPE, SLUG_LENGTH, TOLERANCE)
from tablelake.functions.text import (column_path, describe, distinctive_tokens, own_year_label, padded, row_path, slug, topic,
                                      unhyphenate, unit_at, unit_rank)
from tablelake.functions.values import leaks_answer, qualifiers_kept
from tablelake.functions.years import years_of_column, years_of_row
from tablelake.operators.enrich import answered
from tablelake.operators.ranking import rank_eligible, rank_members
from tablelake.operators.sampling import seeded
from tablelake.session import materialise, shared_folder
from tablelake.sources import runs

TABLE_COLUMNS = ("title", "table_years", "edition_year", "page_url")


def row_context(rows: DataFrame, label: Column | None = None) -> DataFrame:
    """What the cells of a row share of their wording: topic, unit of the title, years unless the column names any, path and its tokens.

    Given to `index_cells` as `per_row` it is worked out once per row; cells without it get it one by one.
    """
    label = F.col("row_label") if label is None else label
    return rows.withColumns({
        "row_years": years_of_row(label, F.col("section"), F.col("ancestors"), F.col("table_years")),
        "section": F.coalesce("section", F.lit("")),
        "topic": topic(F.col("title")), "title_unit": unit_rank(F.col("title")),
        "row_text": unhyphenate(row_path(F.col("ancestors"), label)),
    }).withColumn("row_tokens", distinctive_tokens(F.col("row_text")))


def column_context(cells: DataFrame) -> DataFrame:
    """What the cells of a column name share of their wording: its years and year label, its clause with and without years, its unit."""
    column = F.col("column_name")
    return cells.withColumns({
        "column_years": years_of_column(column), "column_said": own_year_label(column), "column_unit": unit_rank(column),
        "plain_text": F.array_join(column_path(column), " > "), "undated_text": F.array_join(column_path(column, True), " > "),
    }).withColumns({"plain_tokens": distinctive_tokens(F.col("plain_text")), "undated_tokens": distinctive_tokens(F.col("undated_text"))})


def column_wordings(names: DataFrame) -> DataFrame:
    """The `column_context` of each distinct `column_name`, written once: names are few, cells many."""
    return materialise(column_context(names.select("column_name").distinct()), "column-wordings")


def _context(cells: DataFrame, label: Column | None = None, columns: DataFrame | None = None) -> DataFrame:
    """Topic, unit, years, year wording, column clause and its tokens of each cell or group."""
    known = cells if "row_years" in cells.columns else row_context(cells, label)
    if columns is None:
        known = column_context(known)
    else:
        worded = columns.withColumnRenamed("column_name", "_name")
        known = known.join(worded, F.col("column_name").eqNullSafe(F.col("_name")), "left").drop("_name")
    years = F.coalesce("column_years", "row_years")
    said = F.coalesce("column_said", F.array_join(F.slice(years.cast("array<string>"), 1, 2), "-"))
    dated = F.col("year_text") != ""
    return known.withColumns({"years": years, "year_text": said, "unit": unit_at(F.least("title_unit", "column_unit"))}).withColumns({
        "col_text": F.when(dated, F.col("undated_text")).otherwise(F.col("plain_text")),
        "col_tokens": F.when(dated, F.col("undated_tokens")).otherwise(F.col("plain_tokens"))})


def _phrase(before: str, text: Column, after: str = "") -> Column:
    """`before text after`, or nothing when there is no text."""
    return F.when(text != "", F.concat(F.lit(before), text, F.lit(after))).otherwise("")


def lookup_candidates(cells: DataFrame, columns: DataFrame | None = None) -> DataFrame:
    """One question per cell: what figure is reported at these coordinates?

    With the `column_wordings` of its column names given, a name is taken apart once, not once per cell.
    """
    out = _context(cells, columns=columns)
    col_text, year_text = F.col("col_text"), F.col("year_text")
    number = F.col("value.num")
    return out.select(
        F.concat(F.lit(ID_PREFIX), F.coalesce("table_number", F.lit("null")), F.lit("::lookup::r"), padded(F.col("row_index"), 4),
                 F.lit("::c"), padded(F.col("col_index"), 2)).alias("id"),
        F.lit("lookup").alias("question_type"),
        "table_number", *TABLE_COLUMNS,
        number.alias("answer_num"),
        F.when(number.isNull(), F.col("value.text")).alias("answer_label"),
        F.when(number.isNull(), "label").otherwise("number").alias("answer_type"),
        "unit", "years",
        describe(("question_type", F.lit("lookup")), ("table", F.col("topic")), ("section", F.col("section")),
                 ("row", F.col("row_text")), ("column", col_text), ("year", year_text),
                 ("unit", F.col("unit"))).alias("descriptor"),
        F.concat(
            F.lit(QUESTION_LEAD), F.lower("topic"), _phrase(" (", F.col("section"), ")"),
            F.lit(", what figure is reported for "), F.col("row_text"),
            _phrase(" under ", col_text), _phrase(" in ", year_text), F.lit("?")).alias("template"),
        F.concat("row_tokens", "col_tokens").alias("required_tokens"),
        F.struct("section", "ancestors", "row_label", "column_name", "value").alias("cell"),
    )


def rank_candidates(cells: DataFrame, seed: int = 0) -> DataFrame:
    """One multiple-choice question per fairly rankable sibling group.

    The groups are written once, as both the questions and the search for
    shared ids read them.
    """
    # The table's own columns ride along with the ranked members.
    carry = ("column_name", *TABLE_COLUMNS)
    groups = materialise(rank_eligible(rank_members(cells), carry=carry), "ranked-groups")
    lead = F.get("ranked", F.lit(0))
    groups = groups.withColumns({c: lead[c] for c in carry})
    group_id = F.concat_ws("|", "table_number", F.col("col_index").cast("string"), "section",
                           F.array_join("ancestors", ">"))
    drawn = F.array_sort(F.transform("ranked", lambda r: F.struct(
        seeded(seed, group_id, r["label"]).alias("draw"), r["rank"].alias("rank"), r["label"].alias("label"))))
    out = _context(groups, lead["label"]).withColumn(
        "options", F.transform(drawn, lambda d: unhyphenate(d["label"])))
    options, n = F.col("options"), F.size("options")
    measure = F.coalesce(F.nullif(F.col("col_text"), F.lit("")),
                         F.replace("unit", F.lit("count"), F.lit("figure")))
    section_slug = F.coalesce(F.nullif(slug(F.coalesce(F.nullif(F.col("section"), F.lit("")), F.lit("all")),
                                            SLUG_LENGTH), F.lit("")), F.lit("all"))
    chain_slug = slug(F.array_join("ancestors", "-"), SLUG_LENGTH)
    tokens = F.flatten(F.transform(options, lambda o: F.slice(distinctive_tokens(o), 1, 2)))
    named = out.select(
        F.concat(F.format_string(ID_PREFIX + "%s::rank::c%02d::%s", F.col("table_number"), F.col("col_index"),
                                 section_slug), _phrase("::", chain_slug)).alias("id"),
        F.lit("rank").alias("question_type"),
        "table_number", *TABLE_COLUMNS,
        unhyphenate(lead["label"]).alias("answer_label"),
        F.lit("label").alias("answer_type"), "unit", "years",
        describe(("question_type", F.lit(RANK_QUESTION_TYPE)), ("table", F.col("topic")),
                 ("section", F.col("section")), ("group", F.array_join("ancestors", " > ")),
                 ("column", F.col("col_text")), ("year", F.col("year_text")), ("unit", F.col("unit")),
                 ("options", F.array_join(options, "; "))).alias("descriptor"),
        F.concat(
            F.lit(QUESTION_LEAD), F.lower("topic"), _phrase(" (", F.col("section"), ")"),
            F.lit(", which of the following had the highest "), measure, _phrase(" in ", F.col("year_text")),
            F.lit(": "), F.array_join(F.slice(options, F.lit(1), n - 1), ", "), F.lit(", or "),
            F.get(options, n - 1), F.lit("?")).alias("template"),
        tokens.alias("required_tokens"),
        F.round("margin", 4).alias("margin"), "options",
        F.struct(
            "column_name", "section", "ancestors",
            F.transform(F.slice("ranked", 1, MAX_RANK_OPTIONS),
                        lambda r: F.struct(r["label"].alias("label"), r["value"].alias("value"))).alias("candidates"),
        ).alias("group"),
        F.substring(F.md5(F.concat_ws("|", "section", F.array_join("ancestors", ">"))), 1, 8).alias("_mark"),
    )
    # Cut slugs can make two groups of a column share an id; only those get the mark.
    shared = named.groupBy("id").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1")
    return named.join(shared, "id", "left").withColumn(
        "id", F.when(F.col("_n").isNotNull(), F.concat_ws("::", "id", "_mark")).otherwise(F.col("id"))
    ).drop("_mark", "_n")


QUEUE = "id string, attempt int, question string, verdict string"


def word_questions(candidates: DataFrame, fn: Callable[[pd.DataFrame], pd.Series] | None = None,
                   attempts: int = PARAPHRASE_ATTEMPTS, queue: str | None = None) -> DataFrame:
    """Adds `question` and `phrasing`.

    `fn` words a batch from its ids and descriptors (it never sees answers) and is told the attempt. Empty,
    leaking or lossy wordings are tried again, then the template stands in.

    Attempts are runs of a queue (`id, attempt, question, verdict`), judged as they are written, so wordings are paid for once however
    often the result is read. An error in `fn` fails the call, but not before the wordings of other rows are in the queue; with a `queue` folder given,
    a later call goes on from there.
    """
    if fn is None:
        return candidates.withColumn("question", F.col("template")).withColumn("phrasing", F.lit(PHRASED_BY_TEMPLATE))
    spark = candidates.sparkSession
    queue = queue or f"{shared_folder(spark)}/wording-{uuid.uuid4().hex}"
    answer = F.col("answer_num") if "answer_num" in candidates.columns else F.lit(None).cast("double")
    asked = materialise(candidates.select(F.col("id").cast("string").alias("id"), "descriptor", answer.alias("answer"), "required_tokens", "years"), "wording-candidates")
    state = lambda: runs.read(spark, queue, schema=QUEUE).groupBy("id").agg(
        F.max("attempt").alias("tried"), F.max(F.when(F.col("verdict") == ACCEPTED, F.col("question"))).alias("question"))
    for attempt in range(1, attempts + 1):
        todo = asked.join(state(), "id", "left").where((F.coalesce("tried", F.lit(0)) < attempt) & F.col("question").isNull())
        batch = todo.select("id", "descriptor", F.lit(attempt).alias("attempt"), F.col("id").alias("_id"))
        told = materialise(answered(batch, fn, ["_id"]), "wording")
        problem = told.agg(F.min("problem")).first()[0]
        wording = told.where("problem IS NULL").select(F.col("_id").alias("id"), F.regexp_replace(F.trim("value"), '^"+|"+$', "").alias("question"))
        judged = asked.join(wording, "id").select("id", F.lit(attempt).alias("attempt"), "question", verdict(
            F.col("question"), F.col("answer"), F.col("required_tokens"), F.col("years")).alias("verdict"))
        runs.commit(judged, queue)
        if problem is not None:
            raise RuntimeError(f"wording failed: {problem}")
    found = state().where("question IS NOT NULL").select(F.col("id").alias("_id"), F.col("question").alias("_question"))
    met = candidates.join(found, F.col("id").cast("string") == F.col("_id"), "left")
    return met.withColumns({
        "question": F.coalesce("_question", "template"),
        "phrasing": F.when(F.col("_question").isNotNull(), PHRASED_BY_FUNCTION).otherwise(PHRASED_BY_TEMPLATE)}).drop("_id", "_question")


ACCEPTED = "accepted"


def verdict(question: Column, answer: Column, tokens: Column, years: Column) -> Column:
    """What is wrong with a wording, if anything."""
    leaks = F.coalesce(leaks_answer(question, answer, years), F.lit(False))
    kept = F.coalesce(qualifiers_kept(question, tokens, years), F.lit(False))
    return F.when(F.coalesce(question, F.lit("")) == "", "empty").when(leaks, "leaks").when(~kept, "lossy").otherwise(ACCEPTED)


def to_records(worded: DataFrame) -> DataFrame:
    """Nested question records; tolerance applies to numbers only."""
    optional = {
        "answer_num": "double", "answer_label": "string", "margin": "double", "options": "array<string>",
        "cell": None, "group": None,
    }
    have = {c: F.col(c) if c in worded.columns else F.lit(None).cast(t or "string") for c, t in optional.items()}
    where = [F.col("table_number"), F.col("edition_year"), F.col("title"), F.col("page_url")]
    where += [F.array("cell").alias("cells")] if "cell" in worded.columns else []
    where += [F.col("group")] if "group" in worded.columns else []
    return worded.select(
        "id", "question", have["answer_num"].alias("answer_num"), have["answer_label"].alias("answer_label"),
        "answer_type",
        F.when(F.col("answer_type") == "number", TOLERANCE).otherwise(0.0).alias("tolerance"),
        "question_type", "unit", "years", "phrasing", "descriptor",
        F.struct(*where).alias("provenance"),
        have["margin"].alias("margin"), have["options"].alias("options"),
    )


def resume(chosen: DataFrame, existing: DataFrame, key: str = "id") -> tuple[DataFrame, DataFrame]:
    """`(done, todo)`: existing records of chosen ids, and chosen rows still to be worked."""
    done = existing.join(chosen.select(key), key, "left_semi")
    todo = chosen.join(existing.select(key), key, "left_anti")
    return done, todo
