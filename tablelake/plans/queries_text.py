"""Text, value, year and source expressions over whole tables."""
from __future__ import annotations

from pyspark.sql import functions as F

from tablelake.fixed_values import STOPWORDS, SURVEY_PATTERNS, TARGET_SURVEY
from tablelake.functions import pages, text, values, years
from tablelake.operators.once import computed_once
from tablelake.operators.profile import skip_reasons
from tablelake.plans.registry import query
from tablelake.sources.html import extract_tables


def _quoted(words) -> str:
    return ", ".join("'" + w.replace("'", "''") + "'" for w in words)


# ---- labels and texts -------------------------------------------------------
# `documents` has neither no-break spaces nor markup, so both are put in.
SPACED_SQL = """
SELECT doc_id, replace(replace(text, ' e', chr(160) || chr(9) || ' e'), 'a ', 'a' || chr(160)) AS spaced,
       replace(text, 'e ', 'e<sup>1' || chr(10) || '</sup> ') AS marked
FROM documents"""


@query("clean_text", f"""
SELECT doc_id, trim(regexp_replace(replace(spaced, chr(160), ' '), '\\s+', ' ', 'g')) AS cleaned FROM ({SPACED_SQL})""")
def clean(tables):
    return tables.sql(SPACED_SQL.replace("chr(160)", "char(160)")).select(
        "doc_id", text.clean_text(F.col("spaced")).alias("cleaned"))


# Markers and indents are read where pages are read: each text is the cell of a page of its own.
def cell_of(df, key, markup):
    page = df.select(key, F.concat(F.lit("<table><tr><td>"), markup, F.lit("</td></tr></table>")).alias("html"))
    return extract_tables(page).select(key, F.col("tables")[0]["rows"][0]["cells"][0].alias("cell"))


@query("strip_markers", f"""
SELECT doc_id, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS stripped, trim(regexp_replace(replace(text, 'e ', 'e 1 '), '\\s+', ' ', 'g')) AS whole
FROM documents""")
def strip_markers(tables):
    markup = F.regexp_replace(F.replace(F.replace("marked", F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), "&lt;(/?sup)>", "<$1>")
    cells = cell_of(tables.sql(SPACED_SQL), "doc_id", markup)
    return cells.select("doc_id", F.col("cell.text").alias("stripped"), F.col("cell.full_text").alias("whole"))


@query("indent_level", """
SELECT p_partkey, CAST(p_size AS INT) AS level FROM part""")
def indent(tables):
    raw = F.concat(F.lit("\t"), F.expr("repeat(CASE WHEN p_partkey % 2 = 0 THEN '  ' ELSE '&nbsp; ' END, p_size)"), F.lit("\n"), F.col("p_name"), F.lit("  "))
    return cell_of(tables.part, "p_partkey", raw).select("p_partkey", F.col("cell.indent").alias("level"))


@query("title_topic", """
SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN p_name || ': ' || p_brand ELSE p_name END AS topic FROM part""")
def title_topic(tables):
    title = F.concat(
        F.lit("Table "), F.col("p_partkey").cast("string"), F.lit(".10.  "), F.col("p_name"),
        F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit(": "), F.col("p_brand"), F.lit(": Fall 2021")))
        .when(F.col("p_partkey") % 3 == 1, F.lit(": 2020-21 and 2021-22")).otherwise(" "))
    return tables.part.select("p_partkey", text.topic(title).alias("topic"))


@query("unhyphenate", """
SELECT doc_id, replace(text, 'en', 'e-n') AS joined FROM documents""")
def unhyphenate(tables):
    broken = F.regexp_replace(F.replace(F.col("text"), F.lit("en"), F.lit("e-n")), "e-n", "e-  n")
    return tables.documents.select("doc_id", text.unhyphenate(broken).alias("joined"))


# A three-level header per part, with and without year levels.
HEADERS_SQL = """
SELECT p_partkey, p_name || ' |  For- profit | ' || CASE p_partkey % 3 WHEN 0 THEN CAST(2000 + p_size AS STRING) || '-' ||
         lpad(CAST((p_size + 1) % 100 AS STRING), 2, '0') WHEN 1 THEN p_brand ELSE ' ' END AS header
FROM part"""


@query("column_path", """
SELECT p_partkey, p_name || ' > For-profit' || CASE p_partkey % 3 WHEN 0 THEN ' > ' || CAST(2000 + p_size AS VARCHAR) || '-' ||
         lpad(CAST((p_size + 1) % 100 AS VARCHAR), 2, '0') WHEN 1 THEN ' > ' || p_brand ELSE '' END AS full_path,
       p_name || ' > For-profit' || CASE p_partkey % 3 WHEN 1 THEN ' > ' || p_brand ELSE '' END AS yearless_path
FROM part""")
def column_path(tables):
    header = F.col("header")
    return tables.sql(HEADERS_SQL).select(
        "p_partkey", F.array_join(text.column_path(header), " > ").alias("full_path"),
        F.array_join(text.column_path(header, True), " > ").alias("yearless_path"))


@query("year_label", """
SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN CAST(2000 + p_size AS VARCHAR) || '-' || lpad(CAST((p_size + 1) % 100 AS VARCHAR), 2, '0')
       ELSE (1990 + p_size) || '-' || (1991 + p_size) END AS label
FROM part""")
def year_label(tables):
    stated = F.array(F.col("p_size") + 1990, F.col("p_size") + 1991, F.lit(2050))
    return tables.sql(HEADERS_SQL).join(tables.part.select("p_partkey", "p_size"), "p_partkey").select(
        "p_partkey", text.year_label(F.col("header"), stated).alias("label"))


@query("infer_unit", """
SELECT unit, count(*) AS n FROM (
  SELECT CASE WHEN doc_id % 5 = 0 OR contains(text, '%') THEN 'percent'
    WHEN regexp_matches(lower(text || ' ' || CASE doc_id % 5 WHEN 1 THEN 'Salary' WHEN 2 THEN 'student ratio' ELSE '' END), 'percent') THEN 'percent'
    WHEN regexp_matches(lower(text), 'dollar|salary|tuition') OR doc_id % 5 = 1 THEN 'dollars'
    WHEN contains(lower(text), 'ratio') OR doc_id % 5 = 2 THEN 'ratio' ELSE 'count' END AS unit
  FROM documents) GROUP BY unit""")
def infer_unit(tables):
    column = F.when(F.col("doc_id") % 5 == 0, "Percent of total").when(F.col("doc_id") % 5 == 1, "Salary").when(
        F.col("doc_id") % 5 == 2, "student ratio").otherwise("")
    return tables.documents.groupBy(text.infer_unit(column, F.col("text")).alias("unit")).agg(
        F.count(F.lit(1)).alias("n"))


@query("distinctive_tokens", f"""
SELECT doc_id, count(w) AS n_tokens, count(DISTINCT w) AS n_distinct, coalesce(string_agg(w, ' ' ORDER BY i), '') AS tokens
FROM (SELECT doc_id, CASE WHEN length(w) > 2 AND w NOT IN ({_quoted(STOPWORDS)}) THEN w END AS w, i
      FROM (SELECT doc_id, unnest(words) AS w, generate_subscripts(words, 1) AS i
            FROM (SELECT doc_id, regexp_split_to_array(lower(text), '[^A-Za-z0-9\\-]+') AS words FROM documents)))
GROUP BY doc_id""")
def distinctive_tokens(tables):
    tokens = text.distinctive_tokens(F.col("text"))
    return tables.documents.select("doc_id", tokens.alias("t")).select(
        "doc_id", F.size("t").cast("bigint").alias("n_tokens"),
        F.size(F.array_distinct("t")).cast("bigint").alias("n_distinct"), F.array_join("t", " ").alias("tokens"))


@query("normalize_label", """
SELECT doc_id, trim(regexp_replace(regexp_replace(lower(text), '[^a-z0-9\\s]', ' ', 'g'), '\\s+', ' ', 'g')) AS label FROM documents""")
def normalize_label(tables):
    return tables.documents.select("doc_id", text.normalize_label(F.col("text")).alias("label"))


@query("exclude_totals", """
SELECT p_partkey, CASE WHEN p_partkey % 8 = 7 THEN 'Totality' ELSE p_name END AS label FROM part
WHERE p_partkey % 8 NOT IN (1, 2, 3, 4, 5, 6, 7)""")
def exclude_totals(tables):
    k = F.col("p_partkey") % 8
    label = (F.when(k == 1, " Total").when(k == 2, "All students").when(k == 3, "Subtotal").when(k == 4, "U.S. average")
             .when(k == 5, "50 states and D.C.").when(k == 6, "National").when(k == 7, "Totality").otherwise(F.col("p_name")))
    return tables.part.select("p_partkey", label.alias("label")).where(~text.is_total(F.col("label")))


@query("year_only_labels", """
SELECT o_orderkey, CAST(year(o_orderdate) AS VARCHAR) AS label FROM orders WHERE o_orderkey % 4 = 0
UNION ALL SELECT o_orderkey, year(o_orderdate) || '-' || (year(o_orderdate) + 1) FROM orders WHERE o_orderkey % 4 = 1""")
def year_only_labels(tables):
    y, k = F.year("o_orderdate"), F.col("o_orderkey") % 4
    label = (F.when(k == 0, y.cast("string")).when(k == 1, F.concat_ws("-", y.cast("string"), (y + 1).cast("string")))
             .when(k == 2, F.concat(F.lit("Fall "), y.cast("string"))).otherwise(F.concat(y.cast("string"), F.lit("1"))))
    return tables.orders.select("o_orderkey", label.alias("label")).where(text.is_year_label(F.col("label")))


# ---- years ---------------------------------------------------------------------
_YEAR_TEXT = """
SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN CAST(CAST(year(o_orderdate) + 8 AS INT) AS STRING) || '-' ||
         lpad(CAST((CAST(year(o_orderdate) AS INT) + 9) % 100 AS STRING), 2, '0') || ' to 2020-21'
       WHEN 1 THEN o_orderpriority || ' Fall ' || CAST(CAST(year(o_orderdate) AS INT) AS STRING) || ' and 1999-2000'
       WHEN 2 THEN CAST(o_orderkey + 20150 AS STRING) || ' ' || o_orderpriority
       ELSE o_orderpriority || ', 19951 x1996' END AS label
FROM orders"""
_YEARS_DUCK = f"""
SELECT o_orderkey, label, list_transform(regexp_extract_all(label, '\\b((?:19|20)\\d{{2}})(?:\\s*-\\s*(?:\\d{{2}}|\\d{{4}}))?\\b', 1), lambda x: CAST(x AS INT)) AS years
FROM ({_YEAR_TEXT})"""


@query("parse_years", f"SELECT o_orderkey, label, array_to_string(years, ',') AS years FROM ({_YEARS_DUCK})")
def parse_years(tables):
    return tables.sql(_YEAR_TEXT).withColumn("years", F.array_join(
        years.parse_years(F.col("label")).cast("array<string>"), ","))


@query("years_all_in_range", f"""
SELECT o_orderkey FROM ({_YEARS_DUCK}) WHERE len(years) > 0 AND list_min(years) >= 2004 AND list_max(years) <= 2023""")
def years_all_in_range(tables):
    found = years.parse_years(F.col("label"))
    return tables.sql(_YEAR_TEXT).where(years.years_all_in(found, 2004, 2023)).select("o_orderkey")


@query("years_any_in_range", f"""
SELECT o_orderkey, array_to_string(list_sort(list_distinct(list_filter(years, lambda y: y BETWEEN 1999 AND 2005))), ',') AS years
FROM ({_YEARS_DUCK}) WHERE len(list_filter(years, lambda y: y BETWEEN 1999 AND 2005)) > 0""")
def years_any_in_range(tables):
    found = years.parse_years(F.col("label"))
    kept = years.years_within(found, 1999, 2005)
    return tables.sql(_YEAR_TEXT).where(years.years_any_in(found, 1999, 2005)).select(
        "o_orderkey", F.array_join(kept.cast("array<string>"), ",").alias("years"))


# ---- values --------------------------------------------------------------------
# Raw cell texts of all shapes; the oracle states what each shape must give.
RAW_SQL = """
SELECT l_orderkey, l_linenumber, CAST(CAST(l_extendedprice AS DECIMAL(18,2)) AS STRING) AS price,
       CAST(CAST(l_quantity AS INT) AS STRING) AS qty, l_orderkey % 13 AS k
FROM lineitem"""
_RAW = """CASE k WHEN 0 THEN price WHEN 1 THEN ' 1,' || lpad(qty, 3, '0') || ' ' WHEN 2 THEN '$' || price WHEN 3 THEN qty || '!'
  WHEN 4 THEN '(' || price || ')' WHEN 5 THEN '-' || qty WHEN 6 THEN '†' WHEN 7 THEN '—' WHEN 8 THEN '  ' WHEN 9 THEN qty || ' items'
  WHEN 10 THEN qty || 'd' WHEN 11 THEN qty || 'e2' ELSE '(†)' END"""


@query("parse_value", f"""
SELECT l_orderkey, l_linenumber, CASE k WHEN 0 THEN CAST(price AS DOUBLE) WHEN 1 THEN CAST('1' || lpad(qty, 3, '0') AS DOUBLE)
    WHEN 2 THEN CAST(price AS DOUBLE) WHEN 3 THEN CAST(qty AS DOUBLE) WHEN 4 THEN CAST(price AS DOUBLE)
    WHEN 5 THEN -CAST(qty AS DOUBLE) WHEN 11 THEN CAST(qty AS DOUBLE) * 100 ELSE -1e9 END AS num,
  CASE k WHEN 6 THEN '†' WHEN 7 THEN '—' WHEN 9 THEN qty || ' items' WHEN 10 THEN qty || 'd' WHEN 12 THEN '(†)' ELSE '' END AS txt,
  CASE WHEN k IN (1, 3, 5) THEN 1 ELSE 0 END AS is_int
FROM ({RAW_SQL})""")
def parse_value(tables):
    v = values.parse_value(F.expr(_RAW))
    return tables.sql(RAW_SQL).select("l_orderkey", "l_linenumber", v.alias("v")).select(
        "l_orderkey", "l_linenumber", F.coalesce("v.num", F.lit(-1e9)).alias("num"),
        F.coalesce("v.text", F.lit("")).alias("txt"), F.col("v.is_int").cast("int").alias("is_int"))


@query("usable_cells", f"""
SELECT k, CASE WHEN k IN (0, 1, 2, 3, 4, 5, 11) THEN 1 ELSE 0 END AS is_number, count(*) AS n
FROM ({RAW_SQL}) WHERE k NOT IN (6, 7, 8, 12) GROUP BY ALL""")
def usable_cells(tables):
    v = F.col("v")
    return (
        computed_once(tables.sql(RAW_SQL), "v", values.parse_value(F.expr(_RAW))).where(values.usable(v))
        .groupBy("k", values.is_number(v).cast("int").alias("is_number")).agg(F.count(F.lit(1)).alias("n"))
    )


@query("coerce_number", """
SELECT l_orderkey, l_linenumber, CASE l_orderkey % 5 WHEN 0 THEN CAST(CAST(l_extendedprice AS DECIMAL(18,2)) AS DOUBLE)
  WHEN 1 THEN CAST(CAST(l_quantity AS INT) AS DOUBLE) WHEN 2 THEN -1.0 WHEN 3 THEN CAST(CAST(l_quantity AS INT) AS DOUBLE) * 1000
  ELSE -1.0 END AS num
FROM lineitem""")
def coerce_number(tables):
    price = F.col("l_extendedprice").cast("decimal(18,2)")
    qty = F.col("l_quantity").cast("int").cast("string")
    k = F.col("l_orderkey") % 5
    shown = (F.when(k == 0, F.concat(F.lit("$ "), F.format_number(price, 2))).when(k == 1, F.concat(qty, F.lit(" %")))
             .when(k == 2, F.concat(qty, F.lit(" apples"))).when(k == 3, F.concat(qty, F.lit(",000")))
             .otherwise(F.lit(None).cast("string")))
    return tables.lineitem.select("l_orderkey", "l_linenumber",
                                  F.coalesce(values.coerce_number(shown), F.lit(-1.0)).alias("num"))


# ---- sources --------------------------------------------------------------------
_PHRASES = ("Integrated Postsecondary Education Data System (IPEDS)", "National Postsecondary Student Aid Study",
            "IPEDS; and Current Population Survey (CPS)", "U.S. Census Bureau", "National Science Foundation",
            "Schools and Staffing Survey; Open Doors", "an office without a survey")
_PHRASE_SQL = "CASE CAST(doc_id % 7 AS INT) " + " ".join(
    f"WHEN {i} THEN '{p}'" for i, p in enumerate(_PHRASES)) + " END"
_NOTES_DUCK = """
SELECT doc_id, ' source: ' || %s || ' ' || text || ' SOURCE two' AS cited FROM documents""" % _PHRASE_SQL
_SURVEYS_DUCK = "concat_ws('+', " + ", ".join(
    f"CASE WHEN regexp_matches(cited, '(?i){p}') THEN '{n}' END" for n, p in SURVEY_PATTERNS.items()) + ")"


def _classified(tables):
    notes = F.array(
        F.concat(F.lit("NOTE: Current Population Survey; "), F.col("text")),
        F.concat(F.lit(" source: "), F.expr(_PHRASE_SQL), F.lit(" "), F.col("text")),
        F.lit("SOURCE two"))
    return computed_once(tables.documents, "surveys", pages.classify_sources(notes)).select("doc_id", "surveys")


@query("classify_sources", f"SELECT doc_id, {_SURVEYS_DUCK} AS surveys FROM ({_NOTES_DUCK})")
def classify_sources(tables):
    return _classified(tables).withColumn("surveys", F.array_join("surveys", "+"))


@query("source_only", f"SELECT doc_id FROM ({_NOTES_DUCK}) WHERE {_SURVEYS_DUCK} = '{TARGET_SURVEY}'")
def source_only(tables):
    return _classified(tables).where(pages.only_source(F.col("surveys"), TARGET_SURVEY)).select("doc_id")


@query("skip_reasons", f"""
SELECT coalesce(nullif({_SURVEYS_DUCK}, ''), 'unknown') AS reason, count(*) AS n_tables FROM ({_NOTES_DUCK})
WHERE {_SURVEYS_DUCK} <> '{TARGET_SURVEY}' GROUP BY ALL""")
def skips(tables):
    return skip_reasons(_classified(tables).where(~pages.only_source(F.col("surveys"), TARGET_SURVEY)))


# ---- wording checks ---------------------------------------------------------------
_LEAK = """
SELECT o_orderkey, CAST(year(o_orderdate) AS INT) AS y, CAST(o_orderkey % 100 AS INT) AS answer,
  CASE o_orderkey % 4 WHEN 0 THEN 'What was it in ' || CAST(CAST(year(o_orderdate) AS INT) AS STRING) || '?'
    WHEN 1 THEN 'Was it ' || CAST(CAST(o_orderkey % 100 AS INT) AS STRING) || '.0, or less?'
    WHEN 2 THEN 'Was it 1,0' || lpad(CAST(CAST(o_orderkey % 100 AS INT) AS STRING), 2, '0') || '?' ELSE 'How many of 5-LOW?' END AS question
FROM orders"""


@query("leaks_answer", f"""
SELECT o_orderkey FROM ({_LEAK}) WHERE o_orderkey % 4 = 1 OR (o_orderkey % 4 = 3 AND answer = 5)""")
def leaks_answer(tables):
    hit = values.leaks_answer(F.col("question"), F.col("answer").cast("double"), F.array("y"))
    return tables.sql(_LEAK).where(hit).select("o_orderkey")


@query("qualifiers_kept", """
SELECT p_partkey, CASE WHEN kept >= 0.7 * wanted AND (p_partkey % 4 <> 3) THEN 1 ELSE 0 END AS kept FROM (
  SELECT p_partkey, len(words) AS wanted,
    len(list_filter(words, lambda w: contains(hay, CASE WHEN length(w) > 3 AND suffix(w, 's') THEN w[:-2] ELSE w END))) AS kept
  FROM (SELECT p_partkey, list_distinct([split_part(p_name, ' ', 1), split_part(p_name, ' ', 2) || 's', lower(p_brand), lower(p_type)]) AS words,
          regexp_replace(lower(CASE p_partkey % 4 WHEN 0 THEN p_name || ', ' || p_brand || ' ' || p_type WHEN 1 THEN p_name || ' ' || p_brand ELSE p_name END
            || CASE WHEN p_partkey % 4 = 3 THEN '' ELSE ' in 2021' END), '[,\\s]+', ' ', 'g') AS hay FROM part))""")
def qualifiers_kept(tables):
    k = F.col("p_partkey") % 4
    question = F.concat(
        F.when(k == 0, F.concat(F.col("p_name"), F.lit(",  "), F.col("p_brand"), F.lit(" "), F.col("p_type")))
        .when(k == 1, F.concat_ws(" ", "p_name", "p_brand")).otherwise(F.col("p_name")),
        F.when(k == 3, "").otherwise(" in 2021"))
    words = F.array(F.split_part("p_name", F.lit(" "), F.lit(1)),
                    F.concat(F.split_part("p_name", F.lit(" "), F.lit(2)), F.lit("s")), F.lower("p_brand"), F.lower("p_type"))
    kept = values.qualifiers_kept(question, F.concat(words, words), F.array(F.lit(2021)))
    return tables.part.select("p_partkey", kept.cast("int").alias("kept"))
