"""Typed exports, JSON Lines, page bodies and yearly panels."""
from __future__ import annotations

import uuid

from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablelake.functions.pages import decode_body, page_key
from tablelake.functions.years import academic_year_label
from tablelake.operators import ingest
from tablelake.operators.panel import read_year_panel
from tablelake.plans import derived
from tablelake.plans.registry import query
from tablelake.session import shared_folder
from tablelake.sources import export, jsonl, sink


def scratch(tables, name: str) -> str:
    return f"{shared_folder(tables.spark)}/{name}-{uuid.uuid4().hex}"


# ---- CSV exports -----------------------------------------------------------
EXPORT_SCHEMA = T.StructType([
    T.StructField("O_OrderKey", T.IntegerType(), metadata={"source_type": "Long Integer"}),
    T.StructField("Status", T.StringType(), metadata={"source_type": "Text (1)"}),
    T.StructField("Is_Open", T.BooleanType(), metadata={"source_type": "Boolean"}),
    T.StructField("Amount", T.DecimalType(19, 4), metadata={"source_type": "Currency"}),
    T.StructField("Placed", T.TimestampNTZType(), metadata={"source_type": "DateTime"}),
    T.StructField("Remark", T.StringType(), metadata={"source_type": "Memo/Hyperlink"}),
])


def orders_export(tables) -> str:
    """Orders written the way a database export writes them; returns the folder."""
    o = tables.orders
    quoted = lambda c: F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"'))
    remark = F.when(F.col("o_orderkey") % 7 == 0, F.lit("")).when(
        F.col("o_orderkey") % 5 == 0, F.concat(F.lit('says "é"\n, '), F.col("o_orderpriority"))
    ).otherwise(F.col("o_orderpriority"))
    fields = [
        F.col("o_orderkey").cast("string"),
        F.when(F.col("o_orderstatus") == "P", F.lit("")).otherwise(quoted(F.col("o_orderstatus"))),
        F.when(F.col("o_orderstatus") == "O", "1").otherwise("0"),
        F.col("o_totalprice").cast("decimal(19,4)").cast("string"),
        F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss"),
        quoted(remark),
    ]
    path = scratch(tables, "export")
    line = F.concat_ws(",", *fields)
    write_lines(o, line, path)
    return path


def write_lines(df, line, path: str) -> None:
    """One header line per file, as each exported file has."""
    header = ",".join(f.name for f in EXPORT_SCHEMA)

    def with_header(batches):
        import pandas as pd

        first = True
        for batch in batches:
            if first:
                batch = pd.concat([pd.DataFrame({"value": [header]}), batch])
                first = False
            yield batch

    df.select(line.alias("value")).mapInPandas(with_header, "value string").write.text(path)


_EXPORTED = """
SELECT CAST(o_orderkey AS INT) AS o_orderkey, CASE WHEN o_orderstatus <> 'P' THEN o_orderstatus END AS status,
       o_orderstatus = 'O' AS is_open, CAST(o_totalprice AS DOUBLE) AS amount, CAST(o_orderdate AS VARCHAR) AS placed,
       CASE WHEN o_orderkey % 7 = 0 THEN '' WHEN o_orderkey % 5 = 0 THEN 'says "é"' || chr(10) || ', ' || o_orderpriority
            ELSE o_orderpriority END AS remark
FROM orders"""


@query("scan_csv_typed", _EXPORTED)
def scan_csv_typed(tables):
    read = export.read_export(tables.spark, orders_export(tables), EXPORT_SCHEMA)
    return read.withColumns({"amount": F.col("amount").cast("double"), "placed": F.col("placed").cast("string")})


@query("discover_exports", """
SELECT CAST(year(o_orderdate) AS INT) AS year, count(*) AS n_rows FROM orders GROUP BY ALL""")
def discover(tables):
    """Yearly export folders found by name, then counted file by file."""
    root = scratch(tables, "found")
    stamped = tables.orders.select(F.year("o_orderdate").alias("y"), F.col("o_orderkey").cast("string").alias("key"))
    stamped.write.partitionBy("y").csv(root)
    files = export.discover_exports(tables.spark, root)
    lines = tables.spark.read.option("recursiveFileLookup", "true").text(root).select(
        F.col("_metadata.file_path").alias("path"))
    sized = lines.groupBy("path").agg(F.count(F.lit(1)).alias("n"))
    return files.join(sized, "path").groupBy("year").agg(F.sum("n").alias("n_rows"))


# ---- schema listings ---------------------------------------------------------
# One listing of 20 columns per 20 parts, lines numbered by part.
LISTING_LINES = """
SELECT 'T' || CAST(CAST(floor(p_partkey / 20) AS BIGINT) AS STRING) AS table_name, p_partkey * 10 + 5 AS line_no,
       chr(9) || '[' || p_name || ' ' || CAST(p_partkey AS STRING) || ']' || chr(9) || chr(9) ||
       CASE p_partkey % 8 WHEN 0 THEN 'Text (' || CAST(p_size AS STRING) || ')' WHEN 1 THEN 'Long Integer'
         WHEN 2 THEN 'Currency NOT NULL' WHEN 3 THEN 'DateTime (Short)' WHEN 4 THEN 'Memo/Hyperlink (255) not null'
         WHEN 5 THEN 'Boolean NOT NULL' WHEN 6 THEN 'Single' ELSE 'Numeric (18, 0)' END ||
       CASE WHEN p_partkey % 20 = 19 THEN '' ELSE ',' END AS line
FROM part
UNION ALL
SELECT 'T' || CAST(CAST(floor(p_partkey / 20) AS BIGINT) AS STRING), p_partkey * 10, 'CREATE TABLE [X]' FROM part WHERE p_partkey % 20 = 0
UNION ALL
SELECT 'T' || CAST(CAST(floor(p_partkey / 20) AS BIGINT) AS STRING), p_partkey * 10 + 1, ' (' FROM part WHERE p_partkey % 20 = 0
UNION ALL
SELECT 'T' || CAST(CAST(floor(p_partkey / 20) AS BIGINT) AS STRING), p_partkey * 10 + 6, ');' FROM part WHERE p_partkey % 20 = 19
UNION ALL
SELECT 'T' || CAST(CAST(floor(p_partkey / 20) AS BIGINT) AS STRING), p_partkey * 10 + 8, chr(9) || '[after]  Text (1),' FROM part WHERE p_partkey % 20 = 19"""

_PARSED = """
SELECT 'T' || CAST(floor(p_partkey / 20) AS BIGINT) AS table_name, CAST(p_partkey % 20 + 1 AS INT) AS pos,
       p_name || ' ' || p_partkey AS name,
       CASE p_partkey % 8 WHEN 0 THEN 'Text (' || p_size || ')' WHEN 1 THEN 'Long Integer' WHEN 2 THEN 'Currency NOT NULL'
         WHEN 3 THEN 'DateTime (Short)' WHEN 4 THEN 'Memo/Hyperlink (255) not null' WHEN 5 THEN 'Boolean NOT NULL'
         WHEN 6 THEN 'Single' ELSE 'Numeric (18, 0)' END AS type
FROM part"""


@query("schema_listing_parse", _PARSED)
def schema_listing_parse(tables):
    return export.parse_listing(tables.sql(LISTING_LINES))


@query("schema_type_map", f"""
SELECT table_name, name, type, CASE split_part(split_part(replace(upper(type), ' NOT NULL', ''), ' (', 1), ' ', 1)
  WHEN 'TEXT' THEN 'string' WHEN 'LONG' THEN 'int' WHEN 'CURRENCY' THEN 'decimal(19,4)' WHEN 'DATETIME' THEN 'timestamp_ntz'
  WHEN 'MEMO/HYPERLINK' THEN 'string' WHEN 'BOOLEAN' THEN 'boolean' WHEN 'SINGLE' THEN 'float' ELSE 'double' END AS spark_type
FROM ({_PARSED})""")
def schema_type_map(tables):
    return export.with_source_types(export.parse_listing(tables.sql(LISTING_LINES))).drop("pos")


# ---- sinks ------------------------------------------------------------------
@query("sink_replace_roundtrip", "SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderstatus <> 'P'")
def sink_replace(tables):
    """Created, replaced, and read after a replacement that failed."""
    root = scratch(tables, "sink")
    first = tables.orders.select("o_orderkey", "o_orderstatus")
    sink.write_table(first.where("o_orderstatus = 'P'"), root, "orders")
    sink.write_table(first.where("o_orderstatus <> 'P'"), root, "orders", replace=True)
    fails(lambda: sink.write_table(broken(first, "o_orderkey"), root, "orders", replace=True))
    return sink.read_table(tables.spark, root, "orders")


def broken(df, key):
    """Rows whose last one cannot be computed."""
    last = F.col(key) == df.agg(F.max(key)).first()[0]
    return df.withColumn(key, F.when(last, F.raise_error(F.lit("broken")).cast("bigint")).otherwise(F.col(key)))


def fails(write):
    try:
        write()
    except Exception as problem:  # noqa: BLE001 - the job's own error, whatever Spark wraps it in
        if "broken" not in str(problem):
            raise
    else:
        raise AssertionError("the write should have failed")


@query("jsonl_append_last_wins", """
SELECT CAST(o_custkey AS VARCHAR) AS id, CASE WHEN max(o_orderkey) FILTER (WHERE o_orderkey % 2 = 1) IS NULL
  THEN 'first ' || max(o_orderkey) ELSE 'second ' || max(o_orderkey) FILTER (WHERE o_orderkey % 2 = 1) END AS answer FROM orders GROUP BY o_custkey""")
def jsonl_append(tables):
    """A run, one that fails half-way, and one whose lines replace those of the first."""
    path = scratch(tables, "runs")
    latest = lambda rows, word: rows.groupBy(F.col("o_custkey").cast("string").alias("id")).agg(
        F.concat(F.lit(word), F.max("o_orderkey").cast("string")).alias("answer"))
    jsonl.write_jsonl(latest(tables.orders, "first "), path, "append")
    fails(lambda: jsonl.write_jsonl(broken(tables.orders.select("o_orderkey", F.lit("half").alias("answer")), "o_orderkey"), path, "append"))
    jsonl.write_jsonl(latest(tables.orders.where("o_orderkey % 2 = 1"), "second "), path, "append")
    return jsonl.read_jsonl(tables.spark, path, "id string, answer string", key="id")


@query("ingest_catalog", f"""
SELECT 'tables23_meta' AS table_name, count(*) AS n_rows, count(DISTINCT coalesce(tablename, '')) AS n_names FROM ({derived.TABLES_META_SQL})
  WHERE tablename IS NULL OR NOT (upper(tablename) LIKE 'DRV%' OR upper(tablename) LIKE 'DFR%')
UNION ALL SELECT 'vartable23_meta', count(*), count(DISTINCT lower(varname)) FROM ({derived.VARTABLE_META_SQL})
UNION ALL SELECT 'HD2023', count(*), count(DISTINCT s_name) FROM supplier
UNION ALL SELECT 'registry', 3, 2""")
def ingest_catalog(tables):
    """A load, a second one that is refused, and one that replaces it; rollups and revised catalogs stay out."""
    root, sql = scratch(tables, "loaded"), tables.sql
    sources = {"Tables23": sql(derived.TABLES_META_SQL), "vartable23": sql(derived.VARTABLE_META_SQL),
               "HD2023": tables.supplier.selectExpr("s_suppkey AS UNITID", "s_name AS INSTNM"), "DRVX2023": None, "Tables23_RV": None, " ": None}
    listing = tables.spark.createDataFrame([("2023.accdb", name) for name in sources], "file_name string, source_table string")
    read = lambda _, name: sources[name]
    ingest.ingest(listing, read, root)
    try:
        ingest.ingest(listing, read, root)
    except RuntimeError:
        ingest.ingest(listing, read, root, replace=True)
    names = {"tables23_meta": F.coalesce("tablename", F.lit("")), "vartable23_meta": F.col("varname"), "HD2023": F.col("instnm"),
             "registry": F.col("is_meta")}
    out = [sink.read_table(tables.spark, root, t).agg(F.count(F.lit(1)).alias("n_rows"), F.count_distinct(c).alias("n_names")).select(
        F.lit(t).alias("table_name"), "n_rows", "n_names") for t, c in names.items()]
    return out[0].unionByName(out[1]).unionByName(out[2]).unionByName(out[3])


@query("jsonl_roundtrip", """
SELECT doc_id, text, lang, coalesce(quality, -1) AS quality, CASE WHEN quality = 1 THEN 'kept,' || lang ELSE 'kept' END AS tags
FROM documents LEFT JOIN labels USING (doc_id)""")
def jsonl_roundtrip(tables):
    path = scratch(tables, "jsonl")
    tagged = tables.documents.join(tables.labels.select("doc_id", "quality"), "doc_id", "left").withColumn(
        "tags", F.when(F.col("quality") == 1, F.array(F.lit("kept"), F.col("lang"))).otherwise(F.array(F.lit("kept"))))
    rows = tagged.select("doc_id", "text", "lang", "quality", "tags")
    jsonl.write_jsonl(rows.where("doc_id % 2 = 0"), path, "overwrite")
    jsonl.write_jsonl(rows.where("doc_id % 2 = 1"), path, "append")
    read = jsonl.read_jsonl(tables.spark, path, rows.schema)
    return read.withColumn("tags", F.array_join("tags", ",")).withColumn("quality", F.coalesce("quality", F.lit(-1)))


@query("jsonl_last_wins", """
SELECT CAST(o_custkey AS VARCHAR) AS id, CASE WHEN max(o_orderkey) % 3 = 0 THEN CAST(max(o_orderkey) AS VARCHAR)
  ELSE 'order ' || max(o_orderkey) END AS answer FROM orders GROUP BY o_custkey""")
def jsonl_last_wins(tables):
    """Answers are numbers or strings; each customer's last line counts."""
    path = scratch(tables, "answers")
    value = F.when(F.col("o_orderkey") % 3 == 0, F.col("o_orderkey").cast("string")).otherwise(
        F.concat(F.lit('"order '), F.col("o_orderkey").cast("string"), F.lit('"')))
    line = F.concat(F.lit('{"id": "'), F.col("o_custkey").cast("string"), F.lit('", "answer": '), value, F.lit("}\n"))
    tables.orders.select("o_orderkey", line.alias("value")).repartitionByRange("o_orderkey").sortWithinPartitions(
        "o_orderkey").select("value").write.text(path)
    return jsonl.read_jsonl(tables.spark, path, "id string, answer string", key="id")


# ---- pages --------------------------------------------------------------------
@query("decode_body", "SELECT page_id, html, html AS single_byte FROM (SELECT page_id, html FROM pages)")
def decode(tables):
    """Every page from its UTF-8 bytes, and again from single bytes."""
    return tables.pages.select(
        "page_id", decode_body(F.encode("html", "UTF-8")).alias("html"),
        decode_body(F.encode("html", "ISO-8859-1")).alias("single_byte"))


@query("page_cache_key", "SELECT page_id, substring(sha256(url), 1, 16) || '.html' AS page_key FROM pages")
def page_cache_key(tables):
    return tables.pages.select("page_id", page_key(F.col("url")).alias("page_key"))


@query("academic_year_label", """
SELECT label, count(*) AS n FROM (
  SELECT year(o_orderdate) || '-' || printf('%02d', (year(o_orderdate) + 1) % 100) AS label FROM orders) GROUP BY label""")
def academic_label(tables):
    return tables.orders.groupBy(academic_year_label(F.year("o_orderdate")).alias("label")).agg(
        F.count(F.lit(1)).alias("n"))


# ---- panels --------------------------------------------------------------------
@query("year_panel", """
SELECT CAST(year(o_orderdate) AS INT) AS year, o_orderkey, o_totalprice,
       CASE WHEN year(o_orderdate) >= 1998 THEN o_orderpriority ELSE 'none' END AS o_orderpriority
FROM orders""")
def panel(tables):
    """Year folders, of which the early ones lack a column, read in one scan."""
    root = scratch(tables, "years")
    yearly = tables.orders.select("o_orderkey", "o_totalprice", "o_orderpriority", F.year("o_orderdate").alias("year"))
    yearly.where("year >= 1998").write.partitionBy("year").parquet(root)
    yearly.where("year < 1998").drop("o_orderpriority").write.mode("append").partitionBy("year").parquet(root)
    return read_year_panel(tables.spark, root).withColumn("o_orderpriority", F.coalesce("o_orderpriority", F.lit("none")))
