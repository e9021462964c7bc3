"""Dataset entries: the tables an index page links to, read from their pages and put together with where they came from."""
from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tablelake.fixed_values import ID_PREFIX, TARGET_SURVEY, YEAR_MAX, YEAR_MIN
from tablelake.operators.links import link_index
from tablelake.operators.reports import judge, parse_pages
from tablelake.session import materialise
from tablelake.sources.html import one_per_key

ENTRY = ("eval_id", "table_number", "chapter", "edition_year", "title", "source", "source_surveys", "years", "year_axis",
         "dropped", "columns", "row_count", "records", "footnotes")


@dataclass
class Dataset:
    """`entries`: one row per table that was kept. `outcomes`: what became of each link."""

    entries: DataFrame
    outcomes: DataFrame


def first_links(links: DataFrame, limit: int | None, key: str = "page_key") -> DataFrame:
    """The first `limit` links of each index page, in the page's order; None keeps all. The cut is made in every task before the shuffle."""
    if limit is None:
        return links
    nth = F.row_number().over(Window.partitionBy(key).orderBy("anchor_pos"))
    return links.withColumn("_nth", nth).where(F.col("_nth") <= limit).drop("_nth")


def build_dataset(index_pages: DataFrame, pages: DataFrame, base_url: str, chapter: int = 3, limit: int | None = None,
                  target: str | None = TARGET_SURVEY, lo: int | None = YEAR_MIN, hi: int | None = YEAR_MAX,
                  max_rows: int | None = None, absent: str = "error") -> Dataset:
    """Index pages (`page_key, url, html`) and table pages (`url, html`) -> entries of the tables linked under `chapter`.

    Links meet their pages by URL. A page that is linked is parsed once, however many links it has, and one that is not linked is not parsed. A
    table without a caption takes the link's title, and its years are judged by that. A link without a page fails alone.
    """
    links = first_links(link_index(index_pages, base_url, chapter, absent=absent), limit)
    links = materialise(links.join(index_pages.select("page_key", F.col("url").alias("index_url")).distinct(), "page_key"), "dataset-links")
    linked = one_per_key(pages.select("url", "html").join(links.select(F.col("page_url").alias("url")).distinct(), "url", "left_semi"), "url")
    parsed = parse_pages(linked).withColumn("found", F.lit(True))
    met = links.withColumnRenamed("title", "link_title").join(parsed, links["page_url"] == parsed["url"], "left").drop("url")
    missing = F.when(F.col("found").isNull(), "page not found").otherwise(F.col("error"))
    judged = judge(met.withColumn("error", missing).drop("found"), F.col("link_title"), target, lo, hi, max_rows)
    judged = judged.withColumns({
        "eval_id": F.concat(F.lit(ID_PREFIX), "table_number"),
        "source": F.struct("index_url", "page_url", "xlsx_url"),
        "dropped": F.struct(F.col("dropped_rows").alias("rows"), F.col("dropped_columns").alias("columns")),
    })
    judged = materialise(judged.select("page_key", "status", "detail", *ENTRY), "dataset-tables")
    entries = judged.where("status = 'written'").select(*ENTRY)
    return Dataset(entries, judged.select("page_key", F.col("source.page_url").alias("page_url"), "table_number", "status", "detail", "dropped"))


def outcome_counts(outcomes: DataFrame) -> DataFrame:
    """How many links came to each end, with the rows and columns dropped from kept tables."""
    return outcomes.groupBy("status").agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(F.when(F.col("status") == "written", F.col("dropped.rows")).otherwise(0)).alias("dropped_rows"),
        F.sum(F.when(F.col("status") == "written", F.col("dropped.columns")).otherwise(0)).alias("dropped_columns"))


def entry_records(entries: DataFrame) -> DataFrame:
    """Entries -> one row per record, with what questions say about its table."""
    rows = entries.select("table_number", "title", F.col("years").alias("table_years"), "edition_year",
                          F.col("source.page_url").alias("page_url"), F.explode("records").alias("r"))
    return rows.select(*[c for c in rows.columns if c != "r"], "r.*")
