"""Table links of an index page."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablelake.fixed_values import LINK_PATH_PREFIX, TABLE_LINK
from tablelake.operators.once import computed_once
from tablelake.sources.html import extract_anchors, one_per_key


def link_index(pages: DataFrame, base_url: str, chapter: int = 3, pattern: str = TABLE_LINK,
               path_prefix: str = LINK_PATH_PREFIX, key: str = "page_key", absent: str = "error",
               first: str | None = None) -> DataFrame:
    """Links under the first list item headed `Chapter <n>`, one row per page URL.

    Query strings and hosts are dropped and the path is put on `base_url`; the
    title is the list item's text behind the link text. The first link to a
    URL wins, kept by an aggregate so a much-repeated link stays small.
    An index page without the chapter stops the job; with `absent="skip"` it gives no rows.
    Of pages with one key the one with the least value in the column `first` counts (None: any one of them, the same in every run).
    """
    read = extract_anchors(one_per_key(pages, key, first).select(key, "html"), pattern)
    # The anchors of an item are those from its first to its last, whatever lists are inside it.
    headed = F.filter("anchors", lambda a: a["lead"].rlike(rf"(?U)^Chapter\s+{chapter}\b"))
    found = computed_once(read, "head", F.get(headed, F.lit(0)))
    span = F.get("items", F.col("head.item"))
    if absent == "error":
        # Part of the value that rows are kept by, so that no filter comes before it.
        problem = F.raise_error(F.concat(F.lit(f"chapter {chapter} not found on "), F.coalesce(F.col(key).cast("string"), F.lit("a page"))))
        span = F.coalesce(span, problem.cast("struct<first:int,last:int>"))
    found = found.withColumn("span", span)
    inside = F.filter(F.slice("anchors", F.col("span.first") + 1, F.col("span.last") - F.col("span.first")), lambda a: a["label"].isNotNull())
    anchor = found.where("span IS NOT NULL").select(key, F.col("head.lead").alias("chapter"), F.explode(inside).alias("a")).select(key, "chapter", "a.*")
    refs = anchor.select(key, F.col("pos").alias("anchor_pos"), *_reference(base_url, pattern, path_prefix),
                         F.regexp_replace("chapter", r"\.+$", "").alias("chapter"))
    rest = [c for c in refs.columns if c not in (key, "page_url")]
    return refs.groupBy(key, "page_url").agg(F.min(F.struct(*[F.col(c) for c in rest])).alias("ref")).select(key, "page_url", "ref.*")


def _reference(base_url: str, pattern: str, path_prefix: str) -> list[Column]:
    """`table_number, title, page_url, xlsx_url, edition_year` of a link (`href, label, item_text`)."""
    edition = F.regexp_extract("href", f"(?i){pattern}", 1)
    number = F.regexp_extract("href", f"(?i){pattern}", 2)
    bare = F.split_part("href", F.lit("?"), F.lit(1))
    path = F.regexp_replace(F.regexp_replace(bare, r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//[^/]*", ""), "^/+|#.*$", "")
    path = F.when(path.startswith(path_prefix), path.substr(F.lit(len(path_prefix) + 1), F.length(path))).otherwise(path)
    title = F.when(
        F.col("item_text").startswith(F.col("label")),
        F.trim(F.col("item_text").substr(F.length("label") + 1, F.length("item_text"))),
    ).otherwise(F.coalesce("item_text", F.lit("")))
    suffix = F.when(edition.cast("int") <= 20, "xls").otherwise("xlsx")
    return [
        number.alias("table_number"), title.alias("title"), F.concat(F.lit(base_url), path).alias("page_url"),
        F.concat(F.lit(base_url), F.lit("d"), edition, F.lit("/tables/xls/tabn"), number, F.lit("."), suffix).alias("xlsx_url"),
        F.concat(F.lit("20"), edition).alias("edition_year"),
    ]
