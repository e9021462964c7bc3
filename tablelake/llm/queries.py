"""The operators over their whole tables, by query name, with SQL twins where SQL can express them."""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablelake.llm import (
    alignment, embedding_dedup, filter_audit, language_id, license_scan, lm_scoring, mixing, ngram_join, pii, sentencepiece, sharding, suffix_dedup, topk_search,
)
from tablelake.session import configure

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _query(name: str, *tables: str, sql: str | None = None):
    def wrap(build: Callable[..., DataFrame]):
        def run(spark: SparkSession, folder: str) -> DataFrame:
            return build(*[configure(spark).read.parquet(f"{folder}/{table}.parquet") for table in tables])

        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return build

    return wrap


#: Texts joined on their shingles, pair by pair, and links followed to their ends: for small tables only.
NGRAM_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words FROM documents),
s AS (
  SELECT doc_id, unnest(list_distinct(CASE WHEN len(words) >= 5 THEN list_transform(range(1, len(words) - 3), lambda i: array_to_string(words[i:i + 4], ' '))
    WHEN len(words) > 0 THEN [array_to_string(words, ' ')] ELSE [] END)) AS shingle FROM w),
n AS (SELECT doc_id, count(shingle) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS common FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id),
l AS (SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * common >= 80 * (a.n + b.n - common)),
e AS (SELECT x AS a, y AS b FROM l UNION ALL SELECT y, x FROM l),
r AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a),
c AS (SELECT a, min(b) AS component_id FROM r GROUP BY a)
SELECT doc_id, coalesce(n.n, 0) AS n_shingles, component_id FROM documents LEFT JOIN n USING (doc_id) JOIN c ON c.a = doc_id"""


@_query("op7_ngram_jaccard", "documents", sql=NGRAM_SQL)
def op7_ngram_jaccard(documents: DataFrame) -> DataFrame:
    return ngram_join.ngram_components(documents)


@_query("op1_virtual_slots", "documents")
def op1_virtual_slots(documents: DataFrame) -> DataFrame:
    return sharding.shard(documents, shards=40)


TOP_K_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(CAST(q.e AS DOUBLE[]), CAST(c.e AS DOUBLE[])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INT) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5"""


@_query("op4_top_k", "embeddings", sql=TOP_K_SQL)
def op4_top_k(embeddings: DataFrame) -> DataFrame:
    rows = topk_search.usable(embeddings, "vec_id", "embedding")
    return topk_search.top_k(rows, rows.where(F.col("id") % 50 == 0), k=5)


@_query("op8_embedding_near_dup", "embeddings")
def op8_embedding_near_dup(embeddings: DataFrame) -> DataFrame:
    return embedding_dedup.embedding_components(embeddings)


@_query("op2_language_id", "documents")
def op2_language_id(documents: DataFrame) -> DataFrame:
    return language_id.identify(documents)


@_query("op3_lm_score", "documents")
def op3_lm_score(documents: DataFrame) -> DataFrame:
    return lm_scoring.score(documents)


@_query("op6_pii", "documents")
def op6_pii(documents: DataFrame) -> DataFrame:
    return pii.find(documents)


@_query("op9_pfair_mix", "documents")
def op9_pfair_mix(documents: DataFrame) -> DataFrame:
    return mixing.schedule(documents, mixing.TEMPER, most_sources=None)


@_query("op10_sentencepiece", "documents")
def op10_sentencepiece(documents: DataFrame) -> DataFrame:
    return sentencepiece.round_trips(documents)


@_query("op5_license_scan", "documents")
def op5_license_scan(documents: DataFrame) -> DataFrame:
    return license_scan.scan(documents)


#: Texts are grouped here by an equal-text window; the mask of a document follows, then all orders from counts of masks.
FILTER_AUDIT_SQL = r"""
WITH w AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t,
    list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words FROM documents),
m AS (
  SELECT doc_id, part, CASE WHEN len(words) < 200 THEN 1 ELSE 0 END + CASE WHEN 100 * len(list_distinct(words)) < 50 * len(words) THEN 2 ELSE 0 END
    + CASE WHEN 100 * (length(t) - length(regexp_replace(t, '[A-Z]', '', 'g'))) > 3 * length(t) THEN 4 ELSE 0 END
    + CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 8 ELSE 0 END + CASE WHEN doc_id > min(doc_id) OVER (PARTITION BY t) THEN 16 ELSE 0 END AS mask FROM w),
l AS (SELECT doc_id, max(quality = 1) AS good, max(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
c AS (
  SELECT part, mask, count(*) AS n, count(*) FILTER (WHERE coalesce(good, false)) AS good, count(*) FILTER (WHERE coalesce(toxic, false)) AS toxic
  FROM m LEFT JOIN l USING (doc_id) GROUP BY part, mask),
f AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
o AS (
  SELECT a.x || b.x || c.x || d.x || e.x AS filter_order FROM f a, f b, f c, f d, f e
  WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
s AS (SELECT filter_order, CAST(unnest([1, 2, 3, 4, 5]) AS INT) AS step FROM o),
b AS (
  SELECT *, CAST(pow(2, instr('ABCDE', filter_order[step]) - 1) AS INT) AS own,
    CAST(list_sum(list_transform(range(1, step), lambda i: pow(2, instr('ABCDE', filter_order[i]) - 1))) AS INT) AS had FROM s),
p AS (SELECT c.*, filter_order, step, own, coalesce(had, 0) AS had FROM c, b)
SELECT part, filter_order, step,
  CAST(coalesce(sum(n) FILTER (WHERE mask & (own | had) = 0), 0) AS BIGINT) AS kept,
  CAST(coalesce(sum(n) FILTER (WHERE mask & own <> 0 AND mask & had = 0), 0) AS BIGINT) AS removed,
  CAST(coalesce(sum(n) FILTER (WHERE mask & own <> 0 AND mask & had <> 0), 0) AS BIGINT) AS redundant,
  CAST(coalesce(sum(n) FILTER (WHERE mask = own), 0) AS BIGINT) AS unique_fails,
  CAST(coalesce(sum(good) FILTER (WHERE mask & own <> 0 AND mask & had = 0), 0) AS BIGINT) AS good_lost,
  CAST(coalesce(sum(toxic) FILTER (WHERE mask & own <> 0 AND mask & had = 0), 0) AS BIGINT) AS toxic_lost,
  CAST(coalesce(sum(n * 120 // greatest(bit_count(mask), 1)) FILTER (WHERE mask & own <> 0), 0) AS BIGINT) AS shapley
FROM p GROUP BY part, filter_order, step"""


@_query("op12_filter_audit", "documents", "labels", sql=FILTER_AUDIT_SQL)
def op12_filter_audit(documents: DataFrame, labels: DataFrame) -> DataFrame:
    return filter_audit.audit(documents, labels)


@_query("op11_token_alignment", "documents")
def op11_token_alignment(documents: DataFrame) -> DataFrame:
    return alignment.align(documents)


@_query("op13_suffix_dedup", "documents")
def op13_suffix_dedup(documents: DataFrame) -> DataFrame:
    """What was cut from each document, in numbers, and `text`, the text without it (what is left of a character cut in two is U+FFFD)."""
    text = F.make_valid_utf8(F.col("kept").cast("string")).alias("text")
    return suffix_dedup.cut_repeats(documents).select("doc_id", *suffix_dedup.digests(), text)
