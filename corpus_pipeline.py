"""A corpus pipeline over `documents`: each stage applies one operator of `tablelake.llm`."""
from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tablelake.llm import language_id, mixing, ngram_join, pii, sentencepiece
from tablelake.session import configure, shared_folder

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
#: Column of the mixing stage that the stages after it hand on.
POSITION = "mix_position"


def _free(docs: DataFrame, name: str) -> str:
    """`name`, with underscores behind it for as long as documents have a column of that name."""
    while name in docs.columns:
        name += "_"
    return name


def languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is told; those without a letter, or with a pooled probability under the operator's bound, go."""
    configure(spark)
    return language_id.accepted(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: the one with the least doc_id.

    Documents without words are no copies of each other and stay. Of rows repeating the least doc_id of a group one stays.
    """
    configure(spark)
    return ngram_join.keep_one(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data in their texts replaced by its kind; `n_chars` follows."""
    configure(spark)
    return pii.redact(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents in the order of the mix, with their place in a last column, `mix_position`: sources at tempered shares, until used up."""
    configure(spark)
    return mixing.mix(docs, mixing.TEMPER, position=_free(docs, POSITION), most_sources=None)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with their `token_ids` in a last column."""
    configure(spark)
    return sentencepiece.encode_column(docs, name=_free(docs, "token_ids"))


STAGES: list[tuple[str, Stage]] = [
    ("language_id", languages), ("ngram_jaccard", near_duplicates), ("pii", personal_data), ("pfair_mix", mixed), ("sentencepiece", tokens),
]

#: No stage's decisions can be written in SQL; tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`; each result is written as Parquet to the shared folder and read again.

    Rows come in the order of the mix, equal rows side by side; the last written result holds the place itself in POSITION.
    """
    configure(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    position = _free(docs, POSITION)
    for name, stage in STAGES:
        path = f"{shared_folder(spark)}/pipeline-{name}-{uuid.uuid4().hex}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs.orderBy(position).drop(position)
