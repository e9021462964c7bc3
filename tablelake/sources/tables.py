"""Access to a folder of Parquet tables, by name and through SQL text."""
from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLE_NAMES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
)


class Tables:
    """`Tables(spark, folder).orders`, or `.sql(text)` over all of them.

    A table is opened on first use only, so a query pays for the footers of
    the tables it names and nothing else.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.folder = folder.rstrip("/")

    def __getattr__(self, name: str) -> DataFrame:
        if name not in TABLE_NAMES:
            raise AttributeError(name)
        df = self.spark.read.parquet(f"{self.folder}/{name}.parquet")
        setattr(self, name, df)
        return df

    def register(self, text: str) -> None:
        """Temp views for the tables `text` mentions."""
        words = set(re.findall(r"\w+", text.lower()))
        for name in TABLE_NAMES:
            if name in words:
                getattr(self, name).createOrReplaceTempView(name)

    def sql(self, text: str) -> DataFrame:
        self.register(text)
        return self.spark.sql(text)
