import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from tablelake.session import build_session  # noqa: E402

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    session = build_session("tests", "local[4]", **{
        "spark.sql.shuffle.partitions": "4", "spark.ui.enabled": "false", "spark.driver.memory": "4g",
        "spark.ui.showConsoleProgress": "false"})
    session.sparkContext.setLogLevel("OFF")
    yield session
    session.stop()


def column(spark, values, expression, dtype="string"):
    """`expression(col)` for each of `values`, in order."""
    from pyspark.sql import functions as F

    df = spark.createDataFrame(list(enumerate(values)), f"i int, v {dtype}")
    return [row["r"] for row in df.select("i", expression(F.col("v")).alias("r")).orderBy("i").collect()]
