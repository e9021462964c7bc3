"""Every registered query that has a SQL twin against it, on the smallest tables."""
import subprocess
import sys
from pathlib import Path

import pytest
from conftest import SMALL

import __spark_entry__ as entry
from tablelake.sources.tables import TABLE_NAMES
from tools.compare import connect, oracle_rows, spark_rows


@pytest.fixture(scope="module")
def db():
    return connect(SMALL)


def test_queries_load_without_a_session():
    root = Path(entry.__file__).parent
    code = "import __spark_entry__ as e; assert set(e.oracle_sql()) <= set(e.queries()) and len(e.queries()) > 100"
    subprocess.run([sys.executable, "-c", code], cwd=root, check=True, timeout=120)


@pytest.mark.parametrize("name", list(entry.oracle_sql()))
def test_query(spark, db, name):
    got = spark_rows(entry.queries()[name](spark, SMALL))
    assert got == oracle_rows(db, entry.oracle_sql()[name])


def test_entries_of_long_index_pages(spark, tmp_path):
    """Every table that an index page links to gives entries, however many there are: here up to 49 on a page."""
    db = connect(SMALL)
    changed = {"customer": "* REPLACE (c_custkey * 300 AS c_custkey, c_nationkey - c_nationkey AS c_nationkey)", "orders": "* REPLACE (o_custkey * 300 AS o_custkey)"}
    for name in TABLE_NAMES:
        db.execute(f"COPY (SELECT {changed.get(name, '*')} FROM {name}) TO '{tmp_path}/{name}.parquet' (FORMAT parquet)")
    given = connect(str(tmp_path))
    got = spark_rows(entry.queries()["dataset_entries"](spark, str(tmp_path)))
    blocks = [b for (b,) in given.execute("SELECT DISTINCT o_custkey // 300 FROM orders JOIN customer ON c_custkey = o_custkey").fetchall()]
    found = {row[got[0].index("table_number")] for row in got[1]}
    assert len(blocks) > 60 and found == {f"30.{b}" for b in blocks if b % 7 != 3}
    assert got == oracle_rows(given, entry.oracle_sql()["dataset_entries"])


def test_entry(spark):
    assert entry.entry(spark).count() > 0
