import math
import os
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
os.environ.setdefault("SPARK_LOCAL_IP", "127.0.0.1")

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    session = SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.sql.session.timeZone", "UTC").config("spark.ui.enabled", "false").config("spark.driver.memory", "4g").getOrCreate()
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


def _plain(value):
    if isinstance(value, float):
        return "null" if math.isnan(value) else f"{value:.9g}"
    return str(value)


def rows_of(df):
    """Column names and rows of a DataFrame in a form that doesn't depend on order."""
    names = sorted(df.columns)
    return names, sorted(tuple(_plain(r[c]) for c in names) for r in df.collect())


def sql_rows(sql, sf_dir):
    """The same for SQL over the tables that are in a folder."""
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        if os.path.exists(f"{sf_dir}/{t}.parquet"):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    found = con.execute(sql)
    names = [d[0] for d in found.description]
    at = [names.index(c) for c in sorted(names)]
    return sorted(names), sorted(tuple(_plain(r[i]) for i in at) for r in found.fetchall())


@pytest.fixture(scope="session")
def same(spark):
    """Checks that a query and its SQL give equal rows on a folder of tables; returns how many."""

    def check(query, sql, sf_dir):
        names, rows = rows_of(query(spark, str(sf_dir)))
        want_names, want = sql_rows(sql, str(sf_dir))
        assert names == want_names
        assert rows == want
        return len(rows)

    return check
