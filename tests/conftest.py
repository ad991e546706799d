"""One session for all tests."""

import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = ROOT + os.pathsep + os.environ.get("PYTHONPATH", "")
DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    s = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "3g")
        .getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def sf_dir():
    if not os.path.isdir(DATA):
        pytest.skip("the given tables aren't here")
    return DATA


@pytest.fixture(scope="session")
def duck(sf_dir):
    import duckdb

    con = duckdb.connect()
    for name in os.listdir(sf_dir):
        path = f"{sf_dir}/{name}"
        con.execute(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    return con


def _cell(x):
    if x is None or isinstance(x, float) and x != x:
        return "~"
    if isinstance(x, bool):
        return str(x)
    if hasattr(x, "__len__") and not isinstance(x, (str, bytes, bytearray)):
        return str([_cell(v) for v in x])
    try:
        return f"{float(x):.6g}" if not isinstance(x, (str, bytes, bytearray)) else str(x)
    except (TypeError, ValueError):
        return str(x)


def table(rows: list[tuple], columns: list[str]) -> list[tuple]:
    """Rows in an order and form in which results of two engines can be compared."""
    by = sorted(range(len(columns)), key=columns.__getitem__)
    return sorted(tuple(_cell(r[i]) for i in by) for r in rows)


@pytest.fixture(scope="session")
def same(spark, sf_dir, duck):
    """Asserts that a query and its SQL agree."""

    def check(query, sql):
        df = query(spark, sf_dir)
        got = duck.execute(sql)
        columns = [d[0] for d in got.description]
        assert sorted(df.columns) == sorted(columns)
        assert table([tuple(r) for r in df.collect()], df.columns) == table(got.fetchall(), columns)

    return check
