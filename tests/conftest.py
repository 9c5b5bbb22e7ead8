import os
import sys

import pytest

HERE = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, HERE)
os.environ["PYTHONPATH"] = f"{HERE}:{os.environ.get('PYTHONPATH', '')}"
SF = "/root/testdata/sf0.001"
TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    s = (
        SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.driver.memory", "4g").config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    )
    s.sparkContext.setLogLevel("OFF")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def sf():
    return SF


def duck(sql: str, sf: str = SF):
    import duckdb

    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con.execute(sql).df()


def same(frame, table) -> bool:
    """Whether two results have the same columns and the same rows, in any order."""
    a = frame.toPandas()
    assert sorted(a.columns) == sorted(table.columns)
    # pandas has whole numbers with nulls as fractions, or as numbers of another kind
    whole = [f.name for f in frame.schema if f.dataType.simpleString() in ("int", "bigint") and (a[f.name].isna().any() or table[f.name].isna().any())]
    a, table = (x.astype(dict.fromkeys(whole, "Int64")) for x in (a, table))
    rows = lambda x: sorted(map(str, x[sorted(x.columns)].itertuples(index=False, name=None)))
    return rows(a) == rows(table)
