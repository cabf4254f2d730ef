import glob
import math
import os
import sys

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.driver.memory", "4g")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("checkpoint")))
        .config("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def duck():
    import duckdb

    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for path in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def _plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else round(value, 6)
    if hasattr(value, "tolist"):
        value = value.tolist()
    return tuple(map(_plain, value)) if isinstance(value, (list, tuple)) else value


def same_rows(df, cursor):
    """Whether a frame and a DuckDB result have the same columns and rows, in any order."""
    names = [c[0] for c in cursor.description]
    assert sorted(names) == sorted(df.columns)
    key = lambda row: tuple((x is None, str(x)) for x in row)
    got = sorted((tuple(_plain(r[n]) for n in names) for r in df.collect()), key=key)
    expected = sorted((tuple(map(_plain, r)) for r in cursor.fetchall()), key=key)
    assert got == expected
