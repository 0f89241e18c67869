import glob
import os

import duckdb
import pytest
from pyspark.sql import SparkSession

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    s = (
        SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.driver.memory", "6g").config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def duck():
    c = duckdb.connect()
    for p in glob.glob(f"{DATA}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM read_parquet('{p}')")
    return c


def normal(rows, columns):
    order = sorted(range(len(columns)), key=columns.__getitem__)
    value = lambda x: round(x, 6) if isinstance(x, float) else x
    return sorted((tuple(value(r[i]) for i in order) for r in rows), key=repr)


def assert_same(df, duck, sql):
    got = df.collect()
    want = duck.execute(sql)
    names = [d[0] for d in want.description]
    assert sorted(df.columns) == sorted(names)
    assert normal(map(tuple, got), df.columns) == normal(want.fetchall(), names)
