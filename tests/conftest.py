import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = ROOT + ":" + os.environ.get("PYTHONPATH", "")

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    s = SparkSession.builder.master("local[4]").appName("tests").config("spark.sql.shuffle.partitions", "4").config("spark.driver.memory", "6g").config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def duck():
    import glob

    import duckdb

    c = duckdb.connect()
    for f in glob.glob(DATA + "/*.parquet"):
        c.sql(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return c


def rows_of(df):
    names = sorted(df.columns)
    return sorted(tuple("NULL" if r[n] is None else str(r[n]) for n in names) for r in df.collect())


def same_as_sql(spark, duck, query, sql):
    df = query(spark, DATA)
    cursor = duck.execute(sql)
    names = [x[0] for x in cursor.description]
    assert sorted(df.columns) == sorted(names)
    order = [names.index(n) for n in sorted(names)]
    want = sorted(tuple("NULL" if r[i] is None else str(r[i]) for i in order) for r in cursor.fetchall())
    assert rows_of(df) == want
