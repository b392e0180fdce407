import os
import sys
import tempfile

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
SF = "/root/testdata/sf0.001"


def session(cores: int = 8):
    from pyspark.sql import SparkSession

    from quire.session import ready

    at = tempfile.mkdtemp(prefix="spark-")
    s = (
        SparkSession.builder.master(f"local[{cores}]").appName("tests").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", "6g").config("spark.sql.session.timeZone", "UTC").config("spark.local.dir", at).config("spark.sql.warehouse.dir", f"{at}/warehouse")
        .config("spark.checkpoint.dir", f"file://{at}/shared").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    return ready(s)


@pytest.fixture(scope="session")
def spark():
    return session()


@pytest.fixture(scope="session")
def duck():
    import duckdb

    c = duckdb.connect()
    for f in os.listdir(SF):
        c.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{f}'")
    return c


def rows(df):
    return sorted((tuple(r[c] for c in sorted(df.columns)) for r in df.collect()), key=repr)
