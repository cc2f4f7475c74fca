import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.driver.memory", "4g")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def data():
    return DATA


@pytest.fixture(scope="session")
def duck():
    import duckdb

    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


def same(spark_df, duck_df) -> bool:
    """Equal columns and equal rows in any order; doubles to nine places."""

    def norm(df):
        df = df[sorted(df.columns)].copy()
        for c in df:
            if str(df[c].dtype).startswith("float"):
                df[c] = df[c].round(9)
        return df.astype(str).sort_values(list(df.columns)).reset_index(drop=True)

    a, b = norm(spark_df), norm(duck_df)
    return list(a.columns) == list(b.columns) and len(a) == len(b) and bool((a == b).all().all())
