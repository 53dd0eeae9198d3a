import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    session = (
        SparkSession.builder.master("local[4]").appName("tests").config("spark.sql.shuffle.partitions", "4").config("spark.driver.memory", "6g").config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC").getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    from quillspark.cluster import release

    release(session)


@pytest.fixture(scope="session")
def duck():
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def same_rows(spark_df, duck_df) -> None:
    """Both have the same columns and the same rows, in any order."""
    assert sorted(spark_df.columns) == sorted(duck_df.columns)

    def rows(df):
        def cell(x):
            if hasattr(x, "tolist") and not isinstance(x, (int, float)):
                x = x.tolist()
            if x is None or str(x) in ("<NA>", "NaT", "nan"):
                return "none"
            if isinstance(x, float):
                return str(int(x)) if x == int(x) and abs(x) < 1e15 else f"{x:.6g}"
            return str(x)

        return sorted(tuple(cell(x) for x in r) for r in df[sorted(df.columns)].itertuples(index=False))

    assert rows(spark_df) == rows(duck_df)
