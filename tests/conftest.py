import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

DATA = "/root/testdata"


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    session = (
        SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", "6g").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    session.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="spark-tests-"))
    return session


def sql_rows(sf: str, sql: str):
    """Rows of an SQL query over the driver's tables, columns by name."""
    import duckdb

    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for f in os.listdir(f"{DATA}/{sf}"):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{DATA}/{sf}/{f}'")
    return con.execute(sql).df()


def comparable(frame) -> list:
    """Rows in an order of their own, with columns sorted by name and missing values alike."""
    columns = sorted(frame.columns)
    rows = [tuple("~" if v is None or v != v else repr(float(v)) if isinstance(v, float) else str(v) for v in r) for r in frame[columns].itertuples(index=False)]
    return [columns, sorted(rows)]
