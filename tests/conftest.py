import os
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
os.environ.setdefault("PYTHONPATH", str(Path(__file__).resolve().parents[1]))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.driver.memory", "4g")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", f"file://{tmp_path_factory.mktemp('spark-shared')}")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def duck():
    import duckdb

    con = duckdb.connect()
    for name in "documents embeddings pages benchmark labels conversations events".split():
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SMALL}/{name}.parquet'")
    return con


def rows_of(columns, rows):
    """Rows with columns in order of name, as comparable text; floats to 9 digits."""

    def norm(v):
        if v is None:
            return "~"
        if isinstance(v, float) or hasattr(v, "as_tuple"):
            return f"{float(v):.9g}"
        return str(v)

    at = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in at], sorted(tuple(norm(r[i]) for i in at) for r in rows)


@pytest.fixture(scope="session")
def same_as_sql(spark, duck):
    def check(query, sql):
        df = query(spark, SMALL)
        got = rows_of(df.columns, [tuple(r) for r in df.collect()])
        rel = duck.sql(sql)
        want = rows_of(rel.columns, rel.fetchall())
        assert got[0] == want[0]
        assert got[1] == want[1]

    return check
