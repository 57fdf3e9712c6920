import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    s = SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8").config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    s.sparkContext.setLogLevel("ERROR")
    yield s


def oracle(sf_dir):
    import duckdb

    con = duckdb.connect()
    for t in os.listdir(sf_dir):
        con.sql(f"create view {t.split('.')[0]} as select * from '{sf_dir}/{t}'")
    return con


def rows_of(columns, rows):
    show = lambda v: round(v, 6) if isinstance(v, float) else v
    return sorted(repr([show(dict(zip(columns, r, strict=True))[c]) for c in sorted(columns)]) for r in rows)
