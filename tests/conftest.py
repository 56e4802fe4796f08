import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
os.environ["PYTHONPATH"] = os.pathsep.join([sys.path[0], os.environ.get("PYTHONPATH", "")])
SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    s = (
        SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").config("spark.driver.memory", "4g")
        .config("spark.sql.session.timeZone", "UTC").config("spark.ui.showConsoleProgress", "false").config("spark.sql.adaptive.coalescePartitions.parallelismFirst", "false").getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def oracle():
    import duckdb

    con = duckdb.connect()
    for f in os.listdir(SMALL):
        con.execute(f"CREATE VIEW {f[:-8]} AS SELECT * FROM '{SMALL}/{f}'")
    return con


def rows_of(frame) -> list[tuple]:
    """Rows of a pandas frame by sorted column names, as comparable texts."""
    import pandas as pd

    def plain(v):
        if not isinstance(v, (list, tuple, dict)) and pd.isna(v):
            return "null"
        if isinstance(v, float):  # whole numbers with nulls among them come as floats from one side
            return str(int(v)) if v.is_integer() else repr(round(float(v), 6))
        return str(v)

    cols = sorted(frame.columns)
    return sorted(tuple(plain(v) for v in r) for r in frame[cols].itertuples(index=False))
