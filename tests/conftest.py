import os
import sys

import pandas as pd
import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = os.pathsep.join([ROOT, *filter(None, [os.environ.get("PYTHONPATH")])])

DATA = "/root/testdata"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    session = (
        SparkSession.builder.master("local[*]").appName("tests").config("spark.sql.shuffle.partitions", "4").config("spark.driver.memory", "6g").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC").config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared"))).config("spark.sql.warehouse.dir", str(tmp_path_factory.mktemp("warehouse"))).getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def duck():
    """A function that runs SQL over the tables of a scale factor."""
    import duckdb

    def run(sql: str, sf: str = "sf0.01"):
        db = duckdb.connect()
        for name in os.listdir(f"{DATA}/{sf}"):
            db.execute(f"create view {name.removesuffix('.parquet')} as select * from read_parquet('{DATA}/{sf}/{name}')")
        return db.sql(sql).df()

    return run


def as_rows(frame):
    """Rows of a pandas frame as comparable tuples, columns by name."""
    frame = frame[sorted(frame.columns)].astype(object)
    return sorted(tuple("-" if pd.isna(v) else str(float(v)) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v) for v in row) for row in frame.itertuples(index=False))
