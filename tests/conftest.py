import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

DATA = Path("/root/testdata")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    shared = tmp_path_factory.mktemp("shared")
    conf = {
        "spark.sql.shuffle.partitions": "4",
        "spark.ui.enabled": "false",
        "spark.driver.memory": "4g",
        "spark.sql.session.timeZone": "UTC",
        "spark.checkpoint.dir": f"file://{shared}",
        "spark.sql.warehouse.dir": str(tmp_path_factory.mktemp("warehouse")),
    }
    s = SparkSession.builder.master("local[4]").config(map=conf).getOrCreate()
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def small():
    path = DATA / "sf0.001"
    if not path.exists():
        pytest.skip("the test tables aren't there")
    return str(path)


@pytest.fixture(scope="session")
def duck(small):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{small}/{t}.parquet')")
    return con


def rows_of(frame):
    """Rows of a pandas frame as sorted tuples of text, columns by name; floats to 9 digits."""
    import numpy as np
    import pandas as pd

    def text(v):
        if v is None or v is pd.NA or (isinstance(v, float) and v != v):
            return ""
        if isinstance(v, (int, np.integer)) and not isinstance(v, bool):
            return str(int(v))
        if isinstance(v, (float, np.floating)):
            return str(int(v)) if v == int(v) else format(v, ".9g")
        return str(v)

    cols = sorted(frame.columns)
    return cols, sorted(tuple(map(text, r)) for r in frame[cols].itertuples(index=False))
