import os
import sys

import pandas
import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
os.environ["PYTHONPATH"] = sys.path[0] + os.pathsep + os.environ.get("PYTHONPATH", "")

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from tesserae.session import build_session

    shared = tmp_path_factory.mktemp("shared")
    conf = {"spark.sql.shuffle.partitions": "4", "spark.driver.memory": "4g", "spark.checkpoint.dir": f"file://{shared}", "spark.sql.warehouse.dir": f"{shared}/warehouse"}
    session = build_session("tests", "local[4]", **conf)
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def data():
    return DATA


@pytest.fixture(scope="session")
def duck(data):
    import duckdb

    con = duckdb.connect()
    for name in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{data}/{name}.parquet')")
    return con


def rows(frame):
    """A pandas frame as a sorted list of tuples, columns by name, doubles rounded."""
    frame = frame[sorted(frame.columns)]

    def plain(x):
        if not hasattr(x, "__len__") and pandas.isna(x):
            return "null"
        if isinstance(x, (int, float)) and not isinstance(x, bool):
            return repr(round(float(x), 6))
        return str(list(x)) if hasattr(x, "__len__") and not isinstance(x, str) else str(x)

    return sorted(tuple(plain(x) for x in row) for row in frame.itertuples(index=False))
