import math
import os
import sys

import duckdb
import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = os.pathsep.join(x for x in (ROOT, os.environ.get("PYTHONPATH")) if x)
os.environ.setdefault("OMP_NUM_THREADS", "1")

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    session = (
        SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "2").config("spark.ui.enabled", "false").config("spark.driver.memory", "3g")
        .config("spark.sql.session.timeZone", "UTC").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


def rows_of(frame):
    names = sorted(frame.columns)
    frame = frame[names].astype(object)
    rows = frame.where(frame.notna(), None).values.tolist()
    # doubles come last and by few digits: rounding edges may fall either way
    exact = lambda row: [(x is not None, repr(x)) for x in row if not isinstance(x, float)]
    return names, sorted(rows, key=lambda row: (exact(row), [f"{x:.3e}" for x in row if isinstance(x, float)]))


def same_rows(a, b):
    """Equal names and rows; doubles within 2e-6 of each other, absolutely or relatively, since sums may run in another order."""
    close = lambda x, y: math.isclose(x, y, rel_tol=2e-6, abs_tol=2e-6) if isinstance(x, float) and isinstance(y, float) else x == y
    assert a[0] == b[0] and len(a[1]) == len(b[1])
    left = list(b[1])
    for row in a[1]:
        at = next((i for i, other in enumerate(left[:50]) if all(map(close, row, other))), None)
        assert at is not None, (row, left[:2])
        del left[at]


@pytest.fixture(scope="session")
def same_as_sql():
    def check(df, sql, sf=SF):
        con = duckdb.connect()
        for name in os.listdir(sf):
            con.execute(f"CREATE VIEW {name.split('.')[0]} AS SELECT * FROM '{sf}/{name}'")
        same_rows(rows_of(df.toPandas()), rows_of(con.execute(sql).df()))

    return check
