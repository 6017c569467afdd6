import os
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    from palimpsest import ship

    session = (
        SparkSession.builder.master("local[8]").appName("tests").config("spark.driver.memory", "6g").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", "8").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield ship(session)
    session.stop()


SMALL = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def small():
    return SMALL


@pytest.fixture(scope="session")
def oracle():
    """Runs SQL in DuckDB over the small tables."""
    import duckdb

    con = duckdb.connect()
    for p in sorted(Path(SMALL).iterdir()):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}{'/*.parquet' if p.is_dir() else ''}'")
    return lambda sql: con.sql(sql).df()


def canonical(frame):
    """The rows of a frame in an order and form that both engines share."""
    frame = frame[sorted(frame.columns)]
    frame = frame.astype(object).where(frame.notna(), None)

    def one(x):
        if isinstance(x, bool) or type(x).__name__ == "bool_":
            return str(bool(x))
        try:
            return f"{float(x):.9g}"
        except (TypeError, ValueError):
            return str(x)

    return sorted(repr([one(x) for x in r]) for r in frame.itertuples(index=False))


@pytest.fixture(scope="session")
def same():
    def check(ours, theirs):
        assert sorted(ours.columns) == sorted(theirs.columns)
        assert canonical(ours) == canonical(theirs)

    return check
