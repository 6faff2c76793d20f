"""One local session, and the comparison of query results with DuckDB's."""

from __future__ import annotations

import math
import os
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
os.environ.setdefault("TZ", "UTC")
DATA = Path(os.environ.get("STRATAFRAME_TEST_DATA", "/root/testdata/sf0.001"))


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    session = (
        SparkSession.builder.master("local[4]").appName("tests").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", "4g").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def data() -> str:
    if not DATA.exists():
        pytest.skip("no benchmark tables here")
    return str(DATA)


@pytest.fixture(scope="session")
def duck(data):
    import duckdb

    con = duckdb.connect()
    con.sql("SET timezone = 'UTC'")
    for f in Path(data).iterdir():
        con.sql(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}{'' if f.is_file() else '/*.parquet'}'")
    return con


def plain(value) -> str:
    if value is None or str(value) in ("<NA>", "NaT", "nan"):
        return "NULL"
    if isinstance(value, float):
        return repr(value if not math.isclose(value, 0.0, abs_tol=0) else 0.0)
    return str(value)


def rows_of(frame) -> list[tuple[str, ...]]:
    frame = frame[sorted(frame.columns)].astype(object)
    return sorted(tuple(plain(v) for v in row) for row in frame.itertuples(index=False, name=None))


def assert_same(spark_df, relation) -> None:
    got, want = spark_df.toPandas(), relation.df()
    assert sorted(got.columns) == sorted(want.columns)
    for c in got.columns:  # nullable whole numbers come as floats from one side
        if got[c].dtype.kind == "f" or want[c].dtype.kind == "f" or str(want[c].dtype).startswith(("Int", "Float")):
            got[c], want[c] = got[c].astype("float64"), want[c].astype("float64")
    assert rows_of(got) == rows_of(want)
