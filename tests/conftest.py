import os
import sys
from collections.abc import Iterator
from pathlib import Path

import duckdb
import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def spark(tmp_path_factory: pytest.TempPathFactory) -> Iterator[SparkSession]:
    os.environ.setdefault("PYSPARK_PYTHON", sys.executable)
    session = (
        SparkSession.builder.master("local[*]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", "4g").config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared"))).getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def duck() -> duckdb.DuckDBPyConnection:
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return c


def plain(value: object) -> object:
    """Values of both engines in one form."""
    if isinstance(value, float):
        return round(value, 6)
    if type(value).__name__ == "Decimal":
        return round(float(value), 6)
    if isinstance(value, dict):
        return tuple(plain(x) for x in value.values())
    if isinstance(value, (list, tuple)):
        return tuple(plain(x) for x in value)
    return value


def same_rows(df, duck: duckdb.DuckDBPyConnection, sql: str) -> None:
    columns = sorted(df.columns)
    found = sorted(repr(tuple(plain(r[c]) for c in columns)) for r in df.collect())
    result = duck.execute(sql)
    names = [d[0] for d in result.description]
    assert sorted(names) == columns
    places = [names.index(c) for c in columns]
    wanted = sorted(repr(tuple(plain(row[k]) for k in places)) for row in result.fetchall())
    assert found == wanted
