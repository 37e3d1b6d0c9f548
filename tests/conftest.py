"""A shared session, and comparison of a query with its DuckDB statement."""

from __future__ import annotations

import datetime as dt
import math
import os
import sys
from pathlib import Path

import duckdb
import pytest
from pyspark.sql import DataFrame, SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def spark():
    os.environ.setdefault("PYSPARK_PYTHON", sys.executable)
    session = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "6g")
        .config("spark.sql.autoBroadcastJoinThreshold", "1m")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


def plain(value):
    """A value that Spark and DuckDB give alike."""
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 6)
    if isinstance(value, dt.datetime):
        return value.replace(tzinfo=None).isoformat()
    if isinstance(value, (list, tuple)):
        return tuple(plain(v) for v in value)
    return value


def rows_of(df: DataFrame) -> list[tuple]:
    """Rows with columns by name, sorted."""
    names = sorted(df.columns)
    return sorted((tuple(plain(r[n]) for n in names) for r in df.select(*names).collect()), key=repr)


def duck_rows(sql: str, sf_dir: str = DATA) -> tuple[list[str], list[tuple]]:
    with duckdb.connect() as con:
        for table in TABLES:
            con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf_dir}/{table}.parquet'")
        cursor = con.execute(sql)
        names = [d[0] for d in cursor.description]
        order = sorted(range(len(names)), key=lambda i: names[i])
        found = [tuple(plain(r[i]) for i in order) for r in cursor.fetchall()]
    return sorted(names), sorted(found, key=repr)


def same_as_sql(df: DataFrame, sql: str, sf_dir: str = DATA) -> int:
    """Asserts that df and the statement give the same columns and rows; the number of rows."""
    names, expected = duck_rows(sql, sf_dir)
    assert sorted(df.columns) == names
    found = rows_of(df)
    assert len(found) == len(expected)
    for a, b in zip(found, expected, strict=True):
        assert a == b, (names, a, b)
    return len(found)
