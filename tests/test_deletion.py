"""Retention and removal on stored events, and what the rollup can answer alone."""

from __future__ import annotations

import datetime as dt
import os

import pytest
from meterbook.operators import passes, rollup, store
from meterbook.operators.analytics import period
from meterbook.operators.filters import QueryFilter
from pyspark.sql import functions as F

SUMS = ["input_tokens", "output_tokens", "reasoning_tokens", "cache_read_tokens", "cache_write_tokens", "total_tokens"]


@pytest.fixture
def place(spark, tmp_path):
    """Five days, three sources, of which one has days of its own, and an event without a time."""
    n = F.col("id")
    rows = spark.range(300).select(
        F.sha2(n.cast("string"), 256).alias("event_hash"), F.when(n > 0, F.timestamp_seconds(1704067200 + (n % 5) * 86400 + n)).alias("timestamp"), F.when(n % 5 == 4, 2).otherwise(n % 2).cast("long").alias("source_id"), (n % 23).alias("session_id"), (n % 3).alias("project_id"),
        F.when(n % 2 == 0, "openai").otherwise("acme").alias("provider"), F.concat(F.lit("m"), (n % 4).cast("string")).alias("model"), *[(n % 7 + i).alias(c) for i, c in enumerate(SUMS)], (n / 100).alias("cost_usd"), F.lit("exact").alias("exactness"), F.lit(False).alias("ignored"),
    )
    path, daily = f"{tmp_path}/events", f"{tmp_path}/daily"
    store.append(rows, path)
    store.refresh_rollup(spark, path, daily)
    return rows, path, daily


def _files(path: str) -> dict[str, set[str]]:
    return {d: set(os.listdir(f"{path}/{d}")) for d in os.listdir(path) if "=" in d}


def _same_sums(spark, path, daily) -> bool:
    return spark.read.parquet(path).agg(F.sum("total_tokens")).first() == spark.read.parquet(daily).agg(F.sum("total_tokens")).first()


def test_expired_days_are_gone(spark, place):
    rows, path, daily = place
    before, all_ = _files(path), spark.read.parquet(daily).count()
    gone = store.expire(spark, path, dt.date(2024, 1, 6), 3)
    assert gone == rows.where("timestamp < '2024-01-03'").count() > 0
    after = _files(path)
    assert set(before) - set(after) == {"event_date=2024-01-01", "event_date=2024-01-02"}
    assert all(after[d] == before[d] for d in after)
    assert (store.expire(spark, path, dt.date(2024, 1, 6), 3), spark.read.parquet(daily).count()) == (0, all_)
    assert store.expire(spark, f"{path}-none", dt.date(2024, 1, 6), 3) == 0


def test_removed_sources_are_gone(spark, place):
    rows, path, daily = place
    before = _files(path)
    ids = spark.createDataFrame([(2,), (2,), (77,)], "id long")
    assert store.remove_sources(spark, path, daily, ids) == rows.where("source_id = 2").count()
    after = _files(path)
    assert set(before) - set(after) == {"event_date=2024-01-05"}
    assert all(after[d] == before[d] for d in after)
    assert _same_sums(spark, path, daily)
    assert store.remove_sources(spark, path, daily, spark.createDataFrame([(0,)], "id long")) == rows.where("source_id = 0").count()
    assert spark.read.parquet(path).select("source_id").distinct().collect()[0][0] == 1
    assert _same_sums(spark, path, daily) and store.remove_sources(spark, path, daily, ids) == 0


@pytest.mark.parametrize("at", ["begin", "_delete", "refresh_rollup", "commit"])
def test_a_removal_that_breaks_off(spark, place, monkeypatch, at):
    rows, path, daily = place
    ids, owner = spark.createDataFrame([(1,)], "id long"), store if hasattr(store, at) else passes
    real, calls = getattr(owner, at), []

    def broken(*args, **more):
        calls.append(1)
        if at == "_delete" and len(calls) < 3:
            return real(*args, **more)
        raise KeyboardInterrupt

    with monkeypatch.context() as m, pytest.raises(KeyboardInterrupt):
        m.setattr(owner, at, broken)
        store.remove_sources(spark, path, daily, ids)
    store.remove_sources(spark, path, daily, ids)
    assert spark.read.parquet(path).count() == rows.where("source_id <> 1").count()
    assert not [d for d in os.listdir(path) if d.startswith("_replacing")]
    assert _same_sums(spark, path, daily)


@pytest.mark.parametrize("f", [QueryFilter(), QueryFilter(start_date=dt.date(2024, 1, 2), end_date=dt.date(2024, 1, 4), provider="acme"), QueryFilter(start_date=dt.date(2030, 1, 1), project_id=1)])
def test_sessions_from_the_rollup(spark, place, f):
    rows, path, daily = place
    kept = rollup.period(spark.read.parquet(daily), spark.read.parquet(store.session_days_path(daily)), f)
    whole = period(spark.read.parquet(path), f).select(*[c for c in kept.columns if not c.startswith("cache")]).first().asDict()
    found = {c: v for c, v in kept.first().asDict().items() if not c.startswith("cache")}
    assert {c: round(v, 6) for c, v in found.items()} == {c: round(v, 6) for c, v in whole.items()}
    plan = kept._jdf.queryExecution().toString()
    assert f"{path}/" not in plan and f"{path}]" not in plan
