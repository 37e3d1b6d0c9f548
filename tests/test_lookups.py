"""Looking up one session or hash in the store, and prices that touch only the days that hold them."""

from __future__ import annotations

import datetime as dt
import os
import shutil

import pytest
from meterbook.operators import analytics, passes, pricing, store
from meterbook.operators.filters import QueryFilter
from pyspark.sql import functions as F

COUNTS = ["input_tokens", "output_tokens", "reasoning_tokens", "cache_read_tokens", "cache_write_tokens", "tool_tokens"]
MODELS = ["gpt-5.4", "gpt-5.5", "claude-opus-4.8"]


@pytest.fixture(scope="module")
def rows(spark):
    """Ten days with 40,000 events; session 7 has a third of them, session 500 only two days, and the model of the last day stands on no other."""
    n = F.col("id")
    day = (n % 10).cast("long")
    session = F.when(n % 3 == 0, 7).when((n % 101 == 1) & (day >= 8), 500).otherwise(n % 997 + 1000)
    model = F.when(day == 9, MODELS[2]).otherwise(F.element_at(F.array(*[F.lit(m) for m in MODELS[:2]]), (n % 2 + 1).cast("int")))
    made = spark.range(40000).select(
        F.sha2(n.cast("string"), 256).alias("event_hash"), F.when(n > 0, F.timestamp_seconds(1704067200 + day * 86400 + n % 86000)).alias("timestamp"), session.cast("long").alias("session_id"), (n % 3).alias("source_id"), (n % 3).alias("project_id"),
        F.when(day == 9, "anthropic").otherwise("openai").alias("provider"), model.alias("model"), *[(n % 7 + i).alias(c) for i, c in enumerate(COUNTS)], (n % 7 * 6).alias("total_tokens"), F.lit("unknown").alias("exactness"), F.lit(0.0).alias("cost_usd"), (n % 50 == 3).alias("ignored"),
    )
    return made.cache()


@pytest.fixture(scope="module")
def place(spark, rows, tmp_path_factory):
    """A store with pages of 500 rows, so that it is to a page what a large one is to a page of 20,000."""
    folder = tmp_path_factory.mktemp("lookups")
    path, daily = f"{folder}/events", f"{folder}/daily"
    conf = spark._jsc.hadoopConfiguration()
    conf.set("parquet.page.row.count.limit", "500")
    try:
        store.append(rows, path)
    finally:
        conf.unset("parquet.page.row.count.limit")
    store.refresh_rollup(spark, path, daily)
    return path, daily


@pytest.fixture
def own(place, tmp_path):
    """A copy of the store, to change."""
    copies = f"{tmp_path}/events", f"{tmp_path}/daily"
    for old, new in ((place[0], copies[0]), (place[1], copies[1]), (store.session_days_path(place[1]), store.session_days_path(copies[1]))):
        shutil.copytree(old, new)
    return copies


def _scanned(df) -> tuple[int, int]:
    """(files, rows) that the scan of a plan without exchanges has read."""
    execution = df._jdf.queryExecution()
    execution.toRdd().count()
    leaves = execution.executedPlan().collectLeaves()
    assert leaves.size() == 1
    metrics = leaves.head().metrics()
    return tuple(metrics.apply(m).value() for m in ("numFiles", "numOutputRows"))


def _sorted(df, columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)


@pytest.mark.parametrize("session", [7, 500, 1])
def test_a_session_is_read_from_its_days(spark, rows, place, session):
    path, daily = place
    expected = rows.where((F.col("session_id") == session) & ~F.col("ignored"))
    found = store.session_events(spark, path, daily, session)
    assert _sorted(found, rows.columns) == _sorted(expected, rows.columns)
    days = {r[0] for r in expected.select(F.to_date("timestamp")).distinct().collect()}
    assert set(store.days_of_session(spark, daily, session)) == days
    sessions = spark.createDataFrame([(session, "s", "t")], "id long, source_session_id string, title string")
    assert analytics.session_detail(found, sessions, session).collect() == analytics.session_detail(rows, sessions, session).collect()


def test_a_lookup_skips_what_it_is_not_in(spark, rows, place):
    path, daily = place
    everything = _scanned(store.read(spark, path).where("total_tokens >= 0"))
    assert everything[1] == 40000
    files, read = _scanned(store.session_events(spark, path, daily, 500))
    on_two_days = sum(len([f for f in os.listdir(f"{path}/event_date={d}") if f.endswith(".parquet")]) for d in ("2024-01-09", "2024-01-10"))
    assert files <= on_two_days < everything[0]
    assert read < 4000  # of the 8,000 of its two days
    # One without days gives a plan without a scan.
    assert "FileScan" not in store.session_events(spark, path, daily, 1)._jdf.queryExecution().executedPlan().toString()


def test_hashes_are_found_by_their_filters(spark, rows, place):
    path, _ = place
    some = [r[0] for r in rows.where("event_hash in (sha2('5', 256), sha2('77', 256))").select("event_hash").collect()]
    assert {r[0] for r in store.events_by_hash(spark, path, some).select("event_hash").collect()} == set(some)
    known = store.events_by_hash(spark, path, some[:1], [dt.date(2024, 1, 6), dt.date(2024, 1, 8)])
    assert known.count() == 1
    # No file holds it, though it lies within the bounds of each.
    assert _scanned(store.events_by_hash(spark, path, ["8" + "0" * 63]))[1] == 0
    assert store.events_by_hash(spark, f"{path}-none", some) is None and store.session_events(spark, f"{path}-none", f"{path}-none", 7) is None


def test_a_busy_session_lies_in_several_tasks(spark, rows):
    """Session 7 has a third of all rows; the ranges cut it by hash."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        cut = rows.withColumn("event_date", F.lit(1)).repartitionByRange(8, "event_date", "session_id", "event_hash")
        sizes = [r["n"] for r in cut.groupBy(F.spark_partition_id().alias("p")).agg(F.count(F.lit(1)).alias("n")).collect()]
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(sizes) == 8 and max(sizes) < 2 * 40000 / 8


def _files(path: str) -> dict[str, set[str]]:
    return {d: set(os.listdir(f"{path}/{d}")) for d in os.listdir(path) if "=" in d}


def _same_costs(spark, rows, prices, path, daily) -> bool:
    columns = ["event_hash", "cost_usd", "exactness"]
    assert _sorted(store.read(spark, path), columns) == _sorted(pricing.repriced(rows, prices), columns)
    cost = lambda df: round(df.agg(F.sum("cost_usd")).first()[0], 6)
    return cost(store.read(spark, path).where("not ignored")) == cost(spark.read.parquet(daily))


def test_prices_rewrite_only_days_that_hold_them(spark, rows, own):
    path, daily = own
    prices = pricing.seed_prices(spark)
    assert store.reprice(spark, path, daily, prices) == 40000
    assert _same_costs(spark, rows, prices, path, daily)
    before = _files(path)
    assert store.reprice(spark, path, daily, prices) == 0 and _files(path) == before
    dearer = prices.withColumn("output_price_per_million", F.when(F.col("model") == MODELS[2], 50.0).otherwise(F.col("output_price_per_million")))
    assert 0 < store.reprice(spark, path, daily, dearer) <= 4000
    after = _files(path)
    assert {d for d in after if after[d] != before[d]} == {"event_date=2024-01-10"}
    assert _same_costs(spark, rows, dearer, path, daily)
    # Without its price the events of that day are unpriced again.
    assert store.reprice(spark, path, daily, prices.where(F.col("provider") != "anthropic")) == 4000
    assert store.read(spark, path).where("exactness = 'unknown'").count() == 4000
    assert store.reprice(spark, f"{path}-none", daily, prices) == 0


@pytest.mark.parametrize("at", ["begin", "_delete"])
def test_a_broken_repricing_is_finished(spark, rows, own, monkeypatch, at):
    path, daily = own
    prices = pricing.seed_prices(spark)
    owner = passes if hasattr(passes, at) else store

    def broken(*_, **__):
        raise KeyboardInterrupt

    with monkeypatch.context() as m, pytest.raises(KeyboardInterrupt):
        m.setattr(owner, at, broken)
        store.reprice(spark, path, daily, prices)
    assert store.reprice(spark, path, daily, prices) in (0, 40000)
    assert _same_costs(spark, rows, prices, path, daily)
    assert not [n for n in os.listdir(path) if n.startswith("_replacing")]


def test_reports_scan_events_once_with_the_pairs_of_the_rollup(spark, rows, place):
    path, daily = place
    prices, events, known = pricing.seed_prices(spark), store.read(spark, path), spark.read.parquet(daily)

    report = lambda **more: analytics.cache_efficiency(events, QueryFilter(), prices, **more)
    rounded = lambda df: _sorted(df.select(*[F.round(c, 6).alias(c) if t == "double" else c for c, t in df.dtypes]), df.columns)
    assert rounded(report(pairs=known)) == rounded(report())
    counted = lambda df: df._jdf.queryExecution().executedPlan().toString().count(f"{path}]")
    assert (counted(report(pairs=known)), counted(report())) == (1, 2)
    costed = lambda **more: _sorted(pricing.priced(events, prices, **more), ["event_hash", "cost_usd", "cost_status"])
    assert costed(pairs=known) == costed()
