"""Upkeep around the store: the pricing document, stamps of sources, inboxes, orders of lists, sums of streams."""

from __future__ import annotations

import datetime as dt
import json
from pathlib import Path

from conftest import DATA
from pyspark.sql import functions as F

from meterbook import ingest_queries
from meterbook.functions import dashboard
from meterbook.operators import analytics, pricing, store
from meterbook.operators.filters import QueryFilter
from meterbook.queries import items_of
from meterbook.sources import logs
from meterbook.streaming import watch

MISSING = "provider string, model string, events long, tokens long, cost_usd double"


def _document(folder) -> dict:
    return json.loads("".join(p.read_text() for p in sorted(Path(folder).glob("part-*"))))


def test_pricing_document_in_many_files(spark, tmp_path):
    base = pricing.seed_prices(spark).where("model = 'gpt-5.5'").drop("model")
    prices = spark.range(500).select(F.concat(F.lit('m"'), F.col("id").cast("string")).alias("model")).crossJoin(base).select(*pricing.seed_prices(spark).columns)
    missing = spark.createDataFrame([("acme", "b", 2, 9, 0.0), ("acme", "a", 1, None, 0.0)], MISSING)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        store.export_pricing(prices, missing, str(tmp_path / "out"))
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    found = _document(tmp_path / "out")
    assert len(list((tmp_path / "out").glob("part-*"))) > 1
    assert [p["model"] for p in found["priced"]] == sorted(f'm"{i}' for i in range(500))
    assert found["missing"] == [{"provider": "acme", "model": "a", "events": 1}, {"provider": "acme", "model": "b", "events": 2, "tokens": 9}]


def test_pricing_document_without_rows_and_with_repeated_keys(spark, tmp_path):
    empty = spark.createDataFrame([], MISSING)
    store.export_pricing(pricing.seed_prices(spark).limit(0), empty, str(tmp_path / "none"))
    assert _document(tmp_path / "none") == {"priced": [], "missing": []}
    twice = pricing.seed_prices(spark).unionByName(pricing.seed_prices(spark))
    store.export_pricing(twice, empty, str(tmp_path / "twice"))
    assert len(_document(tmp_path / "twice")["priced"]) == pricing.seed_prices(spark).count()


def test_stamps_of_sources(spark):
    day = lambda n: dt.datetime(2024, 1, n)
    sources = spark.createDataFrame([(i, f"s{i}", day(1), "old") for i in range(5)] + [(None, "none", None, None)], "id long, name string, last_scanned_at timestamp_ntz, last_error string")
    scans = spark.createDataFrame([(0, day(2), None), (1, day(2), None), (1, day(3), "gone"), (2, day(2), "gone"), (2, day(3), None), (3, day(2), None), (3, day(2), "a"), (3, day(2), "b"), (9, day(2), None)], "id long, at timestamp_ntz, error string")
    found = {r["name"]: (r["last_scanned_at"], r["last_error"]) for r in store.stamped(sources, scans).collect()}
    assert found == {"s0": (day(2), None), "s1": (day(2), "gone"), "s2": (day(3), None), "s3": (day(2), "b"), "s4": (day(1), "old"), "none": (None, None)}
    assert store.stamped(sources, scans.limit(0)).count() == 6


def test_inbox_takes_two_levels_and_archives(spark, tmp_path):
    box = tmp_path / "inbox"
    (box / "a" / "b").mkdir(parents=True)
    for name in ("one.jsonl", "a/two.ndjson", "a/b/three.jsonl", "four.log"):
        (box / name).write_text(json.dumps({"model": "gpt-4", "usage": {"input_tokens": 5}, "sessionID": name, "timestamp": "2024-01-05T00:00:00Z"}) + "\n")
    paths = [str(tmp_path / p) for p in ("events", "rollup", "checkpoint")]
    for more in (None, "five.jsonl", "six.jsonl"):
        if more:
            (box / more).write_text(json.dumps({"model": "gpt-4", "usage": {"input_tokens": 5}, "sessionID": more, "timestamp": "2024-01-05T00:00:00Z"}) + "\n")
        watch.watch(watch.inbox_of(spark, str(box), str(tmp_path / "archive")), pricing.seed_prices(spark), *paths, name="inbox").awaitTermination()
    sessions = [r[0] for r in store.read(spark, paths[0]).select("source_session_id").collect()]
    assert sorted(sessions) == ["a/two.ndjson", "five.jsonl", "one.jsonl", "six.jsonl"]
    assert (box / "a" / "b" / "three.jsonl").exists() and (box / "four.log").exists()
    archived = {p.name for p in (tmp_path / "archive").rglob("*.*json*") if not p.name.startswith(".")}
    assert archived <= {"one.jsonl", "two.ndjson", "five.jsonl", "six.jsonl"} and "one.jsonl" in archived
    assert not (box / "one.jsonl").exists()


def test_default_sources(spark, tmp_path):
    assert logs.default_sources(spark, [str(tmp_path / "*")]).count() == 0
    for home in ("x", "y"):
        (tmp_path / home / ".local/share/opencode/log").mkdir(parents=True)
    (tmp_path / "z" / "Library/Logs").mkdir(parents=True)
    (tmp_path / "z" / "Library/Logs/opencode").write_text("a file")
    found = logs.default_sources(spark, [str(tmp_path / "*"), str(tmp_path / "x")]).collect()
    assert [r["path"].rsplit("/", 5)[1] for r in found] == ["x", "y"]
    assert {(r["kind"], r["enabled"]) for r in found} == {("opencode_logs", True)}


def test_lists_are_in_order(spark):
    listed = [tuple(r) for r in ingest_queries.prices_by_key(spark, DATA).collect()]
    assert listed == sorted(listed)
    report = analytics.cache_efficiency(items_of(spark, DATA), QueryFilter(), pricing.seed_prices(spark)).collect()
    for grouping in ("provider", "model"):
        saved = [r["cache_savings_usd"] for r in report if r["grouping"] == grouping]
        assert len(saved) > 1 and saved == sorted(saved, reverse=True)


def test_payloads(spark):
    rows = spark.createDataFrame([("a", None), (None, b"\xc3\xa9"), ("", None), (None, b""), (None, None)], "text string, packed binary")
    assert [r[0] for r in rows.select(store.decoded_payload(F.col("text"), F.col("packed"))).collect()] == ["a", "é", None, None, None]


def test_daily_sums_of_a_stream(spark, tmp_path):
    schema = "timestamp timestamp, total_tokens long"
    folder = str(tmp_path / "in")
    for i, rows in enumerate(([(dt.datetime(2024, 1, 1, 5), 3), (dt.datetime(2024, 1, 2), 4)], [(dt.datetime(2024, 1, 20), 1)], [(dt.datetime(2024, 1, 21), 1)])):
        spark.createDataFrame(rows, schema).write.mode("append").parquet(folder)
        sums = watch.daily_stream(spark.readStream.schema(schema).parquet(folder))
        sums.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "cp")).outputMode("append").trigger(availableNow=True).start(str(tmp_path / "out")).awaitTermination()
    assert sorted(tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [(dt.date(2024, 1, 1), 3, 1), (dt.date(2024, 1, 2), 4, 1)]


def test_size_of_a_store(spark, tmp_path):
    path = str(tmp_path / "events")
    assert store.size_bytes(spark, path) == 0
    spark.range(100).withColumn("event_date", F.lit("2024-01-01")).write.partitionBy("event_date").parquet(path)
    assert store.size_bytes(spark, path) == sum(p.stat().st_size for p in Path(path).rglob("part-*"))


def test_entries_between(spark):
    entries = spark.createDataFrame([(v,) for v in ('{"timestamp":"1704067200000"}', '{"timestamp":"1704067200001"}', '{"timestamp":"soon"}', "{}", None)], "value string")
    start = dt.datetime(2024, 1, 1)
    assert dashboard.entries_between(entries).count() == 5
    assert dashboard.entries_between(entries, start).count() == 2
    assert [r[0] for r in dashboard.entries_between(entries, None, start).collect()] == ['{"timestamp":"1704067200000"}']


def test_pairs_without_a_name_are_not_resolved(spark):
    rows = spark.createDataFrame([("openai", "gpt-5.5"), ("openai", None), (None, "gpt-5.5"), ("acme", "x"), ("openai", "gpt-5.5")], "provider string, model string")
    found = sorted((str(r["provider"]), str(r["model"]), r["resolved"]) for r in pricing.with_resolved(rows, pricing.seed_prices(spark)).collect())
    assert found == [("None", "gpt-5.5", False), ("acme", "x", False), ("openai", "None", False), ("openai", "gpt-5.5", True), ("openai", "gpt-5.5", True)]
