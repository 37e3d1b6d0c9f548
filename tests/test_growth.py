"""Growing files, upkeep of the store, and the rules around a sync."""

from __future__ import annotations

import datetime as dt
import json

import public_tokenizers
import pytest
import tiktoken
from meterbook.functions import dashboard, text
from meterbook.operators import passes, pricing, store
from meterbook.sources import logs
from meterbook.streaming import watch
from pyspark.sql import functions as F


def _line(i: int) -> str:
    return json.dumps({"model": f"m{i}", "timestamp": f"2024-03-0{1 + i % 3}T00:00:00Z", "input_tokens": 10 + i, "output_tokens": 1, "sessionID": f"s{i}"})


def test_scan_reads_what_was_added(spark, tmp_path):
    folder, paths = tmp_path / "in", [f"{tmp_path}/{x}" for x in ("events", "daily", "ledger")]
    folder.mkdir()
    prices = pricing.seed_prices(spark)
    scan = lambda: watch.scan(spark, str(folder), prices, *paths)
    models = lambda: {r.model for r in spark.read.parquet(paths[0]).select("model").collect()}
    (folder / "a.JSONL").write_text(_line(0) + "\n" + _line(1) + "\n")
    (folder / "b.json").write_text(json.dumps([json.loads(_line(2))]))
    assert (scan().inserted, models()) == (3, {"m0", "m1", "m2"})
    assert scan().received == 0
    with (folder / "a.JSONL").open("a") as f:
        f.write(_line(3) + "\n" + _line(4)[:9])
    assert (scan().received, models()) == (1, {"m0", "m1", "m2", "m3"})
    # The half line was held back, and is read when its other half is there.
    with (folder / "a.JSONL").open("a") as f:
        f.write(_line(4)[9:] + "\n" + _line(5) + "\n")
    done = scan()
    assert (done.received, models()) == (2, {"m0", "m1", "m2", "m3", "m4", "m5"})
    # A document that has changed is read as a whole.
    (folder / "b.json").write_text(json.dumps([json.loads(_line(2)), json.loads(_line(6))], indent=1))
    done = scan()
    assert (done.received, done.inserted) == (2, 1)
    assert spark.read.parquet(paths[0]).agg(F.sum("total_tokens")).first() == spark.read.parquet(paths[1]).agg(F.sum("total_tokens")).first()
    assert watch.active(spark) == []
    with passes.lease(spark, paths[0]), pytest.raises(RuntimeError, match="already"):
        scan()


def test_large_files_are_reported(spark):
    files = spark.createDataFrame([("a.log", dt.datetime(2024, 1, 1), 10), ("b.log", dt.datetime(2024, 1, 1), 99)], "path string, modified timestamp, length long")
    ledger = spark.createDataFrame([], "path string, modified timestamp, offset long")
    assert logs.changed_files(files, ledger).count() == 2
    assert [r.path for r in logs.changed_files(files, ledger, 50).collect()] == ["a.log"]
    assert [r.path for r in logs.skipped_files(files, 50).collect()] == ["b.log"]


def test_emptied_days_leave_the_rollup(spark, tmp_path):
    path, daily = f"{tmp_path}/events", f"{tmp_path}/daily"
    events = pricing.priced(logs.sample_events(spark, dt.datetime(2024, 5, 1, 12)), pricing.seed_prices(spark)).drop("cost_status").withColumn("session_id", F.xxhash64("source_session_id")).withColumn("project_id", F.lit(None).cast("long"))
    store.append(events, path)
    store.refresh_rollup(spark, path, daily)
    gone = dt.date(2024, 4, 28)
    kept = f"{tmp_path}/kept"
    store.append(events.where(F.to_date("timestamp") != F.lit(gone)), kept)
    store.refresh_rollup(spark, kept, daily, [gone, dt.date(2024, 4, 29)])
    assert spark.read.parquet(daily).where(F.col("date") == F.lit(gone)).count() == 0
    assert spark.read.parquet(daily).agg(F.sum("total_tokens")).first() == spark.read.parquet(kept).agg(F.sum("total_tokens")).first()


def test_sync_reset_and_probe(spark, tmp_path):
    meta = spark.createDataFrame([(None, dt.datetime(2024, 1, 1), "", 5)], "last_sync_at timestamp, last_sync_cursor timestamp, last_sync_result string, events_total long")
    row = store.synced(meta, dt.datetime(2024, 2, 2), None, "0 new events", 0).first()
    assert (row.last_sync_at, row.last_sync_cursor, row.events_total) == (dt.datetime(2024, 2, 2), dt.datetime(2024, 1, 1), 5)
    assert store.synced(meta, dt.datetime(2024, 2, 2), dt.datetime(2024, 2, 1), "", 3).first().last_sync_cursor == dt.datetime(2024, 2, 1)
    cycle, now = (dt.datetime(2024, 1, 1), dt.datetime(2024, 2, 1)), dt.datetime(2024, 1, 20)
    assert dashboard.sync_range(None, cycle, now) == dashboard.sync_range(now, cycle, now, True) == cycle
    assert dashboard.sync_range(dt.datetime(2024, 1, 9), cycle, now) == (dt.datetime(2024, 1, 9), now)
    tables, deleted = store.reset({"usage_events": spark.range(4), "sessions": spark.range(2), "model_pricing": spark.range(3)})
    assert {r.table: r.deleted for r in deleted.collect()} == {"usage_events": 4, "sessions": 2}
    assert [tables[t].count() for t in ("usage_events", "sessions", "model_pricing")] == [0, 0, 3]
    with pytest.raises(ValueError, match="no table"):
        logs.exported_events({"other": spark.range(1)}, F.current_timestamp())
    (tmp_path / "x" / "logs").mkdir(parents=True)
    assert [p.rpartition("/")[2] for p in logs.existing_folders(spark, [f"{tmp_path}/*/logs", f"{tmp_path}/none"])] == ["logs"]


def test_pages_with_a_total(spark):
    page = lambda ns, **more: json.dumps({"usageEventsDisplay": [{"n": n} for n in ns], **more})
    pages = spark.createDataFrame([(1, page([1, 2], totalUsageEventsCount=3)), (2, page([3], totalUsageEventsCount=3)), (3, page([9], totalUsageEventsCount=3))], "page int, value string")
    assert sorted(r.value for r in dashboard.page_entries(pages, 2).collect()) == ['{"n":1}', '{"n":2}', '{"n":3}']
    assert dashboard.page_entries(pages.limit(0), 2).count() == 0


def test_vocabulary_by_model(spark):
    newer, older = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    texts = ["Die Geschwindigkeit der Straßenbahn überrascht", "plain words here", None, ""]
    rows = spark.createDataFrame([(t, m) for t in texts for m in ("gpt-4-turbo", "gpt-4o", None)], "t string, m string")
    found = rows.select("t", "m", text.estimated_tokens(F.col("t"), "bpe", newer, F.col("m"), older).alias("n")).collect()

    def encoder(path):
        import base64

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        return tiktoken.Encoding("plain", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary

    by = {True: encoder(older), False: encoder(newer)}
    assert all(r.n == len(by[r.m == "gpt-4-turbo"](r.t or "")) for r in found)
    assert len({r.n for r in found if r.t == texts[0]}) == 2
