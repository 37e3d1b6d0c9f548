"""The event store: Parquet partitioned by day, with idempotent appends and a rollup that follows them.

A hash holds the event's time, so equal events lie in the same day, and an
append is compared with the days that it touches only. Within a day rows are
clustered by session, so that looking one up skips what it isn't in.
"""

from __future__ import annotations

import datetime as dt
import json
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from dataclasses import asdict, dataclass, fields
from functools import reduce

from pyspark.sql import Column, DataFrame, DataFrameWriter, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from meterbook.operators import passes, pricing
from meterbook.operators.filters import QueryFilter, apply_filter
from meterbook.operators.rollup import daily_rollup, session_days

EXPORTED = ["timestamp", "event_type", "provider", "model", "message_role", "input_tokens", "output_tokens", "reasoning_tokens", "cache_read_tokens", "cache_write_tokens", "total_tokens", "cost_usd", "exactness", "event_hash"]


def read(spark: SparkSession, path: str) -> DataFrame | None:
    """The table at a path, or None if nothing was written there yet."""
    try:
        return spark.read.parquet(path)
    except AnalysisException as e:
        if e.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return None
        raise


def days_of(events: DataFrame) -> list[dt.date | None]:
    """The days of some events, None for those without a time: as many as an append touches."""
    return [r[0] for r in events.select(F.to_date("timestamp").alias("d")).distinct().collect()]


def on_days(days: list[dt.date | None], column: str = "event_date") -> Column:
    """Whether a date, which may be null, is one of some days."""
    known = F.col(column).isin([d for d in days if d is not None])
    return known | F.col(column).isNull() if None in days else known


def _clustered(rows: DataFrame, day: str, *keys: str) -> DataFrameWriter:
    """A writer by day whose rows are ordered by some keys, with Bloom filters on those that aren't written by dictionary.

    Ranges are cut between sampled rows, so that neither a busy day nor a busy
    session is one task as long as the last key tells its rows apart.
    """
    writer = rows.repartitionByRange(day, *keys).sortWithinPartitions(day, *keys).write.partitionBy(day).option("compression", "zstd")
    # A filter takes the size that its row group needs, not the largest allowed.
    writer = writer.option("parquet.bloom.filter.adaptive.enabled", "true")
    for key in keys:
        writer = writer.option(f"parquet.bloom.filter.enabled#{key}", "true")
    return writer


def _write_events(rows: DataFrame, path: str) -> None:
    _clustered(rows, "event_date", "session_id", "event_hash").mode("append").parquet(path)


def append(events: DataFrame, path: str, days: list[dt.date | None] | None = None) -> DataFrame:
    """Adds the events that the store lacks; one row: received, inserted, days (those touched).

    Events without a time lie in a day of their own, null. Equal hashes have
    equal times, so the store is asked by hash within the touched days.
    """
    spark = events.sparkSession
    events = events.withColumn("event_date", F.to_date("timestamp")).persist()
    try:
        received, fresh = events.count(), events.dropDuplicates(["event_hash"])
        touched = days_of(events) if days is None else days
        held = read(spark, path)
        if held is not None:
            fresh = fresh.join(held.where(on_days(touched)).select("event_hash"), "event_hash", "left_anti").select(*events.columns)
        inserted = fresh.persist().count()
        if inserted:
            _write_events(fresh, path)
        fresh.unpersist()
        return spark.createDataFrame([(received, inserted, touched)], "received long, inserted long, days array<date>")
    finally:
        events.unpersist()


def refresh_rollup(spark: SparkSession, store: str, rollup: str, days: list[dt.date | None] | None = None) -> None:
    """Makes the rollup's days anew (all, if none are named), and its session days beside it; other days stay, and named days without events any more go."""
    events = read(spark, store)
    if events is None:
        return
    if days is not None:
        events = events.where(on_days(days))
    mode = "dynamic" if days is not None else "static"
    for writer, path in ((daily_rollup(events).write.partitionBy("date"), rollup), (_clustered(session_days(events), "date", "session_id"), session_days_path(rollup))):
        writer.mode("overwrite").option("partitionOverwriteMode", mode).parquet(path)
    for day in set(days or []) - set(days_of(events)):
        # A dynamic overwrite leaves partitions that it has no rows for.
        for path in (rollup, session_days_path(rollup)):
            _delete(spark, _day_path(path, "date", day))


def session_days_path(rollup: str) -> str:
    return rollup.rstrip("/") + "_sessions"


def days_of_session(spark: SparkSession, rollup: str, session_id: int) -> list[dt.date | None]:
    """The days on which a session has events that count, from the session days beside the rollup; no event is read."""
    days = read(spark, session_days_path(rollup))
    return [] if days is None else [r[0] for r in days.where(F.col("session_id") == session_id).select("date").distinct().collect()]


def session_events(spark: SparkSession, path: str, rollup: str, session_id: int) -> DataFrame | None:
    """The stored events of one session that aren't ignored, read from its days alone; None if nothing was stored yet.

    Give them to the reports of one session in place of all events.
    """
    events = read(spark, path)
    if events is None:
        return None
    return apply_filter(events.where(on_days(days_of_session(spark, rollup, session_id))), QueryFilter()).where(F.col("session_id") == session_id)


def events_by_hash(spark: SparkSession, path: str, hashes: list[str], days: list[dt.date | None] | None = None) -> DataFrame | None:
    """The stored events with some hashes (a handful; join tables of more); days, if they are known, spare the footers of others."""
    events = read(spark, path)
    if events is None:
        return None
    return (events if days is None else events.where(on_days(days))).where(F.col("event_hash").isin(hashes))


def _day_path(path: str, column: str, day: dt.date | None) -> str:
    return f"{path}/{column}={day or '__HIVE_DEFAULT_PARTITION__'}"


def _hadoop(spark: SparkSession, path: str) -> tuple[object, object]:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def _delete(spark: SparkSession, path: str) -> None:
    files, at = _hadoop(spark, path)
    files.delete(at, True)


def held_days(spark: SparkSession, path: str) -> list[dt.date | None]:
    """The days that a store has folders for; no file is read."""
    files, at = _hadoop(spark, path)
    if not files.exists(at):
        return []
    names = [s.getPath().getName() for s in files.listStatus(at)]
    texts = [n.partition("=")[2] for n in names if n.startswith("event_date=")]
    return [None if t == "__HIVE_DEFAULT_PARTITION__" else dt.date.fromisoformat(t) for t in texts]


def expire(spark: SparkSession, path: str, as_of: dt.date, days: int) -> int:
    """Deletes the stored events of all days more than `days` before as_of; their number. Whole days go, nothing is rewritten; the rollup keeps them.

    Events without a time have no age and stay.
    """
    with passes.lease(spark, path):
        old = [d for d in held_days(spark, path) if d is not None and d < as_of - dt.timedelta(days=days)]
        if not old:
            return 0
        deleted = read(spark, path).where(on_days(old)).count()
        for day in old:
            _delete(spark, _day_path(path, "event_date", day))
        return deleted


#: Folders of a store in which days are written anew; readers don't see them.
_ASIDE = "_replacing-"


def _sweep(spark: SparkSession, path: str) -> None:
    """Deletes what removals that broke off before their note have left."""
    files, at = _hadoop(spark, path)
    for status in files.listStatus(at) if files.exists(at) else []:
        if status.getPath().getName().startswith(_ASIDE):
            files.delete(status.getPath(), True)


def remove_sources(spark: SparkSession, path: str, rollup: str, ids: DataFrame) -> int:
    """Deletes the stored events of some sources (id); their number. The days that held any are written anew, and rolled up anew; others aren't touched."""
    with _rewriting(spark, path, rollup) as notes:
        events = read(spark, path)
        if events is None:
            return 0
        gone = events.join(ids.select(F.col("id").alias("source_id")).distinct(), "source_id", "left_semi")
        touched = _by_day(gone)
        _replace_days(notes, path, rollup, list(touched), lambda held: without_sources(held, ids))
        return sum(touched.values())


def reprice(spark: SparkSession, path: str, rollup: str, prices: DataFrame, missing: str = "warn") -> int:
    """Prices the stored events again; the number of those whose cost or exactness has changed.

    A first scan reads names, counts and costs alone and finds the days that
    hold a change; only these are written and rolled up anew. Nothing is kept
    about earlier prices, so it doesn't matter with which ones an event came in.
    """
    with _rewriting(spark, path, rollup) as notes:
        events = read(spark, path)
        if events is None:
            return 0
        before = [F.col("cost_usd").alias("old_cost"), F.col("exactness").alias("old_exactness")]
        after = pricing.repriced(events.select("*", *before), prices, missing)
        changed = after.where(~(F.col("cost_usd").eqNullSafe(F.col("old_cost")) & F.col("exactness").eqNullSafe(F.col("old_exactness"))))
        touched = _by_day(changed)
        _replace_days(notes, path, rollup, list(touched), lambda held: pricing.repriced(held, prices, missing))
        return sum(touched.values())


def _by_day(events: DataFrame) -> dict[dt.date | None, int]:
    return {r["event_date"]: r["n"] for r in events.groupBy("event_date").agg(F.count(F.lit(1)).alias("n")).collect()}


@contextmanager
def _rewriting(spark: SparkSession, path: str, rollup: str) -> Iterator[passes.Notes]:
    """The lease of a store, after what broke off before has been finished or swept away."""
    with passes.lease(spark, path) as notes:
        passes.repair(notes, lambda days, noted: redo_pass(spark, path, rollup, days, noted))
        _sweep(spark, path)
        yield notes


def _replace_days(notes: passes.Notes, path: str, rollup: str, days: list[dt.date | None], change: Callable[[DataFrame], DataFrame]) -> None:
    """Puts what `change` makes of some days' events in their place.

    It is written aside first, and noted; then each day's folder is replaced. A
    replacement that breaks off before the note has changed nothing, and one
    after it is finished by the next pass.
    """
    if not days:
        return
    spark, aside = notes.spark, f"{path}/{_ASIDE}{uuid.uuid4().hex}"
    held = read(spark, path).where(on_days(days))
    _write_events(change(held).select(*held.columns), aside)
    left = held_days(spark, aside)
    noted = {"aside": aside, "emptied": passes.texts([d for d in days if d not in left])}
    number = passes.begin(notes, days, **noted)
    redo_pass(spark, path, rollup, days, noted)
    passes.commit(notes, number, passes.remembered(notes))


def redo_pass(spark: SparkSession, path: str, rollup: str, days: list[dt.date | None], noted: dict) -> None:
    """Finishes the replacement of days, if one was noted, and rolls days up anew. Doing it twice does no harm."""
    if aside := noted.get("aside"):
        for day in passes.dates(noted["emptied"]):
            _delete(spark, _day_path(path, "event_date", day))
        for day in held_days(spark, aside):
            files, staged = _hadoop(spark, _day_path(aside, "event_date", day))
            _delete(spark, _day_path(path, "event_date", day))
            files.rename(staged, _hadoop(spark, _day_path(path, "event_date", day))[1])
        _delete(spark, aside)
    refresh_rollup(spark, path, rollup, days)


def upserted_sessions(sessions: DataFrame, events: DataFrame) -> DataFrame:
    """The session table (id, source_session_id, source_id, provider, model, title, started_at, last_seen_at) after new events.

    A new session takes provider and model from its first event; a known one
    keeps them, and its times widen. Numbers are hashes of source and name.
    """
    key = ["source_id", "source_session_id"]
    first = F.min_by(F.struct("provider", "model"), F.struct("timestamp", "event_hash"))
    found = events.where(F.col("source_session_id").isNotNull()).groupBy(*key).agg(first.alias("first"), F.min("timestamp").alias("from"), F.max("timestamp").alias("to"))
    new = found.select(*[F.col(k).alias(f"n_{k}") for k in key], F.col("first.provider").alias("n_provider"), F.col("first.model").alias("n_model"), "from", "to")
    both = sessions.join(new, (F.col("source_id").eqNullSafe(F.col("n_source_id"))) & (F.col("source_session_id") == F.col("n_source_session_id")), "full")
    known = F.col("source_session_id").isNotNull()
    pick = lambda c: F.when(known, F.col(c)).otherwise(F.col(f"n_{c}"))
    return both.select(
        F.when(known, F.col("id")).otherwise(F.xxhash64("n_source_id", "n_source_session_id")).alias("id"), pick("source_session_id").alias("source_session_id"), pick("source_id").alias("source_id"), pick("provider").alias("provider"), pick("model").alias("model"), "title",
        F.least("started_at", "from").alias("started_at"), F.greatest("last_seen_at", "to").alias("last_seen_at"),
    )


def synced(meta: DataFrame, at: dt.datetime, cursor: dt.datetime | None, summary: str, added: int) -> DataFrame:
    """The row of a source's syncs (last_sync_at, last_sync_cursor, last_sync_result, events_total) after one more: without a cursor the old one stays."""
    cursor_column = F.coalesce(F.lit(cursor).cast("timestamp"), F.col("last_sync_cursor"))
    return meta.select(F.lit(at).cast("timestamp").alias("last_sync_at"), cursor_column.alias("last_sync_cursor"), F.lit(summary).alias("last_sync_result"), (F.col("events_total") + added).alias("events_total"))


def reset(tables: dict[str, DataFrame], kept: tuple[str, ...] = ("model_pricing",)) -> tuple[dict[str, DataFrame], DataFrame]:
    """(the tables without their rows, but for those to keep; table and deleted rows of each)."""
    gone = [name for name in sorted(tables) if name not in kept]
    counts = [tables[name].agg(F.lit(name).alias("table"), F.count(F.lit(1)).alias("deleted")) for name in gone]
    return {name: df.limit(0) if name in gone else df for name, df in tables.items()}, reduce(DataFrame.unionByName, counts)


def without_sources(events: DataFrame, ids: DataFrame) -> DataFrame:
    return events.join(ids.select(F.col("id").alias("source_id")), "source_id", "left_anti")


def retained(events: DataFrame, as_of: dt.date, days: int) -> DataFrame:
    """Events of the last days; the rollup keeps what is dropped here."""
    return events.where(F.to_date("timestamp") >= F.lit(as_of - dt.timedelta(days=days)))


def latest_by(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """The old rows with new ones in place of those with the same key; null keys are equal."""
    fresh = new.dropDuplicates(key)
    same = [old[k].eqNullSafe(fresh[k]) for k in key]
    return old.join(fresh, same, "left_anti").unionByName(fresh)


def size_bytes(spark: SparkSession, path: str) -> int:
    """The bytes of a table's files, 0 where there is none; hidden files, such as checksums, don't count."""
    if read(spark, path) is None:
        return 0
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.agg(F.coalesce(F.sum("length"), F.lit(0))).first()[0]


def stamped(sources: DataFrame, scans: DataFrame) -> DataFrame:
    """sources (id, last_scanned_at, last_error, and others) after some scans (id, at, error: null if the scan went well).

    A scan that went well sets the time and clears the error; one that failed
    sets the error and leaves the time. The latest scan of a source tells its
    error, of those at one time a failed one. Scans of unknown sources are left out.
    """
    state = F.max(F.struct("at", F.col("error").isNotNull().alias("failed"), "error"))
    latest = scans.groupBy("id").agg(F.max(F.when(F.col("error").isNull(), F.col("at"))).alias("scanned"), state.alias("state"))
    rows = sources.join(latest, "id", "left")
    stamps = {"last_scanned_at": F.coalesce("scanned", "last_scanned_at"), "last_error": F.when(F.col("state").isNull(), F.col("last_error")).otherwise(F.col("state.error"))}
    return rows.select(*[stamps[c].alias(c) if c in stamps else F.col(c) for c in sources.columns])


def compact(spark: SparkSession, path: str, to: str, files: int = 1) -> None:
    """Writes a table anew with few files a day, each in the order of sessions."""
    rows = spark.read.parquet(path).repartition("event_date", F.pmod(F.xxhash64("event_hash"), F.lit(files)))
    rows.sortWithinPartitions("event_date", "session_id", "event_hash").write.option("compression", "zstd").partitionBy("event_date").parquet(to)


def csv_rows(events: DataFrame) -> DataFrame:
    """The exported columns as texts: costs with six decimals, nulls empty."""
    return events.select(*[F.format_string("%.6f", F.coalesce(c, F.lit(0.0))).alias(c) if c == "cost_usd" else F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in EXPORTED])


def export_csv(events: DataFrame, path: str) -> None:
    """All events as CSV."""
    csv_rows(events).write.mode("overwrite").option("header", "true").option("emptyValue", "").csv(path)


def export_json(events: DataFrame, path: str) -> None:
    events.write.mode("overwrite").json(path)


def pricing_envelope(prices: DataFrame, missing: DataFrame) -> DataFrame:
    """The lines (section, provider, model, value) of one JSON document with the priced and the missing models.

    By section, provider and model the values are the document. Each model is a
    line of its own, so nothing is gathered. Of rows with one key the smallest counts.
    """
    key = ["provider", "model"]

    def members(rows: DataFrame, section: int, columns: list[str]) -> DataFrame:
        rows = rows.groupBy(*key).agg(F.to_json(F.min(F.struct(*columns))).alias("value"))
        first = rows.agg(F.min(F.struct(*key)).alias("first"))  # one row
        comma = F.when(F.struct(*key) == F.col("first"), "").otherwise(",")
        return rows.join(F.broadcast(first), F.lit(True)).select(F.lit(section).alias("section"), *key, F.concat(comma, "value").alias("value"))

    frame = [(0, "", "", '{"priced":['), (2, "", "", '],"missing":['), (4, "", "", "]}")]
    lines = prices.sparkSession.createDataFrame(frame, "section int, provider string, model string, value string")
    return lines.unionByName(members(prices, 1, prices.columns)).unionByName(members(missing, 3, [*key, "events", "tokens"]))


def export_pricing(prices: DataFrame, missing: DataFrame, path: str) -> None:
    """The document of pricing_envelope as text files, which are it in the order of their names."""
    pricing_envelope(prices, missing).orderBy("section", "provider", "model").select("value").write.mode("overwrite").text(path)


def pricing_import(texts: DataFrame) -> DataFrame:
    """Price rows of JSON texts (value): an array, or an object with rows or pricing; names are trimmed, missing rates are 0."""
    row = "array<struct<provider: string, model: string, " + ", ".join(f"{r}: double" for r in pricing.RATES) + ", context_window_tokens: long, is_local: boolean, currency: string, source: string>>"
    listed = F.when(F.ltrim("value").startswith("["), F.from_json("value", row))
    inside = F.from_json("value", f"rows {row}, pricing {row}")
    rows = texts.select(F.explode(F.coalesce(listed, inside["rows"], inside["pricing"])).alias("r")).select("r.*")
    rates = [F.coalesce(r, F.lit(0.0)).alias(r) for r in pricing.RATES]
    rows = rows.select(F.trim("provider").alias("provider"), F.trim("model").alias("model"), *rates, "context_window_tokens", F.coalesce("currency", F.lit("USD")).alias("currency"), F.lit(None).cast("string").alias("effective_date"), F.coalesce("is_local", F.lit(False)).alias("is_local"), F.coalesce("source", F.lit("import")).alias("source"), F.lit("").alias("updated_at"))
    return rows.where((F.length("provider") > 0) & (F.length("model") > 0))


@dataclass(frozen=True)
class Settings:
    """Typed settings; texts that don't parse give the default."""

    # Names and defaults of the settings.
    currency: str = "USD"
    autostart: bool = False
    start_minimized: bool = False
    theme: str = "system"
    store_raw_json: bool = True
    store_message_text: bool = False
    redact_secrets: bool = True
    anonymize_paths: bool = False
    raw_retention_days: int = 14
    max_db_size_mb: int = 0
    auto_cleanup: bool = True
    default_range: str = "7d"
    missing_price_behavior: str = "warn"
    token_estimation_mode: str = "chars4"
    watcher_enabled: bool = True
    debug_logging: bool = False
    collector_endpoint_enabled: bool = False

    @classmethod
    def decoded(cls, rows: DataFrame) -> Settings:
        """From a table (key, value) of texts: as many rows as there are settings."""
        texts = {r["key"]: r["value"] for r in rows.select("key", "value").where(F.col("key").isin([f.name for f in fields(cls)])).collect()}
        found = {}
        for f in fields(cls):
            default, text = getattr(cls, f.name), texts.get(f.name)
            if text is None:
                continue
            try:
                found[f.name] = text == "true" if isinstance(default, bool) else type(default)(text)
            except ValueError:
                continue
        return cls(**found)

    def encoded(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([(k, json.dumps(v) if not isinstance(v, str) else v) for k, v in asdict(self).items()], "key string, value string")


def decoded_payload(text: Column, packed: Column) -> Column:
    """A payload that is stored as text, or else as UTF-8 bytes; an empty one is null. Parquet compresses both."""
    found = F.coalesce(packed.cast("string"), text)
    return F.when(F.length(found) > 0, found)
