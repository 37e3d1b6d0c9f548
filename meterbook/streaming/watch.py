"""Folders of logs as streams into the event store, and single passes over them.

Both read what producers append to files of lines; a pass (`scan`) also reads
documents and exports that have changed. Late events are always taken: the days
that a batch touches are rolled up anew.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from meterbook.functions.dashboard import from_csv
from meterbook.functions.normalize import first_of_each, normalized
from meterbook.functions.text import private
from meterbook.operators import passes, store
from meterbook.operators.pricing import priced
from meterbook.sources import growing, logs
from meterbook.sources.logs import export_table, json_lines, log_values, of_export


def ingest(lines: DataFrame, prices: DataFrame, ingest_time: Column, redact: bool = True, missing: str = "warn") -> DataFrame:
    """Lines (value, and optionally path; rows of CSV exports as log_values gives them) as priced, redacted events, one of each hash; sessions and projects are numbered by hashes of their names."""
    exports = "path" in lines.columns
    logged = lines.where(~of_export(F.col("path"))) if exports else lines
    rows = priced(first_of_each(normalized(json_lines(logged), ingest_time)), prices, missing)
    rows = rows.withColumn("exactness", F.when(F.col("cost_status") == "Estimated", "estimated").otherwise(F.col("exactness"))).drop("cost_status")
    if exports:
        rows = first_of_each(rows.unionByName(from_csv(export_table(lines), prices, missing), allowMissingColumns=True))
    for number, name in (("session_id", "source_session_id"), ("project_id", "project_path")):
        rows = rows.withColumn(number, F.when(F.col(name).isNotNull(), F.xxhash64(name)))
    return private(rows, redact)


def lines_of(spark: SparkSession, folder: str, files_per_batch: int = 100, archive: str | None = None) -> DataFrame:
    """A stream of the lines, documents and CSV rows below a folder.

    Files of lines may grow: what is added to them is read as it comes. With an
    archive every file counts as finished, is read once and moved there. Of
    files that are read once a batch takes at most files_per_batch of each kind.
    """

    def text(extensions: tuple[str, ...], whole: bool) -> DataFrame:
        if not whole and not archive:
            return growing.line_stream(spark, folder, extensions)
        reader = spark.readStream.option("recursiveFileLookup", "true").option("pathGlobFilter", logs.glob_of(extensions)).option("maxFilesPerTrigger", files_per_batch)
        if archive:
            reader = reader.option("cleanSource", "archive").option("sourceArchiveDir", archive)
        return logs.with_path(reader.text(folder, wholetext=whole))

    return log_values(text)


def inbox_of(spark: SparkSession, folder: str, archive: str, files_per_batch: int = 100) -> DataFrame:
    """A stream of the lines that producers leave in an inbox: finished files in the folder and in those directly below it.

    Each is read once and moved to the archive, which must lie elsewhere. Files
    further down and those with other extensions stay where they are.
    """
    kinds = ",".join(logs.INBOX)
    reader = spark.readStream.option("maxFilesPerTrigger", files_per_batch).option("cleanSource", "archive").option("sourceArchiveDir", archive)
    return logs.with_path(reader.text(f"{folder.rstrip('/')}/{{*,*/*}}.{{{kinds}}}"))


def _stored(rows: DataFrame, prices: DataFrame, events: str, rollup: str, notes: passes.Notes, memory: Callable[[int], dict]) -> Row:
    """One pass: the events of some lines into the store and the rollup. memory: what the pass with a number remembers, called last."""
    spark = rows.sparkSession
    passes.repair(notes, lambda days, noted: store.redo_pass(spark, events, rollup, days, noted))
    # Logs and exports are two branches over the same files.
    rows = rows.persist()
    found = ingest(rows, prices, F.current_timestamp()).persist()
    try:
        days = store.days_of(found)
        number = passes.begin(notes, days)
        done = store.append(found, events, days).first()
        if done["inserted"]:
            store.refresh_rollup(spark, events, rollup, days)
        passes.commit(notes, number, memory(number))
    finally:
        found.unpersist()
        rows.unpersist()
    return done


def scan(spark: SparkSession, folder: str, prices: DataFrame, events: str, rollup: str, ledger: str, largest: int | None = None, ttl: float = passes.TTL) -> Row:
    """One pass over a folder: what is new or added since the last pass goes into the store, then the ledger follows. received, inserted, days.

    The ledger is a folder with a Parquet table of all files for each of the
    last two passes; the committed pass names the one that holds. A pass that
    breaks off leaves it as it was: the next one repairs the rollup and reads
    the same again, and the store drops what it holds. Of several drivers one
    works on a store, and the others fail at once.
    """
    with passes.lease(spark, events, ttl) as notes:
        schema = "path string, modified timestamp, offset long"
        name = passes.remembered(notes).get("ledger")
        known = spark.read.schema(schema).parquet(f"{ledger}/{name}") if name else spark.createDataFrame([], schema)
        changed = growing.with_ends(logs.changed_files(logs.listed_files(spark, folder), known, largest), logs.LINES).persist()

        def ledger_after(number: int) -> dict:
            logs.updated_ledger(known, changed).coalesce(8).write.mode("overwrite").parquet(f"{ledger}/state-{number}")
            _keep_only(spark, ledger, {name, f"state-{number}"})
            return {"ledger": f"state-{number}"}

        try:
            return _stored(logs.read_changed(changed), prices, events, rollup, notes, ledger_after)
        finally:
            changed.unpersist()


def _keep_only(spark: SparkSession, folder: str, names: set[str | None]) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(folder)
    store_of = at.getFileSystem(spark._jsc.hadoopConfiguration())
    for status in store_of.listStatus(at):
        if status.getPath().getName() not in names:
            store_of.delete(status.getPath(), True)


def watch(lines: DataFrame, prices: DataFrame, events: str, rollup: str, checkpoint: str, name: str = "watch", every: str | None = None) -> StreamingQuery:
    """Starts a query, or gives the one that runs under the name. every: a trigger interval; without it, what is there is read once."""
    spark = lines.sparkSession
    for query in spark.streams.active:
        if query.name == name:
            return query

    def batch(rows: DataFrame, _: int) -> None:
        with passes.lease(spark, events, wait=passes.TTL) as notes:
            _stored(rows, prices, events, rollup, notes, lambda _: passes.remembered(notes))

    writer = lines.writeStream.queryName(name).option("checkpointLocation", checkpoint).foreachBatch(batch)
    writer = writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)
    return writer.start()


def active(spark: SparkSession) -> list[str]:
    """The names of the queries that run."""
    return sorted(q.name for q in spark.streams.active if q.name)


def stop(spark: SparkSession, name: str = "watch") -> bool:
    """Whether a query of the name ran and was stopped."""
    found = [q for q in spark.streams.active if q.name == name]
    for query in found:
        query.stop()
    return bool(found)


def daily_stream(events: DataFrame, late: str = "7 days") -> DataFrame:
    """Sums by day of a stream of events (timestamp, total_tokens), for sinks that can't rebuild days."""
    rows = events.withWatermark("timestamp", late).groupBy(F.window("timestamp", "1 day")).agg(F.sum("total_tokens").alias("total_tokens"), F.count(F.lit(1)).alias("events"))
    return rows.select(F.to_date("window.start").alias("date"), "total_tokens", "events")
