"""Logs, exported tables and generated samples as usage events."""

from __future__ import annotations

import datetime as dt
import io
import json
from collections.abc import Callable, Iterator
from itertools import islice

import pyarrow as pa
from pyspark.sql import Column, DataFrame, DataFrameReader, SparkSession
from pyspark.sql import functions as F

from meterbook.functions.dashboard import CSV_COLUMNS
from meterbook.functions.normalize import detected_provider, instant, with_hash
from meterbook.functions.variants import once, with_parsed
from meterbook.sources import exports, growing

# The extensions of logs.
LINES, DOCUMENTS, EXPORTS = ("jsonl", "log", "ndjson", "txt"), ("json",), ("csv",)
EXTENSIONS = (*LINES, *DOCUMENTS, *EXPORTS)
# The extensions of files in an inbox, and the folders below a home in which a producer keeps its logs.
INBOX = ("jsonl", "ndjson")
LOG_FOLDERS = [".local/share/opencode/log", "Library/Logs/opencode", "AppData/Local/opencode/log", "AppData/Roaming/opencode/log"]
# Models of the generated sample, by provider; the other numbers of the sample are in sample_events.
SAMPLE_MODELS = {
    "openai": ["gpt-5.5", "gpt-5.4", "gpt-5.4-mini", "o4-mini"],
    "anthropic": ["claude-fable-5", "claude-opus-4.8", "claude-sonnet-4.6", "claude-haiku-4.5"],
    "google": ["gemini-3.1-pro-preview", "gemini-3.5-flash"],
}


def listed_files(spark: SparkSession, folder: str) -> DataFrame:
    """path, modified, length of the log files below a folder; contents aren't read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).select("path", F.col("modificationTime").alias("modified"), "length")
    return files.where(F.lower(F.substring_index("path", ".", -1)).isin(*EXTENSIONS))


def start_offset(path: Column, modified: Column, length: Column, was_modified: Column, was_offset: Column) -> Column:
    """The byte from which a file is to be read: its end if nothing has changed, the last end if a file of lines has grown, else 0."""
    unchanged = (was_modified == modified) & (was_offset == length)
    grown = F.lower(F.substring_index(path, ".", -1)).isin(*LINES) & (was_offset > 0) & (length > was_offset)
    return F.when(unchanged, length).when(grown, was_offset).otherwise(F.lit(0).cast("long"))


def changed_files(files: DataFrame, ledger: DataFrame, largest: int | None = None) -> DataFrame:
    """files with start, of those that are new or have changed since the ledger (path, modified, offset); files larger than largest bytes are left for `skipped_files`."""
    known = ledger.select(F.col("path").alias("l_path"), F.col("modified").alias("l_modified"), F.col("offset").alias("l_offset"))
    rows = files.join(known, F.col("path") == F.col("l_path"), "left")
    rows = rows.withColumn("start", start_offset(F.col("path"), F.col("modified"), F.col("length"), F.col("l_modified"), F.col("l_offset")))
    rows = rows.where(F.col("l_path").isNull() | (F.col("start") < F.col("length")) | ((F.col("length") == 0) & (F.col("l_offset") > 0))).drop("l_path", "l_modified", "l_offset")
    return rows if largest is None else rows.where(F.col("length") <= largest)


def skipped_files(files: DataFrame, largest: int) -> DataFrame:
    return files.where(F.col("length") > largest)


def updated_ledger(ledger: DataFrame, files: DataFrame) -> DataFrame:
    """The ledger after the files were read to their ends: to `stop`, where with_ends has set it."""
    read = files.select("path", "modified", F.col("stop" if "stop" in files.columns else "length").alias("offset"))
    return ledger.join(read.select("path"), "path", "left_anti").select("path", "modified", "offset").unionByName(read)


def read_changed(files: DataFrame) -> DataFrame:
    """value and path of what changed_files found and growing.with_ends measured (path, start, stop): files of lines from their start, and exports, by ranges, documents as a whole."""
    extension = F.lower(F.substring_index("path", ".", -1))

    def text(extensions: tuple[str, ...], whole: bool) -> DataFrame:
        chosen = files.where(extension.isin(*extensions))
        return growing.read_whole(chosen) if whole else growing.read_ranges(chosen)

    return json_lines(log_values(text, exports.read_exports(files.where(extension.isin(*EXPORTS)))))


def json_lines(lines: DataFrame) -> DataFrame:
    """One row a text that may be a JSON object, by its first and last character: arrays are opened, blank lines and others left out. lines: value, and optionally path.

    Objects are parsed by whoever reads their fields, once.
    """
    more = [c for c in lines.columns if c != "value"]
    # The text is computed once, and one scan serves both: only texts that begin as arrays are parsed here.
    rows = once(lines.select(F.col("value").alias("text"), *more), "value", F.trim("text")).drop("text")
    array = F.col("value").startswith("[")
    rows = with_parsed(rows.where(array | F.col("value").startswith("{")).withColumn("array", F.when(array, F.col("value"))), "array", "parsed")
    parts = F.transform(F.try_variant_get("parsed", "$", "array<variant>"), lambda x: F.to_json(x))
    opened = rows.select(F.explode(F.when(array, parts).otherwise(F.array("value"))).alias("value"), *more)
    return opened.where(F.col("value").startswith("{") & F.col("value").endswith("}"))


def glob_of(extensions: tuple[str, ...]) -> str:
    """Files with one of the extensions, in any case."""
    return "*.{" + ",".join("".join(f"[{c}{c.upper()}]" for c in e) for e in extensions) + "}"


def _export_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The records of whole CSV exports, as exports.read_exports has them."""
    for batch in batches:
        for text, path in zip(batch["value"], batch["path"], strict=True):
            data = text.as_py().encode()
            objects = map(json.dumps, exports.records_in(io.BytesIO(data), 0, len(data), len(data), "S", "S"))
            while some := list(islice(objects, exports.ROWS)):
                yield pa.RecordBatch.from_pydict({"value": some, "path": [path.as_py()] * len(some)})


def log_values(text: Callable[[tuple[str, ...], bool], DataFrame], records: DataFrame | None = None) -> DataFrame:
    """value and path of all files in EXTENSIONS: lines, .json documents, and one JSON object a row of a CSV export. text: value and path of the files with some extensions, by lines or whole; records: those of the exports, if they were read by ranges.

    A .json file that isn't one JSON value is taken by lines.
    """

    def read(extensions: tuple[str, ...], whole: bool) -> DataFrame:
        return text(extensions, whole).select(F.regexp_replace("value", "^\ufeff", "").alias("value"), "path")

    parts = F.when(F.col("parsed").isNotNull(), F.array("value")).otherwise(F.split("value", "\r?\n"))
    documents = with_parsed(read(DOCUMENTS, True), "value", "parsed").select(F.explode(parts).alias("value"), "path")
    if records is None:
        records = read(EXPORTS, True).mapInArrow(_export_rows, "value string, path string")
    return read(LINES, False).unionByName(documents).unionByName(records)


def with_path(texts: DataFrame) -> DataFrame:
    """value and path of what Spark's reader of texts gives."""
    return texts.select("value", F.col("_metadata.file_path").alias("path"))


def of_export(path: Column) -> Column:
    """Whether a value is a row of a CSV export."""
    return F.coalesce(F.lower(F.substring_index(path, ".", -1)).isin(*EXPORTS), F.lit(False))


def export_table(values: DataFrame) -> DataFrame:
    """The rows of CSV exports, as text columns, with their path."""
    row = F.from_json("value", ", ".join(f"`{c}` string" for c in CSV_COLUMNS))
    return values.where(of_export(F.col("path"))).select(row.alias("row"), "path").select("row.*", "path")


def read_logs(spark: SparkSession, paths: list[str] | str) -> DataFrame:
    """value and path of the JSON objects in log files: a .json file holds one document, others one object a line; a row of a CSV export is an object of its columns."""

    def reader(extensions: tuple[str, ...]) -> DataFrameReader:
        return spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", glob_of(extensions))

    listed = reader(EXPORTS).format("binaryFile").load(paths).select("path", F.col("length").alias("stop"))
    return json_lines(log_values(lambda extensions, whole: with_path(reader(extensions).text(paths, wholetext=whole)), exports.read_exports(listed)))


def _field(data: Column, *keys: str) -> Column:
    return F.coalesce(*[F.get_json_object(data, f"$.{k}") for k in keys])


def _count(data: Column, *keys: str) -> Column:
    return F.coalesce(*[F.round(F.get_json_object(data, f"$.{k}").try_cast("double")).cast("long") for k in keys], F.lit(0).cast("long"))


def from_parts(parts: DataFrame, messages: DataFrame, sessions: DataFrame, ingest_time: Column) -> DataFrame:
    """Events of exported tables part(id, session_id, message_id, data), message(id, time_created, data) and session(id, time_created)."""
    data = F.col("data")
    # The cheap test comes first: few parts are steps.
    steps = parts.where(data.contains("step-finish") | data.contains("step.finish")).where(F.get_json_object("data", "$.type").isin("step-finish", "step.finish"))
    m = messages.select(F.col("id").alias("message_id"), F.col("time_created").alias("m_time"), F.col("data").alias("m_data"))
    s = sessions.select(F.col("id").alias("session_id"), F.col("time_created").alias("s_time"))
    rows = steps.join(m, "message_id", "left").join(s, "session_id", "left")
    cached = lambda name, *more: F.when(F.get_json_object("data", "$.tokens.cache").isNotNull(), _count(data, *[f"tokens.cache.{k}" for k in (name, *more)])).otherwise(_count(data, *[f"tokens.{k}" for k in (name, *more)]))
    model = F.coalesce(_field(data, "modelID", "model_id"), F.when(~F.get_json_object("data", "$.model").startswith("{"), F.get_json_object("data", "$.model")), _field(data, "model.id", "model.modelID"), F.lit("unknown"))
    time = F.coalesce("m_time", "s_time", F.lit(0)).cast("long")
    rows = rows.where(F.get_json_object("data", "$.tokens").isNotNull()).select(
        F.when(time > 0, instant(time)).otherwise(ingest_time).alias("timestamp"), F.col("session_id").cast("string").alias("source_session_id"), model.alias("model"), F.coalesce(_field(data, "providerID", "provider_id", "provider"), detected_provider(model)).alias("provider"),
        F.coalesce(_field(data, "type"), F.lit("step.finish")).alias("event_type"),
        _count(data, "tokens.input", "tokens.input_tokens", "tokens.prompt_tokens").alias("input_tokens"), _count(data, "tokens.output", "tokens.output_tokens", "tokens.completion_tokens").alias("output_tokens"),
        _count(data, "tokens.reasoning", "tokens.reasoning_tokens").alias("reasoning_tokens"), cached("read", "cache_read", "cache_read_tokens", "cached_tokens").alias("cache_read_tokens"), cached("write", "cache_write", "cache_write_tokens").alias("cache_write_tokens"),
        _count(data, "tokens.total", "tokens.total_tokens").alias("given_total"), F.col("data").alias("raw_json"), "m_data",
    )
    rows = rows.withColumn("total_tokens", F.greatest("given_total", F.col("input_tokens") + F.col("output_tokens") + F.col("reasoning_tokens"))).where("total_tokens <> 0 or input_tokens <> 0 or output_tokens <> 0")
    # The hash is that of the part alone; the message then fills what the part lacks.
    rows = with_hash(rows)
    named = F.coalesce(_field(F.col("m_data"), "modelID", "model_id"), _field(F.col("m_data"), "model.id", "model.modelID"))
    rows = rows.withColumn("model", F.when(F.col("model") == "unknown", F.coalesce(named, F.lit("unknown"))).otherwise(F.col("model")))
    provider = F.coalesce(_field(F.col("m_data"), "providerID", "provider_id"), F.when(F.col("m_data").isNotNull(), detected_provider(F.col("model"))), F.col("provider"))
    rows = rows.withColumn("provider", provider).withColumn("message_role", _field(F.col("m_data"), "role"))
    return rows.withColumn("tool_tokens", F.lit(0).cast("long")).withColumn("exactness", F.lit("exact")).withColumn("confidence", F.lit(0.95)).withColumn("ignored", F.lit(False)).drop("given_total", "m_data")


def exported_events(tables: dict[str, DataFrame], ingest_time: Column) -> DataFrame:
    """Events of an exported database, by the tables that it has: part (with message and session), or messages."""
    if "part" in tables:
        return from_parts(tables["part"], tables["message"], tables["session"], ingest_time)
    if "messages" in tables:
        return from_messages(tables["messages"])
    raise ValueError(f"no table of events among {sorted(tables)}")


def existing_folders(spark: SparkSession, candidates: list[str]) -> list[str]:
    """Those of the configured folders (globs, in any store that Spark reads) that hold something."""
    hadoop = spark._jvm.org.apache.hadoop.fs
    found = []
    for candidate in candidates:
        at = hadoop.Path(candidate)
        found += [str(s.getPath().toString()) for s in at.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(at) or [] if s.isDirectory()]
    return found


def default_sources(spark: SparkSession, homes: list[str]) -> DataFrame:
    """The sources (name, kind, path, enabled) that exist below some homes, which may be globs."""
    found = existing_folders(spark, [f"{home.rstrip('/')}/{folder}" for home in homes for folder in LOG_FOLDERS])
    return spark.createDataFrame([(f"Logs: {path}", "opencode_logs", path, True) for path in sorted(set(found))], "name string, kind string, path string, enabled boolean")


def from_messages(messages: DataFrame) -> DataFrame:
    """Events of an exported table messages(id, session_id, role, model, prompt_tokens, completion_tokens, created_at)."""
    n = lambda c: F.coalesce(F.col(c).cast("long"), F.lit(0).cast("long"))
    rows = messages.where(n("prompt_tokens") + n("completion_tokens") > 0)
    model = F.coalesce("model", F.lit("unknown"))
    rows = rows.select(
        instant(F.col("created_at")).alias("timestamp"), F.col("session_id").cast("string").alias("source_session_id"), model.alias("model"), detected_provider(model).alias("provider"), F.lit("message").alias("event_type"), F.col("role").alias("message_role"),
        n("prompt_tokens").alias("input_tokens"), n("completion_tokens").alias("output_tokens"), *[F.lit(0).cast("long").alias(c) for c in ("reasoning_tokens", "cache_read_tokens", "cache_write_tokens", "tool_tokens")], (n("prompt_tokens") + n("completion_tokens")).alias("total_tokens"),
    )
    return with_hash(rows).withColumn("exactness", F.lit("exact")).withColumn("confidence", F.lit(0.95)).withColumn("ignored", F.lit(False)).withColumn("raw_json", F.lit(None).cast("string"))


def sample_events(spark: SparkSession, now: dt.datetime, days: int = 14) -> DataFrame:
    """Deterministic events of the days before now."""
    return sampled_days(spark.range(days).withColumnRenamed("id", "day"), now)


def sampled_days(days: DataFrame, now: dt.datetime) -> DataFrame:
    """Deterministic events of some days (day: how many before now): 3 to 8 sessions a day, 5 to 15 messages each."""
    rows = days.select("day").withColumn("s", F.explode(F.sequence(F.lit(0), 2 + F.col("day") % 6))).withColumn("count", 5 + F.col("s") % 11)
    rows = rows.withColumn("m", F.explode(F.sequence(F.lit(0), F.col("count") - 1)))
    pick = lambda values, i: F.element_at(F.array(*[F.lit(v) for v in values]), (i % len(values) + 1).cast("int"))
    rows = rows.withColumn("provider", pick(["openai", "anthropic", "google", "openai"], F.col("day") + F.col("s")))
    model = F.lit(None).cast("string")
    for provider, models in SAMPLE_MODELS.items():
        model = F.when(F.col("provider") == provider, pick(models, F.col("s"))).otherwise(model)
    rows = rows.withColumn("model", model).withColumn("input_tokens", 15000 + (F.col("m") * 1847 + F.col("day") * 813 + F.col("s") * 297) % 180000).withColumn("output_tokens", 8000 + (F.col("m") * 1223 + F.col("day") * 497 + F.col("s") * 271) % 95000)
    reasons, caches = F.col("model").rlike("o3|o4|gpt-5[.]5|fable"), F.col("model").rlike("gpt-5|claude|gemini")
    rows = rows.withColumn("reasoning_tokens", F.when(reasons, (F.col("output_tokens") * 0.6).cast("long")).otherwise(0)).withColumn("cache_read_tokens", F.when(caches, (F.col("input_tokens") * 0.55).cast("long")).otherwise(0))
    back = F.make_dt_interval(F.col("day").cast("int"), F.lit(0), ((F.col("count") - F.col("m")) * 2).cast("int"))
    rows = rows.select(
        (F.lit(now).cast("timestamp") - back).alias("timestamp"), "provider", "model", F.concat_ws("-", F.lit("sess"), F.col("day").cast("string"), F.col("s").cast("string")).alias("source_session_id"), F.lit("message").alias("event_type"),
        F.when(F.col("m") % 2 == 0, "user").otherwise("assistant").alias("message_role"), "input_tokens", "output_tokens", F.col("reasoning_tokens").cast("long").alias("reasoning_tokens"), F.col("cache_read_tokens").cast("long").alias("cache_read_tokens"),
        F.lit(0).cast("long").alias("cache_write_tokens"), F.lit(0).cast("long").alias("tool_tokens"), (F.col("input_tokens") + F.col("output_tokens") + F.col("reasoning_tokens")).alias("total_tokens"), F.lit("exact").alias("exactness"), F.lit(0.95).alias("confidence"), F.lit(False).alias("ignored"),
    )
    return with_hash(rows)
