"""Usage events of a vendor's dashboard: saved API pages and CSV exports."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meterbook.functions.normalize import first_of_each, with_hash
from meterbook.operators.pricing import exactness_of_status, priced

PROVIDER = "cursor"
# The export's columns.
CSV_COLUMNS = ["Date", "Cloud Agent ID", "Automation ID", "Kind", "Model", "Input (w/ Cache Write)", "Input (w/o Cache Write)", "Cache Read", "Output Tokens", "Total Tokens", "Cost"]
CSV_REQUIRED = ["Date", "Model", "Total Tokens"]
SECRET_KEYS = ["sessionToken", "WorkosCursorSessionToken", "token", "cookie"]
_USAGE = ["inputTokens", "input_tokens", "outputTokens", "output_tokens", "cacheWriteTokens", "cache_write_tokens", "cacheReadTokens", "cache_read_tokens", "totalTokens", "total_tokens", "totalCents", "total_cents"]
API_SCHEMA = "timestamp string, model string, kind string, cloudAgentId string, owningUser string, automationId string, chargedCents string, charged_cents string, tokenUsage struct<" + ", ".join(f"{k}: string" for k in _USAGE) + ">"


def included(kind: Column) -> Column:
    k = F.lower(kind)
    return k.contains("included") | (k == "free")


def event_type(kind: Column) -> Column:
    return F.when(included(kind), "included").when(F.lower(kind).contains("usage"), "usage_based").otherwise(F.lower(kind))


def count(*texts: Column) -> Column:
    """The first number, rounded; 0 if there is none."""
    return F.coalesce(*[F.round(t.try_cast("double")).cast("long") for t in texts], F.lit(0).cast("long"))


def cents(*texts: Column) -> Column:
    """The first positive number, or null."""
    return F.coalesce(*[F.when(t.try_cast("double") > 0, t.try_cast("double")) for t in texts])


def cost_cents(text: Column) -> Column:
    """Cents of a cost in USD, with or without a dollar sign; null for Included, free and anything else."""
    return F.regexp_replace(F.trim(text), r"^\$", "").try_cast("double") * 100


def without_secrets(raw: Column) -> Column:
    """The JSON object without its secret keys."""
    kept = F.map_filter(F.from_json(raw, "map<string,variant>"), lambda k, _: ~k.isin(SECRET_KEYS))
    return F.to_json(kept)


def with_bill(rows: DataFrame) -> DataFrame:
    """Cost and exactness of rows with cost_usd and cost_status: the bill counts first, then the vendor's own cost of the model, then the price table."""
    free, bill, own = included(F.col("kind")), F.col("charged_cents"), F.col("model_cents")
    exactness = F.when(bill > 0, "exact").when(own.isNotNull(), F.when(free, "mixed").otherwise("exact")).when(free, F.when(F.col("counted"), "mixed").otherwise("estimated")).otherwise(exactness_of_status(F.col("cost_status")))
    rows = rows.withColumn("exactness", exactness).withColumn("cost_usd", F.when(bill > 0, bill / 100).when(own.isNotNull(), own / 100).otherwise(F.col("cost_usd")))
    return rows.drop("cost_status", "charged_cents", "model_cents", "counted", "kind")


def _costed(rows: DataFrame, prices: DataFrame, missing: str) -> DataFrame:
    rows = with_bill(priced(with_hash(rows.withColumn("reasoning_tokens", F.lit(0).cast("long"))), prices, missing))
    rows = rows.withColumn("tool_tokens", F.lit(0).cast("long")).withColumn("confidence", F.lit(1.0)).withColumn("ignored", F.lit(False))
    return first_of_each(rows)


def recosted(events: DataFrame, prices: DataFrame, missing: str = "warn") -> DataFrame:
    """Stored events of the dashboard with cost and exactness made anew from their payloads; events whose payload is no object stay as they are."""
    j = F.from_json("raw_json", API_SCHEMA)
    u = j["tokenUsage"]
    own = F.coalesce(F.col("raw_json").startswith("{") & F.try_parse_json("raw_json").isNotNull(), F.lit(False))
    rows = priced(events.withColumnRenamed("exactness", "old_exactness").withColumnRenamed("cost_usd", "old_cost"), prices, missing)
    rows = rows.withColumn("has_payload", own).withColumn("kind", F.coalesce(j["kind"], F.lit(""))).withColumn("charged_cents", cents(j["chargedCents"], j["charged_cents"])).withColumn("model_cents", cents(u["totalCents"], u["total_cents"])).withColumn("counted", u.isNotNull())
    rows = with_bill(rows)
    rows = rows.withColumn("cost_usd", F.when(F.col("has_payload"), F.col("cost_usd")).otherwise(F.col("old_cost"))).withColumn("exactness", F.when(F.col("has_payload"), F.col("exactness")).otherwise(F.col("old_exactness")))
    return rows.select(*events.columns)


def page_entries(pages: DataFrame, size: int = 100) -> DataFrame:
    """The entries (value) of saved pages (page, from 1; value: the response) that a paged read takes: up to the first empty page, the page that reaches the stated total, or, without a total, the first short one."""
    j = F.from_json("value", "totalUsageEventsCount long, usageEventsDisplay array<variant>")
    rows = pages.select("page", F.coalesce(j["totalUsageEventsCount"], F.lit(0)).alias("total"), F.coalesce(j["usageEventsDisplay"], F.array().cast("array<variant>")).alias("entries"))
    n = F.size("entries")
    last = rows.where((n == 0) | F.when(F.col("total") > 0, F.col("page") * size >= F.col("total")).otherwise(n < size)).agg(F.min("page").alias("last"))
    taken = rows.join(F.broadcast(last), F.coalesce(F.col("page") <= F.col("last"), F.lit(True)))  # one row
    return taken.select(F.explode("entries").alias("entry")).select(F.to_json("entry").alias("value"))


def entries_between(entries: DataFrame, start: dt.datetime | None = None, end: dt.datetime | None = None) -> DataFrame:
    """The entries (value) of a range of time, both ends included, as the dashboard is asked for it; with a range, entries without a time in milliseconds are left out."""
    at = F.get_json_object("value", "$.timestamp").try_cast("long")
    if start is not None:
        entries = entries.where(at >= F.unix_millis(F.lit(start).cast("timestamp")))
    return entries if end is None else entries.where(at <= F.unix_millis(F.lit(end).cast("timestamp")))


def sync_range(high_water: dt.datetime | None, cycle: tuple[dt.datetime, dt.datetime], now: dt.datetime, full: bool = False) -> tuple[dt.datetime, dt.datetime]:
    """What a sync asks for: from the latest known event until now, or the billing cycle where nothing is known or all is wanted."""
    return cycle if full or high_water is None else (high_water, now)


def _total(total: Column) -> Column:
    return F.when(total > 0, total).otherwise(F.col("input_tokens") + F.col("output_tokens") + F.col("cache_read_tokens") + F.col("cache_write_tokens"))


def from_api(lines: DataFrame, prices: DataFrame, missing: str = "warn") -> DataFrame:
    """Events of a page's entries (value: one JSON object a row); entries without a time in milliseconds are left out."""
    rows = lines.select("value", F.from_json("value", API_SCHEMA).alias("j"))
    u = F.col("j.tokenUsage")
    blank = lambda c: F.when(F.length(c) > 0, c)
    rows = rows.select(
        F.timestamp_millis(F.col("j.timestamp").try_cast("long")).alias("timestamp"), F.lit(PROVIDER).alias("provider"), F.coalesce("j.model", F.lit("unknown")).alias("model"), F.coalesce("j.kind", F.lit("usage")).alias("kind"),
        count(u["inputTokens"], u["input_tokens"]).alias("input_tokens"), count(u["outputTokens"], u["output_tokens"]).alias("output_tokens"), count(u["cacheWriteTokens"], u["cache_write_tokens"]).alias("cache_write_tokens"),
        count(u["cacheReadTokens"], u["cache_read_tokens"]).alias("cache_read_tokens"), count(u["totalTokens"], u["total_tokens"]).alias("given_total"),
        F.coalesce(blank(F.coalesce("j.cloudAgentId", "j.owningUser")), blank(F.col("j.automationId"))).alias("source_session_id"),
        cents(F.col("j.chargedCents"), F.col("j.charged_cents")).alias("charged_cents"), cents(u["totalCents"], u["total_cents"]).alias("model_cents"), u.isNotNull().alias("counted"), without_secrets(F.col("value")).alias("raw_json"),
    ).where(F.col("timestamp").isNotNull())
    rows = rows.withColumn("event_type", event_type(F.col("kind"))).withColumn("total_tokens", _total(F.col("given_total"))).drop("given_total")
    return _costed(rows, prices, missing)


def from_csv(table: DataFrame, prices: DataFrame, missing: str = "warn") -> DataFrame:
    """Events of an export's rows (text columns, and optionally path); a table that lacks the required columns gives none."""
    if not set(CSV_REQUIRED) <= set(table.columns):
        table = table.limit(0)
    c = {name: F.coalesce(F.col(f"`{name}`"), F.lit("")) if name in table.columns else F.lit("") for name in CSV_COLUMNS}
    date, blank = c["Date"], lambda x: F.when(F.length(x) > 0, x)
    number = lambda name: F.coalesce(F.trim(c[name]).try_cast("long"), F.lit(0).cast("long"))
    rows = table.select(
        F.coalesce(F.try_to_timestamp(F.when(date.contains("T"), date)), F.timestamp_millis(date.try_cast("long"))).alias("timestamp"), F.lit(PROVIDER).alias("provider"), F.coalesce(blank(c["Model"]), F.lit("unknown")).alias("model"), c["Kind"].alias("kind"),
        number("Input (w/o Cache Write)").alias("input_tokens"), number("Output Tokens").alias("output_tokens"), number("Input (w/ Cache Write)").alias("cache_write_tokens"), number("Cache Read").alias("cache_read_tokens"), number("Total Tokens").alias("given_total"),
        F.coalesce(blank(c["Cloud Agent ID"]), blank(c["Automation ID"])).alias("source_session_id"), cost_cents(c["Cost"]).alias("charged_cents"), F.lit(None).cast("double").alias("model_cents"), F.lit(True).alias("counted"),
        F.to_json(F.struct(date.alias("date"), c["Kind"].alias("kind"), c["Model"].alias("model"), c["Cost"].alias("cost"))).alias("raw_json"),
        *([F.col("path").alias("raw_source_path")] if "path" in table.columns else []),
    ).where(F.col("timestamp").isNotNull())
    rows = rows.withColumn("event_type", event_type(F.col("kind"))).withColumn("total_tokens", _total(F.col("given_total"))).drop("given_total")
    return _costed(rows, prices, missing)
