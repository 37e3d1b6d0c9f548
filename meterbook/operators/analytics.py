"""The catalogue of usage reports over events that carry cost_usd.

Every report is one plan: filters reach the scan, aggregates combine on the
map side, and only aggregated rows are sorted.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from meterbook.operators.filters import QueryFilter, apply_filter, page
from meterbook.operators.pricing import DEALS, FRESH, context_limits, cost_of, met_by_pair, resolve_pairs, unpriced
from meterbook.schema import EXACTNESS

BREAKDOWNS = {"model": "model", "provider": "provider", "project": "project_id", "source": "source_id", "exactness": "exactness"}
SUMS = ["input_tokens", "output_tokens", "reasoning_tokens", "cache_read_tokens", "cache_write_tokens", "total_tokens", "cost_usd"]
WINDOWS = {"today": 0, "week": 6, "month": 29}


def _sums(*columns: str) -> list[Column]:
    return [F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in columns]


def day_of(timestamp: Column) -> Column:
    return F.to_date(timestamp)


def _dealt(rows: DataFrame, *keys: str) -> DataFrame:
    """rows shuffled by groups of few rows each.

    Combining such groups before a shuffle saves nothing and holds a whole
    split in memory. The number of parts is given, so that small ones aren't
    merged into as large ones as before.
    """
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def _by_session(rows: DataFrame, keys: list[str], *sums: str) -> DataFrame:
    """Sums and events of each session within its keys."""
    return _dealt(rows, *keys, "session_id").groupBy(*keys, "session_id").agg(*_sums(*sums), F.count(F.lit(1)).alias("event_count"))


def rolling(rows: DataFrame, f: QueryFilter, as_of: dt.date, day: str | None = None) -> DataFrame:
    """Tokens and cost of the day, 7 days, 30 days and all time; the filter's dates don't count. rows: events, or a rollup whose date column is `day`."""
    rows = apply_filter(rows, f, dates=False)
    date = F.col(day) if day else day_of(F.col("timestamp"))
    columns = []
    for name, back in WINDOWS.items():
        inside = date == F.lit(as_of) if back == 0 else date >= F.lit(as_of - dt.timedelta(days=back))
        columns += [F.coalesce(F.sum(F.when(inside, F.col(c))), F.lit(0)).alias(f"{name}_{c.split('_')[-1] if c != 'cost_usd' else 'cost'}") for c in ("total_tokens", "cost_usd")]
    return rows.agg(*columns, *[F.coalesce(F.sum(c), F.lit(0)).alias(a) for c, a in (("total_tokens", "lifetime_tokens"), ("cost_usd", "lifetime_cost"))])


def period(events: DataFrame, f: QueryFilter) -> DataFrame:
    """One row over the period: sums, sessions, averages, ratios, unpriced events and the mix of exactness."""
    known = [e for e in EXACTNESS if e != "unknown"]
    totals = apply_filter(events, f).agg(
        *_sums("total_tokens", "cost_usd", "input_tokens", "output_tokens", "reasoning_tokens"),
        F.countDistinct("session_id").alias("sessions"),
        F.count_if(unpriced()).alias("unpriced_events"),
        F.coalesce(F.sum(F.when(unpriced(), F.col("total_tokens"))), F.lit(0)).alias("unpriced_tokens"),
        *[F.count_if(F.col("exactness") == e).alias(f"{e}_events") for e in known],
        F.count_if(~F.coalesce(F.col("exactness"), F.lit("")).isin(known)).alias("unknown_events"),
    )
    ratio = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(0.0)
    return totals.select(
        "*",
        ratio("total_tokens", "sessions").alias("tokens_per_session"),
        (F.col("reasoning_tokens") / F.greatest(F.col("input_tokens") + F.col("output_tokens"), F.lit(1)) * 100).alias("reasoning_pct"),
        ratio("input_tokens", "output_tokens").alias("input_output_ratio"),
    )


def previous_period(events: DataFrame, f: QueryFilter, strict_compat: bool = False) -> DataFrame:
    """total_tokens and cost_usd of the period before, under the same filters."""
    return apply_filter(events, f.previous(strict_compat)).agg(*_sums("total_tokens", "cost_usd"))


def largest(events: DataFrame, f: QueryFilter, key: str, measure: str) -> DataFrame:
    """The key with the greatest sum of the measure; ties go to the smallest key."""
    return apply_filter(events, f).where(F.col(key).isNotNull()).groupBy(key).agg(F.sum(measure).alias(measure)).orderBy(F.desc(measure), key).limit(1)


def cache_savings_by_key(events: DataFrame, f: QueryFilter, prices: DataFrame) -> DataFrame:
    """What cached input saved, with prices of exactly the event's provider and model."""
    price = prices.select("provider", "model", "input_price_per_million", "cache_read_price_per_million")
    saved = F.greatest(F.lit(0.0), F.coalesce(F.col("input_price_per_million") - F.col("cache_read_price_per_million"), F.lit(0.0)))
    rows = apply_filter(events, f).groupBy("provider", "model").agg(F.sum("cache_read_tokens").alias("read"))
    return rows.join(price, ["provider", "model"], "left").agg(F.coalesce(F.sum(F.col("read") * saved / 1e6), F.lit(0.0)).alias("cache_savings_usd"))


def timeseries(events: DataFrame, f: QueryFilter) -> DataFrame:
    return apply_filter(events, f).groupBy(day_of(F.col("timestamp")).alias("date")).agg(*_sums(*SUMS)).orderBy("date")


def breakdown(events: DataFrame, f: QueryFilter, dimension: str, limit: int | None = 50) -> DataFrame:
    """key, sums and sessions by one dimension; null keys show as (none); most tokens first."""
    if dimension not in BREAKDOWNS:
        raise ValueError(f"unknown dimension {dimension!r}")
    key = F.coalesce(F.col(BREAKDOWNS[dimension]).cast("string"), F.lit("(none)")).alias("key")
    sums = ("input_tokens", "output_tokens", "total_tokens", "cost_usd")
    rows = _by_session(apply_filter(events, f).withColumn("key", key), ["key"], *sums).groupBy("key").agg(*_sums(*sums), F.count("session_id").alias("sessions"))
    rows = rows.orderBy(F.desc("total_tokens"), "key")
    return rows if limit is None else rows.limit(limit)


def session_aggregates(events: DataFrame, f: QueryFilter, sessions: DataFrame | None = None) -> DataFrame:
    """One row per session with events; with the session table also its label, and only sessions in it.

    Events are summed by session and pair first: with names as keys the sums
    are hashed, and distinct models need no second copy of the rows.
    """
    rows = _dealt(apply_filter(events, f).where(F.col("session_id").isNotNull()), "session_id", "provider", "model")
    pairs = rows.groupBy("session_id", "provider", "model").agg(
        F.min("timestamp").alias("started_at"),
        F.max("timestamp").alias("last_seen_at"),
        *_sums(*SUMS),
        F.count(F.lit(1)).alias("event_count"),
        F.max(F.col("input_tokens") + F.col("cache_read_tokens") + F.col("tool_tokens")).alias("peak_context_tokens"),
    )
    rows = pairs.groupBy("session_id").agg(
        F.array_max(F.collect_set("provider")).alias("provider"),
        F.array_max(F.collect_set("model")).alias("model"),
        F.min("started_at").alias("started_at"),
        F.max("last_seen_at").alias("last_seen_at"),
        *_sums(*SUMS, "event_count"),
        F.size(F.collect_set("model")).cast("long").alias("model_switches"),
        F.max("peak_context_tokens").alias("peak_context_tokens"),
    )
    if sessions is None:
        return rows.withColumn("label", F.concat(F.lit("session "), F.col("session_id").cast("string")))
    labels = sessions.select(F.col("id").alias("session_id"), F.coalesce("title", "source_session_id").alias("label"))
    return rows.join(labels, "session_id")


def daily_aggregates(events: DataFrame, f: QueryFilter) -> DataFrame:
    rows = apply_filter(events, f).withColumn("date", day_of(F.col("timestamp")))
    days = _by_session(rows, ["date"], *SUMS).groupBy("date").agg(*_sums(*SUMS), F.count("session_id").alias("session_count"), F.sum("event_count").alias("event_count"))
    # Apart, as two distinct counts in one would copy every row.
    models = rows.groupBy(F.col("date").alias("m_date")).agg(F.countDistinct("model").alias("model_count"))
    return days.join(models, F.col("date").eqNullSafe(F.col("m_date"))).select("date", *SUMS, "session_count", "model_count", "event_count")


def session_list(events: DataFrame, sessions: DataFrame, f: QueryFilter) -> DataFrame:
    """Sessions by last use, the latest first; 500 unless the filter says otherwise."""
    rows = session_aggregates(events, f, sessions).select("session_id", "label", "provider", "model", "started_at", "last_seen_at", "total_tokens", "cost_usd", "event_count")
    return page(rows.orderBy(F.desc("last_seen_at"), "session_id"), f)


def session_detail(events: DataFrame, sessions: DataFrame, session_id: int) -> DataFrame:
    """The session's row even if it has no events (sums are 0 then)."""
    one = sessions.where(F.col("id") == session_id).select(F.col("id").alias("session_id"), F.coalesce("title", "source_session_id").alias("label"))
    sums = apply_filter(events, QueryFilter()).where(F.col("session_id") == session_id).groupBy("session_id").agg(*_sums("total_tokens", "cost_usd"), F.count(F.lit(1)).alias("event_count"), F.max("timestamp").alias("last_seen_at"))
    return one.join(sums, "session_id", "left").fillna(0, ["total_tokens", "cost_usd", "event_count"])


def session_events(events: DataFrame, session_id: int) -> DataFrame:
    return apply_filter(events, QueryFilter()).where(F.col("session_id") == session_id).orderBy("timestamp", "event_hash")


def session_daily(events: DataFrame, session_id: int) -> DataFrame:
    """Sums by day of one session, with running tokens."""
    days = timeseries(events.where(F.col("session_id") == session_id), QueryFilter())
    return days.withColumn("cumulative_tokens", F.sum("total_tokens").over(Window.orderBy("date").rowsBetween(Window.unboundedPreceding, 0)))


def event_page(events: DataFrame, f: QueryFilter) -> DataFrame:
    """Events, the latest first; 500 unless the filter says otherwise."""
    return page(apply_filter(events, f).orderBy(F.desc("timestamp"), "event_hash"), f)


def event_count(events: DataFrame, f: QueryFilter) -> DataFrame:
    return apply_filter(events, f).agg(F.count(F.lit(1)).alias("events"))


def resolved_savings(events: DataFrame, f: QueryFilter, prices: DataFrame, pairs: DataFrame | None = None) -> DataFrame:
    """Filtered events with saved: what their cached input saved under resolved prices. pairs: as for pricing.priced."""
    rows = apply_filter(events, f)
    covered = resolve_pairs(rows if pairs is None else pairs, prices).select("provider", "model", F.greatest(F.lit(0.0), F.col("input_price_per_million") - F.col("cache_read_price_per_million")).alias("gap"))
    return met_by_pair(rows, covered, FRESH).withColumn("saved", F.col("cache_read_tokens") * F.coalesce("gap", F.lit(0.0)) / 1e6)


def cache_efficiency(events: DataFrame, f: QueryFilter, prices: DataFrame, pairs: DataFrame | None = None) -> DataFrame:
    """grouping (day, provider, model), key, sums, savings and sessions, from one pass; with pairs (as for pricing.priced) also from one scan.

    Events are first combined by day, provider, model and session, so that the
    three groupings expand those rows and not the events.
    """
    rows = resolved_savings(events, f, prices, pairs)
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("(none)"))
    rows = rows.withColumns({"day": day_of(F.col("timestamp")).cast("string"), "provider": text("provider"), "model": text("model")})
    fine = _by_session(rows, ["day", "provider", "model"], "cache_read_tokens", "cache_write_tokens", "total_tokens", "cost_usd", "saved")
    each = F.explode(F.array(*[F.struct(F.lit(g).alias("grouping"), F.col(g).alias("key")) for g in ("day", "provider", "model")]))
    fine = fine.withColumn("g", each).select("g.*", "session_id", "cache_read_tokens", "cache_write_tokens", "total_tokens", "cost_usd", "saved")
    found = fine.groupBy("grouping", "key").agg(*_sums("cache_read_tokens", "cache_write_tokens", "total_tokens", "cost_usd"), F.sum("saved").alias("cache_savings_usd"), F.countDistinct("session_id").alias("sessions"))
    # Days by date, providers and models by savings.
    return found.orderBy("grouping", F.when(F.col("grouping") == "day", F.col("key")), F.desc("cache_savings_usd"), "key")


def report_totals(events: DataFrame, f: QueryFilter, prices: DataFrame) -> DataFrame:
    """One row: savings, cache reads and writes over all days, and sessions that filled four fifths of their context."""
    days = cache_efficiency(events, f, prices).where(F.col("grouping") == "day").agg(F.coalesce(F.sum("cache_savings_usd"), F.lit(0.0)).alias("cache_savings_usd"), *_sums("cache_read_tokens", "cache_write_tokens"))
    return days.crossJoin(context_trend(events, f, prices).agg(F.coalesce(F.sum("sessions_over_80"), F.lit(0)).alias("sessions_over_80")))  # one row each


def session_utilization(sessions: DataFrame, prices: DataFrame) -> DataFrame:
    """Session aggregates with context_limit and utilization_pct (0 where the limit is unknown)."""
    limits = context_limits(sessions, prices).select(F.col("provider").alias("l_provider"), F.col("model").alias("l_model"), "context_limit")
    # Dealt as in pricing.met_by_pair, whose join takes no null providers.
    limits = limits.withColumn("l_deal", F.explode(F.sequence(F.lit(0), F.lit(DEALS - 1))))
    deal = F.pmod(F.xxhash64("session_id"), F.lit(DEALS)) == F.col("l_deal")
    rows = sessions.join(limits, F.col("provider").eqNullSafe(F.col("l_provider")) & (F.col("model") == F.col("l_model")) & deal, "left").drop("l_provider", "l_model", "l_deal")
    return rows.withColumn("utilization_pct", F.when(F.col("context_limit") > 0, F.greatest(F.col("peak_context_tokens"), F.lit(0)) / F.col("context_limit") * 100).otherwise(0.0))


def context_sessions(events: DataFrame, f: QueryFilter, prices: DataFrame, sessions: DataFrame | None = None, limit: int = 100) -> DataFrame:
    rows = session_utilization(session_aggregates(events, f, sessions), prices)
    return rows.select("session_id", "label", "provider", "model", "last_seen_at", "peak_context_tokens", "context_limit", "utilization_pct", "event_count", "model_switches", "cost_usd").orderBy(F.desc("utilization_pct"), F.desc("peak_context_tokens"), "session_id").limit(limit)


def context_trend(events: DataFrame, f: QueryFilter, prices: DataFrame) -> DataFrame:
    """By the day of last use, over all sessions with a known limit."""
    rows = session_utilization(session_aggregates(events, f), prices).where(F.col("context_limit") > 0)
    u = F.col("utilization_pct")
    return rows.groupBy(day_of(F.col("last_seen_at")).alias("date")).agg(F.avg(u).alias("avg_utilization_pct"), F.max(u).alias("max_utilization_pct"), F.count_if(u >= 80).alias("sessions_over_80")).orderBy("date")


def swap_quote(events: DataFrame, prices: DataFrame, session_id: int, provider: str, model: str, missing: str = "warn") -> DataFrame:
    """What a session would have cost with another model: one row, or none for a session without events."""
    target = events.sparkSession.createDataFrame([(provider, model)], "provider string, model string")
    covered = resolve_pairs(target, prices, missing == "estimate").drop("provider", "model", "p_provider", "p_model")
    limit = context_limits(target, prices).select(F.col("context_limit").alias("target_context_window_tokens"))
    rows = apply_filter(events, QueryFilter()).where(F.col("session_id") == session_id).select("session_id", "cost_usd", "input_tokens", "output_tokens", "reasoning_tokens", "cache_read_tokens", "cache_write_tokens")
    rows = rows.join(F.broadcast(covered.withColumn("one", F.lit(1))), F.lit(1) == F.col("one"), "left")
    cost = cost_of(*[F.col(c) for c in ("input_tokens", "output_tokens", "reasoning_tokens", "cache_read_tokens", "cache_write_tokens")])
    cost = F.when(F.col("rank").isNull() | F.col("is_local"), 0.0).otherwise(cost)
    status = F.when(F.col("rank").isNull(), 2).when((F.col("rank") >= 10) & ~F.col("is_local"), 1).otherwise(0)
    one = rows.groupBy("session_id").agg(F.sum("cost_usd").alias("current_cost_usd"), F.sum(cost).alias("simulated_cost_usd"), F.max(status).alias("status"), F.count(F.lit(1)).alias("events_count"))
    delta = F.col("simulated_cost_usd") - F.col("current_cost_usd")
    return one.select(
        "session_id", F.lit(provider).alias("target_provider"), F.lit(model).alias("target_model"), "current_cost_usd", "simulated_cost_usd", delta.alias("delta_usd"),
        F.when(F.abs("current_cost_usd") > 2.220446049250313e-16, delta / F.col("current_cost_usd") * 100).otherwise(0.0).alias("delta_pct"),
        F.element_at(F.array(*[F.lit(s) for s in ("priced", "estimated", "unpriced")]), F.col("status") + 1).alias("target_pricing_status"), "events_count",
    ).join(F.broadcast(limit), F.lit(True), "left")


def heatmap(events: DataFrame, f: QueryFilter) -> DataFrame:
    """Tokens by day of week (Sunday is 0) and hour, zeros filled, with the greatest cell."""
    cells = apply_filter(events, f).groupBy((F.dayofweek("timestamp") - 1).alias("dow"), F.hour("timestamp").alias("hour")).agg(F.sum("total_tokens").alias("total_tokens"))
    grid = events.sparkSession.range(168).select(F.expr("CAST(id DIV 24 AS INT)").alias("dow"), (F.col("id") % 24).cast("int").alias("hour"))
    full = grid.join(F.broadcast(cells), ["dow", "hour"], "left").fillna(0, ["total_tokens"])
    return full.withColumn("max_tokens", F.max("total_tokens").over(Window.partitionBy()))


def forecast(events: DataFrame, f: QueryFilter, points: int = 14, ahead: int = 30) -> DataFrame:
    """A line through the cost of the last days with use, and its value `ahead` days on, not below 0. Fewer than two days give no value."""
    days = timeseries(events, f).select("date", "cost_usd").orderBy(F.desc("date")).limit(points)
    numbered = days.withColumn("x", (F.row_number().over(Window.orderBy("date")) - 1).cast("double"))
    line = numbered.agg(F.regr_slope("cost_usd", "x").alias("slope"), F.regr_intercept("cost_usd", "x").alias("intercept"), F.count(F.lit(1)).alias("points"))
    return line.withColumn("forecast_usd", F.greatest(F.lit(0.0), F.col("intercept") + F.col("slope") * (F.col("points") - 1 + ahead)))


def shares(events: DataFrame, f: QueryFilter, dimension: str) -> DataFrame:
    """A breakdown with its shares of tokens and cost, the share of the largest, and USD per 1000 tokens."""
    rows = breakdown(events, f, dimension, None)
    everything = Window.partitionBy()
    part = lambda c, whole: F.when(whole > 0, F.col(c) / whole * 100).otherwise(0.0)
    return rows.select(
        "key", "total_tokens", "cost_usd", part("total_tokens", F.sum("total_tokens").over(everything)).alias("token_share_pct"), part("cost_usd", F.sum("cost_usd").over(everything)).alias("cost_share_pct"),
        part("total_tokens", F.max("total_tokens").over(everything)).alias("of_largest_pct"), F.when(F.col("total_tokens") > 0, F.col("cost_usd") / F.col("total_tokens") * 1000).otherwise(0.0).alias("usd_per_1k"),
    )


def imported_totals(events: DataFrame, sources: DataFrame, kind: str) -> DataFrame:
    """Events, tokens and cost of the sources of one kind, and the latest timestamp, from which a next import goes on."""
    own = sources.where(F.col("kind") == kind).select(F.col("id").alias("source_id"))
    return events.join(own, "source_id").agg(F.count(F.lit(1)).alias("events"), *_sums("total_tokens", "cost_usd"), F.max("timestamp").alias("high_water"))


def session_totals(sessions: DataFrame, events: DataFrame) -> DataFrame:
    """The session table with total_tokens and total_cost_usd made anew from events."""
    sums = apply_filter(events, QueryFilter()).groupBy("session_id").agg(F.sum("total_tokens").alias("total_tokens"), F.sum("cost_usd").alias("total_cost_usd"))
    rows = sessions.drop("total_tokens", "total_cost_usd").join(sums.withColumnRenamed("session_id", "id"), "id", "left")
    return rows.fillna(0, ["total_tokens", "total_cost_usd"])
