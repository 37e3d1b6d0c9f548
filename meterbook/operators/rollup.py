"""The daily rollup, its upkeep, and when it can answer instead of the events."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meterbook.operators.filters import QueryFilter, apply_filter

KEY = ["date", "provider", "model", "project_id"]
SUMS = ["input_tokens", "output_tokens", "reasoning_tokens", "cache_read_tokens", "cache_write_tokens", "total_tokens", "cost_usd"]


def daily_rollup(events: DataFrame) -> DataFrame:
    rows = apply_filter(events, QueryFilter()).withColumn("date", F.to_date("timestamp"))
    return rows.groupBy(*KEY).agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in SUMS], F.countDistinct("session_id").alias("sessions_count"))


def session_days(events: DataFrame) -> DataFrame:
    """Each session once for every day, provider, model and project: the sets behind sessions_count, which can't be added up over days."""
    rows = apply_filter(events, QueryFilter()).where(F.col("session_id").isNotNull())
    return rows.select(F.to_date("timestamp").alias("date"), *KEY[1:], "session_id").distinct()


def distinct_sessions(days: DataFrame, f: QueryFilter) -> DataFrame:
    """One row: the sessions of a period under a filter, counted over session days instead of events."""
    return apply_filter(days, f, day="date").agg(F.countDistinct("session_id").alias("sessions"))


def period(rollup: DataFrame, days: DataFrame, f: QueryFilter) -> DataFrame:
    """One row over the period: sums, sessions and what follows from them, as analytics.period gives them from events."""
    sums = apply_filter(rollup, f, day="date").agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in SUMS])
    row = sums.join(distinct_sessions(days, f))  # one row each
    ratio = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(0.0)
    reasoning = (F.col("reasoning_tokens") / F.greatest(F.col("input_tokens") + F.col("output_tokens"), F.lit(1)) * 100).alias("reasoning_pct")
    return row.select("*", ratio("total_tokens", "sessions").alias("tokens_per_session"), reasoning, ratio("input_tokens", "output_tokens").alias("input_output_ratio"))


def breakdown(rollup: DataFrame, days: DataFrame, f: QueryFilter, dimension: str) -> DataFrame:
    """key, sums and sessions by provider, model or project_id."""
    if dimension not in KEY[1:]:
        raise ValueError(f"the rollup has no dimension {dimension!r}")
    key = F.coalesce(F.col(dimension).cast("string"), F.lit("(none)")).alias("key")
    sums = apply_filter(rollup, f, day="date").groupBy(key).agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("input_tokens", "output_tokens", "total_tokens", "cost_usd")])
    sessions = apply_filter(days, f, day="date").groupBy(key).agg(F.countDistinct("session_id").alias("sessions"))
    return sums.join(sessions, "key", "left").withColumn("sessions", F.coalesce("sessions", F.lit(0)))


def touched_dates(events: DataFrame) -> DataFrame:
    return events.select(F.to_date("timestamp").alias("date")).distinct()


def refreshed(rollup: DataFrame, events: DataFrame, dates: DataFrame) -> DataFrame:
    """The rollup with the given dates made anew from events."""
    own = events.withColumn("date", F.to_date("timestamp")).join(dates, "date", "left_semi").drop("date")
    return rollup.join(dates, "date", "left_anti").unionByName(daily_rollup(own))


def answers(f: QueryFilter) -> bool:
    """Whether the rollup has every dimension that the filter names."""
    return f.source_id is None and f.exactness is None


def choose(f: QueryFilter, rollup: DataFrame, events: DataFrame) -> tuple[DataFrame, str | None]:
    """(table, its date column or None): the rollup where it can answer, else the events."""
    return (rollup, "date") if answers(f) else (events, None)
