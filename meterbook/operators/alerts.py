"""Budget alerts."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meterbook.operators.filters import QueryFilter, apply_filter

THRESHOLDS = (100, 80, 50)


def budget_alerts(events: DataFrame, as_of: dt.date, daily_tokens: int = 0, monthly_cost_usd: float = 0.0, existing: DataFrame | None = None) -> DataFrame:
    """type, threshold, severity, title, message, date of each budget threshold reached and not yet in existing for that day. A limit of 0 is no limit."""
    day = F.to_date("timestamp")
    used = apply_filter(events, QueryFilter()).where(F.col("timestamp") >= F.lit(as_of - dt.timedelta(days=30)).cast("timestamp_ntz")).agg(
        F.coalesce(F.sum(F.when(day == F.lit(as_of), F.col("total_tokens"))), F.lit(0)).alias("tokens"), F.coalesce(F.sum("cost_usd"), F.lit(0.0)).alias("cost")
    )
    percent = F.explode(F.array(*[F.lit(p) for p in THRESHOLDS]))
    tokens = used.select(F.lit("daily_tokens").alias("type"), F.col("tokens").cast("double").alias("used"), F.lit(float(daily_tokens)).alias("budget"), percent.alias("threshold"))
    cost = used.select(F.lit("monthly_cost").alias("type"), F.col("cost").alias("used"), F.lit(float(monthly_cost_usd)).alias("budget"), percent.alias("threshold"))
    reached = tokens.unionByName(cost).where((F.col("budget") > 0) & (F.col("used") >= F.col("budget") * F.col("threshold") / 100))
    daily = F.col("type") == "daily_tokens"
    alerts = reached.select(
        "type", "threshold", F.when(F.col("threshold") == 100, "critical").otherwise("warning").alias("severity"),
        F.concat(F.when(daily, "Daily tokens: ").otherwise("Monthly cost: "), F.col("threshold").cast("string"), F.lit("% of the budget")).alias("title"),
        F.when(daily, F.format_string("%.0f of %.0f tokens used today", "used", "budget")).otherwise(F.format_string("%.2f of %.2f USD used in 30 days", "used", "budget")).alias("message"),
        F.lit(as_of).alias("date"),
    )
    return alerts if existing is None else alerts.join(existing.select("type", "threshold", "date"), ["type", "threshold", "date"], "left_anti")


def acknowledged(alerts: DataFrame, type_: str, threshold: int, date: dt.date, at: dt.datetime) -> DataFrame:
    own = (F.col("type") == type_) & (F.col("threshold") == threshold) & (F.col("date") == F.lit(date))
    return alerts.withColumn("acknowledged_at", F.when(own, F.lit(at)).otherwise(F.col("acknowledged_at")))


def latest(alerts: DataFrame, limit: int = 50, open_only: bool = False) -> DataFrame:
    rows = alerts.where(F.col("acknowledged_at").isNull()) if open_only else alerts
    return rows.orderBy(F.desc("date"), F.desc("threshold"), "type").limit(limit)
