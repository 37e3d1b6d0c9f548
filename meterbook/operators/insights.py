"""Anomalies: rows that are at least twice the median of the seven rows before them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from meterbook.operators.analytics import daily_aggregates, session_aggregates, session_utilization
from meterbook.operators.filters import QueryFilter
from meterbook.operators.lineage import cut

PRECEDING = 7
LEAST_RATIO = 2.0
CHUNK_ROWS = 1 << 16
#: monotonically_increasing_id counts the rows of a partition in its lower bits.
_PLACE_BITS = 33


def numbered(rows: DataFrame, order: list[str]) -> DataFrame:
    """rows with place: their number in the order, from 0.

    Partitions are ranges of the whole order between sampled quantiles, so
    rows that share an hour, or any other part of the order, are split like
    others. A row's place is its place in its partition, after the sizes of the
    partitions before; the sorted rows are written once, so that both agree.
    """
    at = F.monotonically_increasing_id()  # the partition's number, and the place in its lower bits
    dealt = cut(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("at", at))
    part = F.expr(f"shiftright(at, {_PLACE_BITS})")
    sizes = dealt.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n"))
    # One row for each partition, so that one task is enough here.
    before = sizes.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))
    return dealt.withColumn("part", part).join(before, "part").withColumn("place", F.col("before") + F.expr(f"at & {(1 << _PLACE_BITS) - 1}L")).drop("part", "before", "at")


def with_baseline(rows: DataFrame, order: list[str], value: str, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """rows with baseline: the median of the PRECEDING rows before each one in the order; rows with fewer before them are left out.

    Rows are numbered, then cut into chunks that also hold the last rows of
    the chunk before, so that no task sorts everything.
    """
    placed = numbered(rows, order)
    chunk = F.expr(f"place DIV {chunk_rows}")
    carried = F.expr(f"place % {chunk_rows}") >= chunk_rows - PRECEDING
    chunks = placed.withColumn("chunk", F.explode(F.when(carried, F.array(chunk, chunk + 1)).otherwise(F.array(chunk))))
    frame = Window.partitionBy("chunk").orderBy("place").rowsBetween(-PRECEDING, -1)
    # Seven values at most: sorting them is cheaper than a percentile's map for each row.
    middle = lambda s: (F.element_at(s, F.expr("CAST((size(recent) + 1) DIV 2 AS INT)")) + F.element_at(s, F.expr("CAST(size(recent) DIV 2 + 1 AS INT)"))) / 2
    found = chunks.withColumn("recent", F.sort_array(F.collect_list(value).over(frame))).withColumn("seen", F.count(F.lit(1)).over(frame))
    found = found.withColumn("baseline", F.when(F.size("recent") > 0, middle(F.col("recent")))).drop("recent")
    return found.where((F.col("chunk") == chunk) & (F.col("seen") == PRECEDING)).drop("place", "chunk", "seen")


def _flagged(rows: DataFrame) -> DataFrame:
    rows = rows.where("baseline > 0").withColumn("ratio", F.col("total_tokens") / F.col("baseline"))
    return rows.where(F.col("ratio") >= LEAST_RATIO).withColumn("baseline_tokens", F.round("baseline").cast("long"))


def anomaly_sessions(events: DataFrame, f: QueryFilter, prices: DataFrame, sessions: DataFrame | None = None, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    found = _flagged(with_baseline(session_aggregates(events, f, sessions), ["last_seen_at", "session_id"], "total_tokens", chunk_rows))
    found = session_utilization(found, prices)
    reason = (
        F.when(F.col("model_switches") > 1, "model switching")
        .when(F.col("utilization_pct") >= 80, "context saturation")
        .when((F.col("cache_write_tokens") > F.col("cache_read_tokens")) & (F.col("cache_write_tokens") > 0), "cache rebuilds")
        .when(F.col("event_count") >= 10, "retry-heavy")
        .otherwise("volume spike")
    )
    return found.select(
        F.lit("session").alias("kind"), "label", "session_id", F.to_date("last_seen_at").alias("date"), "provider", "model", "total_tokens", "baseline_tokens", "ratio", "event_count", "model_switches",
        "peak_context_tokens", F.col("utilization_pct").alias("peak_context_pct"), "cache_read_tokens", "cache_write_tokens", "cost_usd", reason.alias("reason"),
    )


def anomaly_days(events: DataFrame, f: QueryFilter, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    found = _flagged(with_baseline(daily_aggregates(events, f), ["date"], "total_tokens", chunk_rows))
    reason = (
        F.when((F.col("cache_write_tokens") > F.col("cache_read_tokens")) & (F.col("cache_write_tokens") > 0), "cache churn")
        .when(F.col("session_count") >= 10, "session surge")
        .when(F.col("model_count") > 1, "model switching")
        .otherwise("volume spike")
    )
    none = lambda t: F.lit(None).cast(t)
    return found.select(
        F.lit("day").alias("kind"), F.col("date").cast("string").alias("label"), none("long").alias("session_id"), "date", none("string").alias("provider"), none("string").alias("model"), "total_tokens", "baseline_tokens", "ratio", "event_count",
        F.col("model_count").alias("model_switches"), F.lit(0).cast("long").alias("peak_context_tokens"), F.lit(0.0).alias("peak_context_pct"), "cache_read_tokens", "cache_write_tokens", "cost_usd", reason.alias("reason"),
    )


def highlights(events: DataFrame, f: QueryFilter, prices: DataFrame, sessions: DataFrame | None = None, limit: int = 12) -> DataFrame:
    """Sessions and days together, the greatest ratio first."""
    both = anomaly_sessions(events, f, prices, sessions).unionByName(anomaly_days(events, f))
    return both.orderBy(F.desc("ratio"), F.desc("total_tokens"), "kind", "label").limit(limit)
