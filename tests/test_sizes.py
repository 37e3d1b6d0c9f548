"""Plans whose work and memory keep in proportion to the input."""

from __future__ import annotations

from contextlib import contextmanager

import pytest
from conftest import DATA
from meterbook import ingest_queries, queries  # noqa: F401 - the first registers its queries
from meterbook.operators import analytics, pricing
from meterbook.operators.filters import QueryFilter
from pyspark.sql import functions as F


def _plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_plugin_counts_look_up_each_place_once(spark):
    plan = _plan(queries.QUERIES["plugin_counts"](spark, DATA))
    assert plan.count("get_json_object") <= 30
    assert "Join" not in plan


@contextmanager
def _sorted_joins(spark):
    """Eight parts, no broadcast, and no plan that is changed as it runs."""
    conf = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.enabled": "false", "spark.sql.shuffle.partitions": "8"}
    before = {k: spark.conf.get(k) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


def _largest_part(rows) -> int:
    return rows.groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0]


def test_rows_of_a_pair_are_dealt_where_they_meet_prices(spark):
    n = F.col("id")
    counts = [(n % k).alias(c) for k, c in ((97, "input_tokens"), (89, "output_tokens"), (7, "reasoning_tokens"), (83, "cache_read_tokens"), (5, "cache_write_tokens"))]
    events = spark.range(4000).select(n.alias("session_id"), F.timestamp_seconds(n).alias("timestamp"), F.lit("openai").alias("provider"), F.lit("gpt-5.5").alias("model"), *counts)
    prices = pricing.seed_prices(spark)
    with _sorted_joins(spark):
        rows = pricing.priced(events, prices)
        assert rows.count() == 4000
        assert _largest_part(rows) < 2000
        assert _largest_part(pricing.with_resolved(events, prices)) < 2000
        assert _largest_part(analytics.resolved_savings(events, QueryFilter(), prices)) < 2000
        sessions = events.withColumn("peak_context_tokens", F.col("input_tokens"))
        rows = analytics.session_utilization(sessions, prices)
        assert rows.where("context_limit = 400000").count() == 4000
        assert _largest_part(rows) < 2000


@pytest.mark.parametrize("name", ["context_sessions", "cache_by_day_all", "daily_aggregates", "breakdown_model_all"])
def test_groups_of_few_rows_are_dealt_before_they_are_combined(spark, name):
    plan = _plan(queries.QUERIES[name](spark, DATA))
    assert "RepartitionByExpression" in plan
    assert "Expand" not in plan
