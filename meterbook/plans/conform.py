"""Views that make usage events out of the benchmark tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MODELS = ["gpt-5.5", "gpt-5.4", "o4-mini", "claude-opus-4.8", "claude-sonnet-4.6", "claude-haiku-4.5", "gemini-3.1-pro-preview", "gemini-3.5-flash", "composer-2.5"]
PROVIDERS = ["openai"] * 3 + ["anthropic"] * 3 + ["google"] * 2 + ["cursor"]


def pair_of(number: Column) -> tuple[Column, Column]:
    """(provider, model) by a number modulo 20: nine models, a local one, and one that has no price."""
    b = number % 10
    last = number % 20 == 9
    provider, model = F.when(b == 9, F.when(last, "local").otherwise("acme")), F.when(b == 9, F.when(last, "llama-3.1-8b").otherwise("nova-1"))
    for i, (p, m) in enumerate(zip(PROVIDERS, MODELS, strict=True)):
        provider, model = provider.when(b == i, p), model.when(b == i, m)
    return provider, model


def usage_from_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/events.parquet")
    provider, model = pair_of(F.col("event_id"))
    k = F.get_json_object("props", "$.k").cast("long")
    rows = rows.select("event_id", "ts", "user_id", "event_type", "value", k.alias("k"), provider.alias("provider"), model.alias("model"))
    exactness = F.when(F.col("provider") == "acme", "unknown").when(F.col("event_type").isin("purchase", "click"), "exact").when(F.col("event_type") == "view", "estimated").when(F.col("event_type") == "signup", "mixed").otherwise("unknown")
    input_ = F.floor(F.col("value") * 100) + F.col("k")
    return rows.select(
        F.concat(F.lit("e"), F.col("event_id").cast("string")).alias("event_hash"),
        F.col("ts").alias("timestamp"),
        (F.col("user_id") % 3).alias("source_id"),
        F.col("user_id").alias("session_id"),
        (F.col("user_id") % 7).alias("project_id"),
        "event_type",
        "provider",
        "model",
        F.when(F.col("event_id") % 2 == 0, "user").otherwise("assistant").alias("message_role"),
        input_.alias("input_tokens"),
        (F.col("k") * 50).alias("output_tokens"),
        (F.col("k") * 30).alias("reasoning_tokens"),
        F.floor(F.col("value") * 55).alias("cache_read_tokens"),
        (F.col("k") * 7).alias("cache_write_tokens"),
        (F.col("k") % 5).alias("tool_tokens"),
        (input_ + F.col("k") * 80).alias("total_tokens"),
        exactness.alias("exactness"),
        F.lit(False).alias("ignored"),
    )


def usage_from_lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    provider, model = pair_of(F.col("l_partkey"))
    rows = rows.select("*", provider.alias("provider"), model.alias("model"))
    exactness = F.when(F.col("provider") == "acme", "unknown").when(F.col("l_returnflag") == "A", "exact").when(F.col("l_returnflag") == "N", "estimated").otherwise("mixed")
    input_, output = F.floor("l_extendedprice"), (F.col("l_quantity") * 100).cast("long")
    return rows.select(
        F.concat_ws("-", F.lit("l"), F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string")).alias("event_hash"),
        F.col("l_shipdate").alias("timestamp"),
        (F.col("l_suppkey") % 7).alias("source_id"),
        F.col("l_orderkey").alias("session_id"),
        (F.col("l_partkey") % 5).alias("project_id"),
        F.lit("step.finish").alias("event_type"),
        "provider",
        "model",
        F.lit("assistant").alias("message_role"),
        input_.alias("input_tokens"),
        output.alias("output_tokens"),
        F.lit(0).cast("long").alias("reasoning_tokens"),
        F.floor(F.col("l_extendedprice") * F.col("l_discount")).alias("cache_read_tokens"),
        F.floor(F.col("l_extendedprice") * F.col("l_tax")).alias("cache_write_tokens"),
        F.col("l_linenumber").cast("long").alias("tool_tokens"),
        (input_ + output).alias("total_tokens"),
        exactness.alias("exactness"),
        F.lit(False).alias("ignored"),
    )


def sessions_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A session for each customer: those with a user in events have events, the others none."""
    rows = spark.read.parquet(f"{sf_dir}/customer.parquet")
    title = F.when(F.col("c_custkey") % 3 == 0, F.col("c_name"))
    return rows.select(F.col("c_custkey").alias("id"), F.concat(F.lit("s-"), F.col("c_custkey").cast("string")).alias("source_session_id"), (F.col("c_custkey") % 3).alias("source_id"), title.alias("title"))
