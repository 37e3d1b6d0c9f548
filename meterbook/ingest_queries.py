"""Registered queries of ingestion: the benchmark tables as logs, exports, pages and price rows, each with a DuckDB statement of its own."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from meterbook.functions import dashboard, display, text
from meterbook.functions.hashing import event_hash
from meterbook.functions.normalize import detected_by_plugin, detected_provider, normalized, plugin_usage
from meterbook.operators import alerts, analytics, pricing, store
from meterbook.plans.conform import pair_of, sessions_of, usage_from_events
from meterbook.queries import _E, _EC, _LC, _PERIOD, _SESSIONS, _SUM, _SUMS, _UTILIZED, ALL, AS_OF, _COSTS, _query, events_of, items_of, rounded
from meterbook.sources import logs

NEVER = dt.datetime(1990, 1, 1)


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with the numbers from which the texts are made."""
    # Dealt out, as the texts cost far more than the rows, and a table of one row group is read by one task.
    provider, model = pair_of(F.col("event_id"))
    rows = spark.read.parquet(f"{sf_dir}/events.parquet").repartition("event_id").select("*", provider.alias("provider"), model.alias("model"))
    k = F.get_json_object("props", "$.k").cast("long")
    return rows.withColumn("ts", F.col("ts").cast("timestamp")).withColumn("k", k).withColumn("a", 100 + F.col("event_id") % 1000).withColumn("b", 1 + F.col("user_id") % 50)


_AB = "x AS (SELECT *, 100 + event_id % 1000 AS a, 1 + user_id % 50 AS b FROM e0)"
_DETECTED = """CASE WHEN regexp_matches(lower(model), '^(gpt-|o1|o3|o4)') THEN 'openai' WHEN starts_with(lower(model), 'claude-') THEN 'anthropic' WHEN regexp_matches(lower(model), '^(gemini-|palm-)') THEN 'google'
    WHEN contains(lower(model), 'lm-studio') OR starts_with(lower(model), 'local/') THEN 'lmstudio' ELSE 'unknown' END"""


@_query(f"""WITH {_E}, {_AB} SELECT 's' || event_id AS source_session_id, CASE WHEN event_id % 3 = 0 THEN provider ELSE {_DETECTED} END AS provider, model, event_type,
  date_trunc(CASE WHEN event_id % 3 = 1 THEN 'millisecond' ELSE 'second' END, ts) AS timestamp, a AS input_tokens, b AS output_tokens, CASE WHEN event_id % 3 = 0 THEN k ELSE 0 END AS reasoning_tokens, a + b AS total_tokens,
  CASE WHEN event_id % 3 = 2 THEN 'unknown' ELSE 'exact' END AS exactness, CASE WHEN event_id % 3 = 2 THEN 0.4e0 ELSE 0.95e0 END AS confidence FROM x""")
def ingest_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of three shapes, with the time as text, milliseconds and seconds, as canonical events."""
    a, b, type_ = F.col("a").alias("input_tokens"), F.col("b").alias("output_tokens"), F.col("event_type").alias("type")
    session = F.concat(F.lit("s"), F.col("event_id").cast("string"))
    reasoning = F.struct(F.col("k").alias("reasoning_tokens"))
    usage = F.struct(a, b, (F.col("a") + F.col("b")).alias("total_tokens"), reasoning.alias("completion_tokens_details"))
    plain = F.to_json(F.struct(type_, F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("timestamp"), session.alias("sessionID"), "model", "provider", usage.alias("usage")))
    flat = F.to_json(F.struct(type_, F.unix_millis("ts").cast("string").alias("ts"), session.alias("conversation_id"), "model", a, b))
    deep = F.struct(F.struct(F.col("a").alias("input"), F.col("b").alias("output"), (F.col("a") + F.col("b")).alias("total")).alias("tokens"))
    nested = F.to_json(F.struct(type_, F.unix_seconds("ts").alias("time"), session.alias("session_id"), F.col("model").alias("modelID"), deep.alias("info")))
    lines = _events(spark, sf_dir).select(F.when(F.col("event_id") % 3 == 0, plain).when(F.col("event_id") % 3 == 1, flat).otherwise(nested).alias("value"))
    rows = normalized(logs.json_lines(lines), F.lit(NEVER).cast("timestamp"))
    return rows.select("source_session_id", "provider", "model", "event_type", F.col("timestamp").cast("timestamp_ntz").alias("timestamp"), "input_tokens", "output_tokens", "reasoning_tokens", "total_tokens", "exactness", "confidence")


@_query(f"""WITH {_E}, {_AB}, k AS (SELECT *, event_id % 8 AS shape, 'awk-' || event_id AS name FROM x)
SELECT name AS model, CASE shape WHEN 0 THEN a WHEN 4 THEN a ELSE 0 END AS input_tokens, CASE WHEN shape IN (0, 3, 4) THEN b ELSE 0 END AS output_tokens, CASE shape WHEN 0 THEN a + b WHEN 3 THEN b WHEN 4 THEN a + b ELSE a END AS total_tokens,
  CASE WHEN shape IN (0, 3, 5) THEN 'exact' ELSE 'unknown' END AS exactness, CASE WHEN shape IN (0, 3, 5) THEN 0.95e0 ELSE 0.4e0 END AS confidence FROM k WHERE shape IN (0, 3, 4, 5, 7)
UNION ALL SELECT name || '-2', 0, 0, b, 'exact', 0.95e0 FROM k WHERE shape = 5""")
def ingest_awkward_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines with text or an object behind their own, broken off, with a number of 30 digits, with counts far down or in several places, and arrays."""
    name, a, b = F.concat(F.lit('"model":"awk-'), F.col("event_id").cast("string"), F.lit('"')), F.col("a").cast("string"), F.col("b").cast("string")
    line = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])
    plain = line("{", name, ',"usage":{"input_tokens":', a, ',"output_tokens":', b, "}}")
    shapes = [
        plain, line(plain, " trailing"), line(plain, '{"model":"other"}'), line("{", name, ',"input_tokens":123456789012345678901234567', a, ',"output_tokens":', b, "}"),
        line('{"p":{"q":{"r":{"input":', a, ',"output":', b, '}},"list":[{"input":77}]},', name, "}"), line(" [{", name, ',"total":', a, "},7,{", F.substring(name, F.lit(1), F.length(name) - 1), '-2","total":', b, "}]"),
        line("{", name, ',"input_tokens":', a), line('{"z":{"total":5},"m":{"total":0},', name, ',"n":{"k":{"total":', a, "}}}"),
    ]
    lines = _events(spark, sf_dir).select(F.element_at(F.array(*shapes), (F.col("event_id") % 8 + 1).cast("int")).alias("value"))
    rows = normalized(logs.json_lines(lines), F.lit(NEVER).cast("timestamp"))
    return rows.select("model", "input_tokens", "output_tokens", "total_tokens", "exactness", "confidence")


_LE = lambda n: f"unhex(array_to_string(list_reverse(regexp_extract_all(format('{{:016x}}', {n}), '..')), ''))"


@_query(f"""WITH {_E}, t AS (SELECT *, strftime(timestamp, '%Y-%m-%dT%H:%M:%S') || CASE WHEN epoch_us(timestamp) % 1000000 = 0 THEN '' WHEN epoch_us(timestamp) % 1000 = 0 THEN '.' || lpad(CAST(epoch_us(timestamp) % 1000000 // 1000 AS VARCHAR), 3, '0')
    ELSE '.' || lpad(CAST(epoch_us(timestamp) % 1000000 AS VARCHAR), 6, '0') END || '+00:00' AS said FROM e)
SELECT event_hash AS id, sha256(encode(said || '|' || provider || '|' || model || '|' || session_id || '|' || event_type || '|') || {_LE('total_tokens')} || encode('|') || {_LE('input_tokens')} || encode('|') || {_LE('output_tokens')}) AS event_hash FROM t""")
def event_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns = [F.col(c) for c in ("timestamp", "provider", "model", "session_id", "event_type", "total_tokens", "input_tokens", "output_tokens")]
    columns[3] = columns[3].cast("string")
    return usage_from_events(spark, sf_dir).select(F.col("event_hash").alias("id"), event_hash(*columns).alias("event_hash"))


_NAMES = ["gpt-", "o1-", "o3", "O4-", "claude-", "gemini-", "palm-", "local/", "my-lm-studio-", "llama-", "GPT-", "x-", "phi-"]


@_query("WITH p AS (SELECT p_partkey, (" + repr(_NAMES).replace('"', "'") + f")[CAST(p_partkey % 13 AS INTEGER) + 1] || p_partkey AS model FROM part) SELECT p_partkey, model, {_DETECTED} AS provider, CASE WHEN p_partkey % 13 IN (9, 12) THEN 'local' ELSE {_DETECTED} END AS plugin_provider FROM p")
def provider_ladder(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.element_at(F.array(*[F.lit(n) for n in _NAMES]), (F.col("p_partkey") % 13 + 1).cast("int"))
    rows = spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", F.concat(name, F.col("p_partkey").cast("string")).alias("model"))
    return rows.select("p_partkey", "model", detected_provider(F.col("model")).alias("provider"), detected_by_plugin(F.col("model")).alias("plugin_provider"))


@_query(f"""WITH {_E}, {_AB} SELECT event_id, CAST(CASE event_id % 4 WHEN 3 THEN NULL ELSE a END AS BIGINT) AS input, CAST(CASE event_id % 4 WHEN 3 THEN NULL ELSE b END AS BIGINT) AS output, CAST(CASE event_id % 4 WHEN 0 THEN a + b WHEN 1 THEN k WHEN 2 THEN a + b END AS BIGINT) AS total,
  CAST(CASE event_id % 4 WHEN 0 THEN k WHEN 3 THEN NULL ELSE 0 END AS BIGINT) AS reasoning, CAST(CASE event_id % 4 WHEN 1 THEN 5 WHEN 3 THEN NULL ELSE 0 END AS BIGINT) AS cache_read, CAST(CASE event_id % 4 WHEN 2 THEN 9 WHEN 3 THEN NULL ELSE 0 END AS BIGINT) AS cache_write FROM x""")
def plugin_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Payloads with usage, tokens (as texts), info.tokens, or nothing, as a producer's plugin reads them."""
    n = F.col("event_id") % 4
    usage = F.to_json(F.struct(F.struct(F.col("a").alias("prompt_tokens"), F.col("b").alias("completion_tokens"), F.struct(F.col("k").alias("reasoning_tokens")).alias("output_tokens_details")).alias("usage")))
    tokens = F.to_json(F.struct(F.struct(F.concat(F.col("a").cast("string"), F.lit(".9")).alias("input"), F.col("b").alias("output"), F.col("k").alias("total"), F.struct(F.lit(5).alias("cached_tokens")).alias("prompt_tokens_details")).alias("tokens")))
    info = F.to_json(F.struct(F.struct(F.struct(F.col("a").alias("input_tokens"), F.col("b").alias("outputTokens"), F.lit("9").alias("cacheWriteTokens"), F.lit("none").alias("cache_read_tokens")).alias("tokens")).alias("info")))
    found = plugin_usage(F.when(n == 0, usage).when(n == 1, tokens).when(n == 2, info).otherwise(F.lit('{"type": "text"}')))
    return _events(spark, sf_dir).select("event_id", found.alias("u")).select("event_id", "u.input", "u.output", "u.total", "u.reasoning", "u.cache_read", "u.cache_write")


def _entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dashboard entries: bills for a seventh, usage for four fifths, the vendor's own cost for a third of these."""
    n = F.col("event_id")
    kind = F.element_at(F.array(*[F.lit(x) for x in ("Included in Pro", "Usage-based", "free", "Errored")]), (n % 4 + 1).cast("int"))
    usage = F.struct(F.col("a").alias("inputTokens"), F.col("b").cast("string").alias("outputTokens"), F.col("k").alias("cacheReadTokens"), F.when(n % 3 == 0, F.col("k") + 0.5).alias("totalCents"))
    entry = F.struct(
        F.unix_millis("ts").cast("string").alias("timestamp"), F.when(n % 2 == 0, "composer-2.5").otherwise("zzz-1").alias("model"), kind.alias("kind"), F.concat(F.lit("u"), n.cast("string")).alias("owningUser"), F.lit("hidden").alias("token"),
        F.when(n % 5 != 0, usage).alias("tokenUsage"), F.when(n % 7 == 0, F.col("a") + 0.25).alias("chargedCents"),
    )
    return _events(spark, sf_dir).select(F.to_json(entry).alias("value"))


_API = f"""WITH {_E}, {_AB}, y AS (SELECT event_id, ts, event_id % 5 <> 0 AS counted, CASE WHEN event_id % 5 <> 0 THEN a ELSE 0 END AS i, CASE WHEN event_id % 5 <> 0 THEN b ELSE 0 END AS o, CASE WHEN event_id % 5 <> 0 THEN k ELSE 0 END AS c, CASE WHEN event_id % 7 = 0 THEN a + 0.25e0 END AS bill,
  CASE WHEN event_id % 5 <> 0 AND event_id % 3 = 0 THEN k + 0.5e0 END AS own, event_id % 4 IN (0, 2) AS free, event_id % 2 = 0 AS priced FROM x)
SELECT 'u' || event_id AS source_session_id, ['included', 'usage_based', 'included', 'errored'][CAST(event_id % 4 AS INTEGER) + 1] AS event_type, CAST(i + o + c AS BIGINT) AS total_tokens,
  round(CASE WHEN bill > 0 THEN bill / 100 WHEN own IS NOT NULL THEN own / 100 WHEN priced THEN (greatest(i - c, 0) * 0.5e0 + o * 2.5e0 + c * 0.05e0) / 1e6 ELSE 0 END, 9) AS cost_usd,
  CASE WHEN bill > 0 THEN 'exact' WHEN own IS NOT NULL THEN CASE WHEN free THEN 'mixed' ELSE 'exact' END WHEN free THEN CASE WHEN counted THEN 'mixed' ELSE 'estimated' END WHEN priced THEN 'exact' ELSE 'unknown' END AS exactness FROM y"""
_BILLED = ["source_session_id", "event_type", "total_tokens", "cost_usd", "exactness"]


@_query(_API)
def dashboard_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(dashboard.from_api(_entries(spark, sf_dir), pricing.seed_prices(spark)).select(*_BILLED))


@_query(_API)
def dashboard_recosted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored events whose costs were lost get them back from their payloads."""
    prices = pricing.seed_prices(spark)
    lost = dashboard.from_api(_entries(spark, sf_dir), prices).withColumn("cost_usd", F.lit(-1.0)).withColumn("exactness", F.lit("unknown"))
    return rounded(dashboard.recosted(lost, prices).select(*_BILLED))


@_query(f"""WITH {_E}, {_AB} SELECT 'agent' || event_id AS source_session_id, CASE event_id % 3 WHEN 0 THEN 'included' WHEN 1 THEN 'usage_based' ELSE 'on demand' END AS event_type, CAST(CASE WHEN event_id % 4 = 0 THEN a + b + k + 3 ELSE a + 7 END AS BIGINT) AS total_tokens,
  round(CASE WHEN event_id % 3 = 1 AND k > 0 THEN k / 4e0 ELSE (greatest(a - k, 0) * 0.5e0 + b * 2.5e0 + k * 0.05e0 + 3 * 0.625e0) / 1e6 END, 9) AS cost_usd, CASE WHEN event_id % 3 = 0 THEN 'mixed' ELSE 'exact' END AS exactness FROM x""")
def dashboard_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of a CSV export, with dates as text and as milliseconds, and costs with a dollar sign or in words."""
    n, said = F.col("event_id"), lambda c: F.col(c).cast("string")
    rows = _events(spark, sf_dir).select(
        F.when(n % 2 == 0, F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")).otherwise(F.unix_millis("ts").cast("string")).alias("Date"), F.concat(F.lit("agent"), n.cast("string")).alias("Cloud Agent ID"), F.element_at(F.array(F.lit("Included in Pro"), F.lit("Usage-based"), F.lit("On demand")), (n % 3 + 1).cast("int")).alias("Kind"),
        F.lit("composer-2.5").alias("Model"), said("a").alias("Input (w/o Cache Write)"), F.lit(" 3 ").alias("Input (w/ Cache Write)"), said("b").alias("Output Tokens"), said("k").alias("Cache Read"), F.when(n % 4 == 0, F.lit("")).otherwise((F.col("a") + 7).cast("string")).alias("Total Tokens"),
        F.when(n % 3 == 1, F.format_string("$%.2f", F.col("k") / 4)).when(n % 3 == 0, "Included").otherwise("-").alias("Cost"),
    )
    return rounded(dashboard.from_csv(rows, pricing.seed_prices(spark)).select(*_BILLED))


@_query(f"""WITH {_E}, {_AB}, u AS (SELECT user_id, min(ts) AS began FROM events GROUP BY user_id) SELECT 's' || user_id AS source_session_id, date_trunc('millisecond', began) AS timestamp, CASE WHEN event_id % 2 = 0 THEN model ELSE 'claude-sonnet-4.6' END AS model,
  CASE WHEN user_id % 2 = 0 THEN 'vendor' ELSE CASE WHEN event_id % 2 = 0 THEN {_DETECTED} ELSE 'anthropic' END END AS provider, 'assistant' AS message_role, a AS input_tokens, b AS output_tokens, k AS reasoning_tokens, 4 AS cache_read_tokens, CAST(greatest(a + b + k, 300) AS BIGINT) AS total_tokens
  FROM x JOIN u USING (user_id) WHERE event_type IN ('purchase', 'click')""")
def exported_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An exported database of parts, messages and sessions."""
    rows = _events(spark, sf_dir)
    step = F.when(F.col("event_type").isin("purchase", "click"), F.when(F.col("event_id") % 2 == 0, "step-finish").otherwise("step.finish")).otherwise("text")
    tokens = F.struct(F.col("a").alias("input"), F.col("b").alias("output"), F.col("k").alias("reasoning"), F.lit(300).alias("total"), F.struct(F.lit(4).alias("read")).alias("cache"))
    user = F.col("user_id").cast("string")
    parts = rows.select(F.col("event_id").cast("string").alias("id"), F.concat(F.lit("s"), user).alias("session_id"), F.concat(F.lit("m"), user).alias("message_id"), F.to_json(F.struct(step.alias("type"), tokens.alias("tokens"), F.when(F.col("event_id") % 2 == 0, F.col("model")).alias("modelID"))).alias("data"))
    users = rows.groupBy("user_id").agg(F.min("ts").alias("at"))
    said = F.to_json(F.struct(F.lit("assistant").alias("role"), F.lit("claude-sonnet-4.6").alias("modelID"), F.when(F.col("user_id") % 2 == 0, "vendor").alias("providerID")))
    tables = {"part": parts, "message": users.select(F.concat(F.lit("m"), user).alias("id"), F.unix_millis("at").alias("time_created"), said.alias("data")), "session": users.select(F.concat(F.lit("s"), user).alias("id"), F.lit(5).cast("long").alias("time_created"))}
    found = logs.exported_events(tables, F.lit(NEVER).cast("timestamp"))
    return found.select("source_session_id", F.col("timestamp").cast("timestamp_ntz").alias("timestamp"), "model", "provider", "message_role", "input_tokens", "output_tokens", "reasoning_tokens", "cache_read_tokens", "total_tokens")


@_query("""WITH m AS (SELECT *, CASE WHEN role = 'user' THEN length(text) END AS p, CASE WHEN role <> 'user' THEN length(text) END AS c FROM conversations)
SELECT CAST(conv_id AS VARCHAR) AS source_session_id, role AS message_role, CASE WHEN turn % 2 = 0 THEN 'gpt-4' ELSE 'unknown' END AS model, CASE WHEN turn % 2 = 0 THEN 'openai' ELSE 'unknown' END AS provider, CAST(make_timestamp((1704067200 + turn) * 1000000) AS TIMESTAMP) AS timestamp,
  coalesce(p, 0) AS input_tokens, coalesce(c, 0) AS output_tokens, coalesce(p, 0) + coalesce(c, 0) AS total_tokens FROM m WHERE coalesce(p, 0) + coalesce(c, 0) > 0""")
def exported_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.length("text").cast("long")
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select(F.col("turn").alias("id"), F.col("conv_id").alias("session_id"), "role", F.when(F.col("turn") % 2 == 0, "gpt-4").alias("model"), F.when(F.col("role") == "user", n).alias("prompt_tokens"), F.when(F.col("role") != "user", n).alias("completion_tokens"), (1704067200 + F.col("turn")).alias("created_at"))
    found = logs.exported_events({"messages": rows}, F.lit(NEVER).cast("timestamp"))
    return found.select("source_session_id", "message_role", "model", "provider", F.col("timestamp").cast("timestamp_ntz").alias("timestamp"), "input_tokens", "output_tokens", "total_tokens")


@_query(f"""WITH {_E}, n AS (SELECT 's-' || session_id AS name, source_id, arg_min(provider, (timestamp, event_hash)) AS provider, arg_min(model, (timestamp, event_hash)) AS model, min(timestamp) AS lo, max(timestamp) AS hi FROM e GROUP BY ALL),
o AS (SELECT 's-' || c_custkey AS name, c_custkey % 3 AS source_id, 'old' AS provider, 'old-1' AS model, TIMESTAMP '2024-01-15' AS lo, TIMESTAMP '2024-01-16' AS hi FROM customer WHERE c_custkey % 2 = 0)
SELECT coalesce(o.name, n.name) AS source_session_id, coalesce(o.source_id, n.source_id) AS source_id, coalesce(o.provider, n.provider) AS provider, coalesce(o.model, n.model) AS model, least(o.lo, n.lo) AS started_at, greatest(o.hi, n.hi) AS last_seen_at FROM o FULL JOIN n ON o.name = n.name AND o.source_id = n.source_id""")
def session_upserts(spark: SparkSession, sf_dir: str) -> DataFrame:
    old = sessions_of(spark, sf_dir).where("id % 2 = 0").select("id", "source_session_id", "source_id", F.lit("old").alias("provider"), F.lit("old-1").alias("model"), "title", F.lit(dt.datetime(2024, 1, 15)).cast("timestamp_ntz").alias("started_at"), F.lit(dt.datetime(2024, 1, 16)).cast("timestamp_ntz").alias("last_seen_at"))
    events = usage_from_events(spark, sf_dir).withColumn("source_session_id", F.concat(F.lit("s-"), F.col("session_id").cast("string"))).withColumn("timestamp", F.col("timestamp").cast("timestamp_ntz"))
    return store.upserted_sessions(old, events).select("source_session_id", "source_id", "provider", "model", "started_at", "last_seen_at")


@_query("SELECT conv_id, turn, CASE WHEN turn % 2 = 0 AND length(text) > 0 THEN (length(text) + 3) // 4 ELSE 7 END AS input_tokens, CASE WHEN turn % 2 <> 0 THEN 'exact' WHEN length(text) > 0 THEN 'estimated' ELSE 'unknown' END AS exactness FROM conversations")
def reestimated_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of turns of unknown exactness, from the texts inside their JSON."""
    message = F.array(F.struct("role", F.col("text").alias("content")))
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").withColumn("raw_json", F.to_json(F.struct(message.alias("messages"), F.lit("no text").alias("model"))))
    rows = rows.withColumn("exactness", F.when(F.col("turn") % 2 == 0, "unknown").otherwise("exact"))
    for c in ("input_tokens", "total_tokens"):
        rows = rows.withColumn(c, F.lit(7).cast("long"))
    return text.reestimated(rows.withColumn("confidence", F.lit(0.0))).select("conv_id", "turn", "input_tokens", "exactness")


@_query(_EC + "SELECT event_hash, CAST(CAST(CAST(cost AS VARCHAR) AS DECIMAL(38, 6)) AS VARCHAR) AS cost_usd, CAST(input_tokens AS VARCHAR) AS input_tokens, exactness FROM c")
def exported_csv_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.csv_rows(events_of(spark, sf_dir)).select("event_hash", "cost_usd", "input_tokens", "exactness")


@_query(_EC + """, t AS (SELECT coalesce(sum(total_tokens) FILTER (WHERE day = DATE '2024-01-30'), 0) AS tokens, coalesce(sum(cost) FILTER (WHERE day >= DATE '2023-12-31'), 0) AS cost FROM c),
r AS (SELECT 'daily_tokens' AS type, pct, tokens / 100000 AS part FROM t, (VALUES (100), (80), (50)) v(pct) UNION ALL SELECT 'monthly_cost', pct, cost / 20 FROM t, (VALUES (100), (80), (50)) v(pct))
SELECT type, pct AS threshold, CASE WHEN pct = 100 THEN 'critical' ELSE 'warning' END AS severity FROM r WHERE part >= pct / 100 AND NOT (type = 'daily_tokens' AND pct = 50) AND NOT (type = 'monthly_cost' AND pct IN (50, 80))""")
def alerts_not_raised_yet(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Budgets of which three alerts exist for the day, and one for the day before, which doesn't count."""
    known = spark.createDataFrame([("daily_tokens", 50, AS_OF), ("monthly_cost", 50, AS_OF), ("monthly_cost", 80, AS_OF), ("daily_tokens", 80, AS_OF - dt.timedelta(days=1))], "type string, threshold int, date date")
    return alerts.budget_alerts(events_of(spark, sf_dir), AS_OF, 100_000, 20.0, known).select("type", "threshold", "severity")


# What pairs resolve to, by hand: rank and input price. The star stands for any ending.
_LADDER = [
    ("openai", "gpt-5.5", 1, 5.0), ("local", "mine-*", 2, 0.0), ("lmstudio", "mine-*", 9, 0.0), ("cursor", "zen-free", 3, 0.0), ("cursor", "composer-2.5-fast-*", 4, 3.0), ("together", "composer-2-*", 4, 1.5), ("cursor", "default", 4, 1.25),
    ("nvidia", "claude-sonnet-4*", 5, 3.0), ("github-copilot", "vendor/claude-haiku-*", 5, 1.0), ("fireworks", "o4-mini", 6, 1.1), ("together", "other-model", 7, 8.0), ("deepinfra", "other-model-large*", 8, 8.0), ("openai", "gpt-5.4-nano-*", 10, 2.5), ("google", "palm-*", 11, 1.75),
    ("acme", "unheard-of-*", 11, 8.0), ("nobody", "unheard-of-*", None, None),
]


def _ladder_sql() -> str:
    rows = ", ".join(f"({i}, '{p}', '{m}', {r if r else 'NULL'}, {price if r else 'NULL'})" for i, (p, m, r, price) in enumerate(_LADDER))
    return f"""SELECT DISTINCT provider, replace(model, '*', CAST(p_partkey AS VARCHAR)) AS model, CAST(rank AS INTEGER) AS rank, CAST(price AS DOUBLE) AS input_price_per_million
FROM part JOIN (VALUES {rows}) v(i, provider, model, rank, price) ON p_partkey % {len(_LADDER)} = i WHERE rank IS NOT NULL"""


@_query(_ladder_sql())
def price_ladder(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as models that take each step by which a pair finds its price, some under names of their own."""
    prices = pricing.seed_prices(spark).unionByName(pricing.seed_prices(spark).where("model = 'gpt-5.5'").withColumn("provider", F.lit("acme")).withColumn("model", F.lit("other-model")).withColumn("input_price_per_million", F.lit(8.0)))
    step = (F.col("p_partkey") % len(_LADDER) + 1).cast("int")
    provider, model = (F.element_at(F.array(*[F.lit(r[i]) for r in _LADDER]), step) for i in (0, 1))
    pairs = spark.read.parquet(f"{sf_dir}/part.parquet").select(provider.alias("provider"), F.replace(model, F.lit("*"), F.col("p_partkey").cast("string")).alias("model"))
    rows = pricing.resolve_pairs(pairs, prices, estimate=True)
    return rows.select("provider", "model", F.col("rank").cast("int").alias("rank"), "input_price_per_million")


def _nation_prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A vendor's price table: a model for each nation, one in four of them local."""
    n = F.col("n_nationkey")
    rows = spark.read.parquet(f"{sf_dir}/nation.parquet").select(F.concat(F.lit("vendor-"), F.col("n_regionkey").cast("string")).alias("provider"), F.concat(F.lit("nation-"), n.cast("string")).alias("model"), *[((n + i + 1) / 4).alias(r) for i, r in enumerate(pricing.RATES)], (n % 4 == 0).alias("is_local"))
    return pricing.seed_prices(spark).limit(0).unionByName(rows, allowMissingColumns=True)


@_query("""WITH w AS (SELECT DISTINCT CASE WHEN s_suppkey % 2 = 0 THEN 'together' ELSE 'vendor-' || s_suppkey % 5 END AS provider, CASE s_suppkey % 4 WHEN 3 THEN 'hosts/' ELSE '' END || 'Nation-' || s_nationkey || CASE s_suppkey % 3 WHEN 0 THEN '' WHEN 1 THEN '-large' ELSE '5-Preview' END AS model FROM supplier),
m AS (SELECT *, regexp_replace(regexp_extract(lower(model), '[^/]*$'), '-preview$', '') AS plain FROM w),
n AS (SELECT 'nation-' || n_nationkey AS name, 'vendor-' || n_regionkey AS vendor, (n_nationkey + 1) / 4.0e0 AS price FROM nation),
f AS (SELECT m.provider, m.model, n.price, CASE WHEN m.plain = n.name THEN 7 ELSE 8 END AS rank, row_number() OVER (PARTITION BY m.provider, m.model ORDER BY CASE WHEN m.plain = n.name THEN 7 ELSE 8 END, length(n.name) DESC, n.vendor) AS best FROM m JOIN n ON starts_with(m.plain, n.name) WHERE m.provider = 'together')
SELECT provider, model, CAST(rank AS INTEGER) AS rank, price AS input_price_per_million FROM f WHERE best = 1""")
def price_prefixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Resellers' models by the name of a vendor's model or its longest beginning; a vendor's own names must be exact, in the same case."""
    n = F.col("s_suppkey")
    tail = F.when(n % 3 == 0, "").when(n % 3 == 1, "-large").otherwise("5-Preview")
    model = F.concat(F.when(n % 4 == 3, "hosts/").otherwise(""), F.lit("Nation-"), F.col("s_nationkey").cast("string"), tail)
    pairs = spark.read.parquet(f"{sf_dir}/supplier.parquet").select(F.when(n % 2 == 0, "together").otherwise(F.concat(F.lit("vendor-"), (n % 5).cast("string"))).alias("provider"), model.alias("model"))
    found = pricing.resolve_pairs(pairs, _nation_prices(spark, sf_dir))
    return found.select("provider", "model", F.col("rank").cast("int").alias("rank"), "input_price_per_million")


@_query("""SELECT 'vendor-' || n_regionkey AS provider, round(avg(CASE WHEN n_nationkey % 4 <> 0 THEN (n_nationkey + 1) / 4.0e0 END), 9) AS input_price_per_million, round(avg(CASE WHEN n_nationkey % 4 <> 0 THEN (n_nationkey + 2) / 4.0e0 END), 9) AS output_price_per_million
FROM nation GROUP BY n_regionkey HAVING count(*) FILTER (WHERE n_nationkey % 4 <> 0) > 0""")
def price_averages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a vendor's unknown models are estimated at: the average of its models that aren't local."""
    return rounded(pricing.average_prices(_nation_prices(spark, sf_dir)).select("provider", "input_price_per_million", "output_price_per_million"))


@_query("""WITH p AS (SELECT n_regionkey AS r, 'nation-' || n_nationkey || '-zz' || p_partkey AS model FROM part JOIN nation ON n_nationkey = p_partkey % 25),
q AS (SELECT n_regionkey AS r, 'nation-' || n_nationkey AS name, (n_nationkey + 1) / 4.0e0 AS price FROM nation WHERE n_nationkey % 4 <> 0),
o AS (SELECT p.model, max_by(price, length(name)) AS price FROM p JOIN q ON p.r = q.r AND starts_with(p.model, name) GROUP BY p.model),
v AS (SELECT r, avg(price) AS price FROM q GROUP BY r)
SELECT 'vendor-' || p.r AS provider, p.model, CASE WHEN o.model IS NULL THEN 11 ELSE 10 END AS rank, round(coalesce(o.price, v.price), 9) AS input_price_per_million FROM p JOIN v ON p.r = v.r LEFT JOIN o ON p.model = o.model""")
def price_estimates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unknown models: a vendor's closest name that isn't local (rank 10), or else its average (11)."""
    nations = spark.read.parquet(f"{sf_dir}/nation.parquet").select("n_nationkey", "n_regionkey")
    rows = spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", (F.col("p_partkey") % 25).alias("n_nationkey")).join(nations, "n_nationkey")
    pairs = rows.select(F.concat(F.lit("vendor-"), F.col("n_regionkey").cast("string")).alias("provider"), F.concat(F.lit("nation-"), F.col("n_nationkey").cast("string"), F.lit("-zz"), F.col("p_partkey").cast("string")).alias("model"))
    found = pricing.resolve_pairs(pairs, pricing.seed_prices(spark).unionByName(_nation_prices(spark, sf_dir)), estimate=True)
    return rounded(found.select("provider", "model", F.col("rank").cast("int").alias("rank"), "input_price_per_million"))


@_query("SELECT o_orderkey, CASE WHEN o_totalprice > 0 AND o_totalprice < 0.01 THEN '<$0.01' ELSE '$' || format('{:.2f}', o_totalprice) END AS usd, CASE o_orderstatus WHEN 'F' THEN 'Exact' WHEN 'O' THEN 'Mixed' ELSE 'Unknown' END AS label, strftime(o_orderdate, '%m-%d') AS day FROM orders")
def order_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    exactness = F.when(F.col("o_orderstatus") == "F", "exact").when(F.col("o_orderstatus") == "O", "mixed").otherwise("odd")
    return spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", display.usd_label(F.col("o_totalprice")).alias("usd"), display.exactness_label(exactness).alias("label"), display.day_label(F.col("o_orderdate")).alias("day"))


@_query(_EC + f""", {_SESSIONS}, {_UTILIZED}, r AS (SELECT round(sum(cache_read_tokens * greatest(0, coalesce(CAST(pi AS DOUBLE) - pc, 0)) / 1e6), 9) AS cache_savings_usd, {_SUM('cache_read_tokens')}, {_SUM('cache_write_tokens')} FROM c)
SELECT *, (SELECT count(*) FROM u WHERE context_limit > 0 AND pct >= 80) AS sessions_over_80 FROM r""")
def report_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(analytics.report_totals(events_of(spark, sf_dir), ALL, pricing.seed_prices(spark)))


@_query("""WITH f AS (SELECT 'logs/' || o_orderkey || '.' || ['jsonl', 'JSON', 'Log', 'csv'][CAST(o_orderkey % 4 AS INTEGER) + 1] AS path, o_orderdate AS modified, o_orderkey * 10 + 10 AS length, o_orderkey % 5 AS k, o_orderkey % 4 IN (0, 2) AS lines FROM orders)
SELECT path, CAST(CASE WHEN k = 2 AND lines THEN length - 5 ELSE 0 END AS BIGINT) AS start FROM f WHERE k <> 1 AND length <= 1000000""")
def changed_log_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files that are unknown, unchanged, grown, shrunk or rewritten since the ledger, and the byte to read them from."""
    k, ext = F.col("o_orderkey") % 5, F.element_at(F.array(*[F.lit(x) for x in ("jsonl", "JSON", "Log", "csv")]), (F.col("o_orderkey") % 4 + 1).cast("int"))
    rows = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.concat(F.lit("logs/"), F.col("o_orderkey").cast("string"), F.lit("."), ext).alias("path"), F.col("o_orderdate").alias("modified"), (F.col("o_orderkey") * 10 + 10).alias("length"), k.alias("k"))
    offset = F.when(F.col("k") == 1, F.col("length")).when(F.col("k") == 2, F.col("length") - 5).when(F.col("k") == 3, F.col("length") + 9).otherwise(F.col("length"))
    ledger = rows.where("k > 0").select("path", F.when(F.col("k") == 1, F.col("modified")).otherwise(F.lit(NEVER).cast(rows.schema["modified"].dataType)).alias("modified"), offset.alias("offset"))
    return logs.changed_files(rows.drop("k"), ledger, 1_000_000).select("path", "start")


@_query("""SELECT s_suppkey AS id, CASE WHEN s_suppkey % 3 = 0 THEN 'new' ELSE 'old' END AS state, CASE WHEN s_suppkey % 2 = 0 THEN NULL ELSE 'kind' END AS kind FROM supplier UNION ALL SELECT -1, 'new', NULL""")
def source_upserts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources by number and kind, where null kinds are equal."""
    rows = spark.read.parquet(f"{sf_dir}/supplier.parquet").select(F.col("s_suppkey").alias("id"), F.lit("old").alias("state"), F.when(F.col("s_suppkey") % 2 != 0, "kind").alias("kind"))
    fresh = rows.where("id % 3 = 0").withColumn("state", F.lit("new")).unionByName(spark.createDataFrame([(-1, "new", None)], rows.schema))
    return store.latest_by(rows, fresh, ["id", "kind"])


@_query(_EC + "SELECT day AS date, count(*) AS events FROM c WHERE day >= DATE '2024-01-23' AND source_id <> 2 GROUP BY day")
def retained_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left after a week's retention and the removal of a source."""
    kept = store.without_sources(store.retained(events_of(spark, sf_dir), AS_OF, 7), spark.createDataFrame([(2,)], "id long"))
    return kept.groupBy(F.to_date("timestamp").alias("date")).agg(F.count(F.lit(1)).alias("events"))


@_query("SELECT count(*) AS received, count(*) FILTER (WHERE p_partkey % 3 = 1) AS inserted, count(*) FILTER (WHERE p_partkey % 3 = 0) AS updated, count(*) FILTER (WHERE p_partkey % 3 = 2) AS skipped FROM part")
def price_import_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Price rows in JSON, trimmed and counted against the table."""
    n = F.col("p_partkey") % 3
    rows = spark.read.parquet(f"{sf_dir}/part.parquet").select(F.when(n == 0, " openai ").when(n == 1, "acme").otherwise(" ").alias("provider"), F.when(n == 0, "gpt-5.5").otherwise(F.col("p_name")).alias("model"))
    return pricing.bulk_summary(pricing.seed_prices(spark), rows.withColumn("provider", F.trim("provider")))


@_query("SELECT n_nationkey AS entry FROM nation WHERE n_nationkey // 4 < 5")
def paged_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Saved pages of four entries without a total: the fifth is full, and one that comes after a short page isn't taken."""
    page = F.expr("n_nationkey DIV 4").cast("int")
    rows = spark.read.parquet(f"{sf_dir}/nation.parquet").where((page != 5) | (F.col("n_nationkey") % 4 > 3))
    pages = rows.groupBy((page + 1).alias("page")).agg(F.to_json(F.struct(F.collect_list(F.struct(F.col("n_nationkey").alias("n"))).alias("usageEventsDisplay"))).alias("value"))
    pages = pages.unionByName(spark.createDataFrame([(6, '{"usageEventsDisplay": []}')], "page int, value string"))
    return dashboard.page_entries(pages, 4).select(F.get_json_object("value", "$.n").cast("int").alias("entry"))


@_query("""WITH o AS (SELECT DISTINCT datediff('day', CAST(o_orderdate AS DATE), DATE '2030-01-01') AS day FROM orders),
d AS (SELECT day, s, m, ['openai', 'anthropic', 'google', 'openai'][(day + s) % 4 + 1] AS provider FROM o, range(8) b(s), range(15) c(m) WHERE s < 3 + day % 6 AND m < 5 + s % 11)
SELECT CAST(TIMESTAMP '2030-01-01 12:00:00' - to_days(CAST(day AS INTEGER)) AS DATE) AS date, provider, count(*) AS events, CAST(sum(15000 + (m * 1847 + day * 813 + s * 297) % 180000) AS BIGINT) AS input_tokens, CAST(sum(8000 + (m * 1223 + day * 497 + s * 271) % 95000) AS BIGINT) AS output_tokens FROM d GROUP BY ALL""")
def sample_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sample events for each day on which something was ordered. Those of a day lie within 30 hours before noon; they are counted by the day that they were made for."""
    day = F.datediff(F.lit(dt.date(2030, 1, 1)), F.to_date("o_orderdate")).cast("long")
    days = spark.read.parquet(f"{sf_dir}/orders.parquet").select(day.alias("day")).distinct()
    made_for = F.date_sub(F.lit(dt.date(2030, 1, 1)), F.split("source_session_id", "-")[1].cast("int"))
    rows = logs.sampled_days(days, dt.datetime(2030, 1, 1, 12))
    return rows.groupBy(made_for.alias("date"), "provider").agg(F.count(F.lit(1)).alias("events"), F.sum("input_tokens").alias("input_tokens"), F.sum("output_tokens").alias("output_tokens"))


@_query(_EC + """SELECT kind, count(*) AS events, CAST(sum(total_tokens) AS BIGINT) AS total_tokens, round(sum(cost), 9) AS cost_usd, max(timestamp) AS high_water
  FROM c JOIN (SELECT r_regionkey AS id, CASE WHEN r_regionkey % 2 = 0 THEN 'dashboard' ELSE 'logs' END AS kind FROM region) s ON c.source_id = s.id WHERE kind = 'dashboard' GROUP BY kind""")
def imported_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What was imported from the sources of one kind, and how far."""
    kind = F.when(F.col("r_regionkey") % 2 == 0, "dashboard").otherwise("logs")
    sources = spark.read.parquet(f"{sf_dir}/region.parquet").select(F.col("r_regionkey").alias("id"), kind.alias("kind"))
    rows = analytics.imported_totals(events_of(spark, sf_dir), sources, "dashboard")
    return rounded(rows.select(F.lit("dashboard").alias("kind"), "events", "total_tokens", "cost_usd", F.col("high_water").cast("timestamp_ntz").alias("high_water")))


@_query("""WITH s AS (SELECT o_custkey AS id, o_orderdate AS seen, CASE o_orderstatus WHEN 'F' THEN 'failed ' || o_orderpriority END AS error FROM orders),
l AS (SELECT id, max(seen) FILTER (WHERE error IS NULL) AS scanned, list(error ORDER BY seen DESC, error IS NULL, error DESC)[1] AS error FROM s GROUP BY id)
SELECT c_custkey AS id, CASE WHEN l.scanned IS NULL AND c_custkey % 2 = 0 THEN TIMESTAMP '1990-01-01' ELSE CAST(l.scanned AS TIMESTAMP) END AS last_scanned_at, CASE WHEN l.id IS NULL AND c_custkey % 3 = 0 THEN 'old' ELSE l.error END AS last_error FROM customer LEFT JOIN l ON l.id = c_custkey""")
def source_stamps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as sources, their orders as scans, those with status F failed."""
    id_ = F.col("c_custkey")
    sources = spark.read.parquet(f"{sf_dir}/customer.parquet").select(id_.alias("id"), F.when(id_ % 2 == 0, F.lit(NEVER)).cast("timestamp").alias("last_scanned_at"), F.when(id_ % 3 == 0, "old").alias("last_error"))
    error = F.when(F.col("o_orderstatus") == "F", F.concat(F.lit("failed "), "o_orderpriority"))
    scans = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_custkey").alias("id"), F.col("o_orderdate").cast("timestamp").alias("at"), error.alias("error"))
    return store.stamped(sources, scans).select("id", F.col("last_scanned_at").cast("timestamp_ntz").alias("last_scanned_at"), "last_error")


@_query("SELECT doc_id, md5(nullif(text, '')) AS payload_md5 FROM documents")
def decoded_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Payloads of which half are stored as text and half as bytes."""
    even = F.col("doc_id") % 2 == 0
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.when(even, F.col("text")).alias("text"), F.when(even, None).otherwise(F.encode("text", "UTF-8")).alias("packed"))
    return rows.select("doc_id", F.md5(store.decoded_payload(F.col("text"), F.col("packed"))).alias("payload_md5"))


@_query(f"""WITH {_E}, {_AB} SELECT 'u' || event_id AS source_session_id, CASE WHEN event_id % 7 = 0 THEN 'chargedCents,' ELSE '' END || 'kind,model,owningUser,timestamp' || CASE WHEN event_id % 5 <> 0 THEN ',tokenUsage' ELSE '' END AS keys FROM x""")
def dashboard_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The payloads that are kept of dashboard entries have none of the keys under which secrets come."""
    leaky = _entries(spark, sf_dir).select(F.concat(F.expr("substring(value, 1, length(value) - 1)"), F.lit(',"sessionToken":"a","WorkosCursorSessionToken":{"b":1},"cookie":["c"]}')).alias("value"))
    rows = dashboard.from_api(leaky, pricing.seed_prices(spark))
    return rows.select("source_session_id", F.array_join(F.array_sort(F.json_object_keys("raw_json")), ",").alias("keys"))


_NATION_JSON = "'{\"provider\":\"vendor-' || n_regionkey || '\",\"model\":\"nation-' || n_nationkey || '\"'" + "".join(f" || ',\"{r}\":' || CAST((n_nationkey + {i + 1}) / 4.0e0 AS VARCHAR)" for i, r in enumerate(pricing.RATES)) + " || ',\"is_local\":' || CASE WHEN n_nationkey % 4 = 0 THEN 'true' ELSE 'false' END || '}'"


@_query(_EC + f"""SELECT 1 AS section, CASE WHEN row_number() OVER (ORDER BY n_regionkey, 'nation-' || n_nationkey) > 1 THEN ',' ELSE '' END || {_NATION_JSON} AS value FROM nation
UNION ALL SELECT 3, CASE WHEN row_number() OVER (ORDER BY provider, model) > 1 THEN ',' ELSE '' END || '{{"provider":"' || provider || '","model":"' || model || '","events":' || count(*) || ',"tokens":' || CAST(sum(total_tokens) AS BIGINT) || '}}' FROM c WHERE provider <> 'cursor' GROUP BY provider, model
UNION ALL SELECT * FROM (VALUES (0, '{{"priced":['), (2, '],"missing":['), (4, ']}}')) v(section, value)""")
def pricing_envelope(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The document with priced and missing models, by lines."""
    prices = _nation_prices(spark, sf_dir)
    return store.pricing_envelope(prices, pricing.missing_prices(events_of(spark, sf_dir), prices)).select("section", "value")


@_query(f"WITH {_E} SELECT 'u' || event_id AS owner FROM e0 WHERE epoch_ms(ts) BETWEEN epoch_ms(TIMESTAMP '2024-01-10') AND epoch_ms(TIMESTAMP '2024-01-17 12:00:00')")
def ranged_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dashboard entries of a week."""
    found = dashboard.entries_between(_entries(spark, sf_dir), dt.datetime(2024, 1, 10), dt.datetime(2024, 1, 17, 12))
    return found.select(F.get_json_object("value", "$.owningUser").alias("owner"))


@_query(_EC + "SELECT provider, model, bool_and(covered) AS resolved, bool_and(covered AND provider NOT IN ('cursor', 'local')) AS listed, count(*) AS events FROM c GROUP BY ALL")
def resolved_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether the events of a pair find a price, and whether the table holds it under its own name."""
    prices = pricing.seed_prices(spark)
    rows = pricing.with_resolved(usage_from_events(spark, sf_dir), prices).groupBy("provider", "model", "resolved").agg(F.count(F.lit(1)).alias("events"))
    listed = pricing.listed_pairs(rows, prices).select("provider", "model", F.lit(True).alias("listed"))
    return rows.join(listed, ["provider", "model"], "left").withColumn("listed", F.coalesce("listed", F.lit(False)))


@_query("SELECT 'vendor-' || n_regionkey AS provider, 'nation-' || n_nationkey AS model FROM nation ORDER BY provider, model")
def prices_by_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pricing.listed_prices(_nation_prices(spark, sf_dir)).select("provider", "model")


@_query(_EC + _PERIOD + "true")
def overview_period_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(analytics.period(events_of(spark, sf_dir), ALL))


@_query(_EC + "SELECT round(sum(cache_read_tokens * greatest(0, pi - pc)) / 1e6, 9) AS cache_savings_usd FROM c WHERE provider NOT IN ('cursor', 'local')")
def overview_cache_savings_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(analytics.cache_savings_by_key(events_of(spark, sf_dir), ALL, pricing.seed_prices(spark)))


@_query(_EC + f"SELECT day AS date, {_SUMS}, {_COSTS} FROM c GROUP BY day")
def timeseries_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(analytics.timeseries(events_of(spark, sf_dir), ALL))


def _whole_breakdown(dimension: str, column: str) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return rounded(analytics.breakdown(items_of(spark, sf_dir) if dimension != "source" else events_of(spark, sf_dir), ALL, dimension))

    run.__name__ = f"breakdown_{dimension}_all"
    _query((_LC if dimension != "source" else _EC) + f"SELECT coalesce(CAST({column} AS VARCHAR), '(none)') AS key, {_SUM('input_tokens')}, {_SUM('output_tokens')}, {_SUM('total_tokens')}, {_COSTS}, count(DISTINCT session_id) AS sessions FROM c GROUP BY 1 ORDER BY total_tokens DESC, key LIMIT 50")(run)


for _dimension in ("model", "provider", "project", "source"):
    _whole_breakdown(_dimension, analytics.BREAKDOWNS[_dimension])


def _whole_cache(grouping: str) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return rounded(analytics.cache_efficiency(items_of(spark, sf_dir), ALL, pricing.seed_prices(spark)).where(F.col("grouping") == grouping).drop("grouping"))

    run.__name__ = f"cache_by_{grouping}_all"
    _query(_LC + f"SELECT CAST({grouping} AS VARCHAR) AS key, {_SUM('cache_read_tokens')}, {_SUM('cache_write_tokens')}, {_SUM('total_tokens')}, round(sum(cost), 9) AS cost_usd, round(sum(cache_read_tokens * greatest(0, coalesce(CAST(pi AS DOUBLE) - pc, 0)) / 1e6), 9) AS cache_savings_usd, count(DISTINCT session_id) AS sessions FROM c GROUP BY 1")(run)


for _grouping in ("day", "provider", "model"):
    _whole_cache(_grouping)
