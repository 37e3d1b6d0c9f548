"""JSON events of many shapes as canonical usage events.

A line is parsed once; a field whose JSON type doesn't fit is null, so 1.5, "7"
and numbers beyond 64 bits are not token counts. Lines without counts at the
known places are searched in depth.

Defined results: a line that is not one JSON object is left out, as are those
with text or a second object behind the first, with a key twice in one object,
or nested deeper than the parser goes (1000 levels).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meterbook.functions.hashing import event_hash
from meterbook.functions.variants import deep_whole, first_text, first_whole, once, with_parsed

# The keys under which logs hold counts, and the objects that hold such keys.
INPUT = ["input_tokens", "prompt_tokens", "inputTokens", "input", "prompt"]
OUTPUT = ["output_tokens", "completion_tokens", "outputTokens", "output", "completion"]
TOTAL = ["total_tokens", "totalTokens", "total"]
REASONING = ["reasoning_tokens", "reasoningTokens"]
READ_NESTED = ["cached_tokens", "cache_read_input_tokens", "cacheReadTokens"]
READ = ["cache_read_tokens", "cacheReadTokens", "cache_read_input_tokens"]
WRITE_NESTED = ["cache_creation_tokens", "cacheWriteTokens", "cache_creation_input_tokens"]
WRITE = ["cache_write_tokens", "cacheWriteTokens", "cache_creation_input_tokens"]
HOLDERS = ["info", "usage", "tokens", "message"]
DETAILS = ["completion_tokens_details", "output_tokens_details", "prompt_tokens_details", "cache"]
SESSION = ["sessionID", "session_id", "sessionId", "conversation_id"]
MILLISECONDS_FROM = 1_000_000_000_000


def _camel(key: str) -> str:
    head, *rest = key.split("_")
    return head + "".join(w[:1].upper() + w[1:] for w in rest)


def _spelled(keys: list[str]) -> list[str]:
    return list(dict.fromkeys(s for k in keys for s in (k, _camel(k))))


_COUNTS = _spelled([*INPUT, *OUTPUT, *TOTAL, *REASONING, *READ_NESTED, *READ, *WRITE_NESTED, *WRITE, "tokens"])
_TEXTS = ["model", "modelID", "provider", "providerID", "role", "messageRole", "type", "eventType", "model_id", "provider_id", "message_role", "event_type", "project_path", "timestamp", "createdAt", "created_at", "time", "ts"]
_TOP = [k for k in _COUNTS if k != "tokens"]
_OBJECTS = [*HOLDERS, *DETAILS, "tools", "tool"]
SCHEMA = "struct<" + ", ".join([f"`{t}`: variant" for t in [*_TEXTS, *_TOP]] + [f"`{h}`: map<string, variant>" for h in _OBJECTS]) + ">"


# Counts are looked for in hundreds of places, so these expressions are built as text, at once.
def _whole(leaves: list[str]) -> str:
    """The first of some variants that is a whole number of 64 bits."""
    return f"try_variant_get(get(filter(array({', '.join(leaves)}), x -> schema_of_variant(x) = 'BIGINT'), 0), '$', 'bigint')"


def _top(keys: list[str]) -> Column:
    return F.expr(f"coalesce({_whole([f'j.`{k}`' for k in _spelled(keys)])}, 0L)")


def _nested(parents: list[str], keys: list[str]) -> Column:
    """A count of the first of some objects that holds one, in itself or in its details."""
    names, found = _spelled(keys), []
    for p in parents:
        places = [_whole([f"j.`{p}`['{k}']" for k in names])]
        for d in DETAILS:
            details = f"j.`{p}`['{d}']"
            inside = _whole([f"try_variant_get({details}, '$.{k}', 'variant')" for k in names])
            places.append(f"if({details} is null, null, {inside})")
        found.append(f"if(j.`{p}` is null, null, coalesce({', '.join(places)}))")
    return F.expr(f"coalesce({', '.join(found)}, 0L)")


_DEEP = {"input": _spelled(["input_tokens", "prompt_tokens", "input"]), "output": _spelled(["output_tokens", "completion_tokens", "output"]), "total": _spelled(["total_tokens", "total"])}


def _may_name(text: Column, keys: list[str]) -> Column:
    """Whether a JSON text can hold one of the keys: as it is, or with escapes."""
    return reduce(Column.__or__, [text.contains(f'"{k}"') for k in keys]) | text.contains("\\u")


def detected_provider(model: Column) -> Column:
    m = F.lower(model)
    openai = m.startswith("gpt-") | m.startswith("o1") | m.startswith("o3") | m.startswith("o4")
    return F.when(openai, "openai").when(m.startswith("claude-"), "anthropic").when(m.startswith("gemini-") | m.startswith("palm-"), "google").when(m.contains("lm-studio") | m.startswith("local/"), "lmstudio").when(model.isNotNull(), "unknown")


def detected_by_plugin(model: Column) -> Column:
    """As a producer's plugin names providers: open models count as local."""
    m = F.lower(model)
    local = m.startswith("llama") | m.startswith("qwen") | m.startswith("mistral") | m.startswith("phi-")
    return F.when(local, "local").otherwise(detected_provider(model))


# Where a producer's plugin looks for its counts, in order.
PLUGIN_HOLDERS = ["usage", "tokens", "info.tokens", "info.usage"]
PLUGIN_COUNTS = {
    "input": ["input_tokens", "prompt_tokens", "input", "inputTokens"],
    "output": ["output_tokens", "completion_tokens", "output", "outputTokens"],
    "total": ["total_tokens", "total"],
    "reasoning": ["reasoning_tokens", "reasoningTokens", "completion_tokens_details.reasoning_tokens", "output_tokens_details.reasoning_tokens"],
    "cache_read": ["cache_read_input_tokens", "cache_read_tokens", "cacheReadTokens", "prompt_tokens_details.cached_tokens"],
    "cache_write": ["cache_creation_input_tokens", "cache_write_tokens", "cacheWriteTokens"],
}


def whole_number(text: Column) -> Column:
    """A number, or the text of one, cut to a whole number; 0 for anything else."""
    n = F.trim(text).try_cast("double")
    return F.when(n.isNotNull() & ~F.isnan(n) & (F.abs(n) < float(1 << 63)), n.cast("long")).otherwise(F.lit(0).cast("long"))


def plugin_usage(payload: Column) -> Column:
    """The counts that a producer's plugin writes for a JSON payload, as a struct; null without an object of counts."""
    # Lambdas, so that the payload and the object of counts are named more than once but computed once.
    holders = F.transform(F.array(payload), lambda p: F.coalesce(*[F.get_json_object(p, f"$.{h}") for h in PLUGIN_HOLDERS]))
    return F.get(F.transform(holders, lambda holder: F.when(holder.startswith("{"), _plugin_counts(holder))), F.lit(0))


def _plugin_counts(holder: Column) -> Column:
    texts = F.struct(*[F.coalesce(*[F.get_json_object(holder, f"$.{k}") for k in keys]).alias(name) for name, keys in PLUGIN_COUNTS.items()])

    def read(at: Column) -> Column:
        counts = {name: whole_number(at[name]) for name in PLUGIN_COUNTS}
        counts["total"] = F.when(at["total"].isNotNull(), counts["total"]).otherwise(counts["input"] + counts["output"])
        return F.struct(*[c.alias(name) for name, c in counts.items()])

    return F.get(F.transform(F.array(texts), read), F.lit(0))


def instant(number: Column) -> Column:
    """A timestamp from seconds, or from milliseconds where the number is too large for seconds."""
    n = number.cast("long")
    return F.when(n > MILLISECONDS_FROM, F.timestamp_millis(n)).otherwise(F.timestamp_seconds(n))


def parsed_time(text: Column) -> Column:
    """RFC 3339, or an integer; null if it is neither."""
    number = F.when(text.rlike(r"^-?[0-9]{1,15}$"), text)
    dated = F.when(text.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}[Tt ][0-9:.]+([Zz]|[+-][0-9]{2}:[0-9]{2})$"), text)
    return F.coalesce(F.try_to_timestamp(dated), instant(number.try_cast("long")))


def normalized(lines: DataFrame, ingest_time: Column, extended_paths: bool = False) -> DataFrame:
    """Canonical events of the lines (value, and optionally path); lines that hold no object, or neither model, provider nor tokens, are left out.

    extended_paths also reads the cache and reasoning counts of info.tokens.
    """
    path = F.col("path") if "path" in lines.columns else F.lit(None).cast("string")
    value = F.trim("value")
    rows = with_parsed(lines.select(value.alias("raw"), path.alias("raw_source_path")).where(F.col("raw").startswith("{")), "raw", "v").where("v is not null")
    rows = once(rows, "j", F.try_variant_get("v", "$", SCHEMA))
    j = F.col("j")
    text = lambda *keys: first_text([j[k] for k in keys])
    # By path, as two of these names differ in case alone.
    session = first_text([F.try_variant_get("v", f"$.{at}{k}", "variant") for at in ("", "info.") for k in SESSION])
    counts = [c for name, keys in (("input", INPUT), ("output", OUTPUT), ("total", TOTAL)) for c in (_top(keys).alias(f"t_{name}"), _nested(HOLDERS, keys).alias(f"n_{name}"))]
    rows = once(rows, "known", F.struct(*counts, text("model", "modelID", "model_id").alias("model"))).select("raw", "raw_source_path", "v", "j", "known.*")
    known = lambda n: F.when(F.col(f"t_{n}") > 0, F.col(f"t_{n}")).when(F.col(f"n_{n}") > 0, F.col(f"n_{n}"))
    pick = lambda n: F.coalesce(known(n), F.when(_may_name(F.col("raw"), _DEEP[n]), deep_whole(F.col("v"), F.col("raw"), _DEEP[n])), F.lit(0).cast("long"))
    reasoning = F.greatest(_nested([*HOLDERS, "output_tokens_details", "completion_tokens_details"], REASONING), _top(REASONING))
    read = F.greatest(_nested(["info", "usage", "prompt_tokens_details", "cache"], READ_NESTED), _top(READ))
    write = F.greatest(_nested(["info", "usage", "prompt_tokens_details", "cache"], WRITE_NESTED), _top(WRITE))
    if extended_paths:
        at = lambda k: F.coalesce(first_whole([F.try_variant_get("v", f"$.info.tokens.{k}", "variant")]), F.lit(0).cast("long"))
        reasoning, read, write = F.greatest(reasoning, at("reasoning")), F.greatest(read, at("cache_read")), F.greatest(write, at("cache_write"))
    model = F.col("model")
    event = F.struct(
        session.alias("source_session_id"), model.alias("model"), F.coalesce(text("provider", "providerID", "provider_id"), detected_provider(model)).alias("provider"),
        text("role", "messageRole", "message_role").alias("message_role"), F.coalesce(text("type", "eventType", "event_type"), F.lit("unknown")).alias("event_type"), text("project_path").alias("project_path"),
        F.coalesce(*[parsed_time(first_text([j[k]], ("STRING", "BIGINT"))) for k in ("timestamp", "createdAt", "created_at", "time", "ts")], ingest_time).alias("timestamp"),
        pick("input").alias("input_tokens"), pick("output").alias("output_tokens"), reasoning.alias("reasoning_tokens"), read.alias("cache_read_tokens"), write.alias("cache_write_tokens"),
        _nested(["info", "tools", "tool"], ["tokens"]).alias("tool_tokens"), pick("total").alias("known_total"),
        ((F.greatest("t_input", "t_output", "t_total") > 0) | (F.greatest("n_input", "n_output") > 0)).alias("explicit"),
    )
    rows = once(rows, "event", event).select("raw", "raw_source_path", "event.*")
    counted = F.when(F.col("known_total") > 0, F.col("known_total")).otherwise(F.col("input_tokens") + F.col("output_tokens") + F.col("reasoning_tokens"))
    rows = rows.withColumn("total_tokens", counted)
    some = F.greatest("input_tokens", "output_tokens", "total_tokens") > 0
    rows = rows.where(F.col("model").isNotNull() | F.col("provider").isNotNull() | some)
    rows = rows.withColumn("exactness", F.when(some & F.col("explicit"), "exact").otherwise("unknown")).withColumn("confidence", F.when(~some, 0.0).when(F.col("explicit"), 0.95).otherwise(0.4))
    return with_hash(rows).withColumn("ignored", F.lit(False)).withColumnRenamed("raw", "raw_json").drop("known_total", "explicit")


def with_hash(events: DataFrame) -> DataFrame:
    return events.withColumn("event_hash", event_hash(*[F.col(c) for c in ("timestamp", "provider", "model", "source_session_id", "event_type", "total_tokens", "input_tokens", "output_tokens")]))


def first_of_each(events: DataFrame) -> DataFrame:
    """The first event of each hash: of the smallest path, then payload, so that a rerun takes the same one."""
    order = [c for c in ("raw_source_path", "raw_json") if c in events.columns]
    if not order:
        return events.dropDuplicates(["event_hash"])
    row = F.struct(*[F.col(f"`{c}`") for c in events.columns])
    return events.groupBy("event_hash").agg(F.min_by(row, F.struct(*[F.coalesce(F.col(c), F.lit("")) for c in order])).alias("row")).select("row.*")
