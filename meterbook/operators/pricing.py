"""Model prices: resolving (provider, model) pairs, costs, and upkeep of the price table.

Prices are resolved once for each distinct pair: one equi-join finds the offers
that cover it, and the best one is joined to the events by another.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from meterbook.schema import MODEL_PRICING

# Published prices in USD per million tokens (provider, model, input, output, reasoning, cache read, cache write, context window).
SEED_PRICES = [
    ("openai", "gpt-5.5", 5.0, 30.0, 0.0, 0.50, 5.0, 400000),
    ("openai", "gpt-5.4", 2.5, 15.0, 0.0, 0.25, 2.5, 400000),
    ("openai", "gpt-5.4-mini", 0.75, 4.5, 0.0, 0.075, 0.75, 128000),
    ("anthropic", "claude-fable-5", 10.0, 50.0, 0.0, 1.0, 12.5, 200000),
    ("anthropic", "claude-opus-4.8", 5.0, 25.0, 0.0, 0.50, 6.25, 200000),
    ("anthropic", "claude-sonnet-4.6", 3.0, 15.0, 0.0, 0.30, 3.75, 200000),
    ("anthropic", "claude-haiku-4.5", 1.0, 5.0, 0.0, 0.10, 1.25, 200000),
    ("google", "gemini-3.1-pro-preview", 2.0, 12.0, 0.0, 0.20, 0.0, 1000000),
    ("google", "gemini-3.5-flash", 1.5, 9.0, 0.0, 0.15, 0.0, 1000000),
    ("openai", "o4-mini", 1.1, 4.4, 4.4, 0.275, 0.0, 128000),
]
# Built-in rates (model, input, output, cache read, cache write).
BUILTIN_RATES = [
    ("composer-2.5-fast", 3.0, 15.0, 0.30, 3.75),
    ("composer-2.5", 0.50, 2.50, 0.05, 0.625),
    ("composer-2", 1.50, 7.50, 0.15, 1.875),
    ("auto", 1.25, 6.0, 0.25, 0.0),
]
# Context windows by model prefix, in order of precedence.
CONTEXT_WINDOWS = [
    ("gpt-5.5", 400000),
    ("gpt-5.4-pro", 400000),
    ("gpt-5.4", 400000),
    ("gpt-5.4-mini", 128000),
    ("o4-mini", 128000),
    ("o3", 128000),
    ("claude-opus-4.8", 200000),
    ("claude-opus-4.7", 200000),
    ("claude-sonnet-4.6", 200000),
    ("claude-haiku-4.5", 200000),
    ("gemini-3.1-pro-preview", 1000000),
    ("gemini-3.5-flash", 1000000),
    ("gpt-4o", 128000),
    ("gpt-4.1", 1000000),
]
# Providers that resell other vendors' models.
AGGREGATORS = ["opencode-go", "github-copilot", "deepinfra", "together", "fireworks", "ollama-cloud", "nvidia", "cursor"]
# Vendor by model prefix.
VENDOR_PREFIXES = {
    "openai": ["gpt-", "o1", "o3", "o4"],
    "anthropic": ["claude-"],
    "google": ["gemini-", "gemma-"],
    "deepseek": ["deepseek"],
    "moonshot": ["kimi-"],
    "minimax": ["minimax"],
    "zhipu": ["glm-"],
    "qwen": ["qwen-", "qwq-"],
    "doubao": ["doubao"],
    "xai": ["grok-"],
    "mistral": ["mistral", "codestral", "pixtral", "ministral"],
    "meta": ["llama"],
    "01ai": ["yi-"],
}
# Models under which others of a family are billed (prefixes, vendor, model).
FAMILY_ALIASES = [
    (["claude-opus-4-7", "claude-opus-4.7"], "anthropic", "claude-opus-4.7"),
    (["claude-opus-4-8", "claude-opus-4.8"], "anthropic", "claude-opus-4.8"),
    (["claude-sonnet"], "anthropic", "claude-sonnet-4.6"),
    (["claude-haiku"], "anthropic", "claude-haiku-4.5"),
    (["gpt-"], "openai", "gpt-5.3-codex"),
    (["gemini-"], "google", "gemini-2.5-pro"),
]
# Model names that resellers give away, and providers that run locally.
FREE_MODELS = ["go", "zen", "big-pickle"]
LOCAL_PROVIDERS = ["local", "lmstudio"]
RATES = ["input_price_per_million", "output_price_per_million", "reasoning_price_per_million", "cache_read_price_per_million", "cache_write_price_per_million"]
#: Characters by which names that begin alike are brought together.
STEM = 8
#: Parts over which the rows of a pair are dealt, and the columns of events by which.
DEALS = 32
FRESH = ["timestamp", "input_tokens", "output_tokens", "cache_read_tokens", "cache_write_tokens"]
_CARRIED = [*RATES, "context_window_tokens", "is_local"]


@dataclass(frozen=True)
class PriceRow:
    """A price for `upsert` and friends."""

    provider: str
    model: str
    rates: tuple[float, float, float, float, float]
    context_window_tokens: int | None = None
    is_local: bool = False


def seed_prices(spark: SparkSession) -> DataFrame:
    """The seed table, with the row for local models."""
    rows = [(*r, "USD", None, False, "seed", "") for r in SEED_PRICES] + [("local", "any", 0.0, 0.0, 0.0, 0.0, 0.0, None, "USD", None, True, "seed", "")]
    return spark.createDataFrame(rows, MODEL_PRICING)


def _starts(m: Column, prefixes: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [m.startswith(p) for p in prefixes])


def _ladder(steps: list[tuple[Column, Column]]) -> Column:
    """The value of the first condition that holds, else null."""
    found = F.when(*steps[0])
    for condition, value in steps[1:]:
        found = found.when(condition, value)
    return found


def plain_model(model: Column) -> Column:
    """A reseller's model name as its vendor writes it."""
    m = F.regexp_replace(F.lower(model), "-free$", "")
    m = F.regexp_replace(m, "-preview$", "")
    m = F.regexp_replace(m, r"^qwen3(\.?)", r"qwen-3$1")
    m = F.substring_index(m, "/", -1)
    return F.when(m == "glm5", "glm-5").otherwise(m)


def vendor_of(model: Column) -> Column:
    """The vendor that a model's name hints at, or null."""
    m = F.lower(model)
    steps = [(_starts(m, prefixes) | (m.contains("codex") if vendor == "openai" else F.lit(False)), F.lit(vendor)) for vendor, prefixes in VENDOR_PREFIXES.items()]
    return _ladder(steps)


def family_alias(model: Column) -> tuple[Column, Column]:
    """(vendor, model) that a family is billed under, or nulls."""
    m = F.lower(model)
    hits = [(_starts(m, prefixes) | (m.contains("codex") if vendor == "openai" else F.lit(False)), F.lit(vendor), F.lit(name)) for prefixes, vendor, name in FAMILY_ALIASES]
    return _ladder([(c, v) for c, v, _ in hits]), _ladder([(c, n) for c, _, n in hits])


def builtin_name(model: Column) -> Column:
    """The built-in rate that covers a plain model name, or null."""
    auto = (model == "auto") | model.startswith("auto-") | (model == "default")
    return _ladder([(model.startswith(name), F.lit(name)) for name, *_ in BUILTIN_RATES if name != "auto"] + [(auto, F.lit("auto"))])


def _builtin_prices(spark: SparkSession) -> DataFrame:
    rows = [("cursor", name, i, o, 0.0, r, w, None, "USD", None, False, "builtin", "") for name, i, o, r, w in BUILTIN_RATES]
    return spark.createDataFrame(rows, MODEL_PRICING)


def _beginning(name: Column, n: int) -> Column:
    return F.substring(name, 1, n)


def _asked(estimate: bool) -> Column:
    """What a pair looks up at each step: (rank, kind, asked_provider, asked_model). The rows of ranks 8 and 10 are proposals."""
    look = lambda rank, kind, provider, model: F.struct(F.lit(rank).alias("rank"), F.lit(kind).alias("kind"), provider.alias("asked_provider"), model.alias("asked_model"))
    provider, model, plain, resold, none = F.col("provider"), F.col("model"), F.col("plain"), F.col("resold"), F.lit("")
    steps = [
        look(1, "row", provider, model),
        look(2, "row", provider, F.lit("any")),
        F.when(resold & plain.isin(FREE_MODELS), look(3, "row", F.lit("local"), F.lit("any"))),
        F.when(resold, look(4, "builtin", none, F.col("builtin"))),
        F.when(resold, look(5, "row", F.col("alias_vendor"), F.col("alias_model"))),
        F.when(resold, look(6, "row", F.col("vendor"), plain)),
        F.when(resold, look(7, "named", none, plain)),
        *[F.when(resold & (F.length(plain) >= n), look(8, "stem", none, _beginning(plain, n))) for n in range(STEM + 1)],
        F.when(provider.isin(LOCAL_PROVIDERS), look(9, "row", F.lit("local"), F.lit("any"))),
    ]
    if estimate:
        steps += [F.when(F.length(model) >= n, look(10, "own stem", provider, _beginning(model, n))) for n in range(STEM + 1)]
        steps += [look(10, "own start", provider, _beginning(model, STEM)), look(11, "average", provider, none)]
    return F.explode(F.array_compact(F.array(*steps)))


def _offers(prices: DataFrame, estimate: bool) -> DataFrame:
    """Prices under each (kind, asked_provider, asked_model) by which they are looked up."""
    place = lambda kind, provider, model: F.struct(F.lit(kind).alias("kind"), provider.alias("asked_provider"), model.alias("asked_model"))
    provider, model, none = F.col("provider"), F.col("model"), F.lit("")
    vendors, own = ~provider.isin(AGGREGATORS), ~F.col("is_local")
    places = [place("row", provider, model), F.when(vendors, place("named", none, model)), F.when(vendors, place("stem", none, _beginning(model, STEM)))]
    if estimate:
        places.append(F.when(own, place("own stem", provider, _beginning(model, STEM))))
        places += [F.when(own & (F.length(model) >= n), place("own start", provider, _beginning(model, n))) for n in range(STEM + 1)]
    offer = lambda rows, at: rows.select(at.alias("at"), provider.alias("p_provider"), model.alias("p_model"), *_CARRIED).select("at.*", "p_provider", "p_model", *_CARRIED)
    offers = offer(prices, F.explode(F.array_compact(F.array(*places)))).unionByName(offer(_builtin_prices(prices.sparkSession), place("builtin", none, model)))
    if estimate:
        offers = offers.unionByName(offer(average_prices(prices).withColumn("model", F.lit("average")), place("average", provider, none)))
    return offers


def resolve_pairs(pairs: DataFrame, prices: DataFrame, estimate: bool = False) -> DataFrame:
    """Distinct (provider, model) pairs with rank and the columns of the price that covers them.

    rank says how: 1 exact, 2 the provider's "any", 3 to 8 by a reseller's
    model name (free, built in, family, vendor, same name, longest prefix),
    9 local. With estimate also 10 (the provider's closest name) and 11 (its
    average). Unresolved pairs are left out. Ties go by provider and model.

    Each step is a lookup, so one equi-join serves all; names that only begin
    alike meet by their first STEM characters. Spark chooses by size whether
    to broadcast: neither the price table nor the pairs in logs are bounded.
    """
    pairs = pairs.select("provider", "model").where(F.col("provider").isNotNull() & F.col("model").isNotNull()).distinct()
    # Grouping again keeps the name's expression from being repeated in each that uses it.
    pairs = pairs.withColumn("plain", plain_model(F.col("model"))).distinct()
    alias_vendor, alias_model = family_alias(F.col("plain"))
    pairs = pairs.select("*", F.col("provider").isin(AGGREGATORS).alias("resold"), alias_vendor.alias("alias_vendor"), alias_model.alias("alias_model"), vendor_of(F.col("plain")).alias("vendor"), builtin_name(F.col("plain")).alias("builtin"))
    asked = pairs.select("provider", "model", "plain", _asked(estimate).alias("look")).select("provider", "model", "plain", "look.*")
    fits = F.when(F.col("kind") == "stem", F.col("plain").startswith(F.col("p_model"))).when(F.col("kind") == "own stem", F.col("model").startswith(F.col("p_model")))
    fits = fits.when(F.col("kind") == "own start", F.col("p_model").startswith(F.col("model"))).otherwise(True)
    found = asked.join(_offers(prices, estimate), ["kind", "asked_provider", "asked_model"]).where(fits)
    order = F.struct("rank", (-F.length("p_model")).alias("shorter"), "p_provider", "p_model", *_CARRIED)
    return found.groupBy("provider", "model").agg(F.min(order).alias("best")).select("provider", "model", *[f"best.{c}" for c in ("rank", "p_provider", "p_model", *_CARRIED)])


def met_by_pair(rows: DataFrame, found: DataFrame, fresh: list[str]) -> DataFrame:
    """rows joined (left) to found, which has one row a pair, by provider and model.

    Few pairs hold most rows, so a pair's rows are dealt by a hash over DEALS
    parts, each of which meets a copy of the pair's row of found: without this
    one task sorts all rows of a pair. fresh: columns by whose values the rows
    of a pair differ; those that rows lack are passed over.
    """
    named = [F.col(c) for c in fresh if c in rows.columns]
    dealt = rows.withColumn("__deal", F.pmod(F.xxhash64(*named), F.lit(DEALS)).cast("int") if named else F.lit(0))
    copies = F.sequence(F.lit(0), F.lit(DEALS - 1)) if named else F.array(F.lit(0))
    return dealt.join(found.withColumn("__deal", F.explode(copies)), ["provider", "model", "__deal"], "left").drop("__deal")


def with_resolved(rows: DataFrame, prices: DataFrame) -> DataFrame:
    """rows with resolved: whether a price covers their provider and model; false where either is null."""
    covered = resolve_pairs(rows, prices).select("provider", "model", F.lit(True).alias("resolved"))
    return met_by_pair(rows, covered, FRESH).withColumn("resolved", F.coalesce("resolved", F.lit(False)))


def listed_pairs(pairs: DataFrame, prices: DataFrame) -> DataFrame:
    """The pairs that the table holds themselves, under no other name."""
    return pairs.join(prices.select("provider", "model"), ["provider", "model"], "left_semi")


def average_prices(prices: DataFrame) -> DataFrame:
    """Each provider's average price over its rows that aren't local."""
    rows = prices.where(~F.col("is_local")).groupBy("provider").agg(*[F.avg(c).alias(c) for c in RATES])
    return rows.withColumn("context_window_tokens", F.lit(None).cast("long")).withColumn("is_local", F.lit(False))


def cost_of(input_: Column, output: Column, reasoning: Column, cache_read: Column, cache_write: Column) -> Column:
    """The cost in USD under the price columns of the row. Cached input is billed once; reasoning apart from output where it has a price."""
    zero = F.lit(0)
    i, o, r, cr, cw = (F.greatest(F.coalesce(c, zero), zero) for c in (input_, output, reasoning, cache_read, cache_write))
    apart = (F.col("reasoning_price_per_million") > 0) & (r > 0) & (r <= o)
    billed = F.when(apart, o - r).otherwise(o), F.when(apart, r).otherwise(zero)
    parts = zip((F.greatest(i - cr, zero), *billed, cr, cw), RATES, strict=True)
    return reduce(lambda a, b: a + b, [amount * F.col(rate) for amount, rate in parts]) / 1e6


def priced(events: DataFrame, prices: DataFrame, missing: str = "warn", pairs: DataFrame | None = None) -> DataFrame:
    """events with cost_usd and cost_status (Priced, Estimated, Unpriced). missing: skip, warn, or estimate.

    pairs: a smaller table with every provider and model of the events, such as
    the rollup; without it the events are scanned for them first.
    """
    covered = resolve_pairs(events if pairs is None else pairs, prices, missing == "estimate")
    rows = met_by_pair(events.drop("cost_usd", "cost_status"), covered, FRESH)
    cost = cost_of(*[F.col(c) for c in ("input_tokens", "output_tokens", "reasoning_tokens", "cache_read_tokens", "cache_write_tokens")])
    rows = rows.withColumn("cost_usd", F.when(F.col("rank").isNull() | F.col("is_local"), 0.0).otherwise(cost))
    rows = rows.withColumn("cost_status", F.when(F.col("rank").isNull(), "Unpriced").when((F.col("rank") >= 10) & ~F.col("is_local"), "Estimated").otherwise("Priced"))
    return rows.drop("rank", "p_provider", "p_model", *_CARRIED)


def exactness_of_status(status: Column) -> Column:
    return F.when(status == "Priced", "exact").when(status == "Estimated", "estimated").otherwise("unknown")


def repriced(events: DataFrame, prices: DataFrame, missing: str = "warn") -> DataFrame:
    """All events priced again; exactness follows the price's status."""
    rows = priced(events, prices, missing)
    return rows.withColumn("exactness", exactness_of_status(F.col("cost_status"))).drop("cost_status")


def unpriced() -> Column:
    """Whether an event should have a cost and has none."""
    return F.col("provider").isNotNull() & F.col("model").isNotNull() & ~F.col("provider").isin(LOCAL_PROVIDERS) & (F.coalesce(F.col("cost_usd"), F.lit(0.0)) == 0) & (F.col("exactness") == "unknown")


def missing_prices(events: DataFrame, prices: DataFrame) -> DataFrame:
    """provider, model, events, tokens, cost_usd of pairs that no price covers, most tokens first."""
    groups = events.where(F.col("provider").isNotNull() & F.col("model").isNotNull()).groupBy("provider", "model").agg(F.count(F.lit(1)).alias("events"), F.sum("total_tokens").alias("tokens"), F.sum("cost_usd").alias("cost_usd"))
    return groups.join(resolve_pairs(groups, prices).select("provider", "model"), ["provider", "model"], "left_anti").orderBy(F.desc("tokens"), "provider", "model")


def context_windows(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(i, m, n) for i, (m, n) in enumerate(CONTEXT_WINDOWS)], "ord int, prefix string, window long")


def context_limits(pairs: DataFrame, prices: DataFrame) -> DataFrame:
    """provider, model, context_limit (null if unknown) of distinct pairs: the price's window, else the first prefix that fits."""
    pairs = pairs.select("provider", "model").where(F.col("model").isNotNull()).distinct()
    known = resolve_pairs(pairs, prices).select(F.col("provider").alias("k_provider"), F.col("model").alias("k_model"), "context_window_tokens")
    rows = pairs.join(known, F.col("provider").eqNullSafe(F.col("k_provider")) & (F.col("model") == F.col("k_model")), "left")
    rows = rows.join(F.broadcast(context_windows(pairs.sparkSession)), F.lower("model").startswith(F.col("prefix")), "left")
    rows = rows.groupBy("provider", "model").agg(F.coalesce(F.first("context_window_tokens"), F.min_by("window", "ord")).alias("context_limit"))
    return rows


def upsert_prices(prices: DataFrame, new: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(the table with new rows over old ones, the replaced rows for the history)."""
    key = ["provider", "model"]
    latest = new.dropDuplicates(key)
    return prices.join(latest.select(key), key, "left_anti").unionByName(latest), prices.join(latest.select(key), key, "left_semi")


def bulk_summary(prices: DataFrame, rows: DataFrame) -> DataFrame:
    """One row: received, inserted, updated, skipped (blank keys)."""
    blank = (F.trim(F.coalesce("provider", F.lit(""))) == "") | (F.trim(F.coalesce("model", F.lit(""))) == "")
    known = prices.select("provider", "model", F.lit(True).alias("known"))
    marked = rows.withColumn("blank", blank).join(known, ["provider", "model"], "left")
    usable = ~F.col("blank")
    return marked.agg(F.count(F.lit(1)).alias("received"), F.count_if(usable & F.col("known").isNull()).alias("inserted"), F.count_if(usable & F.col("known").isNotNull()).alias("updated"), F.count_if("blank").alias("skipped"))


def missing_seeds(prices: DataFrame, seeds: DataFrame) -> DataFrame:
    """Seed rows of vendors (no resellers) that the table lacks."""
    return seeds.where(~F.col("provider").isin(AGGREGATORS)).join(prices.select("provider", "model"), ["provider", "model"], "left_anti")


def without_resellers(prices: DataFrame) -> DataFrame:
    return prices.where(~F.col("provider").isin(AGGREGATORS))


def listed_prices(prices: DataFrame) -> DataFrame:
    return prices.orderBy("provider", "model")


def delete_price(prices: DataFrame, provider: str, model: str) -> DataFrame:
    return prices.where(~((F.col("provider") == provider) & (F.col("model") == model)))
