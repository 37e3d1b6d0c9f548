from __future__ import annotations

import datetime as dt

import pytest
from meterbook.operators import alerts, pricing
from meterbook.schema import ALERTS, MODEL_PRICING

EVENT = "provider string, model string, input_tokens long, output_tokens long, reasoning_tokens long, cache_read_tokens long, cache_write_tokens long"


def _table(spark, *rows):
    full = [(p, m, *rates, None, "USD", None, p == "local", "test", "") for p, m, rates in rows]
    return spark.createDataFrame(full, MODEL_PRICING)


def _resolved(spark, prices, provider, model, estimate=False):
    pairs = spark.createDataFrame([(provider, model)], "provider string, model string")
    return pricing.resolve_pairs(pairs, prices, estimate).first()


@pytest.mark.parametrize(("rates", "event", "cost"), [
    ((2.5, 10.0, 0.0, 1.25, 0.0), (1000, 500, 0, 600, 0), (400 * 2.5 + 600 * 1.25 + 500 * 10) / 1e6),
    ((3.0, 12.0, 12.0, 0.0, 0.0), (100, 100, 40, 0, 0), (100 * 3 + 60 * 12 + 40 * 12) / 1e6),
    ((3.0, 12.0, 12.0, 0.0, 0.0), (100, 100, 140, 0, 0), (100 * 3 + 100 * 12) / 1e6),
    ((1.0, 1.0, 0.0, 1.0, 2.0), (10, -5, 0, 50, 3), (50 + 6) / 1e6),
])
def test_cost(spark, rates, event, cost):
    row = pricing.priced(spark.createDataFrame([("v", "m", *event)], EVENT), _table(spark, ("v", "m", rates))).first()
    assert row.cost_usd == pytest.approx(cost)
    assert row.cost_status == "Priced"


def test_ladder(spark):
    rate = lambda x: (x, x, 0.0, 0.0, 0.0)
    prices = _table(spark, ("openai", "gpt-5.3-codex", rate(1.0)), ("deepseek", "deepseek-v4-flash", rate(2.0)), ("qwen", "qwen-3.6-plus", rate(3.0)), ("moonshot", "kimi-k2.5", rate(4.0)), ("x", "any", rate(5.0)), ("local", "any", rate(0.0)), ("odd", "weird", rate(6.0)), ("odd", "weird-name", rate(7.0)))
    want = {
        ("opencode-go", "deepseek-v4-flash"): ("deepseek-v4-flash", 6), ("opencode-go", "qwen3.6-plus"): ("qwen-3.6-plus", 6), ("together", "org/kimi-k2.5-free"): ("kimi-k2.5", 6), ("x", "what"): ("any", 2), ("openai", "gpt-5.3-codex"): ("gpt-5.3-codex", 1),
        ("cursor", "composer-2.5"): ("composer-2.5", 4), ("cursor", "auto"): ("auto", 4), ("cursor", "gpt-9"): ("gpt-5.3-codex", 5), ("together", "weird"): ("weird", 7), ("together", "weird-name-2"): ("weird-name", 8), ("lmstudio", "mine"): ("any", 9), ("cursor", "go"): ("any", 3),
    }
    pairs = spark.createDataFrame([*want, ("opencode-go", "kimi-k9-unknown"), (None, "gpt-5"), ("openai", None)], "provider string, model string")
    found = {(r.provider, r.model): (r.p_model, r["rank"]) for r in pricing.resolve_pairs(pairs, prices).collect()}
    assert found == want


def test_estimates(spark):
    prices = _table(spark, ("v", "base", (1.0, 1.0, 0.0, 0.0, 0.0)), ("v", "base-long", (3.0, 3.0, 0.0, 0.0, 0.0)))
    assert _resolved(spark, prices, "v", "base-long-2") is None
    assert _resolved(spark, prices, "v", "base-long-2", True).p_model == "base-long"
    average = _resolved(spark, prices, "v", "other", True)
    assert (average["rank"], average.input_price_per_million) == (11, 2.0)
    events = spark.createDataFrame([("v", "other", 1_000_000, 0, 0, 0, 0), ("w", "other", 5, 0, 0, 0, 0)], EVENT)
    rows = {r.provider: (r.cost_usd, r.cost_status) for r in pricing.priced(events, prices, "estimate").collect()}
    assert rows == {"v": (2.0, "Estimated"), "w": (0.0, "Unpriced")}


def test_context_limits(spark):
    pairs = spark.createDataFrame([("openai", "gpt-5.4-mini"), ("z", "gpt-5.4-mini"), (None, "o3-pro"), ("z", "none"), ("z", None)], "provider string, model string")
    found = {(r.provider, r.model): r.context_limit for r in pricing.context_limits(pairs, pricing.seed_prices(spark)).collect()}
    assert found == {("openai", "gpt-5.4-mini"): 128000, ("z", "gpt-5.4-mini"): 400000, (None, "o3-pro"): 128000, ("z", "none"): None}


def test_upkeep(spark):
    old = pricing.seed_prices(spark)
    new = _table(spark, ("openai", "gpt-5.5", (9.0,) * 5), ("new", "one", (1.0,) * 5), ("new", "one", (1.0,) * 5), (" ", "x", (0.0,) * 5))
    table, replaced = pricing.upsert_prices(old, new.where("provider <> ' '"))
    assert table.count() == old.count() + 1
    assert [r.model for r in replaced.collect()] == ["gpt-5.5"]
    assert tuple(pricing.bulk_summary(old, new).first()) == (4, 2, 1, 1)
    assert pricing.delete_price(old, "openai", "gpt-5.5").count() == old.count() - 1
    assert pricing.missing_seeds(table.where("model <> 'o4-mini'"), old).count() == 1
    assert pricing.without_resellers(_table(spark, ("cursor", "a", (0.0,) * 5), ("openai", "a", (0.0,) * 5))).count() == 1


def test_alerts_come_once_a_day(spark):
    day = dt.date(2024, 1, 30)
    events = spark.createDataFrame([(dt.datetime(2024, 1, 30, 5), 90, 1.0, False), (dt.datetime(2024, 1, 1), 500, 4.0, False), (dt.datetime(2024, 1, 30), 900, 9.0, True)], "timestamp timestamp_ntz, total_tokens long, cost_usd double, ignored boolean")
    first = alerts.budget_alerts(events, day, 100, 10.0)
    assert {(r.type, r.threshold, r.severity) for r in first.collect()} == {("daily_tokens", 80, "warning"), ("daily_tokens", 50, "warning"), ("monthly_cost", 50, "warning")}
    assert alerts.budget_alerts(events, day, 100, 10.0, first).count() == 0
    log = spark.createDataFrame([(r.type, r.threshold, r.severity, r.title, r.message, r.date, None) for r in first.collect()], ALERTS)
    log = alerts.acknowledged(log, "monthly_cost", 50, day, dt.datetime(2024, 1, 31))
    assert [r.threshold for r in alerts.latest(log, 5, open_only=True).collect()] == [80, 50]


def test_names_that_begin_alike(spark):
    """Ranks 8 and 10 against plain Python, with names shorter and longer than the stem, and empty ones."""
    names = ["", "a", "ab", "abcdefg", "abcdefgh", "abcdefghi", "abcdefghij", "abcdefgX", "b", "any-thing", "gpt-5", "abcdefghi-free"]
    rate = (1.0, 1.0, 0.0, 0.0, 0.0)
    prices = _table(spark, *[("v", n, rate) for n in names[::2]], *[("together", n, rate) for n in names[1:6:2]])
    models = [*names, "abcdefghijkl", "abcdefghXYZ", "zz", "abc"]
    pairs = spark.createDataFrame([(p, m) for p in ("v", "together", "w") for m in models], "provider string, model string")
    own = {"v": names[::2], "together": names[1:6:2], "w": []}

    def expected(provider, model, estimate):
        plain = model.removesuffix("-free")
        if model in own[provider]:
            return 1, model
        if provider == "together" and plain in own["v"]:
            return 7, plain
        begun = [n for n in own["v"] if plain.startswith(n)] if provider == "together" else []
        if begun:
            return 8, max(begun, key=len)
        close = [n for n in own[provider] if model.startswith(n) or n.startswith(model)] if estimate else []
        if close:
            return 10, min(close, key=lambda n: (-len(n), n))
        return (11, "average") if estimate and own[provider] else None

    for estimate in (False, True):
        found = {(r.provider, r.model): (r["rank"], r.p_model) for r in pricing.resolve_pairs(pairs, prices, estimate).collect()}
        want = {(p, m): expected(p, m, estimate) for p in own for m in models}
        assert found == {k: v for k, v in want.items() if v is not None}
