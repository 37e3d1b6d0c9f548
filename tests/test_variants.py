"""Lines of any kind: what is read, what is left out, and the search in depth against plain Python."""

from __future__ import annotations

import datetime as dt
import json
import random

from meterbook.functions import normalize, variants
from meterbook.sources import logs
from pyspark.sql import functions as F

NOW = dt.datetime(2024, 5, 1, 12, 0, 0)
KEYS = ["a_b", "aB", "x"]


def _walk(value: object) -> int:
    if not isinstance(value, dict):
        return 0
    for k in KEYS:
        if type(value.get(k)) is int and -(2**63) <= value[k] < 2**63:
            return value[k]
    for name in sorted(value, key=str.encode):
        found = _walk(value[name])
        if found > 0:
            return found
    return 0


def _random(rng: random.Random, depth: int) -> object:
    kind = rng.randrange(10)
    if depth and kind < 6:
        return {rng.choice(["a_b", "aB", "x", "p", "q", "é", "Z", "info"]): _random(rng, depth - 1) for _ in range(rng.randrange(4))}
    return rng.choice([0, -3, 5, 7, 2**63 - 1, 2**63, 10**30, 1.5, 2.0, "5", None, True, [{"x": 9}], "{[}"])


def test_search_in_depth(spark):
    rng = random.Random(1)
    values = [_random(rng, 5) for _ in range(400)]
    deep: object = {"x": 4}
    for _ in range(900):
        deep = {"p": deep}
    texts = [json.dumps(v) for v in [*values, deep, {"p": {"a_b": 0, "q": {"x": 3}}, "q": {"x": 2}}]]
    rows = variants.with_parsed(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string"), "t", "v")
    found = rows.select("i", variants.deep_whole(F.col("v"), F.col("t"), KEYS).alias("n"))
    assert {r.i: r.n for r in found.collect()} == {i: _walk(json.loads(t)) for i, t in enumerate(texts)}


def test_one_value_a_text(spark):
    good = ['{"a": 1}', ' {"a": "]"} ', "[1, {}]", "7", '"x"', "null", '{"a": "\\u0041"}']
    bad = ['{"a": 1} trailing', '{"a": 1}{"b": 2}', '{"a": 1}, {"b": 2}', '{"a": 1}] [', '{"a": 1}, "x"]', '{"a": 1', "", " ", "{'a': 1}", '{"a": NaN}', '{"a": 1, "a": 2}', '{"a": 1}]']
    rows = variants.with_parsed(spark.createDataFrame([(t,) for t in [*good, *bad, None]], "t string"), "t", "v")
    assert {r.t for r in rows.where("v is not null").collect()} == set(good)


def test_awkward_lines(spark):
    deep = '{"a":' * 900 + '{"input": 6}' + "}" * 900
    lines = [
        '{"model": "gpt-4"} trailing', '{"model": "gpt-4"}{"a": 1}', '{"model": "gpt-1", "x": {"input": 9223372036854775808, "y": {"input": 3}}}', '{"model": "gpt-2", "input_tokens": 123456789012345678901234567890}',
        deep, '{"model": 5, "sessionID": 6, "total": 1}', '{"model": "gpt-3", "usage": [1], "tokens": 4, "info": "text"}', '[{"model": "gpt-5"}, 3, "x", {"model": "gpt-6"}] ', '[{"model": "gpt-7"}] junk', "﻿", "[", "{}", "}{", '{"model": "gpt-8", "usage": {"prompt_tokens": 2.0, "input": 8}}',
    ]
    rows = normalize.normalized(logs.json_lines(spark.createDataFrame([(x,) for x in lines], "value string")), F.lit(NOW).cast("timestamp"))
    assert "Python" not in rows._jdf.queryExecution().toString()
    found = sorted((r.model or "", r.source_session_id, r.input_tokens, r.total_tokens, r.exactness) for r in rows.collect())
    assert found == [("", None, 0, 1, "exact"), ("", None, 6, 6, "unknown"), ("gpt-1", None, 3, 3, "unknown"), ("gpt-2", None, 0, 0, "unknown"), ("gpt-3", None, 0, 0, "unknown"), ("gpt-5", None, 0, 0, "unknown"), ("gpt-6", None, 0, 0, "unknown"), ("gpt-8", None, 8, 8, "exact")]
