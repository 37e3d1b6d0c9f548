from __future__ import annotations

import hashlib
import re

import corpus_cases as cases
import pytest
from meterbook.llm import fim
from meterbook.llm.fim import FillIn
from pyspark.sql import functions as F

PATTERNS = {"characters": re.compile(r"(?s)."), "words": re.compile(r"[^\x20\x09-\x0D]+[\x20\x09-\x0D]*|[\x20\x09-\x0D]+"), "lines": re.compile(r"[^\n]*\n|[^\n]+")}
AWKWARD = ["\x1e\x1f\x1ee\x1fd e", "a\x1fb\x1e", "\U0001f600é́\x00z", "<P", "S><P><", "has <S> inside", "<<P>>", "\n\n", "a\n\nb", " lead", "$1 \\1 $", "x", "\r\n\x0b", "<M>"]


def _expected(doc_id: int | None, text: str | None, how: FillIn) -> tuple:
    text = text or ""
    units = PATTERNS[how.unit].findall(text)
    assert "".join(units) == text
    digest = hashlib.sha256(f"{how.seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]
    n = len(units)
    if not text or any(m in text for m in how.marks) or h[2] % 100 >= how.moved:
        return n, "plain", None, None, text
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    prefix, middle, suffix = ("".join(x) for x in (units[:a], units[a:b], units[b:]))
    p, s, m = how.marks
    if h[3] % 100 < how.spm:
        return n, "spm", a, b - a, s + suffix + p + prefix + m + middle
    return n, "psm", a, b - a, p + prefix + s + suffix + m + middle


@pytest.mark.parametrize("how", [FillIn(), FillIn(unit="words", spm=50, seed=2), FillIn(moved=100, spm=50, unit="lines", prefix_mark="[pre]", suffix_mark="[suf]", middle_mark="[mid]")])
def test_outputs_and_way_back(spark, how):
    more = [(100 + i, t * k) for k in range(1, 4) for i, t in enumerate(AWKWARD)]
    docs = cases.documents(spark).select("doc_id", "text", "n", "row").unionByName(spark.createDataFrame(more, "doc_id long, text string"), allowMissingColumns=True)
    made = fim.transformed(docs, how)
    assert made.columns == [*docs.columns, "fim"]
    rows = made.withColumn("back", fim.restored(F.col("fim.output"), F.col("fim.form"), how)).collect()
    assert len(rows) == len(cases.texts()) + len(more)
    for r in rows:
        assert tuple(r.fim) == _expected(r.doc_id, r.text, how)
        assert r.back == (r.text or "")
    assert {r.fim.form for r in rows} == {"plain", "spm", "psm"}


def test_every_cut(spark):
    """Ranks at both ends and next to each other, over units that are escaped."""
    text = "a\x1f\x1eb\U0001f600"
    marked = F.regexp_replace(fim.escaped(F.lit(text)), f"({fim.UNITS['characters']})", f"$1{fim.DELIMITER}")
    pairs = [(a, b) for a in range(6) for b in range(a, 6)]
    rows = spark.createDataFrame(pairs, "a int, b int").select("a", "b", fim.ranked(marked, F.col("a"), F.col("b")).alias("part")).collect()
    assert {(r.a, r.b): r.part for r in rows} == {(a, b): text[a:b] for a, b in pairs}


def test_empty_and_plan(spark):
    made = fim.transformed(cases.empty(spark))
    assert made.count() == 0
    plan = made._jdf.queryExecution().toString()
    assert "Python" not in plan and "Exchange" not in plan
    assert plan.split("== Physical Plan ==")[1].count("regexp_replace") == 1
