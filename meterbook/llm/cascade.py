"""Quality rules as a short-circuit cascade.

Each rule's cost (seconds over a bounded sample of whole texts, with all the
measures that the rule needs) and selectivity (share of the sample it rejects)
are measured; rules then run in descending order of rejection per cost, and a
document leaves at the first rule that rejects it: measures that only later
rules need are never computed for it. Costs count in powers of two, so that the
order doesn't hang on the noise of a clock. The verdict is the same in any
order; only the work differs.

Defined results: null text counts as empty; an empty or null text has no words
and fails the base rules; a rule that gives null doesn't reject; repeated rows
give a row each; an empty table gives an empty result. Columns other than
doc_id and text are carried by `filter_quality` and ignored otherwise.
"""

from __future__ import annotations

import math
import time
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meterbook.llm.native import SPACES, let, without, words
from meterbook.llm.workspace import release, stored

#: Documents on which rules are measured.
SAMPLE_ROWS = 2000
#: Each rule runs so often over the sample; the fastest run counts.
RUNS = 3


@dataclass(frozen=True)
class Rule:
    """rejects: from the measures of a text (by name) to a boolean column."""

    name: str
    rejects: Callable[[dict[str, Column]], Column]


def _repeat_words(codes: Column) -> Column:
    """Words in a window of three words found at least twice, given the words' hashes."""
    n = F.size(codes) - 2
    triples = F.zip_with(F.zip_with(F.slice(codes, 1, n), F.slice(codes, 2, n), lambda a, b: F.xxhash64(a, b)), F.slice(codes, 3, n), lambda ab, c: F.xxhash64(ab, c))

    def covered(at: Column) -> Column:
        return F.aggregate(F.transform(at, lambda p, i: F.when(i == 0, 3).otherwise(F.least(F.lit(3), p - F.get(at, i - 1)))), F.lit(0), lambda total, x: total + x)

    def repeats(h: Column) -> Column:
        ordered = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        at = lambda s: F.sort_array(F.transform(F.filter(s, lambda x, i: (x["h"] == F.get(s, i - 1)["h"]) | (x["h"] == F.get(s, i + 1)["h"])), lambda x: x["i"]))
        return F.when(F.size(F.array_distinct(h)) == F.size(h), 0).otherwise(let(let(ordered, at), covered))

    return F.when(n < 2, 0).otherwise(let(triples, repeats))


def _dup_lines(text: Column) -> Column:
    lines = F.filter(F.split(text, "\n", -1), lambda x: F.length(without(x, SPACES)) > 0)
    return let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x)))


def word_hashes(text: Column) -> Column:
    return F.transform(words(text), lambda w: F.xxhash64(w))


def measures(text: Column, hashes: Column) -> dict[str, Column]:
    """Measures of a text that isn't null, given the hashes of its words; each is computed where it is used."""
    return {
        "text": text,
        "n_words": F.size(hashes).cast("long"),
        "n_repeat_words": _repeat_words(hashes).cast("long"),
        "word_chars": F.length(without(text, SPACES)).cast("long"),
        "n_symbols": (F.length(text) - F.length(without(text, "#*$%&|<>"))).cast("long"),
        "n_dup_lines": _dup_lines(text).cast("long"),
        "n_lines": F.size(F.split(text, "\n", -1)),
        "letters": F.length(F.regexp_replace(text, r"[^\p{L}]+", "")),
        "capitals": F.length(F.regexp_replace(text, r"[^\p{Lu}]+", "")),
    }


BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def measured(documents: DataFrame) -> DataFrame:
    """doc_id, text (null: empty) and the base measures."""
    rows = documents.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    base = let(word_hashes(F.col("text")), lambda w: F.struct(*[measures(F.col("text"), w)[c].alias(c) for c in BASE]))
    return rows.select("doc_id", "text", base.alias("m")).select("doc_id", "text", *[F.col(f"m.{c}") for c in BASE])


def base_rules() -> list[Rule]:
    """Too few words, or more than half of them in repeated windows."""
    return [Rule("short", lambda m: m["n_words"] < 50), Rule("repeated_words", lambda m: 100 * m["n_repeat_words"] > 50 * m["n_words"])]


def default_rules() -> list[Rule]:
    return [
        Rule("symbols", lambda m: 10 * m["n_symbols"] > m["n_words"]),
        Rule("word_length", lambda m: (m["word_chars"] < 2 * m["n_words"]) | (m["word_chars"] > 15 * m["n_words"])),
        Rule("repeated_lines", lambda m: 2 * m["n_dup_lines"] > m["n_lines"]),
        Rule("few_letters", lambda m: 2 * m["letters"] < m["word_chars"]),
        Rule("capitals", lambda m: 2 * m["capitals"] > m["letters"]),
    ]


def _over_text(rejects: Callable[[dict[str, Column]], Column]) -> Column:
    """A rule as one expression over the text column, which hashes the words once."""
    return let(F.coalesce("text", F.lit("")), lambda t: let(word_hashes(t), lambda w: rejects(measures(t, w))))


def measured_order(sample: DataFrame, rules: list[Rule]) -> list[tuple[Rule, float, float]]:
    """(rule, cost in seconds, share rejected) by descending rejection per cost. sample (text) is bounded by the caller."""

    def seconds(condition: Column) -> tuple[float, int, int]:
        best = []
        for _ in range(RUNS):
            began = time.perf_counter()
            row = sample.agg(F.count_if(condition).alias("hits"), F.count(F.lit(1)).alias("rows")).first()
            best.append(time.perf_counter() - began)
        return min(best), row["hits"], row["rows"]

    idle = seconds(F.octet_length("text") < 0)[0]
    found = []
    for rule in rules:
        took, hits, rows = seconds(_over_text(rule.rejects))
        found.append((rule, 2.0 ** round(math.log2(max(took - idle, 1 / 128))), hits / rows if rows else 0.0))
    return sorted(found, key=lambda x: (-x[2] / x[1], x[1], x[0].name))


def cascade(documents: DataFrame, rules: list[Rule], sample_rows: int = SAMPLE_ROWS) -> Callable[[dict[str, Column]], Column]:
    """The rules in measured order, as one function of a text's measures: the name of the first rule that rejects it, or null.

    The sample is the sample_rows documents with the smallest hashes of doc_id,
    so it is the same in every run.
    """
    if len(rules) > 1:
        smallest = documents.select("doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows).distinct()
        sample = stored(documents.select("doc_id", "text").join(F.broadcast(smallest), "doc_id", "left_semi").limit(sample_rows), "sample")
        rules = [rule for rule, _, _ in measured_order(sample, rules)]
        release(sample)

    def verdict(m: dict[str, Column]) -> Column:
        found = F.lit(None).cast("string")
        for rule in reversed(rules):
            found = F.when(rule.rejects(m), rule.name).otherwise(found)
        return found

    return verdict


def judged(documents: DataFrame, rules: list[Rule] | None = None, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """doc_id, the base measures, base_failed, rejected_by, kept. Documents that fail a base rule skip the cascade."""
    verdict = cascade(documents, default_rules() if rules is None else rules, sample_rows)
    rows = measured(documents)
    known = measures(F.col("text"), F.array()) | {c: F.col(c) for c in BASE}
    failed = F.lit(False)
    for rule in base_rules():
        failed = failed | rule.rejects(known)
    rows = rows.withColumn("base_failed", failed).withColumn("rejected_by", F.when(~F.col("base_failed"), verdict(known)))
    return rows.drop("text").withColumn("kept", ~F.col("base_failed") & F.col("rejected_by").isNull())


def filter_quality(documents: DataFrame, rules: list[Rule] | None = None, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """The documents that are kept, with all their columns. The base rules are part of the cascade."""
    verdict = cascade(documents, base_rules() + (default_rules() if rules is None else rules), sample_rows)
    return documents.where(_over_text(verdict).isNull())
