"""Fill-in-the-middle transformation of texts, by escaped marker injection.

A text is cut into units (code points, words or lines). A delimiter is escaped
in the text, a regular expression appends it after each unit, its occurrences
are counted, and substring_index takes the units before, between and after two
ranks. The parts are unescaped and put together in one of three forms:

* psm: <P>prefix<S>suffix<M>middle
* spm: <S>suffix<P>prefix<M>middle
* plain: the text as it is

Form and ranks are drawn from a hash of the document's id, so that a rerun
draws the same ones. A text that holds one of the marks stays plain: every
other output can be taken apart again (`restored`).

Defined results: null text counts as empty, and empty texts stay plain; a null
doc_id is hashed as an empty one; repeated rows give a row each; an empty table
gives an empty result; other columns are carried, whatever their names. A text
of n bytes is held with one more byte for each unit and each escaped character.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DELIMITER, ESCAPE = "\x1f", "\x1e"
#: What stands for the escape character and for the delimiter after an escape character.
_CODES = {ESCAPE: "e", DELIMITER: "d"}
_ONE = rf"(?:{ESCAPE}[ed]|[^{ESCAPE}])"
#: Units of an escaped text; each expression covers every text without a gap.
UNITS = {
    "characters": _ONE,
    "words": r"[^\x20\x09-\x0D]+[\x20\x09-\x0D]*|[\x20\x09-\x0D]+",
    "lines": r"[^\n]*\n|[^\n]+",
}


@dataclass(frozen=True)
class FillIn:
    """Of 100 documents about `moved` are transformed, and of 100 of these about `spm` with the suffix first; seed changes all draws."""

    moved: int = 90
    spm: int = 20
    unit: str = "characters"
    seed: int = 1
    prefix_mark: str = "<P>"
    suffix_mark: str = "<S>"
    middle_mark: str = "<M>"

    @property
    def marks(self) -> tuple[str, str, str]:
        return self.prefix_mark, self.suffix_mark, self.middle_mark


def escaped(text: Column) -> Column:
    """text without the delimiter; the escape character goes first, so that unescaping is exact."""
    for character, code in _CODES.items():
        text = F.replace(text, F.lit(character), F.lit(ESCAPE + code))
    return text


def unescaped(text: Column) -> Column:
    for character, code in reversed(_CODES.items()):
        text = F.replace(text, F.lit(ESCAPE + code), F.lit(character))
    return text


def ranked(marked: Column, first: Column, last: Column) -> Column:
    """The units after the first-th up to the last-th of a text in which each unit is followed by the delimiter, unescaped."""
    head = F.call_function("substring_index", marked, F.lit(DELIMITER), last)
    part = F.call_function("substring_index", head, F.lit(DELIMITER), first - last)
    return unescaped(F.translate(part, DELIMITER, ""))


def _draws(doc_id: Column, seed: int) -> list[Column]:
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 1 + 8 * k, 8), 16, 10).cast("long") for k in range(4)]


def transformed(documents: DataFrame, how: FillIn = FillIn()) -> DataFrame:  # noqa: B008
    """The documents, each with a struct fim: n (units), form, prefix_units, middle_units (null if plain), output."""
    columns = [F.col(f"`{c}`") for c in documents.columns]
    rows = documents.select(F.struct(*columns).alias("row"), F.coalesce("text", F.lit("")).alias("text"), F.array(*_draws(F.col("doc_id"), how.seed)).alias("h"))
    rows = rows.withColumn("marked", F.regexp_replace(escaped(F.col("text")), f"({UNITS[how.unit]})", f"$1{DELIMITER}"))
    rows = rows.withColumn("n", (F.length("marked") - F.length(F.translate("marked", DELIMITER, ""))).cast("long"))
    h = [F.col("h")[k] for k in range(4)]
    holds = reduce(Column.__or__, [F.col("text").contains(mark) for mark in how.marks])
    form = F.when((F.col("text") == "") | holds | (h[2] % 100 >= how.moved), "plain").when(h[3] % 100 < how.spm, "spm").otherwise("psm")
    cuts = [h[k] % (F.col("n") + 1) for k in range(2)]
    rows = rows.select("row", "text", "marked", "n", form.alias("form"), F.least(*cuts).cast("int").alias("a"), F.greatest(*cuts).cast("int").alias("b"))
    rows = rows.withColumn("parts", F.when(F.col("form") != "plain", F.array(*[ranked(F.col("marked"), x, y) for x, y in ((F.lit(0), F.col("a")), (F.col("a"), F.col("b")), (F.col("b"), F.col("n").cast("int")))])))
    prefix, middle, suffix = (F.col("parts")[k] for k in range(3))
    p, s, m = (F.lit(mark) for mark in how.marks)
    output = F.when(F.col("form") == "plain", F.col("text")).when(F.col("form") == "psm", F.concat(p, prefix, s, suffix, m, middle)).otherwise(F.concat(s, suffix, p, prefix, m, middle))
    moved = F.col("form") != "plain"
    fim = F.struct("n", "form", F.when(moved, F.col("a").cast("long")).alias("prefix_units"), F.when(moved, (F.col("b") - F.col("a")).cast("long")).alias("middle_units"), output.alias("output"))
    return rows.select("row", fim.alias("fim")).select("row.*", "fim")


def restored(output: Column, form: Column, how: FillIn = FillIn()) -> Column:  # noqa: B008
    """The text from which an output was made."""
    p, s, m = how.marks
    first, second = F.when(form == "psm", p).otherwise(s), F.when(form == "psm", s).otherwise(p)
    middle = F.substring_index(output, m, -1)
    head = F.call_function("substring_index", output, F.lit(m), F.lit(1))
    right = F.call_function("substring_index", head, second, F.lit(-1))
    left = F.call_function("substring_index", F.call_function("substring_index", head, second, F.lit(1)), first, F.lit(-1))
    return F.when(form == "plain", output).when(form == "psm", F.concat(left, middle, right)).otherwise(F.concat(right, middle, left))
