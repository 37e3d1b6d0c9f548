"""JSON texts as variants: each parsed once, as one value with nothing after it, and searched without Python."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_LEVEL = "array<struct<path: array<string>, members: map<string, variant>>>"
_FOUND = "array<struct<path: array<string>, n: bigint>>"


def once(rows: DataFrame, name: str, value: Column) -> DataFrame:
    """rows with a column that is computed once: a filter on it isn't pushed below it as a copy of its expression."""
    return rows.select("*", F.explode(F.array(value)).alias(name))


def with_parsed(rows: DataFrame, text: str, name: str) -> DataFrame:
    """rows with the variant of a column of texts; null where a text is not one JSON value.

    The parser stops at the end of a value, so the text is put into an array
    with its own digest behind it: what follows the value breaks the array or
    takes the digest's place.
    """
    mark = F.md5(text)
    whole = F.try_parse_json(F.concat(F.lit("["), F.col(text), F.lit(',"'), mark, F.lit('"]')))
    value = F.transform(F.array(whole), lambda w: F.when(F.try_variant_get(w, "$[1]", "string") == mark, F.try_variant_get(w, "$[0]", "variant")))
    return rows.select("*", F.explode(value).alias(name))


def _is(leaf: Column, kind: str) -> Column:
    return F.schema_of_variant(leaf) == kind


def first_whole(leaves: list[Column] | Column) -> Column:
    """The first of some variants that is a whole number of 64 bits, as a long; texts, fractions and larger numbers are none."""
    leaves = leaves if isinstance(leaves, Column) else F.array(*leaves)
    return F.try_variant_get(F.get(F.filter(leaves, lambda x: _is(x, "BIGINT")), F.lit(0)), "$", "bigint")


def first_text(leaves: list[Column], kinds: tuple[str, ...] = ("STRING",)) -> Column:
    """The first of some variants that is a text, or of another kind that is asked for, as a text."""
    return F.try_variant_get(F.get(F.filter(F.array(*leaves), lambda x: F.schema_of_variant(x).isin(*kinds)), F.lit(0)), "$", "string")


def deep_whole(value: Column, text: Column, keys: list[str]) -> Column:
    """A whole number under one of the keys at any depth of the objects of a value, 0 without one. text: the value's text.

    An object's own number goes before those below it; of objects side by side
    the one with the smaller name goes first, and numbers up to 0 count at the
    top only. The search goes down level by level, as many levels as the text
    has braces; levels without objects cost nothing.
    """
    names = [F.lit(k) for k in keys]
    empty = lambda kind: F.array().cast(kind)
    members = lambda v: F.try_variant_get(v, "$", "map<string, variant>")
    top = F.array(F.struct(empty("array<string>").alias("path"), members(value).alias("members")))
    zero = F.struct(F.filter(top, lambda t: t["members"].isNotNull()).cast(_LEVEL).alias("level"), empty(_FOUND).alias("found"))

    def down(state: Column, _: Column) -> Column:
        own = F.transform(state["level"], lambda t: F.struct(t["path"].alias("path"), t["members"].alias("members"), first_whole(F.transform(F.array(*names), lambda k: t["members"][k])).alias("n")))
        return F.get(F.transform(F.array(own), lambda level: F.struct(_below(level).cast(_LEVEL).alias("level"), F.concat(state["found"], _hits(level)).cast(_FOUND).alias("found"))), F.lit(0))

    def _below(level: Column) -> Column:
        open_ = F.filter(level, lambda t: t["n"].isNull())
        children = F.flatten(F.transform(open_, lambda t: F.transform(F.map_entries(t["members"]), lambda e: F.struct(F.concat(t["path"], F.array(e["key"])).alias("path"), members(e["value"]).alias("members")))))
        return F.filter(children, lambda c: c["members"].isNotNull())

    def _hits(level: Column) -> Column:
        hits = F.filter(level, lambda t: (t["n"] > 0) | (t["n"].isNotNull() & (F.size(t["path"]) == 0)))
        return F.transform(hits, lambda t: F.struct(t["path"].alias("path"), t["n"].alias("n")))

    levels = F.length(text) - F.length(F.translate(text, "{", ""))
    found = F.aggregate(F.sequence(F.lit(1), F.greatest(levels, F.lit(1))), zero, down, lambda state: F.array_min(state["found"])["n"])
    return F.coalesce(found, F.lit(0).cast("bigint"))
