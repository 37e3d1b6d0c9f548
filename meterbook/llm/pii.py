"""Personal data: patterns propose spans, checksums confirm them, context words adjust the score.

Every kind has a pattern whose matches are taken leftmost and not overlapping,
a validator, and a score: 0.5 for a match that its validator accepts, plus
0.3 where the validator is a checksum (Luhn, mod 97), plus 0.3 where a word of
the kind's context stands within 40 characters before or 20 after. A span is
reported from 0.5 for the four plain kinds, and from 0.8 for the others, so a
number that only looks like an identifier needs a checksum or a context word;
a short card number needs both.

Spans are code points, end exclusive. Defined results: null text counts as
empty; an empty text has no spans; repeated rows give a row each; an empty
table gives an empty result; columns other than doc_id and text are ignored by
`found_data` and carried unchanged by `redacted`.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meterbook.llm.native import let

_BLOCK = 64
_BYTE_VALUE = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[0-9]{1,2})"


def _digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""

    def total(d: Column) -> Column:
        n = F.length(d)

        def add(acc: Column, i: Column) -> Column:
            x = F.substring(d, n - i + 1, F.lit(1)).cast("int") * F.when(i % 2 == 0, 2).otherwise(1)
            return acc + F.when(x > 9, x - 9).otherwise(x)

        return F.aggregate(F.sequence(F.lit(1), n), F.lit(0), add)

    return F.when(F.length(digits) > 0, let(digits, total) % 10 == 0).otherwise(False)


def mod97(account: Column) -> Column:
    """Whether an IBAN's characters leave 1 modulo 97."""
    plain = F.regexp_replace(account, " ", "")
    turned = F.concat(F.substring(plain, F.lit(5), F.length(plain)), F.substring(plain, 1, 4))

    def rest(t: Column) -> Column:
        def step(acc: Column, i: Column) -> Column:
            code = F.ascii(F.substring(t, i, F.lit(1)))
            return F.when(code >= 65, (acc * 100 + code - 55) % 97).otherwise((acc * 10 + code - 48) % 97)

        return F.aggregate(F.sequence(F.lit(1), F.length(t)), F.lit(0), step)

    return let(turned, rest) == 1


@dataclass(frozen=True)
class Kind:
    """accepts maps a match to a boolean; hint is a cheap pattern that every text with a match has."""

    name: str
    hint: str
    pattern: str
    accepts: Callable[[Column], Column]
    checksum: bool
    context: str
    least: float


# The first two patterns start only where the run of characters that they
# start with starts, or where the last match ended: the matches are those of
# the plain pattern, in time linear in the text.
EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
IBAN = r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:[A-Z0-9]{11,30}|(?:\x20[A-Z0-9]{4}){2,7}(?:\x20[A-Z0-9]{1,3})?)(?![A-Za-z0-9])"
SSN = r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"

BASE_KINDS = [
    Kind("email", "@", EMAIL, lambda m: F.lit(True), False, "mail|contact", 0.5),
    Kind("ip", r"[0-9]\.[0-9]", IP, lambda m: m.rlike(rf"^{_BYTE_VALUE}(?:\.{_BYTE_VALUE}){{3}}$"), False, "host|server|address", 0.5),
    Kind("card", r"[0-9][\x20-]?[0-9]", CARD, lambda m: let(_digits(m), lambda d: F.when(F.length(d).between(16, 19), luhn(d)).otherwise(False)), True, "card|visa|mastercard|credit|payment", 0.5),
    Kind("phone", r"\+[0-9]", PHONE, lambda m: F.length(_digits(m)).between(8, 15), False, "phone|call|tel|mobile|fax", 0.5),
]
ADDED_KINDS = [
    Kind("iban", r"[A-Z]{2}[0-9]{2}", IBAN, mod97, True, "iban|account|bank|transfer", 0.8),
    Kind("short_card", r"[0-9][\x20-]?[0-9]", CARD, lambda m: let(_digits(m), lambda d: F.when(F.length(d).between(13, 15), luhn(d)).otherwise(False)), True, "card|visa|amex|credit|payment", 1.1),
    Kind("ssn", "[0-9]-[0-9]", SSN, lambda m: ~m.rlike("^(?:000|666|9)|-00-|-0000$"), False, "ssn|social security|taxpayer", 0.8),
]
KINDS = BASE_KINDS + ADDED_KINDS


def _before(sizes: Column) -> Column:
    """Sums of the entries before each one, block by block, so that long arrays don't cost their square."""
    add = lambda a: F.aggregate(a, F.lit(0), lambda t, x: t + x)
    cut = lambda s: F.transform(F.sequence(F.lit(0), F.floor((F.size(s) - 1) / _BLOCK).cast("int")), lambda b: F.slice(s, b * _BLOCK + 1, F.lit(_BLOCK)))
    inside = lambda block, base: F.transform(block, lambda x, j: base + add(F.slice(block, F.lit(1), j)))

    def summed(blocks: Column) -> Column:
        sums = F.transform(blocks, add)
        bases = let(sums, lambda s: F.transform(s, lambda x, i: add(F.slice(s, F.lit(1), i))))
        return F.flatten(F.zip_with(blocks, bases, inside))

    return F.when(F.size(sizes) == 0, F.array().cast("array<int>")).otherwise(let(let(sizes, cut), summed))


def _score(kind: Kind, gaps: Column, i: Column) -> Column:
    """The score of an accepted match number i, given the text between matches."""
    around = F.lower(F.concat(F.right(F.get(gaps, i), F.lit(40)), F.lit("\n"), F.left(F.get(gaps, i + 1), F.lit(20))))
    return F.lit(0.8 if kind.checksum else 0.5) + F.when(around.rlike(rf"\b(?:{kind.context})s?\b"), 0.3).otherwise(0.0)


_SPAN = "array<struct<kind:string,start:int,end:int,score:double>>"


def spans(text: Column, kind: Kind) -> Column:
    """Accepted spans of one kind in order: array of kind, start, end, score."""

    def placed(gaps: Column, hits: Column) -> Column:
        sizes = F.zip_with(F.slice(gaps, F.lit(1), F.size(hits)), hits, lambda g, h: F.length(g) + F.length(h))

        def build(before: Column) -> Column:
            def one(hit: Column, i: Column) -> Column:
                gap = F.get(gaps, i)
                start = F.get(before, i) + F.length(gap)
                score = _score(kind, gaps, i)
                kept = F.when(kind.accepts(hit), score >= kind.least).otherwise(False)
                return F.struct(F.lit(kind.name).alias("kind"), start.alias("start"), (start + F.length(hit)).alias("end"), score.alias("score"), kept.alias("kept"))

            return F.filter(F.transform(hits, one), lambda s: s["kept"])

        return F.transform(let(let(sizes, _before), build), lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"), s["score"].alias("score")))

    def both(t: Column) -> Column:
        return let(F.split(t, kind.pattern, -1), lambda gaps: let(F.regexp_extract_all(t, F.lit(kind.pattern), F.lit(0)), lambda hits: F.when(F.size(hits) > 0, placed(gaps, hits))))

    found = F.when(text.rlike(kind.hint), let(text, both))
    return F.coalesce(found, F.array().cast(_SPAN)).cast(_SPAN)


def found_data(documents: DataFrame, kinds: list[Kind] = KINDS) -> DataFrame:
    """doc_id and, for each kind, a column of its spans named after it."""
    rows = documents.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    return rows.select("doc_id", *[spans(F.col("text"), k).alias(k.name) for k in kinds])


def listed(*columns: str) -> Column:
    """kind:start:end of all spans, in the order of the columns, joined by commas."""
    everything = F.concat(*[F.col(c) for c in columns])
    return F.array_join(F.transform(everything, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def redacted(documents: DataFrame, kinds: list[Kind] = KINDS) -> DataFrame:
    """documents with [KIND] in place of each accepted span, one kind after the other; null texts stay null."""
    text = F.col("text")
    for kind in kinds:
        documents = documents.withColumn("text", F.when(text.rlike(kind.hint), let(text, _masker(kind))).otherwise(text))
    return documents


def _masker(kind: Kind) -> Callable[[Column], Column]:
    def joined(gaps: Column, hits: Column) -> Column:
        tag = f"[{kind.name.upper()}]"
        shown = F.transform(hits, lambda x, i: F.concat(F.get(gaps, i), F.when(kind.accepts(x) & (_score(kind, gaps, i) >= kind.least), tag).otherwise(x)))
        return F.concat(F.array_join(shown, ""), F.element_at(gaps, -1))

    def masked(t: Column) -> Column:
        gaps, hits = F.split(t, kind.pattern, -1), F.regexp_extract_all(t, F.lit(kind.pattern), F.lit(0))
        return let(gaps, lambda g: let(hits, lambda h: F.when(F.size(h) > 0, joined(g, h)).otherwise(t)))

    return masked
