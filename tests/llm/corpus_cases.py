"""A small corpus with every awkward case, for the tests of this folder."""

from __future__ import annotations

import random
import re

from pyspark.sql import DataFrame, SparkSession

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key string, mark string, n string, size string, row string, copies string, shingle string, component string"
_VOCABULARY = [a + b for a in ("ba", "de", "fi", "go", "lu", "ma", "ne", "po", "ri", "su") for b in ("ka", "len", "mir", "nos", "tal", "ver", "x", "zo")]


def words(text: str | None) -> list[str]:
    return WORD.findall(text or "")


def prose(rng: random.Random, n: int) -> str:
    parts = []
    for i in range(n):
        parts.append(rng.choice(_VOCABULARY))
        parts.append(rng.choice([" ", " ", " ", " ", " ", ". ", "\n"]) if i < n - 1 else "")
    return "".join(parts)


def texts() -> list[tuple[int | None, str | None, str | None]]:
    """(doc_id, text, source) of each row."""
    rng = random.Random(7)
    base = [prose(rng, n) for n in (60, 80, 120, 200, 300, 55, 90, 400)]
    passage = prose(rng, 30)
    rows: list[tuple[int | None, str | None, str | None]] = [(i, t, "abc"[i % 3]) for i, t in enumerate(base)]
    at = 10

    def add(text: str | None, source: str | None = "a") -> None:
        nonlocal at
        rows.append((at, text, source))
        at += 1

    for _ in range(4):
        add(base[2], "b")
    for t in (base[3], base[4], base[7]):
        for k in range(4):
            w = t.split(" ")
            w[rng.randrange(len(w))] = f"changed{k}"
            add(" ".join(w), "c")
    for k in range(5):
        add(prose(rng, 20 + k) + " " + passage + " " + prose(rng, 15), "hot")
    for t in (None, "", "   \n\t ", "one", "two words", "ONE", "One two three", "a b été \U0001f600 x"):
        add(t, None)
    add("repeated line here\n" * 40, "a")
    add("the same words again " * 60, "a")
    add("#### $$$ %% || <> " * 30 + prose(rng, 30), "b")
    add(prose(rng, 70).upper(), "b")
    add("0 1 2 3 4 5 6 7 8 9 " * 20 + prose(rng, 40), "b")
    add(prose(rng, 6000) + " " + passage, "hot")
    add("x" * 5000 + " " + prose(rng, 60), "a")
    add("Mail jane.doe@example.org or a@b.c.d@e.f, x@y, @z. Host 10.0.0.1 and 1.2.3.4.5.6.7.8 and 300.1.1.1 and 001.002.003.004. " + prose(rng, 60), "a")
    add("Card 4111 1111 1111 1111, 4111-1111-1111-1112, 378282246310005 amex card, order 4222222222222 here, 6011111111111117. Call +44 20 7946 0958 or +1 (555) 010-9999, +12 or +1234567890123456.", "a")
    add("IBAN GB82 WEST 1234 5698 7654 32 and DE89370400440532013000, bad GB82WEST12345698765433; ssn 123-45-6789, 000-12-3456.", "c")
    add("é\U0001f600 4111 1111 1111 1111 a@b.co " * 150, "c")
    rows.append((5, prose(rng, 70), "a"))
    rows += [(6, base[6], "a")] * 3
    rows += [(None, base[1], "b"), (None, prose(rng, 66), None), (None, None, None)]
    return rows


def documents(spark: SparkSession) -> DataFrame:
    rows = [(i, t, "en", s, len(t or ""), *["clash"] * 8) for i, t, s in texts()]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


def empty(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], SCHEMA)
