from __future__ import annotations

import re
from collections import Counter

import corpus_cases as cases
from meterbook.llm import pii
from pyspark.sql import functions as F

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def _luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        x = int(c) * (1 + i % 2)
        total += x - 9 if x > 9 else x
    return total % 10 == 0


def _base(text: str) -> dict[str, list[tuple[int, int]]]:
    digits = lambda m: re.sub("[^0-9]", "", m.group())
    return {
        "email": [m.span() for m in EMAIL.finditer(text)],
        "ip": [m.span() for m in IP.finditer(text) if all(int(p) <= 255 for p in m.group().split("."))],
        "card": [m.span() for m in CARD.finditer(text) if 16 <= len(digits(m)) <= 19 and _luhn(digits(m))],
        "phone": [m.span() for m in PHONE.finditer(text) if 8 <= len(digits(m)) <= 15],
    }


def test_base_spans(spark):
    rows = pii.found_data(cases.documents(spark)).collect()
    plain = lambda spans: tuple((s.start, s.end) for s in spans)
    found = Counter((r.doc_id, *[plain(r[k]) for k in ("email", "ip", "card", "phone")]) for r in rows)
    assert found == Counter((i, *map(tuple, _base(t or "").values())) for i, t, _ in cases.texts())


def test_added_kinds(spark):
    text = next(t for _, t, _ in cases.texts() if (t or "").startswith("IBAN"))
    row = pii.found_data(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert [text[s.start : s.end] for s in row.iban] == ["GB82 WEST 1234 5698 7654 32", "DE89370400440532013000"]
    assert [text[s.start : s.end] for s in row.ssn] == ["123-45-6789"]
    cards = "pay by amex card 378282246310005 now; order number 378282246310005"
    row = pii.found_data(spark.createDataFrame([(1, cards)], "doc_id long, text string")).first()
    assert [cards[s.start : s.end] for s in row.short_card] == ["378282246310005"]


def test_checksums(spark):
    rows = spark.createDataFrame([("4111111111111111", "GB82WEST12345698765432"), ("4111111111111112", "GB82WEST12345698765431"), ("0", "FR1420041010050500013M02606"), ("", "XX00")], "a string, b string")
    assert [r[0] for r in rows.select(pii.luhn(F.col("a"))).collect()] == [True, False, True, False]
    assert [r[0] for r in rows.select(pii.mod97(F.col("b"))).collect()] == [True, False, True, False]


def test_context_raises_score(spark):
    rows = spark.createDataFrame([(1, "server address 10.0.0.1 here"), (2, "just 10.0.0.1 here")], "doc_id long, text string")
    assert [r.ip[0].score for r in pii.found_data(rows).orderBy("doc_id").collect()] == [0.8, 0.5]


def test_redacted(spark):
    docs = cases.documents(spark)
    out = pii.redacted(docs)
    assert out.columns == docs.columns
    rows = out.collect()
    assert len(rows) == docs.count()
    assert sum(r.text is None for r in rows) == sum(t is None for _, t, _ in cases.texts())
    for r in rows:
        assert not EMAIL.search(r.text or "")
        assert not _base(r.text or "")["card"]
    clean = Counter(t for _, t, _ in cases.texts() if t and not re.search("[0-9@+]", t))
    assert not clean - Counter(r.text for r in rows)


def test_long_digit_runs(spark):
    long = "1" * 200_000 + " a" + "@" * 1000 + " 1.2.3.4" * 2000
    row = pii.found_data(spark.createDataFrame([(1, long)], "doc_id long, text string")).first()
    assert len(row.ip) == 2000
    assert not row.card


def test_empty(spark):
    assert pii.found_data(cases.empty(spark)).count() == 0
