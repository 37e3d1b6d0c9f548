from __future__ import annotations

import re

import __spark_entry__ as driver
import pytest
from conftest import DATA, same_as_sql
from meterbook.llm import queries


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_equals_statement(spark, name):
    assert same_as_sql(queries.QUERIES[name](spark, DATA), queries.ORACLE_SQL[name]) > 0


def test_every_operator_is_registered():
    numbers = sorted(int(re.match(r"op(\d+)_", n)[1]) for n in driver.queries() if n.startswith("op"))
    assert numbers == list(range(1, 14))
    assert "pipeline" in driver.queries()


@pytest.mark.parametrize(("name", "columns"), [
    ("op1_source_mix", ["doc_id", "size", "source_size", "target", "taken"]),
    ("op4_toxic_sentences", ["doc_id", "held_out", "score", "predicted"]),
    ("op6_personal_data", ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"]),
    ("op8_nearest", ["query_id", "rank", "vec_id", "score"]),
    ("op9_packing", ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset", "proved"]),
])
def test_columns(spark, name, columns):
    df = queries.QUERIES[name](spark, DATA)
    assert df.columns == columns
    assert df.count() > 0
