from __future__ import annotations

import numpy as np
from conftest import DATA
from meterbook.llm import ann
from meterbook.llm.queries import QUERIES
from pyspark.sql import functions as F

SCHEMA = "vec_id long, embedding array<float>, label int, dim string, code string, block string"


def _rows() -> list[tuple]:
    rng = np.random.default_rng(5)
    rows = [(i, [float(x) for x in rng.standard_normal(24).astype(np.float32)], 0, "x", "x", "x") for i in range(600)]
    rows[101] = (101, rows[100][1], *rows[101][2:])
    rows[102] = (102, [2 * x for x in rows[100][1]], *rows[102][2:])
    bad = [None, [], [0.0] * 24, [1.0] * 23 + [None], [float("nan")] * 24, [float("inf")] + [1.0] * 23]
    rows += [(700 + 50 * k, v, 0, "x", "x", "x") for k, v in enumerate(bad)]
    rows += [(None, [1.0] * 24, 0, "x", "x", "x"), (1001, [1.0, 2.0], 0, "x", "x", "x"), (1050, [2.0, 4.0], 0, "x", "x", "x"), rows[3], rows[50]]
    return rows


def _expected(rows: list[tuple], step: int, k: int) -> dict[int, list[tuple[int, float]]]:
    good = {}
    for i, v, *_ in rows:
        if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v):
            good[i] = np.array(v, np.float64)
    found = {}
    for i, v in good.items():
        if i % step == 0:
            scored = [(-float(v @ w / np.linalg.norm(v) / np.linalg.norm(w)), j) for j, w in good.items() if j != i and len(w) == len(v)]
            found[i] = [(j, -s) for s, j in sorted((round(s, 12), j) for s, j in scored)[:k]]
    return found


def test_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(ann, "BLOCK_ROWS", 100)
    monkeypatch.setattr(ann, "BLOCK_QUERIES", 7)
    rows = _rows()
    index = ann.build_index(spark.createDataFrame(rows, SCHEMA).repartition(3))
    found: dict[int, list] = {}
    for r in ann.nearest(index, F.col("vec_id") % 50 == 0).orderBy("query_id", "rank").collect():
        assert r.rank == len(found.setdefault(r.query_id, [])) + 1
        found[r.query_id].append((r.vec_id, r.score))
    expected = _expected(rows, 50, 5)
    assert found.keys() == expected.keys()
    hits = sum(len({j for j, _ in found[q]} & {j for j, _ in expected[q]}) for q in found)
    assert hits >= 0.99 * sum(map(len, expected.values()))
    assert [j for j, _ in found[100]][:2] == [101, 102]
    for q in found:
        for (j, s), (k, t) in zip(found[q], expected[q], strict=True):
            assert j != k or abs(s - t) < 1e-9


def test_recall_on_embeddings(spark):
    """Against brute force, over the whole table of the tests."""
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{DATA}/embeddings.parquet").select("vec_id", "embedding").collect()]
    expected = {q: {j for j, _ in found} for q, found in _expected(rows, 50, 5).items()}
    hits = total = 0
    for r in QUERIES["op8_nearest"](spark, DATA).collect():
        hits, total = hits + (r.vec_id in expected[r.query_id]), total + 1
    assert total == sum(map(len, expected.values()))
    assert hits >= 0.9 * total


def test_empty(spark):
    index = ann.build_index(spark.createDataFrame([], SCHEMA))
    assert ann.nearest(index, F.col("vec_id") % 50 == 0).count() == 0
