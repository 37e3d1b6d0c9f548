from __future__ import annotations

import random
from collections import Counter

import corpus_cases as cases
import numpy as np
import pyarrow as pa
import pytest
import test_ngram_join as brute
from meterbook.llm import bottom_k, ngram_join
from meterbook.llm.bottom_k import Sketches
from meterbook.llm.ngram_join import Similarity

LIKE = Similarity(3, 85, 100)


def _found(df) -> Counter:
    rows = df.collect()
    assert all(r.kept == (r.doc_id == r.component_id) for r in rows)
    return Counter((r.doc_id, r.n_shingles, r.component_id) for r in rows)


@pytest.mark.parametrize(("like", "size", "broadcast"), [(LIKE, 64, 1 << 25), (Similarity(5, 80, 100), 32, 0)])
def test_components(spark, like, size, broadcast):
    found = bottom_k.near_duplicates(cases.documents(spark), like, size, broadcast_bytes=broadcast)
    assert _found(found) == brute._expected(cases.texts(), like)


def test_families_and_a_common_passage(spark, monkeypatch):
    """Chains of near copies of long and short texts, and unlike texts that share most of a passage, in small groups and cells."""
    monkeypatch.setattr(ngram_join, "GROUP_CLASSES", 8)
    monkeypatch.setattr(ngram_join, "CELL_QUERIES", 16)
    rng = random.Random(5)
    texts, passage = [], cases.prose(rng, 60)
    for n in (30, 66, 90, 400):
        original = cases.prose(rng, n).split()
        for i in range(40):
            w = list(original)
            for _ in range(rng.randrange(1 + n // 20)):
                w[rng.randrange(len(w))] = f"own{i % 10}x{rng.randrange(3)}"
            texts.append((len(texts), " ".join(w)))
    for _ in range(60):
        texts.append((len(texts), passage + " " + cases.prose(rng, rng.randrange(6, 60))))
    docs = spark.createDataFrame(texts, "doc_id long, text string").repartition(3)
    assert _found(bottom_k.near_duplicates(docs, LIKE, rounds=1)) == brute._expected(texts, LIKE)


def test_empty(spark):
    assert bottom_k.near_duplicates(cases.empty(spark)).count() == 0


@pytest.mark.parametrize(("like", "size"), [(LIKE, 64), (LIKE, 16), (Similarity(5, 80, 100), 64)])
def test_screen_loses_no_link(like, size):
    """All links pass the estimate and share a looked-up value in any order; texts that have little in common don't pass."""
    rng = random.Random(9)
    rows = []
    for n in (5, 17, 40, 70, 80, 300, 2000):
        base = [f"w{rng.randrange(10**6)}" for _ in range(n)]
        for _ in range(12):
            x = list(base)
            for _ in range(rng.randrange(1 + len(x) // 25)):
                x[rng.randrange(len(x))] = f"new{rng.randrange(10**6)}"
            rows.append(" ".join(x[: len(x) - rng.randrange(1 + len(x) // 20)]))
    sets, screen = ngram_join.sets_of(pa.array(rows), like.width), Sketches(like, size)
    whole = [set(sets.codes[a:b].tolist()) for a, b in zip(sets.first[:-1], sets.first[1:], strict=True)]
    kept, lists = screen.kept(sets), screen.lists(sets.sizes)
    order = [sorted(np.frombuffer(b, np.uint64).tolist(), key=lambda v: v % 1009)[:n] for b, n in zip(kept, lists.tolist(), strict=True)]
    links = 0
    for i in range(len(rows)):
        for j in range(i):
            a, b = whole[i], whole[j]
            may = screen.may(np.array([True, False]), np.array([0, 1]), sets.sizes[[i, j]], [kept[i], kept[j]])
            assert may[0] == may[1]
            if like.whole * len(a & b) >= like.part * len(a | b):
                links += 1
                assert may[0] and set(order[i]) & set(order[j])
            elif i // 12 != j // 12:
                assert not may[0]
            if max(len(a), len(b)) <= size:
                assert may[0] == (like.whole * len(a & b) >= like.part * len(a | b))
    assert links > 100


def test_bound_of_the_estimate():
    """The chance of so few shared values is below the loss, by the binomial distribution."""
    from math import comb

    screen = Sketches(LIKE, 64, 1e-6)
    for m in (10, 64, 100):
        x = int(screen.shared[m])
        assert x > 0 and sum(comb(m, k) * 0.85**k * 0.15 ** (m - k) for k in range(x)) < 1e-6
        assert x > 0.5 * m or m < 64
