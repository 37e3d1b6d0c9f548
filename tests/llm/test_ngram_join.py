from __future__ import annotations

import random
from collections import Counter

import corpus_cases as cases
import numpy as np
import pyarrow as pa
import pytest
from meterbook.llm import ngram_join
from meterbook.llm.components import components
from meterbook.llm.ngram_join import Similarity


def _set(text: str | None, width: int) -> frozenset:
    w = cases.words("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    if not w:
        return frozenset()
    return frozenset(tuple(w[i : i + width]) for i in range(len(w) - width + 1)) or frozenset([tuple(w)])


def _components(texts: list[tuple], like: Similarity) -> list[int]:
    sets = [_set(t[1], like.width) for t in texts]
    parent = list(range(len(texts)))

    def root(i: int) -> int:
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            if sets[i] and sets[j] and like.whole * len(sets[i] & sets[j]) >= like.part * len(sets[i] | sets[j]):
                parent[root(i)] = root(j)
    return [root(i) for i in range(len(texts))]


def _expected(texts: list[tuple], like: Similarity) -> Counter:
    of = _components(texts, like)
    least: dict[int, int | None] = {}
    for (i, t, *_), c in zip(texts, of, strict=True):
        if _set(t, like.width):
            least[c] = min([x for x in (least.get(c), i) if x is not None], default=None)
    return Counter((t[0], len(_set(t[1], like.width)), least[c] if _set(t[1], like.width) else t[0]) for t, c in zip(texts, of, strict=True))


@pytest.mark.parametrize(("like", "broadcast"), [(Similarity(3, 90, 100), 1 << 25), (Similarity(5, 80, 100), 0)])
def test_components(spark, like, broadcast):
    found = ngram_join.ngram_components(cases.documents(spark), like, broadcast_bytes=broadcast)
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in found.collect()) == _expected(cases.texts(), like)


def test_family_of_near_copies(spark, monkeypatch):
    """Chains of copies, most of which link with few others, with small groups and cells."""
    monkeypatch.setattr(ngram_join, "GROUP_CLASSES", 8)
    monkeypatch.setattr(ngram_join, "CELL_QUERIES", 16)
    monkeypatch.setattr(ngram_join, "LEADER_ROUNDS", 1)
    rng = random.Random(3)
    original = cases.prose(rng, 150).split()
    texts = []
    for i in range(150):
        w = list(original)
        for _ in range(rng.choice([1, 2, 4, 5, 6])):
            w[rng.randrange(len(w))] = f"own{i % 40}x{rng.randrange(3)}"
        texts.append((i, " ".join(w)))
    like = Similarity(3, 90, 100)
    docs = spark.createDataFrame(texts, "doc_id long, text string").repartition(3)
    found = ngram_join.ngram_components(docs, like, rounds=1)
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in found.collect()) == _expected(texts, like)


def test_one_of_each(spark):
    like = Similarity(5, 80, 100)
    docs = cases.documents(spark)
    kept = ngram_join.one_of_each(docs, like)
    assert kept.columns == docs.columns
    texts = cases.texts()
    of = _components(texts, like)
    worded = [i for i, t in enumerate(texts) if _set(t[1], 5)]
    found = [(r.doc_id, r.text) for r in kept.collect()]
    assert len(found) == len({of[i] for i in worded}) + len(texts) - len(worded)
    first: dict[int, tuple] = {}
    for i in worded:
        first[of[i]] = min(first.get(of[i], (True, 0)), (texts[i][0] is None, texts[i][0] or 0))
    assert Counter(i for i, t in found if _set(t, 5)) == Counter(None if none else i for none, i in first.values())


def test_cell_bound_and_links():
    sets = [np.array(x, np.uint64) for x in ([1, 2, 3, 4], [1, 2, 3, 4, 5], [1, 2, 3, 4, 6], [7, 8])]
    keys, query, part = np.array([10, 11, 12, 13]), np.array([True, False, False, True]), np.array([1, 2, 3, 4])
    assert ngram_join.compare_cell(keys, query, part, sets, Similarity(3, 80, 100)) == [(10, 11), (10, 12)]
    assert ngram_join.compare_cell(keys, query, np.array([1, 2, 2, 4]), sets, Similarity(3, 80, 100)) == [(10, 11)]


def test_long_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(300)] + [(1000, 1000), (500, 501)], "a long, b long")
    found = {r.node: r.component for r in components(edges).collect()}
    assert {found.get(i, i) for i in range(301)} == {0}
    assert found[501] == 500


def test_empty(spark):
    assert ngram_join.ngram_components(cases.empty(spark)).count() == 0
    assert ngram_join.one_of_each(cases.empty(spark)).count() == 0


@pytest.mark.parametrize("like", [Similarity(3, 90, 100), Similarity(5, 80, 100), Similarity(3, 1, 2)])
def test_compact_sets_rule_out_no_link(like):
    """Every link of the whole sets passes the bound, and unrelated sets don't."""
    rng = random.Random(8)
    base = [[f"w{rng.randrange(10**6)}" for _ in range(rng.choice([4, 40, 400]))] for _ in range(8)]
    rows = []
    for w in base:
        for _ in range(6):
            x = list(w)
            for _ in range(rng.randrange(1 + len(x) // 12)):
                x[rng.randrange(len(x))] = "new"
            rows.append(" ".join(x))
    sets = ngram_join.sets_of(pa.array(rows), like.width)
    whole = [sets.codes[a:b] for a, b in zip(sets.first[:-1], sets.first[1:], strict=True)]
    compact = [np.frombuffer(b, np.uint32) for b in sets.compact(like.compact_bits)]
    query = np.array([i % 2 == 0 for i in range(len(rows))])
    part = keys = np.arange(len(rows))
    may = ngram_join.open_cell(query, part, sets.sizes, compact, like)
    links = ngram_join.compare_cell(keys, query, part, whole, like)
    assert len(links) > 10
    assert all(may[a] and may[b] for a, b in links)
    for q in np.flatnonzero(query & (sets.sizes > 100)):
        others = [i for i in range(len(rows)) if i // 6 != q // 6 and not query[i]]
        alone = ngram_join.open_cell(np.array([True] + [False] * len(others)), np.arange(1 + len(others)), sets.sizes[[q, *others]], [compact[i] for i in (q, *others)], like)
        assert not alone.any()
