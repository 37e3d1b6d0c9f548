from __future__ import annotations

import hashlib
import random
from collections import Counter

import corpus_cases as cases
import numpy as np
import pyarrow as pa
import pytest
from meterbook.llm import substring


def _expected(texts: list[tuple], width: int) -> Counter:
    last = 1 << 62
    held: dict[tuple, int] = {}
    for i, t, *_ in texts:
        w = cases.words(t)
        for k in range(len(w) - width + 1):
            g = tuple(w[k : k + width])
            held[g] = min(held.get(g, last), last if i is None else i)
    found = Counter()
    for i, t, *_ in texts:
        w = cases.words(t)
        gone = {k + j for k in range(len(w) - width + 1) if held[tuple(w[k : k + width])] < (last if i is None else i) for j in range(width)}
        kept = " ".join(x for k, x in enumerate(w) if k not in gone)
        found[(i, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest(), kept)] += 1
    return found


@pytest.mark.parametrize(("width", "broadcast", "block"), [(13, 1 << 25, 12 << 20), (5, 0, 4096)])
def test_against_brute_force(spark, monkeypatch, width, broadcast, block):
    monkeypatch.setattr(substring, "BLOCK_BYTES", block)
    rows = substring.without_duplicates(cases.documents(spark), width, broadcast_bytes=broadcast).collect()
    assert Counter((r.doc_id, r.n_words, r.n_removed, r.kept_sha256, r.kept) for r in rows) == _expected(cases.texts(), width)


def test_empty(spark):
    assert substring.without_duplicates(cases.empty(spark)).count() == 0


def _plain_factors(segments: list[tuple[int, list[int]]], width: int) -> set[tuple[int, int]]:
    """(segment, word) that a window of an earlier owner covers."""
    held: dict[tuple, int] = {}
    for owner, w in segments:
        for k in range(len(w) - width + 1):
            held[tuple(w[k : k + width])] = min(held.get(tuple(w[k : k + width]), owner), owner)
    return {(s, k + j) for s, (owner, w) in enumerate(segments) for k in range(len(w) - width + 1) if held[tuple(w[k : k + width])] < owner for j in range(width)}


def test_parse_is_greedy_and_checks_boundaries():
    """The third text crosses from the first into the second, over a window that only the second holds."""
    a, b = [1, 2, 3, 4, 5, 6], [4, 5, 6, 7, 8, 9]
    segments = [(1, a), (2, b), (3, [1, 2, 3, 4, 5, 6, 7, 8, 9]), (3, [9, 9, 9, 9])]
    segment, start, end = substring.parsed(np.array([x for _, w in segments for x in w]), np.array([len(w) for _, w in segments]), np.array([o for o, _ in segments]), 3)
    assert list(zip(segment.tolist(), start.tolist(), end.tolist(), strict=True)) == [(1, 0, 3), (2, 0, 6), (2, 4, 9)]


@pytest.mark.parametrize("collide", [False, True])
def test_parse_against_brute_force(monkeypatch, collide):
    """With every hash alike too: equal hashes remove nothing by themselves."""
    if collide:
        monkeypatch.setattr(substring.texts, "mix", lambda x: x & np.uint64(0))
    rng = random.Random(5)
    for _ in range(40):
        segments = sorted((rng.randrange(6), [rng.randrange(3) for _ in range(rng.randrange(1, 14))]) for _ in range(12))
        segment, start, end = substring.parsed(np.array([x for _, w in segments for x in w]), np.array([len(w) for _, w in segments]), np.array([o for o, _ in segments]), 4)
        assert {(s, k) for s, a, b in zip(segment.tolist(), start.tolist(), end.tolist(), strict=True) for k in range(a, b)} == _plain_factors(segments, 4)


def test_anchors_are_rare_and_shared():
    """Equal windows have equal anchors, and frequent triples give way to rarer ones."""
    rng = random.Random(6)
    passage = [f"p{i}" for i in range(30)]
    texts = [" ".join([*[f"w{rng.randrange(10**6)}" for _ in range(20)], *passage, *[f"w{rng.randrange(10**6)}" for _ in range(20)]]) for _ in range(20)]
    words = substring.texts.words_of(pa.array(texts))
    grams, counts = np.unique(substring._grams(words, 3), return_counts=True)
    for weights in (substring.Weights(grams[:0], counts[:0]), substring.Weights(grams[counts > 5], counts[counts > 5])):
        found = substring.segments_of(words, 13, weights)
        spans = [(int(k), texts[d].split()[f - words.first[d] : f - words.first[d] + n]) for f, n, d, k in zip(found.first, found.length, found.document, found.anchor, strict=True)]
        assert sum(len(w) - 12 for _, w in spans) == sum(len(t.split()) - 12 for t in texts)
        of: dict[tuple, set[int]] = {}
        for k, w in spans:
            for i in range(len(w) - 12):
                of.setdefault(tuple(w[i : i + 13]), set()).add(k)
        assert all(len(k) == 1 for k in of.values())
    contexts = Counter(k for k, w in {(k, tuple(w)) for k, w in spans})
    assert max(contexts.values()) <= 2


def test_anchors_do_not_follow_the_chunk(monkeypatch):
    """A window has the same anchor in a short chunk and in a long one, even where triples differ in few bits of their hashes only."""
    grams = substring._grams
    monkeypatch.setattr(substring, "_grams", lambda words, size: grams(words, size) & np.uint64(0xFFFFF))
    rng = random.Random(7)
    passage = " ".join(f"p{rng.randrange(10**6)}" for _ in range(200))
    none = substring.Weights(np.zeros(0, np.uint64), np.zeros(0, np.int64))

    def anchors(texts: list[str]) -> list[int]:
        found = substring.segments_of(substring.texts.words_of(pa.array(texts)), 13, none)
        return [int(a) for n, d, a in zip(found.length, found.document, found.anchor, strict=True) if d == 0 for _ in range(n - 12)]

    assert anchors([passage]) == anchors([passage, " ".join(f"w{rng.randrange(10**6)}" for _ in range(20000))])


def test_leftmost_least():
    rng = np.random.default_rng(8)
    for width in range(1, 14):
        x = rng.integers(0, 4, 60).astype(np.uint64)
        assert substring._leftmost_least(x, width).tolist() == [k + int(np.argmin(x[k : k + width])) for k in range(60 - width + 1)]
