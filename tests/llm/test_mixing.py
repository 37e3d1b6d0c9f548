from __future__ import annotations

from collections import Counter, defaultdict

import corpus_cases as cases
from meterbook.llm import mixing


def _targets(sizes: dict, weights: dict, share: float, cap: float) -> dict:
    """Targets by handing out the rest again and again."""
    left, target, open_ = share * sum(sizes.values()), dict.fromkeys(sizes, 0.0), {s for s in sizes if weights[s] > 0}
    while open_ and left > 1e-9:
        total = sum(weights[s] for s in open_)
        full = {s for s in open_ if target[s] + left * weights[s] / total >= cap * sizes[s]}
        if not full:
            for s in open_:
                target[s] += left * weights[s] / total
            break
        for s in full:
            left -= cap * sizes[s] - target[s]
            target[s] = cap * sizes[s]
        open_ -= full
    return target


def test_mix(spark):
    docs = cases.documents(spark)
    sizes = defaultdict(int)
    for _, t, s in cases.texts():
        sizes[s] += len(cases.words(t))
    order = sorted([s for s in sizes if s is not None]) + [None]
    weights = {s: (3.0, 1.0, 2.0)[i % 3] for i, s in enumerate(order)}
    target = _targets(sizes, weights, 1.5, 2.0)
    run = lambda: [tuple(r) for r in mixing.taken_words(mixing.mix_sources(docs, mixing.repeating_weights(docs), block_words=16)).orderBy("doc_id", "size", "taken").collect()]
    rows = run()
    assert rows == run()
    assert Counter((r[0], r[1]) for r in rows) == Counter((i, len(cases.words(t))) for i, t, _ in cases.texts())
    assert all(0 <= r[4] <= 2 * r[1] for r in rows)
    by_target = defaultdict(int)
    for r in rows:
        by_target[(r[2], round(r[3], 6))] += r[4]
    wanted = defaultdict(int)
    for s in sizes:
        wanted[(sizes[s], round(target[s], 6))] += round(target[s])
    assert dict(by_target) == dict(wanted)
    assert abs(sum(target.values()) - 1.5 * sum(sizes.values())) < 1e-6


def test_mixed_documents(spark):
    docs = cases.documents(spark)
    mixture = mixing.mix_sources(docs, mixing.repeating_weights(docs), block_words=16)
    taken = Counter()
    for r in mixing.taken_words(mixture).collect():
        taken[r.doc_id] += r.taken
    mixed = mixing.mixed_documents(docs, mixture)
    assert mixed.columns == docs.columns
    whole = defaultdict(list)
    for i, t, _ in cases.texts():
        whole[i].append(cases.words(t))
    found = Counter()
    for r in mixed.collect():
        own = cases.words(r.text)
        found[r.doc_id] += len(own)
        assert r.key == "clash"

        def inside(part, full):
            it = iter(full)
            return all(w in it for w in part)

        assert any(inside(own, w) for w in whole[r.doc_id])
    assert {k: v for k, v in taken.items() if v} == dict(found)


def test_rows_that_differ_elsewhere(spark):
    text = "some words to take " * 10
    docs = spark.createDataFrame([(1, text, "x", "a"), (1, text, "y", "a"), (1, text, "y", "a")], "doc_id long, text string, lang string, source string")
    mixed = mixing.mixed_documents(docs, mixing.mix_sources(docs, mixing.repeating_weights(docs), share=2.0, block_words=7))
    assert Counter(r.lang for r in mixed.collect()) == Counter({"y": 4, "x": 2})


def test_permutation(spark):
    from pyspark.sql import functions as F

    for n in (1, 2, 17, 100):
        got = [r[0] for r in spark.range(n).select(mixing.permuted(F.col("id"), F.lit(n), F.lit("k"))).collect()]
        assert sorted(got) == list(range(n))


def test_empty(spark):
    docs = cases.empty(spark)
    mixture = mixing.mix_sources(docs, mixing.repeating_weights(docs))
    assert mixing.taken_words(mixture).count() == 0
    assert mixing.mixed_documents(docs, mixture).count() == 0
