from __future__ import annotations

import sys
from collections import Counter, defaultdict

import corpus_cases as cases
import corpus_pipeline
import test_cascade
import test_ngram_join
import test_packing
from meterbook.llm.ngram_join import Similarity


def test_stages_one_after_the_other(spark, tmp_path):
    """Each stage's result against plain Python over what the stage before it kept."""
    docs = cases.documents(spark).select("doc_id", "text", "lang", "source", "n_chars")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    results = []
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, str(tmp_path)).write.parquet(f"{tmp_path}/{name}")
        before, docs = docs, spark.read.parquet(f"{tmp_path}/{name}")
        if name != "packing":
            assert docs.columns == before.columns
        results.append(docs.collect())
    quality, near, personal, mixed, packed = results

    assert Counter((r.doc_id, r.text) for r in quality) == Counter((i, t) for i, t, _ in cases.texts() if test_cascade._kept(t)[1])

    rows = [(r.doc_id, r.text) for r in quality]
    of = test_ngram_join._components(rows, Similarity(5, 80, 100))
    assert len(near) == len(set(of))
    least = {}
    for (i, _), c in zip(rows, of, strict=True):
        least[c] = min(least.get(c, (True, 0)), (i is None, i or 0))
    assert Counter((r.doc_id is None, r.doc_id or 0) for r in near) == Counter(least.values())

    assert Counter(r.doc_id for r in personal) == Counter(r.doc_id for r in near)
    assert not any("jane.doe@example.org" in r.text or "4111 1111" in r.text for r in personal)
    assert all(r.n_chars == len(r.text) for r in personal + mixed)

    sizes, taken = Counter(), Counter()
    for r in personal:
        sizes[r.source] += len(cases.words(r.text))
    for r in mixed:
        taken[r.source] += len(cases.words(r.text))
    assert abs(sum(taken.values()) - 1.5 * sum(sizes.values())) <= len(sizes)
    assert all(taken[s] <= 2 * sizes[s] for s in sizes)

    ids = test_packing._ids([r.text for r in mixed])
    by_sequence = defaultdict(list)
    for r in packed:
        by_sequence[r.sequence_id].append((r.offset, r.length))
    assert sum(map(len, ids)) == sum(r.length for r in packed)
    assert all(sum(n for _, n in x) <= 2048 for x in by_sequence.values())


def test_run_is_the_stages(spark, tmp_path):
    cases.documents(spark).select("doc_id", "text", "lang", "source", "n_chars").write.parquet(f"{tmp_path}/documents.parquet")
    a = corpus_pipeline.run(spark, str(tmp_path))
    b = corpus_pipeline.run(spark, str(tmp_path))
    key = lambda df: Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in df.collect())
    assert key(a) == key(b)
    assert sys.modules["corpus_pipeline"].ORACLE_SQL is None
