from __future__ import annotations

import math
import re

import corpus_cases as cases
import numpy as np
import pyarrow as pa
from conftest import DATA
from meterbook.llm import toxicity
from pyspark.sql import functions as F


def test_held_out_accuracy(spark):
    sf_dir = DATA.replace("sf0.001", "sf0.01")
    documents, labels = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    fold = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    model = toxicity.train(documents, labels, ~fold)
    rows = toxicity.scored(documents, model).join(labels.where(fold), "doc_id").select("score", "toxic").collect()
    assert len(rows) > 40
    hits = sum((r.score >= 0.5) == bool(r.toxic) for r in rows)
    assert hits >= 0.9 * len(rows)
    assert all(0 <= r.score <= 1 for r in rows)


def test_finds_the_sentence(spark):
    rng = np.random.default_rng(1)
    mild = [f"word{i}" for i in range(40)]
    rows, labels = [], []
    for i in range(400):
        sentences = [" ".join(rng.choice(mild, 6)) for _ in range(4)]
        if i % 2:
            sentences[int(rng.integers(4))] += " vile"
        rows.append((i, ". ".join(sentences) + "."))
        labels.append((i, i % 2))
    documents = spark.createDataFrame(rows, "doc_id long, text string")
    model = toxicity.train(documents, spark.createDataFrame(labels, "doc_id long, toxic int"))
    scores = {r.doc_id: r.score for r in toxicity.scored(documents, model).collect()}
    assert np.mean([(scores[i] >= 0.5) == bool(i % 2) for i in scores]) >= 0.99
    found = toxicity.offending_sentences(documents, model).collect()
    texts = dict(rows)
    assert {r.doc_id for r in found} == {i for i in scores if i % 2}
    for r in found:
        assert r.sentence.endswith("vile")
        assert texts[r.doc_id].encode()[r.start : r.end].decode() == r.sentence


def test_awkward_rows(spark):
    docs = cases.documents(spark)
    labels = spark.createDataFrame([(0, 1, "x"), (0, 1, "x"), (1, None, "x"), (None, 1, "x"), (2, 7, "x"), (3, 0, "x")], "doc_id long, toxic int, text string")
    model = toxicity.train(docs, labels)
    rows = toxicity.scored(docs, model).collect()
    assert len(rows) == len(cases.texts())
    assert all(0 <= r.score <= 1 for r in rows)
    assert toxicity.offending_sentences(docs, model, 0.0).count() > 0
    nothing = toxicity.train(cases.empty(spark), labels.limit(0))
    assert toxicity.scored(cases.empty(spark), nothing).count() == 0
    assert toxicity.scored(docs, nothing).count() == len(rows)


def test_scores_against_plain_noisy_or(spark):
    """Every sentence's words, its logistic score and the document's noisy-or, one by one in plain Python."""
    texts = ["Vile thing here! A mild day.\nMild, mild vile", "", None, "a.b.c", "...", "no known words at all", "VILE vile\tViLe?", "mild " * 3000 + ". vile"]
    names = ["vile", "mild", "day", "thing"]
    codes = {w: int(toxicity.bags_of(pa.array([w])).code[0]) for w in names}
    weights = {w: x for w, x in zip(names, (3.5, -1.25, 0.5, 0.75), strict=True)}
    order = sorted(names, key=codes.get)
    model = toxicity.Model(np.array([codes[w] for w in order], np.uint64), np.array([weights[w] for w in order]), -2.0)
    rows = toxicity.scored(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), model).collect()
    for i, score in rows:
        clean = 1.0
        for sentence in re.split(r"[.!?\n]", texts[i] or ""):
            words = set(re.findall(r"[a-z0-9]+", sentence.lower()))
            if words:
                clean *= 1 - 1 / (1 + math.exp(2.0 - sum(weights.get(w, 0.0) for w in words)))
        assert abs(score - (1 - clean)) < 1e-12, texts[i]
    assert len(rows) == len(texts)


def test_gradient_finds_the_maximum():
    """No small step from the fitted weights raises the penalised likelihood."""
    rng = np.random.default_rng(5)
    sentence = np.repeat(np.arange(120), 3)
    code = rng.integers(0, 4, 360).astype(np.uint64)
    owner = np.repeat(np.arange(60), 2)
    labels = (rng.random(60) < 0.3 + 0.4 * np.isin(np.arange(60), owner[sentence[code == 2]])).astype(np.int32)
    model = toxicity.fit(labels, code, sentence, owner, steps=3000, rate=0.02, ridge=1e-2)

    def value(w: np.ndarray) -> float:
        clean = np.ones(60)
        for s in range(120):
            z = w[-1] + sum(w[:-1][np.searchsorted(model.features, c)] for c in code[sentence == s])
            clean[owner[s]] *= 1 - 1 / (1 + math.exp(-z))
        whole = np.clip(1 - clean, 1e-9, 1 - 1e-9)
        return float(np.mean(labels * np.log(whole) + (1 - labels) * np.log(1 - whole)) - 0.5e-2 * (w[:-1] ** 2).sum())

    fitted = np.append(model.weights, model.bias)
    assert all(value(fitted) >= value(fitted + step) - 1e-6 for step in rng.normal(0, 0.05, (40, len(fitted))))


def test_bounds_of_the_sample(spark):
    docs = spark.createDataFrame([(i, "vile words. " * 10 if i % 2 else "mild words. " * 10) for i in range(200)] + [(1000, "vile " * 5000), (3, None), (3, "")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(200)] + [(1000, 0)], "doc_id long, toxic int")
    whole = toxicity.train(docs, labels)
    # The document over the bound is passed over; half of the others fit.
    half = toxicity.train(docs, labels, text_bytes=12000)
    assert len(whole.features) == len(half.features) == 3
    few = toxicity.train(docs, labels, rows=5)
    assert len(few.features) == 0
    again = toxicity.train(docs, labels, text_bytes=12000)
    assert half.bias == again.bias or abs(half.bias - again.bias) < 1e-9
