"""Toxicity by multiple-instance learning.

A document is a bag of sentences. A sentence's probability is a logistic
function of its distinct words; the document's is the noisy-or of its
sentences'. The weights are trained from document labels alone, and the
sentence probabilities then say where a document is toxic.

Training uses at most TRAIN_ROWS labelled rows and TRAIN_BYTES of text: whole
documents in the order of the hash of their doc_id, as far as both bounds
reach (a document over TRAIN_BYTES is passed over). Their words are hashed on
the executors; the driver gets no more than the hashes. Words in fewer than
MIN_DOCUMENTS of these are left out. Scores read nothing but the text.

Defined results: null text counts as empty; a text without words scores 0;
labels that are null or neither 0 nor 1 are ignored; repeated rows give a row
each; without training rows every score is that of the initial bias; an empty
table gives an empty result. Columns other than doc_id and text are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from meterbook.llm import text as texts
from meterbook.llm.workspace import stored

TRAIN_ROWS = 8000
#: Bytes of text that training reads, in UTF-8.
TRAIN_BYTES = 48 << 20
MIN_DOCUMENTS = 8
_ENDS = np.zeros(256, bool)
_ENDS[[10, 33, 46, 63]] = True


@dataclass(frozen=True)
class Model:
    """features: sorted word hashes; weights: one for each; bias."""

    features: np.ndarray
    weights: np.ndarray
    bias: float


@dataclass
class Bags:
    """Distinct words of each sentence, for the documents of one Arrow array.

    code and sentence are parallel; owner is each sentence's document; begin
    and stop are its first and last word's bytes.
    """

    code: np.ndarray
    sentence: np.ndarray
    owner: np.ndarray
    begin: np.ndarray
    stop: np.ndarray
    words: texts.Words


def bags_of(column: pa.Array) -> Bags:
    words = texts.words_of(column, fold_case=True, separators=texts.NOT_ALPHANUMERIC)
    document = words.document()
    ends = np.concatenate([[0], np.cumsum(_ENDS[words.data])])
    after = ends[words.start] if len(words.start) else np.zeros(0, np.int64)
    new = np.ones(len(document), bool)
    new[1:] = (after[1:] != after[:-1]) | (document[1:] != document[:-1])
    sentence = np.cumsum(new) - 1
    at = np.flatnonzero(new)
    order = np.lexsort((words.codes, sentence))
    code, of = words.codes[order], sentence[order]
    keep = np.ones(len(code), bool)
    keep[1:] = (code[1:] != code[:-1]) | (of[1:] != of[:-1])
    last = np.concatenate([at[1:], [len(document)]]) - 1 if len(at) else at
    return Bags(code[keep], of[keep], document[at], words.start[at], words.end[last], words)


def sentence_scores(model: Model, bags: Bags) -> np.ndarray:
    """The probability of each sentence."""
    z = np.full(len(bags.owner), model.bias)
    if len(model.features):
        at = np.minimum(np.searchsorted(model.features, bags.code), len(model.features) - 1)
        hit = model.features[at] == bags.code
        z += np.bincount(bags.sentence[hit], model.weights[at[hit]], len(z))
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def noisy_or(p: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
    """1 - the product of (1 - p) over each owner's entries; 0 for owners without any."""
    return -np.expm1(np.bincount(owner, np.log1p(-np.minimum(p, 1 - 1e-13)), n))


def fit(labels: np.ndarray, code: np.ndarray, sentence: np.ndarray, owner: np.ndarray, steps: int = 300, rate: float = 0.1, ridge: float = 2e-4, bias: float = -5.0) -> Model:
    """Gradient ascent (Adam) on the likelihood of document labels under the noisy-or."""
    n = len(labels)
    pair = np.unique(np.stack([code, owner[sentence].astype(np.uint64)]), axis=1) if len(code) else np.zeros((2, 0), np.uint64)
    values, df = np.unique(pair[0], return_counts=True)
    features = values[df >= MIN_DOCUMENTS]
    if not n or not len(features):
        return Model(np.zeros(0, np.uint64), np.zeros(0), bias)
    at = np.minimum(np.searchsorted(features, code), len(features) - 1)
    hit = features[at] == code
    at, of = at[hit], sentence[hit]
    w = np.zeros(len(features) + 1)
    w[-1] = bias
    m, v = np.zeros_like(w), np.zeros_like(w)
    for step in range(1, steps + 1):
        z = np.full(len(owner), w[-1]) + np.bincount(of, w[at], len(owner))
        p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        whole = np.clip(noisy_or(p, owner, n), 1e-9, 1.0)
        slope = p * (labels / whole - 1)[owner]
        g = np.concatenate([np.bincount(at, slope[of], len(features)), [slope.sum()]]) / n
        g[:-1] -= ridge * w[:-1]
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w += rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-9)
    return Model(features, w[:-1], float(w[-1]))


def train(documents: DataFrame, labels: DataFrame, keep: Column | None = None, rows: int = TRAIN_ROWS, text_bytes: int = TRAIN_BYTES) -> Model:
    """A model from labels (doc_id, toxic), of which only rows for which keep holds are used; rows and text_bytes bound the sample."""
    known = labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull())
    known = known.where(keep) if keep is not None else known
    known = known.groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    sample = stored(known, "labelled")
    texts_of = documents.select("doc_id", "text")
    # At most `rows` ids, as in every table from here on: one task adds up their sizes.
    sizes = texts_of.join(F.broadcast(sample), "doc_id").groupBy("doc_id", "toxic").agg(F.count(F.lit(1)).alias("n"), F.sum(F.coalesce(F.octet_length("text"), F.lit(0))).alias("size"))
    so_far = Window.orderBy(F.xxhash64("doc_id"), "doc_id").rowsBetween(Window.unboundedPreceding, 0)
    sizes = sizes.where((F.col("size") <= text_bytes) & (F.col("n") <= rows)).select("doc_id", "toxic", F.sum("n").over(so_far).alias("n"), F.sum("size").over(so_far).alias("size"))
    taken = stored(sizes.where((F.col("n") <= rows) & (F.col("size") <= text_bytes)).select("doc_id", "toxic"), "taken")
    chosen = texts_of.join(F.broadcast(taken), "doc_id").select("toxic", "text")

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in texts.chunks(batch):
                b = bags_of(part.column("text"))
                yield pa.record_batch([pa.array([x.tobytes()]) for x in (part.column("toxic").to_numpy(), b.code, b.sentence, b.owner)], ["y", "code", "sentence", "owner"])

    y, code, sentence, owner, n_sentences, n = [], [], [], [], 0, 0
    for row in chosen.mapInArrow(hashed, "y binary, code binary, sentence binary, owner binary").collect():
        parts = [np.frombuffer(row[0], np.int32), np.frombuffer(row[1], np.uint64), np.frombuffer(row[2], np.int64), np.frombuffer(row[3], np.int64)]
        y.append(parts[0])
        code.append(parts[1])
        sentence.append(parts[2] + n_sentences)
        owner.append(parts[3] + n)
        n_sentences += len(parts[3])
        n += len(parts[0])
    join = lambda xs, kind: np.concatenate(xs) if xs else np.zeros(0, kind)
    return fit(join(y, np.int32), join(code, np.uint64), join(sentence, np.int64), join(owner, np.int64))


def scored(documents: DataFrame, model: Model) -> DataFrame:
    """doc_id and score of every document."""
    shared = documents.sparkSession.sparkContext.broadcast(model)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in texts.chunks(batch):
                bags = bags_of(part.column("text"))
                yield pa.record_batch([part.column("doc_id"), pa.array(noisy_or(sentence_scores(shared.value, bags), bags.owner, part.num_rows))], ["doc_id", "score"])

    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(score, "doc_id long, score double")


def offending_sentences(documents: DataFrame, model: Model, threshold: float = 0.5) -> DataFrame:
    """doc_id, start, end (bytes in UTF-8, from the first word to the last), sentence, score of sentences from the threshold."""
    shared = documents.sparkSession.sparkContext.broadcast(model)

    def locate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in texts.chunks(batch):
                bags = bags_of(part.column("text"))
                p = sentence_scores(shared.value, bags)
                at = np.flatnonzero(p >= threshold)
                data = bags.words.data.tobytes()
                owner = bags.owner[at]
                lengths = [len((t.as_py() or "").encode()) for t in part.column("text")]
                base = np.concatenate([[0], np.cumsum(lengths)])[owner] if len(at) else np.zeros(0, np.int64)
                sentences = [data[a:b].decode() for a, b in zip(bags.begin[at], bags.stop[at], strict=True)]
                ids = part.column("doc_id").take(pa.array(owner))
                yield pa.record_batch([ids, pa.array(bags.begin[at] - base), pa.array(bags.stop[at] - base), pa.array(sentences, pa.string()), pa.array(p[at])], ["doc_id", "start", "end", "sentence", "score"])

    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(locate, "doc_id long, start long, end long, sentence string, score double")
