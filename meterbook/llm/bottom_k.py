"""Near duplicates by bottom-k sketches of one hash function.

1. Sketch. Of each set of shingles the `size` smallest hashes are retained; a
   set with no more shingles than that is retained whole. Documents with equal
   sets form a class.
2. Inverted lists. Two sets that are similar enough share at least `shared`
   retained values, whatever the others are; so, in any order of the values,
   they share one of the first `retained - shared + 1` of each. The order is by
   frequency, rare ones first: values that many texts hold, as those of a
   common passage, open no lists but those of sets made of them. Classes that
   share lists are compared with the lists' leaders first and, where they are
   not connected then, in cells of bounded size (see ngram_join).
3. Union sketch. The smallest values of the union of two sketches are a sample of
   the sets' union; the share of it that both hold estimates their similarity.
   Pairs whose estimate is too low are ruled out.
4. Exact Jaccard. What is left is compared by the whole sets.

Sketches rule out a pair at the threshold with a probability of at most `loss`
(Chernoff's bound; a pair above it less likely), and none whose sets are
retained whole. A link is reported only if the whole sets confirm it.

Defined results: as in ngram_join; kept is whether a document's id is that of
its component (true where both are null).
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meterbook.llm import ngram_join, text as texts
from meterbook.llm.frequent import most_frequent
from meterbook.llm.ngram_join import Sets, Similarity


@dataclass(frozen=True)
class Sketches:
    """Bottom-k sketches as the screen of a similarity join."""

    like: Similarity
    size: int = 64
    loss: float = 1e-9

    @cached_property
    def shared(self) -> np.ndarray:
        """shared[m]: the least number that two similar sets share of m values drawn from their union."""
        t, limit = self.like.part / self.like.whole, math.log(1 / self.loss)
        least = np.zeros(2 * self.size + 1, np.int64)
        for m in range(1, len(least)):
            x = least[m - 1]
            while x < t * m and m * _divergence(x / m, t) > limit:
                x += 1
            least[m] = x
        return least

    def retained(self, sets: Sets) -> Sets:
        """The smallest values of each set; a set's codes are in ascending order."""
        rank = np.arange(len(sets.codes)) - sets.first[sets.owner()]
        return Sets(sets.codes[rank < self.size], np.concatenate([np.zeros(1, np.int64), np.cumsum(np.minimum(sets.sizes, self.size))]))

    def kept(self, sets: Sets) -> list[bytes]:
        own = self.retained(sets)
        return [own.codes[a:b].tobytes() for a, b in zip(own.first[:-1].tolist(), own.first[1:].tolist(), strict=True)]

    def lists(self, sizes: np.ndarray) -> np.ndarray:
        """The number of a set's values that are looked up, by its size."""
        whole = self.like.least(sizes)
        meets_larger = sizes * self.like.whole > self.size * self.like.part
        overlap = np.where(meets_larger, np.minimum(whole, self.shared[self.size]), whole)
        return np.minimum(sizes, self.size) - overlap + 1

    def leading(self, rows: DataFrame, classes: DataFrame, limit: int) -> DataFrame:
        """Everything is told by the stored sketches; texts aren't read again."""

        def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                values, n = np.unique(_sketches(batch)[0], return_counts=True)
                yield pa.record_batch([pa.array(texts.signed(values)), pa.array(n)], ["value", "n"])

        shared = classes.sparkSession.sparkContext.broadcast(most_frequent(classes.select("compact").mapInArrow(counted, "value long, n long"), 8, limit))

        def leading(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            values, weights = shared.value
            for batch in batches:
                codes, owner = _sketches(batch)
                key, n = batch.column("key").to_numpy(), batch.column("n").to_numpy()
                weight = np.zeros(len(codes), np.int64)
                if len(values):
                    at = np.minimum(np.searchsorted(values, codes), len(values) - 1)
                    weight = np.where(values[at] == codes, weights[at], 0)
                common = np.bincount(owner, np.log2(1 + weight), len(n)) * 100 / np.maximum(np.minimum(n, self.size), 1)
                order = np.lexsort((codes, weight, owner))
                codes, owner = codes[order], owner[order]
                lead = np.arange(len(owner)) - np.searchsorted(owner, owner) < self.lists(n)[owner]
                of = owner[lead]
                yield pa.record_batch([pa.array(texts.signed(codes[lead])), pa.array(key[of]), pa.array(n[of].astype(np.int32)), pa.array(common.astype(np.int32)[of])], ["shingle", "key", "n", "common"])

        return classes.select("key", "n", "compact").mapInArrow(leading, "shingle long, key long, n int, common int")

    def may(self, query: np.ndarray, part: np.ndarray, sizes: np.ndarray, kept: list[bytes]) -> np.ndarray:
        sketches = [np.frombuffer(b, np.uint64) for b in kept]
        members, may = np.flatnonzero(~query), np.zeros(len(query), bool)
        if not len(members) or not query.any():
            return may
        union, matrix = ngram_join._matrix([sketches[i] for i in members])
        up_to = np.concatenate([np.zeros((1, len(members)), np.int32), np.cumsum(matrix, axis=0, dtype=np.int32)])
        # A sketch tells which values up to its end a set holds; one that holds the whole set, all of them.
        end = np.array([s[-1] if n > self.size else np.uint64(2**64 - 1) for s, n in zip(sketches, sizes.tolist(), strict=True)], np.uint64)
        for q in np.flatnonzero(query).tolist():
            own, n = sketches[q], int(sizes[q])
            shared = matrix[ngram_join._hits(union, own)].sum(axis=0, dtype=np.int64)
            bound = np.minimum(end[q], end[members])
            drawn = np.searchsorted(own, bound, side="right") + up_to[np.searchsorted(union, bound, side="right"), np.arange(len(members))] - shared
            exact = (sizes[members] <= self.size) & (n <= self.size)
            small, large = np.minimum(n, sizes[members]), np.maximum(n, sizes[members])
            estimated = (shared >= self.shared[np.minimum(drawn, len(self.shared) - 1)]) & (self.like.whole * small >= self.like.part * large)
            passed = members[np.where(exact, self.like.link(shared, n, sizes[members]), estimated) & (part[members] != part[q])]
            may[passed] = True
            may[q] = len(passed) > 0
        return may


def _divergence(p: float, t: float) -> float:
    """The Kullback-Leibler divergence of two coins."""
    return sum(x * math.log(x / y) for x, y in ((p, t), (1 - p, 1 - t)) if x > 0)


def _sketches(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """The values of a batch's sketches, and the row of each."""
    bodies = [b.as_py() for b in batch.column("compact")]
    return np.frombuffer(b"".join(bodies), np.uint64), np.repeat(np.arange(len(bodies)), [len(b) // 8 for b in bodies])


def near_duplicates(documents: DataFrame, like: Similarity = Similarity(), size: int = 64, **more: int) -> DataFrame:  # noqa: B008
    """doc_id, mark (hash of the text), n_shingles, component, component_id, kept of every document."""
    found = ngram_join.ngram_components(documents, like, screen=Sketches(like, size), **more)
    return found.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
