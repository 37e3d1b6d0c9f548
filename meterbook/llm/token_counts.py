"""Token counts under a unigram model, by dynamic programming shared along a trie.

Distinct pre-tokens (words with the word mark before them) go into a trie that
a task keeps from batch to batch: the forward score of a prefix is computed
when a word first needs it and stored at its node. Words are visited in sorted
order, so the path they share is walked once. At a word's end its token count
is stored; documents then add up stored counts. A trie of more than
KEPT_PREFIXES nodes takes no more of them (what is not kept is computed again)
and is begun anew with the next batch.

The forward score of a prefix is the best sum of log-probabilities over its
segmentations into vocabulary pieces; of equal sums the one with fewer tokens
counts. A character that is no piece costs one token for each of its UTF-8
bytes.

Defined results: null and empty texts have no tokens; repeated rows give a row
each; an empty table gives an empty result. Columns other than doc_id and text
are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meterbook.llm.text import chunks

MARK = "▁"
#: Words whose counts a worker keeps.
KEPT_WORDS = 300_000
#: Nodes of a worker's trie.
KEPT_PREFIXES = 500_000


def rank_scores(model_path: str) -> dict[str, float]:
    """Log-probabilities by Zipf's law from the order of pieces in a sentencepiece vocabulary file.

    Control, unknown and byte pieces are left out.
    """
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=model_path)
    pieces = [model.id_to_piece(i) for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
    all_mass = math.log(sum(1 / (r + 1) for r in range(len(pieces))))
    return {p: -math.log(r + 1) - all_mass for r, p in enumerate(pieces)}


class TrieCounter:
    """A trie of words with the forward score and the tokens of each prefix; steps counts the scores computed."""

    def __init__(self, scores: dict[str, float], kept: int = KEPT_PREFIXES):
        self.scores = scores
        self.kept = kept
        self.longest = max(map(len, scores), default=1)
        self.byte_score = min(scores.values(), default=0.0) - 1.0
        self.steps = 0
        self._clear()

    def _clear(self) -> None:
        # A child's key is its parent's number and its character; a node that is not kept has number -1 and no children.
        self.child: dict[int, int] = {}
        self.best, self.tokens = [0.0], [0]

    def counts(self, words: Iterable[str]) -> Iterator[tuple[str, int]]:
        """(word, tokens) for distinct words; sorts them first."""
        if len(self.best) >= self.kept:
            self._clear()
        # The nodes of the current word's prefixes, their scores and tokens.
        path, nodes, best, tokens = "", [0], [0.0], [0]
        for word in sorted(words):
            marked = MARK + word
            shared = 0
            for a, b in zip(path, marked, strict=False):
                if a != b:
                    break
                shared += 1
            del nodes[shared + 1 :], best[shared + 1 :], tokens[shared + 1 :]
            for i in range(shared + 1, len(marked) + 1):
                key = nodes[-1] << 21 | ord(marked[i - 1])
                node = self.child.get(key)
                if node is None:
                    top, count = self._forward(marked, i, best, tokens)
                    node = -1
                    if nodes[-1] >= 0 and len(self.best) < self.kept:
                        node = self.child[key] = len(self.best)
                        self.best.append(top)
                        self.tokens.append(count)
                else:
                    top, count = self.best[node], self.tokens[node]
                nodes.append(node)
                best.append(top)
                tokens.append(count)
            path = marked
            yield word, tokens[-1]

    def _forward(self, marked: str, i: int, best: list[float], tokens: list[int]) -> tuple[float, int]:
        """The best sum and the tokens of the first i characters, from those of shorter prefixes."""
        self.steps += 1
        scores = self.scores
        top, count = None, 0
        if marked[i - 1] not in scores:
            n = len(marked[i - 1].encode())
            top, count = best[i - 1] + n * self.byte_score, tokens[i - 1] + n
        for j in range(max(0, i - self.longest), i):
            s = scores.get(marked[j:i])
            if s is not None:
                s += best[j]
                if top is None or s > top or (s == top and tokens[j] + 1 < count):
                    top, count = s, tokens[j] + 1
        return top, count


def token_counts(documents: DataFrame, scores: dict[str, float]) -> DataFrame:
    """doc_id, n_words, n_tokens for every document."""
    shared = documents.sparkSession.sparkContext.broadcast(scores)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter, known = TrieCounter(shared.value), {}
        for batch in batches:
            for part in chunks(batch):
                texts = [(t.as_py() or "").encode().split() for t in part.column("text")]
                new = {w for t in texts for w in t if w not in known}
                if len(known) + len(new) > KEPT_WORDS:
                    known.clear()
                    new = {w for t in texts for w in t}
                known.update((w.encode(), n) for w, n in counter.counts(w.decode() for w in new))
                totals = [sum(map(known.__getitem__, t)) for t in texts]
                yield pa.record_batch([part.column("doc_id"), pa.array([len(t) for t in texts], pa.int64()), pa.array(totals, pa.int64())], ["doc_id", "n_words", "n_tokens"])

    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(count, "doc_id long, n_words long, n_tokens long")
