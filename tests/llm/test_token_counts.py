from __future__ import annotations

from collections import Counter

import corpus_cases as cases
import public_tokenizers
from meterbook.llm import token_counts


def _plain(word: str, scores: dict[str, float]) -> int:
    """The forward pass for one word, with nothing shared."""
    lowest, best = min(scores.values()) - 1, [(0.0, 0)]
    marked = token_counts.MARK + word
    for i in range(1, len(marked) + 1):
        options = [(best[j][0] + scores[marked[j:i]], -(best[j][1] + 1)) for j in range(i) if marked[j:i] in scores]
        if marked[i - 1] not in scores:
            n = len(marked[i - 1].encode())
            options.append((best[i - 1][0] + n * lowest, -(best[i - 1][1] + n)))
        s, n = max(options)
        best.append((s, -n))
    return best[-1][1]


def test_against_plain_forward_pass(spark):
    scores = token_counts.rank_scores(public_tokenizers.path("piece_bpe_32k.model"))
    rows = token_counts.token_counts(cases.documents(spark), scores).collect()
    known: dict[str, int] = {}

    def count(word: str) -> int:
        if word not in known:
            known[word] = _plain(word, scores) if len(word) < 100 else -1
        return known[word]

    expected = Counter()
    for i, t, _ in cases.texts():
        w = cases.words(t)
        if all(len(x) < 100 for x in w):
            expected[(i, len(w), sum(map(count, w)))] += 1
    assert not expected - Counter((r.doc_id, r.n_words, r.n_tokens) for r in rows)
    assert len(rows) == len(cases.texts())


def test_long_words_against_plain_forward_pass():
    scores = token_counts.rank_scores(public_tokenizers.path("piece_bpe_32k.model"))
    words = ["a" * 150, "international" * 20, "x1y2é" * 40, "你好" * 60, "international" * 20 + "ly", "\U0001f600" * 100]
    assert dict(token_counts.TrieCounter(scores).counts(words)) == {w: _plain(w, scores) for w in words}


def test_prefixes_are_shared():
    counter = token_counts.TrieCounter({token_counts.MARK: -1.0, "ab": -1.0, "a": -2.0, "b": -2.0, "c": -2.0})
    assert dict(counter.counts(["abc", "abb", "ab"])) == {"ab": 2, "abb": 3, "abc": 3}
    assert counter.steps == 5
    assert dict(counter.counts(["abbc", "abc"])) == {"abbc": 4, "abc": 3}
    assert counter.steps == 6


def test_full_trie_gives_the_same_counts():
    scores = token_counts.rank_scores(public_tokenizers.path("piece_bpe_32k.model"))
    words = [w for _, t, _ in cases.texts() for w in cases.words(t) if len(w) < 100][:400]
    small = token_counts.TrieCounter(scores, kept=20)
    for some in (set(words[::2]), set(words[1::2]), set(words)):
        assert dict(small.counts(some)) == {w: _plain(w, scores) for w in some}
        assert len(small.best) <= 20


def test_empty(spark):
    assert token_counts.token_counts(cases.empty(spark), {"a": -1.0}).count() == 0
