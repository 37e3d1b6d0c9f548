from __future__ import annotations

import itertools
import zlib
from collections import Counter, defaultdict

import corpus_cases as cases
import numpy as np
import public_tokenizers
from meterbook.llm import packing
from tokenizers import Tokenizer

PATH = public_tokenizers.path("byte_bpe_50k.json")


def _ids(texts: list[str | None]) -> list[np.ndarray]:
    tokenizer = Tokenizer.from_file(PATH)
    return [np.array([*e.ids, 0], "<u4") for e in tokenizer.encode_batch([t or "" for t in texts], add_special_tokens=False)]


def test_ids_match_the_library(spark):
    texts = [t for _, t, _ in cases.texts()] + ["a <|endoftext|> b<|endoftext|>", "<|endoftext|><|endoftext", "<|endoftext|> it's  \n\n x\t y 你好 é don't ' 12ab\r\n"]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    found = {r.doc_id: [] for r in docs.collect()}
    for r in packing.document_pieces(docs, PATH, with_ids=True).orderBy("doc_id", "piece").collect():
        assert r.start == len(found[r.doc_id])
        assert zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32
        found[r.doc_id] += r.ids
    for i, ids in enumerate(_ids(texts)):
        assert found[i] == ids.tolist()


def test_sequences(spark):
    docs = cases.documents(spark)
    rows = packing.pack(packing.document_pieces(docs, PATH), group_pieces=20).collect()
    expected = Counter()
    for (i, t, _), ids in zip(cases.texts(), _ids([t for _, t, _ in cases.texts()]), strict=True):
        first = len(ids) % 2048 or 2048
        for piece, (a, b) in enumerate(zip([0, *range(first, len(ids), 2048)], [*range(first, len(ids), 2048), len(ids)], strict=True)):
            expected[(i, piece, a, b - a, zlib.crc32(ids[a:b].tobytes()))] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == expected
    by_sequence = defaultdict(list)
    for r in rows:
        by_sequence[r.sequence_id].append((r.offset, r.length))
    for spans in by_sequence.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= 2048
    assert {type(r.proved) for r in rows} == {bool}
    total = sum(r.length for r in rows)
    assert len(by_sequence) <= -(-total // 2048) + 4


def test_search_beats_best_fit():
    # Best fit leaves 6 + 2 and 5 + 3; the perfect packing takes three sequences.
    lengths = np.array([6, 4, 5, 5, 3, 3, 4])
    rng = np.random.default_rng(2)
    won = 0
    for _ in range(60):
        capacity, perfect = 100, []
        for _ in range(8):
            cuts = np.sort(rng.choice(np.arange(1, capacity), 2, replace=False))
            perfect += np.diff([0, *cuts, capacity]).tolist()
        lengths = np.array(perfect)
        found = packing.bin_completion(lengths, capacity)
        assert sorted(x for f in found for x in f) == sorted(perfect)
        assert all(sum(f) <= capacity for f in found)
        plain = packing.best_fit(lengths, capacity)
        assert len(found) <= len(plain)
        won += len(found) < len(plain)
    assert won > 10


def _plain_fillings(pieces: list[int], rest: int) -> set[tuple[int, tuple[int, ...]]]:
    """Undominated fillings, from all subsets and all exchanges."""
    subsets = lambda xs: {c for n in range(len(xs) + 1) for c in itertools.combinations(sorted(xs, reverse=True), n)}
    found = set()
    for filling in subsets(pieces):
        waste = rest - sum(filling)
        out = Counter(pieces) - Counter(filling)
        if waste >= 0 and not any(x >= sum(part) and x - sum(part) <= waste and part != (x,) for part in subsets(filling) for x in out):
            found.add((waste, filling))
    return found


def test_all_undominated_fillings():
    rng = np.random.default_rng(3)
    pieces_of = 0
    for _ in range(60):
        rest = int(rng.integers(10, 80))
        pieces = rng.integers(1, rest + 1, 9).tolist() if rng.random() < 0.3 else (1 + rng.integers(0, rest // 2, 9)).tolist()
        lengths = np.array(pieces)
        found = list(packing._fillings(np.bincount(lengths, minlength=rest + 1), rest, rest, packing._reachable(lengths, rest), [10**6]))
        assert [w for w, _ in found] == sorted(w for w, _ in found)
        assert sorted((w, tuple(f)) for w, f in found) == sorted(_plain_fillings(pieces, rest))
        pieces_of = max(pieces_of, *[len(f) for _, f in found])
    assert pieces_of >= 5
    lengths = np.array([*range(51, 71, 2), *range(31, 51, 2)])
    found = packing._fillings(np.bincount(lengths, minlength=101), 100, 0, packing._reachable(lengths, 100), [10**6])
    assert sum(len(f) == 2 for _, f in found) == 10


def test_fillings_of_more_than_two_pieces():
    lengths = np.array([90, 45, 43, 9, 6, 3, 2, 2])
    assert sorted(sorted(f) for f in packing.bin_completion(lengths, 100)) == [[2, 2, 6, 90], [3, 9, 43, 45]]
    # Perfect packings of 4 to 6 pieces a sequence.
    rng = np.random.default_rng(4)
    won = perfect = 0
    for i in range(30):
        cut = lambda: np.diff([0, *np.sort(rng.choice(np.arange(1, 1000), 3 + i % 3, replace=False)), 1000])  # noqa: B023, E731
        lengths = np.concatenate([cut() for _ in range(6)])
        found, plain = packing.bin_completion(lengths, 1000), packing.best_fit(lengths, 1000)
        assert sorted(x for f in found for x in f) == sorted(lengths.tolist())
        assert all(sum(f) <= 1000 for f in found)
        assert len(found) <= len(plain)
        won, perfect = won + (len(found) < len(plain)), perfect + (len(found) == 6)
    assert won == perfect == 30


def _fewest(lengths: list[int], capacity: int) -> int:
    """The least number of sequences, by trying every place of every piece."""
    best = [len(lengths)]

    def place(i: int, rooms: list[int]) -> None:
        if len(rooms) >= best[0]:
            return
        if i == len(lengths):
            best[0] = len(rooms)
            return
        for k in {r: k for k, r in enumerate(rooms) if r >= lengths[i]}.values():
            place(i + 1, [r - lengths[i] * (j == k) for j, r in enumerate(rooms)])
        place(i + 1, [*rooms, capacity - lengths[i]])

    place(0, [])
    return best[0]


def test_small_packings_are_optimal():
    pieces = np.array([5, 4, 3, 3])
    assert next(packing._fillings(np.bincount(pieces, minlength=11), 10, 10, packing._reachable(pieces, 10), [10**6])) == (0, [4, 3, 3])
    rng = np.random.default_rng(9)
    for _ in range(60):
        lengths = np.sort(rng.integers(1, 60, 9))[::-1]
        fewest = _fewest(lengths.tolist(), 100)
        assert packing.lower_bound(lengths, 100) <= fewest == len(packing.bin_completion(lengths, 100))


def test_empty(spark):
    assert packing.pack(packing.document_pieces(cases.empty(spark), PATH)).count() == 0
