"""Removal of passages that an earlier document already holds, by parsing documents against indexed reference blocks.

The parse is that of relative Lempel-Ziv: a document is read from left to
right, and where the reference holds the next `width` words in an earlier
document, the factor is extended greedily, word by word, as long as both texts
agree. The parse goes on with the last window that crosses the factor's end,
so a window that lies in one earlier document on its left and in another on its
right is looked up by itself. Factors of at least `width` words are the
duplicate spans; whatever they leave has no window that an earlier document
holds.

The reference is the corpus itself. Its texts are cut into segments, and every
segment goes to one block by its anchor: the first word triple of the rarest
kind (by its corpus count) with the smallest hash among the triples of a
window. Equal windows have equal anchors, so a window's only block holds every
other window of the same words, and a document meets the blocks that hold its
own anchors instead of all of them: the work is linear in the text. Segments
overlap by `width - 1` words; an anchor stands for about six windows, so a word
travels three times, as a number into its record's word list.

Words are compared as words everywhere. Hashes only choose blocks and propose
equal windows; a window that shares a hash but not its words is told apart.

Hot text costs a block no more than other text: equal segments of one run of
about RUN_WORDS words are sent once, from their smallest doc_id, and a passage's
own triples, which are frequent, stand for windows inside the passage only, as
a window that crosses its edge has rarer ones.

Defined results: null text has no words; documents of fewer than `width` words
lose nothing; rows with the same doc_id don't take words from each other; null
doc_ids come after all others (2**63 - 1 counts as one of them); an empty table
gives an empty result. Columns other than doc_id and text are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meterbook.llm import text as texts
from meterbook.llm.frequent import Weights, most_frequent
from meterbook.llm.workspace import stored

WIDTH = 13
#: Words of an anchor.
ANCHOR = 3
#: Words that a task deals at once; a longer document is dealt alone.
RUN_WORDS = 2 << 20
#: Bytes of text for each reference block.
BLOCK_BYTES = 10 << 20
#: Most frequent anchors whose counts are used for the order (16 bytes each in every task).
FREQUENT = 1 << 20
#: Factors are broadcast up to this size and joined by shuffle beyond.
BROADCAST_BYTES = 32 << 20
_LAST = np.iinfo(np.int64).max


def _leftmost_least(x: np.ndarray, width: int) -> np.ndarray:
    """The place of the leftmost smallest of each `width` entries in a row."""
    place, size = np.arange(len(x), dtype=np.int32 if len(x) <= np.iinfo(np.int32).max else np.int64), 1
    while size < width:
        step = min(size, width - size)
        left, right = place[: len(place) - step], place[step:]
        place = np.where(x[right] < x[left], right, left)
        size += step
    return place


@dataclass
class Segments:
    """Runs of windows with one anchor: word numbers of the first word, length in words, document's number, anchor's hash."""

    first: np.ndarray
    length: np.ndarray
    document: np.ndarray
    anchor: np.ndarray


def _grams(words: texts.Words, size: int) -> np.ndarray:
    """The hash of the words from each word on, `size` of them, across documents too."""
    n = len(words.codes) - size + 1
    h = np.zeros(max(0, n), np.uint64)
    for k in range(size if n > 0 else 0):
        h = h * np.uint64(0x9E3779B97F4A7C15) + words.codes[k : k + n]
    return texts.mix(h)


def segments_of(words: texts.Words, width: int, weights: Weights) -> Segments:
    size = min(ANCHOR, width)
    n = len(words.codes) - width + 1
    if n <= 0:
        none = np.zeros(0, np.int64)
        return Segments(none, none, none, none.astype(np.uint64))
    grams = _grams(words, size)
    # Rarest kind first, then the smallest hash, then the leftmost place: the same in every chunk, so equal windows have equal anchors.
    kind = np.minimum(31, np.ceil(np.log2(1 + weights.of(grams)))).astype(np.uint64)
    place = _leftmost_least(kind << np.uint64(59) | grams >> np.uint64(5), width - size + 1)[:n].astype(np.int64)
    document = words.document()
    at = np.flatnonzero(document[:n] == document[width - 1 :])
    place = place[at]
    edges = np.flatnonzero(np.diff(place, prepend=-1))
    last = np.append(edges[1:], len(at)) - 1
    first = at[edges]
    return Segments(first, at[last] + width - first, document[first], grams[place[edges]])


def _anchor_weights(documents: DataFrame, width: int, limit: int) -> tuple[np.ndarray, np.ndarray]:
    """The word triples that occur most often: a run of RUN_WORDS words reports those that it holds more than once."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[np.ndarray] = []

        def flush() -> pa.RecordBatch:
            values, counts = np.unique(np.concatenate(kept), return_counts=True)
            kept.clear()
            return pa.record_batch([pa.array(texts.signed(values[counts > 1])), pa.array(counts[counts > 1])], ["value", "n"])

        for batch in batches:
            for part in texts.chunks(batch):
                words = texts.words_of(part.column("text"))
                grams = _grams(words, min(ANCHOR, width))
                kept.append(grams[words.document()[: len(grams)] == words.document()[len(words.codes) - len(grams) :]])
                if sum(map(len, kept)) >= RUN_WORDS:
                    yield flush()
        if kept:
            yield flush()

    return most_frequent(documents.select("text").mapInArrow(count, "value long, n long"), 64, limit)


def _flat(first: np.ndarray, length: np.ndarray) -> np.ndarray:
    """first[0], first[0] + 1, ... for `length[0]` numbers, then the same from first[1], and so on."""
    start = np.cumsum(length) - length
    return np.arange(int(length.sum())) + np.repeat(first - start, length)


def _equal(ids: np.ndarray, a: np.ndarray, b: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Whether the words from a on equal those from b on, `length` of each."""
    same = np.ones(len(a), bool)
    for k in range(int(length.max(initial=0))):
        at = np.flatnonzero(same & (length > k))
        same[at] = ids[a[at] + k] == ids[b[at] + k]
    return same


def _leaders(codes: np.ndarray, equal) -> np.ndarray:
    """For each place the first place that equals it; codes propose, equal(places, others) decides."""
    leader = np.arange(len(codes))
    order = np.argsort(codes, kind="stable")
    group = np.cumsum(np.diff(codes[order], prepend=codes[order[:1]] ^ np.uint64(1)) != 0)
    while len(order):
        first = np.flatnonzero(np.diff(group, prepend=-1))
        head = order[first][np.repeat(np.arange(len(first)), np.diff(np.append(first, len(order))))]
        others = head != order
        order, head, group = order[others], head[others], group[others]
        same = equal(order, head)
        leader[order[same]] = head[same]
        # Places that only share a code are grouped among themselves.
        order, group = order[~same], group[~same]
    return leader


def _substring_codes(codes: np.ndarray, first: np.ndarray, length: np.ndarray) -> np.ndarray:
    up, down = texts.power_tables(len(codes) + 1)
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(codes * up[: len(codes)], dtype=np.uint64)])
    return texts.mix((total[first + length] - total[first]) * down[first] + length.astype(np.uint64))


def merged(owner: np.ndarray, mark: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, ...]:
    """Spans of each document that overlap or touch as one, by document and place."""
    if not len(owner):
        return owner, mark, start, end
    order = np.lexsort((start, mark, owner))
    owner, mark, start, end = owner[order], mark[order], start[order].astype(np.int64), end[order].astype(np.int64)
    other = np.ones(len(owner), bool)
    other[1:] = (owner[1:] != owner[:-1]) | (mark[1:] != mark[:-1])
    base = np.cumsum(other) * (int(end.max()) + 2)
    reach = np.maximum.accumulate(end + base)
    new = np.ones(len(owner), bool)
    new[1:] = start[1:] + base[1:] > reach[:-1]
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(owner)) - 1
    return owner[first], mark[first], start[first].astype(np.int32), (reach[last] - base[last]).astype(np.int32)


def _buckets(owner: np.ndarray, mark: np.ndarray, start: np.ndarray, end: np.ndarray, n: int) -> tuple[list[int], list[bytes]]:
    """Merged spans packed by bucket of their document."""
    owner, mark, start, end = merged(owner, mark, start, end)
    bucket = (texts.mix(owner.view(np.uint64) ^ texts.mix(mark.view(np.uint64))) % np.uint64(n)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    edges = np.flatnonzero(np.diff(bucket[order], prepend=-1)).tolist()
    parts = [order[a:b] for a, b in zip(edges, [*edges[1:], len(order)], strict=False)]
    return [int(bucket[p[0]]) for p in parts], [b"".join(x[p].tobytes() for x in (owner, mark, start, end)) for p in parts]


def _unbucket(bodies: list[bytes]) -> tuple[np.ndarray, ...]:
    columns: tuple[list, ...] = ([], [], [], [])
    for body in bodies:
        n, at = len(body) // 24, 0
        for column, kind in zip(columns, (np.int64, np.int64, np.int32, np.int32), strict=True):
            column.append(np.frombuffer(body, kind, n, at))
            at += n * np.dtype(kind).itemsize
    return tuple(np.concatenate(c) for c in columns)


#: The arrays of a record: owners' differences, marks, places, lengths, word numbers, bytes of each listed word, and all of these bytes.
_KINDS = (np.int64, np.int64, np.int32, np.int32, np.int32, np.int32, np.uint8)


def _pack(*arrays: np.ndarray) -> bytes:
    """Compressed byte planes of arrays of the kinds of a record."""
    planes = [np.ascontiguousarray(x.astype(kind).view(np.uint8).reshape(len(x), -1).T).tobytes() for x, kind in zip(arrays, _KINDS, strict=True)]
    body = b"".join([np.array([len(x) for x in arrays], np.int64).tobytes(), *planes])
    return len(body).to_bytes(8, "little") + pa.compress(body, "zstd", asbytes=True)


def _unpack(packed: bytes) -> list[np.ndarray]:
    body = pa.decompress(packed[8:], int.from_bytes(packed[:8], "little"), "zstd", asbytes=True)
    at, found = 8 * len(_KINDS), []
    for n, kind in zip(np.frombuffer(body, np.int64, len(_KINDS)).tolist(), _KINDS, strict=True):
        size = np.dtype(kind).itemsize
        found.append(np.ascontiguousarray(np.frombuffer(body, np.uint8, n * size, at).reshape(size, n).T).view(kind).reshape(n))
        at += n * size
    return found


def _record(owner: np.ndarray, mark: np.ndarray, at: np.ndarray, length: np.ndarray, ids: np.ndarray, dictionary: pa.Array) -> bytes:
    """Segments with their words as numbers into the words that they use, frequent ones first."""
    if len(ids) * 16 > len(dictionary):
        counts = np.bincount(ids, minlength=len(dictionary))
        used = np.flatnonzero(counts)
        counts, place = counts[used], ids
        number = np.empty(len(dictionary), np.int32)
    else:
        used, place, counts = np.unique(ids, return_inverse=True, return_counts=True)
        number = np.empty(len(used), np.int32)
    order = np.argsort(-counts, kind="stable")
    number[used[order] if place is ids else order] = np.arange(len(used), dtype=np.int32)
    own = dictionary.take(pa.array(used[order]))
    ends = np.frombuffer(own.buffers()[1], np.int32)[own.offset : own.offset + len(own) + 1]
    words = np.frombuffer(own.buffers()[2], np.uint8)[ends[0] : ends[-1]]
    return _pack(np.diff(owner, prepend=0), mark, at, length, number[place], np.diff(ends), words)


def _batch(rows: list[tuple[int, bytes]]) -> pa.RecordBatch:
    return pa.record_batch([pa.array([k for k, _ in rows], pa.int64()), pa.array([x for _, x in rows], pa.binary())], ["block", "body"])


def _binaries(lengths: np.ndarray, body: np.ndarray) -> pa.Array:
    ends = np.zeros(len(lengths) + 1, np.int32)
    np.cumsum(lengths, out=ends[1:])
    return pa.BinaryArray.from_buffers(pa.binary(), len(lengths), [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(body))])


class _Run:
    """The words and segments of about RUN_WORDS words of documents."""

    def __init__(self, width: int, weights: Weights):
        self.width, self.weights, self.n = width, weights, 0
        self.parts: list[tuple] = []

    def add(self, part: pa.RecordBatch) -> None:
        words = texts.words_of(part.column("text"))
        found = segments_of(words, self.width, self.weights)
        body = words.data[~texts.SPACE[words.data]]
        listed = _binaries(words.end - words.start, body)
        owner = part.column("doc_id").fill_null(int(_LAST)).to_numpy()[found.document]
        mark = part.column("mark").to_numpy()[found.document]
        self.parts.append((listed, words.codes, found.first + self.n, found.length, found.first - words.first[found.document], owner, mark, found.anchor))
        self.n += len(words.codes)

    def dealt(self, n_blocks: int) -> Iterator[pa.RecordBatch]:
        coded = pa.concat_arrays([p[0] for p in self.parts]).dictionary_encode()
        ids, dictionary = coded.indices.to_numpy(), coded.dictionary
        codes, first, length, at, owner, mark, anchor = (np.concatenate([p[i] for p in self.parts]) for i in range(1, 8))
        self.parts.clear()
        self.n = 0
        order = np.argsort(owner, kind="stable")
        first, length, at, owner, mark, anchor = (x[order] for x in (first, length, at, owner, mark, anchor))
        # A segment whose words an earlier document of the run holds as a segment is a factor already.
        leader = _leaders(_substring_codes(codes, first, length), lambda a, b: (length[a] == length[b]) & _equal(ids, first[a], first[b], np.minimum(length[a], length[b])))
        del codes
        held = owner[leader] < owner
        rows = [(n_blocks + b, body) for b, body in zip(*_buckets(owner[held], mark[held], at[held], (at + length)[held], n_blocks), strict=True)]
        if rows:
            yield _batch(rows)
        first, length, at, owner, mark, anchor = (x[~held] for x in (first, length, at, owner, mark, anchor))
        block = (texts.mix(anchor) % np.uint64(n_blocks)).astype(np.int64)
        order = np.argsort(block, kind="stable")
        edges = np.flatnonzero(np.diff(block[order], prepend=-1)).tolist()
        for a, b in zip(edges, [*edges[1:], len(order)], strict=False):
            s = order[a:b]
            yield _batch([(int(block[s[0]]), _record(owner[s], mark[s], at[s], length[s], ids[_flat(first[s], length[s])], dictionary))])


def parsed(ids: np.ndarray, length: np.ndarray, owner: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(segment, start, end) of the factors of at least `width` words, for the segments of a block in order of their owners.

    The block's text is that of all segments one after the other; its index
    tells for each window the first place that holds the same words.
    """
    first = np.cumsum(length) - length
    count = np.maximum(0, length - width + 1)
    window = _flat(first, count)
    segment = np.repeat(np.arange(len(length)), count)
    n = max(0, len(ids) - width + 1)
    h = np.zeros(n, np.uint64)
    for k in range(width):
        h = h * np.uint64(0x9E3779B97F4A7C15) + ids[k : k + n].astype(np.uint64)
    index = _leaders(texts.mix(h)[window], lambda a, b: _equal(ids, window[a], window[b], np.full(len(a), width)))
    held = owner[segment[index]] < owner[segment]
    # The next held window from each window on.
    following = np.minimum.accumulate(np.where(held, np.arange(len(held)), len(held))[::-1])[::-1]
    following = np.append(following, len(held))
    stop = np.cumsum(count)
    found: list[tuple[np.ndarray, ...]] = []
    at, of = following[stop - count], np.arange(len(length))
    while True:
        going = at < stop[of]
        at, of = at[going], of[going]
        if not len(at):
            break
        own, other = window[at], window[index[at]]
        room = np.minimum(first[of] + length[of] - own, (first + length)[segment[index[at]]] - other)
        size = np.full(len(at), width)
        growing = np.flatnonzero(size < room)
        while len(growing):
            growing = growing[ids[own[growing] + size[growing]] == ids[other[growing] + size[growing]]]
            size[growing] += 1
            growing = growing[size[growing] < room[growing]]
        found.append((of, own - first[of], own - first[of] + size))
        at = following[np.minimum(at + size - width + 1, len(held))]
    none = np.zeros(0, np.int64)
    return tuple(np.concatenate(x) for x in zip(*found, strict=True)) if found else (none, none, none)


def _block_factors(table: pa.Table, width: int, n_buckets: int) -> pa.Table:
    """Parses the segments of one block: packed factors by bucket of their document."""
    listed, ids, columns, base = [], [], [], 0
    for body in table.column("body"):
        owner, mark, at, length, own, sizes, words = _unpack(body.as_py())
        columns.append((np.cumsum(owner), mark, at, length))
        listed.append(_binaries(sizes, words))
        ids.append(own + np.int32(base))
        base += len(sizes)
    ids = pa.concat_arrays(listed).dictionary_encode().indices.to_numpy()[np.concatenate(ids)]
    owner, mark, at, length = (np.concatenate(x) for x in zip(*columns, strict=True))
    length = length.astype(np.int64)
    order = np.argsort(owner, kind="stable")
    ids = ids[_flat((np.cumsum(length) - length)[order], length[order])]
    owner, mark, at = owner[order], mark[order], at[order]
    segment, start, end = parsed(ids, length[order], owner, width)
    buckets, bodies = _buckets(owner[segment], mark[segment], at[segment] + start, at[segment] + end, n_buckets)
    return pa.table([pa.array(buckets, pa.int64()), pa.array(bodies, pa.binary())], names=["bucket", "body"])


def factors(documents: DataFrame, width: int = WIDTH) -> DataFrame:
    """doc_id, mark (hash of the text), starts and ends (packed int32 word numbers): every document's merged factors; doc_id is 2**63 - 1 where it is null."""
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("mark"), "text")
    n_bytes = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n_blocks = max(1, -(-n_bytes // BLOCK_BYTES))
    shared = documents.sparkSession.sparkContext.broadcast(_anchor_weights(rows, width, FREQUENT))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        run = _Run(width, Weights(*shared.value))
        for batch in batches:
            for part in texts.chunks(batch):
                run.add(part)
                if run.n >= RUN_WORDS:
                    yield from run.dealt(n_blocks)
        if run.n:
            yield from run.dealt(n_blocks)

    def parse(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        block = key[0].as_py()
        if block < n_blocks:
            return _block_factors(table, width, n_blocks)
        return pa.table([pa.array([block - n_blocks] * table.num_rows, pa.int64()), table.column("body")], names=["bucket", "body"])

    def gather(table: pa.Table) -> pa.Table:
        owner, mark, start, end = merged(*_unbucket(table.column("body").to_pylist()))
        new = np.ones(len(owner), bool)
        new[1:] = (owner[1:] != owner[:-1]) | (mark[1:] != mark[:-1])
        first = np.flatnonzero(new)
        cut = [(a, b) for a, b in zip(first.tolist(), [*first[1:].tolist(), len(owner)], strict=False)]
        return pa.table([pa.array(owner[first]), pa.array(mark[first]), pa.array([start[a:b].tobytes() for a, b in cut], pa.binary()), pa.array([end[a:b].tobytes() for a, b in cut], pa.binary())], names=["doc_id", "mark", "starts", "ends"])

    found = rows.mapInArrow(deal, "block long, body binary").groupBy("block").applyInArrow(parse, "bucket long, body binary")
    return found.groupBy("bucket").applyInArrow(gather, "doc_id long, mark long, starts binary, ends binary")


def without_duplicates(documents: DataFrame, width: int = WIDTH, with_text: bool = True, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 and, if asked for, kept: the remaining words joined by single spaces."""
    found = stored(factors(documents, width), "factors")
    size = found.agg(F.sum(F.octet_length("starts") + F.octet_length("ends") + 64)).first()[0] or 0
    marked = found.select(F.col("doc_id").alias("f_id"), F.col("mark").alias("f_mark"), "starts", "ends")
    marked = F.broadcast(marked) if size <= broadcast_bytes else marked.hint("merge")
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("mark"), "text")
    rows = rows.join(marked, (F.col("mark") == F.col("f_mark")) & (F.coalesce("doc_id", F.lit(int(_LAST))) == F.col("f_id")), "left").select("doc_id", "text", "starts", "ends")

    def drop(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns: list[list] = [[], [], [], []]
            for text, starts, ends in zip(batch.column("text"), batch.column("starts"), batch.column("ends"), strict=True):
                words = (text.as_py() or "").encode().split()
                n, left = len(words), words
                if starts.is_valid:
                    left, at = [], 0
                    for a, b in zip(np.frombuffer(starts.as_py(), np.int32).tolist(), np.frombuffer(ends.as_py(), np.int32).tolist(), strict=True):
                        left += words[at:a]
                        at = b
                    left += words[at:]
                kept = b" ".join(left)
                for column, value in zip(columns, (n, n - len(left), hashlib.sha256(kept).hexdigest(), kept.decode() if with_text else None), strict=True):
                    column.append(value)
            arrays = [batch.column("doc_id"), pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.string()), pa.array(columns[3], pa.string())]
            yield pa.record_batch(arrays[: 5 if with_text else 4], ["doc_id", "n_words", "n_removed", "kept_sha256", "kept"][: 5 if with_text else 4])

    return rows.mapInArrow(drop, "doc_id long, n_words long, n_removed long, kept_sha256 string" + (", kept string" if with_text else ""))
