"""Packing documents into sequences of bounded length by bin completion.

Documents are tokenized where they lie; only lengths and checksums move. A
document longer than a sequence is cut so that its last pieces are full and
the first one takes the rest. Full pieces are sequences of their own. The
others are dealt into groups of bounded size, and each group is packed by a
branch-and-bound search: around the largest piece left, the undominated
fillings of the rest of its sequence are tried by growing waste; a branch is
left when its waste shows that it can't beat the incumbent. Fillings of any
number of pieces are enumerated, as they are asked for. The first incumbent
is the best-fit decreasing packing; the search ends at the lower bound on the
number of sequences or at its budget (NODES, STEPS) and returns the incumbent.
The column proved tells whether a piece's group has met the lower bound, so
that no packing of the group takes fewer sequences.

Added tokens of the vocabulary (such as `<|endoftext|>`) in a text become their
own id, as `tokenizers` has it with add_special_tokens=False.

Defined results: null text counts as empty; an empty text is the end token
alone; repeated rows and null doc_ids are packed row by row; an empty table
gives an empty result. Columns other than doc_id and text are ignored.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meterbook.llm.workspace import stored

#: The pre-tokenization pattern of byte-level BPE vocabularies of this family (fixed value).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
#: Pieces that one task packs together.
GROUP_PIECES = 4096
#: Groups that one task packs one after another, and the tasks up to which each group gets one of its own.
TASK_GROUPS = 64
LEAST_TASKS = 1024
#: Search nodes for each group, besides one descent.
NODES = 4000
#: Pieces placed while looking for fillings, for each search node of the budget.
STEPS = 100

_encoders: dict[int, object] = {}


def byte_level_encoder(vocabulary: bytes):
    """An encoder for a byte-level BPE vocabulary file in the JSON format of `tokenizers`. Added tokens must be plain ones, which match as they stand."""
    import tiktoken

    key = zlib.crc32(vocabulary)
    if key not in _encoders:
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        hidden = [b for b in range(256) if b not in set(shown)]
        byte_of = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}
        spec = json.loads(vocabulary)
        added = spec.get("added_tokens", [])
        if any(t.get(flag) for t in added for flag in ("single_word", "lstrip", "rstrip", "normalized")):
            raise ValueError("added tokens that match by their surroundings are not supported")
        special = {t["content"]: t["id"] for t in added}
        ranks = {bytes(byte_of[c] for c in token): rank for token, rank in spec["model"]["vocab"].items() if token not in special}
        _encoders[key] = tiktoken.Encoding("byte_level", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=special)
    return lambda text: _encoders[key].encode(text, allowed_special="all")


def document_pieces(documents: DataFrame, vocabulary_path: str, capacity: int = 2048, end_id: int = 0, with_ids: bool = False) -> DataFrame:
    """Pieces of every document: doc_id, piece, start, length, ids_crc32, and ids if asked for."""
    with open(vocabulary_path, "rb") as f:
        shared = documents.sparkSession.sparkContext.broadcast(f.read())

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = byte_level_encoder(shared.value)
        for batch in batches:
            out: list[list] = [[], [], [], [], [], []]
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                ids = np.array([*encode(text.as_py() or ""), end_id], "<u4")
                first = len(ids) % capacity or capacity
                starts = [0, *range(first, len(ids), capacity)]
                for piece, (a, b) in enumerate(zip(starts, [*starts[1:], len(ids)], strict=True)):
                    for column, value in zip(out, (doc_id, piece, a, b - a, zlib.crc32(ids[a:b].tobytes()), ids[a:b].astype("i4") if with_ids else None), strict=True):
                        column.append(value)
            types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int32())]
            arrays = [pa.array(v, t) for v, t in zip(out, types, strict=True)][: 6 if with_ids else 5]
            yield pa.record_batch(arrays, ["doc_id", "piece", "start", "length", "ids_crc32", "ids"][: len(arrays)])

    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(cut, PIECES + (", ids array<int>" if with_ids else ""))


def best_fit(lengths: np.ndarray, capacity: int) -> list[list[int]]:
    """Best-fit decreasing: each sequence's lengths."""
    room: list[list[list[int]]] = [[] for _ in range(capacity + 1)]
    open_at = np.zeros(capacity + 1, bool)
    bins: list[list[int]] = []
    for x in np.sort(lengths)[::-1].tolist():
        fits = int(np.argmax(open_at[x:])) + x
        if not open_at[fits]:
            bins.append([])
            chosen, fits = bins[-1], capacity
        else:
            chosen = room[fits].pop()
            open_at[fits] = bool(room[fits])
        chosen.append(x)
        room[fits - x].append(chosen)
        open_at[fits - x] = True
    return bins


def _reachable(lengths: np.ndarray, capacity: int) -> list[int]:
    """For each length, the sums (as bits) that pieces of at most that length make."""
    counts, full = np.bincount(lengths, minlength=capacity + 1).tolist(), (1 << capacity + 1) - 1
    sums, found = 1, []
    for x, n in enumerate(counts):
        k = 1
        while x and n:
            k = min(k, n)
            sums |= sums << x * k & full
            n, k = n - k, 2 * k
        found.append(sums)
    return found


def _spread(bits: int, width: int) -> int:
    """The bits moved up by 0, 1 and so on to width."""
    done = 1
    while done <= width:
        step = min(done, width + 1 - done)
        bits |= bits << step
        done += step
    return bits


def _fillings(left: np.ndarray, rest: int, most_waste: int, reach: list[int], steps: list[int]) -> Iterator[tuple[int, list[int]]]:
    """All undominated fillings of rest from the multiset left (counts by length), by waste and then number of pieces: (waste, lengths).

    A filling is dominated if a piece left out fits instead of some of its
    pieces and is no smaller than their sum; equal single pieces don't count.
    Pieces are placed in falling order, so whatever can replace placed ones is
    already left out, and a dominated beginning is not gone on with.
    steps[0] falls with every piece placed; at 0 there are no more fillings.
    """
    counts = left[: rest + 1].tolist()
    sizes = np.flatnonzero(left[: rest + 1])
    largest = np.zeros(rest + 1, np.int64)
    largest[sizes] = sizes
    largest = np.maximum.accumulate(largest).tolist()
    free = sum(1 << x for x in sizes.tolist())
    smallest, at_most = (int(sizes[0]), int(left[sizes].sum())) if len(sizes) else (1, 0)
    for waste, n in ((w, n) for w in range(min(rest, most_waste) + 1) for n in range(min((rest - w) // smallest, at_most) + 1)):
        # Next length to try, room, and the sums of one and of several placed pieces.
        room = rest - waste
        frames, filling = [[largest[room], room, 0, 0]], []
        while frames:
            x, room, one, many = frames[-1]
            more = n - len(filling)
            if room == more == 0 and not free & (2 << waste) - 2:
                yield waste, filling.copy()
            # What pieces of at most this length can't make, shorter ones can't either.
            if not room or not more or not x or more * x < room or not reach[x] >> room & 1:
                frames.pop()
                if filling:
                    x = filling.pop()
                    counts[x] += 1
                    free |= 1 << x
                continue
            frames[-1][0] = largest[x - 1]
            if not counts[x] or room - x < (more - 1) * smallest:
                continue
            if steps[0] <= 0:
                return
            steps[0] -= 1
            one, many = one | 1 << x, many | (one | many) << x
            others = free if counts[x] > 1 else free ^ 1 << x
            if (_spread(many, waste) | (_spread(one << 1, waste - 1) if waste else 0)) & others:
                continue
            counts[x] -= 1
            free = others
            filling.append(x)
            room -= x
            frames.append([largest[min(x, room)], room, one, many])


def _quick_fillings(left: np.ndarray, rest: int, most: int) -> list[tuple[int, list[int]]]:
    """Some fillings of rest from the multiset left (counts by length), by waste: (waste, lengths).

    For each first length only the largest second one that fits is taken; what
    then remains is filled with the largest that fits.
    """
    sizes = np.flatnonzero(left[: rest + 1])
    if not len(sizes):
        return [(rest, [])]
    largest = np.zeros(rest + 1, np.int64)
    largest[sizes] = sizes
    largest = np.maximum.accumulate(largest)
    second = largest[np.minimum(sizes, rest - sizes)]
    same = (second == sizes) & (left[sizes] < 2)
    second[same] = largest[np.maximum(np.minimum(sizes[same] - 1, rest - sizes[same]), 0)]
    waste = rest - sizes - second
    # A pair is dominated by one that is no smaller in both lengths.
    best_so_far = np.maximum.accumulate(np.concatenate([[-1], second[::-1][:-1]]))[::-1]
    order = np.flatnonzero(second > best_so_far)
    order = order[np.argsort(waste[order], kind="stable")][: 4 * most]
    found = []
    for i in order.tolist():
        filling, room = [int(sizes[i])], int(rest - sizes[i])
        used = {filling[0]: 1}
        x = int(second[i])
        while x:
            filling.append(x)
            used[x] = used.get(x, 0) + 1
            room -= x
            x = int(largest[min(x, room)])
            while x and used.get(x, 0) >= left[x]:
                x = int(largest[x - 1])
        found.append((room, filling))
    return sorted(found, key=lambda f: (f[0], len(f[1])))[:most]


def lower_bound(lengths: np.ndarray, capacity: int) -> int:
    """No packing takes fewer sequences: for each least length k, pieces over capacity - k stand alone, those over half apart, and the others of k and more fill what is left."""
    if not len(lengths):
        return 0
    counts = np.bincount(lengths, minlength=capacity + 1)
    number = np.concatenate([[0], np.cumsum(counts)])
    total = np.concatenate([[0], np.cumsum(counts * np.arange(capacity + 1))])
    k = np.arange(1, capacity // 2 + 1)
    half = capacity // 2 + 1
    alone = number[-1] - number[capacity - k + 1]
    large, filled = number[capacity - k + 1] - number[half], total[capacity - k + 1] - total[half]
    rest = total[half] - total[k] - (large * capacity - filled)
    bounds = alone + large + np.maximum(0, -(-rest // capacity))
    return max(-(-int(total[-1]) // capacity), int(bounds.max(initial=0)))


def bin_completion(lengths: np.ndarray, capacity: int, nodes: int = NODES) -> list[list[int]]:
    """Sequences (lists of lengths) of the best packing found: a quick search improves best fit, then the search over all undominated fillings goes on from there."""
    return _search(lengths, capacity, nodes, _search(lengths, capacity, nodes, best_fit(lengths, capacity), True), False)


def _search(lengths: np.ndarray, capacity: int, nodes: int, incumbent: list[list[int]], quick: bool) -> list[list[int]]:
    total = int(lengths.sum())
    least = lower_bound(lengths, capacity)
    left = np.bincount(lengths, minlength=capacity + 1)
    budget = nodes + len(incumbent)
    steps = [STEPS * budget]
    reach = _reachable(lengths, capacity) if len(incumbent) > least and not quick else []

    def fillings(most_waste: int) -> Iterator[tuple[int, list[int]]]:
        top = int(np.flatnonzero(left)[-1])
        left[top] -= 1
        rest = left.copy()
        left[top] += 1
        if quick:
            return iter([(w, [top, *f]) for w, f in _quick_fillings(rest, capacity - top, 8)])
        return ((w, [top, *f]) for w, f in _fillings(rest, capacity - top, most_waste, reach, steps))

    while len(incumbent) > least and budget > 0:
        # Look for a packing with one sequence less: its waste in all is known.
        allowed = (len(incumbent) - 1) * capacity - total
        path: list[tuple[int, list[int]]] = []
        wasted, packed = 0, 0
        choices = [fillings(allowed)]
        improved = False
        while choices and budget > 0:
            option = next(choices[-1], None)
            if option is None or wasted + option[0] > allowed:
                choices.pop()
                if path:
                    w, f = path.pop()
                    wasted -= w
                    packed -= len(f)
                    np.add.at(left, f, 1)
                continue
            budget -= 1
            w, f = option
            path.append(option)
            wasted += w
            packed += len(f)
            np.subtract.at(left, f, 1)
            if packed == len(lengths):
                incumbent, improved = [f for _, f in path], True
                break
            if capacity * (len(incumbent) - 1 - len(path)) < total + wasted - capacity * len(path):
                choices.append(iter(()))
            else:
                choices.append(fillings(allowed - wasted))
        for _, f in path:
            np.add.at(left, f, 1)
        if not improved:
            break
    return incumbent


def pack(pieces: DataFrame, capacity: int = 2048, group_pieces: int = GROUP_PIECES, nodes: int = NODES) -> DataFrame:
    """pieces with sequence_id, offset and proved."""
    pieces = stored(pieces, "pieces")
    full = pieces.where(F.col("length") >= capacity)
    full = full.select("*", F.expr("shiftleft(1L, 62) + monotonically_increasing_id()").alias("sequence_id"), F.lit(0).cast("long").alias("offset"), F.lit(True).alias("proved"))
    loose = pieces.where(F.col("length") < capacity)
    groups = max(1, -(-loose.count() // group_pieces))
    # A group is few bytes and much search: tasks are counted by groups, since adaptive execution would merge them by bytes.
    tasks = max(min(groups, LEAST_TASKS), -(-groups // TASK_GROUPS))
    loose = loose.withColumn("group", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(groups))).repartition(tasks, "group")

    def packed(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        lengths = table.column("length").to_numpy()
        rows: dict[int, list[int]] = {}
        for i, x in enumerate(lengths.tolist()):
            rows.setdefault(x, []).append(i)
        sequence, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
        found = bin_completion(lengths, capacity, nodes)
        proved = pa.array(np.full(len(lengths), len(found) == lower_bound(lengths, capacity)))
        for number, contents in enumerate(found):
            at = 0
            for x in contents:
                i = rows[x].pop()
                sequence[i], offset[i] = key[0].as_py() << 32 | number, at
                at += x
        return table.drop_columns(["group"]).append_column("sequence_id", pa.array(sequence)).append_column("offset", pa.array(offset)).append_column("proved", proved)

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema) + ", sequence_id long, offset long, proved boolean"
    return full.unionByName(loose.groupBy("group").applyInArrow(packed, schema))
