"""Vectorised word hashing over Arrow string columns.

A word is a maximal run of bytes other than space and ``\\x09-\\x0D``; in
UTF-8 this equals the regular expression ``[^\\x20\\x09-\\x0D]+``. Words are
hashed from prefix sums modulo 2**64, so no Python object is made per word.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Text bytes handled at once inside a task; a longer document is taken alone.
CHUNK_BYTES = 1 << 20

_BASE = np.uint64(0x9E3779B97F4A7C15)
#: The bytes between words.
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
#: Every ASCII byte that is neither a letter nor a digit.
NOT_ALPHANUMERIC = np.array([i < 128 and not chr(i).isalnum() for i in range(256)])
_FOLD = np.arange(256)
_FOLD[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser, so that low and high bits are both usable."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95))
_powers: list[np.ndarray] = []


def power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the hash's base and of its inverse."""
    if not _powers or len(_powers[0]) < n:
        size = 1 << max(20, int(n - 1).bit_length())
        inverse = np.uint64(pow(int(_BASE), -1, 1 << 64))
        up, down = np.full(size, _BASE), np.full(size, inverse)
        up[0] = down[0] = 1
        _powers[:] = [np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)]
    return _powers[0][:n], _powers[1][:n]


@dataclass
class Words:
    """Words of some documents in order.

    first has one more entry than there are documents: words ``first[i]`` to
    ``first[i + 1]`` (exclusive) are document i's. start and end are byte
    offsets in data; codes are 64-bit hashes.
    """

    data: np.ndarray
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray
    codes: np.ndarray

    def document(self) -> np.ndarray:
        """The document's index for each word."""
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))

    def windows(self, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(hash, first word's index, document's index) of each run of width words inside a document."""
        n = len(self.codes) - width + 1
        if n <= 0:
            none = np.zeros(0, np.int64)
            return none.astype(np.uint64), none, none
        h = np.zeros(n, np.uint64)
        for k in range(width):
            h = h * _BASE + self.codes[k : k + n]
        document = self.document()
        at = np.flatnonzero(document[:n] == document[width - 1 :])
        return mix(h[at]), at, document[at]


def words_of(texts: pa.Array, fold_case: bool = False, separators: np.ndarray = SPACE) -> Words:
    """Words of each text; null counts as empty. fold_case lower-cases A-Z; separators marks the bytes between words."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    if texts.offset:
        texts = pa.concat_arrays([texts, texts.slice(0, 0)]) if len(texts) else texts
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    lo, hi = int(offsets[0]), int(offsets[-1])
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[lo:hi]
    bounds = offsets - lo
    ink = np.zeros(len(data) + 1, bool)
    ink[:-1] = ~separators[data]
    before = np.zeros(len(data) + 1, bool)
    before[1:] = ink[:-1]
    edge = np.zeros(len(data) + 1, bool)
    edge[bounds] = True
    start = np.flatnonzero(ink & (~before | edge))
    end = np.flatnonzero(before & (~ink | edge))
    up, down = power_tables(len(data) + 1)
    table = _BYTE[_FOLD] if fold_case else _BYTE
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(table[data] * up[:-1], out=total[1:], dtype=np.uint64)
    codes = mix((total[end] - total[start]) * down[start] + (end - start).astype(np.uint64))
    return Words(data, start, end, np.searchsorted(start, bounds), codes)


def chunks(batch: pa.RecordBatch, text: str = "text") -> Iterator[pa.RecordBatch]:
    """Slices of at most CHUNK_BYTES of text, at least one row each."""
    sizes = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False)
    ends = np.cumsum(sizes)
    at = 0
    while at < len(sizes):
        done = ends[at - 1] if at else 0
        stop = max(at + 1, int(np.searchsorted(ends, done + CHUNK_BYTES, side="right")))
        yield batch.slice(at, stop - at)
        at = stop


def signed(x: np.ndarray) -> np.ndarray:
    """Bits of unsigned hashes as Spark's long."""
    return x.view(np.int64)
