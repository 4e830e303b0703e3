"""Words and rolling hashes of whole Arrow columns of texts, with NumPy and without a loop over words.

A column of texts is one run of bytes with offsets. A word is a run of bytes other than the
six ASCII blanks ``\\x20 \\x09-\\x0D``; bytes of longer UTF-8 characters are never blanks, so
words of bytes are words of characters. A word's hash is a sum with a random number for every byte and place.
Hashes of neighbours are polynomials over the ring of 64-bit integers, mixed at the end; these are for spans of
up to some hundred places, as longer ones can differ by a multiple of 2**64 whatever the numbers are (Thue-Morse
words of 1,024 letters do). Equal strings have equal hashes in every process.
"""

from __future__ import annotations

import ctypes
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
_RATIO = U64(0x9E3779B97F4A7C15 | 5)
_INVERSE = U64(pow(int(_RATIO), -1, 1 << 64))
_BYTES = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=U64)
_BLANK = np.zeros(256, bool)
_BLANK[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_powers = {"up": np.ones(1, U64), "down": np.ones(1, U64)}


def _grown(kind: str, n: int) -> np.ndarray:
    if len(_powers[kind]) < n:
        steps = np.full(max(n, 2 * len(_powers[kind])), _RATIO if kind == "up" else _INVERSE, U64)
        steps[0] = 1
        _powers[kind] = np.cumprod(steps)
    return _powers[kind][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """Spread every input bit over all 64 output bits."""
    x = x ^ (x >> U64(30))
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def flat(column: pa.Array | pa.ChunkedArray, lower: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets (length + 1) of a text column; a missing text counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    column = pc.fill_null(column.cast(pa.large_binary()), b"")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, where, data = column.buffers()
    offsets = np.frombuffer(where, np.int64)[column.offset:column.offset + len(column) + 1]
    values = np.frombuffer(data, np.uint8)[offsets[0]:offsets[-1]] if data else np.zeros(0, np.uint8)
    return (_LOWER[values] if lower else values), offsets - offsets[0]


def span_hash(weights: np.ndarray, start: np.ndarray | slice, stop: np.ndarray | slice) -> np.ndarray:
    """Hash of ``weights[start:stop]`` for each pair of positions, from one running sum."""
    n = len(weights)
    total = np.zeros(n + 1, U64)
    np.multiply(weights, _grown("up", n), out=total[1:])
    np.cumsum(total, out=total)
    out = total[stop] - total[start]
    out *= _grown("down", n + 1)[start]
    return mix(out)


#: Words that are hashed together.
_WORDS = 1 << 15


@dataclass
class Words:
    """Words of a text column: ``start``/``stop`` in bytes, ``first[d]:first[d + 1]`` the words of text d."""

    data: np.ndarray
    start: np.ndarray
    stop: np.ndarray
    first: np.ndarray

    def hashes(self) -> np.ndarray:
        out = np.empty(len(self.start), U64)
        for a in range(0, len(out), _WORDS):
            own = slice(a, a + _WORDS)
            low, high = self.start[a], self.stop[own][-1]
            start, stop = self.start[own] - low, self.stop[own] - low
            begin = np.zeros(high - low, np.int64)
            begin[start] = start
            place = (np.arange(high - low) - np.maximum.accumulate(begin)).view(U64)
            place *= _RATIO
            place += _BYTES[self.data[low:high]]
            total = np.zeros(high - low + 1, U64)
            np.cumsum(mix(place), out=total[1:])
            out[own] = mix(total[stop] - total[start])
        return out

    def counts(self) -> np.ndarray:
        return np.diff(self.first)


def words(column: pa.Array | pa.ChunkedArray, lower: bool = False) -> Words:
    data, offsets = flat(column, lower)
    solid = ~_BLANK[data]
    begins, ends = solid.copy(), solid.copy()
    begins[1:] &= ~solid[:-1]
    ends[:-1] &= ~solid[1:]
    edges = offsets[(offsets > 0) & (offsets < len(data))]
    begins[edges] |= solid[edges]
    ends[edges - 1] |= solid[edges - 1]
    start = np.flatnonzero(begins)
    return Words(data, start, np.flatnonzero(ends) + 1, np.searchsorted(start, offsets))


def gram_hashes(hashes: np.ndarray, size: int) -> np.ndarray:
    """Hash of ``size`` neighbours at every position at which so many follow (texts are not told apart)."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.zeros(0, U64)
    return span_hash(hashes, slice(0, n), slice(size, size + n))


def inside(first: np.ndarray, size: int) -> np.ndarray:
    """Which of ``gram_hashes``' positions begin a window that stays within its text."""
    total = int(first[-1])
    n = max(0, total - size + 1)
    ends = np.repeat(first[1:], np.diff(first))[:n]
    return np.arange(size, size + n) <= ends


def byte_grams(data: np.ndarray, size: int) -> np.ndarray:
    return gram_hashes(_BYTES[data], size)


def covered(begins: np.ndarray, size: int) -> np.ndarray:
    """Mask of the positions that lie in ``[b, b + size)`` of some position b that is marked."""
    count = np.cumsum(begins, dtype=np.int64)
    count[size:] -= count[:-size].copy()
    return count > 0


def marked(positions: np.ndarray, total: int) -> np.ndarray:
    out = np.zeros(total, bool)
    out[positions] = True
    return out


#: Rows of an Arrow batch. Texts are long rows; the usual ten thousand would be some dozens of megabytes.
BATCH_ROWS = 512


def small_batches(spark) -> None:
    """Let the session send few rows at a time to Python workers, on either side the memory of one batch."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= BATCH_ROWS:
        spark.conf.set(name, str(BATCH_ROWS))


_trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it


def give_back() -> None:
    """Return freed memory to the system: a worker lives on, and what it once needed would count against the executor for good."""
    pa.default_memory_pool().release_unused()
    if _trim:
        _trim(0)


_slot: list = [None, None, None]


def kept(name: str, of, build):
    """What ``build()`` makes of ``of``, kept for the next task of this worker.

    A worker keeps one such thing at a time: one of an operator whose stage is over makes room for that of the next.
    """
    if _slot[0] != name or not (_slot[1] is of or (isinstance(of, str) and _slot[1] == of)):
        forget()
        _slot[:] = name, of, build()
    return _slot[2]


def forget() -> None:
    """Drop what this worker keeps."""
    if _slot[0] is not None:
        _slot[:] = None, None, None
        give_back()


def pieces(batches, rows: int = BATCH_ROWS):
    """The batches in slices of a few rows each, so that what is made of one stays small; at the end memory is given back."""
    try:
        for batch in batches:
            for at in range(0, batch.num_rows, rows):
                yield batch.slice(at, rows)
    finally:
        give_back()


#: Bytes of text that are looked at together where each byte takes much memory.
PIECE_BYTES = 1 << 20


def sized(batches, column: int, most: int = PIECE_BYTES, rows: int = BATCH_ROWS):
    """``pieces`` that end where the texts of a column pass another ``most`` bytes; a longer text is a piece by itself."""
    for batch in pieces(batches, rows):
        upto = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        edges = np.flatnonzero(np.diff(upto // most)) + 1
        for a, b in zip([0, *edges], [*edges, batch.num_rows], strict=True):
            yield batch.slice(a, b - a)
