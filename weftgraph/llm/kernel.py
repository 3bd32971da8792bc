"""Vectorised text kernels for Arrow batches: words, hashes, windows and window owners.

Every function works on the UTF-8 bytes of a slice of an Arrow batch.  Slices hold
a bounded number of bytes (one text at least), so memory doesn't depend on how many
rows Spark puts in a batch.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
#: White space of the word pattern ``[^\x20\x09-\x0D]+``.
SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_P, _Q = 0x9E3779B97F4A7C15 | 1, 0xD6E8FEB86659FD93 | 1
BYTE_VALUE = np.random.default_rng(20240607).integers(1, 2**63, 256, dtype=np.uint64) * U64(2) + U64(1)
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit moves every output bit."""
    h = h ^ (h >> U64(30))
    h = h * U64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> U64(27))
    h = h * U64(0x94D049BB133111EB)
    return h ^ (h >> U64(31))


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i below n at least."""
    have = _powers.get(base)
    if have is None or len(have[0]) < n:
        size = 1 << max(12, (n - 1).bit_length())
        one = np.ones(1, U64)
        up = np.cumprod(np.concatenate([one, np.full(size - 1, base, U64)]), dtype=U64)
        down = np.cumprod(np.concatenate([one, np.full(size - 1, pow(base, -1, 2**64), U64)]), dtype=U64)
        have = _powers[base] = (up, down)
    return have


class PrefixHash:
    """Polynomial hashes of any slice of a sequence of 64-bit values, by subtraction of prefixes."""

    def __init__(self, values: np.ndarray, base: int = _P):
        up, self.down = powers(base, len(values) + 1)
        self.sums = np.zeros(len(values) + 1, U64)
        np.cumsum(values * up[: len(values)], out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        length = (end - start).astype(U64)
        return mix((self.sums[end] - self.sums[start]) * self.down[start] + length * U64(0xA24BAED4963EE407))


class Texts:
    """The texts of some rows: their bytes, end to end, and where each begins."""

    def __init__(self, rows: pa.RecordBatch, column: pa.Array):
        self.rows, self.n = rows, len(column)
        self.null = np.asarray(column.is_null())
        column = column.cast(pa.large_binary()) if not pa.types.is_large_binary(column.type) else column
        buffers = column.buffers()
        offsets = np.frombuffer(buffers[1], np.int64, len(column) + 1, column.offset * 8)
        data = np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None else np.zeros(0, np.uint8)
        self.data, self.offsets = data[offsets[0] : offsets[-1]], offsets - offsets[0]

    def words(self, between: np.ndarray = SPACE) -> None:
        """Sets starts and ends of the words (``between``: which bytes stand between them), and word_offsets: each text's first word."""
        solid = ~between[self.data]
        before = np.empty(len(solid) + 1, bool)
        before[0], before[1:] = False, solid
        opens, closes = solid & ~before[:-1], before[1:] & ~np.append(solid[1:], False)
        inner = self.offsets[:-1][(np.diff(self.offsets) > 0)]
        opens[inner] = solid[inner]
        last = self.offsets[1:][np.diff(self.offsets) > 0] - 1
        closes[last] = solid[last]
        self.starts, self.ends = np.flatnonzero(opens), np.flatnonzero(closes) + 1
        self.word_offsets = np.searchsorted(self.starts, self.offsets)

    def word_hashes(self, data: np.ndarray | None = None) -> np.ndarray:
        self.words()
        return PrefixHash(BYTE_VALUE[self.data if data is None else data]).of(self.starts, self.ends)

    def text(self, i: int) -> str:
        return self.data[self.offsets[i] : self.offsets[i + 1]].tobytes().decode("utf-8", "replace")


def give_back() -> None:
    """Returns free memory to the system: a worker stays, idle, while others need the room."""
    _powers.clear()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc's
    if trim:
        trim(0)


def texts(batches: Iterator[pa.RecordBatch], column: str = "text", most: int = 1 << 20) -> Iterator[Texts]:
    """Slices of the batches with at most ``most`` bytes of text each (or one row)."""
    for batch in batches:
        lengths = batch.column(column).cast(pa.large_binary())
        size = np.diff(np.frombuffer(lengths.buffers()[1], np.int64, len(lengths) + 1, lengths.offset * 8)) if len(lengths) else np.zeros(0, np.int64)
        begin, total = 0, 0
        for i, n in enumerate(size):
            if i > begin and total + n > most:
                part = batch.slice(begin, i - begin)
                yield Texts(part, part.column(column))
                begin, total = i, 0
            total += int(n)
        if begin < len(size):
            part = batch.slice(begin)
            yield Texts(part, part.column(column))
    give_back()


_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32


def fold_ascii(data: np.ndarray) -> np.ndarray:
    """A-Z in lower case; all other bytes as they are."""
    return _FOLD[data]


def window_starts(offsets: np.ndarray, width: int) -> np.ndarray:
    """Positions from which ``width`` items follow in the same text."""
    n = int(offsets[-1])
    ok = np.zeros(n + 1, np.int32)
    counts = np.maximum(np.diff(offsets) - width + 1, 0)
    some = counts > 0
    np.add.at(ok, offsets[:-1][some], 1)
    np.add.at(ok, (offsets[:-1] + counts)[some], -1)
    return np.flatnonzero(np.cumsum(ok[:-1]) > 0)


def owners(values: PrefixHash, offsets: np.ndarray, width: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of windows that share their anchor: (first window, windows, anchor hash).

    The anchor of a window of ``width`` items is its ``gram``-item slice with the
    least hash, the last of equals.  It depends on nothing but the window's content, so equal
    windows have equal anchors at equal offsets, wherever they stand.  Consecutive windows
    mostly share an anchor: a run is about half of ``width - gram`` windows long.
    """
    n = int(offsets[-1])
    starts = window_starts(offsets, width)
    if not len(starts):
        return (np.zeros(0, np.int64),) * 2 + (np.zeros(0, U64),)
    at = np.arange(n - gram + 1)
    h = values.of(at, at + gram)
    low = U64((1 << 31) - 1)
    least = (h & ~low) | (low - at.astype(U64))
    span, need = 1, width - gram + 1
    while span < need:
        step = min(span, need - span)
        least = np.minimum(least[: len(least) - step], least[step:])
        span += step
    owner = (low - (least[starts] & low)).astype(np.int64)
    first = np.flatnonzero(np.append(True, (owner[1:] != owner[:-1]) | (starts[1:] != starts[:-1] + 1)))
    return starts[first], np.diff(np.append(first, len(starts))), h[owner[first]]


def list_array(values: np.ndarray, counts: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(counts)), pa.int32()), pa.array(values, kind))


def as_long(h: np.ndarray) -> np.ndarray:
    return h.view(np.int64)
