"""Vectorised text helpers that run inside Arrow tasks.

A batch of texts is one byte buffer with offsets, as Arrow stores it.  Word and
line positions, word hashes and shingle hashes come from a few passes of numpy
over that buffer; no text is cut and no Python loop runs per word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text that one numpy pass handles; longer texts form a pass of their own.
PASS_BYTES = 1 << 19
_U = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_BASE_INV = pow(_BASE, -1, 1 << 64)
_BYTE_CODE = np.random.default_rng(20260101).integers(1, 1 << 63, 256, dtype=np.uint64)

_ASCII_SPACE = np.zeros(256, bool)
_ASCII_SPACE[[0x20, 9, 10, 11, 12, 13]] = True
#: Bytes of a word that ends at ASCII white space.
NON_SPACE = ~_ASCII_SPACE
#: Bytes of a word made of ASCII letters, digits and anything beyond ASCII.
ALNUM = np.zeros(256, bool)
ALNUM[0x30:0x3A] = True
ALNUM[0x41:0x5B] = True
ALNUM[0x61:0x7B] = True
ALNUM[0x80:] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values (a bijection)."""
    x = x.astype(_U, copy=True)
    x ^= x >> _U(30)
    x *= _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


class _Powers:
    """Powers of the hash base and of its inverse, grown on demand."""

    up = down = np.ones(1, _U)

    @classmethod
    def of(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(cls.up) <= n:
            size = 1 << max(16, int(n).bit_length())
            for name, base in (("up", _BASE), ("down", _BASE_INV)):
                p = np.full(size, base, _U)
                p[0] = 1
                setattr(cls, name, np.multiply.accumulate(p))
        return cls.up, cls.down


class RollingHash:
    """Hashes of any byte ranges of a buffer after one pass over it."""

    def __init__(self, data: np.ndarray):
        self.up, self.down = _Powers.of(len(data) + 1)
        self.sums = np.zeros(len(data) + 1, _U)
        np.cumsum(_BYTE_CODE[data] * self.up[: len(data)], out=self.sums[1:])

    def ranges(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self.down[start])

    def windows(self, size: int) -> np.ndarray:
        """Hash of every range of that size, in order."""
        n = len(self.sums) - size
        if n <= 0:
            return np.zeros(0, _U)
        return mix((self.sums[size:] - self.sums[:n]) * self.down[:n])


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and n+1 offsets of a string or binary column; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    if column.null_count:
        column = column.fill_null("" if "string" in str(column.type) else b"")
    n = len(column)
    _, offs, data = column.buffers()
    if n == 0 or offs is None:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    kind = np.int64 if wide else np.int32
    offsets = np.frombuffer(offs, kind)[column.offset : column.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def passes(offsets: np.ndarray, size: int = PASS_BYTES) -> Iterator[tuple[int, int]]:
    """Consecutive row ranges of about that many bytes each."""
    first, n = 0, len(offsets) - 1
    while first < n:
        last = int(np.searchsorted(offsets, offsets[first] + size, "right")) - 1
        last = min(n, max(first + 1, last))
        yield first, last
        first = last


def runs(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of true values."""
    edge = np.flatnonzero(np.diff(mask.view(np.int8), prepend=0, append=0))
    return edge[::2], edge[1::2]


class Words:
    """Words of a pass of texts: runs of bytes of a class, never across texts.

    ``start`` and ``end`` are byte places in the pass, ``first`` has n+1 places
    in those arrays at which each text's words begin.
    """

    def __init__(self, data: np.ndarray, offsets: np.ndarray, kind: np.ndarray, lower: bool = False):
        self.offsets = offsets
        self.data = LOWER[data] if lower else data
        inside = kind[data]
        begins = inside.copy()
        begins[1:] &= ~inside[:-1]
        ends = inside.copy()
        ends[:-1] &= ~inside[1:]
        cut = offsets[1:-1]
        cut = cut[(cut > 0) & (cut < len(data))]
        begins[cut] = inside[cut]
        ends[cut - 1] = inside[cut - 1]
        self.start = np.flatnonzero(begins)
        self.end = np.flatnonzero(ends) + 1
        self.first = np.searchsorted(self.start, offsets)
        self.count = np.diff(self.first)

    def owner(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.count)), self.count)

    def hashes(self, rolling: RollingHash | None = None) -> np.ndarray:
        return (rolling or RollingHash(self.data)).ranges(self.start, self.end)


_STEP = [_U(pow(0xD6E8FEB86659FD93, i + 1, 1 << 64) | 1) for i in range(16)]


def shingles(words: np.ndarray, first: np.ndarray, size: int, whole: bool) -> tuple[np.ndarray, np.ndarray]:
    """Hash and text of each run of ``size`` words (hashes in ``words``).

    With ``whole`` a text of fewer words has its whole sequence as its only
    shingle; else it has none.  Texts without words have none.
    """
    count = np.diff(first)
    per = np.maximum(count - size + 1, 0)
    owner = np.repeat(np.arange(len(count)), per)
    if len(owner):
        at = first[:-1][owner] + np.arange(len(owner)) - np.repeat(np.cumsum(per) - per, per)
        total = np.zeros(len(at), _U)
        for i in range(size):
            total += words[at + i] * _STEP[i]
        out = mix(total + _U(size))
    else:
        out = np.zeros(0, _U)
    if whole:
        short = np.flatnonzero((count > 0) & (count < size))
        if len(short):
            extra = np.zeros(len(short), _U)
            for i in range(size - 1):
                has = count[short] > i
                extra[has] += words[first[:-1][short[has]] + i] * _STEP[i]
            out = np.concatenate([out, mix(extra + count[short].astype(_U))])
            owner = np.concatenate([owner, short])
    return out, owner


def window_seeds(
    h: np.ndarray, begins: np.ndarray, n_windows: np.ndarray, span: int
) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of windows that share the place of the smallest of ``span`` hashes in them: (row, first window, windows, that hash).

    Window k of row r covers ``h[begins[r] + k : begins[r] + k + span]``.
    """
    if not n_windows.any():
        z = np.zeros(0, np.int64)
        return z, z, z, z.astype(_U)
    # smallest hash among `span` neighbours, the leftmost if equal: 32 hash bits above, the place below
    low = (h & ~_U(0xFFFFFFFF)) | np.arange(len(h), dtype=_U)
    width = 1
    while width * 2 <= span:
        low = np.minimum(low[:-width], low[width:])
        width *= 2
    if width < span:
        low = np.minimum(low[: len(low) - (span - width)], low[span - width :])
    row = np.repeat(np.arange(len(n_windows)), n_windows)
    at = begins[row] + np.arange(len(row)) - (np.cumsum(n_windows) - n_windows)[row]
    pick = (low[at] & _U(0xFFFFFFFF)).astype(np.int64)
    new = np.ones(len(at), bool)
    new[1:] = (pick[1:] != pick[:-1]) | (row[1:] != row[:-1])
    first = np.flatnonzero(new)
    return row[first], at[first] - begins[row[first]], np.diff(np.append(first, len(at))), h[pick[first]]


def distinct_per_owner(values: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each owner's distinct values, sorted by owner and value."""
    order = np.lexsort((values, owner))
    values, owner = values[order], owner[order]
    keep = np.ones(len(values), bool)
    keep[1:] = (values[1:] != values[:-1]) | (owner[1:] != owner[:-1])
    return values[keep], owner[keep]


def lists(values: np.ndarray, owner: np.ndarray, n: int) -> pa.Array:
    """A list column of n rows from values sorted by owner."""
    offsets = np.searchsorted(owner, np.arange(n + 1)).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))
