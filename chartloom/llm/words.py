"""Vectorised word splitting and hashing over Arrow string columns.

Every function works on the flat UTF-8 buffer of a string column, so no
Python string is made per word.  A *word* is a maximal run of bytes other than
space and 0x09-0x0D; in UTF-8 those bytes never occur inside another character,
so this equals the character class ``[^\\x20\\x09-\\x0D]+`` over code points.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 1 << 20
"""Texts are handled in runs of about this many bytes (one text at least)."""

_RNG = np.random.default_rng(20240607)
BYTE_VALUE = _RNG.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
BASE = int(_RNG.integers(1 << 61, 1 << 62)) * 8 + 5
WORD_BASE = int(_RNG.integers(1 << 61, 1 << 62)) * 8 + 3
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """``base**i`` and its inverse modulo 2**64, for i up to n at least."""
    have = _POWERS.get(base)
    if have is None or len(have[0]) <= n:
        size = max(1 << 16, n + n // 8 + 2)
        with np.errstate(over="ignore"):
            up = np.full(size, base & (2**64 - 1), np.uint64)
            down = np.full(size, pow(base, -1, 1 << 64), np.uint64)
            up[0] = down[0] = 1
            have = np.cumprod(up), np.cumprod(down)
        _POWERS[base] = have
    return have


def mix(x: np.ndarray, salt: int = 0) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    with np.errstate(over="ignore"):
        x = x + np.uint64((salt * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) & (2**64 - 1))
        x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        return x ^ (x >> np.uint64(32))


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and the n + 1 offsets of its values; a null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    buf = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return buf[offsets[0] : offsets[-1]] if len(offsets) else buf, offsets - (offsets[0] if len(offsets) else 0)


def runs(offsets: np.ndarray, size: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges that cover about ``size`` bytes each."""
    a, n = 0, len(offsets) - 1
    while a < n:
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + size, "right")) - 1)
        yield a, b
        a = b


class Words:
    """The words of a run of texts: byte spans, the first word of each text, and 64-bit hashes."""

    __slots__ = ("buf", "starts", "ends", "first", "hashes")

    def __init__(self, buf: np.ndarray, offsets: np.ndarray, lower: bool = False, hashed: bool = True):
        self.buf = buf = LOWER[buf] if lower else buf
        n = len(buf)
        ink = ~SPACE[buf]
        edge = np.zeros(n + 1, bool)
        edge[offsets] = True
        before = np.empty(n, bool)
        before[1:] = ~ink[:-1]
        after = np.empty(n, bool)
        after[:-1] = ~ink[1:]
        if n:
            before[0] = after[-1] = True
        self.starts = np.flatnonzero(ink & (before | edge[:-1]))
        self.ends = np.flatnonzero(ink & (after | edge[1:])) + 1
        self.first = np.searchsorted(self.starts, offsets)
        self.hashes = None
        if hashed:
            up, down = powers(BASE, n)
            with np.errstate(over="ignore"):
                total = np.zeros(n + 1, np.uint64)
                np.cumsum(BYTE_VALUE[buf] * up[:n], out=total[1:])
                self.hashes = mix((total[self.ends] - total[self.starts]) * down[self.starts])

    def windows(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of n consecutive words from every word on, and where these lie in one text."""
        k = len(self.hashes)
        m = max(0, k - n + 1)
        up, down = powers(WORD_BASE, k)
        with np.errstate(over="ignore"):
            total = np.zeros(k + 1, np.uint64)
            np.cumsum(self.hashes * up[:k], out=total[1:])
            out = mix((total[n : n + m] - total[:m]) * down[:m], n)
        inside = np.ones(m, bool)
        for d in self.first[1:-1]:
            inside[max(0, d - n + 1) : d] = False
        return out, inside


def rows(batch: pa.RecordBatch, text: str, lower: bool = False, hashed: bool = True) -> Iterator[tuple[int, int, Words]]:
    """(first row, last row, their Words) for runs of a batch."""
    buf, offsets = flat(batch.column(text))
    for a, b in runs(offsets):
        yield a, b, Words(buf[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], lower, hashed)
