"""Vectorised words, word hashes and shingle sets of Arrow string columns.

Words are runs without ASCII white space, A-Z lower-cased. Hashes have 64 bits;
among a billion different words or shingles, two collide with a chance of about
one in forty.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text worked on at once in a Python worker.
CHUNK_BYTES = 512 << 10

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_BASE_INV = np.uint64(pow(int(_BASE), -1, 1 << 64))
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def _pow(n: int) -> list[np.ndarray]:
    if len(_powers[0]) < n:
        n = max(n, CHUNK_BYTES + 65536)
        for i, b in enumerate((_BASE, _BASE_INV)):
            p = np.full(n, b, np.uint64)
            p[0] = 1
            _powers[i] = np.cumprod(p)
    return _powers


def chunks(column: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, pa.Array]]:
    """(first row, slice) of about ``limit`` bytes each; nulls become empty."""
    column = column.fill_null("")
    n = len(column)
    off = _offsets(column)
    lo = 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(off, off[lo] + limit, side="right")) - 1)
        yield lo, column.slice(lo, min(hi, n) - lo)
        lo = min(hi, n)


def _offsets(column: pa.Array) -> np.ndarray:
    kind = np.int64 if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else np.int32
    return np.frombuffer(column.buffers()[1], kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)


def word_bounds(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Lower-cased bytes, word starts, word ends, and per row the number of words before it."""
    off = _offsets(column)
    data = column.buffers()[2]
    if data is None or off[-1] == off[0]:
        z = np.zeros(0, np.int64)
        return np.zeros(0, np.uint8), z, z, np.zeros(len(off), np.int64)
    x = _LOWER[np.frombuffer(data, np.uint8)[off[0] : off[-1]]]
    off = off - off[0]
    word = ~_SPACE[x]
    cut = np.zeros(len(x) + 1, bool)
    cut[off] = True
    edge = np.ones(len(x) + 1, bool)
    edge[1:-1] = ~word[:-1] | ~word[1:]
    edge |= cut
    starts = np.flatnonzero(word & edge[:-1])
    ends = np.flatnonzero(word & edge[1:]) + 1
    return x, starts, ends, np.searchsorted(starts, off)


def word_hashes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every word of the column, and per row the number of words before it."""
    x, s, e, rows = word_bounds(column)
    if not len(s):
        return np.zeros(0, np.uint64), rows
    p, inv = _pow(len(x) + 1)
    sums = np.zeros(len(x) + 1, np.uint64)
    np.cumsum((x.astype(np.uint64) + np.uint64(1)) * p[: len(x)], out=sums[1:])
    return mix64((sums[e] - sums[s]) * inv[s] + (e - s).astype(np.uint64) * np.uint64(0xA24BAED4963EE407)), rows


def shingle_hashes(words: np.ndarray, rows: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the k-word shingles row by row, not yet distinct; a row of
    fewer words, but not none, has its whole sequence as one shingle."""
    n = np.diff(rows)
    many = np.where(n >= k, n - k + 1, np.minimum(n, 1))
    out_rows = np.zeros(len(rows), np.int64)
    np.cumsum(many, out=out_rows[1:])
    at = np.arange(out_rows[-1]) + np.repeat(rows[:-1] - out_rows[:-1], many)
    left = np.repeat(np.minimum(n, k), many)
    h = left.astype(np.uint64)
    padded = np.concatenate([words, np.zeros(k, np.uint64)])
    for j in range(k):
        h = mix64(h) + np.where(left > j, padded[at + j], np.uint64(0))
    return mix64(h), out_rows


def sets(column: pa.Array, k: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of every row of a string column."""
    out: list[np.ndarray] = []
    for _, part in chunks(column):
        h, rows = shingle_hashes(*word_hashes(part), k)
        out += [np.unique(h[a:b]) for a, b in zip(rows[:-1], rows[1:])]
    return out
