"""Words and shingles of whole UTF-8 texts as numpy arrays, a batch of documents at a time.

Words are maximal runs of bytes outside ``[\\x20\\x09-\\x0D]``; A-Z are lower-cased.  A word's
hash is a polynomial over random 64-bit letters, taken from prefix sums, so that the cost is a
few nanoseconds a byte whatever the number of words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

BLANK = np.zeros(256, bool)
BLANK[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LETTERS = np.random.default_rng(20240611).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
LETTERS = _LETTERS.copy()
LETTERS[65:91] = _LETTERS[97:123]
_BASE = 0x9E3779B97F4A7C15
_BACK = pow(_BASE, -1, 2**64)
_powers: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The base's powers and their inverses modulo 2**64, up to n at least."""
    if "up" not in _powers or len(_powers["up"]) < n:
        n = max(n, 1 << 16)
        for key, base in (("up", _BASE), ("down", _BACK)):
            x = np.full(n, base, np.uint64)
            x[0] = 1
            _powers[key] = np.multiply.accumulate(x)
    return _powers["up"], _powers["down"]


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64, len(column) + 1, column.offset * 8) if len(column) else np.zeros(1, np.int64)
    buf = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return buf[at[0] : at[-1]], at - at[0]


def pieces(batch: pa.RecordBatch, column: str, most: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """Runs of rows with about ``most`` bytes of text each; a longer document comes alone."""
    lengths = np.diff(utf8(batch.column(column))[1])
    run = np.cumsum(lengths)
    lo = 0
    while lo < len(lengths):
        hi = max(lo + 1, int(np.searchsorted(run, (run[lo - 1] if lo else 0) + most, "right")))
        yield batch.slice(lo, hi - lo)
        lo = hi


def words(buf: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each word, index of each document's first word, with the end)."""
    if not len(buf):
        return np.zeros(0, np.uint64), np.zeros(len(at), np.int64)
    blank = BLANK[buf]
    edge = np.zeros(len(buf) + 1, bool)  # a document begins here
    edge[at[at < len(buf)]] = True
    ink = ~blank
    before = np.concatenate(([False], ink[:-1]))
    starts = np.flatnonzero(ink & (~before | edge[:-1]))
    after = np.concatenate((ink[1:], [False]))
    ends = np.flatnonzero(ink & (~after | edge[1:])) + 1
    up, down = powers(len(buf))
    run = np.concatenate((np.zeros(1, np.uint64), np.cumsum(LETTERS[buf] * up[: len(buf)], dtype=np.uint64)))
    return mixed((run[ends] - run[starts]) * down[starts]), np.searchsorted(starts, at)


def shingles(hashes: np.ndarray, first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each k-word shingle, index of each document's first, with the end).

    A document with fewer words than k has its whole sequence as one; one without words has none.
    """
    n = np.diff(first)
    count = np.where(n >= k, n - k + 1, (n > 0).astype(np.int64))
    begin = np.concatenate(([0], np.cumsum(count)))
    if not begin[-1]:
        return np.zeros(0, np.uint64), begin
    where = np.repeat(first[:-1] - begin[:-1], count) + np.arange(begin[-1])
    short = np.repeat(n < k, count)
    out = np.zeros(begin[-1], np.uint64)
    own = np.repeat(np.minimum(n, k), count)
    for i in range(k):
        step = hashes[np.minimum(where + i, len(hashes) - 1)]
        out = np.where(i < own, mixed(out * np.uint64(0xD6E8FEB86659FD93) + step), out)
    return np.where(short, out ^ np.uint64(0x5851F42D4C957F2D), out), begin
