"""Vectorised text helpers for Arrow batches: words, chunk hashes, shingles.

All work is done on the UTF-8 bytes of a slice of texts at a time, so memory
is bounded by the slice (``SLICE_BYTES``) or by one text when a single text is
longer. A substring's hash is the polynomial over its bytes modulo 2^64, read
from prefix sums (sum of byte * B^i, times the inverse power of its start),
and then passed through a 64-bit finaliser.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 20
BASE = np.uint64(0x9E3779B97F4A7C15 | 1)

ASCII_SPACE = np.zeros(256, bool)
ASCII_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_POWERS: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """B^0..B^n and their inverses modulo 2^64."""
    have = _POWERS.get("p")
    if have is None or len(have) <= n:
        inverse = np.uint64(pow(int(BASE), -1, 1 << 64))
        for key, base in (("p", BASE), ("i", inverse)):
            x = np.full(n + 1, base, np.uint64)
            x[0] = 1
            _POWERS[key] = np.multiply.accumulate(x)
    return _POWERS["p"], _POWERS["i"]


def mix(x: np.ndarray) -> np.ndarray:
    """64-bit finaliser (splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string or binary column; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    empty = b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else ""
    if column.null_count:
        column = column.fill_null(empty)
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, off, data = column.buffers()
    kind = np.int64 if wide else np.int32
    offsets = np.frombuffer(off, kind)[column.offset:column.offset + len(column) + 1].astype(np.int64)
    if not len(offsets):
        offsets = np.zeros(1, np.int64)
    if data is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[offsets[0]:offsets[-1]], offsets - offsets[0]


def slices(offsets: np.ndarray, limit: int = SLICE_BYTES):
    """Consecutive row ranges of at most ``limit`` bytes (one row at least)."""
    at, n = 0, len(offsets) - 1
    while at < n:
        end = int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1
        end = min(n, max(at + 1, end))
        yield at, end
        at = end


def prefix(data: np.ndarray) -> np.ndarray:
    """Prefix polynomial hashes of the bytes: P[i] covers data[:i]."""
    p, _ = powers(len(data) + 1)
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * p[:len(data)], out=out[1:])
    return out


def span_hash(pre: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of data[start:end] for each pair."""
    _, inv = powers(len(pre))
    return mix((pre[end] - pre[start]) * inv[start] + (end - start).astype(np.uint64) * np.uint64(0x2545F4914F6CDD1D))


def runs(member: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(starts, ends) of the maximal runs of member bytes, cut at the rows' ends."""
    edge = np.zeros(len(member) + 1, bool)
    edge[offsets] = True
    first = member.copy()
    first[1:] &= ~member[:-1] | edge[1:-1]
    last = member.copy()
    last[:-1] &= ~member[1:] | edge[1:-1]
    return np.flatnonzero(first), np.flatnonzero(last) + 1


def word_hashes(data: np.ndarray, offsets: np.ndarray, member: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash, start, end, bounds): the words of all rows in order; row r has
    words bounds[r]:bounds[r + 1]. ``member``: 256 flags, the bytes of words."""
    start, end = runs(member[data], offsets)
    bounds = np.searchsorted(start, offsets)
    return span_hash(prefix(data), start, end), start, end, bounds


def shingle_hashes(words: np.ndarray, bounds: np.ndarray, n: int = 5, short: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """(hash, row bounds) of the n-word shingles of each row, repeats kept.
    ``short``: a row of 1 to n-1 words gives its whole sequence as one."""
    size = np.diff(bounds)
    count = np.maximum(size - n + 1, 0)
    row = np.repeat(np.arange(len(size)), count)
    out_bounds = np.concatenate([[0], np.cumsum(count)])
    at = np.arange(out_bounds[-1]) - out_bounds[row] + bounds[row]
    h = np.full(len(at), np.uint64(n))
    for k in range(n):
        h = mix(h * np.uint64(0xD6E8FEB86659FD93) + words[at + k])
    if not short or not ((size > 0) & (size < n)).any():
        return h, out_bounds
    parts, bound = [], [0]
    for r, s in enumerate(size):
        if 0 < s < n:
            x = np.array([s], np.uint64)
            for w in words[bounds[r]:bounds[r + 1]]:
                x = mix(x * np.uint64(0xD6E8FEB86659FD93) + w)
            parts.append(x)
        else:
            parts.append(h[out_bounds[r]:out_bounds[r + 1]])
        bound.append(bound[-1] + len(parts[-1]))
    return np.concatenate(parts), np.array(bound)


def gather(values: np.ndarray, bounds: np.ndarray, pick: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Concatenates the ragged rows ``pick`` of (values, bounds); also the new bounds."""
    size = (bounds[1:] - bounds[:-1])[pick]
    out = np.concatenate([[0], np.cumsum(size)])
    at = np.arange(out[-1]) + np.repeat(bounds[pick] - out[:-1], size)
    return values[at], out
