"""Whole-batch text kernels: numpy over the UTF-8 bytes of Arrow string columns.

Every function works on a *chunk*: some consecutive rows of a batch, as one byte array
and the byte offsets of the rows.  Null texts are empty rows.  Chunks hold about
``CHUNK_BYTES``, or a single row if that is longer, so memory follows the longest text
and not the number of rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 1 << 18

U64 = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

#: Words between ASCII white space.
SPACED = np.ones(256, dtype=bool)
SPACED[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = False

#: Runs of digits, letters a-z and everything beyond ASCII.
ALNUM = np.zeros(256, dtype=bool)
ALNUM[0x30:0x3A] = ALNUM[0x61:0x7B] = ALNUM[0x80:] = True


def strings(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a string column and the int64 offsets of its rows."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    if not pa.types.is_large_string(column.type):
        column = column.cast(pa.large_string())
    _, offsets, data = column.buffers()
    offs = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offs[0] : offs[-1]], offs - offs[0]


def chunks(column: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of consecutive pieces of a column."""
    data, offs = strings(column)
    lo, n = 0, len(offs) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offs, offs[lo] + limit, "right")) - 1)
        yield lo, hi, data[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo]
        lo = hi


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit values."""
    h = h.astype(U64, copy=True)
    h ^= h >> U64(30)
    h *= U64(0xBF58476D1CE4E5B9)
    h ^= h >> U64(27)
    h *= U64(0x94D049BB133111EB)
    h ^= h >> U64(31)
    return h


_powers = [np.ones(1, dtype=U64), np.ones(1, dtype=U64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i < n, kept from call to call."""
    if len(_powers[0]) < n:
        for k, base in enumerate((_BASE, _INVERSE)):
            steps = np.full(n, base, dtype=U64)
            steps[0] = 1
            _powers[k] = np.multiply.accumulate(steps)
    return _powers[0][:n], _powers[1][:n]


def word_spans(data: np.ndarray, offs: np.ndarray, kind: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and rows of the maximal runs of bytes of a kind; no run crosses rows."""
    n = len(data)
    inside = kind[data]
    before = np.zeros(n, dtype=bool)
    before[1:] = inside[:-1]
    edges = offs[(offs > 0) & (offs < n)]
    before[edges] = False
    after = np.zeros(n, dtype=bool)
    after[:-1] = inside[1:]
    after[edges - 1] = False
    starts = np.flatnonzero(inside & ~before)
    ends = np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(offs, starts, "right") - 1


#: Bytes beyond which a span is hashed by itself: running sums modulo 2**64 are equal for some spans of 1024.
LONG_SPAN = 256


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the bytes of each span, by differences of one running sum; of long ones by BLAKE2."""
    if not len(starts):
        return np.zeros(0, dtype=U64)
    up, down = powers(len(data) + 1)
    total = np.zeros(len(data) + 1, dtype=U64)
    np.cumsum((data.astype(U64) + U64(1)) * up[:-1], out=total[1:])
    out = mix((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(U64) * U64(0xD6E8FEB86659FD93))
    for k in np.flatnonzero(ends - starts > LONG_SPAN):
        out[k] = int.from_bytes(hashlib.blake2b(data[starts[k] : ends[k]].tobytes(), digest_size=8).digest(), "little")
    return out


def shingles(words: np.ndarray, rows: np.ndarray, n_rows: int, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``width`` words of a row, and their rows.

    A row of fewer words, but not none, has its whole sequence as its only run.
    """
    counts = np.bincount(rows, minlength=n_rows)
    if len(words) >= width:
        rolled = np.zeros(len(words) - width + 1, dtype=U64)
        for k in range(width):
            rolled += mix(words[k : len(words) - width + 1 + k] + U64(0x9E3779B97F4A7C15 * (k + 1) % (1 << 64))) * U64(2 * k + 3)
        whole = rows[: len(rolled)] == rows[width - 1 :]
        out, at = mix(rolled[whole]), rows[: len(rolled)][whole]
    else:
        out, at = np.zeros(0, dtype=U64), np.zeros(0, dtype=rows.dtype)
    short = np.flatnonzero((counts > 0) & (counts < width))
    if len(short):
        first = np.searchsorted(rows, short)
        extra = np.zeros(len(short), dtype=U64)
        for k in range(width - 1):
            has = counts[short] > k
            extra[has] += mix(words[first[has] + k] + U64(0x9E3779B97F4A7C15 * (k + 1) % (1 << 64))) * U64(2 * k + 3)
        out = np.concatenate([out, mix(extra + counts[short].astype(U64) * U64(0xA0761D6478BD642F))])
        at = np.concatenate([at, short])
    return out, at


def per_row_unique(values: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values of each row, sorted by row and then by value."""
    order = np.argsort(values, kind="stable")
    order = order[np.argsort(rows[order], kind="stable")]
    v, r = values[order], rows[order]
    keep = np.ones(len(v), dtype=bool)
    keep[1:] = (v[1:] != v[:-1]) | (r[1:] != r[:-1])
    return v[keep], r[keep]


def codepoints(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Code points of a chunk and the offsets of its rows in code points."""
    points = np.frombuffer(data.tobytes().decode("utf-8", "replace").encode("utf-32-le", "replace"), dtype=np.uint32)
    first = np.zeros(len(data) + 1, dtype=np.int64)
    np.cumsum((data & 0xC0) != 0x80, out=first[1:])
    if first[-1] != len(points):  # not valid UTF-8: row by row
        parts = [np.frombuffer(data[a:b].tobytes().decode("utf-8", "replace").encode("utf-32-le"), dtype=np.uint32) for a, b in zip(offs[:-1], offs[1:], strict=True)]
        return np.concatenate([np.zeros(0, np.uint32), *parts]), np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int64)
    return points, first[offs]
