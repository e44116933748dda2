"""Vectorised word, shingle and set hashing over the buffers of Arrow string columns."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

_P = np.uint64(0x9E3779B97F4A7C15 | 1)
_PINV = np.uint64(pow(int(_P), -1, 1 << 64))
_CHUNK = 1 << 18
_tables: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer: every input bit reaches every output bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    size = max(_CHUNK, 1 << (n - 1).bit_length())
    if size not in _tables:
        _tables.clear()
        with np.errstate(over="ignore"):
            up = np.full(size + 1, _P, np.uint64)
            down = np.full(size + 1, _PINV, np.uint64)
            up[0] = down[0] = 1
            _tables[size] = np.multiply.accumulate(up), np.multiply.accumulate(down)
    return _tables[size]


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_binary())
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, number of words up to each document's begin) of the runs of bytes outside 0x20 and 0x09-0x0D."""
    word = ~((data == 32) | ((data >= 9) & (data <= 13)))
    n = len(data)
    before = np.zeros(n + 1, bool)
    before[1:] = word
    first = np.zeros(n + 1, bool)
    first[offsets] = True
    starts = np.flatnonzero(word & (~before[:n] | first[:n]))
    after = np.zeros(n, bool)
    after[:-1] = word[1:]
    ends = np.flatnonzero(word & (~after | first[1:])) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = True) -> np.ndarray:
    """A 64-bit hash of each word; ASCII letters are lower-cased first."""
    out = np.empty(len(starts), np.uint64)
    i = 0
    with np.errstate(over="ignore"):
        while i < len(starts):
            j = max(i + 1, int(np.searchsorted(ends, starts[i] + _CHUNK, "right")))
            lo, hi = int(starts[i]), int(ends[j - 1])
            b = data[lo:hi]
            if lower:
                b = np.where((b >= 65) & (b <= 90), b | 32, b)
            up, down = _powers(hi - lo)
            s = np.zeros(hi - lo + 1, np.uint64)
            np.cumsum((b.astype(np.uint64) + np.uint64(1)) * up[: hi - lo], out=s[1:])
            a, z = starts[i:j] - lo, ends[i:j] - lo
            out[i:j] = mix((s[z] - s[a]) * down[a] + (z - a).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
            i = j
    return out


def shingles(hashes: np.ndarray, bounds: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct k-word shingles: (hash, document), sorted by document and hash.

    A document of fewer than k words has one shingle, its whole sequence; one
    without words has none.
    """
    n = len(hashes)
    counts = np.diff(bounds)
    with np.errstate(over="ignore"):
        acc = np.zeros(max(0, n - k + 1), np.uint64)
        for i in range(k):
            acc = mix(acc * np.uint64(0x2545F4914F6CDD1D) + hashes[i : n - k + 1 + i] + np.uint64(i + 1)) if len(acc) else acc
    doc = np.repeat(np.arange(len(counts)), np.maximum(0, counts - k + 1))
    at = np.arange(len(doc)) + np.repeat(bounds[:-1] - np.concatenate([[0], np.cumsum(np.maximum(0, counts - k + 1))[:-1]]), np.maximum(0, counts - k + 1)) if len(doc) else np.zeros(0, np.int64)
    value = acc[at] if len(doc) else np.zeros(0, np.uint64)
    short = np.flatnonzero((counts > 0) & (counts < k))
    if len(short):
        own = np.zeros(len(short), np.uint64)
        with np.errstate(over="ignore"):
            for i in range(k - 1):
                more = counts[short] > i
                own[more] = mix(own[more] * np.uint64(0x2545F4914F6CDD1D) + hashes[bounds[short[more]] + i] + np.uint64(100 + i))
        doc, value = np.concatenate([doc, short]), np.concatenate([value, own])
    order = np.lexsort((value, doc))
    doc, value = doc[order], value[order]
    keep = np.ones(len(doc), bool)
    keep[1:] = (doc[1:] != doc[:-1]) | (value[1:] != value[:-1])
    return value[keep], doc[keep]


def shingle_sets(column: pa.Array, k: int):
    """Yields (first row, rows, hash, document within the slice) for slices of a string column of about half a megabyte."""
    data, offsets = buffers(column)
    rows = len(offsets) - 1
    i = 0
    while i < rows:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + 2 * _CHUNK, "right")) - 1)
        part, off = data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        starts, ends, bounds = word_spans(part, off)
        value, doc = shingles(word_hashes(part, starts, ends), bounds, k)
        yield i, j - i, value, doc
        i = j
