"""Five-word shingle sets as 64-bit hashes, computed over Arrow string buffers with numpy.

Words are runs of bytes other than ASCII white space, A-Z lower-cased. A word's hash is a polynomial of its
bytes modulo 2^64, taken from prefix sums, then finalised; a shingle's hash is a polynomial of
its words' hashes. Work is done in pieces of a quarter of a megabyte, so the memory is bounded by that and by one text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

PIECE = 1 << 18
SHINGLE = 5


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64 (fixed values)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BASE = 0x9E3779B97F4A7C15
_VALUE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(_BASE))
_VALUE[65:91] = _VALUE[97:123]  # A-Z as a-z
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    size = 1 << max(18, n.bit_length())
    if size not in _POWERS:
        _POWERS.clear()
        up, down = np.full(size, _BASE, dtype=np.uint64), np.full(size, pow(_BASE, -1, 2**64), dtype=np.uint64)
        up[0] = down[0] = 1
        _POWERS[size] = (np.cumprod(up), np.cumprod(down))
    return _POWERS[size]


def _buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets and bytes of a string column; null counts as empty."""
    column = column.cast(pa.large_string()).fill_null("")
    _, offsets, data = column.buffers()
    ends = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    return ends, np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, dtype=np.uint8)


def _words(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of texts that lie one after another, and how many words each text has."""
    inside = ~_SPACE[data]
    before = np.empty(len(data), dtype=bool)
    before[0], before[1:] = False, inside[:-1]
    cuts = ends[:-1][ends[:-1] < len(data)]
    before[cuts] = False
    starts = np.flatnonzero(inside & ~before)
    after = np.empty(len(data), dtype=bool)
    after[-1], after[:-1] = False, inside[1:]
    last = ends[1:] - 1
    after[last[last >= 0]] = False
    stops = np.flatnonzero(inside & ~after) + 1
    up, down = _powers(len(data))
    sums = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum(_VALUE[data] * up[: len(data)], out=sums[1:])
    hashes = mix((sums[stops] - sums[starts]) * down[starts] + (stops - starts).astype(np.uint64))
    counts = np.diff(np.searchsorted(starts, ends))
    return hashes, counts


def _shingled(words: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all shingles of all texts, and how many each text has; a short text is one shingle."""
    step = np.uint64(0xD1342543DE82EF95)
    first = np.concatenate([[0], np.cumsum(counts)])
    n = np.where(counts >= SHINGLE, counts - SHINGLE + 1, (counts > 0).astype(counts.dtype))
    whole = np.zeros(0, dtype=np.uint64)
    if len(words) >= SHINGLE:
        acc = words[: len(words) - SHINGLE + 1].copy()
        for k in range(1, SHINGLE):
            acc = acc * step + words[k : len(words) - SHINGLE + 1 + k]
        whole = mix(acc)
    out = np.empty(int(n.sum()), dtype=np.uint64)
    at = np.concatenate([[0], np.cumsum(n)])
    long = np.flatnonzero(counts >= SHINGLE)
    if len(long):
        lengths = n[long]
        shift = np.repeat(first[long] - np.concatenate([[0], np.cumsum(lengths)[:-1]]), lengths)
        source = np.arange(int(lengths.sum())) + shift
        target = np.arange(int(lengths.sum())) + np.repeat(at[long] - np.concatenate([[0], np.cumsum(lengths)[:-1]]), lengths)
        out[target] = whole[source]
    for i in np.flatnonzero((counts > 0) & (counts < SHINGLE)):
        acc = np.full(1, counts[i], dtype=np.uint64)
        for w in words[first[i] : first[i + 1]]:
            acc = acc * step + w
        out[at[i]] = mix(acc)[0]
    return out, at


def shingle_sets(column: pa.Array) -> Iterator[np.ndarray]:
    """For each text the sorted distinct hashes of its five-word shingles; fewer words make one shingle, none an empty set."""
    ends, data = _buffers(column)
    i, n = 0, len(ends) - 1
    while i < n:
        j = int(np.searchsorted(ends, ends[i] + PIECE, side="right")) - 1
        j = min(n, max(i + 1, j))
        piece = data[ends[i] : ends[j]]
        if len(piece):
            hashes, counts = _words(piece, ends[i : j + 1] - ends[i])
            found, at = _shingled(hashes, counts)
            for a, b in zip(at[:-1], at[1:], strict=True):
                yield np.unique(found[a:b])
        else:
            for _ in range(i, j):
                yield np.zeros(0, dtype=np.uint64)
        i = j
