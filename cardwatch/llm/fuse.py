"""Static binary-fuse filters (three-wise, 8-bit fingerprints) over 64-bit digests, in numpy.

About nine bits a key; no false negatives; one false positive in 256. Built by peeling: slots that hold a
single remaining key are taken off round by round, then fingerprints are assigned in reverse order.
"""

from __future__ import annotations

import numpy as np

_M1, _M2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)  # fixed values: 64-bit finaliser of MurmurHash3
_S33 = np.uint64(33)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _S33)) * _M1
    x = (x ^ (x >> _S33)) * _M2
    return x ^ (x >> _S33)


def _seeded(seed: int) -> np.uint64:
    return np.uint64(seed * 0x9E3779B97F4A7C15 % 2**64)


def _shape(n: int) -> tuple[int, int]:
    """Segment length (a power of two) and number of segments."""
    if n < 2:
        return 4, 3
    length = 1 << min(18, max(2, int(np.floor(np.log(n) / np.log(3.33) + 2.25))))
    slots = int(round(n * max(1.125, 0.875 + 0.25 * np.log(1e6) / np.log(n))))
    return length, max(3, -(-slots // length) + 2)


def _slots(hashed: np.ndarray, length: int, segments: int) -> np.ndarray:
    """Three slots a key, one in each of three neighbouring segments."""
    first = (((hashed >> np.uint64(32)) * np.uint64(segments - 2)) >> np.uint64(32)).astype(np.int64)
    mask = length - 1
    a = (hashed & np.uint64(mask)).astype(np.int64)
    b = ((hashed >> np.uint64(18)) & np.uint64(mask)).astype(np.int64)
    again = _mix(hashed + np.uint64(0x9E3779B97F4A7C15))
    c = (again & np.uint64(mask)).astype(np.int64)
    return np.stack([first * length + a, (first + 1) * length + b, (first + 2) * length + c])


def _prints(hashed: np.ndarray) -> np.ndarray:
    return (_mix(hashed ^ np.uint64(0xA5A5A5A5A5A5A5A5)) >> np.uint64(56)).astype(np.uint8)


def build(keys: np.ndarray) -> tuple[int, int, int, bytes]:
    """seed, segment length, number of segments, fingerprints; keys are 64-bit digests in any order."""
    keys = np.unique(keys.astype(np.uint64))
    length, segments = _shape(len(keys))
    for seed in range(1, 1000):
        hashed = _mix(keys + _seeded(seed))
        slots = _slots(hashed, length, segments)
        order = _peel(slots, length * segments)
        if order is not None:
            break
        if seed % 10 == 0:
            segments += 1 + segments // 10
    else:
        raise RuntimeError("no binary-fuse filter found")
    table = np.zeros(length * segments, dtype=np.uint8)
    prints = _prints(hashed)
    for taken, free in reversed(order):
        own = slots[:, taken]
        table[free] = 0
        table[free] = prints[taken] ^ table[own[0]] ^ table[own[1]] ^ table[own[2]]
    return seed, length, segments, table.tobytes()


def _peel(slots: np.ndarray, size: int):
    """Rounds of (keys, the slot each is alone in), or None if some keys are never alone.

    A key alone in two of its slots is taken once; keys of one round share no free slot, so a round is assigned
    at once: the other slots of its keys belong to keys of later rounds or to none.
    """
    n = slots.shape[1]
    count = np.bincount(slots.ravel(), minlength=size)
    which = np.zeros(size, dtype=np.int64)  # exclusive or of the keys in a slot
    for row in slots:
        np.bitwise_xor.at(which, row, np.arange(n))
    rounds, left = [], n
    alone = np.flatnonzero(count == 1)
    while left:
        if not len(alone):
            return None
        taken, first = np.unique(which[alone], return_index=True)
        free = alone[first]
        rounds.append((taken, free))
        left -= len(taken)
        gone = slots[:, taken]
        for row in gone:
            np.subtract.at(count, row, 1)
            np.bitwise_xor.at(which, row, taken)
        touched = np.unique(gone.ravel())
        alone = touched[count[touched] == 1]
    return rounds


def contains(found: tuple[int, int, int, bytes], keys: np.ndarray) -> np.ndarray:
    seed, length, segments, data = found
    hashed = _mix(keys.astype(np.uint64) + _seeded(seed))
    a, b, c = _slots(hashed, length, segments)
    table = np.frombuffer(data, dtype=np.uint8)
    return (table[a] ^ table[b] ^ table[c]) == _prints(hashed)
