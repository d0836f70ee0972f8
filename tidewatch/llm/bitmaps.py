"""Compressed bitmaps of positions below BLOCK: ascending 16-bit positions while they are few, else one bit each.

A counted bitmap is a list of planes: plane k holds the positions whose count has bit k set. The positions with any
count are the planes' union.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

#: Positions of one bitmap; a dense plane has this many bits.
BLOCK = 1 << 14
_DENSE = BLOCK // 8


def pack(positions: np.ndarray) -> bytes:
    """Ascending positions as the shorter of both forms; the length tells them apart."""
    if 2 * len(positions) < _DENSE:
        return positions.astype("<u2").tobytes()
    flags = np.zeros(BLOCK, bool)
    flags[positions] = True
    return np.packbits(flags, bitorder="little").tobytes()


def positions(plane: bytes) -> np.ndarray:
    """The ascending positions of a plane."""
    if len(plane) != _DENSE:
        return np.frombuffer(plane, "<u2")
    return np.flatnonzero(np.unpackbits(np.frombuffer(plane, np.uint8), bitorder="little")).astype("<u2")


def popcount(plane: bytes) -> int:
    return len(plane) // 2 if len(plane) != _DENSE else int(np.bitwise_count(np.frombuffer(plane, np.uint8)).sum())


def either(planes: list[bytes]) -> bytes:
    """The union (OR) of planes."""
    planes = [p for p in planes if p]
    if len(planes) < 2:
        return planes[0] if planes else b""
    flags = np.zeros(BLOCK, bool)
    for p in planes:
        flags[positions(p)] = True
    return pack(np.flatnonzero(flags))


def merge(parts: list[list[bytes]]) -> list[bytes]:
    """Counted bitmaps of disjoint positions as one."""
    if len(parts) == 1:
        return parts[0]
    return [either([p[k] for p in parts if k < len(p)]) for k in range(max(map(len, parts)))]


def total(planes: list[bytes]) -> int:
    """The sum of all counts."""
    return sum(popcount(p) << k for k, p in enumerate(planes))


def counts(planes: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Positions and their counts; a position comes once for each plane that has it."""
    each = [positions(p) for p in planes]
    return np.concatenate(each), np.repeat(1 << np.arange(len(each)), [len(x) for x in each])


def counted(keys: np.ndarray, at: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, pa.ListArray]:
    """The distinct keys of entries (key, position, count), sorted by key and position, and their counted bitmaps."""
    starts = np.flatnonzero(np.diff(keys, prepend=keys[0] - 1)) if len(keys) else np.zeros(0, np.int64)
    group = np.zeros(len(keys), np.int64)
    group[starts] = 1
    group = np.cumsum(group) - 1
    planes: list[list[bytes]] = [[] for _ in starts]
    for k in range(int(n.max()).bit_length() if len(n) else 0):
        bit = np.flatnonzero(n >> k & 1)
        low, of = at[bit].astype("<u2"), group[bit]
        raw = low.tobytes()
        edges = np.searchsorted(of, np.arange(len(starts) + 1))
        sizes = np.diff(edges)
        # Keys without this plane get an empty one only where a higher plane follows.
        for g, a, b, size in zip(np.flatnonzero(sizes).tolist(), *(x[np.flatnonzero(sizes)].tolist() for x in (edges[:-1], edges[1:], sizes))):
            own = planes[g]
            own.extend([b""] * (k - len(own)))
            own.append(raw[2 * a : 2 * b] if 2 * size < _DENSE else pack(low[a:b]))
    return keys[starts], pa.array(planes, pa.list_(pa.binary()))
