"""A minimal perfect hash over 64-bit keys, built and probed in whole arrays.

Level by level, keys that fall on a cell of their own keep it; the others go on to the next,
smaller level. The place of a key is the number of kept cells before its own, so n keys get the
numbers 0 to n - 1 from about three bits a key. Keys that no level separates stay in a list.
"""

from __future__ import annotations

import numpy as np

from .text import mix

LEVELS = 40


def _cells(keys: np.ndarray, level: int, size: int) -> np.ndarray:
    salt = np.uint64((level * 0x9E3779B97F4A7C15 + 0x5851F42D4C957F2D) % 2**64)
    return (mix(keys ^ salt) % np.uint64(size)).astype(np.int64)


def build(keys: np.ndarray) -> tuple[list[int], bytes, bytes]:
    """(level sizes, packed cells of all levels, keys left over) of distinct keys."""
    sizes, cells = [], []
    while len(keys) and len(sizes) < LEVELS:
        size = max(64, -(-2 * len(keys) // 8) * 8)
        at = _cells(keys, len(sizes), size)
        alone = np.bincount(at, minlength=size) == 1
        sizes.append(size)
        cells.append(np.packbits(alone).tobytes())
        keys = keys[~alone[at]]
    return sizes, b"".join(cells), np.sort(keys).astype("<u8").tobytes()


def places(keys: np.ndarray, sizes: list[int], cells: bytes, rest: bytes) -> np.ndarray:
    """The number of each key; any number, or -1, for a key that was not built in."""
    out = np.full(len(keys), -1, np.int64)
    open_, at, before = np.arange(len(keys)), 0, 0
    packed = np.frombuffer(cells, np.uint8)
    for level, size in enumerate(sizes):
        kept = np.unpackbits(packed[at : at + size // 8])
        rank = np.cumsum(kept, dtype=np.int64)
        cell = _cells(keys[open_], level, size)
        found = kept[cell] == 1
        out[open_[found]] = before + rank[cell[found]] - 1
        open_, at, before = open_[~found], at + size // 8, before + int(rank[-1])
    left = np.frombuffer(rest, "<u8")
    if len(left) and len(open_):
        place = np.minimum(np.searchsorted(left, keys[open_]), len(left) - 1)
        same = left[place] == keys[open_]
        out[open_[same]] = before + place[same]
    return out
