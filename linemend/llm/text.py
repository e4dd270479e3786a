"""Words, lines and hashes of whole batches of texts, on the bytes of Arrow string columns.

White space is the six bytes 0x20 and 0x09 to 0x0D. All of them are single bytes of UTF-8, so
words and lines can be cut on bytes. A hash of a span depends on its bytes alone, never on the
batch it stands in: 64 bits, polynomial over a random table and then mixed.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_SLAB = 1 << 18
_BASE = 0x9E3779B97F4A7C15
_GRAM = np.uint64(0xD1342543DE82EF95)
_BYTES = np.random.default_rng(20).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base % 2**64, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


_UP, _DOWN = _powers(_BASE, _SLAB + 1), _powers(pow(_BASE, -1, 2**64), _SLAB + 1)


def mix(h: np.ndarray) -> np.ndarray:
    """Bijective mixing of 64-bit values."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def array_of(column) -> pa.Array:
    """One array of a column of a table or batch."""
    if isinstance(column, pa.ChunkedArray):
        return pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], column.type)
    return column


def longs(column) -> np.ndarray:
    return array_of(column).cast(pa.int64()).to_numpy(zero_copy_only=False)


def binaries(column) -> list[bytes]:
    return array_of(column).to_pylist()


def text_bytes(column) -> tuple[np.ndarray, np.ndarray]:
    """(bytes of all texts, n + 1 offsets); a null is an empty text."""
    array = array_of(column).cast(pa.large_string())
    if array.null_count:
        array = array.fill_null("")
    if not len(array):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, places, values = array.buffers()
    offsets = np.frombuffer(places, np.int64)[array.offset : array.offset + len(array) + 1]
    data = np.frombuffer(values, np.uint8) if values is not None and values.size else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def strings(data: np.ndarray, offsets: np.ndarray) -> pa.Array:
    """The opposite of `text_bytes`."""
    return pa.Array.from_buffers(
        pa.large_string(), len(offsets) - 1, [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(data))]
    )


def words(data: np.ndarray, offsets: np.ndarray, between: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first byte, byte after the last, n + 1 word numbers at which texts begin)."""
    inside = ~between[data]
    cut = np.zeros(len(data) + 1, bool)
    cut[offsets] = True
    before, after = cut[:-1].copy(), cut[1:].copy()
    before[1:] |= ~inside[:-1]
    after[:-1] |= ~inside[1:]
    starts, ends = np.flatnonzero(inside & before), np.flatnonzero(inside & after) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def lines(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """As `words`, for the lines between line feeds; an empty text is one empty line."""
    breaks = np.flatnonzero(data == 10)
    n_breaks = np.searchsorted(breaks, offsets)
    bounds = n_breaks + np.arange(len(offsets))
    starts, ends = np.empty(bounds[-1], np.int64), np.empty(bounds[-1], np.int64)
    text = np.repeat(np.arange(len(offsets) - 1), np.diff(n_breaks))
    at = np.arange(len(breaks)) + text
    starts[bounds[:-1]] = offsets[:-1]
    starts[at + 1] = breaks + 1
    ends[bounds[1:] - 1] = offsets[1:]
    ends[at] = breaks
    return starts, ends, bounds


def owners(bounds: np.ndarray) -> np.ndarray:
    """Number of the text that each word or line belongs to."""
    return np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))


def hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of spans, which stand in order and don't overlap."""
    out = np.empty(len(starts), np.uint64)
    at = 0
    while at < len(starts):
        base = starts[at]
        to = max(int(np.searchsorted(ends, base + _SLAB, "right")), at + 1)
        n = int(ends[to - 1] - base)
        up, down = (_UP, _DOWN) if n <= _SLAB else (_powers(_BASE, n + 1), _powers(pow(_BASE, -1, 2**64), n + 1))
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(_BYTES[data[base : base + n]] * up[:n], out=sums[1:])
        s, e = starts[at:to] - base, ends[at:to] - base
        out[at:to] = (sums[e] - sums[s]) * down[s]
        at = to
    return mix(out + (ends - starts).astype(np.uint64) * np.uint64(0xA0761D6478BD642F))


def grams(h: np.ndarray, at: np.ndarray, k: int) -> np.ndarray:
    """Hashes of the k words from each of the places `at`."""
    out = np.zeros(len(at), np.uint64)
    for j in range(k):
        out = out * _GRAM + h[at + j]
    return mix(out + np.uint64(k))


def gram_starts(bounds: np.ndarray, k: int) -> np.ndarray:
    """Words from which k words of the same text follow, itself included."""
    n = np.maximum(np.diff(bounds) - k + 1, 0)
    total = int(n.sum())
    return np.arange(total) + np.repeat(bounds[:-1] - (np.cumsum(n) - n), n)


def covered(at: np.ndarray, k: int, n: int) -> np.ndarray:
    """Which of n words lie in a window of k words from one of the places."""
    edges = np.bincount(at, minlength=n + k + 1).astype(np.int64)
    edges[k:] -= np.bincount(at, minlength=n + 1)[: n + 1].astype(np.int64)
    return np.cumsum(edges)[:n] > 0


def runs(ordered: np.ndarray) -> np.ndarray:
    """Places at which a new value begins in a sorted array."""
    if not len(ordered):
        return np.zeros(0, np.int64)
    return np.flatnonzero(np.concatenate(([True], ordered[1:] != ordered[:-1])))


def joined(data: np.ndarray, offsets: np.ndarray, starts: np.ndarray, ends: np.ndarray, bounds: np.ndarray, keep: np.ndarray, by: int) -> tuple[np.ndarray, np.ndarray]:
    """Texts of the kept words or lines with one byte `by` between them: (bytes, offsets).

    Every span but the last of a text has a byte behind it that belongs to no span.
    """
    change = np.zeros(len(data) + 1, np.int8)
    np.add.at(change, starts[keep], 1)
    np.add.at(change, ends[keep], -1)
    mask = np.cumsum(change[:-1], dtype=np.int8) > 0
    kept = np.flatnonzero(keep)
    text = owners(bounds)[kept]
    inner = np.zeros(len(kept), bool)
    inner[:-1] = text[:-1] == text[1:]
    out = data.copy()
    out[ends[kept[inner]]] = by
    mask[ends[kept[inner]]] = True
    size = np.concatenate(([0], np.cumsum(mask)))
    return out[mask], size[offsets]
