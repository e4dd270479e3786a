"""Arrow batches of (id, text) cut to a bounded number of text bytes, sums by text, and names that are free."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa

#: Text bytes worked on at once; a longer text is worked on by itself.
SLICE_BYTES = 4 << 20


def slices(batches: Iterable[pa.RecordBatch], text: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        column = batch.column(text)
        sizes = column.cast(pa.large_binary()).fill_null(b"") if column.null_count else column.cast(pa.large_binary())
        places = np.frombuffer(sizes.buffers()[1], np.int64)[sizes.offset : sizes.offset + len(sizes) + 1] if len(sizes) else np.zeros(1, np.int64)
        at = 0
        while at < len(batch):
            to = max(int(np.searchsorted(places, places[at] + limit, "right")) - 1, at + 1)
            yield batch.slice(at, to - at)
            at = to


def free_name(name: str, columns: Iterable[str]) -> str:
    """The name, or as many strokes ahead of it as no column has."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def per_text(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sums of the values of each text, whose n + 1 bounds are given."""
    ahead = np.concatenate(([0], np.cumsum(values, dtype=np.int64)))
    return ahead[bounds[1:]] - ahead[bounds[:-1]]
