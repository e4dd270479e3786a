"""Exchange of sorted hash sets between chunks of documents and shards of the hash range.

Chunks are groups of documents of about equal size. A chunk sends each shard one row with the
sorted distinct hashes that it holds there, the shard answers with one bit for each of them. A
copy held by a thousand documents of a chunk is sent once, so hot hashes stay small; nothing is
ever looked up by one row per word. Both numbers follow the size of the input.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CHUNK_BYTES = 4 << 20
SHARD_BYTES = 16 << 20

BITS = "chunk long, shard int, kind int, bits binary"


@dataclass(frozen=True)
class Layout:
    chunks: int
    shard_bits: int

    def cuts(self, top: np.ndarray) -> np.ndarray:
        """Places at which the shards begin among sorted shard numbers."""
        return np.searchsorted(top, np.arange((1 << self.shard_bits) + 1))


def layout(docs: DataFrame, text: str) -> Layout:
    """One pass over the lengths of the texts."""
    size = docs.agg(F.sum(F.octet_length(F.col(text)).cast("long"))).first()[0] or 0
    return Layout(max(1, math.ceil(size / CHUNK_BYTES)), min(24, max(0, math.ceil(math.log2(max(1, size / SHARD_BYTES))))))


def chunked(docs: DataFrame, plan: Layout, id_col: str, text: str, carry: Column | None = None) -> DataFrame:
    """(chunk, id, text[, carry]) of documents; equal rows share a chunk.

    A missing id stands behind all others, so such a row never counts as an earlier document.
    """
    columns = [F.coalesce(F.col(id_col).cast("long"), F.lit(2**63 - 1)).alias("id"), F.col(text).alias("text")]
    out = docs.select(*columns, *([carry.alias("carry")] if carry is not None else []))
    return out.select(F.pmod(F.xxhash64("id", "text"), F.lit(plan.chunks)).alias("chunk"), "*")


def cut(plan: Layout, keys: np.ndarray, width: int) -> Iterator[tuple[int, slice]]:
    """(shard, its part) of sorted keys of `width` bits."""
    at = plan.cuts((keys >> np.uint64(width - plan.shard_bits)).astype(np.int64)) if plan.shard_bits else np.array([0, len(keys)])
    for shard in np.flatnonzero(np.diff(at)):
        yield int(shard), slice(int(at[shard]), int(at[shard + 1]))


def answer(rows: list[tuple[int, int]], kind: int, flags: np.ndarray, shard: int) -> pa.Table:
    """Bits for the chunks: rows are (chunk, number of its keys) in the order of the flags."""
    out, at = [], 0
    for chunk, n in rows:
        part = flags[at : at + n]
        if part.any():
            out.append((chunk, np.packbits(part).tobytes()))
        at += n
    return pa.table(
        {
            "chunk": pa.array([c for c, _ in out], pa.int64()),
            "shard": pa.array([shard] * len(out), pa.int32()),
            "kind": pa.array([kind] * len(out), pa.int32()),
            "bits": pa.array([b for _, b in out], pa.binary()),
        }
    )


def flags(plan: Layout, keys: np.ndarray, width: int, rows: list[dict], kind: int) -> np.ndarray:
    """What the shards have answered for each of a chunk's sorted keys."""
    out = np.zeros(len(keys), bool)
    told = {row["shard"]: row["bits"] for row in rows if row["kind"] == kind}
    for shard, part in cut(plan, keys, width):
        if shard in told:
            n = part.stop - part.start
            out[part] = np.unpackbits(np.frombuffer(told[shard], np.uint8), count=n).astype(bool)
    return out
