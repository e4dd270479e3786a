"""Line dedup with a sharded minimal perfect hash.

The hash range of line keys is cut into shards. Each shard numbers its distinct keys by a minimal
perfect hash and keeps plain arrays by that number: a 32-bit fingerprint, the number of documents,
the first document. Documents probe the arrays chunk by chunk, with one packed row of distinct
keys for each shard, and get a bit for each key back: seen in an earlier document or not. Lines
themselves are never joined or grouped.

A line's key is the line without white space at both ends, A-Z in lower case. Keys of at least 10
code points take part. All lines with a key that an earlier document holds are dropped; the first
document keeps all of its own.

Nulls: a null or empty text is one empty line; a row without id is never an earlier document.
Rows with the same id count as one document.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from . import hashing, shards, text

MIN_CHARS = 10

PROBES = "shard int, chunk long, n long, keys binary, first binary, n_docs binary"
INDEX = "shard int, n long, sizes array<long>, cells binary, rest binary, prints binary, counts binary, first binary"
_FINGERPRINT = np.uint64(0x632BE59BD9B4E019)


class _Chunk:
    """Lines of the texts of a chunk, their keys and the distinct ones among them."""

    def __init__(self, table: pa.Table):
        self.ids = text.longs(table["id"])
        self.data, self.offsets = text.text_bytes(table["text"])
        self.starts, self.ends, self.bounds = text.lines(self.data, self.offsets)
        inner = np.flatnonzero(~text.SPACE[self.data])
        begin, end = np.searchsorted(inner, self.starts), np.searchsorted(inner, self.ends)
        filled = np.flatnonzero(end > begin)
        starts, ends = inner[begin[filled]], inner[end[filled] - 1] + 1
        chars = np.concatenate(([0], np.cumsum((self.data & 0xC0) != 0x80)))
        enough = chars[ends] - chars[starts] >= MIN_CHARS
        self.line = filled[enough]
        self.key = text.hashes(text.LOWER[self.data], starts[enough], ends[enough])
        self.doc = text.owners(self.bounds)
        self.keys, self.of = np.unique(self.key, return_inverse=True)
        self.line_ids = self.ids[self.doc[self.line]]
        self.first = np.full(len(self.keys), 2**63 - 1, np.int64)
        np.minimum.at(self.first, self.of, self.line_ids)


def _probe(plan: shards.Layout, table: pa.Table) -> pa.Table:
    """A row per shard: distinct keys of the chunk, first document and number of documents."""
    c = _Chunk(table)
    order = np.lexsort((c.line_ids, c.of))
    of, ids = c.of[order], c.line_ids[order]
    fresh = np.concatenate(([True], (of[1:] != of[:-1]) | (ids[1:] != ids[:-1]))) if len(of) else np.zeros(0, bool)
    n_docs = np.bincount(of[fresh], minlength=len(c.keys))
    chunk = table["chunk"][0].as_py()
    rows = [
        (shard, chunk, part.stop - part.start, c.keys[part].astype("<u8").tobytes(), c.first[part].astype("<i8").tobytes(), n_docs[part].astype("<u4").tobytes())
        for shard, part in shards.cut(plan, c.keys, 64)
    ]
    kinds = (pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary())
    names = ("shard", "chunk", "n", "keys", "first", "n_docs")
    return pa.table({name: pa.array([r[i] for r in rows], kind) for i, (name, kind) in enumerate(zip(names, kinds, strict=True))})


def _prints(keys: np.ndarray) -> np.ndarray:
    return (text.mix(keys ^ _FINGERPRINT) >> np.uint64(32)).astype("<u4")


def _build(table: pa.Table) -> pa.Table:
    """The arrays of one shard."""
    keys = np.frombuffer(b"".join(text.binaries(table["keys"])), "<u8")
    distinct = np.unique(keys)
    sizes, cells, rest = hashing.build(distinct)
    place = hashing.places(keys, sizes, cells, rest)
    prints = np.zeros(len(distinct), "<u4")
    prints[place] = _prints(keys)
    counts = np.zeros(len(distinct), np.int64)
    np.add.at(counts, place, np.frombuffer(b"".join(text.binaries(table["n_docs"])), "<u4").astype(np.int64))
    first = np.full(len(distinct), 2**63 - 1, "<i8")
    np.minimum.at(first, place, np.frombuffer(b"".join(text.binaries(table["first"])), "<i8"))
    return pa.table(
        {
            "shard": table["shard"][:1],
            "n": pa.array([len(distinct)], pa.int64()),
            "sizes": pa.array([sizes], pa.list_(pa.int64())),
            "cells": pa.array([cells], pa.binary()),
            "rest": pa.array([rest], pa.binary()),
            "prints": pa.array([prints.tobytes()], pa.binary()),
            "counts": pa.array([np.minimum(counts, 2**32 - 1).astype("<u4").tobytes()], pa.binary()),
            "first": pa.array([first.tobytes()], pa.binary()),
        }
    )


def _look_up(left: pa.Table, right: pa.Table) -> pa.Table:
    """Bits for the keys that several documents hold, another one before the chunk's first."""
    if not len(left) or not len(right):
        return shards.answer([], 0, np.zeros(0, bool), 0)
    index = right.to_pylist()[0]
    n = text.longs(left["n"]).tolist()
    keys = np.frombuffer(b"".join(text.binaries(left["keys"])), "<u8")
    here = np.frombuffer(b"".join(text.binaries(left["first"])), "<i8")
    place = hashing.places(keys, index["sizes"], index["cells"], index["rest"])
    known = (place >= 0) & (np.frombuffer(index["prints"], "<u4")[place] == _prints(keys))
    earlier = known & (np.frombuffer(index["counts"], "<u4")[place] >= 2) & (np.frombuffer(index["first"], "<i8")[place] < here)
    return shards.answer(list(zip(text.longs(left["chunk"]).tolist(), n, strict=True)), 0, earlier, index["shard"])


def _drop(plan: shards.Layout, left: pa.Table, right: pa.Table) -> pa.Table:
    c = _Chunk(left)
    earlier = shards.flags(plan, c.keys, 64, right.to_pylist(), 0)
    gone = np.zeros(len(c.starts), bool)
    gone[c.line[earlier[c.of] | (c.line_ids > c.first[c.of])]] = True
    data, offsets = text.joined(c.data, c.offsets, c.starts, c.ends, c.bounds, ~gone, 0x0A)
    n = np.concatenate(([0], np.cumsum(gone)))
    return pa.table(
        {
            "id": pa.array(c.ids, pa.int64(), mask=c.ids == 2**63 - 1),
            "n_lines": pa.array(np.diff(c.bounds), pa.int64()),
            "n_dropped": pa.array(n[c.bounds[1:]] - n[c.bounds[:-1]], pa.int64()),
            "kept_text": text.strings(data, offsets).cast(pa.string()),
            **({"carry": text.array_of(left["carry"])} if "carry" in left.column_names else {}),
        }
    )


def line_index(probes: DataFrame) -> DataFrame:
    """One row per shard: perfect hash, fingerprints, counts and first documents."""
    return probes.groupBy("shard").applyInArrow(_build, INDEX)


def drop_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: Column | None = None) -> DataFrame:
    """Documents without the lines that an earlier document holds.

    (id, n_lines, n_dropped, kept_text[, carry]), one row for each row of the input. `carry` is
    a struct of further columns that goes through as it is.
    """
    plan = shards.layout(docs, text_col)

    def probe(table: pa.Table) -> pa.Table:
        return _probe(plan, table)

    def drop(left: pa.Table, right: pa.Table) -> pa.Table:
        return _drop(plan, left, right)

    chunks = shards.chunked(docs, plan, id_col, text_col, carry)
    probes = chunks.select("chunk", "id", "text").groupBy("chunk").applyInArrow(probe, PROBES)
    told = probes.groupBy("shard").cogroup(line_index(probes).groupBy("shard")).applyInArrow(_look_up, shards.BITS)
    # As a type, not as its text: columns that can't be null stay so.
    schema = StructType.fromDDL("id long, n_lines long, n_dropped long, kept_text string")
    if carry is not None:
        schema = schema.add("carry", chunks.schema["carry"].dataType)
    return chunks.groupBy("chunk").cogroup(told.groupBy("chunk")).applyInArrow(drop, schema)


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows and columns of `docs` with the kept lines as text; a null text becomes empty."""
    names = docs.columns
    carry = F.struct(*(F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(names) if c != text_col))
    out = drop_lines(docs, id_col, text_col, carry)
    return out.select(*(F.col("kept_text").alias(c) if c == text_col else F.col(f"carry.c{i}").alias(c) for i, c in enumerate(names)))
