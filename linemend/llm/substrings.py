"""Substring dedup by fixed-block anchors.

Every document is cut into non-overlapping reference blocks of 7 words. They are the index. All
rolling windows of 7 words of all documents probe it. Any 13 consecutive words hold exactly one
whole block of their own document, so a repeat of 13 words shows as a hit at its block, whatever
the place in the other document. From the hits, repeats are extended: windows of 13 words that
hold a hit are compared whole, and adjoining ones form maximal exact repeats.

    texts -(blocks and probes, one packed row per chunk and shard)-> shards -(hit bits)-> texts
          -(13-word windows at hits, with the first document)-> shards -(bits)-> texts

The texts are exchanged once, by chunk, and that exchange is used for all three steps. Anchors
are compared by 32 bits within a shard, which only adds candidates; whole windows by 64 bits.

Nulls: a null text has no words; a row without id is never an earlier document. Empty and very
short texts keep all their words. Rows with the same id never cost each other words.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import shards, text

WINDOW = 13
#: The longest block of which each window holds a whole one.
BLOCK = (WINDOW + 1) // 2

PROBES = "shard int, chunk long, n long, keys binary, block binary, several binary"
WINDOWS = "shard int, chunk long, n long, keys binary, base long, docs binary"
RESULT = "id long, n_words long, n_removed long, kept_text string, removed array<struct<start:long,end:long>>"


class _Chunk:
    """Words of the texts of a chunk and their distinct anchors, in an order any step repeats."""

    def __init__(self, table: pa.Table, plan: shards.Layout):
        self.plan, self.ids = plan, text.longs(table["id"])
        self.data, self.offsets = text.text_bytes(table["text"])
        self.starts, self.ends, self.bounds = text.words(self.data, self.offsets)
        self.hashes = text.hashes(self.data, self.starts, self.ends)
        self.doc = text.owners(self.bounds)
        long_enough = np.diff(self.bounds) >= WINDOW
        at = text.gram_starts(self.bounds, BLOCK)
        self.at = at[long_enough[self.doc[at]]]
        key = text.grams(self.hashes, self.at, BLOCK) >> np.uint64(32 - plan.shard_bits)
        self.order = np.argsort(key, kind="stable")
        ordered = key[self.order]
        self.first = text.runs(ordered)
        self.keys = ordered[self.first]

    def spread(self, flags: np.ndarray) -> np.ndarray:
        """From distinct anchors to all words of the chunk."""
        out = np.zeros(len(self.doc), bool)
        sizes = np.diff(np.append(self.first, len(self.order)))
        out[self.at[self.order]] = np.repeat(flags, sizes)
        return out

    def windows(self, hit: np.ndarray) -> None:
        """Windows that hold a hit: places, and distinct hashes with the first document."""
        at = text.gram_starts(self.bounds, WINDOW)
        seen = np.concatenate(([0], np.cumsum(hit)))
        self.window = at[seen[at + WINDOW - BLOCK + 1] > seen[at]]
        key = text.grams(self.hashes, self.window, WINDOW)
        order = np.argsort(key, kind="stable")
        ordered, ids = key[order], self.ids[self.doc[self.window]][order]
        first = text.runs(ordered)
        self.window_keys = ordered[first]
        self.window_doc = np.minimum.reduceat(ids, first) if len(first) else np.zeros(0, np.int64)
        self.window_of = np.empty(len(order), np.int64)
        self.window_of[order] = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(order))))


def _chunk_number(table: pa.Table) -> int:
    return table["chunk"][0].as_py()


def _probe(plan: shards.Layout, table: pa.Table) -> pa.Table:
    """A row per shard: distinct rolling hashes, which of them are blocks, which stand in several documents."""
    c = _Chunk(table, plan)
    place = (c.at - c.bounds[c.doc[c.at]])[c.order]
    ids = c.ids[c.doc[c.at]][c.order]
    if len(c.first):
        block = np.maximum.reduceat(place % BLOCK == 0, c.first)
        several = np.minimum.reduceat(ids, c.first) != np.maximum.reduceat(ids, c.first)
    else:
        block = several = np.zeros(0, bool)
    rows, chunk = [], _chunk_number(table)
    for shard, part in shards.cut(plan, c.keys, 32 + plan.shard_bits):
        keys = (c.keys[part] & np.uint64(0xFFFFFFFF)).astype("<u4")
        rows.append((shard, chunk, len(keys), keys.tobytes(), np.packbits(block[part]).tobytes(), np.packbits(several[part]).tobytes()))
    return _table(rows, ("shard", pa.int32()), ("chunk", pa.int64()), ("n", pa.int64()), ("keys", pa.binary()), ("block", pa.binary()), ("several", pa.binary()))


def _table(rows: list[tuple], *columns: tuple[str, pa.DataType]) -> pa.Table:
    return pa.table({name: pa.array([r[i] for r in rows], kind) for i, (name, kind) in enumerate(columns)})


def _bits(column, n: list[int]) -> np.ndarray:
    parts = [np.unpackbits(np.frombuffer(b, np.uint8), count=k) for b, k in zip(text.binaries(column), n, strict=True)]
    return np.concatenate(parts).astype(bool)


def _hits(table: pa.Table) -> pa.Table:
    """Bits for the hashes that are a block somewhere and stand in more than one document."""
    n = text.longs(table["n"]).tolist()
    keys = np.frombuffer(b"".join(text.binaries(table["keys"])), "<u4")
    order = np.argsort(keys, kind="stable")
    first = text.runs(keys[order])
    sizes = np.diff(np.append(first, len(keys)))
    block = np.logical_or.reduceat(_bits(table["block"], n)[order], first)
    several = np.logical_or.reduceat(_bits(table["several"], n)[order], first) | (sizes > 1)
    out = np.empty(len(keys), bool)
    out[order] = np.repeat(block & several, sizes)
    return shards.answer(list(zip(text.longs(table["chunk"]).tolist(), n, strict=True)), 0, out, table["shard"][0].as_py())


def _extend(plan: shards.Layout, left: pa.Table, right: pa.Table) -> pa.Table:
    """A row per shard: the windows of a chunk that hold a hit."""
    if not len(left):
        return _table([], ("shard", pa.int32()), ("chunk", pa.int64()), ("n", pa.int64()), ("keys", pa.binary()), ("base", pa.int64()), ("docs", pa.binary()))
    c = _Chunk(left, plan)
    c.windows(c.spread(shards.flags(plan, c.keys, 32 + plan.shard_bits, right.to_pylist(), 0)))
    rows, chunk = [], _chunk_number(left)
    for shard, part in shards.cut(plan, c.window_keys, 64):
        docs = c.window_doc[part]
        base = int(docs.min())
        off = docs.astype(np.uint64) - np.uint64(base & (2**64 - 1))
        off = off.astype("<u4" if int(off.max()) < 2**32 else "<u8")
        rows.append((shard, chunk, len(docs), c.window_keys[part].astype("<u8").tobytes(), base, off.tobytes()))
    return _table(rows, ("shard", pa.int32()), ("chunk", pa.int64()), ("n", pa.int64()), ("keys", pa.binary()), ("base", pa.int64()), ("docs", pa.binary()))


def _repeats(table: pa.Table) -> pa.Table:
    """Bits for the windows that also start in a document before the chunk's first one."""
    n = text.longs(table["n"]).tolist()
    keys = np.frombuffer(b"".join(text.binaries(table["keys"])), "<u8")
    docs = np.concatenate(
        [
            (np.frombuffer(b, f"<u{len(b) // k}").astype(np.uint64) + np.uint64(base & (2**64 - 1))).astype(np.int64)
            for b, k, base in zip(text.binaries(table["docs"]), n, text.longs(table["base"]).tolist(), strict=True)
        ]
    )
    order = np.argsort(keys, kind="stable")
    first = text.runs(keys[order])
    least = np.repeat(np.minimum.reduceat(docs[order], first), np.diff(np.append(first, len(keys))))
    out = np.empty(len(keys), bool)
    out[order] = docs[order] > least
    return shards.answer(list(zip(text.longs(table["chunk"]).tolist(), n, strict=True)), 1, out, table["shard"][0].as_py())


def _remove(plan: shards.Layout, left: pa.Table, right: pa.Table) -> pa.Table:
    """Texts without the words of repeats, and the maximal repeats as spans of words."""
    c = _Chunk(left, plan)
    told = right.to_pylist()
    c.windows(c.spread(shards.flags(plan, c.keys, 32 + plan.shard_bits, told, 0)))
    earlier = shards.flags(plan, c.window_keys, 64, told, 1)
    again = earlier[c.window_of] | (c.ids[c.doc[c.window]] > c.window_doc[c.window_of])
    gone = text.covered(c.window[again], WINDOW, len(c.doc))
    data, offsets = text.joined(c.data, c.offsets, c.starts, c.ends, c.bounds, ~gone, 0x20)
    n = np.concatenate(([0], np.cumsum(gone)))
    # A repeat ends where the next word stays or another text begins.
    fresh = np.zeros(len(c.doc) + 1, bool)
    fresh[c.bounds] = True
    before, after = np.append(False, gone[:-1]), np.append(gone[1:], False)
    begin = np.flatnonzero(gone & (~before | fresh[:-1]))
    end = np.flatnonzero(gone & (~after | fresh[1:])) + 1
    base = c.bounds[c.doc[begin]]
    spans = pa.StructArray.from_arrays([pa.array(begin - base, pa.int64()), pa.array(end - base, pa.int64())], ["start", "end"])
    return pa.table(
        {
            "id": pa.array(c.ids, pa.int64(), mask=c.ids == 2**63 - 1),
            "n_words": pa.array(np.diff(c.bounds), pa.int64()),
            "n_removed": pa.array(n[c.bounds[1:]] - n[c.bounds[:-1]], pa.int64()),
            "kept_text": text.strings(data, offsets).cast(pa.string()),
            "removed": pa.ListArray.from_arrays(pa.array(np.searchsorted(begin, c.bounds), pa.int32()), spans),
        }
    )


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Documents without the words that a window of 13 words shares with an earlier document.

    (id, n_words, n_removed, kept_text, removed): kept words joined by one space, and the spans
    of removed words. One row for each row of the input.
    """
    plan = shards.layout(docs, text_col)

    def probe(table: pa.Table) -> pa.Table:
        return _probe(plan, table)

    def extend(left: pa.Table, right: pa.Table) -> pa.Table:
        return _extend(plan, left, right)

    def remove(left: pa.Table, right: pa.Table) -> pa.Table:
        return _remove(plan, left, right)

    chunks = shards.chunked(docs, plan, id_col, text_col)
    probes = chunks.groupBy("chunk").applyInArrow(probe, PROBES)
    hits = probes.groupBy("shard").applyInArrow(_hits, shards.BITS).repartition("chunk")
    windows = chunks.groupBy("chunk").cogroup(hits.groupBy("chunk")).applyInArrow(extend, WINDOWS)
    repeats = windows.groupBy("shard").applyInArrow(_repeats, shards.BITS)
    told = hits.unionByName(repeats)
    return chunks.groupBy("chunk").cogroup(told.groupBy("chunk")).applyInArrow(remove, RESULT)
