"""Bounded-space online packing of token sequences.

A task reads its documents once. Of a document, every full window is a sequence of its own; the
rest is placed best-fit into one of `OPEN` open windows. When none has room, the fullest is
emitted and a new one opened, so a task holds `OPEN` counters whatever it reads. What is open at
the end goes, as windows of known size, to a merge of the tasks' leftovers: in rounds of at most
`OPEN * FAN_IN` windows a group, best-fit with the largest first, until one group is left. Of what a
group has merged, the `OPEN` least full windows go on to the next round and the others stay as they
are, so that bound holds in every round, the last one included, whatever the number of tasks.

Pieces are written once to a table in the shared folder, so that a lost executor cannot bring a
second, different numbering; the merge only moves whole windows.

Nulls: a null text is an empty one, with the end id alone; a null id stays null. Repeated rows are
documents of their own.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import work_dir
from . import text, tokens

LENGTH = 4096
OPEN = 64
FAN_IN = 64
END_ID = 2
BATCH_BYTES = 1 << 20
TASK_BITS = 32

PIECES = "id long, start long, length long, ids_crc32 long, doc_tokens long, window long, offset long, open boolean"


class Windows:
    """The open windows of a task: sizes in order, emitted or filled by best fit."""

    def __init__(self, first: int):
        self.next = first
        self.sizes: list[tuple[int, int]] = []  # (used, window), ascending

    def new(self) -> int:
        self.next += 1
        return self.next - 1

    def place(self, n: int) -> tuple[int, int]:
        """(window, offset in it) for a piece of n ids."""
        # The fullest with room: the last whose use is at most LENGTH - n.
        at = bisect_left(self.sizes, (LENGTH - n + 1, -1)) - 1
        if at >= 0:
            used, window = self.sizes.pop(at)
        else:
            if len(self.sizes) >= OPEN:
                self.sizes.pop()
            used, window = 0, self.new()
        if used + n < LENGTH:
            insort(self.sizes, (used + n, window))
        return window, used


def _pieces(path: str, end_id: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    task = TaskContext.get().partitionId()
    windows = Windows(task << TASK_BITS)
    encode = tokens.encoder(path)
    for batch in batches:
        sizes = text.text_bytes(batch.column(1))[1]
        at = 0
        while at < batch.num_rows:
            to = max(int(np.searchsorted(sizes, sizes[at] + BATCH_BYTES, "right")) - 1, at + 1)
            part = batch.slice(at, to - at)
            ids, places = encode.batch(*text.text_bytes(part.column(1)), end_id)
            yield _placed(part.column(0).to_pylist(), ids, places.tolist(), windows)
            at = to
    last = [window for _, window in windows.sizes]
    if last:
        # The windows that are still open, as rows without length.
        n = len(last)
        none, zero = pa.nulls(n, pa.int64()), pa.array([0] * n, pa.int64())
        yield pa.RecordBatch.from_arrays(
            [none, zero, zero, zero, zero, pa.array(last, pa.int64()), pa.array([used for used, _ in windows.sizes], pa.int64()), pa.array([True] * n)],
            _NAMES,
        )


_NAMES = ["id", "start", "length", "ids_crc32", "doc_tokens", "window", "offset", "open"]


def _placed(doc_ids: list, ids: np.ndarray, places: list[int], windows: Windows) -> pa.RecordBatch:
    out: list[list] = [[] for _ in _NAMES]
    raw = memoryview(ids.astype("<u4").tobytes())
    for i, doc in enumerate(doc_ids):
        first, size = places[i], places[i + 1] - places[i]
        for start in range(0, size, LENGTH):
            n = min(LENGTH, size - start)
            window, offset = windows.place(n) if n < LENGTH else (windows.new(), 0)
            crc = zlib.crc32(raw[4 * (first + start) : 4 * (first + start + n)])
            for column, value in zip(out, (doc, start, n, crc, size, window, offset, False), strict=True):
                column.append(value)
    return pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in out[:-1]), pa.array(out[-1], pa.bool_())], _NAMES)


def _merge(windows: pd.DataFrame) -> pd.DataFrame:
    """Whole windows into fewer: (window, target, base), the target's use, and whether it goes on."""
    rows = windows.sort_values(["used", "window"], ascending=[False, True])
    bins: list[tuple[int, int]] = []
    out, total = [], {}
    for window, used in zip(rows["window"].tolist(), rows["used"].tolist(), strict=True):
        at = bisect_left(bins, (LENGTH - used + 1, -1)) - 1
        base, target = bins.pop(at) if at >= 0 else (0, window)
        total[target] = base + used
        out.append((window, target, base))
        if base + used < LENGTH:
            insort(bins, (base + used, target))
    on = {target for _, target in bins[:OPEN]}
    return pd.DataFrame([(w, t, b, total[t], t in on) for w, t, b in out], columns=["window", "target", "base", "target_used", "on"])


MOVES = "window long, target long, base long, target_used long, on boolean"


def merged(spark: SparkSession, open_windows: DataFrame, tasks: int) -> DataFrame:
    """(window, target, base) for the leftovers (window, used) of a number of tasks."""
    moves = open_windows.select(
        "window", F.col("window").alias("target"), F.lit(0).cast("long").alias("base"), F.col("used").alias("target_used"), F.lit(True).alias("on")
    )
    span = 1
    while True:
        span *= FAN_IN
        group = F.shiftright(F.col("target"), TASK_BITS) / F.lit(span)
        heads = moves.filter("on").groupBy("target").agg(F.max("target_used").alias("used")).withColumn("part", F.floor(group))
        step = heads.withColumnRenamed("target", "window").groupBy("part").applyInPandas(_merge, MOVES)
        step = step.select(F.col("window").alias("target"), F.col("target").alias("to"), F.col("base").alias("more"), F.col("target_used").alias("sum"), F.col("on").alias("further"))
        # Windows that stay as they are have no step.
        moved = moves.join(step, "target", "left").select(
            "window",
            F.coalesce("to", "target").alias("target"),
            (F.col("base") + F.coalesce("more", F.lit(0))).alias("base"),
            F.coalesce("sum", "target_used").alias("target_used"),
            F.coalesce("further", F.lit(False)).alias("on"),
        )
        path = work_dir(spark, "moves")
        moved.write.parquet(path)
        moves = spark.read.parquet(path)
        if span >= tasks:
            return moves.select("window", "target", "base")


def pack(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = END_ID) -> DataFrame:
    """(id, start, length, ids_crc32, doc_tokens, sequence_id, offset) of every piece."""
    spark = docs.sparkSession

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _pieces(tokenizer, end_id, batches)

    source = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    path = work_dir(spark, "pieces")
    source.mapInArrow(pieces, PIECES).write.parquet(path)
    rows = spark.read.parquet(path)
    left = rows.filter("open").select("window", F.col("offset").alias("used"))
    tasks = (rows.agg(F.max(F.shiftright("window", TASK_BITS))).first()[0] or 0) + 1
    moves = merged(spark, left, tasks)
    placed = rows.filter("not open").join(moves, "window", "left")
    return placed.select(
        "id",
        "start",
        "length",
        "ids_crc32",
        "doc_tokens",
        F.coalesce("target", "window").alias("sequence_id"),
        (F.col("offset") + F.coalesce("base", F.lit(0))).alias("offset"),
    )
