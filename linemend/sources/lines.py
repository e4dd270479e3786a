"""Physical lines and blocks of lines.

A *line* row is `(file, part, id, value)`: `part` is the byte offset of the input split
and `id` rises along the split, so `(part, id)` is the order of lines in a file.

A *block* row is `(file, part, seq, text)`: about `BLOCK_BYTES` of whole lines of one
split, each ended by a newline. Blocks let the record repair run without moving lines
between tasks: the order of lines inside a block needs no sort and no window. The part of
a block is a byte offset too, the same for at most `BLOCKS_PER_PART` blocks, also where
a split cannot be cut (a compressed file).
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import decode_utf8_lossy

BLOCK_BYTES = 2 << 20
BLOCKS_PER_PART = 32
BLOCK_SCHEMA = "file string, part long, seq long, text binary"


def scan_lines(spark: SparkSession, path: str | list[str], file: Column | None = None) -> DataFrame:
    """Lines of headerless text files. Only `\\n` ends a line; values keep their raw bytes."""
    return spark.read.option("lineSep", "\n").text(path).select(
        (F.col("_metadata.file_path") if file is None else file).alias("file"),
        F.col("_metadata.file_block_start").alias("part"),
        F.monotonically_increasing_id().alias("id"),
        "value",
    )


def scan_delimited(spark: SparkSession, path: str | list[str], sep: str = "|", file: Column | None = None) -> DataFrame:
    """(file, part, id, fields) of text files whose lines are whole records: no header, no
    quoting, invalid UTF-8 replaced, one carriage return at the end of a line dropped."""
    text = F.regexp_replace(decode_utf8_lossy(F.col("value")), r"\r\z", "")
    pattern = sep if sep.isalnum() else "\\" + sep
    return scan_lines(spark, path, file).select("file", "part", "id", F.split(text, pattern, -1).alias("fields"))


def lines_of_rows(df: DataFrame, file: Column, value: Column) -> DataFrame:
    """Rows that already hold pipe text (possibly with line breaks) as a line source.

    The file order is the row order of `df`; each task's rows are one split.
    """
    return df.select(
        file.cast("string").alias("file"),
        F.shiftleft(F.spark_partition_id().cast("long"), 40).alias("part"),
        F.monotonically_increasing_id().alias("id"),
        value.alias("value"),
    )


def pack_blocks(lines: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Join the lines of each split into blocks; a narrow pass over Arrow batches."""

    def pack(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split = part = first = None
        done = blocks = size = 0  # bytes and blocks of this split so far, bytes of the pending block
        pending: list[bytes] = []
        for batch in batches:
            for start, stop in _runs(batch, block_bytes):
                key = (batch.column("file")[start].as_py(), batch.column("part")[start].as_py())
                if pending and (key != split or size >= block_bytes):
                    yield block_batch(split[0], part, first, b"".join(pending))
                    done, blocks, pending, size = done + size, blocks + 1, [], 0
                if key != split:
                    split, done, blocks = key, 0, 0
                if not pending:
                    first = batch.column("id")[start].as_py()
                    part = split[1] + done if blocks % BLOCKS_PER_PART == 0 else part
                pending.append(_joined(batch.column("value").slice(start, stop - start)))
                size += len(pending[-1])
        if pending:
            yield block_batch(split[0], part, first, b"".join(pending))

    return lines.select(
        F.coalesce("file", F.lit("")).alias("file"),
        "part",
        "id",
        F.coalesce(F.col("value").cast("binary"), F.lit(b"")).alias("value"),
    ).mapInArrow(pack, BLOCK_SCHEMA)


def _runs(batch: pa.RecordBatch, block_bytes: int) -> list[tuple[int, int]]:
    """Stretches of equal (file, part) of at most about `block_bytes`."""
    if not batch.num_rows:
        return []
    part = batch.column("part").to_numpy()
    name = batch.column("file").dictionary_encode().indices.to_numpy()
    filled = np.cumsum(pc.binary_length(batch.column("value")).to_numpy().astype("int64") + 1) // block_bytes
    cuts = np.flatnonzero((np.diff(part) != 0) | (np.diff(name) != 0) | (np.diff(filled) != 0)) + 1
    edges = [0, *cuts.tolist(), batch.num_rows]
    return list(zip(edges, edges[1:]))


def _joined(values: pa.Array) -> bytes:
    """Values joined by newlines, with one at the end."""
    joined = pc.binary_join(pa.ListArray.from_arrays([0, len(values)], values), b"\n")
    return joined[0].as_py() + b"\n"


def block_batch(file: str, part: int, seq: int, text: bytes) -> pa.RecordBatch:
    """One block as an Arrow batch."""
    return pa.RecordBatch.from_pydict(
        {"file": [file], "part": [part], "seq": [seq], "text": [text]},
        schema=pa.schema([("file", pa.string()), ("part", pa.int64()), ("seq", pa.int64()), ("text", pa.binary())]),
    )
