"""Files on storage: listing, and inflating zip archives to blocks."""

from __future__ import annotations

import zipfile
import zlib
from collections.abc import Iterable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import file_name
from .lines import BLOCK_BYTES, BLOCK_SCHEMA, BLOCKS_PER_PART, block_batch


def list_files(spark: SparkSession, folder: str, glob: str = "*") -> DataFrame:
    """(path, name, size) of the files in a folder; contents are not read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).load(folder)
    return files.select("path", file_name(F.col("path")).alias("name"), F.col("length").alias("size"))


def inflate_archives(
    archives: DataFrame, limit_bytes: int | None = None, block_bytes: int = BLOCK_BYTES, tasks: int | None = None,
    failures: bool = False, carry: Sequence[str] = (),
) -> DataFrame:
    """Blocks of the first member of each zip archive in `(catalog_key, zip_path)` rows.

    A deflate stream can only be read from its start, so one task reads one archive. The
    task does nothing else: it cuts the stream at line ends and hands the blocks on.
    `limit_bytes` reads only the head of each member; `tasks` is the number of archives,
    counted where it is not given. With `failures` an archive that cannot be read gives a last,
    empty block that holds the reason in `error`, and the other archives go on. `carry` names
    columns of the archives that every block repeats.
    """
    carried = [f"{name} {archives.schema[name].dataType.simpleString()}" for name in carry]
    schema = ", ".join([BLOCK_SCHEMA, *carried, *(["error string"] if failures else [])])

    def inflate(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, (key, path) in enumerate(zip(batch.column("catalog_key").to_pylist(), batch.column("zip_path").to_pylist())):

                def block(part: int, seq: int, text: bytes, error: str | None = None) -> pa.RecordBatch:
                    result = block_batch(key, part, seq, text)
                    for name in carry:
                        result = result.append_column(name, batch.column(name).slice(row, 1))
                    return result.append_column("error", pa.array([error], pa.string())) if failures else result

                n = 0
                try:
                    for text in member_blocks(path, limit_bytes, block_bytes):
                        yield block(n // BLOCKS_PER_PART, n, text)
                        n += 1
                except (OSError, EOFError, IndexError, zipfile.BadZipFile, zlib.error, NotImplementedError) as error:
                    if not failures:
                        raise
                    yield block(n // BLOCKS_PER_PART, n, b"", f"{type(error).__name__}: {error}")

    paths = archives.select("catalog_key", "zip_path", *carry)
    one_per_task = paths.repartitionByRange(tasks or max(paths.count(), 1), "catalog_key")
    return one_per_task.mapInArrow(inflate, schema)


def member_blocks(path: str, limit: int | None, block_bytes: int) -> Iterator[bytes]:
    """The first member of an archive, or its first `limit` bytes, cut at line ends as it is inflated."""
    with _open(path) as raw, zipfile.ZipFile(raw) as archive, archive.open(archive.namelist()[0]) as member:
        left = limit if limit is not None else float("inf")
        rest: list[bytes] = []
        while left > 0 and (chunk := member.read(int(min(block_bytes, left)))):
            left -= len(chunk)
            cut = chunk.rfind(b"\n") + 1
            if cut:
                yield b"".join([*rest, chunk[:cut]])
                rest = []
            if cut < len(chunk):
                rest.append(chunk[cut:])
        # At a limit inside the member the last line is torn and left out.
        if rest and (left > 0 or not member.read(1)):
            yield b"".join(rest) + b"\n"


def _open(path: str):
    """A seekable byte stream on any file system Arrow knows."""
    if "://" not in path and not path.startswith("file:"):
        return open(path, "rb")
    if path.startswith("file:"):
        return open("/" + path.removeprefix("file:").lstrip("/"), "rb")
    from pyarrow import fs

    store, inner = fs.FileSystem.from_uri(path)
    return store.open_input_file(inner)
