"""Zip archives as a Spark data source: a partition an archive, and a limit that stops the reading.

`spark.read.format("zip_blocks")` needs two options: `archives`, a JSON array of [key, path], and, where
only heads are wanted, `limit_blocks`. A deflate stream is read from its start, so the first blocks of an archive
cost what they hold, whatever stands behind them.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from itertools import islice

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from .archives import member_blocks
from .lines import BLOCK_BYTES, BLOCK_SCHEMA, BLOCKS_PER_PART, block_batch


class Archive(InputPartition):
    def __init__(self, key: str, path: str):
        super().__init__((key, path))


class ZipBlocks(DataSource):
    @classmethod
    def name(cls) -> str:
        return "zip_blocks"

    def schema(self) -> str:
        return BLOCK_SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return ZipBlocksReader(dict(self.options))


class ZipBlocksReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.archives = json.loads(options["archives"])
        self.limit = int(options["limit_blocks"]) if "limit_blocks" in options else None
        self.block_bytes = int(options.get("block_bytes", BLOCK_BYTES))

    def partitions(self) -> list[Archive]:
        return [Archive(key, path) for key, path in self.archives]

    def read(self, partition: Archive | None) -> Iterator[pa.RecordBatch]:
        if partition is None:  # no archives
            return
        key, path = partition.value
        for n, text in enumerate(islice(member_blocks(path, None, self.block_bytes), self.limit)):
            yield block_batch(key, n // BLOCKS_PER_PART, n, text)


def scan_archives(spark: SparkSession, archives: DataFrame, limit_blocks: int | None = None, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Blocks of the first member of each archive in `(catalog_key, zip_path)` rows, of which the names go
    through the driver, or only its first `limit_blocks`."""
    spark.dataSource.register(ZipBlocks)
    listed = [[row["catalog_key"], row["zip_path"]] for row in archives.select("catalog_key", "zip_path").collect()]
    reader = spark.read.format("zip_blocks").option("archives", json.dumps(listed)).option("block_bytes", str(block_bytes))
    return (reader if limit_blocks is None else reader.option("limit_blocks", str(limit_blocks))).load()


def sample_head(spark: SparkSession, archives: DataFrame, n_blocks: int, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The first blocks of each archive; nothing behind them is read."""
    return scan_archives(spark, archives, n_blocks, block_bytes)
