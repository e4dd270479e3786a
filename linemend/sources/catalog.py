"""Catalog and download-list JSON, schema descriptors, and tables read as they are."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import NA_WORDS, SHEET_COLUMNS, decode_codepage, na_words_to_null, undecodable
from ..session import code_pages, settings
from .lines import scan_lines

CATALOG_ENTRY = "data_category string, dataset_name string, zip_path string, schema_path string, zip_size_bytes bigint"
DOWNLOAD_ITEM = "cat_val string, cat_name string, task_code string, opn_code string, service_name string"


def read_catalog(spark: SparkSession, path: str) -> DataFrame:
    """One row per entry of JSON objects `key -> entry`: one to a file, or one to a line."""
    return _read_json(spark, path, parse_catalog)


def _read_json(spark: SparkSession, path: str, parse: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Files whose lines are JSON by themselves are parsed line by line, in splits; any other file, which is one
    object or array over many lines, as a whole. One pass over the lines tells which files are which; their names go
    through the driver.
    """
    lines = scan_lines(spark, path)
    by_itself = F.try_parse_json("value").isNotNull() | (F.trim(F.regexp_replace("value", r"\s+", " ")) == "")
    status = lines.groupBy("file").agg(F.bool_and(by_itself).alias("by_itself")).collect()
    parts = []
    if of_lines := [row["file"] for row in status if row["by_itself"]]:
        parts.append(scan_lines(spark, of_lines).select("value"))
    if whole := [row["file"] for row in status if not row["by_itself"]]:
        parts.append(spark.read.text(whole, wholetext=True))
    return parse(reduce(DataFrame.unionByName, parts) if parts else lines.select("value"))


def parse_catalog(texts: DataFrame, value: str = "value") -> DataFrame:
    objects = F.from_json(_objects(F.col(value)), f"array<map<string,struct<{_struct(CATALOG_ENTRY)}>>>")
    entries = texts.select(F.explode(objects).alias("object")).select(F.explode("object").alias("catalog_key", "entry"))
    return entries.select("catalog_key", "entry.*")


def _objects(text: Column) -> Column:
    """One JSON array of the objects of a file. A line end between two objects is never inside a
    string, where it would be escaped."""
    body = F.trim(F.regexp_replace(text, r"\A\s+|\s+\z", ""))
    listed = F.concat(F.lit("["), F.regexp_replace(body, r"\}\s*\n\s*\{", "},{"), F.lit("]"))
    return F.when(body.startswith("["), body).otherwise(listed)


def read_download_list(spark: SparkSession, path: str) -> DataFrame:
    """Rows of files of download items: a JSON array, or one object to a line."""
    return _read_json(spark, path, parse_download_list)


def parse_download_list(texts: DataFrame, value: str = "value") -> DataFrame:
    items = F.from_json(_objects(F.col(value)), f"array<struct<{_struct(DOWNLOAD_ITEM)}>>")
    return texts.select(F.explode(items).alias("item")).select("item.*")


def _struct(ddl: str) -> str:
    return ",".join(":".join(field.split()) for field in ddl.split(","))


def scan_schema_descriptors(spark: SparkSession, path: str) -> DataFrame:
    """(dataset, value) for every descriptor: files `schema_{dataset}.txt`, or folders `dataset={dataset}`."""
    texts = spark.read.text(path, wholetext=True, pathGlobFilter="*.txt")
    if "dataset" in texts.columns:
        return texts.select(F.col("dataset").cast("string").alias("dataset"), "value")
    dataset = F.regexp_replace(F.col("_metadata.file_name"), r"\Aschema_|\.txt\z", "")
    return texts.select(dataset.alias("dataset"), "value")


def scan_parquet(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def scan_footers(spark: SparkSession, path: str) -> DataFrame:
    """A Parquet table whose counts come from the footers of its files: read through the source that takes
    aggregates, which is asked for while the frame is made, and lets the planner push them down."""
    spark.conf.set("spark.sql.parquet.aggregatePushdown", "true")
    with settings(spark, spark__sql__sources__useV1SourceList=""):
        return spark.read.parquet(path)


def scan_pages(spark: SparkSession, path: str) -> DataFrame:
    """Captured web pages."""
    return spark.read.parquet(path).select("page_id", "url", "html")


def scan_codepage_table(spark: SparkSession, path: str, encoding: str = "cp949", sep: str = "\t", lossy: bool = False) -> DataFrame:
    """A delimited table with a header in a code page, all strings.

    The file is split as Latin-1, which keeps every byte, and the fields are decoded in the JVM
    afterwards. That is exact for code pages in which `sep`, quotes and line ends are
    never part of a longer character, such as cp949 and euc-kr. Bytes that are no text fail the
    query; with `lossy` they become U+FFFD, and `undecodable_values` counts where.
    """
    raw = spark.read.csv(path, sep=sep, header=True, encoding="ISO-8859-1")
    with code_pages(spark, lossy):
        return raw.select(
            *(
                decode_codepage(F.encode(F.col(f"`{name}`"), "ISO-8859-1"), encoding).alias(name.encode("latin-1").decode(encoding))
                for name in raw.columns
            )
        )


def undecodable_values(table: DataFrame) -> DataFrame:
    """(column_name, n): values of each column that lost bytes when they were decoded."""
    counts = table.agg(*(F.count_if(undecodable(F.col(f"`{c}`"))).alias(c) for c in table.columns))
    return counts.unpivot([], [f"`{c}`" for c in table.columns], "column_name", "n")


def scan_code_sheet(sheet: DataFrame, n_columns: int = len(SHEET_COLUMNS), na_words: Iterable[str] = NA_WORDS) -> DataFrame:
    """The first columns of an exported code sheet, as strings, NA words turned to null."""
    from ..operators.codes import clean_header

    sheet = clean_header(sheet)
    if len(sheet.columns) < n_columns:
        raise ValueError(f"sheet has {len(sheet.columns)} columns, {n_columns} are needed")
    words = tuple(na_words)
    return sheet.select(
        *(na_words_to_null(F.col(f"`{name}`").cast("string"), words).alias(name) for name in sheet.columns[:n_columns])
    )


def read_code_sheets(
    spark: SparkSession, path: str | list[str], header_row: int = 2, n_columns: int = len(SHEET_COLUMNS), sep: str = ","
) -> DataFrame:
    """Code sheets exported as CSV, with the file's `path` as last column. Names are in row
    `header_row` and must be the same in all files; rows above it are dropped; empty cells stay empty.

    Quoted cells may hold line breaks, so one task reads a file, and numbers its rows as it reads. The names
    come from the first rows of the first file; a file with other ones fails the query in the same scan.
    """
    raw = spark.read.option("multiLine", True).option("sep", sep).option("escape", '"').schema(
        ", ".join(f"_c{i} string" for i in range(n_columns))
    ).csv(path)
    cells = raw.select(*raw.columns, F.col("_metadata.file_path").alias("path"))
    first = cells.head(header_row)
    if len(first) < header_row or len({row["path"] for row in first}) > 1:
        raise ValueError(f"no header in row {header_row} of {path}")
    header = tuple(first[-1])[:n_columns]

    def body(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        file, above = None, 0
        for batch in batches:
            paths = batch.column("path").to_pylist()
            at = 0
            while at < len(paths):
                to = next((i for i in range(at, len(paths)) if paths[i] != paths[at]), len(paths))
                if paths[at] != file:
                    file, above = paths[at], 0
                skip = min(max(header_row - above, 0), to - at)
                if skip and above + skip == header_row:
                    found = tuple(batch.column(i)[at + skip - 1].as_py() for i in range(n_columns))
                    if found != header:
                        raise ValueError(f"other names than {header} in row {header_row} of {file}: {found}")
                above += to - at
                yield batch.slice(at + skip, to - at - skip)
                at = to

    rows = cells.mapInArrow(body, cells.schema)
    sheet = rows.select(*(F.coalesce(F.col(c), F.lit("")).alias(name or c) for c, name in zip(raw.columns, header)), "path")
    return scan_code_sheet(sheet, n_columns + 1)


def expected_values(spark: SparkSession, values: dict[str, int]) -> DataFrame:
    return spark.createDataFrame(list(values.items()), "category string, expected long")


def accumulate_pages(*captures: DataFrame) -> DataFrame:
    """Pages captured separately as one table."""
    first, *others = captures
    for other in others:
        first = first.unionByName(other)
    return first
