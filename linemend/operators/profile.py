"""Profiles of written datasets, key lookup, and the encoding audit."""

from __future__ import annotations

import codecs
from collections.abc import Mapping, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import ENCODINGS


def row_count(df: DataFrame) -> DataFrame:
    """Reads no columns."""
    return df.agg(F.count("*").alias("n_rows"))


def column_inventory(spark: SparkSession, frames: Mapping[str, DataFrame]) -> DataFrame:
    """(dataset, ordinal, column_name, data_type, n_columns) from schemas alone."""
    rows = [
        (name, i, f.name, f.dataType.simpleString(), len(df.schema.fields))
        for name, df in frames.items()
        for i, f in enumerate(df.schema.fields)
    ]
    return spark.createDataFrame(rows, "dataset string, ordinal int, column_name string, data_type string, n_columns int")


def preview(df: DataFrame, n: int, order: Sequence[str] = ()) -> DataFrame:
    """The first n rows; a top-n where an order is given."""
    return (df.orderBy(*order) if order else df).limit(n)


MISSING = "dataset not found"


def profile_all(
    frames: Mapping[str, DataFrame | None], order: Mapping[str, Sequence[str]] | None = None, counted: Mapping[str, DataFrame] | None = None
) -> DataFrame:
    """(dataset, n_rows, n_columns, first_row, message) of every dataset, by name.

    The first row is JSON text; with an order given for a dataset it is the first in it. Both
    answers are scalar subqueries. Counts come from the frames of `counted` where given: those of
    `scan_footers` read footers only. A dataset without a frame has a message and nothing else.
    """
    counted = counted or {}
    order = order or {}
    spark = next((df.sparkSession for df in frames.values() if df is not None), None) or SparkSession.active()
    rows = None
    for name, df in sorted(frames.items()):
        n_rows, n_columns, first, message = (F.lit(None).cast(kind) for kind in ("long", "int", "string", "string"))
        if df is None:
            message = F.lit(MISSING)
        else:
            n_rows, n_columns = row_count(counted.get(name, df)).scalar(), F.lit(len(df.columns))
            first = preview(df, 1, order.get(name, ())).select(_record()).scalar()
        part = spark.range(1).select(
            F.lit(name).alias("dataset"), n_rows.alias("n_rows"), n_columns.alias("n_columns"), first.alias("first_row"), message.alias("message")
        )
        rows = part if rows is None else rows.unionByName(part)
    return rows


def lookup_by_key(df: DataFrame, key: str, value: object) -> DataFrame:
    """Rows with that key as (key, record, found); the filter goes down to the file scan.

    A key that no row has gives one row without a record.
    """
    rows = df.filter(F.col(f"`{key}`") == F.lit(value)).select(F.col(f"`{key}`").alias("row_key"), _record().alias("record"))
    asked = df.sparkSession.range(1).select(F.lit(value).cast(df.schema[key].dataType).alias("key"))
    return asked.join(rows, F.col("key") == F.col("row_key"), "left").select("key", "record", F.col("row_key").isNotNull().alias("found"))


def _record() -> Column:
    return F.to_json(F.struct("*"), {"ignoreNullFields": "false"})


def encoding_audit(blocks: DataFrame, encodings: Sequence[str] = ENCODINGS) -> DataFrame:
    """(file, encoding, n_lines, n_bad): undecodable lines of each file per encoding, over all bytes.

    A block is decoded whole, and looked at line by line only if that fails. UTF-8 and ASCII are
    checked in the JVM, Latin-1 takes any byte, all others go through Python. Counts are combined
    per task before they are exchanged.
    """
    names = list(dict.fromkeys(encodings))
    text = F.col("text").cast("binary")
    n_lines = F.length(text) - F.length(F.replace(text.cast("string"), F.lit("\n"), F.lit("")).cast("binary"))
    counted = blocks.select("file", n_lines.cast("long").alias("n_lines"), *(_n_bad(n, text).alias(n) for n in names))
    totals = counted.groupBy("file").agg(F.sum("n_lines").alias("n_lines"), *(F.sum(f"`{n}`").alias(n) for n in names))
    return totals.unpivot(["file", "n_lines"], [f"`{n}`" for n in names], "encoding", "n_bad").select("file", "encoding", "n_lines", "n_bad")


def _n_bad(encoding: str, text: Column) -> Column:
    """Lines of a block that are no text in the encoding."""
    known = codecs.lookup(encoding).name
    whole = text.cast("string")
    if known == "iso8859-1":
        return F.lit(0).cast("long")
    if known == "utf-8":
        # Latin-1 keeps every byte through the split, which would mend invalid ones otherwise.
        bad = F.filter(F.split(F.decode(text, "ISO-8859-1"), "\n"), lambda line: ~F.is_valid_utf8(F.encode(line, "ISO-8859-1").cast("string")))
        return F.when(F.is_valid_utf8(whole), 0).otherwise(F.size(bad)).cast("long")
    if known == "ascii":
        # A character of ASCII is one byte; an invalid byte is none of them.
        beyond = F.filter(F.split(whole, "\n"), lambda line: line.rlike(r"[^\x{0}-\x{7f}]"))
        return F.size(beyond).cast("long")
    return _bad_lines(encoding)(text)


def _bad_lines(encoding: str):
    def fails(raw: bytes) -> bool:
        try:
            raw.decode(encoding)
        except UnicodeDecodeError:
            return True
        return False

    @F.pandas_udf("long")
    def bad(blocks: pd.Series) -> pd.Series:
        return blocks.map(lambda block: sum(map(fails, block.split(b"\n"))) if fails(block) else 0)

    return bad
