"""Schema registry: descriptor texts to (dataset, ordinal, column_name, raw_type, precision, scale)."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from ..functions import HEADER_MARKER, MAX_DECIMAL_PRECISION, numeric_precision, numeric_scale, strip


@dataclass(frozen=True)
class ColumnSpec:
    """One column of a dataset; precision is None for text."""

    name: str
    precision: int | None = None
    scale: int = 0

    @property
    def spark_type(self) -> str:
        return "string" if self.precision is None else f"decimal({self.precision},{self.scale})"


def descriptor_lines(text: Column) -> Column:
    """Lines of a descriptor text, whatever the line ends."""
    return F.split(text, r"\r\n|\r|\n")


def locate_header_row(lines: Column, marker: str = HEADER_MARKER) -> Column:
    """Number of lines up to and including the first that begins with the marker, else 0."""
    return F.array_position(F.transform(lines, lambda line: F.startswith(line, F.lit(marker))), F.lit(True)).cast("int")


def parse_column_rows(texts: DataFrame, marker: str = HEADER_MARKER) -> DataFrame:
    """`(dataset, value)` descriptors to (dataset, ordinal, column_name, raw_type).

    Column rows are the lines below the header with two cells or more. Lines are stripped
    before they are split, so an empty first cell shifts the others. A descriptor is one
    row, so all of this is a narrow pass.
    """
    below = F.slice("lines", F.col("start") + 1, F.greatest(F.size("lines") - F.col("start"), F.lit(0)))
    rows = F.filter(F.transform(below, lambda line: F.split(strip(line), "\t")), lambda cells: F.size(cells) >= 2)
    return (
        texts.select("dataset", descriptor_lines(F.col("value")).alias("lines"))
        .withColumn("start", locate_header_row(F.col("lines"), marker))
        .select("dataset", F.posexplode(rows).alias("ordinal", "cells"))
        .select("dataset", "ordinal", strip(F.col("cells")[0]).alias("column_name"), strip(F.col("cells")[1]).alias("raw_type"))
    )


def parse_numeric_type(columns: DataFrame, raw_type: str = "raw_type") -> DataFrame:
    """Add precision and scale; null for every type other than NUMERIC(p[,s])."""
    raw = F.col(raw_type)
    return columns.withColumn("precision", numeric_precision(raw)).withColumn("scale", numeric_scale(raw))


def build_registry(texts: DataFrame, marker: str = HEADER_MARKER) -> DataFrame:
    """Registry of all datasets in `(dataset, value)` descriptors."""
    return parse_numeric_type(parse_column_rows(texts, marker))


def schema_summary(registry: DataFrame) -> DataFrame:
    """Columns per dataset and how many are to become decimals."""
    castable = F.col("precision") <= MAX_DECIMAL_PRECISION
    return registry.groupBy("dataset").agg(F.count("*").alias("n_columns"), F.count_if(castable).alias("n_decimal"))


def expected_by_dataset(registry: DataFrame) -> DataFrame:
    """(dataset, expected): separators each record of a dataset must have."""
    return registry.groupBy("dataset").agg((F.count("*") - 1).alias("expected"))


def dataset_rows(registry: DataFrame) -> dict[str, list[Row]]:
    """Registry rows by dataset, in column order, for building projections. One row per
    column is collected: call it on the datasets that are needed."""
    found: dict[str, list[Row]] = {}
    for row in registry.orderBy("dataset", "ordinal").collect():
        found.setdefault(row["dataset"], []).append(row)
    return found


def column_specs(dataset: str, rows: Sequence[Row]) -> list[ColumnSpec]:
    """Columns of one dataset. Fails where there are none, or two of one name."""
    names = [row["column_name"] for row in rows]
    repeated = sorted({name for name in names if names.count(name) > 1})
    if not rows:
        raise ValueError(f"no schema for dataset {dataset}")
    if repeated:
        raise ValueError(f"dataset {dataset} names columns twice: {', '.join(repeated)}")
    return [
        ColumnSpec(row["column_name"], row["precision"], row["scale"])
        if row["precision"] is not None and row["precision"] <= MAX_DECIMAL_PRECISION and row["scale"] <= row["precision"]
        else ColumnSpec(row["column_name"])
        for row in rows
    ]


def dataset_columns(registry: DataFrame, dataset: str) -> list[ColumnSpec]:
    """Columns of one dataset, looked up in the registry."""
    return column_specs(dataset, dataset_rows(registry.filter(F.col("dataset") == dataset)).get(dataset, []))


def oversized_columns(registry: DataFrame) -> DataFrame:
    """Columns whose declared precision no decimal can hold; they stay text."""
    return registry.filter((F.col("precision") > MAX_DECIMAL_PRECISION) | (F.col("scale") > F.col("precision")))
