"""Records to typed columns: one split and one projection, no shuffle."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import empty_to_null, lenient_decimal
from .registry import ColumnSpec


def read_as_strings(records: DataFrame, value: str = "value", sep: str = "|", keep: Sequence[str] = ()) -> DataFrame:
    """Split each record into an array of text fields. Quotes are ordinary characters."""
    pattern = sep if sep.isalnum() else "\\" + sep
    return records.select(*keep, F.split(value, pattern, -1).alias("fields"))


def field(i: int) -> Column:
    """Field i of a split record; null when it is empty or the record is too short."""
    return empty_to_null(F.get("fields", F.lit(i)))


def apply_schema(
    records: DataFrame, columns: Sequence[ColumnSpec], ragged: str = "fail", cast: bool = True, keep: Sequence[str | Column] = ()
) -> DataFrame:
    """Name and type the fields by position.

    `ragged` says what happens to fields past the last column: `fail` stops the query,
    `truncate` drops them. Missing fields are null. A number that cannot be read or does
    not fit becomes null.
    """
    if ragged not in ("fail", "truncate"):
        raise ValueError("ragged must be 'fail' or 'truncate'")
    if ragged == "fail":
        too_long = F.size("fields") > len(columns)
        message = F.concat(F.lit(f"more than {len(columns)} fields: "), F.array_join("fields", "|"))
        records = records.withColumn("fields", F.when(too_long, F.raise_error(message)).otherwise(F.col("fields")))
    return records.select(
        *keep, *((typed_field(i, c) if cast else field(i)).alias(c.name) for i, c in enumerate(columns))
    )


def typed_field(i: int, spec: ColumnSpec) -> Column:
    """Field i in its type; a blank is no number, so it needs no test of its own."""
    return field(i) if spec.precision is None else lenient_cast(F.get("fields", F.lit(i)), spec)


def lenient_cast(col: Column, spec: ColumnSpec) -> Column:
    return col if spec.precision is None else lenient_decimal(col, spec.precision, spec.scale)


def lenient_decimal_cast(df: DataFrame, columns: Sequence[ColumnSpec]) -> DataFrame:
    """Cast text columns that the schema declares numeric; others stay as they are."""
    return df.withColumns({c.name: lenient_cast(F.col(f"`{c.name}`"), c) for c in columns if c.precision is not None})


def lost_name(i: int) -> str:
    """Name of the column that flags a lost value in column i."""
    return f"lost_{i}"


def with_losses(records: DataFrame, columns: Sequence[ColumnSpec], ragged: str = "fail", keep: Sequence[str] = ()) -> DataFrame:
    """`apply_schema` plus a flag per numeric column: there was a value, but no number."""
    flags = [
        (typed_field(i, c).isNull() & (F.get("fields", F.lit(i)) != "")).alias(lost_name(i))
        for i, c in enumerate(columns)
        if c.precision is not None
    ]
    return apply_schema(records, columns, ragged, keep=[*keep, *flags])


def cast_losses(columns: Sequence[ColumnSpec]) -> dict[str, Column]:
    """Per numeric column, how many values did not become numbers: counts over `with_losses`."""
    return {c.name: F.count_if(F.col(lost_name(i))) for i, c in enumerate(columns) if c.precision is not None}


def type_records(records: DataFrame, columns: Sequence[ColumnSpec], sep: str = "|", ragged: str = "fail", keep: Sequence[str] = ()) -> DataFrame:
    """Text records to typed rows."""
    return apply_schema(read_as_strings(records, sep=sep, keep=keep), columns, ragged, keep=keep)
