"""Administrative code tables derived from a full code list."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import code_prefix, edition_date, not_true


def filter_suffix(df: DataFrame, col: str, suffix: str = "00000") -> DataFrame:
    return df.filter(F.endswith(_c(col), F.lit(suffix)))


def filter_no_space(df: DataFrame, col: str) -> DataFrame:
    """Names of one word; a missing name counts as one."""
    return df.filter(not_true(F.contains(_c(col), F.lit(" "))))


def filter_code_length(df: DataFrame, col: str, n: int, longer: bool = False) -> DataFrame:
    """Codes of length n, or longer than n."""
    length = F.length(_c(col))
    return df.filter(length > n if longer else length == n)


def with_prefix(df: DataFrame, col: str, n: int, name: str) -> DataFrame:
    return df.withColumn(name, code_prefix(_c(col), n))


def rename_columns(df: DataFrame, names: Mapping[str, str]) -> DataFrame:
    return df.withColumnsRenamed(dict(names))


def key_first(df: DataFrame, key: str) -> DataFrame:
    return df.select(_c(key), *(_c(c) for c in df.columns if c != key))


def clean_header(df: DataFrame) -> DataFrame:
    """Line breaks in column names become spaces."""
    return df.toDF(*(c.replace("\n", " ") for c in df.columns))


def districts(codes: DataFrame, code: str, name: str, key: str, renamed: str) -> DataFrame:
    """Rows whose code ends in 00000, keyed by its first five digits."""
    return _level(filter_suffix(codes, code), code, name, 5, key, renamed)


def provinces(codes: DataFrame, code: str, name: str, key: str, renamed: str) -> DataFrame:
    """Rows whose name is one word, keyed by the first two digits."""
    return _level(filter_no_space(codes, name), code, name, 2, key, renamed)


def _level(rows: DataFrame, code: str, name: str, n: int, key: str, renamed: str) -> DataFrame:
    keyed = with_prefix(rows, code, n, "__key").drop(code)
    return key_first(rename_columns(keyed, {"__key": key, name: renamed}), key)


def sheet_level(sheet: DataFrame, level_code: str, length: int, code: str, n: int, key: str) -> DataFrame:
    """Sheet rows of one level, with a key cut from another code put first."""
    return key_first(with_prefix(filter_code_length(sheet, level_code, length), code, n, key), key)


def with_edition(files: DataFrame, name: str = "name") -> DataFrame:
    return files.withColumn("edition_date", edition_date(_c(name)))


def latest_edition(files: DataFrame, by: str | None = None, order: str = "path") -> DataFrame:
    """The file row of the newest edition, per `by` where given; undated files are ignored.

    Files of the same date are told apart by `order`.
    """
    dated = files if "edition_date" in files.columns else with_edition(files)
    dated = dated.filter(F.col("edition_date").isNotNull())
    keys = [by] if by else []
    others = [c for c in dated.columns if c not in keys]
    newest = F.max_by(F.struct(*others), F.struct("edition_date", order)).alias("row")
    return dated.groupBy(*keys).agg(newest).filter("row IS NOT NULL").select(*keys, "row.*")


def undated_files(files: DataFrame, name: str = "name") -> DataFrame:
    """Files that are skipped because their name holds no edition date."""
    return with_edition(files, name).filter("edition_date IS NULL").drop("edition_date").withColumn("issue", F.lit("no edition date"))


def _c(name: str) -> Column:
    return F.col(f"`{name}`")
