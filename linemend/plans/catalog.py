"""Folder listings to the dataset catalog."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..functions import PUBLISHER
from ..operators.catalog import catalog_rows, parse_archive_name, report_unmatched
from ..sources.archives import list_files


def build_catalog(
    spark: SparkSession, archive_dir: str, schema_dir: str, year: str, month: str, base: str = "", publisher: str = PUBLISHER
) -> tuple[DataFrame, DataFrame]:
    """(catalog, issues) of the archives of one month."""
    archives = parse_archive_name(list_files(spark, archive_dir, "*.zip"), year, month, publisher)
    schemas = list_files(spark, schema_dir, "*.txt")
    return catalog_rows(archives, schemas, base), report_unmatched(archives, schemas)
