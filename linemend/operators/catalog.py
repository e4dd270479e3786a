"""Archive and schema file names to the dataset catalog."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import PUBLISHER, archive_name_part, catalog_key, normalise_path, schema_key


def parse_archive_name(files: DataFrame, year: str, month: str, publisher: str = PUBLISHER) -> DataFrame:
    """Add category, dataset and catalog_key; null where the name is not of that month's form."""
    name = F.col("name")
    return (
        files.withColumn("data_category", archive_name_part(name, 1, year, month, publisher))
        .withColumn("dataset_name", archive_name_part(name, 2, year, month, publisher))
        .withColumn(
            "catalog_key",
            F.when(F.col("data_category").isNotNull(), catalog_key(F.col("data_category"), F.col("dataset_name"))),
        )
    )


def match_archive_schema(archives: DataFrame, schemas: DataFrame) -> DataFrame:
    """Parsed archives with the path of the schema of the same name, null where none is."""
    wanted = schema_key(F.col("data_category"), F.col("dataset_name"))
    by_name = schemas.select(F.col("name").alias("schema_name"), F.col("path").alias("schema_path"))
    return archives.withColumn("schema_name", wanted).join(by_name, "schema_name", "left")


def last_wins_per_key(catalog: DataFrame, key: str = "catalog_key", order: str = "zip_path") -> DataFrame:
    """One row per key, the one with the greatest order value; combined before the shuffle."""
    others = [c for c in catalog.columns if c != key]
    return catalog.groupBy(key).agg(F.max_by(F.struct(*others), F.col(order)).alias("row")).select(key, "row.*")


def report_unmatched(archives: DataFrame, schemas: DataFrame) -> DataFrame:
    """(name, catalog_key, issue) for archives that do not enter the catalog."""
    wanted = schema_key(F.col("data_category"), F.col("dataset_name"))
    odd = archives.filter(F.col("catalog_key").isNull()).withColumn("issue", F.lit("unexpected name"))
    names = schemas.select(F.col("name").alias("schema_name"))
    orphan = (
        archives.filter(F.col("catalog_key").isNotNull())
        .withColumn("schema_name", wanted)
        .join(names, "schema_name", "left_anti")
        .withColumn("issue", F.lit("schema not found"))
    )
    columns = ("name", "catalog_key", "issue")
    return odd.select(*columns).unionByName(orphan.select(*columns))


def catalog_rows(archives: DataFrame, schemas: DataFrame, base: str = "") -> DataFrame:
    """The catalog: matched archives, one row per key, paths relative to `base`."""
    matched = match_archive_schema(archives, schemas).filter(F.col("catalog_key").isNotNull() & F.col("schema_path").isNotNull())
    path = (lambda c: normalise_path(F.col(c), base)) if base else F.col
    rows = matched.select(
        "catalog_key", "data_category", "dataset_name",
        path("path").alias("zip_path"), path("schema_path").alias("schema_path"),
        F.col("size").cast("long").alias("zip_size_bytes"),
    )
    return last_wins_per_key(rows)


def catalog_count(catalog: DataFrame) -> DataFrame:
    return catalog.agg(F.count("*").alias("n_datasets"))


def skip_existing(catalog: DataFrame, done: DataFrame, key: str = "catalog_key") -> DataFrame:
    """Catalog rows whose key has no finished output yet."""
    return catalog.join(done.select(key).distinct(), key, "left_anti")
