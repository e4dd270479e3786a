"""Writers. Each task writes its own files; nothing is gathered first."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import PROVIDER_LABEL, SERVICE_LABEL, TABLE_LABEL
from ..operators.codes import key_first
from ..session import hadoop_path

BOM = "\ufeff"


def finished(spark: SparkSession, path: str) -> bool:
    """Whether a write to the path was completed."""
    fs, done = hadoop_path(spark, f"{path}/_SUCCESS")
    return fs.exists(done)


MANIFEST = (
    "catalog_key string, data string, rejects string, rows_in long, rows_out long, short long, suspect long, rejected long, "
    "cast_nulls map<string,long>, first_line_separators long"
)


def manifest_path(out: str, key: str) -> str:
    return f"{out}/_manifests/{key}"


def write_manifest(spark: SparkSession, out: str, key: str, counts: dict) -> None:
    """One row that names a dataset's data, its rejects and its counts. It is written last, so a dataset
    that has it is whole."""
    row = {"catalog_key": key, "data": f"{out}/{key}", "rejects": f"{out}/_rejects/{key}", **counts}
    spark.createDataFrame([row], MANIFEST).coalesce(1).write.mode("overwrite").json(manifest_path(out, key))


def read_manifests(spark: SparkSession, out: str, keys: list[str]) -> DataFrame:
    """The manifests of finished datasets."""
    if not keys:
        return spark.createDataFrame([], MANIFEST)
    return spark.read.schema(MANIFEST).json([manifest_path(out, key) for key in keys])


def finished_keys(catalog: DataFrame, out: str, key: str = "catalog_key") -> DataFrame:
    """(key) of catalog rows with a manifest: one metadata call per catalog row."""
    spark = catalog.sparkSession
    keys = [row[0] for row in catalog.select(key).distinct().collect()]
    return spark.createDataFrame([(k,) for k in keys if finished(spark, manifest_path(out, k))], f"{key} string")


def write_dataset(df: DataFrame, out: str, key: str) -> str:
    """Typed rows to `{out}/{key}`. Finished output is never replaced; an unfinished rest of
    an earlier run is."""
    path = f"{out}/{key}"
    if finished(df.sparkSession, path):
        raise FileExistsError(f"{path} is already complete")
    df.write.mode("overwrite").parquet(path)
    return path


def write_catalog(catalog: DataFrame, path: str) -> None:
    """One JSON object per line, `{"<key>": {...}}`, which `read_catalog` reads back."""
    entry = F.struct(*(c for c in catalog.columns if c != "catalog_key"))
    line = F.to_json(F.create_map("catalog_key", entry))
    catalog.select(line.alias("value")).write.mode("overwrite").text(path)


def write_download_list(items: DataFrame, path: str) -> None:
    items.write.mode("overwrite").json(path)


def descriptor_texts(pages: DataFrame, category: str) -> DataFrame:
    """(dataset, value): preamble and column rows of each schema page, one text per page."""
    lines = F.concat(
        F.array(F.lit(SERVICE_LABEL), "service_name", F.lit(PROVIDER_LABEL), "provider", F.lit(TABLE_LABEL)), "schema_rows"
    )
    return pages.select(
        F.concat_ws("_", category, "dataset_name").alias("dataset"), F.concat(F.array_join(lines, "\n"), F.lit("\n")).alias("value")
    )


def write_schema_descriptors(texts: DataFrame, path: str) -> None:
    """`(dataset, value)` descriptors as text below `dataset=<name>/`."""
    texts.write.mode("overwrite").option("lineSep", "\n").partitionBy("dataset").text(path)


def write_csv_bom(df: DataFrame, path: str, key: str, partition_by: str | None = None) -> None:
    """CSV in UTF-8 with a byte-order mark and a header in every file, key column first."""
    rows = key_first(df, key)
    first = next(c for c in rows.columns if c != partition_by)
    rows = rows.withColumnRenamed(first, BOM + first)
    writer = rows.write.mode("overwrite").option("header", True).option("emptyValue", "")
    (writer.partitionBy(partition_by) if partition_by else writer).csv(path)


def read_csv_bom(spark: SparkSession, path: str) -> DataFrame:
    """All strings; the mark is dropped."""
    rows = spark.read.option("header", True).csv(path)
    return rows.toDF(*(c.removeprefix(BOM) for c in rows.columns))


def write_checks(checks: DataFrame, path: str) -> None:
    """The report of a run, replacing the one before."""
    checks.write.mode("overwrite").parquet(path)
