"""Archives to typed Parquet: inflate, split and stage, reassemble, type, write, report."""

from __future__ import annotations

from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor
from functools import reduce

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..functions import separator_count
from ..operators.catalog import skip_existing
from ..operators.registry import ColumnSpec, column_specs, dataset_rows
from ..operators.repair import (
    clean_records,
    detect_bad_lines,
    expected_separators,
    file_status,
    kept_records,
    reject_overflow,
    repair_blocks,
    repair_split,
    stage_split,
)
from ..operators.typed import apply_schema, cast_losses, read_as_strings, with_losses
from ..session import drop_work_dir, work_dir
from ..sinks import finished, finished_keys, manifest_path, read_manifests, write_manifest
from ..sources.archives import inflate_archives
from ..sources.lines import pack_blocks, scan_lines

STATUS = (
    "catalog_key string, status string, rows_in long, rows_out long, short long, suspect long, rejected long, "
    "cast_nulls map<string,long>, first_line_separators long, error string"
)


def convert_catalog(
    spark: SparkSession, catalog: DataFrame, registry: DataFrame, out: str, sep: str = "|", workers: int = 4, base: str = ""
) -> DataFrame:
    """Convert every dataset without finished output; returns one status row per dataset.

    `base` is the folder that relative archive paths of the catalog start from.

    All archives are inflated, split and matched in the same jobs. Then each dataset is typed and
    written by itself, several at a time, so one that fails does not stop the others.
    """
    if base:
        catalog = catalog.withColumn("zip_path", F.concat(F.lit(base.rstrip("/") + "/"), "zip_path"))
    pending = {row["catalog_key"]: row["zip_path"] for row in skip_existing(catalog, finished_keys(catalog, out)).collect()}
    keys = spark.createDataFrame([(key,) for key in pending], "catalog_key string")
    schemas = dataset_rows(registry.join(keys, F.col("dataset") == F.col("catalog_key"), "left_semi"))
    columns, errors = {}, {}
    for key in pending:
        try:
            columns[key] = column_specs(key, schemas.get(key, []))
        except Exception as error:  # noqa: BLE001 - reported, and the other datasets go on
            errors[key] = _reason(error)
    stage = work_dir(spark, "repair")

    def store(key: str) -> dict:
        # A pool for each dataset, so that small ones need not wait for the tasks of a large one.
        spark.sparkContext.setLocalProperty("spark.scheduler.pool", key)
        try:
            return {"catalog_key": key, "status": "converted", **_store(outcome.filter(F.col("file") == key), columns[key], out, key, sep, rejects.get(key, NO_REJECTS), firsts.get(key))}
        except Exception as error:  # noqa: BLE001
            return _failed(key, _reason(error))

    try:
        rows = []
        if columns:
            split = _stage_archives(spark, {key: (pending[key], len(columns[key]) - 1) for key in columns}, stage, sep)
            errors |= {row["file"]: row["error"] for row in split.filter("error IS NOT NULL").select("file", "error").collect()}
            # The lead of a file's first block begins with its first line.
            first_line = separator_count(F.substring_index("lead", "\n", 1), sep).cast("long").alias("n")
            firsts = {row["file"]: row["n"] for row in split.filter("seq = 0 AND error IS NULL").select("file", first_line).collect()}
            outcome = repair_split(split.drop("error"), stage, sep, by_file=True)
            rejects = _reject_counts(outcome)
            with ThreadPoolExecutor(max_workers=workers) as pool:
                rows = list(pool.map(store, [key for key in columns if key not in errors]))
    finally:
        drop_work_dir(spark, stage)
    rows += [_failed(key, error) for key, error in errors.items()]
    done = [row["catalog_key"] for row in catalog.select("catalog_key").distinct().collect() if row["catalog_key"] not in pending]
    # What the run that made them has counted.
    skipped = read_manifests(spark, out, done).drop("data", "rejects").withColumn("status", F.lit("skipped"))
    return spark.createDataFrame(rows, STATUS).unionByName(skipped, allowMissingColumns=True)


def _stage_archives(spark: SparkSession, archives: dict[str, tuple[str, int]], stage: str, sep: str) -> DataFrame:
    """Split blocks of all archives, staged in a folder for each dataset."""
    rows = [(key, path, expected) for key, (path, expected) in archives.items()]
    listed = spark.createDataFrame(rows, "catalog_key string, zip_path string, expected int")
    blocks = inflate_archives(listed, tasks=len(rows), failures=True, carry=["expected"])
    # The exchange hands blocks from the inflating tasks to as many as their size needs.
    return stage_split(blocks.repartition("file", "part", "seq"), F.col("expected"), sep, f"{stage}/split", keep=["error"], by_file=True)


def _failed(key: str, error: str) -> dict:
    return {"catalog_key": key, "status": "failed", "error": error}


def _reason(error: Exception) -> str:
    return f"{type(error).__name__}: {error}"


def convert_blocks(blocks: DataFrame, columns: Sequence[ColumnSpec], out: str, key: str, sep: str = "|") -> dict:
    """Blocks of one dataset to `{out}/{key}`, and its rejects to `{out}/_rejects/{key}`."""
    stage = work_dir(blocks.sparkSession, "repair")
    try:
        outcome = repair_blocks(blocks, len(columns) - 1, sep, stage)
        return _store(outcome, columns, out, key, sep, _total(_reject_counts(outcome)))
    finally:
        drop_work_dir(blocks.sparkSession, stage)


def convert_text_files(spark: SparkSession, path: str | list[str], columns: Sequence[ColumnSpec], out: str, key: str, sep: str = "|") -> dict:
    """Text files of one dataset to `{out}/{key}`. One narrow pass counts separators; files whose
    lines all are records are read a second time and typed, only the others are repaired.

    Files are routed by name, so no line is exchanged. The first line's number of separators is
    reported for each file where it is not that of the schema.
    """
    expected = len(columns) - 1
    lines = scan_lines(spark, path)
    status = file_status(lines, expected, sep).join(expected_separators(lines, sep), "file").collect()
    clean = [row["file"] for row in status if row["clean"]]
    broken = [row["file"] for row in status if not row["clean"]]
    stage = work_dir(spark, "repair")
    try:
        outcomes = []
        if clean:
            outcomes.append(clean_records(scan_lines(spark, clean), expected))
        if broken:
            outcomes.append(repair_blocks(pack_blocks(scan_lines(spark, broken)), expected, sep, stage))
        if not outcomes:
            raise ValueError(f"no lines in {path}")
        outcome = reduce(DataFrame.unionByName, outcomes)
        counts = _store(outcome, columns, out, key, sep, _total(_reject_counts(outcome)))
    finally:
        drop_work_dir(spark, stage)
    misfits = {row["file"]: row["expected"] for row in status if row["expected"] != expected}
    return {**counts, "clean_files": len(clean), "first_line_separators": misfits}


NO_REJECTS = (0, 0)


def _reject_counts(outcome: DataFrame) -> dict[str, tuple[int, int]]:
    """Rejects, and lines of files in which no record ends, of each file that has any."""
    counts = reject_overflow(outcome).groupBy("file").agg(F.count("*").alias("n"), F.count_if(F.col("status") == "unfit").alias("unfit"))
    return {row["file"]: (row["n"], row["unfit"]) for row in counts.collect()}


def _total(counts: dict[str, tuple[int, int]]) -> tuple[int, int]:
    return tuple(map(sum, zip(NO_REJECTS, *counts.values())))


def _store(outcome: DataFrame, columns: Sequence[ColumnSpec], out: str, key: str, sep: str, rejects: tuple[int, int], first_line: int | None = None) -> dict:
    """Type and write outcomes; counters are taken while the rows are written. `first_line` is the number of
    separators of the first line, reported beside them.

    Rejects, whose numbers are given, are looked for only in the blocks that hold some, and
    written first, so that finished data always has its rejects.
    """
    spark = outcome.sparkSession
    fields = read_as_strings(kept_records(outcome), sep=sep, keep=["status", "suspect"])
    losses = cast_losses(columns)
    counters = Observation()
    typed = with_losses(fields, columns, keep=["status", "suspect"]).observe(
        counters,
        F.count("*").alias("rows_out"),
        F.count_if(F.col("status") == "short").alias("short"),
        F.count_if("suspect").alias("suspect"),
        *(count.alias(f"null_{i}") for i, count in enumerate(losses.values())),
    )
    if finished(spark, manifest_path(out, key)):
        raise FileExistsError(f"{out}/{key} is already complete")
    # Rejects, data, manifest: a run that fails before the last starts again and replaces the rest.
    rejected, unfit = rejects
    found = reject_overflow(outcome).drop("exact")
    found = found if rejected else spark.createDataFrame([], found.schema)
    found.write.mode("overwrite").parquet(f"{out}/_rejects/{key}")
    if unfit:
        raise ValueError(f"schema does not fit: {unfit} lines of files in which no record ends are in {out}/_rejects/{key}")
    typed.select(*(F.col(f"`{c.name}`") for c in columns)).write.mode("overwrite").parquet(f"{out}/{key}")
    counts = counters.get
    told = {
        "rows_in": counts["rows_out"] + rejected,
        **{name: counts[name] for name in ("rows_out", "short", "suspect")},
        "rejected": rejected,
        "cast_nulls": {name: counts[f"null_{i}"] for i, name in enumerate(losses)},
        "first_line_separators": first_line,
    }
    write_manifest(spark, out, key, told)
    return told


def route_files(spark: SparkSession, path: str | list[str], expected: int, sep: str = "|") -> tuple[DataFrame, DataFrame]:
    """Lines of the files whose lines all are records, and lines of the others.

    One narrow pass counts; then each side is a scan of its own files by name, so that no line is joined or
    exchanged. File names go through the driver.
    """
    status = file_status(scan_lines(spark, path), expected, sep).select("file", "clean").collect()
    sides = ([row["file"] for row in status if row["clean"] is wanted] for wanted in (True, False))
    return tuple(scan_lines(spark, files) if files else scan_lines(spark, path).limit(0) for files in sides)


def file_verdicts(spark: SparkSession, paths: Sequence[str], expected: int, sep: str = "|", workers: int = 4) -> DataFrame:
    """(file, clean) of each file. The reading of a file stops at its first bad line: the limit runs on its first
    split, then on four times as many, until a line is found or none is left."""

    def clean(path: str) -> tuple[str, bool]:
        return path, not detect_bad_lines(scan_lines(spark, path), expected, sep).select("id").head(1)

    with ThreadPoolExecutor(max_workers=workers) as pool:
        return spark.createDataFrame(list(pool.map(clean, paths)), "file string, clean boolean")


def analyze_head(archives: DataFrame, columns: Sequence[ColumnSpec], limit_bytes: int | None, sep: str = "|") -> DataFrame:
    """Typed rows of the head of an archive as they stand: no repair, extra fields dropped.

    The head is the first `limit_bytes` of the member up to its last line end; None reads all."""
    heads = inflate_archives(archives, limit_bytes)
    text = F.replace(F.make_valid_utf8(F.col("text").cast("string")), F.lit("\r\n"), F.lit("\n"))
    lines = heads.select("seq", F.posexplode(F.split(text, "\n")).alias("line", "value")).filter("value <> ''")
    return apply_schema(read_as_strings(lines, sep=sep), columns, ragged="truncate")
