"""Documents as zip archives, through catalog, repair and typing to Parquet."""

from __future__ import annotations

import itertools
import uuid

import pyarrow as pa
from pyspark.sql import functions as F

from ..functions import HEADER_MARKER, schema_key
from ..operators.catalog import catalog_rows, parse_archive_name
from ..operators.registry import build_registry
from ..plans.convert import analyze_head, convert_catalog, convert_text_files, file_verdicts, route_files
from ..session import work_dir
from ..sources import inflate_archives, list_files, sample_head
from .files import ArchiveWriter
from .repairing import DOCUMENTS_SQL
from .tables import DOCUMENT_COLUMNS, DOCUMENT_SEPARATORS, document_text, table


def _write_archives(spark, folder, line=None):
    """One archive per task of the document scan, written by that task as it reads."""
    docs = table(spark, folder, "documents")
    return _archived(docs.select(F.spark_partition_id().alias("number"), (document_text(True) if line is None else line).alias("line")))


def _numbered_archives(spark, folder):
    """An archive per 500 numbers of documents, in order of their numbers."""
    docs = table(spark, folder, "documents").select((F.col("doc_id") / 500).cast("int").alias("number"), "doc_id", document_text(True).alias("line"))
    return _archived(docs.repartitionByRange("number").sortWithinPartitions("number", "doc_id").select("number", "line"))


def _archived(rows):
    """Archives of the lines of rows (number, line), in which equal numbers follow each other."""
    path = work_dir(rows.sparkSession, "archives")

    def pack(batches):
        number = archive = None
        for batch in batches:
            numbers = batch.column("number").to_pylist()
            lines = batch.column("line").to_pylist()
            at = 0
            for key, run in itertools.groupby(numbers):
                n = len(list(run))
                if key != number:
                    if archive is not None:
                        archive.close()
                    number, archive = key, ArchiveWriter(f"{path}/국토교통부_문서_{key}+(2025년+12월).zip", uuid.uuid4().hex)
                archive.write(lines[at : at + n])
                at += n
        if archive is not None:
            archive.close()
        yield pa.RecordBatch.from_pydict({"number": pa.array([], pa.int32())})

    rows.mapInArrow(pack, "number int").write.format("noop").mode("overwrite").save()
    return path


DESCRIPTOR = f"{HEADER_MARKER}\t데이터타입\n" + "".join(
    f"{c.name}\t{'VARCHAR(100)' if c.precision is None else f'NUMERIC({c.precision})'}\n" for c in DOCUMENT_COLUMNS
)


def _catalog(spark, folder, path=None):
    archives = parse_archive_name(list_files(spark, path or _write_archives(spark, folder), "*.zip"), "2025", "12")
    name = schema_key(F.col("data_category"), F.col("dataset_name"))
    schemas = archives.select(F.concat(F.lit("schema/"), name).alias("path"), name.alias("name"))
    return catalog_rows(archives, schemas)


def _registry(catalog):
    return build_registry(catalog.select(F.col("catalog_key").alias("dataset"), F.lit(DESCRIPTOR).alias("value")))


def inflated_lines(spark, folder):
    blocks = inflate_archives(_catalog(spark, folder))
    lines = F.split(F.substring(F.col("text").cast("string"), F.lit(1), F.length(F.col("text").cast("string")) - 1), "\n")
    return blocks.select(F.explode(lines).alias("value"))


def convert_archives(spark, folder):
    catalog = _catalog(spark, folder)
    out = work_dir(spark, "converted")
    convert_catalog(spark, catalog, _registry(catalog), out)
    return spark.read.parquet(f"{out}/문서_*")


def conversion_status(spark, folder):
    """A run with one archive missing, and a second run that has only that one left to do.

    Each document is one line. Pipes inside its text make it a reject, every seventh number is no number.
    """
    line = F.concat_ws(
        "|", F.concat(F.when(F.col("doc_id") % 7 == 0, "x").otherwise(""), F.col("doc_id").cast("string")), "lang", "source",
        F.translate("text", "\n", " "), F.col("n_chars").cast("string"),
    )
    catalog = _catalog(spark, folder, _write_archives(spark, folder, line))
    missing = catalog.limit(1).withColumn("catalog_key", F.lit("문서_없음")).withColumn("zip_path", F.concat("zip_path", F.lit(".none")))
    catalog = catalog.unionByName(missing)
    out, registry = work_dir(spark, "converted"), _registry(catalog)
    first = convert_catalog(spark, catalog, registry, out).withColumn("run", F.lit(1))
    second = convert_catalog(spark, catalog, registry, out).withColumn("run", F.lit(2))
    return first.unionByName(second).groupBy("run", "status").agg(
        F.sum("rows_in").alias("rows_in"), F.sum("rows_out").alias("rows_out"), F.sum("rejected").alias("rejected"),
        F.sum(F.col("cast_nulls")["doc_id"]).alias("lost_ids"), F.min("first_line_separators").alias("first_line"),
    )


def _text_files(spark, folder):
    """Text files of records whose text has no line break, and of the others."""
    path = work_dir(spark, "files")
    rows = table(spark, folder, "documents").select(F.contains("text", F.lit("\n")).alias("broken"), document_text(True).alias("value"))
    rows.write.partitionBy("broken").option("lineSep", "\n").text(path)
    return path


def route_clean(spark, folder):
    return route_files(spark, _text_files(spark, folder), DOCUMENT_SEPARATORS)[0].select("value")


def route_repair(spark, folder):
    return route_files(spark, _text_files(spark, folder), DOCUMENT_SEPARATORS)[1].select("value")


def verdicts(spark, folder):
    """Which files hold a bad line, each read up to its first one; by the folder they are in."""
    files = [row["path"] for row in list_files(spark, f"{_text_files(spark, folder)}/*", "*.txt").collect()]
    told = file_verdicts(spark, files, DOCUMENT_SEPARATORS)
    return told.groupBy(F.contains("file", F.lit("broken=true")).alias("broken")).agg(F.bool_and("clean").alias("all_clean"), F.bool_or("clean").alias("any_clean"))


def convert_text(spark, folder):
    """Clean files and broken ones, routed by name."""
    path, out = _text_files(spark, folder), work_dir(spark, "converted")
    convert_text_files(spark, path, DOCUMENT_COLUMNS, out, "documents")
    return spark.read.parquet(f"{out}/documents")


def sampled_head(spark, folder):
    """Lines of the first block of each archive, whose other blocks are not read."""
    catalog = _catalog(spark, folder, _numbered_archives(spark, folder))
    text = F.col("text").cast("string")
    blocks = sample_head(spark, catalog, 1, HEAD_BYTES)
    return blocks.select(F.explode(F.split(F.substring(text, F.lit(1), F.length(text) - 1), "\n")).alias("value"))


HEAD_BYTES = 50_000


def sampled_archives(spark, folder):
    """Each archive without a limit, typed without repair."""
    catalog = _catalog(spark, folder)
    return analyze_head(catalog, DOCUMENT_COLUMNS, None)


PLAIN_SQL = "concat_ws('|', doc_id, lang, source, replace(text, '|', '/'), n_chars)"

QUERIES = {
    "inflate_archives": (
        inflated_lines,
        "SELECT unnest(string_split(concat_ws('|', doc_id, lang, source, replace(text, '|', '/'), n_chars), chr(10))) AS value FROM documents",
    ),
    "convert_archives": (convert_archives, DOCUMENTS_SQL),
    "convert_text_files": (convert_text, DOCUMENTS_SQL),
    "conversion_status": (
        conversion_status,
        """WITH lines AS (SELECT contains(text, '|') AS bad, doc_id % 7 = 0 AS lost FROM documents),
        counts AS (SELECT count(*) AS rows_in, count(*) FILTER (NOT bad) AS rows_out, count(*) FILTER (bad) AS rejected,
          count(*) FILTER (NOT bad AND lost) AS lost_ids,
          (SELECT CAST(length(text) - length(replace(text, '|', '')) AS BIGINT) + 4 FROM documents ORDER BY doc_id LIMIT 1) AS first_line FROM lines)
        SELECT 1 AS run, 'converted' AS status, * FROM counts UNION ALL SELECT 2, 'skipped', * FROM counts
        UNION ALL VALUES (1, 'failed', NULL, NULL, NULL, NULL, NULL), (2, 'failed', NULL, NULL, NULL, NULL, NULL)""",
    ),
    "route_clean_files": (
        route_clean,
        f"SELECT {PLAIN_SQL} AS value FROM documents WHERE NOT contains(text, chr(10))",
    ),
    "route_repair_files": (
        route_repair,
        f"SELECT unnest(string_split({PLAIN_SQL}, chr(10))) AS value FROM documents WHERE contains(text, chr(10))",
    ),
    "file_verdicts": (
        verdicts,
        "SELECT contains(text, chr(10)) AS broken, NOT contains(text, chr(10)) AS all_clean, NOT contains(text, chr(10)) AS any_clean FROM documents GROUP BY ALL",
    ),
    "sample_head": (
        sampled_head,
        f"""WITH lines AS (
          SELECT doc_id, doc_id // 500 AS number, unnest(string_split({PLAIN_SQL}, chr(10))) AS value,
            generate_subscripts(string_split({PLAIN_SQL}, chr(10)), 1) AS line FROM documents),
        sized AS (SELECT value, sum(strlen(value) + 1) OVER (PARTITION BY number ORDER BY doc_id, line) AS bytes FROM lines)
        SELECT value FROM sized WHERE bytes <= {HEAD_BYTES}""",
    ),
    "analyze_head": (
        sampled_archives,
        """WITH lines AS (SELECT unnest(string_split(concat_ws('|', doc_id, lang, source, replace(text, '|', '/'), n_chars), chr(10))) AS line FROM documents)
        SELECT TRY_CAST(f[1] AS DECIMAL(18,0)) AS doc_id, nullif(f[2], '') AS lang, nullif(f[3], '') AS source, nullif(f[4], '') AS text,
        TRY_CAST(f[5] AS DECIMAL(9,0)) AS n_chars FROM (SELECT string_split(line, '|') AS f FROM lines WHERE line <> '')""",
    ),
}
