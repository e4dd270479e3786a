"""Schema descriptors: each part writes one, with a few columns of its own."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import HEADER_MARKER, PROVIDER_LABEL, SERVICE_LABEL, TABLE_LABEL
from ..operators import registry
from .tables import table


def descriptors(spark, folder):
    """Promo parts have no header line; their columns start at the first line."""
    part = table(spark, folder, "part")
    size = F.col("p_size").cast("string")
    header = F.when(F.col("p_type") == "PROMO", "").otherwise(F.lit(f"{HEADER_MARKER}\t데이터타입\t설명\n"))
    value = F.concat(
        F.lit(f"{SERVICE_LABEL}\n"), "p_name", F.lit(f"\n{PROVIDER_LABEL}\n"), "p_brand", F.lit(f"\n{TABLE_LABEL}\n"), header,
        F.col("p_name"), F.lit(" 금액\tNUMERIC("), size, F.lit(",2)\t금액\n"),
        F.lit("\t "), F.col("p_type"), F.lit(" \tVARCHAR(20)\r\n"),
        F.lit("remark only\n"),
        F.col("p_brand"), F.lit("\tNUMERIC("), size, F.lit(")\n"),
        F.lit("좌표\tNUMERIC(19, 9)\n"),
    )
    return part.select(F.col("p_partkey").cast("string").alias("dataset"), value.alias("value"))


def header_rows(spark, folder):
    return descriptors(spark, folder).select(
        "dataset", registry.locate_header_row(registry.descriptor_lines(F.col("value"))).alias("start")
    )


def column_rows(spark, folder):
    return registry.parse_column_rows(descriptors(spark, folder))


def registry_rows(spark, folder):
    return registry.build_registry(descriptors(spark, folder))


def summary(spark, folder):
    return registry.schema_summary(registry_rows(spark, folder))


def expected(spark, folder):
    """Small parts lack the columns of their brand, so the numbers differ."""
    part = table(spark, folder, "part").select(F.col("p_partkey").cast("string").alias("dataset"), "p_size", "p_brand")
    rows = registry_rows(spark, folder).join(part, "dataset").filter((F.col("p_size") >= 20) | (F.col("column_name") != F.col("p_brand")))
    return registry.expected_by_dataset(rows.drop("p_size", "p_brand"))


def oversized(spark, folder):
    return registry.oversized_columns(registry_rows(spark, folder)).select("dataset", "column_name", "precision", "scale")


ROWS_SQL = """
rows AS (
  SELECT CAST(p_partkey AS VARCHAR) AS dataset, 0 AS ordinal, p_name || ' 금액' AS column_name,
         'NUMERIC(' || p_size || ',2)' AS raw_type FROM part
  UNION ALL SELECT CAST(p_partkey AS VARCHAR), 1, p_type, 'VARCHAR(20)' FROM part
  UNION ALL SELECT CAST(p_partkey AS VARCHAR), 2, p_brand, 'NUMERIC(' || p_size || ')' FROM part
  UNION ALL SELECT CAST(p_partkey AS VARCHAR), 3, '좌표', 'NUMERIC(19, 9)' FROM part
), typed AS (
  SELECT *, TRY_CAST(regexp_extract(raw_type, 'NUMERIC\\((\\d+)(,(\\d+))?\\)', 1) AS INTEGER) AS precision,
         TRY_CAST(regexp_extract(raw_type, 'NUMERIC\\((\\d+)(,(\\d+))?\\)', 3) AS INTEGER) AS s FROM rows
), registry AS (
  SELECT dataset, ordinal, column_name, raw_type, precision, CASE WHEN precision IS NOT NULL THEN coalesce(s, 0) END AS scale FROM typed
)"""

QUERIES = {
    "locate_header_row": (
        header_rows, "SELECT CAST(p_partkey AS VARCHAR) AS dataset, CASE WHEN p_type = 'PROMO' THEN 0 ELSE 6 END AS start FROM part"
    ),
    "parse_column_rows": (column_rows, f"WITH {ROWS_SQL} SELECT * FROM rows"),
    "registry_parse": (registry_rows, f"WITH {ROWS_SQL} SELECT * FROM registry"),
    "schema_summary": (
        summary,
        f"""WITH {ROWS_SQL} SELECT dataset, count(*) AS n_columns, count(*) FILTER (precision <= 38) AS n_decimal
        FROM registry GROUP BY dataset""",
    ),
    "expected_by_dataset": (
        expected,
        f"""WITH {ROWS_SQL} SELECT dataset, count(*) - 1 AS expected FROM registry JOIN part ON dataset = CAST(p_partkey AS VARCHAR)
        WHERE p_size >= 20 OR column_name <> p_brand GROUP BY dataset""",
    ),
    "oversized_columns": (
        oversized,
        f"WITH {ROWS_SQL} SELECT dataset, column_name, precision, scale FROM registry WHERE precision > 38 OR scale > precision",
    ),
}
