"""Catalog building: each customer is an archive, each customer with orders has a schema."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import schema_key
from ..operators import catalog
from ..session import work_dir
from ..sinks import write_catalog, write_download_list
from ..sources import list_files, read_catalog, read_download_list
from .tables import TABLES, table


def _archives(spark, folder):
    """Two copies of each archive; every fifth nation names another month."""
    rows = table(spark, folder, "customer")
    month = F.when(F.col("c_nationkey") % 5 == 0, "11").otherwise("12")
    name = F.concat(F.lit("국토교통부_"), "c_mktsegment", F.lit("_"), F.col("c_name"), F.lit("+(2025년+"), month, F.lit("월).zip"))
    files = rows.select(F.explode(F.array(F.lit("C:\\data\\a\\"), F.lit("C:\\data\\b\\"))).alias("dir"), name.alias("name"), "c_custkey")
    files = files.select(
        F.concat("dir", "name").alias("path"), "name", (F.col("c_custkey") * 1000003 + F.length("dir")).alias("size")
    )
    return catalog.parse_archive_name(files, "2025", "12")


def _schemas(spark, folder):
    """One descriptor file per customer with orders: a semi join, at most one row per customer."""
    rows = table(spark, folder, "customer").join(
        table(spark, folder, "orders"), F.col("c_custkey") == F.col("o_custkey"), "left_semi"
    )
    name = schema_key(F.col("c_mktsegment"), F.col("c_name"))
    return rows.select(F.concat(F.lit("C:/data/schema/"), name).alias("path"), name.alias("name"))


def parsed_names(spark, folder):
    return _archives(spark, folder).select("path", "data_category", "dataset_name", "catalog_key")


def schema_names(spark, folder):
    return table(spark, folder, "customer").select("c_custkey", schema_key(F.col("c_mktsegment"), F.col("c_name")).alias("schema_name"))


def matched(spark, folder):
    return catalog.match_archive_schema(_archives(spark, folder), _schemas(spark, folder)).select("path", "schema_path")


def catalog_rows(spark, folder):
    return catalog.catalog_rows(_archives(spark, folder), _schemas(spark, folder), base="C:\\data")


def last_wins(spark, folder):
    """The latest order of each customer."""
    rows = table(spark, folder, "orders").select("o_custkey", "o_orderkey", "o_orderpriority")
    return catalog.last_wins_per_key(rows, "o_custkey", "o_orderkey")


def count(spark, folder):
    return catalog.catalog_count(catalog_rows(spark, folder))


def unmatched(spark, folder):
    return catalog.report_unmatched(_archives(spark, folder), _schemas(spark, folder))


def skip_existing(spark, folder):
    rows = table(spark, folder, "customer").select(F.col("c_custkey").alias("catalog_key"), "c_name")
    done = table(spark, folder, "orders").filter(F.col("o_orderpriority") == "1-URGENT").select(F.col("o_custkey").alias("catalog_key"))
    return catalog.skip_existing(rows, done)


def _entries(spark, folder):
    return table(spark, folder, "supplier").select(
        F.concat(F.col("s_nationkey").cast("string"), F.lit("_"), "s_name").alias("catalog_key"),
        F.col("s_nationkey").cast("string").alias("data_category"), F.col("s_name").alias("dataset_name"),
        F.concat(F.lit("data/원본/"), "s_name", F.lit('"+(2025년+12월).zip')).alias("zip_path"),
        F.concat(F.lit("data/schema/"), "s_name", F.lit(".txt")).alias("schema_path"),
        (F.col("s_suppkey") * 4204179688).alias("zip_size_bytes"),
    )


def parse_entries(spark, folder):
    """Files of one entry to a line, and files of objects over many lines, read with the reader."""
    path = work_dir(spark, "catalog")
    entries = _entries(spark, folder)
    write_catalog(entries.filter("zip_size_bytes % 10 <> 0"), f"{path}/lines")
    # Of the others up to 200 are an object: an entry to a line, the braces around them, as a pretty printer writes it.
    fields = F.to_json(F.create_map("catalog_key", F.struct(*(c for c in entries.columns if c != "catalog_key"))))
    inner = F.substring(fields, F.lit(2), F.length(fields) - 2)
    block = F.floor(F.col("zip_size_bytes") / F.lit(4204179688 * 1000))
    objects = entries.filter("zip_size_bytes % 10 = 0").groupBy(block).agg(F.array_join(F.sort_array(F.collect_list(inner)), ",\n  ").alias("all"))
    objects.select(F.concat(F.lit("{\n  "), "all", F.lit("\n}")).alias("value")).write.option("lineSep", "\n").text(f"{path}/objects")
    return read_catalog(spark, f"{path}/*")


def catalog_round_trip(spark, folder):
    path = work_dir(spark, "catalog")
    write_catalog(_entries(spark, folder), path)
    return read_catalog(spark, path)


def _items(spark, folder):
    return table(spark, folder, "part").select(
        F.lpad((F.col("p_size") % 3 + 1).cast("string"), 2, "0").alias("cat_val"), F.col("p_type").alias("cat_name"),
        F.lpad(F.col("p_size").cast("string"), 4, "0").alias("task_code"),
        F.concat(F.lit("OPN"), F.col("p_partkey").cast("string")).alias("opn_code"),
        F.concat("p_name", F.lit(" (2025년 12월)")).alias("service_name"),
    )


def parse_items(spark, folder):
    """Files of many items, one to a line, read with the reader in splits."""
    path = work_dir(spark, "items")
    write_download_list(_items(spark, folder), path)
    return read_download_list(spark, path)


def download_list_round_trip(spark, folder):
    path = work_dir(spark, "items")
    write_download_list(_items(spark, folder), path)
    return read_download_list(spark, path)


def listed_files(spark, folder):
    """The files of the given tables."""
    return list_files(spark, folder, "*.parquet").select("name", (F.col("size") > 0).alias("has_content"))


ARCHIVES_SQL = """
archives AS (
  SELECT 'C:\\data\\' || d || '\\' || name AS path, name, c_custkey * 1000003 + 10 AS size, d,
         CASE WHEN c_nationkey % 5 <> 0 THEN c_mktsegment END AS data_category,
         CASE WHEN c_nationkey % 5 <> 0 THEN c_name END AS dataset_name,
         CASE WHEN c_nationkey % 5 <> 0 THEN c_mktsegment || '_' || c_name END AS catalog_key,
         CASE WHEN c_nationkey % 5 <> 0 AND c_custkey IN (SELECT o_custkey FROM orders)
              THEN 'C:/data/schema/schema_' || c_mktsegment || '_' || c_name || '.txt' END AS schema_path
  FROM (SELECT *, '국토교통부_' || c_mktsegment || '_' || c_name || '+(2025년+'
               || CASE WHEN c_nationkey % 5 = 0 THEN '11' ELSE '12' END || '월).zip' AS name FROM customer),
       (VALUES ('a'), ('b')) AS v(d)
)"""

CATALOG_SQL = ARCHIVES_SQL + """, catalog AS (
  SELECT catalog_key, data_category, dataset_name, 'b/' || name AS zip_path, replace(schema_path, 'C:/data/', '') AS schema_path,
         size AS zip_size_bytes
  FROM archives WHERE schema_path IS NOT NULL AND d = 'b'
)"""

ENTRIES_SQL = """
SELECT s_nationkey || '_' || s_name AS catalog_key, CAST(s_nationkey AS VARCHAR) AS data_category, s_name AS dataset_name,
       'data/원본/' || s_name || '"+(2025년+12월).zip' AS zip_path, 'data/schema/' || s_name || '.txt' AS schema_path,
       s_suppkey * 4204179688 AS zip_size_bytes FROM supplier
"""

ITEMS_SQL = """
SELECT lpad(CAST(p_size % 3 + 1 AS VARCHAR), 2, '0') AS cat_val, p_type AS cat_name, lpad(CAST(p_size AS VARCHAR), 4, '0') AS task_code,
       'OPN' || p_partkey AS opn_code, p_name || ' (2025년 12월)' AS service_name FROM part
"""

QUERIES = {
    "parse_archive_name": (parsed_names, f"WITH {ARCHIVES_SQL} SELECT path, data_category, dataset_name, catalog_key FROM archives"),
    "schema_key": (schema_names, "SELECT c_custkey, 'schema_' || c_mktsegment || '_' || c_name || '.txt' AS schema_name FROM customer"),
    "catalog_match": (matched, f"WITH {ARCHIVES_SQL} SELECT path, schema_path FROM archives"),
    "catalog_rows": (catalog_rows, f"WITH {CATALOG_SQL} SELECT * FROM catalog"),
    "catalog_count": (count, f"WITH {CATALOG_SQL} SELECT count(*) AS n_datasets FROM catalog"),
    "catalog_unmatched": (
        unmatched,
        f"""WITH {ARCHIVES_SQL} SELECT name, catalog_key,
        CASE WHEN catalog_key IS NULL THEN 'unexpected name' ELSE 'schema not found' END AS issue
        FROM archives WHERE catalog_key IS NULL OR schema_path IS NULL""",
    ),
    "last_wins_per_key": (
        last_wins,
        """SELECT o_custkey, o_orderkey, o_orderpriority FROM (
        SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) AS rn FROM orders) WHERE rn = 1""",
    ),
    "skip_existing": (
        skip_existing,
        """SELECT c_custkey AS catalog_key, c_name FROM customer
        WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority = '1-URGENT')""",
    ),
    "read_catalog": (parse_entries, ENTRIES_SQL),
    "write_catalog": (catalog_round_trip, ENTRIES_SQL),
    "read_download_list": (parse_items, ITEMS_SQL),
    "write_download_list": (download_list_round_trip, ITEMS_SQL),
    "list_files": (
        listed_files,
        f"SELECT unnest({[f'{name}.parquet' for name in TABLES]}) AS name, true AS has_content",
    ),
}
