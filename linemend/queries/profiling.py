"""Profiles, lookups and the encoding audit over all given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import profile
from ..session import work_dir
from ..sinks import write_dataset
from ..sources import lines_of_rows, pack_blocks, scan_footers, scan_parquet
from .tables import TABLES, table


#: Tables with a key of one column.
FIRST = {
    "customer": "c_custkey", "documents": "doc_id", "nation": "n_nationkey", "orders": "o_orderkey", "part": "p_partkey",
    "region": "r_regionkey", "supplier": "s_suppkey",
}


def _frames(spark, folder):
    return {name: scan_parquet(spark, f"{folder}/{name}.parquet") for name in TABLES}


def row_count(spark, folder):
    return profile.row_count(scan_footers(spark, f"{folder}/lineitem.parquet"))


def column_inventory(spark, folder):
    return profile.column_inventory(spark, _frames(spark, folder))


def profile_all(spark, folder):
    """All tables and one that is not there; the first row is compared by its key."""
    counted = {name: scan_footers(spark, f"{folder}/{name}.parquet") for name in TABLES}
    rows = profile.profile_all(_frames(spark, folder) | {"nowhere": None}, {name: [key] for name, key in FIRST.items()}, counted)
    key = F.create_map(*(F.lit(x) for item in FIRST.items() for x in item))
    first = F.from_json("first_row", "map<string,string>")[F.try_element_at(key, F.col("dataset"))]
    return rows.select("dataset", "n_rows", "n_columns", F.col("first_row").isNotNull().alias("has_row"), first.alias("first_key"), "message")


def preview(spark, folder):
    return profile.preview(table(spark, folder, "orders"), 5, ["o_orderkey"])


def lookup(spark, folder):
    """One key that is there and one that is not."""
    customers = table(spark, folder, "customer")
    return profile.lookup_by_key(customers, "c_custkey", 42).unionByName(profile.lookup_by_key(customers, "c_custkey", -1))


def written_dataset(spark, folder):
    out = work_dir(spark, "datasets")
    return spark.read.parquet(write_dataset(table(spark, folder, "orders"), out, "주문_목록"))


def encoding_audit(spark, folder):
    """A file per language; in the French ones each full stop is a byte no UTF-8 text holds."""
    docs = table(spark, folder, "documents")
    raw = F.when(F.col("lang") == "fr", F.replace("text", F.lit("."), F.lit(b"\xff").cast("string"))).otherwise(F.col("text"))
    return profile.encoding_audit(pack_blocks(lines_of_rows(docs, F.col("lang"), raw)), ("utf-8", "ascii", "iso-8859-1", "utf-8"))


def korean_encodings(spark, folder):
    """Plain ASCII, in which each full stop becomes bytes that are Korean text in both code pages
    (French), in cp949 alone (German), or in no candidate (Spanish)."""
    docs = table(spark, folder, "documents")
    raw = F.regexp_replace("text", r"[^\x{0}-\x{7f}]", "?")
    marked = raw
    for lang, stored in KOREAN.items():
        marked = F.when(F.col("lang") == lang, F.replace(raw, F.lit("."), F.lit(stored).cast("string"))).otherwise(marked)
    return profile.encoding_audit(pack_blocks(lines_of_rows(docs, F.col("lang"), marked)), ("utf-8", "cp949", "euc-kr"))


#: The first syllable of both code pages, one of cp949 alone, and a byte of neither.
KOREAN = {"fr": b"\xb0\xa1", "de": b"\x81\x41", "es": b"\xff"}


QUERIES = {
    "row_count": (row_count, "SELECT count(*) AS n_rows FROM lineitem"),
    "column_inventory": (
        column_inventory,
        f"""SELECT table_name AS dataset, CAST(ordinal_position - 1 AS INTEGER) AS ordinal, column_name,
        CASE data_type WHEN 'INTEGER' THEN 'int' WHEN 'VARCHAR' THEN 'string' WHEN 'FLOAT[]' THEN 'array<float>' WHEN 'TIMESTAMP' THEN 'timestamp_ntz' ELSE lower(data_type) END AS data_type,
        CAST(count(*) OVER (PARTITION BY table_name) AS INTEGER) AS n_columns
        FROM information_schema.columns WHERE table_name IN ({", ".join(repr(t) for t in TABLES)})""",
    ),
    "profile_all": (
        profile_all,
        " UNION ALL ".join(
            f"""SELECT '{t}' AS dataset, (SELECT count(*) FROM {t}) AS n_rows,
            (SELECT CAST(count(*) AS INTEGER) FROM information_schema.columns WHERE table_name = '{t}') AS n_columns, true AS has_row,
            {f"(SELECT CAST(min({FIRST[t]}) AS VARCHAR) FROM {t})" if t in FIRST else "CAST(NULL AS VARCHAR)"} AS first_key, CAST(NULL AS VARCHAR) AS message"""
            for t in TABLES
        )
        + f" UNION ALL SELECT 'nowhere', NULL, NULL, false, NULL, '{profile.MISSING}'",
    ),
    "preview": (preview, "SELECT * FROM orders ORDER BY o_orderkey LIMIT 5"),
    "lookup_by_key": (
        lookup,
        """SELECT c_custkey AS key, '{"c_custkey":' || c_custkey || ',"c_name":"' || c_name || '","c_nationkey":' || c_nationkey || ',"c_acctbal":'
        || c_acctbal || ',"c_mktsegment":"' || c_mktsegment || '"}' AS record, true AS found FROM customer WHERE c_custkey = 42
        UNION ALL SELECT -1, NULL, false""",
    ),
    "write_dataset": (written_dataset, "SELECT * FROM orders"),
    "encoding_audit": (
        encoding_audit,
        """WITH lines AS (SELECT lang, unnest(string_split(text, chr(10))) AS line FROM documents),
        counts AS (SELECT lang AS file, count(*) AS n_lines, count(*) FILTER (lang = 'fr' AND contains(line, '.')) AS stops,
          count(*) FILTER (strlen(line) <> length(line) OR (lang = 'fr' AND contains(line, '.'))) AS beyond FROM lines GROUP BY lang)
        SELECT file, 'utf-8' AS encoding, n_lines, stops AS n_bad FROM counts
        UNION ALL SELECT file, 'ascii', n_lines, beyond FROM counts UNION ALL SELECT file, 'iso-8859-1', n_lines, 0 FROM counts""",
    ),
    "korean_encodings": (
        korean_encodings,
        """WITH lines AS (SELECT lang, unnest(string_split(text, chr(10))) AS line FROM documents),
        counts AS (SELECT lang AS file, count(*) AS n_lines, count(*) FILTER (contains(line, '.')) AS stops FROM lines GROUP BY lang)
        SELECT file, 'utf-8' AS encoding, n_lines, CASE WHEN file IN ('fr', 'de', 'es') THEN stops ELSE 0 END AS n_bad FROM counts
        UNION ALL SELECT file, 'cp949', n_lines, CASE WHEN file = 'es' THEN stops ELSE 0 END FROM counts
        UNION ALL SELECT file, 'euc-kr', n_lines, CASE WHEN file IN ('de', 'es') THEN stops ELSE 0 END FROM counts""",
    ),
}
