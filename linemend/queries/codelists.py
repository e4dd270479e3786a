"""Code hierarchies: parts carry ten-digit codes, orders carry edition dates."""

from __future__ import annotations

import csv
import io

import pyarrow as pa
from pyspark.sql import functions as F

from ..functions import code_prefix, decode_codepage, encode_codepage, na_words_to_null, normalise_path, undecodable
from ..operators import codes
from ..plans.regions import all_editions, legal_districts, statistical_districts, write_legal_districts, write_statistical_districts
from ..session import code_pages, work_dir
from ..sinks import read_csv_bom, write_csv_bom
from ..sources import scan_code_sheet, scan_codepage_table, undecodable_values
from .files import writable
from .tables import table


def _codes(spark, folder):
    """Ten-digit codes; large parts have a one-word name, some parts none."""
    part = table(spark, folder, "part")
    name = F.when(F.col("p_size") == 7, F.lit(None)).when(F.col("p_size") > 25, F.replace("p_name", F.lit(" "), F.lit(""))).otherwise(F.col("p_name"))
    code = F.lpad((F.col("p_partkey") * 2500).cast("string"), 10, "0")
    return part.select(code.alias("법정동코드"), name.alias("법정동명"), F.col("p_type").alias("폐지여부"))


def suffix_rows(spark, folder):
    return codes.filter_suffix(_codes(spark, folder), "법정동코드").withColumnsRenamed({"법정동코드": "code", "법정동명": "name", "폐지여부": "state"})


def district_table(spark, folder):
    return legal_districts(_codes(spark, folder))[0]


def province_table(spark, folder):
    return legal_districts(_codes(spark, folder))[1]


def prefixes(spark, folder):
    return _codes(spark, folder).select(
        F.col("법정동코드").alias("code"), code_prefix(F.col("법정동코드"), 5).alias("district"), code_prefix(F.col("법정동코드"), 2).alias("province")
    )


def _sheet(spark, folder):
    """A sheet whose level code has 1 to 6 digits and whose header holds line breaks."""
    part = table(spark, folder, "part")
    level = F.substring(F.lpad(F.col("p_partkey").cast("string"), 6, "7"), F.lit(1), F.col("p_size") % 6 + 1)
    return part.select(
        F.col("p_brand").alias("시도"), F.col("p_name").alias("시군구"), level.alias("행정구역분류"),
        F.lpad((F.col("p_partkey") * 37).cast("string"), 10, "3").alias("법정동코드"), F.col("p_type").alias("행정동\n(행정기관명)"),
    )


def sheet_provinces(spark, folder):
    return statistical_districts(codes.clean_header(_sheet(spark, folder)))[0]


def sheet_districts(spark, folder):
    """Two editions at once."""
    sheet = codes.clean_header(_sheet(spark, folder))
    return statistical_districts(all_editions({"20251231": sheet, "20260201": sheet}))[1]


def longer_codes(spark, folder):
    sheet = codes.clean_header(_sheet(spark, folder))
    return codes.filter_code_length(sheet, "행정구역분류", 5, longer=True).select(F.col("행정구역분류").alias("level_code"), F.col("법정동코드").alias("code"))


def clean_header(spark, folder):
    rows = table(spark, folder, "supplier").select(F.col("s_suppkey").alias("공급\n코드"), F.col("s_name").alias("이름\n(영문)"))
    return codes.clean_header(rows)


def renamed(spark, folder):
    rows = table(spark, folder, "supplier").select("s_suppkey", "s_name", "s_nationkey")
    return codes.key_first(codes.rename_columns(rows, {"s_name": "시군구명", "s_nationkey": "시도코드"}), "시도코드")


def _cell():
    """Order priorities, three of them turned into words for a missing value or into blanks."""
    return (
        F.when(F.col("o_orderpriority") == "1-URGENT", "NA").when(F.col("o_orderpriority") == "2-HIGH", "null")
        .when(F.col("o_orderpriority") == "3-MEDIUM", "").otherwise(F.col("o_orderpriority"))
    )


def na_words(spark, folder):
    return table(spark, folder, "orders").select("o_orderkey", na_words_to_null(_cell()).alias("cell"))


def code_sheet(spark, folder):
    """The first two of three columns, all as text."""
    rows = table(spark, folder, "orders").select("o_orderkey", _cell().alias("우선\n순위"), "o_orderstatus")
    return scan_code_sheet(rows, 2)


def _editions(spark, folder):
    """An edition file per order; cancelled dates have no date in the name."""
    orders = table(spark, folder, "orders")
    date = F.concat(
        F.year("o_orderdate").cast("string"), F.lit(". "), F.month("o_orderdate").cast("string"), F.lit(". "),
        F.dayofmonth("o_orderdate").cast("string"), F.lit(".기준"),
    )
    name = F.concat(F.lit("한국행정구역분류_"), F.when(F.col("o_orderstatus") == "P", "").otherwise(date), F.lit("_"), F.col("o_orderkey").cast("string"), F.lit(".xlsx"))
    return orders.select("o_custkey", F.col("o_orderkey").alias("path"), name.alias("name"))


def edition_dates(spark, folder):
    return codes.with_edition(_editions(spark, folder)).select("path", "edition_date")


def latest_editions(spark, folder):
    return codes.latest_edition(_editions(spark, folder), by="o_custkey").select("o_custkey", "path", "edition_date")


def latest_edition(spark, folder):
    return codes.latest_edition(_editions(spark, folder)).select("path", "edition_date")


def undated(spark, folder):
    return codes.undated_files(_editions(spark, folder)).select("path", "name", "issue")


def codepage_table(spark, folder):
    """Written as cp949 bytes, read back."""
    part = table(spark, folder, "part")
    path = work_dir(spark, "codepage")
    rows = part.select(
        F.col("p_partkey").cast("string").alias("코드"), F.concat(F.lit("건축물 "), "p_name").alias("이름"), F.col("p_type").alias("구분")
    )
    _write_cp949(rows, path)
    return scan_codepage_table(spark, path)


def _write_cp949(rows, path):
    with code_pages(rows.sparkSession):
        as_bytes = rows.select(
            *(F.decode(encode_codepage(F.col(c), "cp949"), "ISO-8859-1").alias(c.encode("cp949").decode("latin-1")) for c in rows.columns)
        )
    as_bytes.write.option("header", True).option("sep", "\t").option("encoding", "ISO-8859-1").csv(path)


def code_list_files(spark, folder):
    """A code list in cp949 files to written tables, of which the districts are read back."""
    source, out = work_dir(spark, "codes"), work_dir(spark, "regions")
    _write_cp949(_codes(spark, folder), source)
    write_legal_districts(spark, source, out)
    return read_csv_bom(spark, f"{out}/code_sgg")


def codepage_text(spark, folder):
    """Korean text as bytes and back, a byte of no character behind every third customer's."""
    rows = table(spark, folder, "customer")
    stray = F.when(F.col("c_custkey") % 3 == 0, F.lit(b"\xff")).otherwise(F.lit(b""))
    with code_pages(spark, lossy=True):
        raw = F.concat(encode_codepage(F.concat(F.lit("시장 "), "c_mktsegment"), "cp949"), stray)
        return rows.select("c_custkey", decode_codepage(raw, "cp949").alias("segment")).withColumn("lost", undecodable(F.col("segment")))


def undecodable_counts(spark, folder):
    """A cp949 file in which the names of every fourth part hold a byte of no character."""
    part = table(spark, folder, "part")
    path = work_dir(spark, "codepage")
    name = F.when(F.col("p_partkey") % 4 == 0, F.concat("p_name", F.lit("\u00ff"))).otherwise(F.col("p_name"))
    rows = part.select(F.col("p_partkey").cast("string").alias("code"), name.alias("name"))
    rows.write.option("header", True).option("sep", "\t").option("encoding", "ISO-8859-1").csv(path)
    return undecodable_values(scan_codepage_table(spark, path, lossy=True))


def sheet_files(spark, folder):
    """Two dated sheet files with their names in row 2, and an undated one, to written tables, of which the districts are
    read back."""
    source, out = work_dir(spark, "sheets"), work_dir(spark, "regions")
    _write_sheets(spark, folder, source)
    write_statistical_districts(spark, source, out, n_columns=5)
    rows = read_csv_bom(spark, f"{out}/code_kcad_sgg")
    return rows.withColumn("edition_date", F.col("edition_date").cast("string"))


SHEET_FILES = ("분류_2025.12.31.기준_1.csv", "분류_2026. 2. 1.기준_2.csv", "분류_3.csv")


def _write_sheets(spark, folder, path):
    """The sheet once a file, each written by one task; cells with quotes, commas and line breaks are quoted."""
    sheet = _sheet(spark, folder)
    rows = sheet.select(F.explode(F.array(*map(F.lit, SHEET_FILES))).alias("file"), *(F.coalesce(f"`{c}`", F.lit("#N/A")).alias(c) for c in sheet.columns))
    names = sheet.columns

    def store(batches):
        current = sink = None
        for batch in batches:
            for file, *cells in zip(*(column.to_pylist() for column in batch.columns), strict=True):
                if file != current:
                    if sink is not None:
                        sink.close()
                    current, sink = file, io.TextIOWrapper(writable(f"{path}/{file}"), "utf-8", newline="")
                    out = csv.writer(sink, lineterminator="\n")
                    out.writerow(["제목"] + [""] * (len(names) - 1))
                    out.writerow(names)
                out.writerow(cells)
        if sink is not None:
            sink.close()
        yield pa.RecordBatch.from_pydict({"file": pa.array([], pa.string())})

    dealt = rows.repartition(len(SHEET_FILES), "file").sortWithinPartitions("file")
    dealt.mapInArrow(store, "file string").write.format("noop").mode("overwrite").save()


def csv_round_trip(spark, folder):
    path = work_dir(spark, "csv")
    write_csv_bom(district_table(spark, folder), path, "시군구코드")
    return read_csv_bom(spark, path)


def edition_csv(spark, folder):
    """One folder per edition."""
    path = work_dir(spark, "editions")
    write_csv_bom(sheet_districts(spark, folder), path, "시군구코드", partition_by="edition_date")
    rows = read_csv_bom(spark, path)
    return rows.groupBy(F.col("edition_date").cast("string").alias("edition_date")).agg(F.count("*").alias("n"), F.min("시군구코드").cast("string").alias("first_code"))


def paths(spark, folder):
    rows = table(spark, folder, "supplier")
    return rows.select("s_suppkey", normalise_path(F.concat(F.lit("file:///e:\\data\\"), "s_name", F.lit("\\x.zip")), "/e:/data").alias("path"))


CODES_SQL = """
codes AS (
  SELECT lpad(CAST(p_partkey * 2500 AS VARCHAR), 10, '0') AS code, p_type AS state,
         CASE WHEN p_size = 7 THEN NULL WHEN p_size > 25 THEN replace(p_name, ' ', '') ELSE p_name END AS name FROM part
)"""
DISTRICTS_SQL = f"""WITH {CODES_SQL} SELECT substr(code, 1, 5) AS "시군구코드", name AS "시군구명", state AS "폐지여부"
FROM codes WHERE code LIKE '%00000'"""

SHEET_SQL = """
sheet AS (
  SELECT p_brand AS "시도", p_name AS "시군구", substr(lpad(CAST(p_partkey AS VARCHAR), 6, '7'), 1, p_size % 6 + 1) AS "행정구역분류",
         lpad(CAST(p_partkey * 37 AS VARCHAR), 10, '3') AS "법정동코드", p_type AS "행정동 (행정기관명)" FROM part
)"""

CELL_SQL = "CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN NULL WHEN o_orderpriority = '3-MEDIUM' THEN '' ELSE o_orderpriority END"

EDITIONS_SQL = """
editions AS (
  SELECT o_custkey, o_orderkey AS path, CASE WHEN o_orderstatus <> 'P' THEN strftime(o_orderdate, '%Y%m%d') END AS edition_date FROM orders
)"""

QUERIES = {
    "filter_suffix": (suffix_rows, f"WITH {CODES_SQL} SELECT code, name, state FROM codes WHERE code LIKE '%00000'"),
    "code_prefix": (prefixes, f"WITH {CODES_SQL} SELECT code, substr(code, 1, 5) AS district, substr(code, 1, 2) AS province FROM codes"),
    "district_table": (district_table, DISTRICTS_SQL),
    "code_list_files": (code_list_files, DISTRICTS_SQL),
    "province_table": (
        province_table,
        f"""WITH {CODES_SQL} SELECT substr(code, 1, 2) AS "시도코드", name AS "시도명", state AS "폐지여부"
        FROM codes WHERE name IS NULL OR NOT contains(name, ' ')""",
    ),
    "sheet_provinces": (
        sheet_provinces,
        f"""WITH {SHEET_SQL} SELECT substr("법정동코드", 1, 2) AS "시도코드", * FROM sheet WHERE length("행정구역분류") = 2""",
    ),
    "sheet_districts": (
        sheet_districts,
        f"""WITH {SHEET_SQL} SELECT substr("법정동코드", 1, 5) AS "시군구코드", sheet.*, edition_date
        FROM sheet, (VALUES ('20251231'), ('20260201')) AS v(edition_date) WHERE length("행정구역분류") = 5""",
    ),
    "filter_code_length": (
        longer_codes,
        f"""WITH {SHEET_SQL} SELECT "행정구역분류" AS level_code, "법정동코드" AS code FROM sheet WHERE length("행정구역분류") > 5""",
    ),
    "clean_header": (clean_header, 'SELECT s_suppkey AS "공급 코드", s_name AS "이름 (영문)" FROM supplier'),
    "rename_columns": (renamed, 'SELECT s_nationkey AS "시도코드", s_suppkey, s_name AS "시군구명" FROM supplier'),
    "na_words": (na_words, f"SELECT o_orderkey, {CELL_SQL} AS cell FROM orders"),
    "scan_code_sheet": (code_sheet, f'SELECT CAST(o_orderkey AS VARCHAR) AS o_orderkey, {CELL_SQL} AS "우선 순위" FROM orders'),
    "edition_date": (edition_dates, f"WITH {EDITIONS_SQL} SELECT path, edition_date FROM editions"),
    "latest_edition_per_key": (
        latest_editions,
        f"""WITH {EDITIONS_SQL} SELECT o_custkey, path, edition_date FROM (
        SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY edition_date DESC, path DESC) AS rn
        FROM editions WHERE edition_date IS NOT NULL) WHERE rn = 1""",
    ),
    "latest_edition": (
        latest_edition,
        f"""WITH {EDITIONS_SQL} SELECT path, edition_date FROM editions WHERE edition_date IS NOT NULL
        ORDER BY edition_date DESC, path DESC LIMIT 1""",
    ),
    "undated_files": (
        undated,
        """SELECT o_orderkey AS path, '한국행정구역분류__' || o_orderkey || '.xlsx' AS name, 'no edition date' AS issue
        FROM orders WHERE o_orderstatus = 'P'""",
    ),
    "scan_codepage_table": (
        codepage_table, """SELECT CAST(p_partkey AS VARCHAR) AS "코드", '건축물 ' || p_name AS "이름", p_type AS "구분" FROM part"""
    ),
    "decode_codepage": (
        codepage_text,
        """SELECT c_custkey, '시장 ' || c_mktsegment || CASE WHEN c_custkey % 3 = 0 THEN chr(65533) ELSE '' END AS segment,
        c_custkey % 3 = 0 AS lost FROM customer""",
    ),
    "undecodable_values": (
        undecodable_counts,
        """SELECT 'code' AS column_name, CAST(0 AS BIGINT) AS n UNION ALL SELECT 'name', count(*) FILTER (p_partkey % 4 = 0) FROM part""",
    ),
    "sheet_files": (
        sheet_files,
        f"""WITH {SHEET_SQL} SELECT substr("법정동코드", 1, 5) AS "시군구코드", sheet.*, edition_date
        FROM sheet, (VALUES ('20251231'), ('20260201')) AS v(edition_date) WHERE length("행정구역분류") = 5""",
    ),
    "write_csv_bom": (csv_round_trip, DISTRICTS_SQL),
    "write_editions": (
        edition_csv,
        f"""WITH {SHEET_SQL} SELECT edition_date, count(*) AS n, min(substr("법정동코드", 1, 5)) AS first_code
        FROM sheet, (VALUES ('20251231'), ('20260201')) AS v(edition_date) WHERE length("행정구역분류") = 5 GROUP BY edition_date""",
    ),
    "normalise_path": (paths, "SELECT s_suppkey, s_name || '/x.zip' AS path FROM supplier"),
}
