"""Data-quality checks on codes derived from parts and on customers' nations."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import ADMIN_CITY_PROVINCE, EXPECTED_DISTRICTS, SPECIAL_CITY
from ..operators import checks
from ..plans.verify import code_evidence, verify_codes
from ..session import work_dir
from ..sinks import write_checks
from ..sources import expected_values
from .tables import table

KNOWN = ("red", "blue w", "old")


def _codes(spark, folder):
    part = table(spark, folder, "part")
    key = F.lpad(F.col("p_partkey").cast("string"), 5, "0")
    size = F.col("p_size")
    level = (
        F.when(size < 6, F.substring(key, 1, 2)).when(size < 30, key).when(size < 40, F.concat(key, F.lit("123")))
        .when(size < 44, F.lit(None)).when(size < 47, F.lit("")).otherwise(F.substring(key, 1, 3))
    )
    suffix = F.when(F.col("p_type") == "PROMO", "12345").otherwise("00000")
    start = F.when(size % 4 == 0, F.reverse(key)).otherwise(key)
    code = F.when(F.col("p_brand") != "Brand#3", F.concat(start, suffix))
    return part.select("p_partkey", "p_type", "p_name", level.alias("level_code"), code.alias("code"))


def level_counts(spark, folder):
    return checks.level_counts(_codes(spark, folder), "level_code", "code", by=["p_type"])


def level_rows(spark, folder):
    return checks.level_rows(checks.level_counts(_codes(spark, folder), "level_code", "code"))


def coverage(spark, folder):
    return checks.coverage_check(level_counts(spark, folder)).select("p_type", "total", "covered", "passed")


def alignment(spark, folder):
    rows = _codes(spark, folder).filter(F.length("level_code") == 5)
    return checks.suffix_alignment(rows, "code", by=["p_type"])


def known(spark, folder):
    return checks.known_values(_codes(spark, folder), "p_name", KNOWN, "p_partkey")


def known_check(spark, folder):
    return checks.known_values_check(known(spark, folder))


def _disagreeing(spark, folder):
    rows = _codes(spark, folder).filter(F.length("level_code") == 5)
    return checks.code_disagreement(rows, "code", "level_code").select("p_partkey", "level_code", F.substring("code", 1, 5).alias("code_5"))


def disagreement_sample(spark, folder):
    return checks.sample_rows(_disagreeing(spark, folder), ["p_partkey"])


def _districts(spark, folder):
    """Customers with a province and a district name built from region and nation."""
    region = table(spark, folder, "region")
    nation = table(spark, folder, "nation").join(region, F.col("n_regionkey") == F.col("r_regionkey"))
    province = F.when(F.col("r_name") == "ASIA", SPECIAL_CITY).when(F.col("r_name") == "AFRICA", ADMIN_CITY_PROVINCE).otherwise(F.col("r_name"))
    district = F.when(F.col("n_nationkey") % 3 == 0, SPECIAL_CITY).when(F.col("n_nationkey") % 3 == 1, F.replace("n_name", F.lit("_"), F.lit(" "))).otherwise(F.col("n_name"))
    named = nation.select("n_nationkey", province.alias("province"), district.alias("district"))
    joined = table(spark, folder, "customer").join(named, F.col("c_nationkey") == F.col("n_nationkey"))
    return joined.select("c_custkey", "province", "district", checks.district_class(F.col("province"), F.col("district")).alias("class"))


def classified(spark, folder):
    return _districts(spark, folder)


def against_expected(spark, folder):
    return checks.category_vs_expected(_districts(spark, folder), "class", expected_values(spark, EXPECTED_DISTRICTS))


def category_sample(spark, folder):
    return checks.category_sample(_districts(spark, folder), "class", "Non-autonomous", ["c_custkey"])


def _parts_sheet(spark, folder):
    return _codes(spark, folder).withColumn("province", F.when(F.col("p_type") == "PROMO", ADMIN_CITY_PROVINCE).otherwise(F.col("p_type")))


def _report(spark, folder):
    return verify_codes(
        _parts_sheet(spark, folder), order="p_partkey", level_code="level_code", code="code", province="province", district="p_name", known=KNOWN
    )


def evidence(spark, folder):
    """What stands beside the counts of the report."""
    return code_evidence(
        _parts_sheet(spark, folder), order="p_partkey", level_code="level_code", code="code", province="province", district="p_name", known=KNOWN
    )


def report(spark, folder):
    return _report(spark, folder)


def written_report(spark, folder):
    path = work_dir(spark, "checks")
    for _ in range(2):
        write_checks(_report(spark, folder), path)
    return spark.read.parquet(path)


CODES_SQL = """
codes AS (
  SELECT p_partkey, p_type, p_name, CASE WHEN p_size < 6 THEN substr(key, 1, 2) WHEN p_size < 30 THEN key
           WHEN p_size < 40 THEN key || '123' WHEN p_size < 44 THEN NULL WHEN p_size < 47 THEN '' ELSE substr(key, 1, 3) END AS level_code,
         CASE WHEN p_brand <> 'Brand#3' THEN CASE WHEN p_size % 4 = 0 THEN reverse(key) ELSE key END
           || CASE WHEN p_type = 'PROMO' THEN '12345' ELSE '00000' END END AS code
  FROM (SELECT *, lpad(CAST(p_partkey AS VARCHAR), 5, '0') AS key FROM part)
)"""
COUNTERS_SQL = """count(*) AS total, count(*) FILTER (length(level_code) = 2) AS len_2, count(*) FILTER (length(level_code) = 5) AS len_5,
  count(*) FILTER (length(level_code) > 5) AS len_over_5, count(*) FILTER (level_code IS NULL OR level_code = '') AS missing,
  count(*) FILTER (code LIKE '%00000') AS suffix_00000"""
MISMATCH_SQL = "count(*) FILTER (code IS NULL OR code NOT LIKE '%00000')"
DISAGREES_SQL = "substr(code, 1, 5) IS DISTINCT FROM level_code"
KNOWN_SQL = "regexp_matches(p_name, 'red|blue w|old')"
DISTRICTS_SQL = f"""
districts AS (
  SELECT c_custkey, province, district, CASE WHEN province = '{SPECIAL_CITY}' AND district = '{SPECIAL_CITY}' THEN 'Special'
           WHEN contains(district, ' ') OR province = '{ADMIN_CITY_PROVINCE}' THEN 'Non-autonomous' ELSE 'Autonomous' END AS class
  FROM customer JOIN (
    SELECT n_nationkey, CASE r_name WHEN 'ASIA' THEN '{SPECIAL_CITY}' WHEN 'AFRICA' THEN '{ADMIN_CITY_PROVINCE}' ELSE r_name END AS province,
           CASE n_nationkey % 3 WHEN 0 THEN '{SPECIAL_CITY}' WHEN 1 THEN replace(n_name, '_', ' ') ELSE n_name END AS district
    FROM nation JOIN region ON n_regionkey = r_regionkey) ON c_nationkey = n_nationkey
)"""
REPORT_SQL = f"""
WITH {CODES_SQL}, counts AS (SELECT {COUNTERS_SQL} FROM codes), final AS (SELECT * FROM codes WHERE length(level_code) = 5),
classes AS (SELECT CASE WHEN contains(p_name, ' ') OR p_type = 'PROMO' THEN 'Non-autonomous' ELSE 'Autonomous' END AS category FROM final)
SELECT level AS "check", n AS value, CAST(NULL AS BIGINT) AS expected, CAST(NULL AS BOOLEAN) AS passed
FROM (UNPIVOT counts ON total, len_2, len_5, len_over_5, missing, suffix_00000 INTO NAME level VALUE n)
UNION ALL SELECT 'coverage', len_2 + len_5 + len_over_5 + missing, total, len_2 + len_5 + len_over_5 + missing = total FROM counts
UNION ALL SELECT 'suffix_alignment', {MISMATCH_SQL}, 0, {MISMATCH_SQL} = 0 FROM final
UNION ALL SELECT 'known_values', count(DISTINCT p_name), NULL, count(DISTINCT p_name) >= 2 FROM final WHERE {KNOWN_SQL}
UNION ALL SELECT 'code_disagreement', count(*), NULL, count(*) > 0 FROM final WHERE {DISAGREES_SQL}
UNION ALL SELECT 'districts', count(*), 268, count(*) = 268 FROM final
UNION ALL SELECT category, n, expected, n = expected FROM (
  SELECT v.category, expected, (SELECT count(*) FROM classes c WHERE c.category = v.category) AS n
  FROM (VALUES ('Autonomous', 226), ('Non-autonomous', 41), ('Special', 1)) AS v(category, expected))
"""

EVIDENCE_SQL = f"""
WITH {CODES_SQL}, final AS (
  SELECT *, CASE WHEN p_type = 'PROMO' THEN '{ADMIN_CITY_PROVINCE}' ELSE p_type END AS province FROM codes WHERE length(level_code) = 5)
SELECT 'known_values' AS "check", min(p_partkey) AS first_at, CAST(NULL AS VARCHAR) AS province, p_name AS district,
  CAST(NULL AS VARCHAR) AS level_code, CAST(NULL AS VARCHAR) AS code FROM final WHERE {KNOWN_SQL} GROUP BY p_name
UNION ALL SELECT * FROM (SELECT 'code_disagreement', p_partkey, province, p_name, level_code, substr(code, 1, 5) FROM final
  WHERE {DISAGREES_SQL} ORDER BY p_partkey LIMIT 5)
UNION ALL SELECT * FROM (SELECT 'Non-autonomous', p_partkey, province, p_name, level_code, code FROM final
  WHERE contains(p_name, ' ') OR p_type = 'PROMO' ORDER BY p_partkey LIMIT 5)
"""

QUERIES = {
    "level_counts": (level_counts, f"WITH {CODES_SQL} SELECT p_type, {COUNTERS_SQL} FROM codes GROUP BY p_type"),
    "level_rows": (
        level_rows,
        f"""WITH {CODES_SQL}, counts AS (SELECT {COUNTERS_SQL} FROM codes)
        SELECT level, n FROM (UNPIVOT counts ON total, len_2, len_5, len_over_5, missing, suffix_00000 INTO NAME level VALUE n)""",
    ),
    "coverage_check": (
        coverage,
        f"""WITH {CODES_SQL} SELECT p_type, total, covered, covered = total AS passed
        FROM (SELECT *, len_2 + len_5 + len_over_5 + missing AS covered FROM (SELECT p_type, {COUNTERS_SQL} FROM codes GROUP BY p_type))""",
    ),
    "suffix_alignment": (
        alignment,
        f"""WITH {CODES_SQL} SELECT p_type, {MISMATCH_SQL} AS mismatches, {MISMATCH_SQL} = 0 AS passed
        FROM codes WHERE length(level_code) = 5 GROUP BY p_type""",
    ),
    "known_values": (known, f"SELECT p_name AS value, min(p_partkey) AS first_at FROM part WHERE {KNOWN_SQL} GROUP BY p_name"),
    "known_values_check": (known_check, f"SELECT count(DISTINCT p_name) AS n_found, count(DISTINCT p_name) >= 2 AS passed FROM part WHERE {KNOWN_SQL}"),
    "code_disagreement": (
        _disagreeing,
        f"""WITH {CODES_SQL} SELECT p_partkey, level_code, substr(code, 1, 5) AS code_5 FROM codes
        WHERE length(level_code) = 5 AND {DISAGREES_SQL}""",
    ),
    "disagreement_sample": (
        disagreement_sample,
        f"""WITH {CODES_SQL} SELECT p_partkey, level_code, substr(code, 1, 5) AS code_5 FROM codes
        WHERE length(level_code) = 5 AND {DISAGREES_SQL} ORDER BY p_partkey LIMIT 5""",
    ),
    "classify_rows": (classified, f"WITH {DISTRICTS_SQL} SELECT * FROM districts"),
    "category_vs_expected": (
        against_expected,
        f"""WITH {DISTRICTS_SQL} SELECT category, n, expected, n = expected AS passed FROM (
        SELECT v.category, (SELECT count(*) FROM districts WHERE class = v.category) AS n, CAST(expected AS BIGINT) AS expected
        FROM (VALUES ('Autonomous', 226), ('Non-autonomous', 41), ('Special', 1)) AS v(category, expected))""",
    ),
    "category_sample": (
        category_sample, f"WITH {DISTRICTS_SQL} SELECT * FROM districts WHERE class = 'Non-autonomous' ORDER BY c_custkey LIMIT 5"
    ),
    "verify_codes": (report, REPORT_SQL),
    "code_evidence": (evidence, EVIDENCE_SQL),
    "write_checks": (written_report, REPORT_SQL),
}
