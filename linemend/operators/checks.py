"""Data-quality checks on code tables. Counts only: each is one pass with partial aggregation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import ADMIN_CITY_PROVINCE, SPECIAL_CITY, code_prefix, differs, not_true

LEVELS = ("total", "len_2", "len_5", "len_over_5", "missing", "suffix_00000")
CLASSES = ("Special", "Non-autonomous", "Autonomous")


def level_counts(df: DataFrame, code: str, alt_code: str, by: Sequence[str] = ()) -> DataFrame:
    """One row of counters (per `by` group): total, code lengths, missing, alt-code suffix."""
    return df.groupBy(*by).agg(*level_counters(code, alt_code))


def level_counters(code: str, alt_code: str) -> list[Column]:
    """The aggregates of `level_counts`, for use beside others in one pass."""
    c, length = F.col(code), F.length(F.col(code))
    counters = (
        F.count("*"),
        F.count_if(length == 2),
        F.count_if(length == 5),
        F.count_if(length > 5),
        F.count_if(c.isNull() | (c == "")),
        F.count_if(F.endswith(F.col(alt_code), F.lit("00000"))),
    )
    return [counter.alias(level) for counter, level in zip(counters, LEVELS)]


def level_rows(counts: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """`level_counts` as (level, n) rows."""
    return counts.unpivot(list(by), list(LEVELS), "level", "n")


def coverage_check(counts: DataFrame) -> DataFrame:
    """Add `covered` and whether the levels make up the total. Codes of length 1, 3 and 4
    belong to no level, so this can fail."""
    covered = F.col("len_2") + F.col("len_5") + F.col("len_over_5") + F.col("missing")
    return counts.withColumn("covered", covered).withColumn("passed", covered == F.col("total"))


def suffix_alignment(df: DataFrame, code: str, suffix: str = "00000", by: Sequence[str] = ()) -> DataFrame:
    """How many codes lack the suffix; missing codes do."""
    lacking = not_true(F.endswith(F.col(code), F.lit(suffix)))
    return df.groupBy(*by).agg(F.count_if(lacking).alias("mismatches")).withColumn("passed", F.col("mismatches") == 0)


def known_values(df: DataFrame, col: str, names: Sequence[str], order: str) -> DataFrame:
    """(value, first_at): distinct values that contain a known name, and where first seen.

    Ordered by `first_at` these rows are the report's list of names found.
    """
    pattern = "|".join(_literal(n) for n in names)
    hits = df.filter(F.coalesce(F.col(col).rlike(pattern), F.lit(False)))
    return hits.groupBy(F.col(col).alias("value")).agg(F.min(order).alias("first_at"))


def known_values_check(found: DataFrame, minimum: int = 2) -> DataFrame:
    return found.agg(F.count("*").alias("n_found")).withColumn("passed", F.col("n_found") >= minimum)


def code_disagreement(df: DataFrame, a: str, b: str, n: int = 5) -> DataFrame:
    """Rows whose code `a` does not begin with code `b`; a missing code disagrees."""
    return df.filter(differs(code_prefix(F.col(a), n), F.col(b)))


def sample_rows(df: DataFrame, order: Sequence[str], n: int = 5) -> DataFrame:
    """The first n rows in the given order: a top-n, each task keeps n rows."""
    return df.orderBy(*order).limit(n)


def classify_rows(rules: Sequence[tuple[Column, str]], otherwise: str) -> Column:
    """Class of a row; the first rule that holds wins."""
    case = None
    for condition, label in rules:
        case = F.when(condition, label) if case is None else case.when(condition, label)
    return F.lit(otherwise) if case is None else case.otherwise(otherwise)


def district_class(province: Column, name: Column) -> Column:
    """Special city, non-autonomous district (two-word name, or in the province whose
    cities are administrative only), else autonomous."""
    return classify_rows(
        [
            ((province == SPECIAL_CITY) & (name == SPECIAL_CITY), "Special"),
            (F.contains(name, F.lit(" ")) | (province == ADMIN_CITY_PROVINCE), "Non-autonomous"),
        ],
        "Autonomous",
    )


def category_vs_expected(df: DataFrame, category: str, expected: DataFrame) -> DataFrame:
    """(category, n, expected, passed). Classes on either side are kept."""
    counts = df.groupBy(F.col(category).alias("category")).agg(F.count("*").alias("n"))
    joined = counts.join(expected, "category", "full").withColumn("n", F.coalesce("n", F.lit(0)))
    return joined.withColumn("passed", F.col("n").eqNullSafe(F.col("expected")))


def category_sample(df: DataFrame, category: str, value: str, order: Sequence[str], n: int = 5) -> DataFrame:
    return sample_rows(df.filter(F.col(category) == value), order, n)


def _literal(text: str) -> str:
    return "".join(ch if ch.isalnum() or ch == " " else "\\" + ch for ch in text)
