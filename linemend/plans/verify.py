"""All checks of a code sheet as one report table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import EXPECTED_DISTRICTS, KNOWN_DISTRICTS, code_prefix, differs, not_true
from ..operators import checks

CHECK = "check string, value long, expected long, passed boolean"


def verify_codes(
    sheet: DataFrame,
    order: str,
    level_code: str = "행정구역분류",
    code: str = "법정동코드",
    province: str = "시도",
    district: str = "시군구",
    known: tuple[str, ...] = KNOWN_DISTRICTS,
    expected: dict[str, int] | None = None,
) -> DataFrame:
    """(check, value, expected, passed). Two passes over the sheet: all counters, and the known
    names. `districts` is the number of rows of the district level against the sum of the classes."""
    expected = EXPECTED_DISTRICTS if expected is None else expected
    classes = list(dict.fromkeys([*expected, *checks.CLASSES]))
    final = F.length(F.col(level_code)) == 5
    label = checks.district_class(F.col(province), F.col(district))
    counts = checks.coverage_check(
        sheet.agg(
            *checks.level_counters(level_code, code),
            F.count_if(final & not_true(F.endswith(F.col(code), F.lit("00000")))).alias("mismatches"),
            F.count_if(final & differs(code_prefix(F.col(code), 5), F.col(level_code))).alias("unequal"),
            F.count_if(final).alias("districts"),
            *(F.count_if(final & (label == name)).alias(f"class_{i}") for i, name in enumerate(classes)),
        )
    )
    rows = [
        *(_row(level, F.col(level)) for level in checks.LEVELS),
        _row("coverage", F.col("covered"), F.col("total"), F.col("passed")),
        _row("suffix_alignment", F.col("mismatches"), F.lit(0), F.col("mismatches") == 0),
        _row("code_disagreement", F.col("unequal"), passed=F.col("unequal") > 0),
        _row("districts", F.col("districts"), F.lit(sum(expected.values())), F.col("districts") == sum(expected.values())),
    ]
    for i, name in enumerate(classes):
        n = F.col(f"class_{i}")
        if name in expected:
            rows.append(_row(name, n, F.lit(expected[name]), n == expected[name]))
        else:
            rows.append(_row(name, n, passed=F.lit(False)))
    unexpected = [name for name in classes if name not in expected]
    counted = counts.select(F.inline(F.array(*rows))).filter(~F.col("check").isin(unexpected) | (F.col("value") > 0))
    found = checks.known_values_check(checks.known_values(sheet.filter(final), district, known, order))
    return counted.unionByName(found.select(F.inline(F.array(_row("known_values", F.col("n_found"), passed=F.col("passed"))))))


def code_evidence(
    sheet: DataFrame,
    order: str,
    level_code: str = "행정구역분류",
    code: str = "법정동코드",
    province: str = "시도",
    district: str = "시군구",
    known: tuple[str, ...] = KNOWN_DISTRICTS,
    sampled: str = "Non-autonomous",
    n: int = 5,
) -> DataFrame:
    """(check, first_at, province, district, level_code, code): the rows that a report shows beside its counts.

    Every known name that was found, with the place where it stands first; the first n rows of the district level whose
    two codes disagree, with the part of the code that is compared; and the first n of a class. Names are as many as
    there are different ones; each sample is a top-n, of which a task keeps n rows.
    """
    final = sheet.filter(F.length(F.col(level_code)) == 5)
    label = checks.district_class(F.col(province), F.col(district))
    names = {"province": province, "district": district, "level_code": level_code}
    found = checks.known_values(final, district, known, order).select("first_at", F.lit(None).cast("string").alias("province"), F.col("value").alias("district"))
    unequal = checks.sample_rows(checks.code_disagreement(final, code, level_code), [order], n)
    members = checks.category_sample(final.withColumn("class", label), "class", sampled, [order], n)

    def shown(rows: DataFrame, check: str, as_code: Column) -> DataFrame:
        return rows.select(F.lit(check).alias("check"), F.col(order).alias("first_at"), *(F.col(c).alias(name) for name, c in names.items()), as_code.alias("code"))

    evidence = shown(unequal, "code_disagreement", code_prefix(F.col(code), 5)).unionByName(shown(members, sampled, F.col(code)))
    return found.withColumn("check", F.lit("known_values")).unionByName(evidence, allowMissingColumns=True).select(
        "check", "first_at", *names, "code"
    )


def _row(check: str, value: Column, expected: Column | None = None, passed: Column | None = None) -> Column:
    return F.struct(
        F.lit(check).alias("check"),
        value.cast("long").alias("value"),
        (F.lit(None) if expected is None else expected).cast("long").alias("expected"),
        (F.lit(None) if passed is None else passed).cast("boolean").alias("passed"),
    )
