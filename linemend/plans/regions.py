"""Code lists and code sheets to region tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import edition_date, file_name
from ..operators.codes import districts, provinces, sheet_level, undated_files, with_edition
from ..sinks import write_csv_bom
from ..sources import list_files, read_code_sheets, scan_codepage_table


def legal_districts(codes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(district table, province table) of a legal-district code list."""
    return (
        districts(codes, "법정동코드", "법정동명", "시군구코드", "시군구명"),
        provinces(codes, "법정동코드", "법정동명", "시도코드", "시도명"),
    )


def statistical_districts(sheet: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(province table, district table) of a code sheet, or of all editions of it at once
    where the sheet has an `edition_date` column."""
    return (
        sheet_level(sheet, "행정구역분류", 2, "법정동코드", 2, "시도코드"),
        sheet_level(sheet, "행정구역분류", 5, "법정동코드", 5, "시군구코드"),
    )


def all_editions(sheets: dict[str, DataFrame]) -> DataFrame:
    """Sheets by edition date as one table with an `edition_date` column."""
    dated = [sheet.withColumn("edition_date", F.lit(date)) for date, sheet in sorted(sheets.items())]
    result, *others = dated
    for other in others:
        result = result.unionByName(other, allowMissingColumns=True)
    return result


def write_legal_districts(spark: SparkSession, path: str, out: str, encoding: str = "cp949") -> None:
    """From the file of a code list to its full, district and province tables as CSV below `out`."""
    codes = scan_codepage_table(spark, path, encoding)
    district, province = legal_districts(codes)
    write_csv_bom(codes, f"{out}/code_bjd", "법정동코드")
    write_csv_bom(district, f"{out}/code_sgg", "시군구코드")
    write_csv_bom(province, f"{out}/code_sido", "시도코드")


def write_statistical_districts(spark: SparkSession, folder: str, out: str, glob: str = "*.csv", **sheet) -> DataFrame:
    """From all dated sheet files of a folder to province and district tables as CSV, a folder for
    each edition. Returns the files that are skipped because their name has no date.

    `sheet` goes to `read_code_sheets`.
    """
    files = list_files(spark, folder, glob)
    paths = [row["path"] for row in with_edition(files).filter("edition_date IS NOT NULL").select("path").collect()]
    if paths:
        sheets = read_code_sheets(spark, paths, **sheet)
        sheets = sheets.withColumn("edition_date", edition_date(file_name(F.url_decode(F.replace("path", F.lit("+"), F.lit("%2B")))))).drop("path")
        province, district = statistical_districts(sheets)
        write_csv_bom(province, f"{out}/code_kcad_sido", "시도코드", partition_by="edition_date")
        write_csv_bom(district, f"{out}/code_kcad_sgg", "시군구코드", partition_by="edition_date")
    return undated_files(files)
