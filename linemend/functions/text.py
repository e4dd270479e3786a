"""Column functions. Each takes columns and returns a column, all inside the JVM."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

from .fixed import ARCHIVE_NAME, CATEGORIES, CODE_PAGES, DATE_SUFFIXES, EDITION_DATE, NA_WORDS, NUMERIC_TYPE, PUBLISHER


def char_class(sep: str) -> str:
    """A one-character separator as a regex escape, valid inside and outside brackets."""
    if len(sep) != 1:
        raise ValueError("separator must be one character")
    return f"\\x{{{ord(sep):x}}}"


def separator_count(col: Column, sep: str = "|") -> Column:
    """Occurrences of a character, from the byte lengths with and without it."""
    dropped = F.octet_length(col) - F.octet_length(F.replace(col, F.lit(sep), F.lit("")))
    width = len(sep.encode())
    return dropped if width == 1 else (dropped / width).cast("int")


def after_bytes(col: Column, n: Column) -> Column:
    """The text behind its first n bytes; does not walk over the characters before them."""
    return F.substring(col.cast("binary"), n + 1, F.octet_length(col)).cast("string")


def decode_utf8_lossy(col: Column) -> Column:
    """Bytes to text; every invalid sequence becomes U+FFFD."""
    return F.make_valid_utf8(col.cast("string"))


def decode_codepage(col: Column, encoding: str) -> Column:
    """Bytes in a code page to text, in the JVM; to be selected while `session.code_pages` holds."""
    return F.decode(col, CODE_PAGES.get(encoding.lower(), encoding))


def encode_codepage(col: Column, encoding: str) -> Column:
    """Text to bytes of a code page, likewise."""
    return F.encode(col, CODE_PAGES.get(encoding.lower(), encoding))


def undecodable(col: Column) -> Column:
    """Whether a value decoded with losses has lost bytes: no code page has a character U+FFFD."""
    return F.coalesce(F.contains(col, F.lit("\ufffd")), F.lit(False))


def strip(col: Column) -> Column:
    """Drop white space of any kind from both ends."""
    return F.regexp_replace(col, r"(?U)\A\s+|\s+\z", "")


def empty_to_null(col: Column) -> Column:
    return F.nullif(col, F.lit(""))


def na_words_to_null(col: Column, words: Iterable[str] = NA_WORDS) -> Column:
    return F.when(~F.coalesce(col.isin(*words), F.lit(False)), col)


# Types ------------------------------------------------------------------------------


def numeric_precision(raw_type: Column) -> Column:
    return _numeric_part(raw_type, 1)


def numeric_scale(raw_type: Column) -> Column:
    """Scale of NUMERIC(p[,s]); 0 where only p is given, null for any other type."""
    return F.when(
        numeric_precision(raw_type).isNotNull(), F.coalesce(_numeric_part(raw_type, 2), F.lit(0))
    )


def _numeric_part(raw_type: Column, group: int) -> Column:
    found = F.regexp_extract(raw_type, NUMERIC_TYPE, group)
    return F.nullif(found, F.lit("")).try_cast("int")


def lenient_decimal(col: Column, precision: int, scale: int) -> Column:
    """Decimal of the given size; null where the text is no number or does not fit."""
    return col.try_cast(f"decimal({precision},{scale})")


# Codes ------------------------------------------------------------------------------


def code_prefix(col: Column, n: int) -> Column:
    return F.substring(col, 1, n)


def not_true(condition: Column) -> Column:
    """Negation that holds for unknown as well as for false."""
    return ~F.coalesce(condition, F.lit(False))


def differs(a: Column, b: Column) -> Column:
    """`a <> b` that holds when a side is null."""
    return F.coalesce(a != b, F.lit(True))


def edition_date(col: Column) -> Column:
    """`... 2026. 2. 1.기준 ...` to `20260201`; null where there is no such date."""
    year, month, day = (F.regexp_extract(col, EDITION_DATE, i) for i in (1, 2, 3))
    return F.when(year != "", F.concat(year, F.lpad(month, 2, "0"), F.lpad(day, 2, "0")))


# Names ------------------------------------------------------------------------------


def clean_dataset_name(col: Column) -> Column:
    """Drop a trailing `(2025년 12월)`, then `(2025.12)`, then `(2025)`."""
    for suffix in DATE_SUFFIXES:
        col = F.regexp_replace(col, f"(?U){suffix}", "")
    return strip(col)


def archive_name_part(name: Column, part: int, year: str, month: str, publisher: str = PUBLISHER) -> Column:
    """Category (1) or dataset (2) of an archive name; null when the name has another form."""
    pattern = ARCHIVE_NAME.format(publisher=publisher, year=year, month=month)
    return F.when(name.rlike(pattern), F.regexp_extract(name, pattern, part))


def catalog_key(category: Column, dataset: Column) -> Column:
    return F.concat_ws("_", category, dataset)


def schema_key(category: Column, dataset: Column) -> Column:
    return F.concat(F.concat_ws("_", F.lit("schema"), category, dataset), F.lit(".txt"))


def normalise_path(col: Column, base: str) -> Column:
    """Path below `base`, with forward slashes and without a `file:` scheme."""
    slashed = F.translate(col, "\\", "/")
    plain = F.regexp_replace(slashed, r"\Afile:/+", "/")
    root = base.replace("\\", "/").removeprefix("file:").rstrip("/") + "/"
    return F.when(F.startswith(plain, F.lit(root)), F.substr(plain, F.lit(len(root) + 1))).otherwise(plain)


def file_name(path: Column) -> Column:
    return F.substring_index(F.translate(path, "\\", "/"), "/", -1)


def category_lookup(col: Column, names: Mapping[str, str] = CATEGORIES) -> Column:
    pairs = [F.lit(x) for item in names.items() for x in item]
    return F.try_element_at(F.create_map(*pairs), col)


# Target window ----------------------------------------------------------------------


def window_start(year: Column, month: Column) -> Column:
    return F.date_format(F.make_date(year, month, F.lit(1)), "yyyyMMdd")


def window_end(year: Column, month: Column, months: int = 3) -> Column:
    return F.date_format(F.add_months(F.make_date(year, month, F.lit(1)), months), "yyyyMMdd")


def search_text(year: Column, month: Column, padded: bool) -> Column:
    """`2025년 2월`, or `2025년 02월` when padded."""
    return F.format_string("%d년 %02d월" if padded else "%d년 %d월", year, month)


__all__ = [name for name, value in list(globals().items()) if callable(value) and not name.startswith("_") and getattr(value, "__module__", "") == __name__]
