"""Typing of pipe text by an external schema."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import repair
from ..operators.registry import ColumnSpec
from ..operators.typed import apply_schema, cast_losses, lenient_decimal_cast, read_as_strings, type_records, with_losses
from ..session import work_dir
from ..sources import lines_of_rows, pack_blocks, scan_delimited
from .tables import LINEITEM_COLUMNS, LINEITEM_SQL, lineitem_text, money, table


def typed_lineitem(spark, folder):
    return type_records(table(spark, folder, "lineitem").select(lineitem_text().alias("value")), LINEITEM_COLUMNS)


def scanned_lineitem(spark, folder):
    """Written as text files, read back."""
    path = work_dir(spark, "text")
    table(spark, folder, "lineitem").select(lineitem_text()).write.option("lineSep", "\r\n").text(path)
    return apply_schema(scan_delimited(spark, path), LINEITEM_COLUMNS)


def repaired_lineitem(spark, folder):
    """The same rows through the repair, which finds nothing to do."""
    lines = lines_of_rows(table(spark, folder, "lineitem"), F.lit("lineitem"), lineitem_text())
    outcome = repair.repair_blocks(pack_blocks(lines), len(LINEITEM_COLUMNS) - 1)
    return type_records(repair.kept_records(outcome), LINEITEM_COLUMNS)


def broken_lineitem(spark, folder):
    """The same rows, each with a line break after its fourth field."""
    text = F.regexp_replace(lineitem_text(), r"\A((?:[^|]*\|){4})", "$1\n")
    lines = lines_of_rows(table(spark, folder, "lineitem"), F.lit("lineitem"), text)
    outcome = repair.repair_blocks(pack_blocks(lines), len(LINEITEM_COLUMNS) - 1)
    return type_records(repair.kept_records(outcome), LINEITEM_COLUMNS)


def all_strings(spark, folder):
    records = table(spark, folder, "orders").select(
        F.concat_ws("|", F.col("o_orderkey").cast("string"), "o_orderstatus", money("o_totalprice"), "o_orderpriority").alias("value")
    )
    columns = [ColumnSpec("orderkey", 9), ColumnSpec("status"), ColumnSpec("price", 9, 2), ColumnSpec("priority")]
    return apply_schema(read_as_strings(records), columns, cast=False)


def lost_casts(spark, folder):
    lines = table(spark, folder, "lineitem").select(lineitem_text().alias("value"))
    rows = with_losses(read_as_strings(lines), LINEITEM_COLUMNS)
    counts = rows.agg(*(count.alias(name) for name, count in cast_losses(LINEITEM_COLUMNS).items()))
    return counts.unpivot([], list(counts.columns), "column_name", "n_lost")


def lenient_cast(spark, folder):
    part = table(spark, folder, "part")
    price = F.col("p_retailprice").cast("decimal(9,2)").cast("string")
    text = part.select("p_partkey", price.alias("wide"), price.alias("narrow"), price.alias("whole"), F.col("p_name").alias("word"))
    return lenient_decimal_cast(
        text, [ColumnSpec("wide", 9, 2), ColumnSpec("narrow", 4, 2), ColumnSpec("whole", 5), ColumnSpec("word", 5)]
    )


def ragged(spark, folder):
    rows = table(spark, folder, "customer")
    key = F.col("c_custkey").cast("string")
    value = (
        F.when(F.col("c_nationkey") < 8, F.concat_ws("|", key, "c_name", "c_mktsegment", F.lit("extra"), F.lit("")))
        .when(F.col("c_nationkey") < 16, F.concat_ws("|", key, "c_name"))
        .otherwise(F.concat_ws("|", key, "c_name", "c_mktsegment"))
    )
    columns = [ColumnSpec("custkey", 18), ColumnSpec("name"), ColumnSpec("segment")]
    return type_records(rows.select(value.alias("value")), columns, ragged="truncate")


def quotes_and_blanks(spark, folder):
    """Quotes are data; an empty field is null."""
    rows = table(spark, folder, "conversations")
    role = F.when(F.col("turn") == 0, "").otherwise(F.concat(F.lit('"'), F.col("role")))
    value = F.concat_ws("|", F.col("conv_id").cast("string"), F.col("turn").cast("string"), role, F.translate("text", "|\n", '""'))
    columns = [ColumnSpec("conv_id", 18), ColumnSpec("turn", 18), ColumnSpec("role"), ColumnSpec("text")]
    return type_records(rows.select(value.alias("value")), columns)


QUERIES = {
    "typed_lineitem": (typed_lineitem, LINEITEM_SQL),
    "scan_delimited": (scanned_lineitem, LINEITEM_SQL),
    "repaired_lineitem": (repaired_lineitem, LINEITEM_SQL),
    "broken_lineitem": (
        broken_lineitem,
        # The break is joined by one space, which the lenient cast ignores.
        LINEITEM_SQL,
    ),
    "read_as_strings": (
        all_strings,
        """SELECT CAST(o_orderkey AS VARCHAR) AS orderkey, o_orderstatus AS status,
        CAST(CAST(o_totalprice AS DECIMAL(15,2)) AS VARCHAR) AS price, o_orderpriority AS priority FROM orders""",
    ),
    "cast_losses": (
        lost_casts,
        """SELECT name AS column_name, CASE WHEN name = 'l_extendedprice' THEN n ELSE 0 END AS n_lost
        FROM (SELECT count(*) FILTER (l_orderkey % 97 = 0) AS n FROM lineitem),
        (SELECT unnest(['l_orderkey', 'l_partkey', 'l_suppkey', 'l_linenumber', 'l_quantity', 'l_extendedprice',
                        'l_discount', 'l_tax']) AS name)""",
    ),
    "lenient_decimal_cast": (
        lenient_cast,
        """SELECT p_partkey, CAST(p_retailprice AS DECIMAL(9,2)) AS wide,
        TRY_CAST(CAST(CAST(p_retailprice AS DECIMAL(9,2)) AS VARCHAR) AS DECIMAL(4,2)) AS narrow,
        TRY_CAST(CAST(CAST(p_retailprice AS DECIMAL(9,2)) AS VARCHAR) AS DECIMAL(5,0)) AS whole,
        TRY_CAST(p_name AS DECIMAL(5,0)) AS word FROM part""",
    ),
    "truncate_ragged": (
        ragged,
        """SELECT CAST(c_custkey AS DECIMAL(18,0)) AS custkey, c_name AS name,
        CASE WHEN c_nationkey BETWEEN 8 AND 15 THEN NULL ELSE c_mktsegment END AS segment FROM customer""",
    ),
    "no_quoting": (
        quotes_and_blanks,
        """SELECT CAST(conv_id AS DECIMAL(18,0)) AS conv_id, CAST(turn AS DECIMAL(18,0)) AS turn,
        CASE WHEN turn = 0 THEN NULL ELSE '"' || role END AS role,
        replace(replace(text, '|', '"'), chr(10), '"') AS text FROM conversations""",
    ),
}
