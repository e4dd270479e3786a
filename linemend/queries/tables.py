"""The given tables, and the text forms of them that several queries share."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.registry import ColumnSpec
from ..sources import lines_of_rows, pack_blocks

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def money(col: str):
    """A two-digit amount as text."""
    return F.col(col).cast("decimal(15,2)").cast("string")


# documents as pipe text: the text, with its line breaks, before the last field.

DOCUMENT_COLUMNS = (
    ColumnSpec("doc_id", 18), ColumnSpec("lang"), ColumnSpec("source"), ColumnSpec("text"), ColumnSpec("n_chars", 9),
)
DOCUMENT_SEPARATORS = len(DOCUMENT_COLUMNS) - 1


def document_text(plain: bool = False):
    """Pipe text of a document; `plain` replaces pipes inside the text."""
    text = F.translate("text", "|", "/") if plain else F.col("text")
    return F.concat_ws("|", F.col("doc_id").cast("string"), "lang", "source", text, F.col("n_chars").cast("string"))


DOCUMENT_SQL = "concat_ws('|', doc_id, lang, source, text, n_chars)"


def document_lines(spark: SparkSession, folder: str, file: str = "source") -> DataFrame:
    """Lines of the documents; a file per `file` value, ordered by document and line."""
    return table(spark, folder, "documents").select(
        F.col(file).cast("string").alias("file"), F.col("doc_id").alias("part"),
        F.posexplode(F.split(document_text(), "\n")).alias("id", "value"),
    )


def ordered_document_blocks(spark: SparkSession, folder: str) -> DataFrame:
    """Blocks of one file per source, documents in order of doc_id.

    The range exchange also cuts a source that holds many documents.
    """
    docs = table(spark, folder, "documents").select("source", "doc_id", document_text().alias("line"))
    ordered = docs.repartitionByRange("source", "doc_id").sortWithinPartitions("source", "doc_id")
    return pack_blocks(lines_of_rows(ordered, F.col("source"), F.col("line")))


def document_blocks(spark: SparkSession, folder: str, plain: bool = True) -> DataFrame:
    """Blocks of all documents as one file, in table order."""
    docs = table(spark, folder, "documents")
    return pack_blocks(lines_of_rows(docs, F.lit("documents"), document_text(plain)))


# lineitem as pipe text; the price of every 97th order is no number.

LINEITEM_COLUMNS = (
    ColumnSpec("l_orderkey", 18), ColumnSpec("l_partkey", 18), ColumnSpec("l_suppkey", 18), ColumnSpec("l_linenumber", 9),
    ColumnSpec("l_quantity", 15, 2), ColumnSpec("l_extendedprice", 15, 2), ColumnSpec("l_discount", 15, 2),
    ColumnSpec("l_tax", 15, 2), ColumnSpec("l_returnflag"), ColumnSpec("l_linestatus"), ColumnSpec("l_shipdate"),
)


def lineitem_text():
    price = F.when(F.col("l_orderkey") % 97 == 0, F.concat(F.lit("x"), money("l_extendedprice"))).otherwise(money("l_extendedprice"))
    keys = [F.col(c).cast("string") for c in ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber")]
    return F.concat_ws(
        "|", *keys, money("l_quantity"), price, money("l_discount"), money("l_tax"), "l_returnflag", "l_linestatus",
        F.date_format("l_shipdate", "yyyyMMdd"),
    )


LINEITEM_SQL = """
SELECT CAST(l_orderkey AS DECIMAL(18,0)) AS l_orderkey, CAST(l_partkey AS DECIMAL(18,0)) AS l_partkey,
       CAST(l_suppkey AS DECIMAL(18,0)) AS l_suppkey, CAST(l_linenumber AS DECIMAL(9,0)) AS l_linenumber,
       CAST(l_quantity AS DECIMAL(15,2)) AS l_quantity,
       CASE WHEN l_orderkey % 97 = 0 THEN NULL ELSE CAST(l_extendedprice AS DECIMAL(15,2)) END AS l_extendedprice,
       CAST(l_discount AS DECIMAL(15,2)) AS l_discount, CAST(l_tax AS DECIMAL(15,2)) AS l_tax,
       l_returnflag, l_linestatus, strftime(l_shipdate, '%Y%m%d') AS l_shipdate
FROM lineitem
"""
