"""Line checks and record repair on documents written as pipe text."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import decode_utf8_lossy, separator_count
from ..operators import repair
from ..operators.typed import type_records
from ..session import work_dir
from ..sources import lines_of_rows, pack_blocks, scan_lines
from .tables import (
    DOCUMENT_COLUMNS,
    DOCUMENT_SEPARATORS,
    DOCUMENT_SQL,
    document_blocks,
    document_lines,
    document_text,
    ordered_document_blocks,
    table,
)

E = DOCUMENT_SEPARATORS

LINES_SQL = f"""
lines AS (
  SELECT source AS file, doc_id, unnest(string_split({DOCUMENT_SQL}, chr(10))) AS value,
         generate_subscripts(string_split({DOCUMENT_SQL}, chr(10)), 1) - 1 AS line_no
  FROM documents
), counted AS (
  SELECT *, CAST(length(value) - length(replace(value, '|', '')) AS BIGINT) AS separators FROM lines
)"""

# The rule itself, one line at a time and all files side by side.
SEQUENTIAL_SQL = f"""
WITH RECURSIVE {LINES_SQL}, numbered AS MATERIALIZED (
  SELECT file, value, separators AS k, row_number() OVER (PARTITION BY file ORDER BY doc_id, line_no) AS n FROM counted
), run AS (
  SELECT DISTINCT file, CAST(0 AS BIGINT) AS n, '' AS buf, CAST(0 AS BIGINT) AS cnt, CAST(0 AS BIGINT) AS first_k,
         CAST(0 AS BIGINT) AS n_lines, CAST(NULL AS VARCHAR) AS done, CAST(NULL AS BIGINT) AS total, false AS suspect
  FROM numbered
  UNION ALL
  SELECT file, n, CASE WHEN t >= {E} THEN '' ELSE joined END, CASE WHEN t >= {E} THEN 0 ELSE t END, fk, nl,
         CASE WHEN t >= {E} THEN joined END, CASE WHEN t >= {E} THEN t END, fk = 0 AND nl > 1
  FROM (
    SELECT l.file, l.n, CASE WHEN r.buf = '' THEN l.value ELSE r.buf || ' ' || l.value END AS joined,
           CASE WHEN r.buf = '' THEN l.k ELSE r.cnt + l.k END AS t,
           CASE WHEN r.buf = '' THEN l.k ELSE r.first_k END AS fk,
           CASE WHEN r.buf = '' THEN 1 ELSE r.n_lines + 1 END AS nl
    FROM run r JOIN numbered l ON l.file = r.file AND l.n = r.n + 1
  )
), outcomes AS (
  SELECT file, done AS value, total AS separators, CASE WHEN total > {E} THEN 'overflow' ELSE 'record' END AS status, suspect
  FROM run WHERE done IS NOT NULL
  UNION ALL
  SELECT file, buf, cnt, 'short', first_k = 0 AND n_lines > 1 FROM run
  WHERE buf <> '' AND (file, n) IN (SELECT (file, max(n)) FROM numbered GROUP BY file)
)"""


def repair_documents(spark, folder):
    outcome = repair.repair_blocks(document_blocks(spark, folder), E)
    return type_records(repair.kept_records(outcome), DOCUMENT_COLUMNS)


def repair_text_files(spark, folder):
    """The documents written as text files and read in splits."""
    path = work_dir(spark, "text")
    table(spark, folder, "documents").select(document_text(True)).write.option("lineSep", "\n").text(path)
    outcome = repair.repair_blocks(pack_blocks(scan_lines(spark, path)), E)
    return type_records(repair.kept_records(outcome), DOCUMENT_COLUMNS)


def _outcome(spark, folder):
    return repair.repair_blocks(ordered_document_blocks(spark, folder), E)


def reject_overflow(spark, folder):
    return repair.reject_overflow(_outcome(spark, folder)).select("file", "value", F.col("separators").cast("long").alias("separators"), "reason")


def outcome_counts(spark, folder):
    return _outcome(spark, folder).groupBy("file", "status").agg(
        F.count("*").alias("n"), F.count_if("suspect").alias("n_suspect"), F.sum(F.length("value").cast("long")).alias("n_chars")
    )


def suspect_records(spark, folder):
    return _outcome(spark, folder).filter("suspect").select("file", "status", "value")


def flush_tail(spark, folder):
    """The last document of each source lacks its last field."""
    docs = table(spark, folder, "documents")
    last = docs.groupBy("source").agg(F.max("doc_id").alias("last_id"))
    cut = F.when(F.col("doc_id") == F.col("last_id"), F.regexp_replace(document_text(True), r"\|\d+\z", "")).otherwise(document_text(True))
    rows = docs.join(last, "source").select("source", "doc_id", cut.alias("line"))
    ordered = rows.repartitionByRange("source", "doc_id").sortWithinPartitions("source", "doc_id")
    outcome = repair.repair_blocks(pack_blocks(lines_of_rows(ordered, F.col("source"), F.col("line"))), E)
    typed = type_records(repair.kept_records(outcome), DOCUMENT_COLUMNS, keep=["status"])
    return typed.select("status", "doc_id", "lang", "source", F.length("text").cast("long").alias("text_length"), "n_chars")


def unfit_files(spark, folder):
    """A file for each language; the one of English has another separator than the schema says."""
    docs = table(spark, folder, "documents")
    line = F.when(F.col("lang") == "en", F.translate(document_text(True), "|", "~")).otherwise(document_text(True))
    rows = docs.select("lang", "doc_id", line.alias("line")).repartitionByRange("lang", "doc_id").sortWithinPartitions("lang", "doc_id")
    outcome = repair.repair_blocks(pack_blocks(lines_of_rows(rows, F.col("lang"), F.col("line"))), E)
    return repair.reject_overflow(outcome).select("file", "value", "reason")


def separators(spark, folder):
    lines = document_lines(spark, folder)
    return lines.select(
        F.col("part").alias("doc_id"), F.col("id").cast("long").alias("line_no"), separator_count(F.col("value")).cast("long").alias("separators")
    )


def expected_separators(spark, folder):
    return repair.expected_separators(document_lines(spark, folder))


def bad_lines(spark, folder):
    bad = repair.detect_bad_lines(document_lines(spark, folder), E)
    return bad.select("file", F.col("part").alias("doc_id"), F.col("id").cast("long").alias("line_no"), "value")


def first_bad_lines(spark, folder):
    first = repair.first_bad_lines(document_lines(spark, folder), E)
    return first.select("file", F.col("part").alias("doc_id"), F.col("id").cast("long").alias("line_no"), "value", F.col("separators").cast("long").alias("separators"))


def file_status(spark, folder):
    return repair.file_status(document_lines(spark, folder), E)


def _routed(spark, folder):
    lines = document_lines(spark, folder, file="doc_id")
    return repair.route_clean_or_repair(lines, repair.file_status(lines, E))


def route_clean(spark, folder):
    """Each document is a file of its own."""
    return _routed(spark, folder)[0].select("file", "value")


def route_repair(spark, folder):
    return _routed(spark, folder)[1].select("file", F.col("id").cast("long").alias("line_no"), "value")


def lossy_decode(spark, folder):
    docs = table(spark, folder, "documents")
    raw = F.concat(F.encode("text", "UTF-8"), F.lit(b"\xff\xc3"), F.encode("lang", "UTF-8"))
    return docs.select(
        "doc_id", decode_utf8_lossy(raw).alias("text"), F.is_valid_utf8(raw.cast("string")).alias("was_valid")
    )


def line_endings(spark, folder):
    """Conversations with Windows line ends: one carriage return per line is dropped."""
    rows = table(spark, folder, "conversations")
    line = F.concat(F.concat_ws("|", F.col("conv_id").cast("string"), F.col("turn").cast("string"), F.translate("text", "|\n", "/ ")), F.lit("\r"))
    outcome = repair.repair_blocks(pack_blocks(lines_of_rows(rows, F.lit("conversations"), line)), 2)
    return outcome.select("value", "status")


DOCUMENTS_SQL = """
SELECT CAST(doc_id AS DECIMAL(18,0)) AS doc_id, lang, source, replace(replace(text, '|', '/'), chr(10), ' ') AS text,
       CAST(n_chars AS DECIMAL(9,0)) AS n_chars
FROM documents
"""

ROUTE_CLEAN_SQL = f"""SELECT CAST(doc_id AS VARCHAR) AS file, {DOCUMENT_SQL} AS value FROM documents
        WHERE NOT contains(text, chr(10)) AND NOT contains(text, '|')"""

ROUTE_REPAIR_SQL = f"""WITH {LINES_SQL} SELECT CAST(doc_id AS VARCHAR) AS file, line_no, value FROM counted
        WHERE doc_id IN (SELECT doc_id FROM counted WHERE separators <> {E})"""

QUERIES = {
    "repair_documents": (repair_documents, DOCUMENTS_SQL),
    "repair_text_files": (repair_text_files, DOCUMENTS_SQL),
    "reject_overflow": (
        reject_overflow,
        SEQUENTIAL_SQL + "SELECT file, value, separators, 'more separators than the schema allows' AS reason FROM outcomes WHERE status = 'overflow'",
    ),
    "outcome_counts": (
        outcome_counts,
        SEQUENTIAL_SQL + """SELECT file, status, count(*) AS n, count(*) FILTER (suspect) AS n_suspect,
        CAST(sum(length(value)) AS BIGINT) AS n_chars FROM outcomes GROUP BY file, status""",
    ),
    "suspect_records": (suspect_records, SEQUENTIAL_SQL + "SELECT file, status, value FROM outcomes WHERE suspect"),
    "flush_tail": (
        flush_tail,
        """SELECT CASE WHEN doc_id = last_id THEN 'short' ELSE 'record' END AS status, CAST(doc_id AS DECIMAL(18,0)) AS doc_id,
        lang, source, length(text) AS text_length,
        CASE WHEN doc_id = last_id THEN NULL ELSE CAST(n_chars AS DECIMAL(9,0)) END AS n_chars
        FROM (SELECT *, max(doc_id) OVER (PARTITION BY source) AS last_id FROM documents)""",
    ),
    "unfit_files": (
        unfit_files,
        """SELECT file, value, 'schema does not fit' AS reason FROM (
        SELECT lang AS file, unnest(string_split(concat_ws('~', doc_id, lang, source, replace(text, '|', '/'), n_chars), chr(10))) AS value
        FROM documents WHERE lang = 'en') WHERE value <> ''""",
    ),
    "separator_count": (separators, f"WITH {LINES_SQL} SELECT doc_id, line_no, separators FROM counted"),
    "expected_separators": (
        expected_separators,
        f"WITH {LINES_SQL} SELECT file, arg_min(separators, doc_id * 1000000 + line_no) AS expected FROM counted GROUP BY file",
    ),
    "detect_bad_lines": (bad_lines, f"WITH {LINES_SQL} SELECT file, doc_id, line_no, value FROM counted WHERE separators <> {E}"),
    "first_bad_lines": (
        first_bad_lines,
        f"""WITH {LINES_SQL} SELECT file, doc_id, line_no, value, separators FROM (
        SELECT *, row_number() OVER (PARTITION BY file ORDER BY doc_id, line_no) AS rn FROM counted WHERE separators <> {E}) WHERE rn = 1""",
    ),
    "file_status": (
        file_status,
        f"""WITH {LINES_SQL} SELECT file, count(*) AS n_lines, count(*) FILTER (separators <> {E}) AS n_bad,
        count(*) FILTER (separators <> {E}) = 0 AS clean FROM counted GROUP BY file""",
    ),
    "route_clean": (route_clean, ROUTE_CLEAN_SQL),
    "route_clean_frame": (route_clean, ROUTE_CLEAN_SQL),
    "route_repair": (route_repair, ROUTE_REPAIR_SQL),
    "route_repair_frame": (route_repair, ROUTE_REPAIR_SQL),
    "decode_utf8_lossy": (
        lossy_decode, "SELECT doc_id, text || chr(65533) || chr(65533) || lang AS text, false AS was_valid FROM documents"
    ),
    "line_endings": (
        line_endings,
        """SELECT conv_id || '|' || turn || '|' || replace(replace(text, '|', '/'), chr(10), ' ') AS value, 'record' AS status
        FROM conversations""",
    ),
}
