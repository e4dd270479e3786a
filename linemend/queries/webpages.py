"""Page extraction, on the captured pages and on pages written from documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import (
    DESCRIBE_CALL,
    DOWNLOAD_CALL,
    HEADER_MARKER,
    PROVIDER_LABEL,
    SERVICE_LABEL,
    category_lookup,
    clean_dataset_name,
    search_text,
    window_end,
    window_start,
)
from ..operators import pages as ops
from ..operators.registry import build_registry
from ..session import work_dir
from ..sinks import descriptor_texts, write_schema_descriptors
from ..sources import accumulate_pages, scan_pages, scan_schema_descriptors
from .tables import table

LINK = r'<a href="/([^"]*)">([^<]*)</a>'


def _pages(spark, folder):
    return scan_pages(spark, f"{folder}/pages.parquet")


def page_links(spark, folder):
    """Every link of the captured pages turned into a call."""
    html = F.regexp_replace("html", LINK, f"<a class=x onclick=\"{DOWNLOAD_CALL}('01','/$1',&#39;$2&#39;)\">$2</a>")
    return ops.extract_call_args(_pages(spark, folder).withColumn("html", html))


def download_items(spark, folder):
    """Every link turned into a download and a description button; links to short words
    get a download button without a call in it, to words of three letters buttons in single
    quotes, to words of four buttons without quotes."""
    buttons = (
        f"<button onclick=\"{DOWNLOAD_CALL}('01','$1','OPN')\">v</button>"
        f"<button onclick=\"{DESCRIBE_CALL}('a','b','$2',1)\">i</button>"
    )
    html = F.regexp_replace("html", r'<a href="/(\w{1,2})">([^<]*)</a>', f'<a onclick="{DOWNLOAD_CALL}()"></a><a onclick="{DESCRIBE_CALL}()"></a>')
    single = buttons.replace("'", "&#x27;").replace('"', "'")
    bare = buttons.replace("'", "&#39;").replace('"', "")
    for letters, form in (("3", single), ("4", bare)):
        html = F.regexp_replace(html, rf'<a href="/(\w{{{letters}}})">(\w*)</a>', form)
    return ops.download_items(_pages(spark, folder).withColumn("html", F.regexp_replace(html, LINK, buttons)))


def page_labels(spark, folder):
    """The advertisement div of each captured page, with a label div put before it."""
    html = F.regexp_replace("html", '<div class="ad">', f'<div>\n{SERVICE_LABEL} </div><div class="ad">')
    parsed = ops.parse_pages(_pages(spark, folder).withColumn("html", html))
    return parsed.select(
        "page_id", ops.labelled_value(parsed, SERVICE_LABEL).alias("service_name"), ops.labelled_value(parsed, PROVIDER_LABEL).alias("provider")
    )


def _escaped(col):
    return F.replace(F.replace(F.col(col), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))


def _schema_pages(spark, folder):
    """A page per document: name and provider, a table that does not count, a schema table.

    Documents of the first label value have no name, so their pages are incomplete.
    """
    docs = table(spark, folder, "documents")
    name = F.when(F.col("lang") == "de", "").otherwise(F.concat("source", F.lit(" (2025년 12월)")))
    html = F.concat(
        F.lit(f"<html><body><div class=p><div>{SERVICE_LABEL}</div><div><b>"), name, F.lit("</b></div>"),
        F.lit(f"<div>{PROVIDER_LABEL}</div><div>"), F.col("lang"), F.lit("<br>팀<script>var x = 1;</script></div>"),
        F.lit("<table><tr><th>번호</th></tr><tr><td>1</td></tr></table>"),
        F.lit(f"<table><tr></tr><tr><th>{HEADER_MARKER}</th><th>데이터타입</th></tr>"),
        F.lit("<tr><td>글</td><td>"), _escaped("text"), F.lit("</td></tr>"),
        F.lit("<tr><td> 길이 </td><td>NUMERIC("), F.col("n_chars").cast("string"), F.lit(")</td></tr></table></div></body></html>"),
    )
    return docs.select(F.col("doc_id").alias("page_id"), F.lit("http://example.org/").alias("url"), html.alias("html"), "lang")


def schema_tables(spark, folder):
    rows = ops.parse_pages(_schema_pages(spark, folder)).select("page_id", F.posexplode(ops.schema_table()).alias("row_no", "row"))
    return rows.withColumn("row_no", F.col("row_no").cast("long"))


def complete_pages(spark, folder):
    rows = ops.schema_pages(_schema_pages(spark, folder), keep=["lang"])
    return rows.select("page_id", "service_name", "provider", "dataset_name", F.size("schema_rows").cast("long").alias("n_rows"))


def page_registry(spark, folder):
    """Pages to descriptors to registry rows."""
    pages = ops.schema_pages(_schema_pages(spark, folder).withColumn("category", F.concat(F.lit("c"), F.col("page_id").cast("string"))), keep=["category"])
    rows = build_registry(descriptor_texts(pages, "category"))
    return rows.filter("precision IS NOT NULL").select("dataset", "ordinal", "column_name", "precision", "scale")


def written_descriptors(spark, folder):
    """Descriptor texts per nation of suppliers, written and read back."""
    rows = table(spark, folder, "nation").select(
        F.col("n_name").alias("service_name"), F.col("n_name").alias("provider"), F.col("n_name").alias("dataset_name"),
        F.col("n_regionkey").cast("string").alias("category"),
        F.array(F.lit(f"{HEADER_MARKER}\t데이터타입"), F.concat("n_name", F.lit("\tNUMERIC("), F.col("n_nationkey").cast("string"), F.lit(",0)"))).alias("schema_rows"),
    )
    path = work_dir(spark, "descriptors")
    write_schema_descriptors(descriptor_texts(rows, "category"), path)
    return build_registry(scan_schema_descriptors(spark, path))


def accumulated(spark, folder):
    """Captured pages and document pages as one table."""
    both = accumulate_pages(_pages(spark, folder), _schema_pages(spark, folder).drop("lang"))
    return both.select("page_id", F.length("url").cast("long").alias("url_length"))


def clean_names(spark, folder):
    """Names with a date suffix of each form, and one that only looks like one."""
    part = table(spark, folder, "part")
    suffix = (
        F.when(F.col("p_size") % 5 == 0, " (2025년 12월)").when(F.col("p_size") % 5 == 1, "(2025.1) ")
        .when(F.col("p_size") % 5 == 2, "  (2024) (2025.02)").when(F.col("p_size") % 5 == 3, " (2025) a").otherwise("")
    )
    return part.select("p_partkey", clean_dataset_name(F.concat("p_name", suffix)).alias("name"))


def target_window(spark, folder):
    orders = table(spark, folder, "orders")
    year, month = F.year("o_orderdate"), F.month("o_orderdate")
    return orders.select(
        "o_orderkey", window_start(year, month).alias("first_day"), window_end(year, month).alias("last_day"),
        search_text(year, month, False).alias("plain"), search_text(year, month, True).alias("padded"),
    )


def categories(spark, folder):
    code = F.lpad((F.col("p_size") % 5).cast("string"), 2, "0")
    return table(spark, folder, "part").select("p_partkey", category_lookup(code).alias("category"))


LINKS_SQL = """
links AS (
  SELECT page_id, unnest(regexp_extract_all(html, '<a href="/([^"]*)">([^<]*)</a>', 1)) AS target,
         unnest(regexp_extract_all(html, '<a href="/([^"]*)">([^<]*)</a>', 2)) AS label,
         generate_subscripts(regexp_extract_all(html, '<a href="/([^"]*)">([^<]*)</a>', 1), 1) - 1 AS button
  FROM pages
)"""

QUERIES = {
    "extract_call_args": (
        page_links,
        f"WITH {LINKS_SQL} SELECT page_id, CAST(button AS INTEGER) AS button, '01' AS arg1, '/' || target AS arg2, label AS arg3 FROM links",
    ),
    "download_items": (
        download_items,
        f"""WITH {LINKS_SQL} SELECT page_id, CAST(button AS INTEGER) AS button, '01' AS cat_val, '건축인허가' AS cat_name, target AS task_code,
        'OPN' AS opn_code, label AS service_name FROM links WHERE NOT regexp_full_match(target, '[A-Za-z0-9_]{{1,2}}')""",
    ),
    "labelled_value": (
        page_labels,
        """SELECT page_id, trim(regexp_extract(html, '<div class="ad">([^<]*)</div>', 1)) AS service_name, '' AS provider FROM pages""",
    ),
    "schema_table": (
        schema_tables,
        f"""SELECT doc_id AS page_id, CAST(0 AS BIGINT) AS row_no, '{HEADER_MARKER}' || chr(9) || '데이터타입' AS row FROM documents
        UNION ALL SELECT doc_id, 1, '글' || chr(9) || replace(text, chr(10), ' ') FROM documents
        UNION ALL SELECT doc_id, 2, '길이' || chr(9) || 'NUMERIC(' || n_chars || ')' FROM documents""",
    ),
    "schema_pages": (
        complete_pages,
        """SELECT doc_id AS page_id, source || ' (2025년 12월)' AS service_name, lang || '팀' AS provider, source AS dataset_name,
        CAST(3 AS BIGINT) AS n_rows FROM documents WHERE lang <> 'de'""",
    ),
    "page_registry": (
        page_registry,
        """SELECT 'c' || doc_id || '_' || source AS dataset, 1 AS ordinal, '길이' AS column_name, CAST(n_chars AS INTEGER) AS precision, 0 AS scale
        FROM documents WHERE lang <> 'de'""",
    ),
    "write_schema_descriptors": (
        written_descriptors,
        """SELECT n_regionkey || '_' || n_name AS dataset, 0 AS ordinal, n_name AS column_name, 'NUMERIC(' || n_nationkey || ',0)' AS raw_type,
        n_nationkey AS precision, 0 AS scale FROM nation""",
    ),
    "accumulate_pages": (
        accumulated, "SELECT page_id, length(url) AS url_length FROM pages UNION ALL SELECT doc_id, 19 FROM documents"
    ),
    "clean_dataset_name": (
        clean_names,
        """SELECT p_partkey, p_name || CASE p_size % 5 WHEN 1 THEN '(2025.1)' WHEN 3 THEN ' (2025) a' ELSE '' END AS name FROM part""",
    ),
    "target_window": (
        target_window,
        """SELECT o_orderkey, strftime(date_trunc('month', o_orderdate), '%Y%m%d') AS first_day,
        strftime(date_trunc('month', o_orderdate) + INTERVAL 3 MONTH, '%Y%m%d') AS last_day,
        year(o_orderdate) || '년 ' || month(o_orderdate) || '월' AS plain,
        strftime(o_orderdate, '%Y년 %m월') AS padded FROM orders""",
    ),
    "category_lookup": (
        categories,
        """SELECT p_partkey, CASE p_size % 5 WHEN 1 THEN '건축인허가' WHEN 2 THEN '주택인허가' WHEN 3 THEN '건축물대장' END AS category FROM part""",
    ),
}
