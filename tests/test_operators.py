import time
import tracemalloc
import pyarrow as pa
import pytest
from decimal import Decimal
from pyspark.sql import functions as F

from linemend import functions as fn
from linemend.operators import catalog, checks, codes, pages, profile, registry
from linemend.operators import pages as pages_ops
from linemend.operators.registry import ColumnSpec
from linemend.operators.typed import apply_schema, read_as_strings, type_records
from linemend.plans.regions import legal_districts
from linemend.plans.verify import verify_codes
from linemend.queries import ALL
from linemend.sinks import descriptor_texts

HEADER = "서비스명\n개요\n제공기관/제공부서\n부서\n상세설명 표\n"


def descriptor(spark, *texts):
    return spark.createDataFrame([(f"d{i}", t) for i, t in enumerate(texts)], "dataset string, value string")


def test_registry(spark):
    text = HEADER + "컬럼한글명\t타입\n 관리_PK \tVARCHAR(33)\n면적\tNUMERIC(19,9)\t비고\n\tNUMERIC(5)\nx\n수\t NUMERIC(3)\n둘\tNUMERIC\n셋\tNUMERIC(19, 9)\n"
    rows = registry.build_registry(descriptor(spark, text, text.replace("컬럼한글명\t타입\n", ""))).orderBy("dataset", "ordinal").collect()
    first = [(r["ordinal"], r["column_name"], r["raw_type"], r["precision"], r["scale"]) for r in rows if r["dataset"] == "d0"]
    assert first == [
        (0, "관리_PK", "VARCHAR(33)", None, None), (1, "면적", "NUMERIC(19,9)", 19, 9), (2, "수", "NUMERIC(3)", 3, 0),
        (3, "둘", "NUMERIC", None, None), (4, "셋", "NUMERIC(19, 9)", None, None),
    ]
    assert [r["column_name"] for r in rows if r["dataset"] == "d1"] == [c[1] for c in first]


def test_column_specs(spark):
    rows = registry.build_registry(descriptor(spark, "컬럼한글명\t\na\tNUMERIC(39)\nb\tNUMERIC(38,2)\n", "컬럼한글명\t\na\tx\na\ty\n"))
    assert registry.dataset_columns(rows, "d0") == [ColumnSpec("a"), ColumnSpec("b", 38, 2)]
    assert [r["column_name"] for r in registry.oversized_columns(rows).collect()] == ["a"]
    with pytest.raises(ValueError, match="twice"):
        registry.dataset_columns(rows, "d1")
    with pytest.raises(ValueError, match="no schema"):
        registry.dataset_columns(rows, "d9")


def test_typing(spark):
    rows = spark.createDataFrame([("1|x|1.225",), ("1000000000000000516565||abc",), ("7",)], "value string")
    columns = [ColumnSpec("a", 5), ColumnSpec("b"), ColumnSpec("c", 5, 2)]
    assert [tuple(r) for r in type_records(rows, columns).collect()] == [
        (Decimal(1), "x", Decimal("1.23")), (None, None, None), (Decimal(7), None, None),
    ]


def test_ragged(spark):
    rows = spark.createDataFrame([("a|b|c",)], "value string")
    columns = [ColumnSpec("x"), ColumnSpec("y")]
    assert tuple(type_records(rows, columns, ragged="truncate").first()) == ("a", "b")
    with pytest.raises(Exception, match="more than 2 fields"):
        type_records(rows, columns).collect()
    with pytest.raises(ValueError):
        apply_schema(read_as_strings(rows), columns, ragged="other")


def test_archive_names(spark):
    names = ["국토교통부_건축물대장_총괄_표제부+(2025년+12월).zip", "국토교통부_건축물대장_기본개요+(2025년+11월).zip", "x.zip"]
    files = spark.createDataFrame([(f"/d/{n}", n, 5) for n in names], "path string, name string, size long")
    parsed = catalog.parse_archive_name(files, "2025", "12")
    schemas = spark.createDataFrame([("/s/schema_건축물대장_총괄_표제부.txt", "schema_건축물대장_총괄_표제부.txt")], "path string, name string")
    rows = catalog.catalog_rows(parsed, schemas, base="/d").collect()
    assert [(r["catalog_key"], r["dataset_name"], r["zip_path"], r["zip_size_bytes"]) for r in rows] == [
        ("건축물대장_총괄_표제부", "총괄_표제부", names[0], 5)
    ]
    assert {r["name"] for r in catalog.report_unmatched(parsed, schemas).collect()} == set(names[1:])


def test_legal_districts(spark):
    rows = [("1100000000", "서울특별시", "존재"), ("1111000000", "서울특별시 종로구", "존재"), ("1111010100", "서울특별시 종로구 청운동", "존재"),
            ("3611000000", "세종특별자치시", "존재"), ("3600000000", "세종특별자치시", "존재")]
    sgg, sido = legal_districts(spark.createDataFrame(rows, ["법정동코드", "법정동명", "폐지여부"]))
    assert sgg.columns == ["시군구코드", "시군구명", "폐지여부"] and sido.columns == ["시도코드", "시도명", "폐지여부"]
    assert sorted(r[0] for r in sgg.collect()) == ["11000", "11110", "36000", "36110"]
    assert sorted(r[0] for r in sido.collect()) == ["11", "36", "36"]


def test_verify_codes(spark):
    sheet = spark.createDataFrame(
        [
            (0, "서울특별시", "서울특별시", "11", "1100000000"), (1, "서울특별시", "강남구", "11230", "1168000000"),
            (2, "경기도", "수원시 장안구", "31011", "4111100000"), (3, "세종특별자치시", "세종특별자치시", "29010", "3611000000"),
            (4, "제주특별자치도", "제주시", "39010", "5011000001"), (5, "서울특별시", "강남구", "1123051", "1168010100"),
            (6, "서울특별시", "종로구", "11110", None), (7, "x", "y", None, "z"), (8, "x", "y", "", "z"), (9, "x", "y", "123", "z"),
        ],
        ["ord", "시도", "시군구", "행정구역분류", "법정동코드"],
    )
    report = {r["check"]: (r["value"], r["expected"], r["passed"]) for r in verify_codes(sheet, "ord").collect()}
    assert [report[level][0] for level in checks.LEVELS] == [10, 1, 5, 1, 2, 4]
    assert report["coverage"] == (9, 10, False)
    assert report["suffix_alignment"] == (2, 0, False)
    assert report["known_values"] == (3, None, True)
    assert report["code_disagreement"][0] == 5
    assert (report["Autonomous"][0], report["Non-autonomous"][0], report["Special"][0]) == (2, 2, 1)


def test_editions(spark):
    names = ["한국행정구역분류_2025.12.31.기준_1.xlsx", "한국행정구역분류_2026. 2. 1.기준_2.xlsx", "한국행정구역분류.xlsx"]
    files = spark.createDataFrame([(n, n) for n in names], "path string, name string")
    assert codes.latest_edition(files).select("name", "edition_date").collect() == [(names[1], "20260201")]
    assert [r["name"] for r in codes.undated_files(files).collect()] == names[2:]


PAGE = """<html><div id=p><div> 서비스명 </div><div>표제부 &amp; 개요 (2025년 12월)</div><div><div>제공기관/제공부서</div><p>x</p><div>국토
<br>부</div></div><!-- c --><script>var d = "<div>서비스명</div>";</script></div>
<table><tr><th>번호</th></tr></table>
<table><tr></tr><tr><th> 컬럼한글명 </th><th>타입</th></tr><tr><td>가
나</td><td><b>NUMERIC</b>(5,2)</td></tr></table></html>"""


def test_schema_page(spark):
    rows = spark.createDataFrame([(1, "u", PAGE), (2, "u", "<div>서비스명</div>"), (3, "u", None)], "page_id long, url string, html string")
    page = pages.schema_pages(rows).collect()
    assert len(page) == 1
    assert page[0]["service_name"] == "표제부 & 개요 (2025년 12월)" and page[0]["dataset_name"] == "표제부 & 개요"
    assert page[0]["provider"] == "국토\n부"
    assert page[0]["schema_rows"] == ["컬럼한글명\t타입", "가 나\tNUMERIC(5,2)"]


def test_download_buttons_pair_by_position(spark):
    html = (
        "<a onclick=\"fnDownloadPop('01','0117','OPN1')\">v</a><a onclick=\"fnLgcptPop('x','y','주택 (2025년 12월)',1)\">i</a>"
        "<a onclick=\"fnDownloadPop()\">v</a><a onclick=\"fnLgcptPop('x','y','skipped')\">i</a>"
        "<a onclick=\"fnDownloadPop(&#39;03&#39;,&#39;0301&#39;,&#39;OPN3&#39;);\">v</a>"
    )
    rows = spark.createDataFrame([(1, "u", html)], "page_id long, url string, html string")
    items = pages.download_items(rows).orderBy("button").collect()
    assert [tuple(r)[2:] for r in items] == [
        ("01", "건축인허가", "0117", "OPN1", "주택 (2025년 12월)"), ("03", "건축물대장", "0301", "OPN3", ""),
    ]


def test_clean_names(spark):
    names = {"a (2025년 12월)": "a", "a(2025년12월)": "a", "a (2025.2)": "a", "a (2024) (2025.02)": "a", "a (2025) b": "a (2025) b", " a ": "a"}
    rows = spark.createDataFrame([(n,) for n in names], "n string").select("n", fn.clean_dataset_name(F.col("n")).alias("c")).collect()
    assert {r["n"]: r["c"] for r in rows} == names


def test_lookup_reaches_the_scan(spark, tmp_path):
    spark.range(100).select(F.col("id").cast("string").alias("관리_PK"), "id").write.parquet(str(tmp_path / "d"))
    found = profile.lookup_by_key(spark.read.parquet(str(tmp_path / "d")), "관리_PK", "42")
    assert found.first()["record"] == '{"관리_PK":"42","id":42}'
    assert "EqualTo(`관리_PK`,42)" in found._jdf.queryExecution().executedPlan().toString()


def test_row_count_reads_no_columns(spark, tmp_path):
    spark.range(10).selectExpr("id", "id * 2 AS b").write.parquet(str(tmp_path / "d"))
    plan = profile.row_count(spark.read.parquet(str(tmp_path / "d")))._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<>" in plan


def test_many_buttons_in_one_page(spark):
    """10,000 buttons of each kind, in all forms of quoting: the time grows with the page."""
    forms = (
        """<a onclick="fnDownloadPop('01','{0}','&lt;O&amp;')">""", """<a ONCLICK = 'fnDownloadPop(&#x27;01&#x27;,&#39;{0}&#39;,&#39;O&#39;)'>""",
        """<a onclick=fnDownloadPop(&#39;01&#39;,&#39;{0}&#39;,&#39;O&#39;)>""",
    )
    html = "".join(forms[i % 3].format(i) + f"""<b onclick="fnLgcptPop('a','b','이름 {i}',1)"></b>""" for i in range(10_000))
    pages = spark.createDataFrame([(1, html), (2, None), (3, "no buttons"), (4, "<a onclick=\"fnDownloadPop('02','x','y')\">")], "page_id int, html string")
    begin = time.perf_counter()
    items = pages_ops.download_items(pages)
    rows = {(r["page_id"], r["button"]): r for r in items.collect()}
    assert time.perf_counter() - begin < 20
    assert len(rows) == 10_001 and rows[4, 0]["service_name"] == ""
    for i in (0, 1, 2, 9_999):
        assert (rows[1, i]["task_code"], rows[1, i]["service_name"]) == (str(i), f"이름 {i}")
    calls = pages_ops.extract_call_args(pages).count()
    assert calls == 10_001
    plan = items._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract_all") == 1 and "regexp_extract_all" not in "".join(p.split(")")[0] for p in plan.split("lambdafunction(")[1:])


def test_pairs_are_as_long_as_the_left_list(spark):
    rows = spark.sql("SELECT array(1, 2, 3) AS a, array('x') AS b UNION ALL SELECT array(1), array('x', 'y') UNION ALL SELECT array(), array('x')")
    pairs = rows.select(pages_ops.pair_by_position(F.col("a"), F.col("b")).alias("p")).collect()
    assert sorted([[(q["left"], q["right"]) for q in r["p"]] for r in pairs]) == [[], [(1, "x")], [(1, "x"), (2, None), (3, None)]]


def test_character_references(spark):
    texts = ["&#39;a&#x27;&amp;#39;", "&#0;&#1114112;&#65;&#x41;", "&#12345678;&#;&#x;", "a&lt;&gt;&quot;&apos;", "&amp;amp;", "&#128512;&#44032;x", None, ""]
    frame = spark.createDataFrame([(t,) for t in texts], "t string")
    read = [r[0] for r in frame.select(pages_ops._unescape(F.col("t"))).collect()]
    assert read == ["'a'&#39;", "&#0;&#1114112;AA", "&#12345678;&#;&#x;", "a<>\"'", "&amp;", "😀가x", None, ""]


def test_pages_are_parsed_once(spark):
    rows = spark.createDataFrame([(1, "u", PAGE)], "page_id long, url string, html string")
    plan = pages.schema_pages(rows)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") + plan.count("MapInArrow") == 1


def test_pages_are_parsed_in_parts(spark):
    """Pages of less than a part, of several parts and without markup, more than a part to a batch."""
    long = PAGE + "x" * (2 * pages.PART_BYTES)
    htmls = [PAGE + "y" * 100_000] * 25 + [long, None, "", long, PAGE]
    batch = pa.RecordBatch.from_pydict({"page_id": list(range(len(htmls))), "html": htmls})
    parts = list(pages._parts(batch))
    assert [i for part in parts for i in part.column(0).to_pylist()] == list(range(len(htmls)))
    assert all(part.num_rows == 1 or sum(len((html or "").encode()) for html in part.column(1).to_pylist()) <= pages.PART_BYTES for part in parts)
    frame = spark.createDataFrame(list(enumerate(htmls)), "page_id long, html string").coalesce(1)
    found = pages.schema_pages(frame).orderBy("page_id").collect()
    assert [r["page_id"] for r in found] == [*range(26), 28, 29]
    assert {tuple(r["schema_rows"]) for r in found} == {("컬럼한글명\t타입", "가 나\tNUMERIC(5,2)")}


def test_registry_of_pages_parses_them_once(spark):
    rows = spark.createDataFrame([(1, "c", PAGE)], "page_id long, category string, html string")
    found = registry.build_registry(descriptor_texts(pages.schema_pages(rows, keep=["category"]), "category"))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") + plan.count("MapInArrow") == 1
    assert [(r["column_name"], r["precision"], r["scale"]) for r in found.collect()] == [("가 나", 5, 2)]


def test_query_of_page_registry_parses_pages_once(spark):
    """With the filters of the query, which must not be pushed into a second parse."""
    plan = ALL["page_registry"][0](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") + plan.count("MapInArrow") == 1


def test_schema_tables_come_in_batches_of_parts(spark):
    """A batch of 40 pages of 100 KB is parsed, and handed on, in at least four parts; the rows are whole."""
    frame = spark.createDataFrame([(i, PAGE + "z" * 100_000) for i in range(40)], "page_id long, html string").coalesce(1)
    parsed = pages.parse_pages(frame)
    rows = parsed.select("page_id", F.posexplode(pages.schema_table()).alias("row_no", "row")).collect()
    assert sorted((r["page_id"], r["row_no"]) for r in rows) == [(i, j) for i in range(40) for j in range(2)]
    assert {r["row"] for r in rows} == {"컬럼한글명\t타입", "가 나\tNUMERIC(5,2)"}
    batch = pa.RecordBatch.from_pydict({"page_id": list(range(40)), "html": [PAGE + "z" * 100_000] * 40})
    parts = [part.num_rows for part in pages._parse_batches([batch], ("서비스명",))]
    assert sum(parts) == 40 and len(parts) >= 4 and max(parts) <= 10


def test_memory_of_parsing_does_not_grow_with_the_batch():
    """Python objects held for a batch of four times the pages are those of a part, not of the batch."""
    page = PAGE + "<table><tr><td>" + "z" * 10_000 + "</td></tr></table>"

    def peak(n):
        batch = pa.RecordBatch.from_pydict({"page_id": list(range(n)), "html": [page] * n})
        tracemalloc.start()
        try:
            assert sum(part.num_rows for part in pages._parse_batches([batch], ("서비스명",))) == n
            return tracemalloc.get_traced_memory()[1]
        finally:
            tracemalloc.stop()

    assert peak(2000) < 1.3 * peak(500)
