import json
import zipfile

import pytest
from pyspark.sql import functions as F

from linemend import sources
from linemend.functions import decode_codepage, undecodable
from linemend.operators import profile
from linemend.session import code_pages, settings
from linemend.sources.lines import BLOCKS_PER_PART


def plan_of(df) -> str:
    return df._jdf.queryExecution().toString()


def test_catalog_json_is_one_object(spark, tmp_path):
    entry = {"data_category": "가", "dataset_name": "나", "zip_path": "a/나.zip", "schema_path": "b.txt", "zip_size_bytes": 4204179688}
    path = tmp_path / "catalog.json"
    path.write_text(json.dumps({"가_나": entry, "가_다": {**entry, "dataset_name": "다"}}, ensure_ascii=False, indent=4) + "\n", "utf-8")
    rows = sources.read_catalog(spark, str(path)).orderBy("catalog_key").collect()
    assert [r["catalog_key"] for r in rows] == ["가_나", "가_다"]
    assert rows[0]["zip_size_bytes"] == 4204179688 and rows[1]["dataset_name"] == "다"


def test_download_list_json(spark, tmp_path):
    items = [{"cat_val": "01", "cat_name": "건축인허가", "task_code": "0117", "opn_code": "OPN2", "service_name": "주택유형 (2025년 12월)"}]
    path = tmp_path / "items.json"
    path.write_text(json.dumps(items, ensure_ascii=False, indent=2), "utf-8")
    assert sources.read_download_list(spark, str(path)).collect()[0].asDict() == items[0]


def test_inflate_first_member_only_and_cut_at_line_ends(spark, tmp_path):
    lines = [f"{n}|" + "x" * (n % 50) for n in range(5000)]
    with zipfile.ZipFile(tmp_path / "a.zip", "w", zipfile.ZIP_DEFLATED) as archive:
        archive.writestr("first.txt", "\n".join(lines))
        archive.writestr("second.txt", "other\n")
    archives = spark.createDataFrame([("a", str(tmp_path / "a.zip"))], "catalog_key string, zip_path string")
    blocks = sources.inflate_archives(archives, block_bytes=1000).orderBy("seq").collect()
    assert "".join(bytes(b["text"]).decode() for b in blocks) == "\n".join(lines) + "\n"
    assert all(bytes(b["text"]).endswith(b"\n") for b in blocks)
    assert [b["part"] for b in blocks] == [b["seq"] // BLOCKS_PER_PART for b in blocks] and blocks[-1]["part"] > 1
    head = sources.inflate_archives(archives, limit_bytes=2500, block_bytes=1000)
    text = "".join(bytes(b["text"]).decode() for b in head.orderBy("seq").collect())
    # The head ends with the last whole line within the limit.
    assert text == ("\n".join(lines))[:2500].rpartition("\n")[0] + "\n"


def test_a_line_longer_than_a_block(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as archive:
        archive.writestr("first.txt", "a|" + "x" * 5000 + "\nb|c\n")
    archives = spark.createDataFrame([("a", str(tmp_path / "a.zip"))], "catalog_key string, zip_path string")
    blocks = sources.inflate_archives(archives, block_bytes=1000).orderBy("seq").collect()
    assert "".join(bytes(b["text"]).decode() for b in blocks) == "a|" + "x" * 5000 + "\nb|c\n"


def test_pack_keeps_order_and_bounds_parts(spark):
    rows = spark.range(0, 3000, numPartitions=2).select(F.format_string("line %05d", "id").alias("value"))
    blocks = sources.pack_blocks(sources.lines_of_rows(rows, F.lit("f"), F.col("value")), 100).orderBy("part", "seq").collect()
    text = "".join(bytes(b["text"]).decode() for b in blocks)
    assert text == "".join(f"line {n:05d}\n" for n in range(3000))
    per_part = {}
    for block in blocks:
        per_part[block["part"]] = per_part.get(block["part"], 0) + 1
    assert max(per_part.values()) == BLOCKS_PER_PART


def test_codepage_table(spark, tmp_path):
    rows = ["법정동코드\t법정동명\t폐지여부", "1100000000\t서울특별시\t존재", "1111010100\t서울특별시 종로구 청운동\t존재"]
    (tmp_path / "codes.txt").write_bytes("\r\n".join(rows).encode("cp949") + b"\r\n")
    table = sources.scan_codepage_table(spark, str(tmp_path / "codes.txt"))
    assert table.columns == ["법정동코드", "법정동명", "폐지여부"]
    assert [tuple(r) for r in table.orderBy("법정동코드").collect()] == [tuple(r.split("\t")) for r in rows[1:]]


def test_decode_codepage_fails_on_wrong_bytes_or_marks_them(spark):
    frame = spark.createDataFrame([(b"\xff\xff",), ("가똠".encode("cp949"),), (None,)], "raw binary")
    with code_pages(spark):
        strict = frame.select(decode_codepage(F.col("raw"), "cp949").alias("text"))
    with pytest.raises(Exception, match="windows-949"):
        strict.collect()
    with code_pages(spark, lossy=True):
        lossy = frame.select(decode_codepage(F.col("raw"), "cp949").alias("text"))
    read = lossy.select("text", undecodable(F.col("text")).alias("lost")).collect()
    assert [r["lost"] for r in read] == [True, False, False] and read[1]["text"] == "가똠" and read[2]["text"] is None


def test_code_pages_without_python(spark, tmp_path):
    rows = ["코드\t이름", "1\t서울", "2\t종로"]
    (tmp_path / "codes.txt").write_bytes("\n".join(rows).encode("cp949") + b"\xff\n")
    table = sources.scan_codepage_table(spark, str(tmp_path / "codes.txt"), lossy=True)
    assert "Python" not in plan_of(table) and "Arrow" not in plan_of(table)
    assert {r["column_name"]: r["n"] for r in sources.undecodable_values(table).collect()} == {"코드": 0, "이름": 1}
    # The settings are those of before.
    assert spark.conf.get("spark.sql.legacy.codingErrorAction") == "false"


def test_encoding_audit(spark):
    rows = [("u", "가나다".encode()), ("u", b"abc"), ("k", "가나다".encode("cp949")), ("k", "똠".encode("cp949")), ("k", b"abc")]
    frame = spark.createDataFrame(rows, "file string, raw binary").coalesce(1)
    blocks = sources.pack_blocks(sources.lines_of_rows(frame, F.col("file"), F.col("raw")))
    audit = {(r["file"], r["encoding"]): (r["n_lines"], r["n_bad"]) for r in profile.encoding_audit(blocks).collect()}
    assert audit["u", "utf-8"] == (2, 0) and audit["k", "utf-8"] == (3, 2)
    assert audit["k", "cp949"] == (3, 0) and audit["k", "euc-kr"] == (3, 1)
    assert audit["k", "iso-8859-1"] == (3, 0)


def test_code_sheet(spark):
    sheet = spark.createDataFrame([("NA", "", "x"), ("nan", "n.a.", "y")], ["행정\n구역", "b", "c"])
    read = sources.scan_code_sheet(sheet, 2)
    assert read.columns == ["행정 구역", "b"]
    assert [tuple(r) for r in read.collect()] == [(None, ""), (None, "n.a.")]
    with pytest.raises(ValueError, match="needed"):
        sources.scan_code_sheet(sheet, 12)


def test_head_of_an_archive_reads_no_further(spark, tmp_path):
    """The tail of the archive is damaged: its head can be read, all of it can't."""
    noise = "\n".join(f"{i}|{hash((i, 'x')) & 0xFFFFFFFFFFFF}" for i in range(200_000)) + "\n"
    path = tmp_path / "a.zip"
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as archive:
        archive.writestr("first.txt", noise)
    raw = bytearray(path.read_bytes())
    middle = len(raw) // 2
    raw[middle : middle + 1000] = b"\0" * 1000
    path.write_bytes(bytes(raw))
    archives = spark.createDataFrame([("a", str(path)), ("b", str(path))], "catalog_key string, zip_path string")
    head = sources.sample_head(spark, archives, 2, block_bytes=10_000)
    blocks = head.orderBy("file", "seq").collect()
    assert [(r["file"], r["seq"]) for r in blocks] == [("a", 0), ("a", 1), ("b", 0), ("b", 1)]
    assert noise.encode().startswith(bytes(blocks[0]["text"]) + bytes(blocks[1]["text"]))
    with pytest.raises(Exception, match="(?i)crc|zlib|error"):
        sources.scan_archives(spark, archives, block_bytes=10_000).count()


def test_archives_scan_whole_and_empty(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as archive:
        archive.writestr("first.txt", "a|1\nb|2")
    archives = spark.createDataFrame([("a", str(tmp_path / "a.zip"))], "catalog_key string, zip_path string")
    assert [bytes(r["text"]) for r in sources.scan_archives(spark, archives, block_bytes=4).orderBy("seq").collect()] == [b"a|1\n", b"b|2\n"]
    assert sources.scan_archives(spark, archives.limit(0)).count() == 0


def test_line_files_are_read_in_splits(spark, tmp_path):
    """Objects one to a line are rows of many tasks, next to an array and an object over many lines."""
    item = {"cat_val": "01", "cat_name": "가", "task_code": "t", "opn_code": "o", "service_name": "이름"}
    (tmp_path / "lines.json").write_text("".join(json.dumps({**item, "opn_code": str(i)}) + "\n" for i in range(3000)), "utf-8")
    (tmp_path / "array.json").write_text(json.dumps([{**item, "opn_code": "x"}, {**item, "opn_code": "y"}], indent=1), "utf-8")
    (tmp_path / "one.json").write_text("\n" + json.dumps([{**item, "opn_code": "z"}]) + "\n\n", "utf-8")
    (tmp_path / "none.json").write_text("", "utf-8")
    with settings(spark, spark__sql__files__maxPartitionBytes="20000", spark__sql__files__openCostInBytes="0"):
        items = sources.read_download_list(spark, str(tmp_path))
        assert items.rdd.getNumPartitions() > 10
        assert sorted(r["opn_code"] for r in items.collect()) == sorted([*map(str, range(3000)), "x", "y", "z"])


def test_counts_come_from_footers(spark, tmp_path):
    spark.range(1000).select("id", F.lit("x").alias("text")).write.parquet(str(tmp_path / "t"))
    table = sources.scan_footers(spark, str(tmp_path / "t"))
    counted = profile.row_count(table)
    assert "PushedAggregation: [COUNT(*)]" in plan_of(counted) and counted.first()["n_rows"] == 1000
    rows = profile.profile_all({"t": sources.scan_parquet(spark, str(tmp_path / "t")), "none": None}, counted={"t": table})
    assert "PushedAggregation: [COUNT(*)]" in plan_of(rows)
    assert [(r["dataset"], r["n_rows"], r["message"]) for r in rows.collect()] == [("none", None, profile.MISSING), ("t", 1000, None)]


def test_sheets_are_read_in_one_scan(spark, tmp_path):
    for name, head in (("a.csv", "시도,코드"), ("b.csv", "시도,코드")):
        (tmp_path / name).write_text(f'title,\n{head}\n"가,\n나",1\n{name},\n', "utf-8")
    sheet = sources.read_code_sheets(spark, str(tmp_path), n_columns=2)
    assert plan_of(sheet).split("== Physical Plan ==")[1].count("FileScan csv") == 1
    assert sheet.columns == ["시도", "코드", "path"]
    assert sorted((r["시도"], r["코드"]) for r in sheet.collect()) == [("a.csv", ""), ("b.csv", ""), ("가,\n나", "1"), ("가,\n나", "1")]
    (tmp_path / "b.csv").write_text("title,\n시도,다른\nx,1\n", "utf-8")
    with pytest.raises(Exception, match="다른"):
        sources.read_code_sheets(spark, str(tmp_path), n_columns=2).collect()
    (tmp_path / "c").mkdir()
    (tmp_path / "c" / "short.csv").write_text("title,\n", "utf-8")
    with pytest.raises(ValueError, match="no header"):
        sources.read_code_sheets(spark, str(tmp_path / "c"), n_columns=2)
