import zipfile
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from linemend.operators.registry import ColumnSpec, build_registry, dataset_columns
from linemend.plans.catalog import build_catalog
from linemend.plans.convert import analyze_head, convert_catalog, convert_text_files, file_verdicts, route_files
from linemend.plans.regions import write_legal_districts, write_statistical_districts

from linemend.sinks import finished, read_csv_bom, read_manifests, write_catalog, write_csv_bom, write_dataset, write_download_list, write_schema_descriptors
from linemend.session import settings
from linemend.sources import read_catalog, read_download_list, scan_schema_descriptors

SCHEMA = "서비스명\nx\n제공기관/제공부서\ny\n상세설명 표\n컬럼한글명\t타입\n관리_PK\tVARCHAR(10)\n이름\tVARCHAR(10)\n면적\tNUMERIC(5,2)\n"


@pytest.fixture()
def dump(tmp_path):
    (tmp_path / "original").mkdir()
    (tmp_path / "schema").mkdir()

    def add(name, content, month="12", schema=True):
        path = tmp_path / "original" / f"국토교통부_건축물대장_{name}+(2025년+{month}월).zip"
        if content is None:
            path.write_bytes(b"not a zip")
        else:
            with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as archive:
                archive.writestr("mart.txt", content)
        if schema:
            (tmp_path / "schema" / f"schema_건축물대장_{name}.txt").write_text(SCHEMA, "utf-8")

    add("표제부", '1|"나"동|1.5\r\n2|가\r\n나|x\r\n3|a|b|c\r\n4||9999\r\n5|끝')
    add("깨짐", None)
    add("무스키마", "1|2|3\n", schema=False)
    add("지난달", "1|2|3\n", month="11")
    return tmp_path


def test_archives_to_parquet(spark, dump):
    catalog, issues = build_catalog(spark, str(dump / "original"), str(dump / "schema"), "2025", "12", base=str(dump))
    rows = {r["catalog_key"]: r for r in catalog.collect()}
    assert set(rows) == {"건축물대장_표제부", "건축물대장_깨짐"}
    assert rows["건축물대장_표제부"]["zip_path"] == "original/국토교통부_건축물대장_표제부+(2025년+12월).zip"
    assert {r["issue"] for r in issues.collect()} == {"schema not found", "unexpected name"}

    registry = build_registry(scan_schema_descriptors(spark, str(dump / "schema")))
    out = str(dump / "parquet")
    status = {r["catalog_key"]: r for r in convert_catalog(spark, catalog, registry, out, base=str(dump)).collect()}
    good, bad = status["건축물대장_표제부"], status["건축물대장_깨짐"]
    assert (good["status"], good["rows_out"], good["short"], good["rejected"]) == ("converted", 4, 1, 1)
    assert good["cast_nulls"] == {"면적": 2} and good["first_line_separators"] == 2
    assert bad["status"] == "failed" and "zip" in bad["error"]

    table = spark.read.parquet(f"{out}/건축물대장_표제부")
    assert table.columns == ["관리_PK", "이름", "면적"]
    assert sorted(tuple(r) for r in table.collect()) == [
        ("1", '"나"동', Decimal("1.50")), ("2", "가 나", None), ("4", None, None), ("5", "끝", None),
    ]
    assert [r["value"] for r in spark.read.parquet(f"{out}/_rejects/건축물대장_표제부").collect()] == ["3|a|b|c"]

    again = {r["catalog_key"]: r for r in convert_catalog(spark, catalog, registry, out, base=str(dump)).collect()}
    assert {key: r["status"] for key, r in again.items()} == {"건축물대장_표제부": "skipped", "건축물대장_깨짐": "failed"}
    # What is skipped tells the counts of the run that made it.
    assert again["건축물대장_표제부"].asDict() == {**good.asDict(), "status": "skipped"}


def test_data_without_a_manifest_is_made_again(spark, dump):
    """The run ended between the data and the manifest, or the manifest was half written."""
    catalog, _ = build_catalog(spark, str(dump / "original"), str(dump / "schema"), "2025", "12")
    catalog = catalog.filter("catalog_key = '건축물대장_표제부'")
    registry = build_registry(scan_schema_descriptors(spark, str(dump / "schema")))
    out = dump / "parquet"
    first = convert_catalog(spark, catalog, registry, str(out)).collect()
    (out / "_manifests" / "건축물대장_표제부" / "_SUCCESS").unlink()
    assert finished(spark, str(out / "건축물대장_표제부"))
    assert convert_catalog(spark, catalog, registry, str(out)).collect() == first
    manifest = read_manifests(spark, str(out), ["건축물대장_표제부"]).first()
    assert spark.read.parquet(manifest["data"]).count() == manifest["rows_out"] == 4
    assert spark.read.parquet(manifest["rejects"]).count() == manifest["rejected"] == 1
    assert read_manifests(spark, str(out), []).count() == 0


def test_files_are_routed_without_an_exchange(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "clean.txt").write_text("1|a\n2|b\n")
    (tmp_path / "in" / "broken.txt").write_text("3|c\nd\n")
    clean, broken = route_files(spark, str(tmp_path / "in"), 1)
    assert sorted(r["value"] for r in clean.collect()) == ["1|a", "2|b"] and sorted(r["value"] for r in broken.collect()) == ["3|c", "d"]
    for side in (clean, broken):
        plan = side._jdf.queryExecution().toString()
        assert "Exchange" not in plan and "Join" not in plan
    assert [side.count() for side in route_files(spark, str(tmp_path / "in" / "clean.txt"), 1)] == [2, 0]


def test_reading_stops_at_the_first_bad_line(spark, tmp_path):
    lines = [f"{i}|{'x' * 90}" for i in range(20_000)]
    (tmp_path / "late.txt").write_text("\n".join([*lines, "bad"]))
    (tmp_path / "early.txt").write_text("\n".join([*lines[:10], "bad", *lines]))
    (tmp_path / "clean.txt").write_text("\n".join(lines))

    def tasks(name):
        context, tracker = spark.sparkContext, spark.sparkContext.statusTracker()
        context.setJobGroup(name, name)
        told = file_verdicts(spark, [str(tmp_path / f"{name}.txt")], 1, workers=1).first()["clean"]
        # The threads of the pool inherit no group: all jobs since the last look are counted.
        jobs = [j for g in (None, name) for j in tracker.getJobIdsForGroup(g)]
        new = [j for j in jobs if j not in seen]
        seen.update(new)
        stages = [tracker.getStageInfo(s) for j in new for s in tracker.getJobInfo(j).stageIds]
        return told, sum(stage.numTasks for stage in stages if stage is not None)

    seen = set()
    with settings(spark, spark__sql__files__maxPartitionBytes="20000", spark__sql__files__openCostInBytes="0"):
        tasks("clean")
        (early, few), (late, many), (clean, all_) = tasks("early"), tasks("late"), tasks("clean")
    assert (early, late, clean) == (False, False, True)
    assert few < many and few < all_ / 4


def test_head_of_an_archive(spark, dump):
    registry = build_registry(scan_schema_descriptors(spark, str(dump / "schema")))
    archives = spark.createDataFrame(
        [("건축물대장_표제부", str(dump / "original" / "국토교통부_건축물대장_표제부+(2025년+12월).zip"))], "catalog_key string, zip_path string"
    )
    columns = dataset_columns(registry, "건축물대장_표제부")
    assert [r["관리_PK"] for r in analyze_head(archives, columns, None).collect()] == ["1", "2", "나", "3", "4", "5"]


def test_head_smaller_than_the_archive_ends_with_a_whole_line(spark, tmp_path):
    lines = [f"{i}|name {i}|1" for i in range(200)]
    path = tmp_path / "a.zip"
    with zipfile.ZipFile(path, "w") as archive:
        archive.writestr("a.txt", "\n".join(lines) + "\n")
    archives = spark.createDataFrame([("a", str(path))], "catalog_key string, zip_path string")
    columns = (ColumnSpec("id", 9), ColumnSpec("name"), ColumnSpec("n", 9))
    limit = len("\n".join(lines[:50])) + 4
    assert [int(r["id"]) for r in analyze_head(archives, columns, limit).collect()] == list(range(50))


def test_files_are_routed_by_their_lines(spark, tmp_path):
    columns = (ColumnSpec("id", 9), ColumnSpec("name"), ColumnSpec("n", 9))
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "clean.txt").write_bytes(b"1|a|1\r\n2||2\r\n")
    (tmp_path / "in" / "broken.txt").write_bytes(b"3|a\nb|3\n4|x|4\n5|y|5|6\n")
    out = str(tmp_path / "out")
    counts = convert_text_files(spark, str(tmp_path / "in"), columns, out, "k")
    assert (counts["rows_in"], counts["rows_out"], counts["rejected"], counts["clean_files"]) == (5, 4, 1, 1)
    assert [name.rsplit("/", 1)[1] for name in counts["first_line_separators"]] == ["broken.txt"]
    assert sorted(map(tuple, spark.read.parquet(f"{out}/k").collect())) == [(1, "a", 1), (2, None, 2), (3, "a b", 3), (4, "x", 4)]


def test_dataset_with_a_schema_that_does_not_fit(spark, tmp_path):
    columns = (ColumnSpec("id", 9), ColumnSpec("name"), ColumnSpec("n", 9))
    (tmp_path / "a.txt").write_text("1;a;1\n2;b;2\n")
    with pytest.raises(ValueError, match="schema does not fit"):
        convert_text_files(spark, str(tmp_path / "a.txt"), columns, str(tmp_path / "out"), "k")
    assert not finished(spark, str(tmp_path / "out" / "k"))
    assert sorted(r["value"] for r in spark.read.parquet(str(tmp_path / "out" / "_rejects" / "k")).collect()) == ["1;a;1", "2;b;2"]


def test_finished_data_always_has_its_rejects(spark, dump):
    catalog, _ = build_catalog(spark, str(dump / "original"), str(dump / "schema"), "2025", "12")
    registry = build_registry(scan_schema_descriptors(spark, str(dump / "schema")))
    located = catalog.filter("catalog_key = '건축물대장_표제부'")
    out = dump / "blocked"
    out.mkdir()
    (out / "_rejects").write_text("in the way")
    assert [r["status"] for r in convert_catalog(spark, located, registry, str(out)).collect()] == ["failed"]
    (out / "_rejects").rename(dump / "aside")
    row = convert_catalog(spark, located, registry, str(out)).first()
    assert (row["status"], row["rejected"]) == ("converted", 1)


def test_unfinished_output_is_replaced_and_finished_is_not(spark, tmp_path):
    (tmp_path / "k").mkdir()
    (tmp_path / "k" / "part-0.parquet").write_bytes(b"half")
    assert not finished(spark, str(tmp_path / "k"))
    write_dataset(spark.range(3), str(tmp_path), "k")
    assert spark.read.parquet(str(tmp_path / "k")).count() == 3
    with pytest.raises(FileExistsError):
        write_dataset(spark.range(3), str(tmp_path), "k")


def test_code_list_to_tables(spark, tmp_path):
    text = "법정동코드\t법정동명\t폐지여부\n1100000000\t서울특별시\t존재\n1111000000\t서울특별시 종로구\t존재\n1111010100\t서울특별시 종로구 청운동\t존재\n"
    (tmp_path / "codes.txt").write_bytes(text.encode("cp949"))
    write_legal_districts(spark, str(tmp_path / "codes.txt"), str(tmp_path / "out"))
    read = {name: sorted(map(tuple, read_csv_bom(spark, str(tmp_path / "out" / name)).collect())) for name in ("code_bjd", "code_sgg", "code_sido")}
    assert len(read["code_bjd"]) == 3
    assert read["code_sgg"] == [("11000", "서울특별시", "존재"), ("11110", "서울특별시 종로구", "존재")]
    assert read["code_sido"] == [("11", "서울특별시", "존재")]


def test_dated_sheets_to_tables(spark, tmp_path):
    header = '시도,"행정구역\n분류",행정구역분류,법정동코드\n'
    rows = "서울,,11,1100000000\n종로,N/A,11010,1111000000\n청운,,1101053,1111051500\n"
    (tmp_path / "in").mkdir()
    for date in ("2025.12.31.", "2026. 2. 1."):
        (tmp_path / "in" / f"분류_{date}기준_1.csv").write_text("title,,,\n" + header + rows, "utf-8")
    (tmp_path / "in" / "other.csv").write_text("x\n", "utf-8")
    skipped = write_statistical_districts(spark, str(tmp_path / "in"), str(tmp_path / "out"), n_columns=4)
    assert [r["name"] for r in skipped.collect()] == ["other.csv"]
    provinces = read_csv_bom(spark, str(tmp_path / "out" / "code_kcad_sido"))
    assert provinces.columns == ["시도코드", "시도", "행정구역 분류", "행정구역분류", "법정동코드", "edition_date"]
    assert sorted((r["시도코드"], str(r["edition_date"])) for r in provinces.collect()) == [("11", "20251231"), ("11", "20260201")]
    districts = read_csv_bom(spark, str(tmp_path / "out" / "code_kcad_sgg")).collect()
    assert [(r["시군구코드"], r["시도"], r["행정구역 분류"]) for r in districts] == [("11110", "종로", None)] * 2


def test_csv_has_a_mark_in_every_file(spark, tmp_path):
    rows = spark.range(0, 10, numPartitions=2).select(F.lit("가").alias("name"), F.format_string("%02d", "id").alias("코드"))
    write_csv_bom(rows, str(tmp_path / "c"), "코드")
    files = list((tmp_path / "c").glob("*.csv"))
    assert len(files) == 2
    assert all(f.read_bytes().startswith("﻿코드,name\n".encode()) for f in files)
    back = read_csv_bom(spark, str(tmp_path / "c"))
    assert back.columns == ["코드", "name"] and back.count() == 10


def test_descriptors_round_trip(spark, tmp_path):
    texts = spark.createDataFrame([("건축물대장_가", SCHEMA)], "dataset string, value string")
    write_schema_descriptors(texts, str(tmp_path / "s"))
    back = scan_schema_descriptors(spark, str(tmp_path / "s"))
    assert [r["dataset"] for r in back.collect()] == ["건축물대장_가"]
    assert build_registry(back).count() == 3


def test_catalog_round_trip(spark, dump):
    catalog, _ = build_catalog(spark, str(dump / "original"), str(dump / "schema"), "2025", "12")
    write_catalog(catalog, str(dump / "catalog"))
    back = read_catalog(spark, str(dump / "catalog"))
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, catalog.collect()))


def test_download_list_round_trip(spark, tmp_path):
    items = spark.createDataFrame([(str(i), "가", "t", "o", "s") for i in range(3)], "cat_val string, cat_name string, task_code string, opn_code string, service_name string")
    write_download_list(items.coalesce(1), str(tmp_path / "items"))
    assert sorted(map(tuple, read_download_list(spark, str(tmp_path / "items")).collect())) == sorted(map(tuple, items.collect()))
    (tmp_path / "one.json").write_text('[{"cat_val": "1"},\n {"cat_val": "2"}]', encoding="utf-8")
    assert [r["cat_val"] for r in read_download_list(spark, str(tmp_path / "one.json")).collect()] == ["1", "2"]
