"""Queries take all rows of their tables, on small tables that hold each case."""

import duckdb
import pytest

from linemend.queries import ALL

CUSTOMERS = "c_custkey long, c_name string, c_nationkey int, c_mktsegment string"


@pytest.fixture(scope="module")
def customers(spark, tmp_path_factory):
    """Customers 1 to 14; 5 and 10 name another month, 3 has no orders."""
    path = tmp_path_factory.mktemp("customers")
    spark.createDataFrame([(i, f"N{i}", i, "S") for i in range(1, 15)], CUSTOMERS).write.parquet(f"{path}/customer.parquet")
    spark.createDataFrame([(i,) for i in range(1, 15) if i != 3], "o_custkey long").write.parquet(f"{path}/orders.parquet")
    return str(path)


WITH_SCHEMA = set(range(1, 15)) - {3, 5, 10}


def test_catalog_match_finds_each_schema(spark, customers):
    rows = ALL["catalog_match"][0](spark, customers).collect()
    assert len(rows) == 28
    assert sorted(r["schema_path"] for r in rows if r["schema_path"]) == sorted(f"C:/data/schema/schema_S_N{i}.txt" for i in WITH_SCHEMA for _ in "ab")


def test_catalog_rows_hold_each_archive_with_a_schema(spark, customers):
    rows = ALL["catalog_rows"][0](spark, customers).collect()
    assert sorted(r["catalog_key"] for r in rows) == sorted(f"S_N{i}" for i in WITH_SCHEMA)
    assert {r["schema_path"] for r in rows} == {f"schema/schema_S_N{i}.txt" for i in WITH_SCHEMA}


def test_catalog_count_is_of_all_archives_with_a_schema(spark, customers):
    assert ALL["catalog_count"][0](spark, customers).first()["n_datasets"] == len(WITH_SCHEMA)


def test_sql_of_catalog_count_is_of_all_archives_with_a_schema(customers):
    connection = duckdb.connect()
    for name in ("customer", "orders"):
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{customers}/{name}.parquet/*.parquet'")
    assert connection.execute(ALL["catalog_count"][1]).fetchall() == [(len(WITH_SCHEMA),)]


def test_catalog_unmatched_names_only_archives_without_a_schema(spark, customers):
    rows = ALL["catalog_unmatched"][0](spark, customers).collect()
    assert sorted((r["catalog_key"], r["issue"]) for r in rows if r["catalog_key"]) == [("S_N3", "schema not found")] * 2
    assert sum(r["issue"] == "unexpected name" for r in rows) == 4


@pytest.fixture(scope="module")
def documents(spark, tmp_path_factory):
    """A clean document, and documents with a line break, with a pipe and with both."""
    path = tmp_path_factory.mktemp("documents")
    rows = [(1, "a", "en", "s", 1), (2, "a\nb", "en", "s", 3), (3, "a|b", "en", "s", 3), (4, "a|\nb", "en", "s", 4)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    return str(path)


def test_route_clean_judges_each_document(spark, documents):
    assert [r.asDict() for r in ALL["route_clean"][0](spark, documents).collect()] == [{"file": "1", "value": "1|en|s|a|1"}]


def test_route_repair_names_file_and_line(spark, documents):
    rows = ALL["route_repair"][0](spark, documents).collect()
    assert sorted((r["file"], r["line_no"], r["value"]) for r in rows) == [
        ("2", 0, "2|en|s|a"), ("2", 1, "b|3"), ("3", 0, "3|en|s|a|b|3"), ("4", 0, "4|en|s|a|"), ("4", 1, "b|4"),
    ]
