"""Every registered query against its SQL on the smallest tables."""

import compare
import pytest

import __spark_entry__ as entry_module

FOLDER = "/root/testdata/sf0.001"
ORACLE = entry_module.oracle_sql()


@pytest.fixture(scope="module")
def connection():
    return compare.connect(FOLDER)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_equals_sql(spark, connection, name):
    df = entry_module.queries()[name](spark, FOLDER)
    assert compare.type_difference(df, connection, ORACLE[name]) is None
    assert compare.difference(df, connection, ORACLE[name]) is None


@pytest.mark.parametrize("name", sorted(set(entry_module.queries()) - set(ORACLE)))
def test_query_without_sql_has_rows(spark, name):
    assert entry_module.queries()[name](spark, FOLDER).count() > 0


def test_entry(spark):
    df = entry_module.entry(spark)
    assert df.columns == ["doc_id", "lang", "source", "text", "n_chars"] and df.count() > 0
