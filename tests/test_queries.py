"""Every registered query against its SQL on the smallest tables."""

import os

import pytest

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def names():
    from checks import QUERIES

    return list(QUERIES)


@pytest.mark.parametrize("name", names())
def test_query_equals_sql(spark, name):
    from checks import compare

    lines = []
    assert compare.compare(spark, FOLDER, [name], lines.append) == [], "\n".join(lines)


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(names()) <= set(entry.oracle_sql()) <= set(entry.queries())
