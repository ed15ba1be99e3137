"""Every query against its SQL, on the small tables."""

import os

import harness
import pytest

from packlake.plans import catalog

SMALL = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SMALL), reason="needs the driver's tables")


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query_equals_sql(spark, name):
    harness.assert_same(catalog.QUERIES[name](spark, SMALL), catalog.ORACLES[name], SMALL)


def test_whole_tables_are_read(spark):
    n = spark.read.parquet(f"{SMALL}/documents.parquet").count()
    assert [catalog.QUERIES[q](spark, SMALL).count() for q in ("sql_functions", "read_many_order", "iter_split_w3")] == [n, 2 * n, n]
