"""Clashing names, nulls and empty tables for the core's registered queries."""

import shutil

import pytest
from pyspark.sql import functions as F

from codonloom.plans import catalog

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def empty_dir(spark, tmp_path_factory):
    """All tables without rows, and with clashing extra columns."""
    import os

    if not os.path.isdir(SMALL):
        pytest.skip("test tables are not here")
    d = tmp_path_factory.mktemp("empty")
    for f in os.listdir(SMALL):
        t = spark.read.parquet(f"{SMALL}/{f}").limit(0).withColumns({"txt": F.lit("x"), "uid": F.lit(1), "n": F.lit(2), "f": F.lit(3)})
        t.coalesce(1).write.parquet(str(d / f))
    yield str(d)
    shutil.rmtree(d)


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_empty_tables(spark, empty_dir, name):
    rows = catalog.queries()[name](spark, empty_dir).collect()
    assert all(r is not None for r in rows)
