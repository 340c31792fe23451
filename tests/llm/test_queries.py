"""The registered training-data queries: columns, empty tables, their SQL checks."""

import os

import duckdb
import pytest
from pyspark.sql import functions as F

from codonloom.llm import queries as Q

SMALL = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SMALL), reason="test tables are not here")

COLUMNS = {
    "p2_found": ["rec_id_a", "rec_id_b"], "p3_found": ["group_no_a", "group_no_b"], "p5_found": ["group_no_a", "group_no_b"], "p6_found": ["doc_id", "item_id"], "p7_found": ["source"], "p8_found": ["doc_id"],
}


@pytest.fixture(scope="module")
def empty_dir(spark, tmp_path_factory):
    d = tmp_path_factory.mktemp("empty")
    for f in os.listdir(SMALL):
        t = spark.read.parquet(f"{SMALL}/{f}").limit(0).withColumns({"txt": F.lit("x"), "uid": F.lit(1), "key": F.lit(2), "kind": F.lit(3)})
        t.coalesce(1).write.parquet(str(d / f))
    return str(d)


@pytest.mark.parametrize("name", sorted(Q.queries()))
def test_runs(spark, name):
    df = Q.queries()[name](spark, SMALL)
    assert df.columns == COLUMNS.get(name, df.columns)
    rows = df.count()
    assert rows > 0 or name == "p2_found"


@pytest.mark.parametrize("name", sorted(Q.queries()))
def test_empty(spark, empty_dir, name):
    assert Q.queries()[name](spark, empty_dir).count() >= 0


@pytest.mark.parametrize("name", sorted(Q.oracle_sql()))
def test_sql(spark, name):
    con = duckdb.connect()
    for f in os.listdir(SMALL):
        con.sql(f"create view {f.removesuffix('.parquet')} as select * from '{SMALL}/{f}'")
    sql = con.sql(Q.oracle_sql()[name])
    got = Q.queries()[name](spark, SMALL).select(*sql.columns)
    assert sorted((tuple(r) for r in got.collect()), key=str) == sorted(sql.fetchall(), key=str)


def test_report_shares(spark):
    r = Q.queries()["p5_split_report"](spark, SMALL).collect()
    whole = [x for x in r if x["host"] is None]
    assert abs(sum(x["share"] for x in whole) - 1) < 1e-6
