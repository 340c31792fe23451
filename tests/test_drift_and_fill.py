"""Schema drift and filling: defined results on small tables and edge cases."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from codonloom.operators.fill_missing import time_fill
from codonloom.operators.schema_drift import consistent_table, drift

LINES = "line_no long, feed string, file_seq int, file_name string, line string"


def lines(spark, files):
    rows, n = [], 0
    for feed, seq, objects in files:
        for o in objects:
            n += 1
            rows.append((n, feed, seq, f"{feed}_{seq}", o if isinstance(o, str) or o is None else json.dumps(o)))
    return spark.createDataFrame(rows, LINES)


def test_changes(spark):
    ids = [f"P{i}" for i in range(12)]
    one = [{"protein_id": p, "x": {"plddt": 50 + i}, "old": 1, "flag": True} for i, p in enumerate(ids)]
    two = [{"protein_id": p, "x": {"mean_plddt": str(50 + i)}, "flag": [True], "new": "a"} for i, p in enumerate(ids)]
    t = lines(spark, [("f", 1, [*one, "{broken", "", None]), ("f", 2, [*two, two[0]]), ("g", 1, one)])
    got = {tuple(r) for r in drift(t).collect()}
    assert got == {
        ("f_2", "renamed", "x.mean_plddt", "x.plddt"), ("f_2", "retyped", "x.mean_plddt", "x.mean_plddt"), ("f_2", "retyped", "flag", "flag"),
        ("f_2", "removed", "old", "old"), ("f_2", "added", "new", "new"),
    }


def test_sparse_fields_do_not_count(spark):
    one = [{"protein_id": f"P{i}", "a": i} for i in range(20)]
    two = [{"protein_id": f"P{i}", "a": i} | ({"debug": 1} if i == 0 else {}) for i in range(20)]
    assert drift(lines(spark, [("f", 1, one), ("f", 2, two)])).count() == 0


def test_table_and_failed_casts(spark):
    one = [{"protein_id": f"P{i}", "a.b": i, "v": 1.5} for i in range(10)]
    two = [{"protein_id": f"P{i}", "a.b": i, "w": "1.5" if i else "bad", "line_no": i} for i in range(10)]
    table, report, failed = consistent_table(lines(spark, [("f", 1, one), ("f", 2, two)]))
    assert {(r["change"], r["field"]) for r in report.collect()} >= {("renamed", "w"), ("retyped", "w")}
    assert {(r["file_name"], r["field"], r["n_failed"]) for r in failed.collect() if r["n_failed"]} == {("f_2", "v", 1)}
    assert table.count() == 20


def test_numbers_keep_their_digits(spark):
    values = [1700000000123456, "123456789012", 0.12345678901234, "12.345678901234", -98765432109.5, 3, True, " 7 "]
    table, _, failed = consistent_table(lines(spark, [("f", 1, [{"protein_id": f"P{i}", "v": v} for i, v in enumerate(values)])]))
    assert [r["v"] for r in table.orderBy("line_no").collect()] == [float(v) for v in values]
    assert not any(r["n_failed"] for r in failed.collect())


def test_empty_tables(spark):
    empty = spark.createDataFrame([], LINES)
    assert drift(empty).count() == 0
    table, report, failed = consistent_table(empty)
    assert (table.count(), report.count(), failed.count()) == (0, 0, 0)


def day(n):
    return dt.datetime(2024, 1, 1) + dt.timedelta(days=n)


def fills(spark, rows, numeric=True, gap=None, kind="double"):
    df = spark.createDataFrame(rows, f"id long, e string, t timestamp, v {kind}, entity string, at string")
    got = time_fill(df, F.col("id"), F.col("e"), F.col("t"), F.col("v"), numeric, gap)
    return {r["row_id"]: (r["value"], r["method"], r["distance_s"]) for r in got.collect()}


def test_numeric_fill(spark):
    rows = [(1, "a", day(0), 10.0), (2, "a", day(30), None), (3, "a", day(40), 50.0), (4, "a", day(100), None), (5, "a", None, None), (6, "b", day(1), None), (7, None, day(1), None), (8, "a", day(-5), None), (9, "a", day(40), 70.0)]
    got = fills(spark, [(*r, "x", "y") for r in rows])
    assert set(got) == {2, 4, 5, 8}
    assert got[2] == (pytest.approx(10 + 50 * 0.75), "interpolated", 10 * 86400.0)
    assert got[4] == (60.0, "carried_forward", 60 * 86400.0)
    assert got[8] == (10.0, "carried_back", 5 * 86400.0)
    assert got[5][1] == "entity_mean"


def test_category_fill(spark):
    rows = [(1, "a", day(0), "x"), (2, "a", day(3), None), (3, "a", day(6), "y"), (4, "a", day(400), None), (5, "a", day(1), "y")]
    got = fills(spark, [(*r, "x", "y") for r in rows], numeric=False, gap=90.0, kind="string")
    assert got[2] == ("y", "carried_forward", 2 * 86400.0)
    assert got[4] == ("y", "entity_mode", None)


def test_fill_empty(spark):
    assert fills(spark, []) == {}
