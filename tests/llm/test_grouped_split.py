"""Tied sets and their placement."""

from pyspark.sql import functions as F

from codonloom.llm.grouped_split import SPLITS, _quotas, grouped_split, tied_sets

GROUPS = "group_no long, group_id string, protein_aa string, host string, cluster_id long, tied string"
CLUSTERS = "cluster_id long, protein_groups array<string>, host string"


def tables(spark, groups, clusters):
    return spark.createDataFrame([(*g, "x") for g in groups], GROUPS), spark.createDataFrame([(*c, "x") for c in clusters], CLUSTERS)


def test_ties(spark):
    groups = [(1, "a", "MK", "Human", None), (2, "b", "mk*", "Human", 7), (3, "c", "AA", None, 7), (4, "d", "CC", "odd", 9), (5, "e", None, "Mouse", None), (6, "f", None, "Mouse", None), (7, "g", "DD", "Mouse", 9), (8, "h", "EE", "Mouse", 8), (None, "i", "MK", "Human", 8)]
    clusters = [(9, ["e", "e", "unknown", None]), (8, None), (None, ["a", "h"]), (10, ["f", "h"])]
    got = {r["group_no"]: r["tied"] for r in tied_sets(*tables(spark, groups, clusters)).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 4, 5: 4, 6: 6, 7: 4, 8: 6}


def test_split_keeps_ties_and_shares(spark):
    hosts = ["Human", "Mouse", "E. coli", "nobody"]
    groups = [(i, f"g{i}", f"P{i // 3}A{i % 7 if i % 5 else 0}", hosts[i % 4], i // 4 if i % 2 else None) for i in range(600)]
    got = grouped_split(*tables(spark, groups, [(1, ["g0", "g9"])])).collect()
    assert len(got) == 600
    by = {}
    for r in got:
        assert by.setdefault(r["tied"], r["split"]) == r["split"]
    for s, share in SPLITS.items():
        assert abs(sum(r["split"] == s for r in got) / 600 - share) < 0.04
        for h in ("Human", "Mouse", "E_coli", "other"):
            n = [r for r in got if r["host"] == h]
            assert abs(sum(r["split"] == s for r in n) / len(n) - share) < 0.08


def test_quotas_large_set():
    got = _quotas([("a", 1, [90.0]), ("b", 2, [10.0])], SPLITS)
    assert got["a"] == {"train": 1, "val": 0, "test": 0} and got["b"] == {"train": 0, "val": 1, "test": 1}
    assert _quotas([("a", 1, [5.0]), ("b", 0, [0.0])], SPLITS)["a"]["train"] == 1 and _quotas([], SPLITS) == {}


def test_quotas_place_every_set_once():
    classes = [(f"c{i}", 1 + i * 7 % 13, [float(i % 3), float(i * i % 5), 1.0]) for i in range(60)]
    got = _quotas(classes, SPLITS)
    assert all(sum(got[c].values()) == n for c, n, _ in classes)


def test_shares_of_many_sets_of_all_sizes(spark):
    """One rule at all sizes: 25 000 rows in single sets, middle ones and one with a tenth of all."""
    hosts = ["Human", "Mouse", "E. coli", "Pichia pastoris"]
    groups = [(i, f"g{i}", None, hosts[i * i % 7 % 4], 0 if i % 10 == 0 else i % 90 if i % 3 == 0 else 1000 + i) for i in range(25_000)]
    got = grouped_split(*tables(spark, groups, []))
    rows = got.groupBy("host", "split").count().collect()
    assert got.groupBy("tied").agg(F.countDistinct("split").alias("k")).filter("k > 1").count() == 0
    for h in {r["host"] for r in rows}:
        n = {r["split"]: r["count"] for r in rows if r["host"] == h}
        for s, share in SPLITS.items():
            assert abs(n[s] / sum(n.values()) - share) < 0.005


def test_empty(spark):
    assert grouped_split(*tables(spark, [], [])).count() == 0
