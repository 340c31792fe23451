"""Spans, seeded numbers, ranges, caps, linkage and models against plain loops."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from codonloom.functions import kernels as K
from codonloom.functions import rules as R
from codonloom.functions.seeded import seeded, uniform
from codonloom.operators import models as M
from codonloom.operators import pairs as C
from codonloom.operators import profile as P
from codonloom.operators import records as O
from codonloom.operators import similarity as S
from codonloom.operators.ordinals import running_sum
from codonloom.operators.schema_drift import consistent_table
from codonloom.plans.lineage import checkpoint_dir


def number(*parts):
    return int(hashlib.md5(":".join(map(str, parts)).encode()).hexdigest()[:15], 16)


def test_seeded(spark):
    r = spark.range(3).select("id", seeded(7, "id", F.lit("x")).alias("h"), uniform(F.col("id")).alias("u")).collect()
    assert [x["h"] for x in r] == [number(7, i, "x") for i in range(3)] and all(0 <= x["u"] < 1 for x in r)


@pytest.mark.parametrize("least", [1, 3, 6])
def test_run_spans(spark, least):
    rng = random.Random(least)
    texts = ["", None, "A", "".join(rng.choice("AC") for _ in range(80)), "A" * 9 + "C" + "G" * 7]
    got = spark.createDataFrame(list(enumerate(texts)), "id int, s string").select("id", K.run_spans(F.col("s"), least).alias("r")).collect()
    for row in got:
        want, s, i = [], texts[row["id"]] or "", 0
        while i < len(s):
            j = i
            while j < len(s) and s[j] == s[i]:
                j += 1
            if j - i >= least:
                want.append((i, j - i, s[i]))
            i = j
        assert [tuple(x) for x in row["r"] or []] == want


@pytest.mark.parametrize("unit", [2, 3])
def test_tandem_spans(spark, unit):
    rng = random.Random(unit)
    texts = ["", "ACACACACGTGTGTGAAATTT"] + ["".join(rng.choice("AC") for _ in range(60)) for _ in range(20)]
    got = spark.createDataFrame(list(enumerate(texts)), "id int, s string").select("id", K.tandem_spans(F.col("s"), unit).alias("r")).collect()
    for row in got:
        s, want, i = texts[row["id"]], [], 0
        while i + unit <= len(s):
            n = 1
            while s[i : i + unit] == s[i + n * unit : i + (n + 1) * unit]:
                n += 1
            if n >= 3:
                want.append((i, n * unit, s[i : i + unit]))
                i += n * unit
            else:
                i += 1
        assert [tuple(x) for x in row["r"]] == want


def test_expression_rules(spark):
    """Values worked out by hand from the documented rules."""
    rows = [(50.0, "medium", 0.96, 0.98, 0.90, -1.0, 5.0), (50.0, "medium", None, 0.98, 0.90, -5.0, 40.0), (50.0, "low", 0.5, 0.9, 0.2, None, None)]
    c = [F.col(x) for x in "vcabdlp"]
    got = spark.createDataFrame(rows, "v double, c string, a double, b double, d double, l double, p double").select(*[x.alias(n) for x, n in zip(R.lm_expression(*c), ("x", "y"), strict=True)]).collect()
    assert [(round(r["x"], 6), r["y"]) for r in got] == [(57.575, "high"), (47.0, "medium"), (47.0, "low")]
    s = spark.createDataFrame([("GC" * 5 + "AT" * 5,), ("G" * 8 + "C" * 2,), ("A" * 10,)], "s string").select(R.sequence_expression(F.lit(50.0), F.col("s")).alias("x")).collect()
    assert [r["x"] for r in s] == [55.0, 45.0, 35.0]


def test_take_lowest_of_a_hot_part(spark):
    rows = spark.range(3000).select(F.when(F.col("id") < 2900, "hot").otherwise("cold").alias("k"), "id")
    got = O.take_lowest(rows, ["k"], seeded(3, "id"), ["id"], F.lit(500)).collect()
    for k, ids in (("hot", range(2900)), ("cold", range(2900, 3000))):
        assert sorted(r["id"] for r in got if r["k"] == k) == sorted(sorted(ids, key=lambda i: (number(3, i), i))[:500])
    whole = O.take_lowest(rows, [], seeded(3, "id"), ["id"], F.lit(70)).collect()
    assert sorted(r["id"] for r in whole) == sorted(sorted(range(3000), key=lambda i: number(3, i))[:70])


def test_stratified_cap(spark):
    bands = [0] * 60 + [1] * 30 + [2] * 3 + [None] * 2
    rows = spark.createDataFrame([("g", i, b) for i, b in enumerate(bands)] + [("h", 900 + i, 1) for i in range(5)], "g string, id long, band int")
    got = O.stratified_cap(rows, ["g"], "band", 20, 9, "id").collect()
    own = [r["band"] for r in got if r["g"] == "g"]
    assert len(own) == 20 and len(got) == 25 and own.count(0) >= 12 and own.count(1) >= 6 and own.count(2) >= 1 and own.count(None) >= 1


def test_running_sum_and_quantiles(spark):
    rng = random.Random(4)
    xs = [rng.randint(0, 40) / 2 for _ in range(400)] + [None, float("nan")]
    df = spark.createDataFrame([(x, 1.0) for x in xs], "a double, b double")
    good = sorted(x for x in xs if x is not None and x == x)
    got = {(r["column"], r["p"]): r["value"] for r in P.linear_quantiles(df, ["a", "b"], (0.0, 0.25, 0.9, 1.0)).collect()}
    for p in (0.0, 0.25, 0.9, 1.0):
        assert got["a", p] == pytest.approx(float(np.quantile(good, p))) and got["b", p] == 1.0
    sums = running_sum(spark.createDataFrame([("x", i, 2) for i in range(50)] + [("y", 3, 7)], "k string, i int, v int"), ["k"], ["i"], "v", "s").collect()
    assert all(r["s"] == (2 * (r["i"] + 1) if r["k"] == "x" else 7) for r in sums) and len(sums) == 51
    assert P.linear_quantiles(df.limit(0), ["a"], (0.5,)).count() == 0


def test_pairs_of_a_hot_group(spark, monkeypatch):
    rows = spark.createDataFrame([("hot", i, float(i % 5)) for i in range(40)] + [("cold", 1, 1.0), ("cold", 2, 2.0), ("one", 3, None)], "g string, i long, v double")
    want = sorted(map(tuple, C.group_pairs(rows, "g", "i", "v").collect()))
    monkeypatch.setattr(C, "PAIRED", 7)
    assert sorted(map(tuple, C.group_pairs(rows, "g", "i", "v").collect())) == want and len(want) == 641


def test_kmers_of_a_hot_one(spark, monkeypatch):
    rows = spark.createDataFrame([(i, "p", "MKTAYIAKQR"[: 6 + i % 4]) for i in range(30)], "id long, part string, txt string")
    want = sorted(map(tuple, S.kmer_jaccard(rows, 3, 0.5).collect()))
    monkeypatch.setattr(S, "MET", 4)
    assert sorted(map(tuple, S.kmer_jaccard(rows, 3, 0.5).collect())) == want and want


def test_identity_linkage(spark):
    texts = ["MKTAYIAK", "MKTAYIAR", "MKTAYIA", "GGGGGGGG", "GGGGGGGA", "WWWWFFFF", ""]
    d = C._identity_distance(texts)
    for i, a in enumerate(texts):
        for j, b in enumerate(texts):
            n = min(len(a), len(b))
            assert d[i, j] == pytest.approx(1 - sum(x == y for x, y in zip(a, b, strict=False)) / n if n else 1)
    rows = spark.createDataFrame([("p", i, t) for i, t in enumerate(texts[:6])] + [("q", 9, None)], "p string, id long, t string")
    got = {r["id"]: r["cluster"] for r in C.identity_linkage(rows, "p", "id", "t", most=3, per=2).collect()}
    assert got == {0: 0, 1: 0, 2: 0, 3: 3, 4: 3, 5: 5}


def test_surrogate_without_rows(spark):
    rows = M.assembled(spark.createDataFrame([(1, 2.0, 3.0)], "id long, a double, y double"), ["a"])
    m = M.QuantileSurrogate.fit(rows.limit(0), "y")
    path = f"{checkpoint_dir(spark)}/none"
    m.save(path)
    r = M.QuantileSurrogate.load(path).predict(rows).first()
    assert r["mu"] is None and r["sigma"] is None and m.importances() == []


def test_sigma_follows_the_noise(spark):
    rng = random.Random(9)
    data = [(float(i % 2), 10.0 + rng.gauss(0, 8.0 if i % 2 else 0.5)) for i in range(600)]
    rows = M.assembled(spark.createDataFrame(data, "a double, y double"), ["a"])
    s = {r["a"]: r["sigma"] for r in M.QuantileSurrogate.fit(rows, "y", trees=5).predict(rows).groupBy("a").agg(F.avg("sigma").alias("sigma")).collect()}
    assert s[1.0] > 3 * s[0.0] > 0


def test_fields_beyond_the_columns(spark):
    text = ['{"protein_id": "P%d", "v": %d, "rare_%d": %d}' % (i, i, i, i) for i in range(9)]
    rows = spark.createDataFrame([(i, "f", 1, "f1", t) for i, t in enumerate(text)], "line_no long, feed string, file_seq int, file_name string, line string")
    table, _, _ = consistent_table(rows, most=3)
    assert set(table.columns) - {"line_no", "feed", "file_seq", "file_name", "entity", "other_fields"} == {"protein_id", "v", "rare_0"}
    assert sorted(k for r in table.collect() for k in r["other_fields"]) == [f"rare_{i}" for i in range(1, 9)]
