"""Core operators: components, ordinals, sampling, similarity, pairs, generation, models."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from codonloom.functions import kernels as K
from codonloom.operators import generate as N
from codonloom.operators import pairs as C
from codonloom.operators import records as O
from codonloom.operators.components import components, follow_pointers, star_edges
from codonloom.operators.ordinals import with_ordinal
from codonloom.operators.similarity import kmer_jaccard


def test_components(spark):
    rng = random.Random(2)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(45)] + [(100 + i, 101 + i) for i in range(30)] + [(5, 5), (None, 3)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            ra, rb = find(a), find(b)
            parent[max(ra, rb)] = min(ra, rb)
    got = {r["node"]: r["comp"] for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {x: find(x) for x in list(parent)}


def test_components_empty(spark):
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_star_edges(spark):
    m = spark.createDataFrame([(3, "a"), (1, "a"), (2, "a"), (2, "a"), (9, "b"), (4, None)], "n long, k string")
    assert {tuple(r) for r in star_edges(m, "n", ["k"]).collect()} == {(3, 1), (2, 1)}


def test_pointers(spark):
    p = spark.createDataFrame([(0, 0)] + [(i, i - 1) for i in range(1, 20)] + [(50, 50)], "node long, parent long")
    assert {r["root"] for r in follow_pointers(p).collect() if r["node"] < 20} == {0}


def test_ordinals(spark):
    df = spark.createDataFrame([(x,) for x in random.Random(1).sample(range(1000), 100)], "v long")
    got = with_ordinal(df, ["v"], "i").orderBy("v").collect()
    assert [r["i"] for r in got] == list(range(100))


def test_take_per_key(spark):
    df = spark.createDataFrame([("a" if i % 3 else "b", i) for i in range(300)], "k string, id long")
    got = O.take_per_key(df, "k", {"a": 17, "b": 500}, 3, "id")
    assert {r["k"]: r["count"] for r in got.groupBy("k").count().collect()} == {"a": 17, "b": 100}
    assert sorted(r["id"] for r in got.collect()) == sorted(r["id"] for r in O.take_per_key(df, "k", {"a": 17, "b": 500}, 3, "id").collect())


def test_quotas():
    assert O.host_quotas({"x": 5, "y": 9}, None) == {"x": 5, "y": 5}
    assert O.host_quotas({"x": 50, "y": 90}, 40, {"x": 0.25, "y": 0.75}, cap=20) == {"x": 10, "y": 20}


@pytest.mark.parametrize("least", [0.2, 0.5, 0.8])
def test_kmer_jaccard(spark, least):
    rng = random.Random(5)
    base = ["".join(rng.choice("ABCD") for _ in range(30)) for _ in range(6)]
    texts = base + [b[:-3] + "XYZ" for b in base] + [b[5:] for b in base] + ["", "AB", None]
    df = spark.createDataFrame([(i, "p", t) for i, t in enumerate(texts)], "id long, part string, txt string")
    sets = [{t[i : i + 3] for i in range(len(t) - 2)} if t else set() for t in texts]
    want = {(i, j) for i in range(len(sets)) for j in range(i + 1, len(sets)) if sets[i] and sets[j] and len(sets[i] & sets[j]) / len(sets[i] | sets[j]) >= least}
    assert {(r["id_a"], r["id_b"]) for r in kmer_jaccard(df, 3, least).collect()} == want


def test_generation(spark):
    df = spark.createDataFrame([(1, "MKTAYIAKQR"), (2, "MAEFWX"), (3, None), (4, "")], "id long, aa string")
    hfc = {r["id"]: r["x"] for r in df.select("id", N.back_translate(F.col("aa"), "E_coli", "hfc", F.col("id")).alias("x")).collect()}
    assert hfc[3] is None and hfc[4] == "" and len(hfc[2]) == 15
    both = df.filter("id = 1").select(K.translate(K.codons(N.back_translate(F.col("aa"), "Human", "urc", F.col("id")))).alias("t"), K.cai(K.codon_facts(K.codons(F.lit(hfc[1])), F.lit("E_coli"))).alias("c"), K.fop(K.codon_facts(K.codons(F.lit(hfc[1])), F.lit("E_coli"))).alias("f")).first()
    assert both["t"] == "MKTAYIAKQR" and both["c"] == pytest.approx(1) and both["f"] == 1
    got = N.candidates(df, "id", "aa", "E_coli", 4, motifs=["AAA"]).collect()
    assert {r["id"] for r in got} == {1} and len({r["dna"] for r in got}) == len(got) <= 4 and all("AAA" not in r["dna"] for r in got)
    with pytest.raises(ValueError):
        N.back_translate(F.col("aa"), "E_coli", "guess", F.col("id"))


def test_policy(spark):
    df = spark.createDataFrame([(["GCT", "GCT"], 1.0), (["GCC", "GCC"], 0.0)], "cs array<string>, r double")
    up = N.policy_update(df, "cs", "r", {}, 1.0)
    assert up["GCT"] > up["GCA"] > up["GCC"] and up["AAA"] == 0


def test_hard_easy_cap(spark):
    rows = spark.createDataFrame([("g", i, float(i)) for i in range(8)] + [("g", 9, None)], "g string, i long, v double")
    pairs = C.group_pairs(rows, "g", "i", "v")
    assert pairs.count() == 28
    got = C.hard_easy(pairs, "g", cap=3)
    assert got.filter("level = 'hard' and abs(vi - vj) > 2.5").count() == 0
    assert max(r["count"] for r in got.groupBy("i").count().collect()) <= 3


def test_hard_easy_cap_large_group(spark):
    rows = [("g", i, float(i)) for i in range(330)] + [("h", i, float(i % 7) / 4) for i in range(240)]
    pairs = C.group_pairs(spark.createDataFrame(rows, "g string, i long, v double"), "g", "i", "v")
    got = {(r["g"], r["i"], r["j"]) for r in C.hard_easy(pairs, "g").collect()}
    want, used = set(), {}
    for a, (g, i, v) in enumerate(rows):
        for h, j, w in rows[a + 1 :]:
            if g == h and abs(v - w) >= 0.5 and max(used.get((g, i), 0), used.get((g, j), 0)) < 100:
                want.add((g, i, j))
                used[g, i], used[g, j] = used.get((g, i), 0) + 1, used.get((g, j), 0) + 1
    assert got == want and max(used.values()) == 100 and len(used) == len(rows)


def test_robust_pairs_sources_and_shortage(spark):
    rows = spark.createDataFrame([("g", i, float(i)) for i in range(6)], "g string, i long, v double")
    pairs = C.group_pairs(rows, "g", "i", "v")  # 15
    noise = C.noise_pairs(rows, "g", "i", "v", 0.2, 5)

    def sources(target, cap=500):
        got = C.robust_pairs(pairs, pairs, noise, "g", target, cap=cap).groupBy("source").count().collect()
        return {r["source"]: r["count"] for r in got}

    assert sources(20) == {"real": 15, "weak": 14}
    assert sources(31) == {"real": 15, "weak": 15, "synthetic": 15}
    assert sources(31, 20) == {"real": 15, "weak": 5}


def test_linkage_and_big_parts(spark):
    rows = spark.createDataFrame([("p", i, t) for i, t in enumerate(["MKTAYIAK", "MKTAYIAR", "GGGGGGGG", "GGGGGGGA", "WWWWFFFF", "WWWWFFFY"])], "p string, id long, t string")
    small = {r["id"]: r["cluster"] for r in C.average_linkage(rows, "p", "id", "t").collect()}
    big = {r["id"]: r["cluster"] for r in C.average_linkage(rows, "p", "id", "t", most=2, linked=0.2).collect()}
    assert set(small) == set(big) == set(range(6)) and small[0] == small[1] or len(set(small.values())) == 2
    assert big[0] == big[1] != big[2]


def test_linkage_is_one_rule_at_all_sizes(spark):
    rng = random.Random(4)
    rows = [("p", i, "".join(rng.choice("ACDEFGHIKL") for _ in range(30))) for i in range(520)]
    got = C.average_linkage(spark.createDataFrame(rows, "p string, id long, t string"), "p", "id", "t").collect()
    assert len(got) == 520 and len({r["cluster"] for r in got}) == 520 // 3


def test_linkage_merges_the_first_of_the_nearest():
    rng = np.random.default_rng(3)
    for n in (1, 2, 3, 7, 40, 60):
        dist = rng.integers(0, 6, (n, n)) / 7 if n % 2 else rng.random((n, n))
        dist = np.minimum(dist, dist.T)
        groups, d = {i: [i] for i in range(n)}, lambda a, b: sum(dist[x, y] for x in a for y in b) / len(a) / len(b)
        while len(groups) > max(2, n // 3):
            i, j = min(((i, j) for i in groups for j in groups if i < j), key=lambda x: (round(d(groups[x[0]], groups[x[1]]), 9), x))
            groups[i] = groups[i] + groups.pop(j)
        got = C._linkage(dist.copy(), max(2, n // 3))
        assert [int(x) for x in got] == [next(i for i, own in groups.items() if m in own) for m in range(n)]


def test_cluster_split_keeps_clusters(spark):
    cl = spark.createDataFrame([(i, i // 3) for i in range(60)], "id long, cluster long")
    got = C.cluster_splits(cl, 3)
    assert got.select("cluster", "split").distinct().count() == 20 and got.count() == 60


def test_merge_and_prefix(spark):
    df = spark.createDataFrame([({"a": 1.0, "struct_x": 2.0}, {"a": 3.0, "b": None}), (None, {"c": 4.0})], "m map<string,double>, n map<string,double>")
    got = [r["x"] for r in df.select(O.merged(F.col("m"), F.col("n")).alias("x")).collect()]
    assert got == [{"struct_x": 2.0, "a": 3.0, "b": None}, {"c": 4.0}]
    assert df.select(O.numeric_by_prefix(F.col("m"), ["struct_"]).alias("x")).first()["x"] == {"struct_x": 2.0}
    assert set(df.select(O.prefixed(F.col("m"), "struct_").alias("x")).first()["x"]) == {"struct_a", "struct_x"}
