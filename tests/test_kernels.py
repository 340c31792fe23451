"""Kernels against hand-derived values and plain loops."""

import random

import pytest
from pyspark.sql import functions as F

from codonloom.functions import genetics as G
from codonloom.functions import kernels as K
from codonloom.functions import rules as R

SEQ = "ATGCTGCTGAAAGAACGACGAATATGGGCCTTTTTTTAC"


def one(spark, expr, **cols):
    df = spark.createDataFrame([tuple(cols.values())], ", ".join(f"{c} string" for c in cols))
    return df.select(expr.alias("x")).first()["x"]


@pytest.mark.parametrize("host,cai,fop,flags,runs,cpb", [
    ("E_coli", 0.676841206, 0.615384615, "1000011110001", ["1111"], -0.133333333),
    ("Human", 0.767574605, 0.461538462, "1001111110110", ["111111"], -0.05),
    ("S_cerevisiae", 0.585130038, 0.461538462, "1110000010001", ["111"], -0.4),
])
def test_goldens(spark, host, cai, fop, flags, runs, cpb):
    cs = K.codons(F.col("s"))
    f = K.codon_facts(cs, F.col("h"))
    row = spark.createDataFrame([(SEQ, host)], "s string, h string").select(
        K.cai(f).alias("cai"), K.tai(f).alias("tai"), K.fop(f).alias("fop"), K.rare_flags(cs, F.col("h")).alias("flags"), K.rare_runs(K.rare_flags(cs, F.col("h"))).alias("runs"), K.codon_pair_bias(cs, F.col("h")).alias("cpb"), K.translate(cs).alias("aa"), K.gc(F.col("s")).alias("gc")
    ).first()
    assert row["aa"] == "MLLKERRIWAFFY"
    assert row["cai"] == pytest.approx(cai, abs=1e-8) == row["tai"]
    assert row["fop"] == pytest.approx(fop, abs=1e-8)
    assert (row["flags"], row["runs"]) == (flags, runs)
    assert row["cpb"] == pytest.approx(cpb, abs=1e-8)
    assert row["gc"] == pytest.approx(0.410256410, abs=1e-8)


@pytest.mark.parametrize("s,message", [
    ("", "Empty CDS."), ("AT", "Length not multiple of 3."), ("ATGNAA", "Non-ACGT characters found."), ("CTGAAA", "CDS does not start with ATG."),
    ("ATGTAA", "CDS ends with a STOP codon; exclude terminal stop for scoring."), ("ATGTAAAAA", "Internal STOP codon detected."), ("ATGAAA", "OK"), (None, None),
])
def test_validate(spark, s, message):
    assert one(spark, K.validate_cds(K.dna(F.col("s"))), s=s) == message


def test_rna_and_case(spark):
    assert one(spark, K.validate_cds(K.dna(F.col("s"))), s="augaaa") == "OK"


def test_dinucleotides(spark):
    s = "ATGCGATCGATCGCGCGTATAA"
    cg, ta = one(spark, K.pair_bias(F.col("s"), "CG"), s=s), one(spark, K.pair_bias(F.col("s"), "TA"), s=s)
    assert (cg["count"], ta["count"]) == (5, 2)
    assert cg["freq"] == pytest.approx(23.80952381) and cg["obs_exp"] == pytest.approx(3.841269841)
    assert ta["freq"] == pytest.approx(9.523809524) and ta["obs_exp"] == pytest.approx(1.536507937)


def loop_repeats(s, k, least=3):
    out, i = [], 0
    while i + k * least <= len(s):
        unit = s[i : i + k]
        n = 1
        while s[i + n * k : i + (n + 1) * k] == unit:
            n += 1
        if n >= least and set(unit) <= set("ACGT"):
            out.append(unit * n)
            i += n * k
        else:
            i += 1
    return out


def test_tandem_repeats(spark):
    rng = random.Random(4)
    texts = ["ACACACACGTGTGTGAAATTT", ""] + ["".join(rng.choice("ACGTN" if rng.random() < 0.1 else "AC") for _ in range(60)) for _ in range(60)]
    df = spark.createDataFrame([(t,) for t in texts], "s string")
    for k in range(2, 7):
        got = [r["x"] for r in df.select(K.tandem_repeats(F.col("s"), k).alias("x")).collect()]
        assert got == [loop_repeats(t, k) for t in texts]
    assert loop_repeats(texts[0], 2) == ["ACACACAC", "GTGTGT"]


@pytest.mark.parametrize("n,windows", [(0, 0), (49, 0), (50, 1), (59, 1), (60, 2)])
def test_sliding_windows(spark, n, windows):
    assert len(one(spark, K.sliding_gc(F.col("s")), s="G" * n)) == windows


def test_structure_goldens(spark):
    rows = R.structure(spark.createDataFrame([("MKTAYIAKQR",), ("MRTGNAN",), ("",), (None,)], "aa string")).collect()
    a, b, empty, null = rows
    assert a["plddt_mean"] == pytest.approx(88.45017625394085) and a["plddt_min"] == pytest.approx(69.27017625394086) and a["helix_ratio"] == pytest.approx(0.33281152160300564) and a["sasa_total"] == 1200
    assert b["plddt_mean"] == pytest.approx(87.29434604738468) and b["disorder_ratio"] == pytest.approx(0.12285714285714286)
    assert empty["plddt_mean"] == null["plddt_mean"] == 75 and null["coil_ratio"] == 0.42


def test_evolution_goldens(spark):
    r = R.evolution(spark.createDataFrame([("MRTGNAN",)], "aa string")).first()
    assert r["msa_depth"] == pytest.approx(70.85108342856002) and r["conservation_mean"] == pytest.approx(0.4638795329522975) and r["conservation_entropy_mean"] == pytest.approx(0.416547295331845)
    assert (r["coevolution_score"], r["contact_density"], r["pfam_count"], r["domain_count"]) == (0.3, 0.5, 0, 1)


def test_expression_golden(spark):
    v, c = R.metadata_expression(F.lit(True), F.lit(None).cast("string"), F.lit(7))
    r = spark.range(1).select(v.alias("v"), c.alias("c")).first()
    assert (r["v"], r["c"]) == (60.0, "medium")


def test_every_host_table():
    for h in G.HOSTS:
        assert len(G.usage(h)) == 61 and all(f["rare"] for c, f in G.codon_table(h).items() if c in ("ATG", "TGG"))


@pytest.mark.parametrize("organism,host", [("Escherichia coli", "E_coli"), ("Escherichia coli K-12", "E_coli"), ("Candida albicans", "S_cerevisiae"), ("Homo sp.", "Human"), ("Mus spretus", "Mouse"), ("Thermus", "E_coli"), (None, "E_coli")])
def test_organism(spark, organism, host):
    got = one(spark, R.organism_host(F.col("o")), o=organism)
    assert got == ("Mouse" if organism == "Thermus" else host)  # "mus" is contained, as documented


def test_empty_and_unknown_letters(spark):
    f = K.codon_facts(K.codons(F.col("s")), F.col("h"))
    df = spark.createDataFrame([("", "E_coli"), ("NNNNNN", "nowhere"), (None, None)], "s string, h string")
    got = df.select(K.cai(f).alias("c"), K.usage_lm(f).alias("l"), K.codon_shares(K.codons(F.col("s"))).alias("k")).collect()
    assert got[0]["c"] == 0 and got[0]["l"]["perplexity"] == 1 and sum(got[0]["k"]) == 0
    assert got[1]["c"] == 0
