"""The pipeline from an export to enriched records, and the command line."""

import json

import pytest
from pyspark.sql import functions as F

from codonloom import __main__ as cli
from codonloom.plans import pipeline as L
from codonloom.sources import readers as S

HEAD = "Entry\tReviewed\tEntry Name\tProtein names\tGene Names\tOrganism\tLength\tSubcellular location [CC]\tRefSeq_id\tGenome_id\tRefSeq_nn\tRefSeq_aa\n"
ROWS = [
    ("P1", "reviewed", "E1", "x", "g", "Escherichia coli", "7", "", "r1", "G1", "ATGCGTACTGGTAATGCTAATTAA", "MRTGNAN"),
    ("P2", "unreviewed", "E2", "x", "g", "Candida albicans", "bad", "Cytoplasm", "r2", "G2", "ATGAAA", "MK"),
    ("", "reviewed", "E3", "x", "g", "Homo sapiens", "2", "", "", "", "ATGAAA", "MK"),
    ("P4", "reviewed", "E4", "x", "g", "Homo sapiens", "2", "", "", "", "ATGAA", "MK"),
    ("P5", "reviewed", "E5", "x", "g", "Homo sapiens", "2", "", "", "", "ATGAAA", "MKAAAA"),
]


@pytest.fixture
def export(tmp_path):
    p = tmp_path / "export.tsv"
    p.write_text(HEAD + "".join("\t".join(r) + "\n" for r in ROWS))
    return str(p)


def test_records(spark, export):
    got = {r["metadata"]["entry_name"]: r for r in L.to_records(S.read_tsv(spark, export)).collect()}
    assert [got[f"E{i}"]["reject"] for i in range(1, 6)] == [None, None, "no_entry", "frame", "length"]
    assert got["E1"]["sequence"].endswith("TAA") and got["E1"]["expression"]["value"] == 60.0 and got["E1"]["expression"]["confidence"] == "medium"
    assert got["E2"]["host"] == "S_cerevisiae" and got["E2"]["extra_features"]["length"] == 2.0


def test_complete(spark, export):
    st = spark.createDataFrame([("P2", {"plddt_mean": 1.0}, 1), ("P2", {"plddt_mean": 2.0}, 2)], "protein_id string, features map<string,double>, line long")
    got = {r["protein_id"]: r for r in L.complete(S.read_tsv(spark, export), "full", structure=st).collect()}
    assert set(got) == {"P1", "P2"}
    x = got["P1"]["extra_features"]
    assert x["struct_plddt_mean"] == pytest.approx(87.29434604738468) and x["evo_msa_depth"] == pytest.approx(70.85108342856002)
    assert x["ctx_promoter_strength"] == 0.5 and x["codon_gc"] > 0 and x["codon_cai"] > 0
    assert got["P2"]["extra_features"]["struct_plddt_mean"] == 2.0
    assert got["P1"]["expression"]["original_value"] == 60.0


def test_refresh_keeps_lm(spark, export):
    rows = L.to_records(S.read_tsv(spark, export)).filter("reject is null").drop("reject")
    rows = rows.withColumn("extra_features", F.create_map(F.lit("evo2_perplexity"), F.lit(4.0), F.lit("struct_plddt_mean"), F.lit(1.0)))
    x = L.selective_refresh(rows).filter("protein_id = 'P1'").first()["extra_features"]
    assert x["evo2_perplexity"] == 4.0 and x["struct_plddt_mean"] > 80
    with pytest.raises(ValueError):
        L.enhanced_expression(rows, "guess")


def test_command_line(spark, export, tmp_path, monkeypatch):
    monkeypatch.setattr(cli, "session", lambda: spark)
    cli.main(["convert", "--input", export, "--output", str(tmp_path / "rec")])
    assert spark.read.json(str(tmp_path / "rec")).count() == 2
    one = tmp_path / "one.jsonl"
    one.write_text("".join(p.read_text() for p in sorted((tmp_path / "rec").glob("part-*"))))
    cli.main(["integrate", "--input", str(one), "--output", str(tmp_path / "int")])
    full = tmp_path / "full.jsonl"
    full.write_text("".join(p.read_text() for p in sorted((tmp_path / "int").glob("part-*"))))
    cli.main(["describe", "--input", str(full), "--output", str(tmp_path / "desc")])
    assert spark.read.option("header", True).csv(str(tmp_path / "desc")).filter("column = 'codon_gc'").first()["count"] == "2"
    cli.main(["extract", "--input", str(full), "--output", str(tmp_path / "fam"), "--features", "evo"])
    assert "evo_msa_depth" in spark.read.option("header", True).csv(str(tmp_path / "fam")).columns
    lm = tmp_path / "lm.json"
    lm.write_text(json.dumps([{"task": "t", "status": "success", "output": {"avg_loglik": -1.0, "perplexity": 4.0}, "metadata": {"request_id": "record_0"}}]))
    cli.main(["enhance", "--input", str(full), "--evo2-results", str(lm), "--output", str(tmp_path / "enh")])
    assert spark.read.json(str(tmp_path / "enh")).count() == 2
    cli.main(["candidates", "--aa", "MKTAYIAKQR", "--n", "3", "--top", "2", "--output", str(tmp_path / "c")])
    assert spark.read.json(str(tmp_path / "c")).count() == 2


def test_model_round_trip(spark, tmp_path):
    from codonloom.operators.models import QuantileSurrogate, assembled

    rows = assembled(spark.createDataFrame([(float(i), float(i % 5), i * 2.0) for i in range(60)], "a double, b double, y double"), ["a", "b"])
    m = QuantileSurrogate.fit(rows, "y", trees=3)
    m.save(str(tmp_path / "m"))
    a = [r["mu"] for r in m.predict(rows).orderBy("a").collect()]
    assert a == [r["mu"] for r in QuantileSurrogate.load(str(tmp_path / "m")).predict(rows).orderBy("a").collect()]
