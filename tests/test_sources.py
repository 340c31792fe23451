"""Readers, writers and streaming on small files."""

import json

import numpy as np
from pyspark.sql import functions as F

from codonloom.sources import readers as S
from codonloom.sources import schemas as H
from codonloom.sources import writers as W
from codonloom.streaming import enrich


def test_jsonl(spark, tmp_path):
    p = tmp_path / "a.jsonl"
    p.write_text('{"protein_id": "A", "sequence": "ATG"}\n\n{broken\n{"protein_id": "B", "extra": 1}\n')
    rows = S.read_jsonl(spark, str(p), H.RECORD)
    assert {r["protein_id"] for r in rows.collect()} == {"A", "B"}
    assert S.read_many(spark, [str(p), str(tmp_path / "absent"), str(p)], H.RECORD).count() == 2
    assert S.read_many(spark, [str(tmp_path / "absent")], H.RECORD).count() == 0


def test_array_or_lines(spark, tmp_path):
    rows = [{"task": "t", "status": "success", "output": {"avg_loglik": -1.0, "perplexity": 4.0, "confidence_scores": [0.5, 1.0]}, "metadata": {"request_id": "record_7"}}, {"task": "t", "status": "error", "metadata": {"request_id": "record_8"}}]
    a, b = tmp_path / "a.json", tmp_path / "b.json"
    a.write_text(" [" + ",".join(map(json.dumps, rows)) + "]")
    b.write_text("\n".join(map(json.dumps, rows)))
    for p in (a, b):
        got = {r["position"]: r for r in S.read_lm_results(spark, str(p)).collect()}
        assert got[7]["evo2_bpb"] == 2.0 and got[7]["evo2_std_confidence"] == 0.25 and got[8]["evo2_bpb"] is None and not got[8]["ok"]


def test_tsv(spark, tmp_path):
    for n in "ab":
        (tmp_path / f"{n}.tsv").write_text("Entry\tReviewed\tRefSeq_nn\tOrganism\n" + "".join(f"{n}{i}\treviewed\tATG\tHomo sapiens\n" for i in range(5)))
    (tmp_path / "c.txt").write_text("no\n")
    rows = S.read_tsv_directory(spark, str(tmp_path), cap=2, reviewed=True)
    assert rows.count() == 4
    got = S.aliased(rows).first()
    assert got["expression"] == 1.0 and got["host"] == "Homo sapiens" and got["protein_aa"] is None
    assert len(S.discover(spark, [str(tmp_path)], ".tsv")) == 2


def test_alignments_and_features(spark, tmp_path):
    from codonloom.operators.records import hit_features

    p = tmp_path / "hits.tsv"
    p.write_text("q\tt1\t80\t90\t0\t0\t1\t9\t1\t9\t1e-5\t50\nq\tt2\t40\t110\t0\t0\t1\t9\t1\t9\t1e-5\t50\nbroken line\n")
    r = hit_features(S.read_alignment_tsv(spark, str(p)).filter("pident is not null")).first()
    assert (r["msa_depth"], r["msa_effective_depth"], r["msa_coverage"]) == (2.0, 1.0, 1.0)


def test_pdb(spark, tmp_path):
    atom = "ATOM  {:5d}  {:<3s} ALA A{:4d}    {:8.3f}{:8.3f}{:8.3f}{:6.2f}{:6.2f}\n"
    (tmp_path / "m.pdb").write_text(atom.format(1, "CA", 1, 0, 0, 0, 1, 80) + atom.format(2, "CB", 1, 0, 0, 0, 1, 40) + "REMARK x\n" + atom.format(3, "CA", 2, 0, 0, 0, 1, 60))
    r = S.read_pdb(spark, str(tmp_path / "m.pdb")).first()
    assert (r["plDDT_mean"], r["plDDT_min"], r["ca_mean"], r["ca_std"], r["ca_below70"]) == (60.0, 40.0, 70.0, 10.0, 0.5)


def test_npz_fasta_numeric(spark, tmp_path):
    np.savez(tmp_path / "e.npz", emb=np.array([[3.0, 0.0], [3.0, 8.0]]))
    r = S.read_npz_embeddings(spark, str(tmp_path / "e.npz")).first()
    assert (r["dim"], r["l2"]) == (2, 5.0)
    (tmp_path / "m.a3m").write_text(">a\nAC\n>b\nAC\n")
    assert S.msa_depth(spark, str(tmp_path / "m.a3m")).first()["msa_depth"] == 2
    df = spark.createDataFrame([('{"a": "1.5", "b": "x", "c": 2}',)], "j string")
    assert df.select(S.numeric_json(F.col("j")).alias("x")).first()["x"] == {"a": 1.5, "c": 2.0}


def test_writers(spark, tmp_path):
    df = spark.createDataFrame([("a", "MK", 0.5), ("b", None, 0.25), ("c", "", 1.0)], "id string, aa string, v double").coalesce(1)
    W.write_fasta(df, "id", "aa", str(tmp_path / "f"))
    assert [r["value"] for r in spark.read.text(str(tmp_path / "f")).collect()] == [">a", "MK"]
    W.write_json_array(df, str(tmp_path / "j"))
    text = "".join(p.read_text() for p in (tmp_path / "j").glob("part-*"))
    assert [x["id"] for x in json.loads(text)] == ["a", "b", "c"]
    W.write_csv(df, str(tmp_path / "c"), {"v": 6})
    assert spark.read.option("header", True).csv(str(tmp_path / "c")).first()["v"] == "0.500000"
    W.write_jsonl(df, str(tmp_path / "t"))
    W.replace_table(spark.read.json(str(tmp_path / "t")).filter("id = 'a'"), str(tmp_path / "t"))
    assert spark.read.json(str(tmp_path / "t")).count() == 1
    b = spark.createDataFrame([(1.5,)], "plDDT_mean double").select(F.struct("plDDT_mean").alias("b"))
    assert b.select(S.bundle_from_json(W.bundle_to_json(F.col("b")))["plDDT_mean"].alias("x")).first()["x"] == 1.5


def test_lookup(spark):
    calls = spark.createDataFrame([("a",), ("b",), (None,)], "acc string")

    def fetch(key):
        if key == "b":
            raise OSError("down")
        return {"plddt": 90.0}

    got = {r["acc"]: r["plddt"] for r in S.looked_up(calls, "acc", fetch, "plddt double").collect()}
    assert got == {"a": 90.0, "b": None, None: None}


def test_streams(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    (src / "a.json").write_text('{"protein_id": "A", "sequence": "ATGAAACTGTAA", "host": "E. coli"}\n{bad\n{"protein_id": "B", "sequence": null}\n')
    args = (str(src), str(tmp_path / "out"), str(tmp_path / "ck"))
    enrich.enrich_stream(spark, *args).awaitTermination()
    (src / "b.json").write_text('{"protein_id": "C", "sequence": "ATG"}\n')
    enrich.enrich_stream(spark, *args).awaitTermination()
    got = {r["protein_id"]: r["codon_cai"] for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert set(got) == {"A", "B", "C"} and got["A"] > 0 and got["B"] is None
    t = tmp_path / "tasks"
    t.mkdir()
    (t / "t.json").write_text(json.dumps({"task": "analyze", "input": {"sequence": "ATGGAATTC", "host": "Human", "forbidden_motifs": ["GAATTC"]}, "metadata": {"request_id": "r1"}}))
    enrich.task_stream(spark, str(t), str(tmp_path / "res"), str(tmp_path / "ck2")).awaitTermination()
    r = spark.read.json(str(tmp_path / "res")).first()
    assert (r["status"], r["forbidden_sites"]) == ("warning", 1)
