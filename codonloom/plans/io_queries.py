"""Queries of readers and writers: each table is written to the checkpoint folder and read back."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import records as O
from ..sources import files
from ..sources import readers as S
from ..sources import schemas as H
from ..sources import writers as W
from . import pipeline as L
from .lineage import checkpoint_dir
from .profile_queries import P
from .registry import RECORDS, query, records, table
from .sequence_queries import r6


def place(spark: SparkSession, name: str) -> str:
    """A new folder of its own beside the checkpoints."""
    return f"{checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"


def lines(rows: DataFrame, path: str) -> str:
    rows.write.mode("overwrite").text(path)
    return path


@query("SELECT protein_id, sequence, expression.value AS value, metadata.organism AS organism, cardinality(extra_features) AS n_features FROM integrated_test_1")
def io_jsonl(spark, d) -> DataFrame:
    """Records as JSON lines, between blank and broken lines that the tolerant reader leaves out."""
    t = table(spark, d, "integrated_test_1").select(*H.RECORD.names)
    noise = spark.createDataFrame([("",), ("   ",), ("{broken",), ('{"protein_id": ',)], "value string")
    path = lines(t.select(F.to_json(F.struct("*")).alias("value")).unionByName(noise), place(spark, "jsonl"))
    r = S.read_jsonl(spark, path, H.RECORD)
    return r.select("protein_id", "sequence", "expression.value", F.col("metadata.organism").alias("organism"), F.size("extra_features").cast("long").alias("n_features"))


@query("SELECT protein_id, sequence, host FROM integrated_test_1")
def io_jsonl_strict(spark, d) -> DataFrame:
    """Records written as JSON lines and read by the strict reader, from two paths of which one
    is missing."""
    path = place(spark, "strict")
    W.write_jsonl(table(spark, d, "integrated_test_1").select("protein_id", "sequence", "host"), path)
    have = S.existing(spark, [path, f"{path}-absent", path])
    return S.read_jsonl(spark, have, H.struct(H.TEXT, "protein_id sequence host"), strict=True)


@query(f"WITH {RECORDS} SELECT protein_id, aa AS protein_aa, raw AS sequence, metadata.organism AS host, 1.0::DOUBLE AS expression FROM rec WHERE protein_id <> ''")
def io_tsv(spark, d) -> DataFrame:
    """A table by tab with an export's column names, read as text and brought to canonical ones."""
    r = records(spark, d).filter("protein_id <> ''").select(F.col("protein_id").alias("Entry"), F.col("metadata.organism").alias("Organism"), F.col("raw").alias("RefSeq_nn"), F.col("aa").alias("RefSeq_aa"))
    path = place(spark, "tsv")
    r.write.option("sep", "\t").option("header", True).csv(path)
    return S.aliased(S.read_tsv(spark, path)).select("protein_id", "protein_aa", "sequence", "host", "expression")


@query("SELECT c_mktsegment AS segment, least(count(*), 100) AS n FROM customer GROUP BY 1")
def io_tsv_directory(spark, d) -> DataFrame:
    """All files of a folder by suffix, at most a hundred rows of each; other files are not read."""
    path = place(spark, "folder")
    t = table(spark, d, "customer").select(F.col("c_custkey").alias("Entry"), F.lit("reviewed").alias("Reviewed"), F.col("c_mktsegment").alias("segment"))
    segments = sorted(r["segment"] for r in t.select("segment").distinct().collect())  # five
    if not segments:
        return spark.createDataFrame([], "segment string, n long")
    for i, s in enumerate(segments):
        one = f"{path}/part{i}"
        t.filter(F.col("segment") == s).coalesce(1).write.option("sep", "\t").option("header", True).csv(one)
        files.move(spark, files.listed(spark, one, ".csv")[0], f"{path}/{i}.tsv")
        files.remove(spark, one)
    lines(spark.createDataFrame([("no table",)], "value string"), f"{path}/other")
    return S.read_tsv_directory(spark, path, cap=100, reviewed=True).groupBy("segment").agg(F.count("*").alias("n"))


@query("SELECT rec_id, expression.value AS value, CASE WHEN rec_id % 2 = 0 THEN expression.unit END AS unit FROM integrated_test_1")
def io_expression_forms(spark, d) -> DataFrame:
    """Expression given as a struct (even ids) or as a bare number (odd ids)."""
    t = table(spark, d, "integrated_test_1").select("rec_id", "expression")
    text = F.when(F.col("rec_id") % 2 == 0, F.to_json("expression")).otherwise(F.col("expression.value").cast("string"))
    return t.select("rec_id", S.expression_of(text).alias("e")).select("rec_id", "e.value", "e.unit")


@query("SELECT protein_id, sequence, expression.value AS value FROM integrated_test_1")
def io_json_array(spark, d) -> DataFrame:
    """Files that are JSON arrays, found to be arrays by their first character."""
    path = place(spark, "array")
    W.write_json_array(table(spark, d, "integrated_test_1").select(*H.RECORD.names), path)
    return S.read_json_any(spark, path, H.RECORD).select("protein_id", "sequence", "expression.value")


@query(
    """SELECT event_id::INT AS position, event_type <> 'error' AS ok, CASE WHEN event_type <> 'error' THEN -value / 100 END AS evo2_avg_loglik, CASE WHEN event_type <> 'error' AND value > 0 THEN round(log2(value), 6) END AS evo2_bpb,
CASE WHEN event_type <> 'error' THEN round(value / 150, 6) END AS evo2_avg_confidence, CASE WHEN event_type <> 'error' THEN value / 100 END AS evo2_max_confidence, CASE WHEN event_type <> 'error' THEN value / 300 END AS evo2_min_confidence,
CASE WHEN event_type <> 'error' THEN round(abs(value) / 300, 6) END AS evo2_std_confidence FROM events"""
)
def io_lm_results(spark, d) -> DataFrame:
    """Language-model results, events standing for tasks: new statistics and the old form's list
    of two confidences; failed tasks keep their position."""
    v = F.col("value")
    out = F.struct((-v / 100).alias("avg_loglik"), v.alias("perplexity"), F.array(v / 100, v / 300).alias("confidence_scores"))
    t = table(spark, d, "events")
    rows = t.select(F.lit("score").alias("task"), F.when(F.col("event_type") == "error", "error").otherwise("success").alias("status"), out.alias("output"), F.struct(F.concat(F.lit("record_"), F.col("event_id").cast("string")).alias("request_id")).alias("metadata"))
    path = place(spark, "lm")
    W.write_jsonl(rows, path)
    r = S.read_lm_results(spark, path)
    return r.select("position", "ok", "evo2_avg_loglik", r6(F.col("evo2_bpb")).alias("evo2_bpb"), r6(F.col("evo2_avg_confidence")).alias("evo2_avg_confidence"), "evo2_max_confidence", "evo2_min_confidence", r6(F.col("evo2_std_confidence")).alias("evo2_std_confidence"))


@query(
    """SELECT protein_id, CASE WHEN NOT isnan(msa_features.msa_depth) THEN msa_features.msa_depth END AS msa_depth, msa_features.domain_count AS domain_count FROM evolutionary_features WHERE protein_id IS NOT NULL AND msa_features IS NOT NULL
QUALIFY row_number() OVER (PARTITION BY protein_id ORDER BY evo_id DESC) = 1"""
)
def io_keyed_features(spark, d) -> DataFrame:
    """MSA records by protein id; of repeated ids the last line wins."""
    path = place(spark, "msa")
    W.write_jsonl(table(spark, d, "evolutionary_features").select("protein_id", "msa_features", F.col("evo_id").alias("line")), path)
    r = S.keyed_features(S.read_jsonl(spark, path, H.MSA_RECORD))
    return r.select("protein_id", P.number(F.col("msa_features.msa_depth")).alias("msa_depth"), F.col("msa_features.domain_count").alias("domain_count"))


@query(
    """SELECT 'u' || user_id AS query, count(*)::DOUBLE AS msa_depth, count(*) FILTER (value >= 50)::DOUBLE AS msa_effective_depth, round(least(1.0, avg(len(event_type)) / 100), 6) AS msa_coverage, round(avg(value) / 100, 6) AS conservation_mean,
round(stddev_pop(value / 100), 6) AS conservation_entropy_mean FROM events GROUP BY user_id"""
)
def io_alignment_tsv(spark, d) -> DataFrame:
    """Twelve alignment columns without a header, events standing for hits, to hit features."""
    t = table(spark, d, "events")
    zero = [F.lit(0).alias(n) for n in ("mismatch", "gapopen", "qstart", "qend", "tstart", "tend")]
    rows = t.select(F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("query"), F.lit("t").alias("target"), F.col("value").alias("pident"), F.length("event_type").alias("alnlen"), *zero, F.lit(1e-5).alias("evalue"), F.lit(50.0).alias("bits"))
    path = place(spark, "hits")
    rows.write.option("sep", "\t").csv(path)
    h = O.hit_features(S.read_alignment_tsv(spark, path))
    keep = ("msa_coverage", "conservation_mean", "conservation_entropy_mean")
    return h.select("query", "msa_depth", "msa_effective_depth", *[r6(F.col(k)).alias(k) for k in keep])


@query(
    """WITH a AS (SELECT l_linenumber % 2 = 1 AS ca, l_quantity AS b FROM lineitem) SELECT round(avg(b), 6) AS "plDDT_mean", min(b) AS "plDDT_min", round(avg(b) FILTER (ca), 6) AS ca_mean, max(b) FILTER (ca) AS ca_max, round(stddev_pop(b) FILTER (ca), 6) AS ca_std,
quantile_cont(b, 0.25) FILTER (ca) AS ca_q25, round(avg((b < 50)::INT) FILTER (ca), 6) AS ca_below50 FROM a"""
)
def io_pdb(spark, d) -> DataFrame:
    """B-factor statistics of a structure file, line items standing for atoms (odd numbers are
    C-alpha atoms)."""
    t = table(spark, d, "lineitem")
    atom = F.format_string("ATOM  %5d  %-3s ALA A%4d    %8.3f%8.3f%8.3f%6.2f%6.2f", F.lit(1), F.when(F.col("l_linenumber") % 2 == 1, "CA").otherwise("CB"), F.lit(1), F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(1.0), F.col("l_quantity").cast("double"))
    path = place(spark, "pdb")
    lines(t.select(atom.alias("value")).coalesce(1), path)
    r = S.read_pdb(spark, path)
    return r.select(r6(F.col("plDDT_mean")).alias("plDDT_mean"), "plDDT_min", r6(F.col("ca_mean")).alias("ca_mean"), "ca_max", r6(F.col("ca_std")).alias("ca_std"), "ca_q25", r6(F.col("ca_below50")).alias("ca_below50"))


@query(
    """SELECT round(avg(l_quantity), 6) AS plddt_mean, min(l_quantity) AS plddt_min, max(l_quantity) AS plddt_max, round(avg((l_returnflag = 'A')::INT), 6) AS helix_ratio, round(avg((l_returnflag = 'N')::INT), 6) AS sheet_ratio, round(avg((l_returnflag = 'R')::INT), 6) AS coil_ratio
FROM lineitem GROUP BY l_orderkey"""
)
def io_structure_json(spark, d) -> DataFrame:
    """Structure files, an order each: line items are residues, their flags the structure."""
    t = table(spark, d, "lineitem").select("l_orderkey", F.col("l_quantity").cast("double").alias("q"), F.translate("l_returnflag", "ANR", "HEC").alias("ss"))
    rows = t.groupBy("l_orderkey").agg(F.collect_list("q").alias("plddt"), F.array_join(F.collect_list("ss"), "").alias("secondary_structure")).drop("l_orderkey")
    path = place(spark, "structures")
    W.write_json_array(rows, path)
    r = S.read_structure_json(spark, path)
    keep = ("plddt_mean", "helix_ratio", "sheet_ratio", "coil_ratio")
    return r.select(*[r6(F.col(k)).alias(k) if k in keep else F.col(k) for k in r.columns])


@query("SELECT event_id, (json_extract(props, '$.k'))::DOUBLE AS k, 1 AS n FROM events")
def io_numeric_json(spark, d) -> DataFrame:
    """Numeric values of flat JSON objects; what is no number is left out."""
    t = table(spark, d, "events")
    m = S.numeric_json(F.concat(F.left("props", F.length("props") - 1), F.lit(', "note": "x"}')))
    return t.select("event_id", F.try_element_at(m, F.lit("k")).alias("k"), F.size(m).alias("n"))


@query("SELECT count(*) AS n_sequences, sum(length(b))::BIGINT AS n_letters FROM (SELECT nullif(regexp_replace(upper(protein_aa), '[^A-Z]', '', 'g'), '') AS b FROM protein_group) WHERE b IS NOT NULL")
def io_fasta(spark, d) -> DataFrame:
    """Proteins written as FASTA; sequences and letters counted from the file."""
    g = table(spark, d, "protein_group").select("group_id", F.regexp_replace(F.upper("protein_aa"), "[^A-Z]", "").alias("aa"))
    path = place(spark, "fasta")
    W.write_fasta(g, "group_id", "aa", path)
    letters = spark.read.text(path).filter(~F.col("value").startswith(">")).agg(F.sum(F.length("value")).alias("n_letters"))
    return S.msa_depth(spark, path).agg(F.sum("msa_depth").alias("n_sequences")).crossJoin(letters)  # two single rows


BUNDLE = ["plDDT_mean", "tm_segments", "disorder_fraction", "msa_depth", "length", "kd_hydropathy_mean"]


@query("SELECT bundle_id, " + ", ".join(f'"{c}"' for c in BUNDLE) + " FROM feature_bundle")
def io_bundle_json(spark, d) -> DataFrame:
    """Feature bundles through JSON text and back."""
    t = table(spark, d, "feature_bundle")
    text = W.bundle_to_json(F.struct(*[f.name for f in H.BUNDLE.fields]))
    return t.select("bundle_id", S.bundle_from_json(text).alias("b")).select("bundle_id", *[F.col(f"b.{c}").alias(c) for c in BUNDLE])


@query("SELECT s_suppkey::VARCHAR AS s_suppkey, s_name, printf('%.2f', s_acctbal) AS s_acctbal FROM supplier")
def io_csv(spark, d) -> DataFrame:
    """CSV with a header and fixed decimals, read back as text."""
    path = place(spark, "csv")
    W.write_csv(table(spark, d, "supplier").select("s_suppkey", "s_name", "s_acctbal"), path, {"s_acctbal": 2})
    return spark.read.option("header", True).csv(path)


@query("SELECT s_suppkey, s_acctbal + 2 AS s_acctbal FROM supplier")
def io_replace_table(spark, d) -> DataFrame:
    """A table that is read, changed and written over itself, twice."""
    path = place(spark, "replaced")
    W.write_jsonl(table(spark, d, "supplier").select("s_suppkey", "s_acctbal"), path)
    for _ in range(2):
        rows = spark.read.schema("s_suppkey long, s_acctbal double").json(path)
        W.replace_table(rows.withColumn("s_acctbal", F.col("s_acctbal") + 1), path)
    return spark.read.schema("s_suppkey long, s_acctbal double").json(path)


@query("SELECT 'a.tsv' AS name UNION ALL SELECT 'c.tsv' UNION ALL SELECT 'deep/d.tsv'")
def io_discover(spark, d) -> DataFrame:
    """Files by name, pattern and folder, each once."""
    path = place(spark, "found")
    for name in ("a.tsv", "b.txt", "c.tsv", "deep/d.tsv"):
        lines(spark.createDataFrame([("x",)], "value string").coalesce(1), f"{path}/tmp")
        lines(spark.range(0).selectExpr("'x' as value"), f"{path}/deep/tmp")
        files.move(spark, next(f for f in files.listed(spark, f"{path}/tmp", ".txt")), f"{path}/{name}")
    for junk in ("tmp", "deep/tmp"):
        files.remove(spark, f"{path}/{junk}")
    got = S.discover(spark, [path, f"{path}/*.tsv", f"{path}/a.tsv", f"{path}/absent.tsv"], ".tsv")
    return spark.createDataFrame([(g.split(path.split("://")[-1].removeprefix("file:") + "/")[-1],) for g in got], "name string")


@query("SELECT n_nationkey, n_name, CASE WHEN n_nationkey % 3 <> 0 THEN n_nationkey * 2 END AS twice FROM nation")
def io_lookup(spark, d) -> DataFrame:
    """An external lookup with a retry; keys that fail keep nulls (the stand-in fails on each third)."""

    def fetch(key: int) -> dict:
        if key % 3 == 0:
            raise LookupError(key)
        return {"twice": key * 2}

    return S.looked_up(table(spark, d, "nation").select("n_nationkey", "n_name"), "n_nationkey", fetch, "twice int")


@query("SELECT label, count(*) AS n_files, round(max(sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x)))), 3) AS max_l2, max(len(embedding)) AS dim FROM embeddings GROUP BY label")
def io_npz(spark, d) -> DataFrame:
    """Embeddings as NPZ archives of one vector each, read back as dimension and norm."""
    t = table(spark, d, "embeddings").select("vec_id", "label", F.col("embedding").cast("array<double>").alias("e"))

    def pack(batches):
        import io

        import numpy as np
        import pyarrow as pa

        for b in batches:
            out = []
            for e in b.column("e").to_pylist():
                buffer = io.BytesIO()
                np.savez(buffer, mean=np.array(e))
                out.append(buffer.getvalue())
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), b.column("label"), pa.array(out, pa.binary())], names=["vec_id", "label", "content"])

    packed = t.mapInArrow(pack, "vec_id long, label int, content binary")
    norms = S.npz_embeddings(packed.select(F.col("vec_id").cast("string").alias("path"), "content"))
    r = norms.join(t.select(F.col("vec_id").cast("string").alias("file"), "label"), "file")
    return r.groupBy("label").agg(F.count("*").alias("n_files"), F.round(F.max("l2"), 3).alias("max_l2"), F.max("dim").cast("int").alias("dim"))


# --- the pipeline over read records --------------------------------------------------------------


def export(spark, d) -> DataFrame:
    """The records as an export by tab would have them."""
    r = table(spark, d, "integrated_test_1")
    name = {"Entry": "protein_id", "Organism": "metadata.organism", "Subcellular location [CC]": "metadata.subcellular_location", "RefSeq_nn": "sequence", "RefSeq_aa": "protein_aa"}
    return r.select("rec_id", F.when(F.col("metadata.uniprot_id").isNotNull(), "reviewed").alias("Reviewed"), *[F.col(v).alias(k) for k, v in name.items()])


NN, AA = (f"nullif(upper(translate({c}, ' *' || chr(10), '')), '')" for c in ("sequence", "protein_aa"))


@query(
    f"""WITH x AS (SELECT protein_id AS p, {NN} AS nn, {AA} AS aa, metadata.uniprot_id IS NOT NULL AS rev FROM integrated_test_1),
y AS (SELECT CASE WHEN coalesce(trim(p), '') = '' THEN 'no_entry' WHEN nn IS NULL THEN 'no_sequence' WHEN aa IS NULL THEN 'no_protein' WHEN length(nn) % 3 <> 0 THEN 'frame' WHEN abs(length(aa) - length(nn) / 3) > 1 THEN 'length' END AS reject, rev FROM x)
SELECT coalesce(reject, 'ok') AS outcome, count(*) AS n, count(*) FILTER (rev) AS n_reviewed FROM y GROUP BY 1"""
)
def pf_to_records(spark, d) -> DataFrame:
    """Records made from an export, counted by the reason they are rejected for."""
    r = L.to_records(export(spark, d).drop("rec_id"))
    return r.groupBy(F.coalesce("reject", F.lit("ok")).alias("outcome")).agg(F.count("*").alias("n"), F.count_if(F.try_element_at("extra_features", F.lit("reviewed")) == 1).alias("n_reviewed"))


@query(
    f"""WITH x AS (SELECT rec_id, expression.value AS old, lower(coalesce(metadata.subcellular_location, '')) AS loc, length(protein_aa) AS n, extra_features FROM integrated_test_1)
SELECT rec_id, 'relative' AS unit, 'estimated_metadata_only' AS assay, old AS original_value, greatest(10.0, 50 + CASE WHEN regexp_matches(loc, 'cytoplasm|cytosol') THEN 15 ELSE 0 END + CASE WHEN contains(loc, 'ribosome') THEN 30 ELSE 0 END - CASE WHEN contains(loc, 'membrane') THEN 10 ELSE 0 END
 - CASE WHEN regexp_matches(loc, 'secreted|extracellular') THEN 5 ELSE 0 END + CASE WHEN n BETWEEN 100 AND 500 THEN 10 WHEN n < 50 OR n > 1000 THEN -10 ELSE 0 END)::DOUBLE AS value, CASE WHEN contains(loc, 'ribosome') THEN 'medium' ELSE 'low' END AS confidence FROM x"""
)
def pf_modes(spark, d) -> DataFrame:
    """Expression recomputed from annotation only; the former value is kept."""
    t = table(spark, d, "integrated_test_1").withColumn("expression", F.struct(F.col("expression.value").alias("value"), F.lit(None).cast("double").alias("original_value")))
    e = L.enhanced_expression(t, "metadata_only")
    return e.select("rec_id", "expression.unit", "expression.assay", "expression.original_value", "expression.value", "expression.confidence")


@query("SELECT host, count(*) AS n FROM (SELECT * FROM integrated_test_1 WHERE length(protein_aa) BETWEEN 60 AND 300 AND coalesce(expression.confidence, 'high') <> 'low') GROUP BY host")
def pf_merged_datasets(spark, d) -> DataFrame:
    """Datasets found in a folder, read together and filtered by length and confidence."""
    path = place(spark, "sets")
    t = table(spark, d, "integrated_test_1")
    for i in range(2):
        one = t.filter(F.pmod("rec_id", F.lit(2)) == i).withColumn("spelling", F.col("host"))
        W.write_jsonl(one.select(*[F.create_map(F.lit("spelling"), F.lit(0.0)).alias("extra_features") if c == "extra_features" else F.struct(*[F.col("host").alias("organism")]).alias("metadata") if c == "metadata" else F.col(c) for c in H.RECORD.names]), f"{path}/{i}")
        for f in files.listed(spark, f"{path}/{i}", ".json"):
            files.move(spark, f, f"{path}/{i}-{f.rsplit('/', 1)[-1]}l")
    r = L.merged_datasets(spark, [path], ".jsonl", least=60, most=300)
    return r.groupBy(F.col("metadata.organism").alias("host")).agg(F.count("*").alias("n"))


@query("SELECT source_file, count(*) AS n_rows, count(ingested_at) AS n_done, round(count(ingested_at) / count(*), 6) AS share, date_diff('second', min(ingested_at), max(ingested_at)) AS span_s FROM integrated_test_1 GROUP BY source_file")
def ag_progress(spark, d) -> DataFrame:
    """Progress of a load by file: rows, rows done, their share and the time they took."""
    t = table(spark, d, "integrated_test_1").groupBy("source_file").agg(F.count("*").alias("n_rows"), F.count("ingested_at").alias("n_done"), F.min("ingested_at").alias("a"), F.max("ingested_at").alias("b"))
    span = F.unix_timestamp(F.col("b").cast("timestamp")) - F.unix_timestamp(F.col("a").cast("timestamp"))
    return t.select("source_file", "n_rows", "n_done", r6(F.col("n_done") / F.col("n_rows")).alias("share"), span.alias("span_s"))

