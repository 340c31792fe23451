"""The feature pipeline as one lazy chain: table rows to records to features to enriched records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import kernels as K
from ..functions import rules as R
from ..functions.hosts import host_key
from ..functions.text_norm import protein_key, sequence_key
from ..operators import records as O
from ..sources.readers import discover, read_many
from ..sources.schemas import EXPRESSION, FEATURES, RECORD

MODES = ("metadata_only", "model_enhanced", "full")
# The feature families by key prefix.
FAMILIES = {"codon": "codon_", "struct": "struct_", "evo": "evo_", "ctx": "ctx_", "evo2": "evo2_"}


def to_records(tsv: DataFrame, reviewed_only: bool = False) -> DataFrame:
    """Base records from a UniProt-style export (all columns text), with ``reject``: why a row is
    no valid record (null for valid ones), so that counts and rows come from one pass.

    The id is the first of entry, RefSeq id and genome id that is not empty; sequences keep a
    terminal stop codon; the length is the stated one if it is a number, else the protein's."""

    def col(name: str) -> Column:
        return F.col(f"`{name}`") if name in tsv.columns else F.lit(None).cast("string")

    some = lambda c: F.nullif(F.trim(c), F.lit(""))
    nn, aa = F.upper(F.translate(col("RefSeq_nn"), " *\n", "")), F.upper(F.translate(col("RefSeq_aa"), " *\n", ""))
    n = F.coalesce(col("Length").try_cast("int"), F.length(aa))
    reviewed = F.lower(F.coalesce(col("Reviewed"), F.lit(""))) == "reviewed"
    value, confidence = R.metadata_expression(reviewed, col("Subcellular location [CC]"), n)
    meta = {
        "uniprot_id": "Entry", "entry_name": "Entry Name", "protein_names": "Protein names", "gene_names": "Gene Names", "organism": "Organism", "subcellular_location": "Subcellular location [CC]", "refseq_id": "RefSeq_id", "genome_id": "Genome_id",
    }
    reject = (
        F.when(some(col("Entry")).isNull(), "no_entry").when(F.coalesce(F.length(nn), F.lit(0)) == 0, "no_sequence").when(F.coalesce(F.length(aa), F.lit(0)) == 0, "no_protein")
        .when(F.length(nn) % 3 != 0, "frame").when(F.abs(F.length(aa) - F.length(nn) / 3) > 1, "length")
    )
    if reviewed_only:
        reject = F.when(~reviewed, "not_reviewed").otherwise(reject)
    return tsv.select(
        F.coalesce(some(col("Entry")), some(col("RefSeq_id")), some(col("Genome_id"))).alias("protein_id"), nn.alias("sequence"), aa.alias("protein_aa"), R.organism_host(col("Organism")).alias("host"),
        F.struct(value.alias("value"), F.lit("relative").alias("unit"), F.lit("metadata_heuristic").alias("assay"), confidence.alias("confidence"), F.lit(None).cast("double").alias("original_value")).alias("expression"),
        F.create_map(F.lit("length"), n.cast("double"), F.lit("reviewed"), reviewed.cast("double")).alias("extra_features"), F.struct(*[col(v).alias(k) for k, v in meta.items()]).alias("metadata"), reject.alias("reject"),
    )


def as_map(columns: dict[str, Column], prefix: str) -> Column:
    return F.map_filter(F.create_map(*[x for k, c in columns.items() for x in (F.lit(k if k.startswith(prefix) else prefix + k), c.cast("double"))]), lambda _, v: v.isNotNull())


def codon_features(rows: DataFrame, strip_stop: bool = True, strict: bool = False) -> DataFrame:
    """``rows`` with ``codon`` features as a map.  partial: composition always, adaptation for
    valid sequences; strict: an empty map for invalid ones."""
    s = K.without_stop(sequence_key("sequence")) if strip_stop else sequence_key("sequence")
    r = rows.withColumns({"_s": s, "_h": F.coalesce(host_key("host"), F.lit("E_coli"))}).withColumn("_cs", K.codons(F.col("_s")))
    r = r.withColumns({"_f": K.codon_facts(F.col("_cs"), F.col("_h")), "_ok": F.coalesce(K.validate_cds(F.col("_s")) == "OK", F.lit(False)), "_cg": K.pair_bias(F.col("_s"), "CG"), "_ta": K.pair_bias(F.col("_s"), "TA"), "_runs": K.rare_runs(K.rare_flags(F.col("_cs"), F.col("_h"))), "_homo": K.homopolymers(F.col("_s"))})
    f, ok = F.col("_f"), F.col("_ok")
    cols = {
        "gc": K.gc(F.col("_s")), "cpb": K.codon_pair_bias(F.col("_cs"), F.col("_h")), "cpg_count": F.col("_cg.count"), "cpg_freq": F.col("_cg.freq"), "cpg_obs_exp": F.col("_cg.obs_exp"), "upa_count": F.col("_ta.count"), "upa_freq": F.col("_ta.freq"), "upa_obs_exp": F.col("_ta.obs_exp"),
        "rare_runs_count": F.size("_runs"), "rare_runs_length": F.length(F.array_join("_runs", "")), "homopolymers_count": F.size("_homo"), "homopolymers_length": F.length(F.array_join("_homo", "")),
        "cai": F.when(ok, K.cai(f)), "tai": F.when(ok, K.tai(f)), "fop": F.when(ok, K.fop(f)), "cps": F.when(ok, F.lit(0.0)),
    }
    has = F.col("_s").isNotNull() & (ok if strict else F.lit(True))
    empty = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<double>"))
    return r.withColumn("codon", F.when(has, as_map(cols, "codon_")).otherwise(empty)).drop("_s", "_h", "_cs", "_f", "_ok", "_cg", "_ta", "_runs", "_homo")


def context_features(metadata: Column, fields: list[str]) -> Column:
    """Context map from a metadata struct with whichever of the context fields it has."""

    def get(name: str) -> Column:
        return metadata[name].cast("string") if name in fields else F.lit(None).cast("string")

    c = R.context(get("promoter"), get("rbs"), get("rbs_spacing"), get("kozak_score"), get("copy_number"), get("has_marker"), get("temperature"), get("inducer_conc"), get("growth_phase"), get("localization"))
    return as_map(c, "ctx_")


def integrated(records: DataFrame, structure: DataFrame | None = None, msa: DataFrame | None = None) -> DataFrame:
    """Records with all feature families in ``extra_features``.

    structure and msa: ``protein_id`` and a map ``features`` (of repeated ids the last ``line``
    wins); where a record has none, the sequence proxies stand in.  Former extras are kept."""
    rows = records.withColumn("_aa", protein_key("protein_aa"))
    for name, table in (("_st", structure), ("_ev", msa)):
        if table is None:
            rows = rows.withColumn(name, F.lit(None).cast(FEATURES))
        else:
            one = O.last_of(table, "protein_id", ["line"]).select("protein_id", F.col("features").alias(name))
            rows = rows.join(one, "protein_id", "left")
    have = rows.columns
    lite = R.structure(rows, "_aa")
    keys = [c for c in lite.columns if c not in have]
    rows = lite.withColumn("_lite_st", as_map({k: F.col(k) for k in keys}, "struct_")).drop(*keys)
    have = rows.columns
    lite = R.evolution(rows, "_aa")
    keys = [c for c in lite.columns if c not in have]
    rows = lite.withColumn("_lite_ev", F.when(F.col("_aa").isNotNull(), as_map({k: F.col(k) for k in keys}, "evo_"))).drop(*keys)
    rows = codon_features(rows)
    meta = rows.schema["metadata"].dataType.names if "metadata" in rows.columns else []
    ctx = context_features(F.col("metadata") if meta else F.lit(None), meta)
    parts = [F.col("extra_features"), F.coalesce(O.prefixed(F.col("_st"), "struct_"), F.col("_lite_st")), F.coalesce(O.prefixed(F.col("_ev"), "evo_"), F.col("_lite_ev")), ctx, F.col("codon")]
    return rows.withColumn("extra_features", O.merged(*parts)).drop("_aa", "_st", "_ev", "_lite_st", "_lite_ev", "codon")


def enhanced_expression(rows: DataFrame, mode: str = "model_enhanced") -> DataFrame:
    """Expression recomputed with provenance: metadata only, with language-model statistics
    (``evo2_`` features), or with the sequence too.  The former value becomes original_value."""
    if mode not in MODES:
        raise ValueError(f"unknown mode {mode}")
    x = lambda k: F.try_element_at("extra_features", F.lit(k))
    reviewed = F.coalesce(x("reviewed") == 1, F.lit(False))
    value, conf = R.metadata_expression(reviewed, F.col("metadata.subcellular_location"), F.coalesce(x("length").cast("int"), F.length("protein_aa")))
    out = rows.withColumns({"_v": value, "_c": conf})
    if mode != "metadata_only":
        v, c = R.lm_expression(F.col("_v"), F.col("_c"), x("evo2_avg_confidence"), x("evo2_max_confidence"), x("evo2_min_confidence"), x("evo2_avg_loglik"), x("evo2_perplexity"))
        out = out.withColumns({"_w": v, "_d": c}).withColumns({"_v": F.col("_w"), "_c": F.col("_d")}).drop("_w", "_d")
    if mode == "full":
        out = out.withColumn("_v", F.coalesce(R.sequence_expression(F.col("_v"), sequence_key("sequence")), F.col("_v")))
    new = F.struct(F.col("_v").alias("value"), F.lit("relative").alias("unit"), F.lit(f"estimated_{mode}").alias("assay"), F.col("_c").alias("confidence"), F.coalesce(F.col("expression.original_value"), F.col("expression.value")).alias("original_value"))
    return out.withColumn("expression", new.cast(EXPRESSION)).drop("_v", "_c")


def with_lm_results(rows: DataFrame, results: DataFrame, position: str) -> DataFrame:
    """Records with the ``evo2_`` statistics of their position's result; failed results add
    nothing."""
    names = [c for c in results.columns if c.startswith("evo2_")]
    m = results.filter("ok").select(F.col("position").alias(position), as_map({n: F.col(n) for n in names}, "evo2_").alias("_lm"))
    return rows.join(m, position, "left").withColumn("extra_features", O.merged(F.col("extra_features"), F.col("_lm"))).drop("_lm")


def selective_refresh(rows: DataFrame) -> DataFrame:
    """Everything recomputed but the ``evo2_`` features, which stay as they are (a top-level
    column of that name wins over the map)."""
    top = [c for c in rows.columns if c.startswith("evo2_")]
    kept = F.map_filter(F.coalesce("extra_features", F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<double>"))), lambda k, _: k.startswith("evo2_") | k.isin("reviewed", "length"))
    base = rows.withColumn("extra_features", O.merged(kept, as_map({c: F.col(c) for c in top}, "evo2_")) if top else kept)
    return enhanced_expression(integrated(base), "model_enhanced")


def family(rows: DataFrame, names: list[str], keys: list[str]) -> DataFrame:
    """Identity columns and the keys of the named families; keys a record lacks are null."""
    wanted = [k for k in keys if any(k.startswith(FAMILIES[n]) for n in names)]
    ident = [c for c in ("protein_id", "host", "sequence", "protein_aa", "expression") if c in rows.columns]
    return rows.select(*ident, *[F.try_element_at("extra_features", F.lit(k)).alias(k) for k in wanted])


def complete(tsv: DataFrame, mode: str = "model_enhanced", structure: DataFrame | None = None, msa: DataFrame | None = None) -> DataFrame:
    """The whole chain: valid records with all features and expression; nothing is materialised."""
    return enhanced_expression(integrated(to_records(tsv).filter("reject is null").drop("reject"), structure, msa), mode)


def merged_datasets(spark: SparkSession, inputs: list[str], suffix: str = ".jsonl", hosts: list[str] | None = None, least: int = 50, most: int = 10_000, balance: bool = False, total: int | None = None, seed: int = 7) -> DataFrame:
    """Datasets loaded, filtered and (by request) balanced over hosts."""
    rows = read_many(spark, discover(spark, inputs, suffix), RECORD).withColumn("host", F.coalesce(host_key("host"), F.lit("E_coli")))
    rows = rows.filter(F.length("protein_aa").between(least, most) & (F.coalesce("expression.confidence", F.lit("high")) != "low"))
    if hosts:
        rows = rows.filter(F.col("host").isin(hosts))
    if not balance:
        return rows
    counts = {r["host"]: r["n"] for r in rows.groupBy("host").agg(F.count("*").alias("n")).collect()}  # five hosts
    return O.take_per_key(rows, "host", O.host_quotas(counts, total), seed, "sequence")
