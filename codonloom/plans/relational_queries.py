"""Queries of projections, rules, joins, windows, sorts, samples, splits and set operations."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import kernels as K
from ..functions import rules as R
from ..functions.seeded import seeded, sql_seeded
from ..functions.text_norm import protein_key
from ..operators import records as O
from .feature_queries import raw
from .profile_queries import P
from .registry import ORACLE, RECORDS, coding, query, records, sql_protein, table
from .sequence_queries import MOTIFS, r6

VAL = "CASE WHEN NOT isnan(expression.value) THEN expression.value END"


# --- projections and rules -------------------------------------------------------------------


@query(f"WITH {RECORDS} SELECT rec_id, aa, raw AS sequence FROM rec")
def pf_normalize(spark, d) -> DataFrame:
    return records(spark, d).select("rec_id", "aa", F.col("raw").alias("sequence"))


@query(
    f"""WITH {RECORDS} SELECT rec_id, CASE WHEN coalesce(protein_id, '') = '' THEN 'no_entry' WHEN raw IS NULL THEN 'no_sequence' WHEN aa IS NULL THEN 'no_protein' WHEN length(raw) % 3 <> 0 THEN 'frame' WHEN abs(length(aa) - length(raw) / 3) > 1 THEN 'length' END AS reject FROM rec"""
)
def pf_validity(spark, d) -> DataFrame:
    """Why a record is rejected; null for valid ones."""
    r = records(spark, d)
    reject = (
        F.when(F.coalesce("protein_id", F.lit("")) == "", "no_entry").when(F.col("raw").isNull(), "no_sequence").when(F.col("aa").isNull(), "no_protein").when(F.length("raw") % 3 != 0, "frame")
        .when(F.abs(F.length("aa") - F.length("raw") / 3) > 1, "length")
    )
    return r.select("rec_id", reject.alias("reject"))


ORG = " ".join(f"WHEN metadata.organism = '{k}' THEN '{v}'" for k, v in R.SPECIES.items()) + " " + " ".join(f"WHEN contains(lower(metadata.organism), '{k.lower()}') THEN '{v}'" for k, v in R.SPECIES.items())
for _h, _w in (("S_cerevisiae", R.YEASTS), ("Human", R.HUMAN_WORDS), ("Mouse", R.MOUSE_WORDS)):
    ORG += f" WHEN regexp_matches(lower(metadata.organism), '{'|'.join(_w)}') THEN '{_h}'"


@query(f"SELECT rec_id, CASE {ORG} ELSE 'E_coli' END AS mapped_host FROM integrated_test_1")
def pf_organism_host(spark, d) -> DataFrame:
    return table(spark, d, "integrated_test_1").select("rec_id", R.organism_host(F.col("metadata.organism")).alias("mapped_host"))


REV = "(metadata.uniprot_id IS NOT NULL)"
LOC = "lower(coalesce(metadata.subcellular_location, ''))"
EXPR = f"greatest(10.0, 50 + CASE WHEN {REV} THEN 20 ELSE 0 END + CASE WHEN regexp_matches({LOC}, 'cytoplasm|cytosol') THEN 15 ELSE 0 END + CASE WHEN contains({LOC}, 'ribosome') THEN 30 ELSE 0 END - CASE WHEN contains({LOC}, 'membrane') THEN 10 ELSE 0 END - CASE WHEN regexp_matches({LOC}, 'secreted|extracellular') THEN 5 ELSE 0 END + CASE WHEN length(aa) BETWEEN 100 AND 500 THEN 10 WHEN length(aa) < 50 OR length(aa) > 1000 THEN -10 ELSE 0 END)::DOUBLE"
CONF = f"CASE WHEN {REV} OR contains({LOC}, 'ribosome') THEN 'medium' ELSE 'low' END"


@query(f"WITH {RECORDS} SELECT rec_id, {EXPR} AS value, {CONF} AS confidence FROM rec")
def pf_metadata_expression(spark, d) -> DataFrame:
    """Expression from annotation; a record with an accession counts as reviewed."""
    v, c = R.metadata_expression(F.col("metadata.uniprot_id").isNotNull(), F.col("metadata.subcellular_location"), F.length("aa"))
    return records(spark, d).select("rec_id", v.alias("value"), c.alias("confidence"))


@query(
    f"""WITH {RECORDS}, b AS (SELECT rec_id, s, 50 + CASE WHEN {REV} THEN 20 ELSE 0 END AS v, {CONF} AS c FROM cds), l AS (SELECT b.*, lm.score AS conf, lm.avg_loglik AS ll, lm.perplexity AS ppl, lm.score - lm.score * ad.cai < 0.1 AS even, co.gc, h.longest_run FROM b JOIN {raw('sc_adaptation')} ad USING (rec_id) JOIN {raw('sc_usage_lm')} lm USING (rec_id) JOIN {raw('sc_composition')} co USING (rec_id) JOIN {raw('sc_homopolymers')} h USING (rec_id)),
e AS (SELECT *, greatest(10.0, least(100.0, v + 0.3 * (CASE WHEN conf > 0.9 THEN 15 * (conf - 0.9) / 0.1 WHEN conf < 0.7 THEN -15 * (0.7 - conf) / 0.3 ELSE 0 END + CASE WHEN even THEN 5 ELSE 0 END + CASE WHEN ll > -2 THEN 10 * (ll + 2) / 2 WHEN ll < -4 THEN -10 * (-4 - ll) / 2 ELSE 0 END)
+ CASE WHEN ppl < 10 THEN 0.3 * 10 * (10 - ppl) / 8 WHEN ppl > 30 THEN -least(0.3 * 10 * (ppl - 30) / 20, 10) ELSE 0 END)) AS x, CASE WHEN conf > 0.95 OR (even AND c = 'medium') THEN 'high' ELSE c END AS confidence FROM l)
SELECT rec_id, round(x, 6) AS lm_value, confidence, round(greatest(10.0, least(100.0, x + CASE WHEN gc BETWEEN 0.4 AND 0.6 THEN 5 WHEN gc < 0.3 OR gc > 0.7 THEN -5 ELSE 0 END - CASE WHEN longest_run > 8 THEN 10 ELSE 0 END)), 6) AS full_value FROM e"""
)
def pf_enhanced_expression(spark, d) -> DataFrame:
    """Expression enhanced by the usage model's statistics (mode model_enhanced), then by the
    sequence (mode full).  The score is the largest confidence, the score times CAI the least."""
    rows = records(spark, d).filter("raw is not null").withColumn("cs", K.codons(F.col("s")))
    rows = rows.select("rec_id", "s", F.col("metadata.uniprot_id").isNotNull().alias("rev"), F.col("metadata.subcellular_location").alias("loc"), K.codon_facts(F.col("cs"), F.col("host")).alias("f")).withColumn("lm", K.usage_lm(F.col("f")))
    conf = F.when(F.col("rev") | F.lower(F.coalesce("loc", F.lit(""))).contains("ribosome"), "medium").otherwise("low")
    top = F.col("lm.score")
    v, c = R.lm_expression(F.lit(50.0) + F.when(F.col("rev"), 20).otherwise(0), conf, top, top, top * K.cai(F.col("f")), F.col("lm.avg_loglik"), F.col("lm.perplexity"))
    out = rows.select("rec_id", "s", v.alias("x"), c.alias("confidence"))
    return out.select("rec_id", r6(F.col("x")).alias("lm_value"), "confidence", r6(R.sequence_expression(F.col("x"), F.col("s"))).alias("full_value"))


@query(f"WITH {RECORDS} SELECT rec_id FROM rec WHERE length(aa) BETWEEN 50 AND 400 AND metadata.uniprot_id IS NOT NULL AND expression.value >= 20 AND coalesce(expression.confidence, 'high') <> 'low' AND host IN ('E_coli', 'Human')")
def pf_quality_filter(spark, d) -> DataFrame:
    """Length, review, value, confidence (missing counts as high) and target hosts."""
    r = records(spark, d)
    ok = F.length("aa").between(50, 400) & F.col("metadata.uniprot_id").isNotNull() & (F.col("expression.value") >= 20) & (F.coalesce("expression.confidence", F.lit("high")) != "low") & F.col("host").isin("E_coli", "Human")
    return r.filter(ok).select("rec_id")


@query(f"SELECT rec_id, check_message = 'OK' AND coalesce(matches, false) AND sites = 0 AS accepted FROM ({ORACLE['sc_validate_cds']}) JOIN ({ORACLE['sc_translate']}) USING (rec_id) LEFT JOIN (SELECT rec_id AS r, count(*) AS k FROM ({ORACLE['sc_forbidden_sites']}) GROUP BY 1) f ON f.r = rec_id, LATERAL (SELECT coalesce(k, 0) AS sites)")
def pf_constraints(spark, d) -> DataFrame:
    """Valid sequence, exact translation and no forbidden motif."""
    s = F.col("s")
    ok = (K.validate_cds(s) == "OK") & F.coalesce(K.translate(F.col("cs")) == F.col("aa"), F.lit(False)) & (K.motif_hits(s, MOTIFS) == 0)
    return coding(spark, d).select("rec_id", ok.alias("accepted"))


DEV = "abs(gc - 0.5)"


@query(
    f"""SELECT rec_id, round(greatest(0.0, least(100.0, 50 + CASE WHEN cai > 0.8 THEN 25 WHEN cai > 0.6 THEN 15 WHEN cai < 0.4 THEN -20 ELSE 10 * (cai - 0.5) END + CASE WHEN {DEV} < 0.05 THEN 15 WHEN {DEV} < 0.10 THEN 8 WHEN {DEV} > 0.20 THEN -20 ELSE -15 * ({DEV} - 0.1) / 0.1 END
+ CASE WHEN rr.n_runs = 0 THEN 10 ELSE -6 * least(rr.n_runs, 5) END + CASE WHEN h.n_runs = 0 THEN 5 ELSE -4 * least(h.n_runs, 3) END)), 6) AS quality FROM {raw('sc_adaptation')} a JOIN {raw('sc_composition')} c USING (rec_id) JOIN {raw('sc_rare_codon_runs')} rr USING (rec_id) JOIN {raw('sc_homopolymers')} h USING (rec_id)"""
)
def pf_quality_score(spark, d) -> DataFrame:
    rows = coding(spark, d).withColumn("f", K.codon_facts(F.col("cs"), F.col("host")))
    rows = rows.select("rec_id", K.cai(F.col("f")).alias("cai"), K.gc(F.col("s")).alias("gc"), F.size(K.rare_runs(K.rare_flags(F.col("cs"), F.col("host")))).alias("rare"), F.size(K.homopolymers(F.col("s"))).alias("homo"))
    return rows.select("rec_id", r6(R.quality_score(F.col("cai"), F.col("gc"), F.col("rare"), F.col("homo"))).alias("quality"))


@query(
    f"""WITH {RECORDS}, p AS (SELECT rec_id, CASE host WHEN 'E_coli' THEN 'T7' WHEN 'P_pastoris' THEN 'AOX1' WHEN 'S_cerevisiae' THEN 'GAL1' WHEN 'Human' THEN 'CMV' END AS pr, lower(metadata.subcellular_location) AS loc, expression.value AS v FROM rec)
SELECT rec_id, CASE pr WHEN 'T7' THEN 1.0::DOUBLE WHEN 'AOX1' THEN 0.9 WHEN 'GAL1' THEN 0.85 WHEN 'CMV' THEN 0.9 ELSE 0.5 END AS ctx_promoter_strength, 0.5::DOUBLE AS ctx_rbs_strength, 8.0::DOUBLE AS ctx_rbs_spacing, 0.0::DOUBLE AS ctx_kozak_score, 1.0::DOUBLE AS ctx_vector_copy_number,
0.0::DOUBLE AS ctx_has_selection_marker, round((coalesce(v, 37) - 37) / 10, 6) AS ctx_temperature_norm, 0.0::DOUBLE AS ctx_inducer_concentration, 1.0::DOUBLE AS ctx_growth_phase_score,
(CASE trim(loc) WHEN 'cytoplasm' THEN 1.0 WHEN 'periplasm' THEN 0.8 WHEN 'membrane' THEN 0.6 WHEN 'secreted' THEN 0.7 WHEN 'extracellular' THEN 0.7 ELSE 1.0 END)::DOUBLE AS ctx_localization_score FROM p"""
)
def pf_context(spark, d) -> DataFrame:
    """Context features with the host's usual promoter; the value stands for a temperature."""
    r = records(spark, d)
    none = F.lit(None).cast("string")
    pr = F.when(F.col("host") == "E_coli", "T7").when(F.col("host") == "P_pastoris", "AOX1").when(F.col("host") == "S_cerevisiae", "GAL1").when(F.col("host") == "Human", "CMV")
    c = R.context(pr, none, none, none, none, none, F.col("expression.value"), none, none, F.lower("metadata.subcellular_location"))
    return r.select("rec_id", *[r6(v).alias(k) for k, v in c.items()])


MSA = ["msa_depth", "conservation_mean", "coevolution_score"]
LASTEVO = "le AS (SELECT * FROM evolutionary_features WHERE protein_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY protein_id ORDER BY received_at DESC, evo_id DESC) = 1)"


def last_evo(spark, d) -> DataFrame:
    evo = table(spark, d, "evolutionary_features").select("protein_id", "evo_id", "received_at", *[F.col(f"msa_features.{k}").alias(k) for k in MSA])
    return O.last_of(evo, "protein_id", ["received_at", "evo_id"])


@query(f"WITH {LASTEVO} SELECT rec_id, protein_id, " + ", ".join(f"coalesce(extra_features['evo_{k}'], le.msa_features.{k}) AS evo_{k}" for k in MSA) + ", extra_features['codon_gc'] AS codon_gc FROM integrated_test_1 LEFT JOIN le USING (protein_id)")
def pf_family_projection(spark, d) -> DataFrame:
    """A feature family: the record's own value, else the MSA record's, else null."""
    t = table(spark, d, "integrated_test_1").select("rec_id", "protein_id", "extra_features")
    own = lambda k: F.try_element_at("extra_features", F.lit(k))
    return t.join(last_evo(spark, d), "protein_id", "left").select("rec_id", "protein_id", *[F.coalesce(own(f"evo_{k}"), F.col(k)).alias(f"evo_{k}") for k in MSA], own("codon_gc").alias("codon_gc"))


@query(
    """WITH e AS (SELECT rec_id, unnest(map_entries(extra_features), recursive := false) AS e FROM integrated_test_1), s AS (SELECT rec_id, count(*) FILTER (starts_with(e.key, 'struct_')) AS n_struct, count(*) FILTER (starts_with(e.key, 'evo_')) AS n_evo, count(*) AS n_all FROM e GROUP BY rec_id)
SELECT rec_id, coalesce(n_struct, 0)::INT AS n_struct, coalesce(n_evo, 0)::INT AS n_evo, (coalesce(n_all, 0) + 1)::INT AS n_merged FROM integrated_test_1 LEFT JOIN s USING (rec_id)"""
)
def pf_map_merge(spark, d) -> DataFrame:
    """Maps merged with a prefixed one (last wins) and filtered by prefix."""
    more = F.create_map(F.lit("probe"), F.lit(1.0))
    m = O.merged(F.col("extra_features"), O.prefixed(more, "evo2_"))
    t = table(spark, d, "integrated_test_1")
    empty = F.coalesce("extra_features", F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<double>")))
    has = lambda p: F.size(F.map_filter(empty, lambda k, v: k.startswith(p)))
    return t.select("rec_id", has("struct_").alias("n_struct"), has("evo_").alias("n_evo"), F.size(m).alias("n_merged"))


@query(
    f"""WITH {RECORDS} SELECT rec_id, round({EXPR}, 6) AS value, expression.value AS original_value, coalesce(nullif(metadata.subcellular_location, 'nan'), '') AS location, {CONF} AS confidence FROM rec"""
)
def pf_recompute_expression(spark, d) -> DataFrame:
    """Recomputed expression that keeps the former value and turns a NaN location into text."""
    v, c = R.metadata_expression(F.col("metadata.uniprot_id").isNotNull(), F.col("metadata.subcellular_location"), F.length("aa"))
    loc = F.coalesce(F.nullif("metadata.subcellular_location", F.lit("nan")), F.lit(""))
    return records(spark, d).select("rec_id", r6(v).alias("value"), F.col("expression.value").alias("original_value"), loc.alias("location"), c.alias("confidence"))


@query("SELECT evo_id, " + ", ".join(f"CASE WHEN NOT isnan(msa_features.{k}) THEN msa_features.{k} END AS msa_{k}" for k in ("msa_depth", "msa_effective_depth", "msa_coverage", "conservation_mean", "conservation_min", "conservation_max", "conservation_entropy_mean", "coevolution_score", "contact_density", "pfam_count", "domain_count")) + " FROM evolutionary_features")
def pf_flatten(spark, d) -> DataFrame:
    """MSA records as flat columns; NaN counts as missing."""
    t = table(spark, d, "evolutionary_features")
    return t.select("evo_id", *[P.number(F.col(f"msa_features.{f}")).alias(f"msa_{f}") for f in t.schema["msa_features"].dataType.names])


@query("SELECT 'plDDT_mean' AS feature, true AS available UNION ALL SELECT 'msa_depth', true UNION ALL SELECT 'codon_cai', false")
def pf_column_availability(spark, d) -> DataFrame:
    have = set(table(spark, d, "feature_bundle").columns)
    return spark.createDataFrame([(c, c in have) for c in ("plDDT_mean", "msa_depth", "codon_cai")], "feature string, available boolean")


@query(f"SELECT rec_id, round(coalesce(CASE WHEN perplexity > 0 THEN log2(perplexity) END, -avg_loglik / ln(2)), 6) AS bpb FROM {raw('sc_usage_lm')}")
def pf_bpb(spark, d) -> DataFrame:
    """Bits per base: given, else log2 of the perplexity, else from the log likelihood."""
    rows = coding(spark, d).select("rec_id", K.codon_facts(F.col("cs"), F.col("host")).alias("f")).select("rec_id", K.usage_lm(F.col("f")).alias("x"))
    given = F.lit(None).cast("double")
    return rows.select("rec_id", r6(F.coalesce(given, F.when(F.col("x.perplexity") > 0, F.log2("x.perplexity")), -F.col("x.avg_loglik") / F.log(F.lit(2.0)))).alias("bpb"))


@query(
    f"""SELECT rec_id, round(((cai > 0.7)::INT + (fop > 0.5)::INT + (gc BETWEEN 0.35 AND 0.65)::INT + (cpg_obs_exp < 1.5)::INT + (upa_obs_exp < 1.5)::INT + (rr.n_runs = 0)::INT + (h.n_runs = 0)::INT) / 7 * 100, 6) AS checks_pct
FROM {raw('sc_adaptation')} a JOIN {raw('sc_composition')} c USING (rec_id) JOIN {raw('sc_cpg_upa')} du USING (rec_id) JOIN {raw('sc_rare_codon_runs')} rr USING (rec_id) JOIN {raw('sc_homopolymers')} h USING (rec_id)"""
)
def pf_seven_checks(spark, d) -> DataFrame:
    rows = coding(spark, d).withColumn("f", K.codon_facts(F.col("cs"), F.col("host")))
    s = F.col("s")
    rows = rows.select(
        "rec_id", K.cai(F.col("f")).alias("cai"), K.fop(F.col("f")).alias("fop"), K.gc(s).alias("gc"), K.pair_bias(s, "CG")["obs_exp"].alias("cg"), K.pair_bias(s, "TA")["obs_exp"].alias("ta"), F.size(K.rare_runs(K.rare_flags(F.col("cs"), F.col("host")))).alias("r"), F.size(K.homopolymers(s)).alias("h")
    )
    checks = [F.col("cai") > 0.7, F.col("fop") > 0.5, F.col("gc").between(0.35, 0.65), F.col("cg") < 1.5, F.col("ta") < 1.5, F.col("r") == 0, F.col("h") == 0]
    return rows.select("rec_id", r6(sum((c.cast("int") for c in checks), F.lit(0)) / 7 * 100).alias("checks_pct"))


@query("SELECT DISTINCT source, regexp_replace(source, '[^A-Za-z0-9_.-]+', '_', 'g') AS name FROM documents")
def pf_sanitize_name(spark, d) -> DataFrame:
    return table(spark, d, "documents").select("source").distinct().select("source", F.regexp_replace("source", r"[^A-Za-z0-9_.\-]+", "_").alias("name"))


@query(
    f"WITH {RECORDS} SELECT rec_id, list_concat([" + ", ".join(f"(host = '{h}')::INT::DOUBLE" for h in ("E_coli", "Human", "Mouse", "P_pastoris", "S_cerevisiae")) + f", coalesce({VAL}, 0), coalesce(length(aa), 0)::DOUBLE], list_transform(range(57), lambda i: 0.0::DOUBLE)) AS vector FROM rec"
)
def pf_one_hot_vector(spark, d) -> DataFrame:
    """Host one-hot and numbers, padded to 64 places (the key spellings are the canonical ones)."""
    hosts = ("E_coli", "Human", "Mouse", "P_pastoris", "S_cerevisiae")
    head = F.array(*[(F.col("host") == h).cast("double") for h in hosts], F.coalesce(P.number(F.col("expression.value")), F.lit(0.0)), F.coalesce(F.length("aa"), F.lit(0)).cast("double"))
    return records(spark, d).select("rec_id", F.slice(F.concat(head, F.array_repeat(F.lit(0.0), 64)), 1, 64).alias("vector"))


# --- joins -----------------------------------------------------------------------------------


@query(
    f"""WITH {LASTEVO}, b AS (SELECT * FROM feature_bundle QUALIFY row_number() OVER (PARTITION BY protein_id ORDER BY bundle_id DESC) = 1)
SELECT rec_id, CASE WHEN NOT isnan(b.plDDT_mean) THEN b.plDDT_mean END AS struct_plddt_mean, CASE WHEN NOT isnan(le.msa_features.msa_depth) THEN le.msa_features.msa_depth END AS evo_msa_depth, b.protein_id IS NOT NULL AS has_structure, le.protein_id IS NOT NULL AS has_msa FROM integrated_test_1 i LEFT JOIN b USING (protein_id) LEFT JOIN le USING (protein_id)"""
)
def jn_integrate(spark, d) -> DataFrame:
    """Records left-joined with structure and MSA features; of repeated ids the last wins.  The
    build sides grow with the data, so Spark picks the join by their size.  NaN counts as missing."""
    base = table(spark, d, "integrated_test_1").select("rec_id", "protein_id")
    b = O.last_of(table(spark, d, "feature_bundle").select("protein_id", "bundle_id", "plDDT_mean"), "protein_id", ["bundle_id"]).withColumn("has_structure", F.lit(True))
    m = last_evo(spark, d).select("protein_id", "msa_depth", F.lit(True).alias("has_msa"))
    j = base.join(b, "protein_id", "left").join(m, "protein_id", "left")
    return j.select("rec_id", P.number(F.col("plDDT_mean")).alias("struct_plddt_mean"), P.number(F.col("msa_depth")).alias("evo_msa_depth"), F.coalesce("has_structure", F.lit(False)).alias("has_structure"), F.coalesce("has_msa", F.lit(False)).alias("has_msa"))


@query(f"WITH {LASTEVO} SELECT count(le.protein_id) AS matched, count(*) - count(le.protein_id) AS errors FROM integrated_test_1 LEFT JOIN le USING (protein_id)")
def jn_strict(spark, d) -> DataFrame:
    """Strict inner join and the anti side counted as errors."""
    base, m = table(spark, d, "integrated_test_1").select("protein_id"), last_evo(spark, d).select("protein_id")
    inner = base.join(m, "protein_id", "inner").agg(F.count("*").alias("matched"))
    anti = base.join(m, "protein_id", "left_anti").agg(F.count("*").alias("errors"))
    return inner.crossJoin(anti)  # two single rows


@query(f"WITH {RECORDS}, {LASTEVO} SELECT rec_id, coalesce(le.msa_features.msa_depth, length(aa)::DOUBLE) AS depth, le.protein_id IS NOT NULL AS is_real FROM rec LEFT JOIN le USING (protein_id)")
def jn_fallback(spark, d) -> DataFrame:
    """Real features, else a computed one (here the length)."""
    j = records(spark, d).select("rec_id", "protein_id", "aa").join(last_evo(spark, d).select("protein_id", "msa_depth", F.lit(True).alias("real")), "protein_id", "left")
    return j.select("rec_id", F.coalesce("msa_depth", F.length("aa").cast("double")).alias("depth"), F.coalesce("real", F.lit(False)).alias("is_real"))


@query(f"WITH {RECORDS}, k AS (SELECT rec_id, concat_ws('_', protein_id, left(sha256(raw), 16)) AS key FROM cds), c AS (SELECT key, min(rec_id) AS first_id, count(*) AS n FROM k GROUP BY key) SELECT rec_id, key, first_id, n FROM k JOIN c USING (key)")
def jn_content_key(spark, d) -> DataFrame:
    """Join on protein id and content hash (a cache keyed by content)."""
    k = records(spark, d).filter("raw is not null").select("rec_id", O.content_key(F.col("protein_id"), F.col("raw")).alias("key"))
    return k.join(k.groupBy("key").agg(F.min("rec_id").alias("first_id"), F.count("*").alias("n")), "key")


@query("WITH a AS (SELECT rec_id, row_number() OVER (ORDER BY rec_id) - 1 AS i FROM integrated_test_1), b AS (SELECT bundle_id, row_number() OVER (ORDER BY bundle_id) - 1 AS i FROM feature_bundle) SELECT rec_id, bundle_id FROM a LEFT JOIN b USING (i)")
def jn_positional(spark, d) -> DataFrame:
    """Record number i joins result number i; ordinals come from a distributed sort."""
    from ..operators.ordinals import with_ordinal

    a = with_ordinal(table(spark, d, "integrated_test_1").select("rec_id"), ["rec_id"], "i")
    b = with_ordinal(table(spark, d, "feature_bundle").select("bundle_id"), ["bundle_id"], "i")
    return a.join(b, "i", "left").select("rec_id", "bundle_id")


@query("SELECT l_orderkey, a.l_linenumber AS i, b.l_linenumber AS j, (a.l_extendedprice > b.l_extendedprice)::INT AS label FROM lineitem a JOIN lineitem b USING (l_orderkey) WHERE a.l_linenumber < b.l_linenumber AND a.l_extendedprice <> b.l_extendedprice")
def jn_group_pairs(spark, d) -> DataFrame:
    """All unordered pairs within a group (equi key and i < j), labelled by value, ties left out."""
    from ..operators.pairs import group_pairs

    return group_pairs(table(spark, d, "lineitem"), "l_orderkey", "l_linenumber", "l_extendedprice").select("l_orderkey", "i", "j", "label")


@query(
    """WITH h AS (SELECT user_id AS query, count(*)::DOUBLE AS depth, round(avg(value) / 100, 6) AS cons, round(min(value) / 100, 6) AS low, 1.0::DOUBLE AS pfam FROM events GROUP BY user_id)
SELECT c_custkey, coalesce(depth, 0) AS msa_depth, coalesce(cons, 0.5) AS conservation_mean, coalesce(low, 0.3) AS conservation_min, 0.3::DOUBLE AS contact_density, coalesce(pfam, 0) AS pfam_count FROM customer LEFT JOIN h ON query = c_custkey"""
)
def jn_hits_to_records(spark, d) -> DataFrame:
    """Hits aggregated once and joined to records; records without hits take the defaults."""
    h = O.hit_features(table(spark, d, "events").select(F.col("user_id").alias("query"), F.col("value").alias("pident"), F.length("event_type").alias("alnlen")))
    j = table(spark, d, "customer").select("c_custkey").join(h, F.col("c_custkey") == F.col("query"), "left")
    keep = ("msa_depth", "conservation_mean", "conservation_min", "contact_density", "pfam_count")
    return j.select("c_custkey", *[r6(F.coalesce(k, F.lit(O.NO_HITS[k]))).alias(k) for k in keep])


@query("SELECT l_orderkey, l_linenumber AS seq_idx, round(avg(l_extendedprice), 6) AS score, max(o_totalprice) AS truth FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2")
def jn_scores_labels(spark, d) -> DataFrame:
    """Scores averaged per (group, index) beside their label."""
    j = table(spark, d, "lineitem").join(table(spark, d, "orders").withColumnRenamed("o_orderkey", "l_orderkey"), "l_orderkey")
    return j.groupBy("l_orderkey", F.col("l_linenumber").alias("seq_idx")).agg(r6(F.avg("l_extendedprice")).alias("score"), F.max("o_totalprice").alias("truth"))


# --- windows ---------------------------------------------------------------------------------


@query(
    f"""WITH {RECORDS}, b AS (SELECT c.rec_id, c.host, c.aa, length(c.raw) AS n, log2(l.perplexity) AS bpb FROM cds c JOIN {raw('sc_usage_lm')} l USING (rec_id) WHERE c.aa IS NOT NULL) SELECT rec_id, round(median(bpb) OVER w, 6) AS ref_bpb, round(bpb - median(bpb) OVER w, 6) AS delta_bpb, round((bpb - median(bpb) OVER w) * n, 6) AS delta_nll FROM b WINDOW w AS (PARTITION BY aa, host)"""
)
def wn_delta_to_median(spark, d) -> DataFrame:
    """Bits per base against the median of records with the same protein and host.

    The median is aggregated per group and joined back, so that a hot group is no single task."""
    rows = coding(spark, d).filter("aa is not null")
    rows = rows.select("rec_id", "host", F.sha2("aa", 256).alias("g"), F.length("raw").alias("n"), K.codon_facts(F.col("cs"), F.col("host")).alias("f")).withColumn("bpb", F.log2(K.usage_lm(F.col("f"))["perplexity"])).drop("f")
    ref = rows.groupBy("g", "host").agg(F.median("bpb").alias("ref"))
    delta = F.col("bpb") - F.col("ref")
    return rows.join(ref, ["g", "host"]).select("rec_id", r6(F.col("ref")).alias("ref_bpb"), r6(delta).alias("delta_bpb"), r6(delta * F.col("n")).alias("delta_nll"))


@query(
    f"""WITH {RECORDS}, b AS (SELECT c.rec_id, c.host, c.aa, -l.loglik AS nll FROM cds c JOIN {raw('sc_usage_lm')} l USING (rec_id) WHERE c.aa IS NOT NULL), g AS (SELECT aa, host, median(nll) AS ref FROM b GROUP BY aa, host)
SELECT rec_id, round(ref, 6) AS ref_nll, round(nll - ref, 6) AS delta_nll FROM b JOIN g USING (aa, host)"""
)
def wn_nll_delta(spark, d) -> DataFrame:
    """Negative log likelihood against the median of records with the same protein and host."""
    rows = coding(spark, d).filter("aa is not null")
    rows = rows.select("rec_id", "host", F.sha2("aa", 256).alias("g"), K.codon_facts(F.col("cs"), F.col("host")).alias("f")).withColumn("nll", -K.usage_lm(F.col("f"))["loglik"]).drop("f")
    ref = rows.groupBy("g", "host").agg(F.median("nll").alias("ref"))
    return rows.join(ref, ["g", "host"]).select("rec_id", r6(F.col("ref")).alias("ref_nll"), r6(F.col("nll") - F.col("ref")).alias("delta_nll"))


@query(f"WITH {RECORDS}, v AS (SELECT rec_id, host, {VAL} AS x FROM rec) SELECT rec_id, round((x - avg(x) OVER w) / (stddev_pop(x) OVER w + 1e-8), 6) AS z FROM v WINDOW w AS (PARTITION BY host)")
def wn_host_zscore(spark, d) -> DataFrame:
    """Value against its host's mean and population deviation (five groups: joined back)."""
    r = records(spark, d).select("rec_id", "host", P.number(F.col("expression.value")).alias("x"))
    g = r.groupBy("host").agg(F.avg("x").alias("m"), F.stddev_pop("x").alias("s"))
    return r.join(F.broadcast(g), "host").select("rec_id", r6((F.col("x") - F.col("m")) / (F.col("s") + 1e-8)).alias("z"))


@query(f"WITH {RECORDS} SELECT rec_id, row_number() OVER (PARTITION BY aa, host ORDER BY rec_id) - 1 AS seq_idx FROM rec WHERE aa IS NOT NULL")
def wn_group_ordinal(spark, d) -> DataFrame:
    r = records(spark, d).filter("aa is not null").select("rec_id", F.sha2("aa", 256).alias("g"), "host")
    return r.select("rec_id", (F.row_number().over(Window.partitionBy("g", "host").orderBy("rec_id")) - 1).cast("long").alias("seq_idx"))


SPEAR = "r AS (SELECT l_orderkey AS g, rank() OVER (PARTITION BY l_orderkey ORDER BY l_quantity) + (count(*) OVER (PARTITION BY l_orderkey, l_quantity) - 1) / 2 AS a, rank() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice) + (count(*) OVER (PARTITION BY l_orderkey, l_extendedprice) - 1) / 2 AS b FROM lineitem)"


@query(f"WITH {SPEAR} SELECT g AS l_orderkey, count(*) AS n, CASE WHEN var_pop(a) > 0 AND var_pop(b) > 0 THEN round(corr(a, b), 6) END AS spearman FROM r GROUP BY g")
def wn_spearman(spark, d) -> DataFrame:
    from ..operators.evaluate import group_spearman

    return group_spearman(table(spark, d, "lineitem").select("l_orderkey", "l_quantity", "l_extendedprice"), ["l_orderkey"], "l_quantity", "l_extendedprice").withColumn("spearman", r6(F.col("spearman")))


@query(
    """WITH x AS (SELECT l_orderkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice DESC, l_linenumber, l_partkey) AS b, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_quantity DESC, l_linenumber, l_partkey) AS s FROM lineitem), t AS (SELECT l_orderkey, max(CASE WHEN b = 1 THEN s END) AS r, count(*) AS n FROM x GROUP BY 1)
SELECT l_orderkey, (r = 1)::INT AS top1, (r <= 3)::INT AS top3, round(1 / n, 6) AS random1, round(least(1.0, 3 / n), 6) AS random3 FROM t"""
)
def wn_top_hits(spark, d) -> DataFrame:
    from ..operators.evaluate import top_hits

    rows = table(spark, d, "lineitem").select("l_orderkey", F.struct("l_linenumber", "l_partkey").alias("tie"), "l_quantity", "l_extendedprice")
    t = top_hits(rows, ["l_orderkey"], "l_quantity", "l_extendedprice", "tie")
    return t.select("l_orderkey", "top1", "top3", r6(F.col("random1")).alias("random1"), r6(F.col("random3")).alias("random3"))


@query(
    """WITH p AS (SELECT l_orderkey, a.l_linenumber AS i, b.l_linenumber AS j, row_number() OVER (PARTITION BY l_orderkey ORDER BY a.l_linenumber, b.l_linenumber) AS r FROM lineitem a JOIN lineitem b USING (l_orderkey) WHERE a.l_linenumber < b.l_linenumber) SELECT l_orderkey, i, j FROM p WHERE r <= 5"""
)
def wn_capped_pairs(spark, d) -> DataFrame:
    """The first five pairs of each group, in order of their indices (the cap is the feature).

    They lie among the first six members, so only those meet, whatever the size of the group."""
    t = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber")
    t = t.withColumn("n", F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber"))).filter("n <= 6").drop("n")
    p = t.toDF("l_orderkey", "i").join(t.toDF("l_orderkey", "j"), "l_orderkey").filter("i < j")
    return p.withColumn("r", F.row_number().over(Window.partitionBy("l_orderkey").orderBy("i", "j"))).filter("r <= 5").drop("r")


@query(
    """WITH p AS (SELECT a.l_quantity AS x, b.l_quantity AS y, (a.l_extendedprice > b.l_extendedprice)::INT AS win FROM lineitem a JOIN lineitem b USING (l_orderkey) WHERE a.l_linenumber < b.l_linenumber), s AS (SELECT x AS score, win FROM p UNION ALL SELECT y, 1 - win FROM p) SELECT score, count(*) AS n, round(sum(win) / count(*), 6) AS win_rate FROM s GROUP BY score"""
)
def wn_win_rate(spark, d) -> DataFrame:
    t = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice")
    p = t.toDF("k", "i", "x", "px").join(t.toDF("k", "j", "y", "py"), "k").filter("i < j").withColumn("win", (F.col("px") > F.col("py")).cast("int"))
    both = p.select(F.explode(F.array(F.struct(F.col("x").alias("score"), F.col("win")), F.struct(F.col("y").alias("score"), (1 - F.col("win")).alias("win")))).alias("e")).select("e.*")
    return both.groupBy("score").agg(F.count("*").alias("n"), r6(F.sum("win") / F.count("*")).alias("win_rate"))


@query("WITH m AS (SELECT avg(l_extendedprice) AS m, stddev_pop(l_extendedprice) AS s FROM lineitem) SELECT l_orderkey, l_linenumber, round((l_extendedprice - m) / s, 6) AS z FROM lineitem, m")
def wn_standardize(spark, d) -> DataFrame:
    """Global standardisation with the population deviation."""
    t = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice")
    one = t.agg(F.avg("l_extendedprice").alias("m"), F.stddev_pop("l_extendedprice").alias("s"))
    return t.crossJoin(F.broadcast(one)).select("l_orderkey", "l_linenumber", r6(F.try_divide(F.col("l_extendedprice") - F.col("m"), F.col("s"))).alias("z"))  # one row


# --- sort, limit, sample, split --------------------------------------------------------------


@query(f"SELECT rec_id, quality FROM ({ORACLE['pf_quality_score']}) ORDER BY quality DESC, rec_id LIMIT 20")
def tk_top_k(spark, d) -> DataFrame:
    return pf_quality_score(spark, d).orderBy(F.desc("quality"), "rec_id").limit(20)


@query("SELECT o_orderkey, round(abs(o_totalprice - (o_totalprice * 0.9 + 1000)), 4) AS error FROM orders ORDER BY abs(o_totalprice - (o_totalprice * 0.9 + 1000)) DESC, o_orderkey LIMIT 10")
def tk_worst_errors(spark, d) -> DataFrame:
    e = F.abs(F.col("o_totalprice") - (F.col("o_totalprice") * 0.9 + 1000))
    return table(spark, d, "orders").select("o_orderkey", e.alias("e")).orderBy(F.desc("e"), "o_orderkey").limit(10).select("o_orderkey", F.round("e", 4).alias("error"))


@query("SELECT l_orderkey, l_linenumber, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice DESC, l_linenumber) AS rank FROM lineitem")
def tk_predict_and_rank(spark, d) -> DataFrame:
    w = Window.partitionBy("l_orderkey").orderBy(F.desc("l_extendedprice"), "l_linenumber")
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.row_number().over(w).cast("long").alias("rank"))


def _sql_ranked(key: str, seed: int, rows: str = "rec") -> str:
    return f"k AS (SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY {sql_seeded(seed, 'rec_id')}, rec_id) AS r, count(*) OVER (PARTITION BY {key}) AS n FROM {rows})"


@query(f"WITH {RECORDS}, {_sql_ranked('host', 7)} SELECT rec_id, host FROM k WHERE r <= (SELECT min(n) FROM k)")
def tk_balanced_hosts(spark, d) -> DataFrame:
    """As many records of each host as the rarest host has, by seeded hash."""
    r = records(spark, d).select("rec_id", "host")
    counts = {x["host"]: x["n"] for x in r.groupBy("host").agg(F.count("*").alias("n")).collect()}  # five hosts
    return O.take_per_key(r, "host", O.host_quotas(counts, None), 7, "rec_id")


@query(f"WITH {RECORDS}, {_sql_ranked('host', 7)} SELECT rec_id, host FROM k WHERE r <= CASE host WHEN 'E_coli' THEN 80 WHEN 'Human' THEN 60 ELSE 20 END")
def tk_weighted_hosts(spark, d) -> DataFrame:
    r = records(spark, d).select("rec_id", "host")
    counts = {x["host"]: x["n"] for x in r.groupBy("host").agg(F.count("*").alias("n")).collect()}  # five hosts
    # the last host in order of name takes what the shares leave of the total
    return O.take_per_key(r, "host", O.host_quotas(counts, 200, {"E_coli": 0.4, "Human": 0.3, "Mouse": 0.1, "S_cerevisiae": 0.1, "P_pastoris": 0.1}, cap=80), 7, "rec_id")


@query(f"WITH {RECORDS}, {_sql_ranked('host', 3)} SELECT rec_id, host, CASE WHEN r <= floor(0.8 * n) THEN 'train' ELSE 'val' END AS split FROM k")
def tk_stratified_split(spark, d) -> DataFrame:
    """floor(0.8 n) records of each host train, the rest validate, by seeded hash."""
    r = records(spark, d).select("rec_id", "host")
    counts = {x["host"]: x["n"] for x in r.groupBy("host").agg(F.count("*").alias("n")).collect()}  # five hosts
    train = O.take_per_key(r, "host", {h: int(0.8 * n) for h, n in counts.items()}, 3, "rec_id").select("rec_id", F.lit(True).alias("t"))
    return r.join(train, "rec_id", "left").select("rec_id", "host", F.when(F.col("t"), "train").otherwise("val").alias("split"))


@query(f"SELECT rec_id, {sql_seeded(5, 'rec_id')} % 5 AS fold FROM integrated_test_1")
def tk_kfold(spark, d) -> DataFrame:
    return table(spark, d, "integrated_test_1").select("rec_id", F.pmod(seeded(5, "rec_id"), F.lit(5)).alias("fold"))


@query(f"SELECT rec_id, CASE WHEN {sql_seeded(21, 'rec_id')} < 0.2 * (1::BIGINT << 60) THEN 'holdout' ELSE 'fit' END AS part FROM integrated_test_1")
def tk_holdout(spark, d) -> DataFrame:
    """A seeded fifth of the records held out."""
    part = F.when(seeded(21, "rec_id") < F.lit(int(0.2 * (1 << 60))), "holdout").otherwise("fit")
    return table(spark, d, "integrated_test_1").select("rec_id", part.alias("part"))


@query()
def tk_bootstrap_ci(spark, d) -> DataFrame:
    """Percentile interval of a mean over 1000 Poisson bootstraps; resamples are summed in
    parallel, rows are read once."""
    from ..operators.bootstrap import mean_interval

    return mean_interval(records(spark, d).select("host", P.number(F.col("expression.value")).alias("x")), "host", "x", 1000, 0.95, 13)


BAND = f"least(4, greatest(0, floor(coalesce({VAL}, 0) / 20)))::INT"


@query(
    f"""WITH {RECORDS}, x AS (SELECT rec_id, md5(aa || '_' || host) AS grp, {BAND} AS band, {sql_seeded(9, 'rec_id')} AS h FROM rec WHERE aa IS NOT NULL), c AS (SELECT *, count(*) OVER (PARTITION BY grp) AS n, count(*) OVER (PARTITION BY grp, band) AS m, row_number() OVER (PARTITION BY grp, band ORDER BY h, rec_id) AS r FROM x),
q AS (SELECT *, CASE WHEN n <= 4 THEN m ELSE least(m, greatest(1, floor(4 * m / n))) END AS quota FROM c), t AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY r > quota, h, rec_id) AS place FROM q) SELECT grp, rec_id, band FROM t WHERE place <= 4"""
)
def tk_stratified_cap(spark, d) -> DataFrame:
    """At most four records of each (protein, host) group, spread over five expression bands by
    their share and topped up from the rest of the group."""
    band = F.least(F.lit(4), F.greatest(F.lit(0), F.floor(F.coalesce(P.number(F.col("expression.value")), F.lit(0.0)) / 20))).cast("int")
    r = records(spark, d).filter("aa is not null").select(F.md5(F.concat("aa", F.lit("_"), "host")).alias("grp"), "rec_id", band.alias("band"))
    return O.stratified_cap(r, ["grp"], "band", 4, 9, "rec_id").select("grp", "rec_id", "band")


@query(
    f"""WITH {RECORDS}, x AS (SELECT rec_id, host, {BAND} AS band, {sql_seeded(9, 'rec_id')} AS h FROM rec), c AS (SELECT *, count(*) OVER (PARTITION BY host) AS n, count(*) OVER (PARTITION BY host, band) AS m, row_number() OVER (PARTITION BY host, band ORDER BY h, rec_id) AS r FROM x),
q AS (SELECT *, CASE WHEN n <= 40 THEN m ELSE least(m, greatest(1, floor(40 * m / n))) END AS quota FROM c), t AS (SELECT *, row_number() OVER (PARTITION BY host ORDER BY r > quota, h, rec_id) AS place FROM q) SELECT host, rec_id, band FROM t WHERE place <= 40"""
)
def tk_host_cap(spark, d) -> DataFrame:
    """The same cap of 40 records a host: groups that hold a large part of all rows."""
    band = F.least(F.lit(4), F.greatest(F.lit(0), F.floor(F.coalesce(P.number(F.col("expression.value")), F.lit(0.0)) / 20))).cast("int")
    r = records(spark, d).select("host", "rec_id", band.alias("band"))
    return O.stratified_cap(r, ["host"], "band", 40, 9, "rec_id").select("host", "rec_id", "band")


# --- set operations --------------------------------------------------------------------------


@query("SELECT protein_id, 'bundle' AS species FROM feature_bundle UNION ALL SELECT protein_id, 'evo' FROM evolutionary_features")
def st_union_sources(spark, d) -> DataFrame:
    a = table(spark, d, "feature_bundle").select("protein_id", F.lit("bundle").alias("species"))
    return a.unionByName(table(spark, d, "evolutionary_features").select("protein_id", F.lit("evo").alias("species")), allowMissingColumns=True)


@query(f"WITH {RECORDS} SELECT md5(raw) AS dna, min(rec_id) AS rec_id FROM cds GROUP BY raw")
def st_dedup(spark, d) -> DataFrame:
    return records(spark, d).filter("raw is not null").groupBy("raw").agg(F.min("rec_id").alias("rec_id")).select(F.md5("raw").alias("dna"), "rec_id")


@query("SELECT protein_id FROM feature_bundle WHERE protein_id IS NOT NULL UNION SELECT protein_id FROM evolutionary_features WHERE protein_id IS NOT NULL")
def st_key_union(spark, d) -> DataFrame:
    a, b = (table(spark, d, t).select("protein_id").dropna() for t in ("feature_bundle", "evolutionary_features"))
    return a.union(b).distinct()


@query(
    """WITH r AS (SELECT l_orderkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_quantity DESC, l_linenumber, l_partkey) AS a, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice DESC, l_linenumber, l_partkey) AS b FROM lineitem)
SELECT l_orderkey, (count(*) FILTER (a <= 3 AND b <= 3))::INT AS n_shared FROM r GROUP BY 1"""
)
def st_topk_intersection(spark, d) -> DataFrame:
    t = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_extendedprice")
    w = Window.partitionBy("l_orderkey")
    tie = ("l_linenumber", "l_partkey")
    r = t.withColumn("a", F.row_number().over(w.orderBy(F.desc("l_quantity"), *tie))).withColumn("b", F.row_number().over(w.orderBy(F.desc("l_extendedprice"), *tie)))
    return r.groupBy("l_orderkey").agg(F.count_if((F.col("a") <= 3) & (F.col("b") <= 3)).cast("int").alias("n_shared"))


@query("WITH n AS (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1), s AS (SELECT CASE WHEN n = 1 THEN '1' WHEN n <= 3 THEN '2-3' WHEN n <= 6 THEN '4-6' ELSE '7+' END AS stratum, n FROM n) SELECT stratum, count(*) AS n_groups, sum(n)::BIGINT AS n_rows FROM s GROUP BY 1 UNION ALL SELECT '4+', count(*), sum(n)::BIGINT FROM s WHERE stratum IN ('4-6', '7+')")
def st_strata_union(spark, d) -> DataFrame:
    n = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("n"))
    s = n.withColumn("stratum", F.when(F.col("n") == 1, "1").when(F.col("n") <= 3, "2-3").when(F.col("n") <= 6, "4-6").otherwise("7+"))
    g = s.groupBy("stratum").agg(F.count("*").alias("n_groups"), F.sum("n").alias("n_rows"))
    joint = g.filter(F.col("stratum").isin("4-6", "7+")).agg(F.sum("n_groups").alias("n_groups"), F.sum("n_rows").alias("n_rows")).select(F.lit("4+").alias("stratum"), "n_groups", "n_rows")
    return g.unionByName(joint)


