"""Queries of the protein proxies, composite scores and rules over the integrated records."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import kernels as K
from ..functions import rules as R
from ..functions.text_norm import protein_key
from .registry import CODONS, DIM, ORACLE, RECORDS, RESIDUES, coding, query, records, spread, sql_protein, table
from .sequence_queries import MOTIFS, r6


def r9(c):
    """Nine digits: means of two-decimal scales would often lie on a tie at six."""
    return F.round(c, 9)


def raw(name: str) -> str:
    """An oracle as a subquery without its rounding."""
    return "(" + ORACLE[name].replace("round(", "(").replace(", 6)", ")") + ")"


DIS = "greatest(0.0, least(1.0, dis))"
PLM = f"greatest(50.0, least(95.0, 90 - {DIS} * 40 + cx * 5))"
STD = f"(8 + {DIS} * 15)"
TM = "len(list_filter(range(1, greatest(length(aa) - 18, 1)), lambda i: length(regexp_replace(substr(aa, i::INT, 20), '[^IVLF]', '', 'g')) / 20 > 0.7))"


@query(
    f"""WITH {RESIDUES} SELECT rec_id, round({PLM}, 9) AS plddt_mean, round(greatest(30.0, {PLM} - 2 * {STD}), 9) AS plddt_min, round(least(100.0, {PLM} + {STD}), 9) AS plddt_max, round({STD}, 9) AS plddt_std,
round({PLM} - 0.67 * {STD}, 9) AS plddt_q25, round({PLM} + 0.67 * {STD}, 9) AS plddt_q75, round({DIS}, 9) AS disorder_ratio, round({DIS} * 0.4, 9) AS flexible_ratio, round(hel / (hel + she + 1), 9) AS helix_ratio,
round(she / (hel + she + 1), 9) AS sheet_ratio, round(1 / (hel + she + 1), 9) AS coil_ratio, 120.0::DOUBLE AS sasa_mean, length(aa) * 120.0::DOUBLE AS sasa_total, round(length(regexp_replace(aa, '[^RNDQEHKSTY]', '', 'g')) / length(aa), 9) AS sasa_polar_ratio,
(length(aa) >= 20 AND length(regexp_replace(left(aa, 20), '[^IVLFC]', '', 'g')) / 20 > 0.5)::INT::DOUBLE AS has_signal_peptide, ({TM} > 0)::INT::DOUBLE AS has_transmembrane, {TM}::DOUBLE AS tm_helix_count FROM base"""
)
def sc_structure_lite(spark, d) -> DataFrame:
    rows = spread(records(spark, d).filter("aa is not null").select("rec_id", "aa"))
    out = R.structure(rows)
    return out.select("rec_id", *[F.round(k, 9).alias(k) for k in out.columns[2:]])


CONS = "greatest(0.4, least(0.95, con * 0.5 + sim * 0.3 + cx * 0.2))"
DEPTH = f"greatest(20.0, least(500.0, 100 * (1 + 0.2 * log10(length(aa) / 100)) * (0.5 + cx) * (0.7 + 0.6 * {CONS})))"


@query(
    f"""WITH {RESIDUES}, pos AS (SELECT rec_id, i, substr(aa, i::INT, 1) AS r FROM (SELECT rec_id, aa, unnest(range(1, length(aa) + 1)) AS i FROM prot)),
br AS (SELECT a.rec_id, count(*) AS k FROM pos a JOIN pos b ON a.rec_id = b.rec_id AND a.r IN ('R', 'K') AND b.r IN ('D', 'E') AND abs(a.i - b.i) <= 10 GROUP BY a.rec_id)
SELECT rec_id, round({DEPTH}, 6) AS msa_depth, round({DEPTH} * 0.8, 6) AS msa_effective_depth, 0.95::DOUBLE AS msa_coverage, round({CONS}, 6) AS conservation_mean, round(greatest(0.2, {CONS} - 0.3), 6) AS conservation_min, round(least(1.0, {CONS} + 0.25), 6) AS conservation_max,
round(1 - h / log2(20), 6) AS conservation_entropy_mean, round(CASE WHEN length(aa) < 10 THEN 0.3 ELSE 0.3 + 0.4 * least(1.0, coalesce(k, 0) / (length(aa) * 0.1)) END, 6) AS coevolution_score,
(CASE WHEN length(aa) < 50 THEN 0.5 WHEN length(aa) < 200 THEN 0.35 ELSE 0.25 END)::DOUBLE AS contact_density, (CASE WHEN length(aa) > 100 THEN greatest(0, greatest(1, length(aa) // 150) - 1) ELSE 0 END)::DOUBLE AS pfam_count, greatest(1, length(aa) // 150)::DOUBLE AS domain_count
FROM base LEFT JOIN br USING (rec_id)"""
)
def sc_evolution_lite(spark, d) -> DataFrame:
    rows = spread(records(spark, d).filter("aa is not null").select("rec_id", "aa"))
    out = R.evolution(rows)
    return out.select("rec_id", *[r6(F.col(k)).alias(k) for k in out.columns[2:]])


@query(f"WITH {RESIDUES} SELECT rec_id, round(kd, 9) AS kd_hydropathy_mean, round(h, 9) AS entropy, round(cx, 9) AS complexity, round(dis, 9) AS disorder FROM base")
def sc_protein_composition(spark, d) -> DataFrame:
    rows = records(spark, d).filter("aa is not null").select("rec_id", K.residue_counts(F.col("aa")).alias("c"), F.length("aa").alias("n"))
    c, n = F.col("c"), F.col("n")
    return rows.select(
        "rec_id", r9(K.scale_mean(c, n, "hydropathy", 0.0)).alias("kd_hydropathy_mean"), r9(K.entropy(c, n)).alias("entropy"), r9(K.complexity(c, n)).alias("complexity"), r9(K.scale_mean(c, n, "disorder", 0.5)).alias("disorder")
    )


@query(
    """WITH v AS (SELECT protein_id, extra_features['struct_plddt_mean'] AS x FROM integrated_test_1), u AS (SELECT protein_id, x FROM v WHERE x > 0 AND x <= 100 AND NOT isnan(x)), g AS (SELECT protein_id, list_sort(list(x)) AS l, count(*) AS n, avg(x) AS m FROM u GROUP BY protein_id),
q AS (SELECT *, (n + 1) * 0.25 AS a, (n + 1) * 0.75 AS b FROM g WHERE n >= 2)
SELECT protein_id, n, round(m, 6) AS plddt_mean, CASE WHEN m >= 90 THEN 'very_high' WHEN m >= 70 THEN 'confident' WHEN m >= 50 THEN 'low' ELSE 'very_low' END AS confidence,
round(l[least(greatest(floor(a), 1), n - 1)::INT] + (a - least(greatest(floor(a), 1), n - 1)) * (l[least(greatest(floor(a), 1), n - 1)::INT + 1] - l[least(greatest(floor(a), 1), n - 1)::INT]), 6) AS q25,
round(l[least(greatest(floor(b), 1), n - 1)::INT] + (b - least(greatest(floor(b), 1), n - 1)) * (l[least(greatest(floor(b), 1), n - 1)::INT + 1] - l[least(greatest(floor(b), 1), n - 1)::INT]), 6) AS q75 FROM q"""
)
def sc_plddt_class(spark, d) -> DataFrame:
    """Per protein with two or more usable pLDDT values: class and exclusive quartiles."""
    from .data_quality import usable_plddt

    v = table(spark, d, "integrated_test_1").select("protein_id", usable_plddt(F.try_element_at("extra_features", F.lit("struct_plddt_mean"))).alias("x")).dropna()
    g = v.groupBy("protein_id").agg(F.sort_array(F.collect_list("x")).alias("l"), F.count("*").alias("n"), F.avg("x").alias("m")).filter("n >= 2")

    def quartile(p: float):
        at = (F.col("n") + 1) * p
        j = F.least(F.greatest(F.floor(at), F.lit(1)), F.col("n") - 1).cast("int")
        return F.get("l", j - 1) + (at - j) * (F.get("l", j) - F.get("l", j - 1))

    m = F.col("m")
    return g.select(
        "protein_id", "n", r6(m).alias("plddt_mean"), F.when(m >= 90, "very_high").when(m >= 70, "confident").when(m >= 50, "low").otherwise("very_low").alias("confidence"), r6(quartile(0.25)).alias("q25"), r6(quartile(0.75)).alias("q75")
    )


def rules_terms(rows: DataFrame) -> DataFrame:
    """``rows`` (rec_id, host, aa, s, cs, plDDT_mean, msa_depth, conservation_mean,
    kd_hydropathy_mean) of valid sequences with one column per term of the rules score."""
    s, cs, host = F.col("s"), F.col("cs"), F.col("host")
    rows = rows.withColumns({"f": K.codon_facts(cs, host), "w": K.sliding_gc(s), "pb": K.pair_bias(s, "CG"), "ub": K.pair_bias(s, "TA")})
    rows = rows.withColumn("lm", K.usage_lm(F.col("f"))["score"])
    f = F.col("f")
    return rows.select(
        "rec_id",
        K.clamp(F.col("lm"), 0, 1).alias("lm_host"),
        F.when(K.translate(cs) == F.col("aa"), K.clamp(F.col("lm"), 0, 1)).otherwise(0.0).alias("lm_cond"),
        K.cai(f).alias("cai"),
        K.tai(f).alias("tai"),
        K.fop(f).alias("fop"),
        R.gc_term(K.gc(s)).alias("gc"),
        R.window_gc_term(F.col("w")).alias("win_gc"),
        (1 / (1 + F.exp(-K.five_prime_structure(s) / 3))).alias("struct5"),
        K.motif_hits(s, MOTIFS).cast("double").alias("forbidden"),
        F.length(F.array_join(K.rare_runs(K.rare_flags(F.col("cs"), F.col("host"))), "")).cast("double").alias("rare_runs"),
        F.length(F.array_join(K.homopolymers(s), "")).cast("double").alias("homopoly"),
        K.codon_pair_bias(cs, host).alias("cpb"),
        F.greatest(F.lit(0.0), F.col("pb.obs_exp") - 1).alias("cpg_penalty"),
        F.greatest(F.lit(0.0), F.col("ub.obs_exp") - 1).alias("upa_penalty"),
        R.structure_term(F.col("plDDT_mean"), F.col("msa_depth"), F.col("conservation_mean"), F.col("kd_hydropathy_mean")).alias("feat_struct"),
    )


def _cl(x: str) -> str:
    return f"greatest(0.0, least(1.0, {x}))"


@query(
    f"""WITH {RECORDS}, b AS (SELECT protein_id, min(plDDT_mean) AS pl, min(msa_depth) AS md, min(conservation_mean) AS cm, min(kd_hydropathy_mean) AS kd FROM feature_bundle GROUP BY protein_id), ok AS (SELECT c.rec_id, c.aa, b.* EXCLUDE (protein_id) FROM cds c LEFT JOIN b USING (protein_id) JOIN {raw('sc_validate_cds')} v ON v.rec_id = c.rec_id WHERE v.check_message = 'OK'),
w AS (SELECT rec_id, 1 - count(*) FILTER (g < 0.30 OR g > 0.70) / count(*) AS wg FROM (SELECT rec_id, length(regexp_replace(substr(s, i::INT + 1, 50), '[^GC]', '', 'g')) / 50 AS g FROM (SELECT rec_id, s, unnest(range(0, length(s) - 49, 10)) AS i FROM cds WHERE length(s) >= 50)) GROUP BY rec_id),
fs AS (SELECT rec_id, count(*) AS k FROM {raw('sc_forbidden_sites')} GROUP BY rec_id)
SELECT ok.rec_id, round(ad.cai, 6) AS cai, round(ad.fop, 6) AS fop, round(0.6 * {_cl('lm.score')} + 0.25 * CASE WHEN t.matches THEN {_cl('lm.score')} ELSE 0 END + ad.cai + 0.5 * ad.tai + 0.8 * ad.fop
 + 0.5 * {_cl('1 - greatest(0.0, CASE WHEN gc < 0.35 THEN (0.35 - gc) / 0.35 ELSE (gc - 0.65) / 0.35 END)')} + 0.5 * coalesce(wg, 1) + 0.5 / (1 + exp(-struct5 / 3)) - coalesce(fs.k, 0) - 0.5 * rr.run_codons - 0.3 * h.run_nt
 + 0.2 * cpb - 0.3 * greatest(0.0, cpg_obs_exp - 1) - 0.2 * greatest(0.0, upa_obs_exp - 1) + 0.3 * (CASE WHEN pl IS NULL OR isnan(pl) THEN 0 ELSE 0.4 * {_cl('pl / 100')} END + CASE WHEN md IS NULL OR isnan(md) THEN 0 ELSE 0.2 * {_cl('log10(1 + md) / 3')} END
 + CASE WHEN cm IS NULL OR isnan(cm) THEN 0 ELSE 0.2 * {_cl('cm')} END + CASE WHEN kd IS NULL OR isnan(kd) THEN 0 ELSE 0.2 * {_cl('1 - greatest(0.0, kd - 2) / 4')} END), 6) AS total_rules
FROM ok JOIN {raw('sc_usage_lm')} lm USING (rec_id) JOIN {raw('sc_translate')} t USING (rec_id) JOIN {raw('sc_adaptation')} ad USING (rec_id) JOIN {raw('sc_composition')} co USING (rec_id) LEFT JOIN w USING (rec_id) JOIN {raw('sc_five_prime')} fp USING (rec_id)
LEFT JOIN fs USING (rec_id) JOIN {raw('sc_rare_codon_runs')} rr USING (rec_id) JOIN {raw('sc_homopolymers')} h USING (rec_id) JOIN {raw('sc_codon_pair_bias')} cp USING (rec_id) JOIN {raw('sc_cpg_upa')} du USING (rec_id)"""
)
def rules_score(spark, d) -> DataFrame:
    """Flagship: the weighted rules score of every valid coding sequence."""
    bundle = table(spark, d, "feature_bundle").groupBy("protein_id").agg(*[F.min(c).alias(c) for c in ("plDDT_mean", "msa_depth", "conservation_mean", "kd_hydropathy_mean")])
    rows = records(spark, d).filter("raw is not null").select("rec_id", "protein_id", "host", "aa", "s").filter(K.validate_cds(F.col("s")) == "OK")
    rows = spread(rows.join(bundle, "protein_id", "left")).withColumn("cs", K.codons(F.col("s")))
    terms = rules_terms(rows)
    total = R.weighted({c: F.col(c) for c in terms.columns if c != "rec_id"})
    return terms.select("rec_id", r6(F.col("cai")).alias("cai"), r6(F.col("fop")).alias("fop"), r6(total).alias("total_rules"))


#: Pairs whose score the report takes from the table: the most frequent of each host.
SCORED_PAIRS = 20


def pair_shares(rows: DataFrame, most: int = SCORED_PAIRS) -> dict[str, dict[str, float]]:
    """Share of each host's most frequent codon pairs (ties: the pair's text) among all its pairs."""
    both = F.zip_with(F.slice("cs", 1, F.greatest(F.size("cs") - 1, F.lit(0))), F.slice("cs", 2, F.greatest(F.size("cs") - 1, F.lit(0))), lambda a, b: F.concat(a, F.lit("-"), b))
    n = rows.filter(F.size("cs") > 1).select("host", F.explode(both).alias("pair")).groupBy("host", "pair").agg(F.count("*").alias("n"))
    by_host = Window.partitionBy("host")  # at most 4096 pairs
    ranked = n.withColumn("share", F.col("n") / F.sum("n").over(by_host)).withColumn("r", F.row_number().over(by_host.orderBy(F.desc("n"), "pair"))).filter(F.col("r") <= most)
    out: dict[str, dict[str, float]] = {}
    for r in ranked.collect():  # ``most`` pairs a host
        out.setdefault(r["host"], {})[r["pair"]] = r["share"]
    return out


REPORT = """cai tai fop gc gc_term win_gc_term struct5_proxy dG_vienna dG_term forbidden_hits rare_run_len homopoly_len cpb cps cpg_count cpg_freq cpg_obs_exp upa_count upa_freq upa_obs_exp cpg_penalty upa_penalty feat_struct_term diversity_term
lm_host_term lm_cond_term lm_host_geom lm_cond_geom lm_host_perplexity lm_cond_perplexity total_rules mfe_5p_dG mfe_global_dG mfe_5p_note""".split()


@query(
    f"""WITH {RECORDS}, {CODONS}, {DIM}, b AS (SELECT protein_id, min(plDDT_mean) AS pl, min(msa_depth) AS md, min(conservation_mean) AS cm, min(kd_hydropathy_mean) AS kd FROM feature_bundle GROUP BY protein_id), ok AS (SELECT c.rec_id, c.host, c.s, c.aa, b.* EXCLUDE (protein_id) FROM cds c LEFT JOIN b USING (protein_id) JOIN {raw('sc_validate_cds')} v ON v.rec_id = c.rec_id WHERE v.check_message = 'OK'),
w AS (SELECT rec_id, 1 - count(*) FILTER (g < 0.30 OR g > 0.70) / count(*) AS wg FROM (SELECT rec_id, length(regexp_replace(substr(s, i::INT + 1, 50), '[^GC]', '', 'g')) / 50 AS g FROM (SELECT rec_id, s, unnest(range(0, length(s) - 49, 10)) AS i FROM cds WHERE length(s) >= 50)) GROUP BY rec_id),
fs AS (SELECT rec_id, count(*) AS k FROM {raw('sc_forbidden_sites')} GROUP BY rec_id), pr AS (SELECT rec_id, host, codon AS a, lead(codon) OVER (PARTITION BY rec_id ORDER BY i) AS b FROM cod), pn AS (SELECT host, a, b, count(*) AS n FROM pr WHERE b IS NOT NULL GROUP BY ALL),
ps AS (SELECT *, n / sum(n) OVER (PARTITION BY host) AS share, row_number() OVER (PARTITION BY host ORDER BY n DESC, a || '-' || b) AS r FROM pn), sc AS (SELECT ps.host, ps.a, ps.b, ln(share / (x.u * y.u)) AS z FROM ps JOIN dim x ON x.host = ps.host AND x.codon = ps.a JOIN dim y ON y.host = ps.host AND y.codon = ps.b WHERE r <= {SCORED_PAIRS} AND x.u * y.u > 0),
cs AS (SELECT rec_id, avg(z) AS cps FROM pr JOIN sc USING (host, a, b) GROUP BY rec_id), refs AS (SELECT s AS ref FROM ok ORDER BY rec_id LIMIT 1), di AS (SELECT rec_id, list_sum(list_transform(range(1, least(length(s), length(ref)) + 1), lambda i: (substr(s, i::INT, 1) = substr(ref, i::INT, 1))::INT)) / least(length(s), length(ref)) AS same FROM ok, refs),
x AS (SELECT ok.rec_id, ad.cai, ad.tai, ad.fop, co.gc, {_cl('1 - greatest(0.0, CASE WHEN gc < 0.35 THEN (0.35 - gc) / 0.35 ELSE (gc - 0.65) / 0.35 END)')} AS gc_term, coalesce(wg, 1)::DOUBLE AS win_gc_term, struct5 AS struct5_proxy, struct5 / 4 AS dG_vienna, CASE WHEN struct5 / 4 >= -5 THEN 1.0 ELSE greatest(0.0, 1 - (-5 - struct5 / 4) / 10) END::DOUBLE AS dG_term,
coalesce(fs.k, 0)::INT AS forbidden_hits, rr.run_codons::DOUBLE AS rare_run_len, h.run_nt::DOUBLE AS homopoly_len, cp.cpb, coalesce(cs.cps, 0) AS cps, du.cpg_count, du.cpg_freq, du.cpg_obs_exp, du.upa_count, du.upa_freq, du.upa_obs_exp, greatest(0.0, cpg_obs_exp - 1) AS cpg_penalty, greatest(0.0, upa_obs_exp - 1) AS upa_penalty,
CASE WHEN pl IS NULL OR isnan(pl) THEN 0 ELSE 0.4 * {_cl('pl / 100')} END + CASE WHEN md IS NULL OR isnan(md) THEN 0 ELSE 0.2 * {_cl('log10(1 + md) / 3')} END + CASE WHEN cm IS NULL OR isnan(cm) THEN 0 ELSE 0.2 * {_cl('cm')} END + CASE WHEN kd IS NULL OR isnan(kd) THEN 0 ELSE 0.2 * {_cl('1 - greatest(0.0, kd - 2) / 4')} END AS feat_struct_term,
CASE WHEN same > 0.98 THEN -(same - 0.98) / 0.02 ELSE 0 END AS diversity_term, {_cl('lm.score')} AS lm_host_term, CASE WHEN t.matches THEN {_cl('lm.score')} ELSE 0 END AS lm_cond_term, lm.geom AS lm_host_geom, CASE WHEN t.matches THEN lm.geom ELSE 0 END AS lm_cond_geom, lm.perplexity AS lm_host_perplexity, CASE WHEN t.matches THEN lm.perplexity END AS lm_cond_perplexity,
struct5 / 4 AS mfe_5p_dG, NULL::DOUBLE AS mfe_global_dG, fp.note0 AS mfe_5p_note
FROM ok JOIN {raw('sc_usage_lm')} lm USING (rec_id) JOIN {raw('sc_translate')} t USING (rec_id) JOIN {raw('sc_adaptation')} ad USING (rec_id) JOIN {raw('sc_composition')} co USING (rec_id) LEFT JOIN w USING (rec_id) JOIN {raw('sc_five_prime')} fp USING (rec_id) LEFT JOIN fs USING (rec_id) LEFT JOIN cs USING (rec_id) JOIN di USING (rec_id)
JOIN {raw('sc_rare_codon_runs')} rr USING (rec_id) JOIN {raw('sc_homopolymers')} h USING (rec_id) JOIN {raw('sc_codon_pair_bias')} cp USING (rec_id) JOIN {raw('sc_cpg_upa')} du USING (rec_id)),
y AS (SELECT *, 0.6 * lm_host_term + 0.25 * lm_cond_term + cai + 0.5 * tai + 0.8 * fop + 0.5 * gc_term + 0.5 * win_gc_term + 0.5 / (1 + exp(-struct5_proxy / 3)) + 0.5 * dG_term - forbidden_hits - 0.5 * rare_run_len - 0.3 * homopoly_len + 0.2 * cpb + 0.2 * cps - 0.3 * cpg_penalty - 0.2 * upa_penalty + 0.3 * feat_struct_term + 0.3 * diversity_term AS total_rules FROM x)
SELECT rec_id, {', '.join(k if k in ('forbidden_hits', 'cpg_count', 'upa_count', 'mfe_5p_note') else f'round({k}, 6) AS {chr(34)}{k}{chr(34)}' for k in REPORT)} FROM y"""
)
def rules_report(spark, d) -> DataFrame:
    """All outputs of the rules score with its 18 terms.

    Pair shares come from the table (the most frequent pairs of each host), the diversity term from
    the identity to the first valid sequence.  Free energies are an input: the structure proxy over
    four stands for that of the 5' end, the global one is null."""
    bundle = table(spark, d, "feature_bundle").groupBy("protein_id").agg(*[F.min(c).alias(c) for c in ("plDDT_mean", "msa_depth", "conservation_mean", "kd_hydropathy_mean")])
    every = coding(spark, d)
    shares = pair_shares(every.select("host", "cs"))
    rows = records(spark, d).filter("raw is not null").select("rec_id", "protein_id", "host", "aa", "s").filter(K.validate_cds(F.col("s")) == "OK")
    first = [r["s"] for r in rows.select("rec_id", "s").orderBy("rec_id").limit(1).collect()]  # the references are a parameter
    rows = spread(rows.join(bundle, "protein_id", "left")).withColumn("cs", K.codons(F.col("s")))
    s, cs, host = F.col("s"), F.col("cs"), F.col("host")
    rows = rows.withColumns({"f": K.codon_facts(cs, host), "w": K.sliding_gc(s), "pb": K.pair_bias(s, "CG"), "ub": K.pair_bias(s, "TA"), "s5": K.five_prime_structure(s), "runs": K.rare_runs(K.rare_flags(cs, host))})
    rows = rows.withColumns({"lm": K.usage_lm(F.col("f")), "match": K.translate(cs) == F.col("aa"), "g": K.gc(s), "dg": F.col("s5") / 4})
    f, lm, match, dg = F.col("f"), F.col("lm"), F.coalesce("match", F.lit(False)), F.col("dg")
    score, zero = K.clamp(lm["score"], 0, 1), F.lit(0.0)
    out = rows.select(
        "rec_id", K.cai(f).alias("cai"), K.tai(f).alias("tai"), K.fop(f).alias("fop"), F.col("g").alias("gc"), R.gc_term(F.col("g")).alias("gc_term"), R.window_gc_term(F.col("w")).alias("win_gc_term"), F.col("s5").alias("struct5_proxy"), dg.alias("dG_vienna"), R.energy_term(dg).alias("dG_term"),
        K.motif_hits(s, MOTIFS).alias("forbidden_hits"), F.length(F.array_join("runs", "")).cast("double").alias("rare_run_len"), F.length(F.array_join(K.homopolymers(s), "")).cast("double").alias("homopoly_len"), K.codon_pair_bias(cs, host).alias("cpb"), K.mean_pair_score(cs, host, shares).alias("cps"),
        *[F.col(f"{a}.{k}").cast("long" if k == "count" else "double").alias(f"{b}_{k}") for a, b in (("pb", "cpg"), ("ub", "upa")) for k in ("count", "freq", "obs_exp")],
        F.greatest(zero, F.col("pb.obs_exp") - 1).alias("cpg_penalty"), F.greatest(zero, F.col("ub.obs_exp") - 1).alias("upa_penalty"), R.structure_term(F.col("plDDT_mean"), F.col("msa_depth"), F.col("conservation_mean"), F.col("kd_hydropathy_mean")).alias("feat_struct_term"),
        R.diversity_term(K.min_identity(s, first)).alias("diversity_term"), score.alias("lm_host_term"), F.when(match, score).otherwise(zero).alias("lm_cond_term"), lm["geom"].alias("lm_host_geom"), F.when(match, lm["geom"]).otherwise(zero).alias("lm_cond_geom"),
        lm["perplexity"].alias("lm_host_perplexity"), F.when(match, lm["perplexity"]).alias("lm_cond_perplexity"), dg.alias("mfe_5p_dG"), F.lit(None).cast("double").alias("mfe_global_dG"), K.mfe_note(s, F.lit(0)).alias("mfe_5p_note"),
    )
    term = lambda c: F.col(c).cast("double")
    terms = {"lm_host": "lm_host_term", "lm_cond": "lm_cond_term", "gc": "gc_term", "win_gc": "win_gc_term", "struct5_dG": "dG_term", "forbidden": "forbidden_hits", "rare_runs": "rare_run_len", "homopoly": "homopoly_len", "feat_struct": "feat_struct_term", "diversity": "diversity_term"}
    named = {k: term(terms.get(k, k)) for k in R.WEIGHTS if k != "struct5"} | {"struct5": 1 / (1 + F.exp(-F.col("struct5_proxy") / 3))}
    out = out.withColumn("total_rules", R.weighted(named))
    return out.select("rec_id", *[F.col(k) if k in ("forbidden_hits", "cpg_count", "upa_count", "mfe_5p_note") else r6(F.col(k)).alias(k) for k in REPORT])


BUNDLE = ["gc", "cpb", "cpg_count", "cpg_freq", "cpg_obs_exp", "upa_count", "upa_freq", "upa_obs_exp", "rare_runs_count", "rare_runs_length", "homopolymers_count", "homopolymers_length", "cai", "tai", "fop", "cps"]


@query(
    f"""SELECT v.rec_id, gc AS codon_gc, round(cpb, 6) AS codon_cpb, cpg_obs_exp AS codon_cpg_obs_exp, upa_obs_exp AS codon_upa_obs_exp, n_runs_r AS codon_rare_runs_count, run_codons AS codon_rare_runs_length, n_runs AS codon_homopolymers_count,
CASE WHEN check_message = 'OK' THEN cai END AS codon_cai, CASE WHEN check_message = 'OK' THEN tai END AS codon_tai, CASE WHEN check_message = 'OK' THEN fop END AS codon_fop, CASE WHEN raw_check = 'OK' THEN cai END AS strict_cai
FROM ({ORACLE['sc_validate_cds']}) v JOIN ({ORACLE['sc_composition']}) USING (rec_id) JOIN ({ORACLE['sc_codon_pair_bias']}) USING (rec_id) JOIN ({ORACLE['sc_cpg_upa']}) USING (rec_id) JOIN (SELECT rec_id, n_runs AS n_runs_r, run_codons FROM ({ORACLE['sc_rare_codon_runs']})) USING (rec_id)
JOIN ({ORACLE['sc_homopolymers']}) USING (rec_id) JOIN ({ORACLE['sc_adaptation']}) USING (rec_id)"""
)
def sc_codon_bundle(spark, d) -> DataFrame:
    """Codon features: composition always, adaptation only of valid sequences (terminal stop
    stripped); ``strict_cai`` is null unless the sequence is valid with its stop kept."""
    s, cs = F.col("s"), F.col("cs")
    rows = coding(spark, d).withColumns({"f": K.codon_facts(cs, F.col("host")), "ok": K.validate_cds(s) == "OK", "strict": K.validate_cds(F.col("raw")) == "OK"})
    f = F.col("f")
    rows = rows.withColumns({"runs": K.rare_runs(K.rare_flags(F.col("cs"), F.col("host"))), "x": F.struct(r6(K.cai(f)).alias("cai"), r6(K.tai(f)).alias("tai"), r6(K.fop(f)).alias("fop"))})
    return rows.select(
        "rec_id", r6(K.gc(s)).alias("codon_gc"), r6(K.codon_pair_bias(cs, F.col("host"))).alias("codon_cpb"), r6(K.pair_bias(s, "CG")["obs_exp"]).alias("codon_cpg_obs_exp"), r6(K.pair_bias(s, "TA")["obs_exp"]).alias("codon_upa_obs_exp"),
        F.size("runs").cast("long").alias("codon_rare_runs_count"), F.length(F.array_join("runs", "")).cast("long").alias("codon_rare_runs_length"), F.size(K.homopolymers(s)).alias("codon_homopolymers_count"),
        *[F.when(F.col("ok"), F.col(f"x.{k}")).alias(f"codon_{k}") for k in ("cai", "tai", "fop")], F.when(F.col("strict"), F.col("x.cai")).alias("strict_cai"),
    )


CODON_LIST = "list_transform(range(0, length(s) // 3), lambda i: substr(s, 3 * i::INT + 1, 3))"
SHARES = "list_transform([" + ", ".join(f"'{c}'" for c in K.ALL_CODONS) + "], lambda c: round(CASE WHEN len(cod) > 0 THEN len(list_filter(cod, lambda x: x = c)) / len(cod) ELSE 0 END, 6))"


@query(
    f"""WITH {RECORDS}, c AS (SELECT rec_id, s, {CODON_LIST} AS cod FROM cds) SELECT c.rec_id, list_concat([round(CASE WHEN check_message = 'OK' THEN cai ELSE 0 END, 6)], {SHARES}, [round(cpb, 6), gc, gcw_max, gcw_mean, gcw_min, gcw_std, h.n_runs::DOUBLE, length(s)::DOUBLE, rr.n_runs::DOUBLE, struct5,
CASE WHEN check_message = 'OK' THEN tai ELSE 0 END]) AS features FROM c JOIN ({ORACLE['sc_validate_cds']}) v USING (rec_id) JOIN ({ORACLE['sc_composition']}) co USING (rec_id) JOIN ({ORACLE['sc_adaptation']}) a USING (rec_id) JOIN ({ORACLE['sc_codon_pair_bias']}) p USING (rec_id)
JOIN ({ORACLE['sc_sliding_gc']}) g USING (rec_id) JOIN ({ORACLE['sc_homopolymers']}) h USING (rec_id) JOIN ({ORACLE['sc_rare_codon_runs']}) rr USING (rec_id) JOIN ({ORACLE['sc_five_prime']}) fp USING (rec_id)"""
)
def sc_feature_vector(spark, d) -> DataFrame:
    """Model vectors: features by sorted name (64 codon shares, GC windows, adaptation, lengths);
    invalid sequences keep 0 for adaptation."""
    s, cs = F.col("s"), F.col("cs")
    rows = coding(spark, d).withColumns({"f": K.codon_facts(cs, F.col("host")), "gw": K.window_stats(K.sliding_gc(s)), "ok": K.validate_cds(s) == "OK"})
    f, ok = F.col("f"), F.col("ok")
    named = {
        "len_nt": F.length(s).cast("double"), "gc": K.gc(s), "gcw_mean": F.col("gw.mean"), "gcw_std": F.col("gw.std"), "gcw_min": F.col("gw.min"), "gcw_max": F.col("gw.max"), "cai": F.when(ok, K.cai(f)).otherwise(0.0), "tai": F.when(ok, K.tai(f)).otherwise(0.0),
        "struct5": K.five_prime_structure(s), "rare_runs": F.size(K.rare_runs(K.rare_flags(F.col("cs"), F.col("host")))).cast("double"), "homopoly": F.size(K.homopolymers(s)).cast("double"), "cpb": K.codon_pair_bias(cs, F.col("host")),
    }
    # codon shares stand between "cai" and the other names: all are called codon_...
    names = [f"codon_{c}" for c in K.ALL_CODONS]
    before = [k for k in sorted(named) if k < names[0]]
    after = [k for k in sorted(named) if k > names[-1]]
    one = lambda keys: F.array(*[F.round(named[k], 6) for k in keys])
    return rows.select("rec_id", F.concat(one(before), F.transform(K.codon_shares(cs), lambda x: F.round(x, 6)), one(after)).alias("features"))


@query(
    f"""WITH g AS (SELECT group_no, cluster_id, {sql_protein('protein_aa')} AS aa FROM protein_group), k AS (SELECT DISTINCT group_no, cluster_id, substr(aa, i::INT, 3) AS mer FROM (SELECT *, unnest(range(1, length(aa) - 1)) AS i FROM g WHERE length(aa) >= 3)),
n AS (SELECT group_no, cluster_id, count(*) AS n FROM k GROUP BY ALL), c AS (SELECT a.group_no AS a, b.group_no AS b, count(*) AS nb FROM k a JOIN k b ON a.cluster_id = b.cluster_id AND a.mer = b.mer AND a.group_no < b.group_no GROUP BY ALL)
SELECT c.a AS group_no_a, c.b AS group_no_b, round(nb / (x.n + y.n - nb), 6) AS jaccard FROM c JOIN n x ON x.group_no = c.a JOIN n y ON y.group_no = c.b WHERE nb / (x.n + y.n - nb) >= 0.3"""
)
def sc_kmer_jaccard(spark, d) -> DataFrame:
    """Groups of a stored cluster whose proteins share k-mers (k = 3, Jaccard 0.3 or more), by
    inverted index."""
    from ..operators.similarity import kmer_jaccard

    g = table(spark, d, "protein_group").select(F.col("group_no").alias("id"), F.col("cluster_id").alias("part"), protein_key("protein_aa").alias("txt"))
    return kmer_jaccard(g, 3, 0.3).select(F.col("id_a").alias("group_no_a"), F.col("id_b").alias("group_no_b"), r6(F.col("jaccard")).alias("jaccard"))
