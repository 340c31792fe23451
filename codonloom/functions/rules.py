"""Composite features: structure and evolution proxies, context, expression and quality rules."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import kernels as K

# Default weights of the rules score.
WEIGHTS = {
    "lm_host": 0.6, "lm_cond": 0.25, "cai": 1.0, "tai": 0.5, "fop": 0.8, "gc": 0.5, "win_gc": 0.5, "struct5": 0.5, "struct5_dG": 0.5, "forbidden": -1.0,
    "rare_runs": -0.5, "homopoly": -0.3, "cpb": 0.2, "cps": 0.2, "cpg_penalty": -0.3, "upa_penalty": -0.2, "feat_struct": 0.3, "diversity": 0.3,
}
# Strengths of promoters and ribosome binding sites, scores of growth phases and
# localisations; anything else takes the default.
PROMOTERS = {"T7": 1.0, "lacUV5": 0.8, "tac": 0.85, "trc": 0.75, "araBAD": 0.7, "AOX1": 0.9, "GAL1": 0.85, "TEF1": 0.7, "CMV": 0.9, "EF1A": 0.85, "SV40": 0.7}
SITES = {"strong": 1.0, "medium": 0.6, "weak": 0.3, "BBa_B0034": 1.0, "BBa_B0032": 0.6, "BBa_B0030": 0.3, "optimal": 1.0}
PHASES = {"log": 1.0, "exponential": 1.0, "stationary": 0.5, "lag": 0.3}
PLACES = {"cytoplasm": 1.0, "periplasm": 0.8, "membrane": 0.6, "secreted": 0.7, "extracellular": 0.7}
# Keywords that name a host in an organism's name, in order.
SPECIES = {"Escherichia coli": "E_coli", "Homo sapiens": "Human", "Mus musculus": "Mouse", "Pichia pastoris": "P_pastoris", "Saccharomyces cerevisiae": "S_cerevisiae"}
YEASTS = ["yeast", "pichia", "saccharomyces", "candida", "komagataella", "hansenula", "scheffersomyces", "wickerhamomyces", "cyberlindnera", "ogataea", "millerozyma"]
HUMAN_WORDS = ["human", "homo", "sapiens"]
MOUSE_WORDS = ["mouse", "mus", "musculus"]


def residue_stage(rows: DataFrame, protein: str) -> DataFrame:
    """``rows`` with the shared intermediates ``_n, _c, _cx`` (length, residue counts, complexity)
    as columns, so that no feature computes them again."""
    rows = rows.withColumn("_c", K.residue_counts(F.col(protein))).withColumn("_n", F.length(protein))
    return rows.withColumn("_cx", K.complexity(F.col("_c"), F.col("_n")))


def structure(rows: DataFrame, protein: str = "aa") -> DataFrame:
    """``rows`` with the 17 structure proxies; empty and null proteins take fixed defaults."""
    p, n, c = F.col(protein), F.col("_n"), F.col("_c")
    rows = residue_stage(rows, protein)
    rows = rows.withColumns({"_d": K.clamp(K.scale_mean(c, n, "disorder", 0.5), 0, 1), "_h": K.scale_mean(c, n, "helix", 1.0), "_s": K.scale_mean(c, n, "sheet", 1.0), "_tm": K.membrane_windows(p)})
    d, h, s, tm = F.col("_d"), F.col("_h"), F.col("_s"), F.col("_tm")
    mean = K.clamp(90 - d * 40 + F.col("_cx") * 5, 50, 95)
    std = 8 + d * 15
    full = {
        "plddt_mean": mean, "plddt_min": F.greatest(F.lit(30.0), mean - 2 * std), "plddt_max": F.least(F.lit(100.0), mean + std), "plddt_std": std, "plddt_q25": mean - 0.67 * std, "plddt_q75": mean + 0.67 * std,
        "disorder_ratio": d, "flexible_ratio": d * 0.4, "helix_ratio": h / (h + s + 1), "sheet_ratio": s / (h + s + 1), "coil_ratio": 1 / (h + s + 1), "sasa_mean": F.lit(120.0), "sasa_total": n * 120.0,
        "sasa_polar_ratio": K.fraction(F.regexp_count(p, F.lit("[RNDQEHKSTY]")), n), "has_signal_peptide": K.signal_peptide(p), "has_transmembrane": (tm > 0).cast("double"), "tm_helix_count": tm.cast("double"),
    }
    # What a record without a protein gets.
    blank = dict(zip(full, (75.0, 60.0, 90.0, 10.0, 70.0, 85.0, 0.15, 0.05, 0.33, 0.25, 0.42, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0), strict=True))
    out = rows.withColumns({k: F.when(n > 0, v).otherwise(F.lit(blank[k])) for k, v in full.items()})
    return out.drop("_n", "_c", "_cx", "_d", "_h", "_s", "_tm")


def evolution(rows: DataFrame, protein: str = "aa") -> DataFrame:
    """``rows`` (proteins not empty) with the 11 evolution proxies."""
    p, n, c, cx = F.col(protein), F.col("_n"), F.col("_c"), F.col("_cx")
    rows = residue_stage(rows, protein)
    rows = rows.withColumn("_k", K.clamp(K.scale_mean(c, n, "conservation", 0.5) * 0.5 + K.composition_similarity(c, n) * 0.3 + cx * 0.2, 0.4, 0.95))
    cons = F.col("_k")
    rows = rows.withColumn("_m", K.clamp(100 * (1 + 0.2 * F.log10(n / 100)) * (0.5 + cx) * (0.7 + 0.6 * cons), 20, 500))
    domains = F.greatest(F.lit(1), F.floor(n / 150))
    bridges = F.when(n < 10, 0.3).otherwise(0.3 + 0.4 * F.least(F.lit(1.0), K.salt_bridges(p) / (n * 0.1)))
    full = {
        "msa_depth": F.col("_m"), "msa_effective_depth": F.col("_m") * 0.8, "msa_coverage": F.lit(0.95), "conservation_mean": cons, "conservation_min": F.greatest(F.lit(0.2), cons - 0.3),
        "conservation_max": F.least(F.lit(1.0), cons + 0.25), "conservation_entropy_mean": 1 - K.entropy(c, n) / math.log2(20), "coevolution_score": bridges,
        "contact_density": F.when(n < 50, 0.5).when(n < 200, 0.35).otherwise(0.25), "pfam_count": F.when(n > 100, F.greatest(F.lit(0), domains - 1)).otherwise(0).cast("double"), "domain_count": domains.cast("double"),
    }
    return rows.withColumns(full).drop("_n", "_c", "_cx", "_k", "_m")


def _choice(c: Column, values: dict[str, float], default: float) -> Column:
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in values.items() for x in kv]), F.coalesce(F.trim(c), F.lit(""))), F.lit(default))


def context(promoter: Column, rbs: Column, spacing: Column, kozak: Column, copies: Column, marker: Column, temperature: Column, inducer: Column, phase: Column, place: Column) -> dict[str, Column]:
    """The 10 context features; null inputs take the documented defaults."""

    def number(c: Column, default: float) -> Column:
        return F.coalesce(c.cast("double"), F.lit(default))

    return {
        "ctx_promoter_strength": _choice(promoter, PROMOTERS, 0.5), "ctx_rbs_strength": _choice(rbs, SITES, 0.5), "ctx_rbs_spacing": number(spacing, 8.0), "ctx_kozak_score": number(kozak, 0.0),
        "ctx_vector_copy_number": number(copies, 1.0), "ctx_has_selection_marker": number(marker, 0.0), "ctx_temperature_norm": (number(temperature, 37.0) - 37) / 10, "ctx_inducer_concentration": number(inducer, 0.0),
        "ctx_growth_phase_score": F.when(phase.isNull(), 1.0).otherwise(_choice(phase, PHASES, 0.8)), "ctx_localization_score": F.when(place.isNull(), 1.0).otherwise(_choice(place, PLACES, 1.0)),
    }


def organism_host(organism: Column) -> Column:
    """Host of an organism's name: exact, contained, by keyword, else E_coli; null gives E_coli."""
    low = F.lower(F.coalesce(organism, F.lit("")))
    out = None
    for name, host in SPECIES.items():
        out = F.when(organism == name, host) if out is None else out.when(organism == name, host)
    for name, host in SPECIES.items():
        out = out.when(F.contains(low, F.lit(name.lower())), host)
    for host, names in (("S_cerevisiae", YEASTS), ("Human", HUMAN_WORDS), ("Mouse", MOUSE_WORDS)):
        out = out.when(low.rlike("|".join(names)), host)
    return out.otherwise("E_coli")


def metadata_expression(reviewed: Column, place: Column, n: Column) -> tuple[Column, Column]:
    """Expression score (at least 10) and confidence from a record's annotation."""
    low = F.lower(F.coalesce(place, F.lit("")))
    has = lambda *w: low.rlike("|".join(w))
    score = (
        F.lit(50.0)
        + F.when(reviewed, 20).otherwise(0)
        + F.when(has("cytoplasm", "cytosol"), 15).otherwise(0)
        + F.when(has("ribosome"), 30).otherwise(0)
        - F.when(has("membrane"), 10).otherwise(0)
        - F.when(has("secreted", "extracellular"), 5).otherwise(0)
        + F.when(n.between(100, 500), 10).when((n < 50) | (n > 1000), -10).otherwise(0)
    )
    return F.greatest(F.lit(10.0), score), F.when(reviewed | has("ribosome"), "medium").otherwise("low")


def lm_expression(value: Column, confidence: Column, conf: Column, conf_max: Column, conf_min: Column, ll: Column, ppl: Column, weight: float = 0.3) -> tuple[Column, Column]:
    """Expression adjusted by language-model statistics, in [10, 100], and its confidence.
    A null statistic adjusts nothing; an even confidence (range under 0.1) counts only beside an
    average one."""
    zero = F.lit(0.0)
    by_conf = F.when(conf > 0.9, 15 * (conf - 0.9) / 0.1).when(conf < 0.7, -15 * (0.7 - conf) / 0.3).otherwise(zero)
    even = conf.isNotNull() & ((conf_max - conf_min) < 0.1)
    by_ll = F.when(ll > -2, 10 * (ll + 2) / 2).when(ll < -4, -10 * (-4 - ll) / 2).otherwise(zero)
    by_ppl = F.when(ppl < 10, weight * 10 * (10 - ppl) / 8).when(ppl > 30, -F.least(weight * 10 * (ppl - 30) / 20, F.lit(10.0))).otherwise(zero)
    out = value + weight * (by_conf + F.when(even, 5.0).otherwise(zero) + by_ll) + by_ppl
    up = F.when(conf > 0.95, "high").otherwise(confidence)
    return K.clamp(out, 10, 100), F.when(even & (up == "medium"), "high").otherwise(up)


def sequence_expression(value: Column, s: Column) -> Column:
    """Expression adjusted by GC content and the longest run, in [10, 100]."""
    g = K.gc(s)
    out = value + F.when(g.between(0.4, 0.6), 5).when((g < 0.3) | (g > 0.7), -5).otherwise(0) - F.when(K.longest_run(s) > 8, 10).otherwise(0)
    return K.clamp(out, 10, 100)


def quality_score(cai: Column, gc: Column, rare: Column, homo: Column) -> Column:
    """Rule-based quality in [0, 100] from CAI, GC, rare-codon runs and homopolymers."""
    dev = F.abs(gc - 0.5)
    score = (
        F.lit(50.0)
        + F.when(cai > 0.8, 25.0).when(cai > 0.6, 15.0).when(cai < 0.4, -20.0).otherwise(10 * (cai - 0.5))
        + F.when(dev < 0.05, 15.0).when(dev < 0.10, 8.0).when(dev > 0.20, -20.0).otherwise(-15 * (dev - 0.1) / 0.1)
        + F.when(rare == 0, 10.0).otherwise(-6.0 * F.least(rare, F.lit(5)))
        + F.when(homo == 0, 5.0).otherwise(-4.0 * F.least(homo, F.lit(3)))
    )
    return K.clamp(score, 0, 100)


def structure_term(plddt: Column, msa: Column, cons: Column, kd: Column) -> Column:
    """Weighted [0, 1] term of structure and evolution features; nulls and NaN count 0."""
    ok = lambda c, v: F.when(c.isNotNull() & ~F.isnan(c), v).otherwise(0.0)
    return (
        0.4 * ok(plddt, K.clamp(plddt / 100, 0, 1))
        + 0.2 * ok(msa, K.clamp(F.log10(1 + msa) / 3, 0, 1))
        + 0.2 * ok(cons, K.clamp(cons, 0, 1))
        + 0.2 * ok(kd, K.clamp(1 - F.greatest(F.lit(0.0), kd - 2) / 4, 0, 1))
    )


def gc_term(g: Column, low: float = 0.35, high: float = 0.65) -> Column:
    return K.clamp(1 - F.greatest(F.lit(0.0), F.when(g < low, (low - g) / low).otherwise((g - high) / (1 - high))), 0, 1)


def window_gc_term(windows: Column, low: float = 0.30, high: float = 0.70) -> Column:
    bad = F.size(F.filter(windows, lambda x: (x < low) | (x > high)))
    return F.when(F.size(windows) > 0, 1 - bad / F.size(windows)).otherwise(1.0)


def energy_term(dg: Column, threshold: float = -5.0, span: float = 10.0) -> Column:
    return F.when(dg.isNull(), 0.0).when(dg >= threshold, 1.0).otherwise(F.greatest(F.lit(0.0), 1 - (threshold - dg) / span))


def diversity_term(identity: Column, most: float = 0.98) -> Column:
    return F.when(identity > most, -(identity - most) / max(1e-6, 1 - most)).otherwise(0.0)


def weighted(terms: dict[str, Column], weights: dict[str, float] | None = None) -> Column:
    """Weighted sum of the named terms; terms that are not given count 0."""
    weights = WEIGHTS | (weights or {})
    out = F.lit(0.0)
    for name, w in weights.items():
        if name in terms:
            out = out + F.lit(w) * terms[name]
    return out
