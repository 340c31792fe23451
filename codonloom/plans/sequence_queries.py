"""Queries of the sequence kernels over the integrated records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import genetics as G
from ..functions import kernels as K
from ..functions.text_norm import protein_key
from .registry import CODE, CODONS, FACTS, ORACLE, PAIRS, RECORDS, coding, query, records, sql_protein, table

# Restriction sites used where a query needs forbidden motifs.
MOTIFS = ["GAATTC", "GGATCC", "AAGCTT", "AATAAA"]


def r6(c: Column) -> Column:
    return F.round(c, 6)


@query(
    f"""WITH {RECORDS}, {CODONS}, d AS (SELECT rec_id, count(DISTINCT codon) / count(*) AS div, count(*) FILTER (codon IN ('ATG', 'TAA', 'TAG', 'TGA')) / count(*) AS mark, count(*) AS n FROM cod GROUP BY rec_id)
SELECT rec_id, length(s) AS n_nt, coalesce(n, 0) AS n_codons, round(length(regexp_replace(s, '[^GC]', '', 'g')) / length(s), 6) AS gc, round(length(regexp_replace(s, '[^A]', '', 'g')) / length(s), 6) AS a_share,
round(length(regexp_replace(s, '[^T]', '', 'g')) / length(s), 6) AS t_share, round(coalesce(div, 0), 6) AS codon_diversity, round(coalesce(mark, 0), 6) AS marker_share FROM cds LEFT JOIN d USING (rec_id)"""
)
def sc_composition(spark, d) -> DataFrame:
    s, cs = F.col("s"), F.col("cs")
    return coding(spark, d).select(
        "rec_id", F.length(s).alias("n_nt"), F.size(cs).alias("n_codons"), r6(K.gc(s)).alias("gc"), r6(K.base_share(s, "A")).alias("a_share"), r6(K.base_share(s, "T")).alias("t_share"),
        r6(K.codon_diversity(cs)).alias("codon_diversity"), r6(K.marker_codon_share(cs)).alias("marker_share"),
    )


CHECK = """CASE WHEN length({s}) % 3 <> 0 THEN 'Length not multiple of 3.' WHEN regexp_matches({s}, '[^ACGT]') THEN 'Non-ACGT characters found.' WHEN length({s}) = 0 THEN 'Empty CDS.'
WHEN left({s}, 3) <> 'ATG' THEN 'CDS does not start with ATG.' WHEN right({s}, 3) IN ('TAA', 'TAG', 'TGA') THEN 'CDS ends with a STOP codon; exclude terminal stop for scoring.'
WHEN regexp_matches({s}, '^([ACGT]{{3}})*?(TAA|TAG|TGA)') THEN 'Internal STOP codon detected.' ELSE 'OK' END"""


@query(
    f"WITH {RECORDS} SELECT rec_id, {CHECK.format(s='raw')} AS raw_check, {CHECK.format(s='s')} AS check_message, starts_with(raw, 'ATG') AS has_start, right(raw, 3) IN ('TAA', 'TAG', 'TGA') AS has_stop, NOT regexp_matches(raw, '[^ACGT]') AS only_acgt FROM cds"
)
def sc_validate_cds(spark, d) -> DataFrame:
    raw = F.col("raw")
    return coding(spark, d).select(
        "rec_id", K.validate_cds(raw).alias("raw_check"), K.validate_cds(F.col("s")).alias("check_message"), raw.startswith("ATG").alias("has_start"),
        F.right(raw, F.lit(3)).isin("TAA", "TAG", "TGA").alias("has_stop"), (~raw.rlike("[^ACGT]")).alias("only_acgt"),
    )


@query(
    f"""WITH {RECORDS}, {CODE}, {CODONS}, t AS (SELECT rec_id, string_agg(coalesce(aa, 'X'), '' ORDER BY i) AS translated FROM cod LEFT JOIN code USING (codon) GROUP BY rec_id)
SELECT rec_id, coalesce(translated, '') AS translated, coalesce(translated, '') = aa AS matches FROM cds LEFT JOIN t USING (rec_id)"""
)
def sc_translate(spark, d) -> DataFrame:
    return coding(spark, d).select("rec_id", "aa", K.translate(F.col("cs")).alias("translated")).select("rec_id", "translated", (F.col("translated") == F.col("aa")).alias("matches"))


@query(
    f"""WITH {RECORDS}, w AS (SELECT rec_id, length(regexp_replace(substr(s, i::INT + 1, 50), '[^GC]', '', 'g')) / 50 AS g FROM (SELECT rec_id, s, unnest(range(0, length(s) - 49, 10)) AS i FROM cds WHERE length(s) >= 50))
SELECT rec_id, count(g) AS n_windows, round(coalesce(avg(g), 0), 6) AS gcw_mean, round(coalesce(stddev_pop(g), 0), 6) AS gcw_std, round(coalesce(min(g), 0), 6) AS gcw_min, round(coalesce(max(g), 0), 6) AS gcw_max
FROM cds LEFT JOIN w USING (rec_id) GROUP BY rec_id"""
)
def sc_sliding_gc(spark, d) -> DataFrame:
    rows = coding(spark, d).select("rec_id", K.sliding_gc(F.col("s")).alias("w"))
    x = K.window_stats(F.col("w"))
    return rows.select("rec_id", F.size("w").cast("long").alias("n_windows"), x.alias("x")).select("rec_id", "n_windows", *[r6(F.col(f"x.{k}")).alias(f"gcw_{k}") for k in ("mean", "std", "min", "max")])


RUN6 = "(A{6,}|C{6,}|G{6,}|T{6,}|N{6,})"


@query(
    f"""WITH {RECORDS}, r AS (SELECT rec_id, s, regexp_extract_all(s, '{RUN6}') AS h, regexp_extract_all(s, '(A+|C+|G+|T+|N+)') AS a FROM cds)
SELECT rec_id, len(h) AS n_runs, coalesce(list_sum(list_transform(h, lambda x: length(x))), 0)::BIGINT AS run_nt, list_max(list_transform(a, lambda x: length(x))) AS longest_run FROM r"""
)
def sc_homopolymers(spark, d) -> DataFrame:
    runs = K.homopolymers(F.col("s"))
    return coding(spark, d).select("rec_id", F.size(runs).alias("n_runs"), F.length(F.array_join(runs, "")).cast("long").alias("run_nt"), K.longest_run(F.col("s")).alias("longest_run"))


@query(
    f"""WITH {RECORDS}, l AS (SELECT rec_id, i, substr(s, i::INT, 1) AS base FROM (SELECT rec_id, s, unnest(range(1, length(s) + 1)) AS i FROM cds)), g AS (SELECT *, i - row_number() OVER (PARTITION BY rec_id, base ORDER BY i) AS k FROM l)
SELECT rec_id, base, (min(i) - 1)::INT AS pos, count(*)::INT AS len FROM g GROUP BY rec_id, base, k HAVING count(*) >= 6"""
)
def sc_homopolymer_spans(spark, d) -> DataFrame:
    """Runs of six or more of one base with their position."""
    rows = coding(spark, d).select("rec_id", F.explode(K.run_spans(F.col("s"), 6)).alias("r"))
    return rows.select("rec_id", "r.base", "r.pos", "r.len")


@query()
def sc_tandem_spans(spark, d) -> DataFrame:
    """Repeats of units of 2 to 6 bases with position, length and unit (checked against a loop in
    the tests)."""
    all_units = F.concat(*[K.tandem_spans(F.col("s"), k) for k in range(2, 7)])
    return coding(spark, d).select("rec_id", F.explode(all_units).alias("r")).select("rec_id", "r.motif", "r.pos", "r.len")


@query()
def sc_tandem_repeats(spark, d) -> DataFrame:
    """Repeats of units of 2 to 6 bases (checked against a loop in the tests: RE2 lacks
    back-references)."""
    found = {f"n_unit{k}": F.size(K.tandem_repeats(F.col("s"), k)) for k in range(2, 7)}
    return coding(spark, d).select("rec_id", *[c.alias(n) for n, c in found.items()])


@query(
    f"""WITH {FACTS} SELECT c.rec_id, round(coalesce(exp(avg(ln(w)) FILTER (aa <> '*')), 0), 6) AS cai, round(coalesce(exp(avg(ln(t)) FILTER (aa <> '*')), 0), 6) AS tai,
round(coalesce(avg(opt::INT) FILTER (aa <> '*'), 0), 6) AS fop FROM cds c LEFT JOIN (SELECT rec_id, aa AS aa, w, t, opt FROM facts) f USING (rec_id) GROUP BY c.rec_id""".replace("FILTER (aa", "FILTER (f.aa")
)
def sc_adaptation(spark, d) -> DataFrame:
    """CAI, tAI and FOP of every sequence, terminal stop aside."""
    f = coding(spark, d).select("rec_id", K.codon_facts(F.col("cs"), F.col("host")).alias("f"))
    return f.select("rec_id", r6(K.cai(F.col("f"))).alias("cai"), r6(K.tai(F.col("f"))).alias("tai"), r6(K.fop(F.col("f"))).alias("fop"))


@query(
    f"""WITH {FACTS}, g AS (SELECT rec_id, count(*) AS len FROM (SELECT rec_id, i - row_number() OVER (PARTITION BY rec_id ORDER BY i) AS g FROM facts WHERE rare) GROUP BY rec_id, g),
n AS (SELECT rec_id, sum(len) AS n_rare, count(*) FILTER (len >= 3) AS n_runs, coalesce(sum(len) FILTER (len >= 3), 0) AS run_codons FROM g GROUP BY rec_id)
SELECT rec_id, coalesce(n_rare, 0)::BIGINT AS n_rare, coalesce(n_runs, 0)::BIGINT AS n_runs, coalesce(run_codons, 0)::BIGINT AS run_codons FROM cds LEFT JOIN n USING (rec_id)"""
)
def sc_rare_codon_runs(spark, d) -> DataFrame:
    f = coding(spark, d).select("rec_id", K.rare_flags(F.col("cs"), F.col("host")).alias("flags"))
    runs = K.rare_runs(F.col("flags"))
    return f.select(
        "rec_id", F.regexp_count("flags", F.lit("1")).cast("long").alias("n_rare"), F.size(runs).cast("long").alias("n_runs"), F.length(F.array_join(runs, "")).cast("long").alias("run_codons")
    )


@query(
    f"""WITH {FACTS}, g AS (SELECT rec_id, i, i - row_number() OVER (PARTITION BY rec_id ORDER BY i) AS k FROM facts WHERE rare) SELECT rec_id, min(i)::INT AS pos, count(*)::INT AS len FROM g GROUP BY rec_id, k HAVING count(*) >= 3"""
)
def sc_rare_run_spans(spark, d) -> DataFrame:
    """Runs of three or more rare codons, position and length in codons."""
    rows = coding(spark, d).select("rec_id", F.explode(K.letter_runs(K.rare_flags(F.col("cs"), F.col("host")), "1", 3)).alias("r"))
    return rows.select("rec_id", "r.pos", "r.len")


@query(
    f"""WITH {RECORDS}, {PAIRS}, {CODONS}, p AS (SELECT rec_id, host, codon || '-' || lead(codon) OVER (PARTITION BY rec_id ORDER BY i) AS pair FROM cod)
SELECT rec_id, count(score) AS n_scored, round(coalesce(avg(score), 0), 6) AS cpb FROM cds LEFT JOIN (SELECT p.rec_id, score FROM p JOIN cpb USING (host, pair)) USING (rec_id) GROUP BY rec_id"""
)
def sc_codon_pair_bias(spark, d) -> DataFrame:
    f = coding(spark, d).select("rec_id", K.pair_scores(F.col("cs"), F.col("host")).alias("p"))
    return f.select("rec_id", F.size("p").cast("long").alias("n_scored"), r6(K.mean(F.col("p"))).alias("cpb"))


@query(
    f"""WITH {FACTS}, pr AS (SELECT host, codon AS a, lead(codon) OVER (PARTITION BY rec_id ORDER BY i) AS b FROM cod), n AS (SELECT host, a, b, count(*) AS n FROM pr WHERE b IS NOT NULL GROUP BY ALL),
q AS (SELECT *, n / sum(n) OVER (PARTITION BY host) AS share FROM n)
SELECT q.host, q.a, q.b, q.n AS n_pairs, round(ln(q.share / (x.u * y.u)), 6) AS cps FROM q JOIN dim x ON x.host = q.host AND x.codon = q.a JOIN dim y ON y.host = q.host AND y.codon = q.b WHERE x.u > 0 AND y.u > 0"""
)
def sc_codon_pair_score(spark, d) -> DataFrame:
    """ln(F_ab / (F_a F_b)) of every pair, its frequency counted over the host's sequences."""
    rows = coding(spark, d).select("host", F.col("cs").alias("c"))
    both = rows.filter(F.size("c") > 1).select("host", F.explode(F.zip_with(F.slice("c", 1, F.size("c") - 1), F.slice("c", 2, F.size("c") - 1), lambda a, b: F.struct(a.alias("a"), b.alias("b")))).alias("p"))
    n = both.groupBy("host", "p.a", "p.b").agg(F.count("*").alias("n_pairs"))
    sums = n.groupBy("host").agg(F.sum("n_pairs").alias("all_pairs"))
    dim = F.broadcast(spark.createDataFrame([(h, c, u) for h in G.HOSTS for c, u in G.usage(h).items()], "host string, codon string, u double"))  # 305 rows
    out = n.join(sums, "host").join(dim.toDF("host", "a", "ua"), ["host", "a"]).join(dim.toDF("host", "b", "ub"), ["host", "b"])
    return out.select("host", "a", "b", "n_pairs", r6(K.codon_pair_score(F.col("n_pairs"), F.col("n_pairs") / F.col("all_pairs"), F.col("ua"), F.col("ub"))).alias("cps"))


def _sql_pair(two: str) -> str:
    seen = f"(length(s) - length(replace(s, '{two}', ''))) / 2"
    exp = f"((length(s) - length(replace(s, '{two[0]}', ''))) / length(s) * ((length(s) - length(replace(s, '{two[1]}', ''))) / length(s)) * (length(s) - 1))"
    n = "cpg" if two == "CG" else "upa"
    return f"({seen})::BIGINT AS {n}_count, round(CASE WHEN length(s) > 1 THEN {seen} / (length(s) - 1) * 100 ELSE 0 END, 6) AS {n}_freq, round(CASE WHEN length(s) > 1 AND {exp} > 0 THEN {seen} / {exp} ELSE 0 END, 6) AS {n}_obs_exp"


@query(f"WITH {RECORDS} SELECT rec_id, {_sql_pair('CG')}, {_sql_pair('TA')} FROM cds")
def sc_cpg_upa(spark, d) -> DataFrame:
    s = F.col("s")
    rows = coding(spark, d).select("rec_id", K.pair_bias(s, "CG").alias("cpg"), K.pair_bias(s, "TA").alias("upa"))
    return rows.select("rec_id", *[(F.col(f"{p}.{k}").cast("long") if k == "count" else r6(F.col(f"{p}.{k}"))).alias(f"{p}_{k}") for p in ("cpg", "upa") for k in ("count", "freq", "obs_exp")])


@query(
    f"""WITH {RECORDS}, p AS (SELECT rec_id, substr(s, i::INT, 2) AS two FROM (SELECT rec_id, s, unnest(range(1, length(s))) AS i FROM cds))
SELECT rec_id, two AS dinucleotide, count(*) AS n FROM p WHERE regexp_matches(two, '^[ACGT]{{2}}$') GROUP BY rec_id, two"""
)
def sc_dinucleotides(spark, d) -> DataFrame:
    """Overlapping counts of the 16 pairs (pairs that occur)."""
    all16 = F.array(*[F.struct(F.lit(a + b).alias("dinucleotide"), K.dinucleotide(F.col("s"), a + b).cast("long").alias("n")) for a in "ACGT" for b in "ACGT"])
    return coding(spark, d).select("rec_id", F.explode(all16).alias("x")).select("rec_id", "x.*").filter("n > 0")


@query(
    f"""WITH {RECORDS}, m(motif) AS (VALUES {', '.join(f"('{m}')" for m in MOTIFS)}), h AS (SELECT rec_id, motif, i - 1 AS pos FROM (SELECT rec_id, s, motif, unnest(range(1, length(s) - length(motif) + 2)) AS i FROM cds, m) WHERE substr(s, i::INT, length(motif)) = motif)
SELECT rec_id, motif, pos::INT AS pos FROM h"""
)
def sc_forbidden_sites(spark, d) -> DataFrame:
    """Every overlapping hit of the motifs with its 0-based position."""
    hits = F.array(*[F.struct(F.lit(m).alias("motif"), K.motif_positions(F.col("s"), m).alias("at")) for m in MOTIFS])
    rows = coding(spark, d).filter(F.col("s").rlike("|".join(MOTIFS)))
    return rows.select("rec_id", F.explode(hits).alias("x")).select("rec_id", "x.motif", F.explode("x.at").alias("pos"))


@query(
    f"""WITH {FACTS} SELECT c.rec_id, round(coalesce(sum(ln(greatest(1e-9, p))) FILTER (f.aa <> '*'), 0), 6) AS loglik, round(coalesce(avg(ln(greatest(1e-9, p))) FILTER (f.aa <> '*'), 0), 6) AS avg_loglik,
round(exp(-coalesce(avg(ln(greatest(1e-9, p))) FILTER (f.aa <> '*'), 0)), 6) AS perplexity, round(exp(coalesce(avg(ln(greatest(1e-9, p))) FILTER (f.aa <> '*'), 0)), 6) AS geom,
round(pow(exp(coalesce(avg(ln(greatest(1e-9, p))) FILTER (f.aa <> '*'), 0)), 1.0::DOUBLE / 3), 6) AS score FROM cds c LEFT JOIN (SELECT rec_id, aa, p FROM facts) f USING (rec_id) GROUP BY c.rec_id"""
)
def sc_usage_lm(spark, d) -> DataFrame:
    """Statistics of the codon-usage language model of each record's host."""
    rows = coding(spark, d).select("rec_id", K.codon_facts(F.col("cs"), F.col("host")).alias("f")).select("rec_id", K.usage_lm(F.col("f")).alias("x"))
    return rows.select("rec_id", *[r6(F.col(f"x.{k}")).alias(k) for k in ("loglik", "avg_loglik", "perplexity", "geom", "score")])


@query(
    f"""WITH {RECORDS}, {CODONS}, n AS (SELECT host, rec_id, codon, count(*) AS k FROM cod GROUP BY ALL), n2 AS (SELECT *, sum(k) OVER (PARTITION BY rec_id) AS tot FROM n),
r AS (SELECT host, count(*) AS n_rec FROM cds GROUP BY host) SELECT host, codon, round(sum(k / tot) / any_value(n_rec), 6) AS mean_share, sum(k)::BIGINT AS n FROM n2 JOIN r USING (host) WHERE regexp_matches(codon, '^[ACGT]{{3}}$') GROUP BY host, codon"""
)
def sc_codon_histogram(spark, d) -> DataFrame:
    """Mean relative frequency of each codon over the sequences of a host."""
    rows = coding(spark, d)
    n_rec = rows.groupBy("host").agg(F.count("*").alias("n_rec"))
    parts = rows.select("host", F.size("cs").alias("tot"), F.explode("cs").alias("codon")).filter(F.col("codon").rlike("^[ACGT]{3}$"))
    sums = parts.groupBy("host", "codon").agg(F.sum(1 / F.col("tot")).alias("x"), F.count("*").alias("n"))
    return sums.join(n_rec, "host").select("host", "codon", r6(F.col("x") / F.col("n_rec")).alias("mean_share"), "n")


@query(
    f"""WITH {RECORDS}, w AS (SELECT rec_id, s, substr(s, 4, 45) AS w, reverse(translate(substr(s, 4, 45), 'ACGT', 'TGCA')) AS rc FROM cds)
SELECT rec_id, -(list_sum(list_transform([5, 4, 3], lambda k: (6 - k) * len(list_filter(range(1, greatest(length(w) - k + 2, 1)), lambda i: contains(rc, substr(w, i::INT, k::INT)))))))::DOUBLE AS struct5,
CASE WHEN length(s) >= 51 THEN 'no_utr_fallback' ELSE 'no_utr_fallback_short' END AS note0, CASE WHEN length(s) >= 51 THEN 'utr_available_but_cds_only' ELSE 'utr_available_but_short_cds' END AS note25 FROM w"""
)
def sc_five_prime(spark, d) -> DataFrame:
    """Structure proxy behind the start codon and the window notes without and with a UTR."""
    s = F.col("s")
    return coding(spark, d).select("rec_id", K.five_prime_structure(s).alias("struct5"), K.mfe_note(s, F.lit(0)).alias("note0"), K.mfe_note(s, F.lit(25)).alias("note25"))


@query(
    f"""WITH {RECORDS}, pc AS (SELECT g.group_no, {sql_protein('g.protein_aa')} AS a, {sql_protein('c.representative_aa')} AS b FROM protein_group g JOIN protein_cluster c USING (cluster_id)), ok AS (SELECT * FROM pc WHERE a IS NOT NULL AND b IS NOT NULL),
s AS (SELECT group_no, a, b, len(list_filter(range(1, least(length(a), length(b)) + 1), lambda i: substr(a, i::INT, 1) = substr(b, i::INT, 1))) AS same FROM ok)
SELECT group_no, round(same / least(length(a), length(b)), 6) AS identity_min, round(same / greatest(length(a), length(b)), 6) AS identity_max FROM s"""
)
def sc_sequence_identity(spark, d) -> DataFrame:
    """Identity of each group's protein to its stored cluster's representative, over the shorter
    and over the longer one."""
    g = table(spark, d, "protein_group").select("group_no", "cluster_id", protein_key("protein_aa").alias("a"))
    c = table(spark, d, "protein_cluster").select("cluster_id", protein_key("representative_aa").alias("b"))
    rows = g.join(c, "cluster_id").filter("a is not null and b is not null")
    return rows.select("group_no", r6(K.identity(F.col("a"), F.col("b"))).alias("identity_min"), r6(K.identity(F.col("a"), F.col("b"), longest=True)).alias("identity_max"))


@query(
    f"""WITH {RECORDS} SELECT rec_id, list_aggregate([CASE WHEN cpg > 1.5 THEN 'cpg' END, CASE WHEN upa > 1.5 THEN 'upa' END, CASE WHEN homo THEN 'homopolymer' END, CASE WHEN motif THEN 'motif' END], 'string_agg', ',') AS flags FROM (
SELECT rec_id, x.cpg_obs_exp AS cpg, x.upa_obs_exp AS upa, regexp_matches(s, '{RUN6}') AS homo, regexp_matches(s, '{"|".join(MOTIFS)}') AS motif FROM cds JOIN (SELECT rec_id, {_sql_pair('CG')}, {_sql_pair('TA')} FROM cds) x USING (rec_id))"""
)
def pf_warning_flags(spark, d) -> DataFrame:
    """Flags of a sequence's problems, in fixed order; null when there are none."""
    s = F.col("s")
    flags = F.array_compact(
        F.array(
            F.when(r6(K.pair_bias(s, "CG")["obs_exp"]) > 1.5, "cpg"), F.when(r6(K.pair_bias(s, "TA")["obs_exp"]) > 1.5, "upa"), F.when(F.size(K.homopolymers(s)) > 0, "homopolymer"), F.when(s.rlike("|".join(MOTIFS)), "motif")
        )
    )
    return coding(spark, d).select("rec_id", F.when(F.size(flags) > 0, F.array_join(flags, ",")).alias("flags"))


@query(
    f"""WITH {RECORDS}, refs AS (SELECT s AS ref FROM cds WHERE length(s) >= 60 ORDER BY rec_id LIMIT 3), x AS (SELECT rec_id, list_transform(range(1, least(length(s), length(ref)) + 1), lambda i: (substr(s, i::INT, 1) = substr(ref, i::INT, 1))::INT) AS same, least(length(s), length(ref)) AS n FROM cds, refs)
SELECT rec_id, round(min(list_sum(same) / n), 6) AS min_identity FROM x GROUP BY rec_id"""
)
def sc_min_identity(spark, d) -> DataFrame:
    """Least identity of each sequence to a set of references (the first three long sequences)."""
    rows = coding(spark, d).select("rec_id", "s")
    refs = [r["s"] for r in rows.filter(F.length("s") >= 60).orderBy("rec_id").limit(3).collect()]  # the set is a parameter
    return rows.select("rec_id", r6(K.min_identity(F.col("s"), refs)).alias("min_identity"))


METRICS = ["length", "gc", "cai", "tai", "fop", "cpb", "cpg_obs_exp", "rare_codon_runs", "homopolymers", "forbidden_sites"]


@query(
    f"""WITH {RECORDS}, m AS (SELECT v.rec_id, n_nt AS length, gc, cai, tai, fop, cpb, cpg_obs_exp, rr.n_runs::INT AS rare_codon_runs, h.n_runs::INT AS homopolymers, coalesce(f.k, 0)::INT AS forbidden_sites, check_message AS message FROM ({ORACLE['sc_validate_cds']}) v JOIN ({ORACLE['sc_composition']}) c USING (rec_id)
JOIN ({ORACLE['sc_adaptation']}) a USING (rec_id) JOIN ({ORACLE['sc_codon_pair_bias']}) p USING (rec_id) JOIN ({ORACLE['sc_cpg_upa']}) d USING (rec_id) JOIN ({ORACLE['sc_rare_codon_runs']}) rr USING (rec_id) JOIN ({ORACLE['sc_homopolymers']}) h USING (rec_id)
LEFT JOIN (SELECT rec_id, count(*) AS k FROM ({ORACLE['sc_forbidden_sites']}) GROUP BY rec_id) f USING (rec_id)), w AS (SELECT rec.rec_id, m.* EXCLUDE (rec_id), message = 'OK' AS ok FROM rec LEFT JOIN m USING (rec_id)),
x AS (SELECT *, CASE WHEN ok THEN concat_ws(',', CASE WHEN cpg_obs_exp > 1.5 THEN 'cpg' END, CASE WHEN rare_codon_runs > 0 THEN 'rare_codon_runs' END, CASE WHEN homopolymers > 0 THEN 'homopolymers' END, CASE WHEN forbidden_sites > 0 THEN 'forbidden_sites' END) ELSE '' END AS warnings FROM w)
SELECT rec_id, CASE WHEN NOT coalesce(ok, false) THEN 'error' WHEN warnings <> '' THEN 'warning' ELSE 'success' END AS status, {', '.join(f'CASE WHEN ok THEN {k} END AS {k}' for k in METRICS)}, warnings, CASE WHEN NOT coalesce(ok, false) THEN coalesce(message, 'No sequence.') END AS error FROM x"""
)
def sc_analyze(spark, d) -> DataFrame:
    """Analyser task over all records: envelope with status, metrics, warnings and error."""
    rows = records(spark, d).select("rec_id", "host", "raw", "s").withColumn("cs", K.codons(F.col("s")))
    s = F.col("s")
    check = K.validate_cds(s)
    f = F.col("f")
    rows = rows.withColumn("f", K.codon_facts(F.col("cs"), F.col("host")))
    ok = check == "OK"
    metrics = F.struct(
        F.length(s).alias("length"), r6(K.gc(s)).alias("gc"), r6(K.cai(f)).alias("cai"), r6(K.tai(f)).alias("tai"), r6(K.fop(f)).alias("fop"), r6(K.codon_pair_bias(F.col("cs"), F.col("host"))).alias("cpb"),
        r6(K.pair_bias(s, "CG")["obs_exp"]).alias("cpg_obs_exp"), F.size(K.rare_runs(K.rare_flags(F.col("cs"), F.col("host")))).alias("rare_codon_runs"), F.size(K.homopolymers(s)).alias("homopolymers"), K.motif_hits(s, MOTIFS).alias("forbidden_sites"),
    )
    out = rows.select("rec_id", check.alias("message"), F.when(ok, metrics).alias("metrics"))
    warn = F.array_compact(
        F.array(F.when(F.col("metrics.cpg_obs_exp") > 1.5, "cpg"), F.when(F.col("metrics.rare_codon_runs") > 0, "rare_codon_runs"), F.when(F.col("metrics.homopolymers") > 0, "homopolymers"), F.when(F.col("metrics.forbidden_sites") > 0, "forbidden_sites"))
    )
    status = F.when(F.col("message").isNull() | (F.col("message") != "OK"), "error").when(F.size(warn) > 0, "warning").otherwise("success")
    return out.select("rec_id", status.alias("status"), "metrics.*", F.array_join(warn, ",").alias("warnings"), F.when(status == "error", F.coalesce("message", F.lit("No sequence."))).alias("error"))
