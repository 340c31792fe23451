"""Sequence kernels: pure Column expressions over coding sequences and proteins.

Every function takes Columns and returns a Column that Catalyst evaluates in the JVM.  Null in
gives null out unless a docstring says otherwise; empty texts give the neutral value named there.
Positions are 0-based.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import genetics as G

STOP_PATTERN = "TAA|TAG|TGA"


def dna(c: Column) -> Column:
    """Upper case with T for U."""
    return F.translate(F.upper(c), "U", "T")


def codons(s: Column) -> Column:
    """Non-overlapping triplets from the start; a rest of one or two letters is left out."""
    return F.regexp_extract_all(s, F.lit(r"([\s\S]{3})"), F.lit(1))


def fraction(hits: Column, n: Column) -> Column:
    return F.coalesce(F.try_divide(hits.cast("double"), n.cast("double")), F.lit(0.0))


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x)


def mean(values: Column, empty: float | None = 0.0) -> Column:
    out = F.try_divide(total(values), F.size(values).cast("double"))
    return F.coalesce(out, F.lit(empty)) if empty is not None else out


def clamp(x: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(float(low)), F.least(F.lit(float(high)), x))


def bind(value: Column, use) -> Column:
    """``use(value)`` with the value computed once a row, not once for every lambda call in it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def letters(s: Column) -> Column:
    return F.filter(F.split(s, ""), lambda c: c != "")


# --- composition -----------------------------------------------------------------------------


def gc(s: Column) -> Column:
    """Share of G and C; an empty text has 0."""
    return fraction(F.regexp_count(s, F.lit("[GC]")), F.length(s))


def base_share(s: Column, base: str) -> Column:
    return fraction(F.regexp_count(s, F.lit(base)), F.length(s))


def codon_diversity(cs: Column) -> Column:
    return fraction(F.size(F.array_distinct(cs)), F.size(cs))


ALL_CODONS = [a + b + c for a in "ACGT" for b in "ACGT" for c in "ACGT"]


def codon_counts(cs: Column) -> Column:
    """Counts of the 64 codons, in order of text: one native replacement scan per codon."""
    return bind(F.array_join(cs, ","), lambda m: F.transform(F.lit(ALL_CODONS), lambda c: (F.length(m) - F.length(F.replace(m, c, F.lit("")))) / 3))


def codon_shares(cs: Column) -> Column:
    """Shares of the 64 codons among all, in order of text; zeros without codons."""
    return bind(F.size(cs), lambda n: F.transform(codon_counts(cs), lambda k: fraction(k, n)))


def marker_codon_share(cs: Column) -> Column:
    """Share of ATG and the stops among the codons."""
    return fraction(F.size(F.filter(cs, lambda c: c.isin("ATG", *G.STOPS))), F.size(cs))


def sliding_gc(s: Column, window: int = 50, step: int = 10) -> Column:
    """GC of the full windows starting at 0, step, 2 step ...; shorter texts have none."""
    starts = F.when(F.length(s) >= window, F.sequence(F.lit(0), F.length(s) - window, F.lit(step))).otherwise(F.array().cast("array<int>"))
    return bind(s, lambda t: F.transform(starts, lambda i: F.regexp_count(F.substring(t, i + 1, F.lit(window)), F.lit("[GC]")) / F.lit(float(window))))


def window_stats(values: Column) -> Column:
    """Struct of mean, population deviation, least and largest; zeros when there are none."""
    m = mean(values)
    var = bind(m, lambda c: mean(F.transform(values, lambda x: (x - c) * (x - c))))
    return F.struct(m.alias("mean"), F.sqrt(var).alias("std"), F.coalesce(F.array_min(values), F.lit(0.0)).alias("min"), F.coalesce(F.array_max(values), F.lit(0.0)).alias("max"))


def homopolymers(s: Column, least: int = 6) -> Column:
    """Maximal runs of one character of at least that length, as texts."""
    return F.regexp_extract_all(s, F.lit(rf"(([\s\S])\2{{{least - 1},}})"), F.lit(1))


def run_spans(s: Column, least: int) -> Column:
    """Maximal runs of one character of at least that length: array of ``pos`` (from 0), ``len``,
    ``base``."""
    at = F.when(F.length(s) > 0, F.sequence(F.lit(1), F.length(s))).otherwise(F.array().cast("array<int>"))
    starts = F.filter(at, lambda i: (i == 1) | (F.substring(s, i, F.lit(1)) != F.substring(s, i - 1, F.lit(1))))

    def spans(x: Column) -> Column:
        ends = F.concat(F.slice(x, 2, F.greatest(F.size(x), F.lit(1))), F.array(F.length(s) + 1))
        return F.filter(F.zip_with(x, ends, lambda a, b: F.when(a.isNotNull(), F.struct((a - 1).alias("pos"), (b - a).alias("len"), F.substring(s, a, F.lit(1)).alias("base")))), lambda r: r["len"] >= least)

    return bind(starts, spans)


def letter_runs(s: Column, letter: str, least: int) -> Column:
    """Maximal runs of that letter (of a regular expression's plain ones) of at least that length:
    array of ``pos`` (from 0), ``len``.

    Each match is a run with all that stands between it and the run before it, so positions follow
    from lengths, in one scan of the text."""
    start = F.struct(F.array().cast("array<struct<pos: int, len: int>>").alias("out"), F.lit(0).alias("next"))

    def step(acc: Column, m: Column) -> Column:
        end = acc["next"] + F.length(m)
        n = F.length(m) - F.length(F.rtrim(m, F.lit(letter)))
        return F.struct(F.concat(acc["out"], F.array(F.struct((end - n).alias("pos"), n.alias("len")))).alias("out"), end.alias("next"))

    found = F.regexp_extract_all(s, F.lit(rf"\G([\s\S]*?{letter}{{{least},}})"), F.lit(1))
    return F.aggregate(found, start, step, lambda acc: acc["out"])


def tandem_spans(s: Column, unit: int, least: int = 3) -> Column:
    """The repeats of :func:`tandem_repeats` as array of ``pos`` (from 0), ``len``, ``motif``.

    A repeat cannot stand further left than where it was found, or it had been found there, so its
    text is located behind the repeat before it."""
    start = F.struct(F.array().cast("array<struct<pos: int, len: int, motif: string>>").alias("out"), F.lit(1).alias("next"))

    def step(acc: Column, m: Column) -> Column:
        p = F.position(m, s, acc["next"])
        return F.struct(F.concat(acc["out"], F.array(F.struct((p - 1).alias("pos"), F.length(m).alias("len"), F.left(m, F.lit(unit)).alias("motif")))).alias("out"), (p + F.length(m)).alias("next"))

    return F.aggregate(tandem_repeats(s, unit, least), start, step, lambda acc: acc["out"])


def longest_run(s: Column) -> Column:
    runs = F.regexp_extract_all(s, F.lit(r"(([\s\S])\2*)"), F.lit(1))
    return F.coalesce(F.array_max(F.transform(runs, F.length)), F.lit(0))


def tandem_repeats(s: Column, unit: int, least: int = 3) -> Column:
    """Leftmost greedy repeats of a unit of that many bases, as texts."""
    return F.regexp_extract_all(s, F.lit(rf"(([ACGT]{{{unit}}})\2{{{least - 1},}})"), F.lit(1))


def dinucleotide(s: Column, two: str) -> Column:
    """Overlapping count of a pair of bases."""
    return F.regexp_count(s, F.lit(f"{two[0]}(?={two[1]})"))


def pair_bias(s: Column, two: str) -> Column:
    """Struct of count, frequency per 100 positions and observed over expected of a pair."""
    n = F.length(s).cast("double")
    seen = dinucleotide(s, two).cast("double")
    expected = F.regexp_count(s, F.lit(two[0])) / n * (F.regexp_count(s, F.lit(two[1])) / n) * (n - 1)
    return F.struct(
        seen.alias("count"),
        F.when(n > 1, seen / (n - 1) * 100).otherwise(0.0).alias("freq"),
        F.when((n > 1) & (expected > 0), seen / expected).otherwise(0.0).alias("obs_exp"),
    )


def motif_hits(s: Column, motifs: list[str]) -> Column:
    """Overlapping occurrences of all motifs."""
    out = F.lit(0)
    for m in motifs:
        out = out + F.regexp_count(s, F.lit(f"(?={m})"))
    return out


def motif_positions(s: Column, motif: str) -> Column:
    n = len(motif)
    at = F.when(F.length(s) >= n, F.sequence(F.lit(0), F.length(s) - n)).otherwise(F.array().cast("array<int>"))
    return bind(s, lambda t: F.filter(at, lambda i: F.substring(t, i + 1, F.lit(n)) == motif))


# --- coding sequence -------------------------------------------------------------------------


def validate_cds(s: Column) -> Column:
    """The first failed check, else ``OK``; null for null."""

    def check(t: Column) -> Column:
        return (
            F.when(t.isNull(), F.lit(None).cast("string"))
            .when(F.length(t) % 3 != 0, "Length not multiple of 3.")
            .when(t.rlike("[^ACGT]"), "Non-ACGT characters found.")
            .when(F.length(t) == 0, "Empty CDS.")
            .when(~t.startswith("ATG"), "CDS does not start with ATG.")
            .when(F.right(t, F.lit(3)).isin(*G.STOPS), "CDS ends with a STOP codon; exclude terminal stop for scoring.")
            .when(t.rlike(f"^(?:...)*?(?:{STOP_PATTERN})"), "Internal STOP codon detected.")
            .otherwise("OK")
        )

    return bind(s, check)


def without_stop(s: Column) -> Column:
    """The sequence without one terminal stop codon in frame."""
    return bind(s, lambda t: F.when((F.length(t) % 3 == 0) & F.right(t, F.lit(3)).isin(*G.STOPS), F.left(t, F.length(t) - 3)).otherwise(t))


def _literal_map(values: dict) -> Column:
    return F.create_map(*[x for k, v in values.items() for x in (F.lit(k), v)])


def translate(cs: Column) -> Column:
    """Protein of the codons; unknown codons give X, stops ``*``."""
    code = _literal_map({c: F.lit(a) for c, a in G.AA_OF.items()})
    return F.array_join(F.transform(cs, lambda c: F.coalesce(F.try_element_at(code, c), F.lit("X"))), "")


def _looked_up(keys: Column, values: Column) -> Column:
    return F.transform(keys, lambda k: F.try_element_at(values, k))


def by_host(host: Column, value) -> Column:
    """``value(name)`` of the row's host; unknown and null hosts count as E_coli."""
    out = value("E_coli")
    for name in G.HOSTS[1:]:
        out = F.when(host == name, value(name)).otherwise(out)
    return out


def codon_facts(cs: Column, host: Column) -> Column:
    """Sums over the sense codons with the host's tables, as a struct ``n, lw, lt, lp, opt``:
    number, log adaptiveness, log tRNA adaptiveness, log share in the family, optimal codons.

    The sums are products of the 64 counts with constant vectors, so their cost does not depend
    on the length of the sequence; codons with other letters are in none of them."""

    def vector(name: str, field) -> list[float]:
        t = G.codon_table(name)
        return [0.0 if t[c]["aa"] == "*" else field(t[c]) for c in ALL_CODONS]

    fields = {
        "n": lambda f: 1.0,
        "lw": lambda f: G.logs(f["w"]),
        "lt": lambda f: G.logs(f["t"]),
        "lp": lambda f: G.logs(f["p"]),
        "opt": lambda f: float(f["opt"]),
    }

    def sums(counts: Column) -> Column:
        dots = []
        for field, get in fields.items():
            weights = F.lit(vector("E_coli", get)) if field == "n" else by_host(host, lambda name, get=get: F.lit(vector(name, get)))
            dots.append(total(F.zip_with(counts, weights, lambda k, w: k * w)).alias(field))
        return F.struct(*dots)

    return bind(codon_counts(cs), sums)


def _geometric(facts: Column, field: str) -> Column:
    return F.coalesce(F.exp(F.try_divide(facts[field], facts["n"])), F.lit(0.0))


def cai(facts: Column) -> Column:
    """Geometric mean of the adaptiveness of all sense codons (single-codon families too)."""
    return _geometric(facts, "lw")


def tai(facts: Column) -> Column:
    return _geometric(facts, "lt")


def fop(facts: Column) -> Column:
    return F.coalesce(F.try_divide(facts["opt"], facts["n"]), F.lit(0.0))


def rare_flags(cs: Column, host: Column) -> Column:
    """One letter a codon: 1 if rare in the host, else 0 (other codons and stops are not)."""

    def flags(name: str) -> Column:
        rare = [c for c, f in G.codon_table(name).items() if f["rare"]]
        return F.transform(cs, lambda c: F.when(c.isin(*rare), "1").otherwise("0"))

    return F.array_join(by_host(host, flags), "")


def rare_runs(flags: Column, least: int = 3) -> Column:
    return F.regexp_extract_all(flags, F.lit(f"(1{{{least},}})"), F.lit(1))


def pair_scores(cs: Column, host: Column) -> Column:
    """Scores of the adjacent codon pairs that the host's table holds."""
    both = F.when(F.size(cs) > 1, F.zip_with(F.slice(cs, 1, F.size(cs) - 1), F.slice(cs, 2, F.size(cs) - 1), lambda a, b: F.concat(a, F.lit("-"), b))).otherwise(
        F.array().cast("array<string>")
    )
    out = F.array().cast("array<double>")
    for name in reversed(G.HOSTS):
        table = _literal_map({k: F.lit(v) for k, v in G.pairs(name).items()})
        out = F.when(host == name, F.array_compact(_looked_up(both, table))).otherwise(out)
    return out


def codon_pair_bias(cs: Column, host: Column) -> Column:
    return mean(pair_scores(cs, host))


def codon_pair_score(pairs_seen: Column, pair_share: Column, first_share: Column, second_share: Column) -> Column:
    """ln(F_ab / (F_a F_b)) of one pair where all shares are positive."""
    return F.when((pair_share > 0) & (first_share > 0) & (second_share > 0), F.log(pair_share / (first_share * second_share)))


def mean_pair_score(cs: Column, host: Column, shares: dict[str, dict[str, float]]) -> Column:
    """Mean codon pair score of the adjacent pairs with a known share (``host -> pair -> share``)
    and codon use above 0; 0 without such pairs."""
    both = F.when(F.size(cs) > 1, F.zip_with(F.slice(cs, 1, F.size(cs) - 1), F.slice(cs, 2, F.size(cs) - 1), lambda a, b: F.concat(a, F.lit("-"), b))).otherwise(
        F.array().cast("array<string>")
    )
    out = F.array().cast("array<double>")
    for name in reversed(G.HOSTS):
        use = G.usage(name)
        known = {p: math.log(x / (use[p[:3]] * use[p[4:]])) for p, x in shares.get(name, {}).items() if x > 0 and use.get(p[:3], 0) * use.get(p[4:], 0) > 0}
        if known:
            out = F.when(host == name, F.array_compact(_looked_up(both, _literal_map({k: F.lit(v) for k, v in known.items()})))).otherwise(out)
    return mean(out)


def lm_stats(loglik: Column, n: Column) -> Column:
    """Struct ``loglik, avg_loglik, perplexity, geom, score`` of n log probabilities' sum; none
    gives 0, 0, 1, 1, 1."""
    avg = F.coalesce(F.try_divide(loglik, n.cast("double")), F.lit(0.0))
    geom = F.exp(avg)
    return F.struct(loglik.alias("loglik"), avg.alias("avg_loglik"), F.exp(-avg).alias("perplexity"), geom.alias("geom"), F.pow(geom, F.lit(1 / 3)).alias("score"))


def usage_lm(facts: Column) -> Column:
    """:func:`lm_stats` of the codon-usage model."""
    return lm_stats(facts["lp"], facts["n"])


def reverse_complement(s: Column) -> Column:
    return F.reverse(F.translate(s, "ACGT", "TGCA"))


def five_prime_structure(s: Column, window: int = 45) -> Column:
    """Minus the weighted number of k-mers (k 5, 4, 3; weight 6 - k) of the window behind the
    start codon that its reverse complement holds too."""

    def shared(k: int, w: Column, rc: Column) -> Column:
        at = F.when(F.length(w) >= k, F.sequence(F.lit(1), F.length(w) - (k - 1))).otherwise(F.array().cast("array<int>"))
        return F.size(F.filter(at, lambda i: F.contains(rc, F.substring(w, i, F.lit(k)))))

    def score(x: Column) -> Column:
        return -(shared(5, x["w"], x["rc"]) * 1.0 + shared(4, x["w"], x["rc"]) * 2.0 + shared(3, x["w"], x["rc"]) * 3.0)

    w = F.substring(s, 4, window)
    return bind(F.struct(w.alias("w"), reverse_complement(w).alias("rc")), score)


def mfe_note(s: Column, utr5: Column) -> Column:
    long = F.length(s) >= 51
    return F.when(utr5 >= 20, F.when(long, "utr_available_but_cds_only").otherwise("utr_available_but_short_cds")).otherwise(
        F.when(long, "no_utr_fallback").otherwise("no_utr_fallback_short")
    )


def identity(a: Column, b: Column, longest: bool = False) -> Column:
    """Equal letters of the aligned prefixes over the shorter (or the longer) length."""
    n = F.least(F.length(a), F.length(b))
    at = F.when(n > 0, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>"))
    same = F.size(F.filter(F.zip_with(F.slice(letters(a), 1, F.greatest(n, F.lit(1))), F.slice(letters(b), 1, F.greatest(n, F.lit(1))), lambda x, y: x == y), lambda x: x))
    return fraction(F.when(F.size(at) > 0, same).otherwise(0), F.greatest(F.length(a), F.length(b)) if longest else n)


def min_identity(s: Column, references: list[str]) -> Column:
    """Least identity to a set of references; 0 for an empty set."""
    return F.array_min(F.array(*[identity(s, F.lit(r)) for r in references])) if references else F.lit(0.0)


def kmers(s: Column, k: int) -> Column:
    """Distinct k-mers; shorter texts have none."""
    at = F.when(F.length(s) >= k, F.sequence(F.lit(1), F.length(s) - (k - 1))).otherwise(F.array().cast("array<int>"))
    return F.array_distinct(bind(s, lambda t: F.transform(at, lambda i: F.substring(t, i, F.lit(k)))))


def jaccard(a: Column, b: Column) -> Column:
    return F.when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(fraction(F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b))))


# --- protein ---------------------------------------------------------------------------------


def residue_counts(p: Column) -> Column:
    """Map of residue to count, one pass over the distinct letters."""
    return bind(p, lambda t: F.map_from_entries(F.transform(F.array_distinct(letters(t)), lambda c: F.struct(c, F.length(t) - F.length(F.replace(t, c))))))


def scale_mean(counts: Column, n: Column, scale: str, empty: float) -> Column:
    """Mean of a residue scale from the counts of residues."""
    values = _literal_map({r: F.lit(v[scale]) for r, v in G.SCALES.items()})
    sums = F.aggregate(F.map_entries(counts), F.lit(0.0), lambda a, e: a + e["value"] * F.coalesce(F.try_element_at(values, e["key"]), F.lit(G.SCALE_DEFAULT[scale])))
    return F.coalesce(F.try_divide(sums, n.cast("double")), F.lit(empty))


def entropy(counts: Column, n: Column) -> Column:
    """Shannon entropy of the residues in bits; 0 when empty."""
    return bind(n, lambda m: F.aggregate(F.map_values(counts), F.lit(0.0), lambda a, c: a - c / m * F.log2(c / m)))


def complexity(counts: Column, n: Column) -> Column:
    return F.when(n > 0, (F.size(counts) / F.lit(20.0) + entropy(counts, n) / math.log2(20)) / 2).otherwise(0.5)


def composition_similarity(counts: Column, n: Column) -> Column:
    expected = _literal_map({r: F.lit(v["typical_share"]) for r, v in G.SCALES.items()})

    def term(e: Column, m: Column) -> Column:
        x = F.coalesce(F.try_element_at(expected, e["key"]), F.lit(G.SCALE_DEFAULT["typical_share"]))
        return 1 - F.least(F.lit(1.0), F.abs(e["value"] / m - x) / x)

    return bind(n, lambda m: F.aggregate(F.map_entries(counts), F.lit(0.0), lambda a, e: a + term(e, m))) / 20


def signal_peptide(p: Column) -> Column:
    """1 if over half of the first 20 residues are strongly hydrophobic, in texts of 20 or more."""
    return F.when(F.length(p) >= 20, (F.regexp_count(F.left(p, F.lit(20)), F.lit("[IVLFC]")) / F.lit(20.0) > 0.5).cast("double")).otherwise(0.0)


def membrane_windows(p: Column, window: int = 20) -> Column:
    """Number of (overlapping) windows with over 70 % of I, V, L, F."""
    flags = F.regexp_replace(F.regexp_replace(p, "[^IVLF]", "0"), "[IVLF]", "1")
    at = F.when(F.length(p) >= window, F.sequence(F.lit(1), F.length(p) - (window - 1))).otherwise(F.array().cast("array<int>"))
    return F.size(bind(flags, lambda t: F.filter(at, lambda i: F.regexp_count(F.substring(t, i, F.lit(window)), F.lit("1")) / F.lit(float(window)) > 0.7)))


def salt_bridges(p: Column, reach: int = 10) -> Column:
    """Pairs of a positive (R, K) and a negative (D, E) residue at most ``reach`` apart."""
    cs = letters(p)
    at = F.filter(F.transform(cs, lambda c, i: F.struct(c.alias("c"), i.alias("i"))), lambda x: x["c"].isin("R", "K", "D", "E"))

    def count(charged: Column) -> Column:
        plus = F.transform(F.filter(charged, lambda x: x["c"].isin("R", "K")), lambda x: x["i"])
        minus = F.transform(F.filter(charged, lambda x: x["c"].isin("D", "E")), lambda x: x["i"])
        return bind(minus, lambda m: F.aggregate(plus, F.lit(0), lambda a, i: a + F.size(F.filter(m, lambda j: F.abs(i - j) <= reach))))

    return bind(at, count)
