"""Back-translation and candidate generation as Column expressions with hashed uniforms."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import genetics as G
from ..functions import kernels as K
from ..functions.seeded import uniform

METHODS = ("hfc", "bfc", "urc", "softmax")


def _residue_table(host: str, method: str, temperature: float) -> Column:
    """Map of residue to an array of (cumulative share, codon)."""
    use = G.usage(host)
    entries = []
    for aa, cs in G.CODONS_OF.items():
        if aa == "*":
            continue
        if method == "hfc":
            w = [1.0 if i == max(range(len(cs)), key=lambda j: use[cs[j]]) else 0.0 for i in range(len(cs))]
        elif method == "urc":
            w = [1.0] * len(cs)
        elif method == "softmax":
            top = max(use[c] for c in cs)
            w = [math.exp((use[c] - top) / max(1e-6, temperature)) for c in cs]
        else:
            w = [use[c] for c in cs]
        run, steps = 0.0, []
        for c, x in zip(cs, w, strict=True):
            run += x / sum(w)
            if x > 0:
                steps.append(F.struct(F.lit(run).alias("upto"), F.lit(c).alias("codon")))
        entries += [F.lit(aa), F.array(*steps)]
    return F.create_map(*entries)


def back_translate(protein: Column, host: str, method: str, seed: Column, temperature: float = 1.0) -> Column:
    """A coding sequence of the protein.

    hfc: the most used codon; bfc: by use; urc: any codon alike; softmax: by exp(use / t).
    Unknown residues are left out; null gives null, an empty protein an empty text."""
    if method not in METHODS:
        raise ValueError(f"unknown method {method}")
    table = _residue_table(host, method, temperature)

    def pick(aa: Column, i: Column) -> Column:
        steps = F.try_element_at(table, aa)
        if method == "hfc":
            return F.get(steps, F.lit(0))["codon"]

        def drawn(x: Column) -> Column:
            return F.coalesce(F.get(F.filter(x["steps"], lambda s: x["u"] < s["upto"]), F.lit(0))["codon"], F.get(x["steps"], F.size(x["steps"]) - 1)["codon"])

        # the number is drawn once a place, not for each codon of the residue
        return K.bind(F.struct(steps.alias("steps"), uniform(seed, i).alias("u")), drawn)

    return F.array_join(F.array_compact(F.transform(K.letters(protein), pick)), "")


def avoids(s: Column, motifs: list[str]) -> Column:
    return K.motif_hits(s, motifs) == 0 if motifs else F.lit(True)


def constrained(protein: Column, host: str, motifs: list[str], seed: Column, retries: int = 5, temperature: float = 1.0) -> Column:
    """Greedy decoding, codon by codon: each position draws up to ``retries`` codons and keeps the
    first that completes no motif; if none does, the last draw stays."""
    table = _residue_table(host, "softmax", temperature)
    longest = max((len(m) for m in motifs), default=0)

    def step(acc: Column, x: Column) -> Column:
        steps = F.try_element_at(table, x["aa"])

        def draw(t: int) -> Column:
            u = uniform(seed, x["i"], F.lit(t))
            return F.coalesce(F.get(F.filter(steps, lambda s: u < s["upto"]), F.lit(0))["codon"], F.get(steps, F.size(steps) - 1)["codon"], F.lit(""))

        tail = F.right(acc, F.lit(max(0, longest - 1)))
        chosen = draw(retries - 1)
        for t in range(retries - 2, -1, -1):
            c = draw(t)
            bad = F.concat(tail, c).rlike("|".join(motifs)) if motifs else F.lit(False)
            chosen = F.when(~bad, c).otherwise(chosen)
        return F.concat(acc, chosen)

    return F.aggregate(F.transform(K.letters(protein), lambda aa, i: F.struct(aa.alias("aa"), i.alias("i"))), F.lit(""), step)


def candidates(proteins: DataFrame, id_col: str, protein_col: str, host: str, n: int, method: str = "bfc", motifs: list[str] | None = None, seed: int = 1, oversample: int = 3, temperature: float = 1.0) -> DataFrame:
    """``id, candidate, dna``: up to ``n`` distinct valid candidates per protein: oversampled,
    filtered (valid, exact translation, no motif), deduplicated, numbered in order of draw."""
    from pyspark.sql import Window

    draws = proteins.select(F.col(id_col).alias("id"), F.col(protein_col).alias("aa")).dropna().withColumn("draw", F.explode(F.sequence(F.lit(1), F.lit(n * oversample))))
    # a generator's output is made once; a filter on a projection would draw each sequence again for each check
    made = draws.withColumn("dna", F.explode(F.array(back_translate(F.col("aa"), host, method, F.concat_ws(":", "id", "draw", F.lit(seed)), temperature))))
    good = made.filter((K.validate_cds(F.col("dna")) == "OK") & (K.translate(K.codons(F.col("dna"))) == F.col("aa")) & avoids(F.col("dna"), motifs or []))
    first = good.groupBy("id", "dna").agg(F.min("draw").alias("draw"))
    rank = F.row_number().over(Window.partitionBy("id").orderBy("draw"))  # n * oversample rows at most
    return first.withColumn("candidate", rank).filter(F.col("candidate") <= n).select("id", "candidate", "dna")


def policy_log_prob(cs: Column, logits: dict[str, float]) -> Column:
    """Log probability of a codon choice under softmax logits within each residue's family."""
    logp = {}
    for aa, own in G.CODONS_OF.items():
        if aa == "*":
            continue
        x = [logits.get(c, 0.0) for c in own]
        z = max(x) + math.log(sum(math.exp(v - max(x)) for v in x))
        logp |= {c: v - z for c, v in zip(own, x, strict=True)}
    weights = F.lit([logp.get(c, 0.0) for c in K.ALL_CODONS])
    return K.total(F.zip_with(K.codon_counts(cs), weights, lambda k, w: k * w))


def policy_update(samples: DataFrame, codons_col: str, reward_col: str, logits: dict[str, float], rate: float = 0.1) -> dict[str, float]:
    """One policy-gradient step: the mean over samples of (reward - mean reward) times the
    gradient of the log probability.  The data are reduced to 64 sums; null rewards count not."""
    rows = samples.filter(F.col(reward_col).isNotNull()).withColumn("_k", K.codon_counts(F.col(codons_col)))
    n = rows.agg(F.count("*").alias("n"), F.avg(reward_col).alias("m")).first()
    if not n["n"]:
        return dict(logits)
    adv = F.col(reward_col) - n["m"]
    sums = rows.select(adv.alias("a"), F.posexplode("_k").alias("i", "k")).groupBy("i").agg(F.sum(F.col("a") * F.col("k")).alias("g")).collect()  # 64 rows
    pull = {K.ALL_CODONS[r["i"]]: r["g"] / n["n"] for r in sums}
    out = dict(logits)
    for aa, own in G.CODONS_OF.items():
        if aa == "*":
            continue
        x = [logits.get(c, 0.0) for c in own]
        z = sum(math.exp(v - max(x)) for v in x)
        family = sum(pull.get(c, 0.0) for c in own)
        for c, v in zip(own, x, strict=True):
            out[c] = v + rate * (pull.get(c, 0.0) - family * math.exp(v - max(x)) / z)
    return out


def ranked(cands: DataFrame, score: str, k: int) -> DataFrame:
    """The k best candidates of each protein (ties: smaller candidate number)."""
    from pyspark.sql import Window

    w = Window.partitionBy("id").orderBy(F.desc(score), "candidate")
    return cands.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
