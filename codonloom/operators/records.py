"""Operators on feature records: hits to features, merges with fallback, families, sampling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.seeded import BITS, seeded

#: Ranges of seeded numbers that rows are counted by: 2 ** RANGE_BITS.
RANGE_BITS = 10


def hit_features(hits: DataFrame) -> DataFrame:
    """Per ``query`` the 11 MSA features of its alignment hits (``pident`` 0-100, ``alnlen``)."""
    share = F.col("pident") / 100
    return hits.groupBy("query").agg(
        F.count("*").cast("double").alias("msa_depth"), F.count_if(F.col("pident") >= 50).cast("double").alias("msa_effective_depth"), F.least(F.lit(1.0), F.avg("alnlen") / 100).alias("msa_coverage"),
        F.avg(share).alias("conservation_mean"), F.min(share).alias("conservation_min"), F.max(share).alias("conservation_max"), F.stddev_pop(share).alias("conservation_entropy_mean"),
        F.lit(0.5).alias("coevolution_score"), F.lit(0.3).alias("contact_density"), F.lit(1.0).alias("pfam_count"), F.lit(1.0).alias("domain_count"),
    )


#: The features of a record without alignment hits.
NO_HITS = {
    "msa_depth": 0.0, "msa_effective_depth": 0.0, "msa_coverage": 0.0, "conservation_mean": 0.5, "conservation_min": 0.3, "conservation_max": 0.7, "conservation_entropy_mean": 0.5, "coevolution_score": 0.5,
    "contact_density": 0.3, "pfam_count": 0.0, "domain_count": 0.0,
}


def last_of(rows: DataFrame, key: str, order: list[str]) -> DataFrame:
    """One row per key: the last in the given order; null keys are left out.  The pick is an
    aggregate, so a hot key is reduced before the shuffle."""
    whole = F.struct(*[F.col(c) for c in rows.columns])
    return rows.filter(F.col(key).isNotNull()).groupBy(key).agg(F.max_by(whole, F.struct(*order)).alias("x")).select("x.*")


def content_key(pid: Column, seq: Column, width: int = 16) -> Column:
    return F.concat_ws("_", pid, F.left(F.sha2(seq, 256), F.lit(width)))


def prefixed(features: Column, prefix: str) -> Column:
    return F.transform_keys(features, lambda k, _: F.when(k.startswith(prefix), k).otherwise(F.concat(F.lit(prefix), k)))


def merged(*maps: Column) -> Column:
    """Union of maps; the last value of a key wins, null maps are empty."""
    empty = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<double>"))
    entries = F.concat(*[F.map_entries(F.coalesce(m, empty)) for m in maps])
    keep = F.filter(F.transform(entries, lambda e, i: F.struct(e["key"].alias("k"), e["value"].alias("v"), i.alias("i"))), lambda x: ~F.exists(F.slice(entries, x["i"] + 2, F.size(entries)), lambda y: y["key"] == x["k"]))
    return F.map_from_entries(F.transform(keep, lambda x: F.struct(x["k"], x["v"])))


def numeric_by_prefix(features: Column, prefixes: list[str]) -> Column:
    return F.map_filter(features, lambda k, v: k.rlike("^(" + "|".join(prefixes) + ")") & v.isNotNull())


def host_quotas(counts: dict[str, int], total: int | None, weights: dict[str, float] | None = None, cap: int | None = None) -> dict[str, int]:
    """Rows per host: the least count, or by weight of a total (the last host takes the rest);
    never above the host's count nor, with a total, above ``cap``."""
    if total is None:
        least = min(counts.values(), default=0)
        return dict.fromkeys(counts, least)
    names = sorted(counts)
    shares = weights or {h: 1 / len(names) for h in names}
    out, left = {}, total
    for i, h in enumerate(names):
        want = left if i == len(names) - 1 else int(total * shares.get(h, 0))
        left -= want
        out[h] = min(want, counts[h], cap if cap is not None else want)
    return out


def take_per_key(rows: DataFrame, key: str, quotas: dict[str, int], seed: int, id_col: str) -> DataFrame:
    """Seeded sample of ``quotas[key]`` rows of each key: those with the smallest seeded numbers."""
    q = F.broadcast(rows.sparkSession.createDataFrame(list(quotas.items()), f"`{key}` string, _quota long"))  # one row a key
    return take_lowest(rows.join(q, key), [key], seeded(seed, id_col), [id_col], F.col("_quota")).drop("_quota")


def take_lowest(rows: DataFrame, part: list[str], number: Column, ties: list[str], quota: Column) -> DataFrame:
    """The ``quota`` rows of each part with the smallest ``number`` (of :func:`seeded`; ties: the
    given columns).

    Rows are counted by ranges of the number first, so that a part with all the rows is ranked
    range by range and never sorted in one task."""
    h = rows.withColumn("_h", number).withColumn("_s", F.shiftright("_h", BITS - RANGE_BITS))
    cells = h.groupBy(*part, "_s").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(*part, F.lit(0)).orderBy("_s").rowsBetween(Window.unboundedPreceding, -1)  # one row a range
    cells = cells.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    near = h.join(F.broadcast(cells) if not part else cells, [*part, "_s"]).filter(F.col("_before") < quota)
    rank = F.row_number().over(Window.partitionBy(*part, "_s").orderBy("_h", *ties)) + F.col("_before")
    return near.withColumn("_r", rank).filter(F.col("_r") <= quota).drop("_h", "_s", "_r", "_before")


def stratified_cap(rows: DataFrame, group: list[str], band: str, cap: int, seed: int, id_col: str) -> DataFrame:
    """At most ``cap`` rows of each group: of each band its share of the cap (at least one row),
    then whatever rows come next, until the cap is met; all by seeded number.

    Only the ``cap`` lowest rows of each (group, band) are ranked against each other, so a group
    with all the rows is no single task.  Null bands are a band of their own."""
    h = seeded(seed, id_col)
    sizes = rows.groupBy(*group, band).agg(F.count("*").alias("_m"))
    sizes = sizes.withColumn("_n", F.sum("_m").over(Window.partitionBy(*group)))  # one row a band
    share = F.when(F.col("_n") <= cap, F.col("_m")).otherwise(F.least("_m", F.greatest(F.lit(1), F.floor(cap * F.col("_m") / F.col("_n")))))
    low = take_lowest(rows.withColumn("_b", F.coalesce(F.col(band).cast("string"), F.lit(""))), [*group, "_b"], h, [id_col], F.lit(cap)).withColumn("_h", h)
    low = low.join(sizes.select(*group, F.coalesce(F.col(band).cast("string"), F.lit("")).alias("_b"), share.alias("_quota")), [*group, "_b"])
    over = F.row_number().over(Window.partitionBy(*group, "_b").orderBy("_h", id_col)) > F.col("_quota")  # cap rows at most
    place = F.row_number().over(Window.partitionBy(*group).orderBy("_over", "_h", id_col))  # cap rows a band
    return low.withColumn("_over", over).withColumn("_place", place).filter(F.col("_place") <= cap).select(*rows.columns)
