"""Profiling: summaries, quantiles, correlations, outliers and availability."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ordinals import running_sum

# The quantiles of a profile.
QUANTILES = (0.01, 0.05, 0.25, 0.50, 0.75, 0.95, 0.99)


def number(c: Column) -> Column:
    """The value as a finite-or-infinite double; NaN counts as missing."""
    x = c.cast("double")
    return F.when(~F.isnan(x), x)


def stacked(df: DataFrame, columns: list[str]) -> DataFrame:
    """``column, value`` of the numeric columns, one row a cell: one pass over the table."""
    cells = F.array(*[F.struct(F.lit(c).alias("column"), number(F.col(c)).alias("value")) for c in columns])
    return df.select(F.explode(cells).alias("x")).select("x.column", "x.value")


def numeric_summary(df: DataFrame, columns: list[str]) -> DataFrame:
    """Count, missing, mean, sample deviation (null for one value), least and largest."""
    return (
        stacked(df, columns)
        .groupBy("column")
        .agg(
            F.count("value").alias("n"), F.count_if(F.col("value").isNull()).alias("missing"), F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"), F.min("value").alias("min"), F.max("value").alias("max")
        )
    )


def value_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    """``column, value, k, hi, n``: the count of each distinct value, the count up to and with it,
    and of all values; ranks come from range partitions of the distinct values."""
    counts = stacked(df, columns).filter("value is not null").groupBy("column", "value").agg(F.count("*").alias("k"))
    run = running_sum(counts, ["column"], ["value"], "k", "hi")
    return run.join(F.broadcast(run.groupBy("column").agg(F.sum("k").alias("n"))), "column")  # one row a column


def nearest_rank(df: DataFrame, columns: list[str], quantiles: tuple[float, ...] = QUANTILES) -> DataFrame:
    """Exact quantiles by nearest rank with half-to-even rounding of ``p (n - 1)``."""
    ranks = F.array(*[F.struct(F.lit(p).alias("p"), F.bround(F.lit(p) * (F.col("n") - 1), 0).cast("long").alias("r")) for p in quantiles])
    hit = value_counts(df, columns).select("column", "value", "hi", "k", F.explode(ranks).alias("q")).filter((F.col("q.r") < F.col("hi")) & (F.col("q.r") >= F.col("hi") - F.col("k")))
    return hit.select("column", F.col("q.p").alias("p"), "value")


def linear_quantiles(df: DataFrame, columns: list[str], quantiles: tuple[float, ...]) -> DataFrame:
    """``column, p, value``: exact quantiles with linear interpolation between the neighbours of
    ``p (n - 1)``; columns without values have no rows."""
    at = lambda p: F.lit(p) * (F.col("n") - 1)
    ends = [F.struct(F.lit(p).alias("p"), f(at(p)).cast("long").alias("r"), F.lit(i).alias("end"), (at(p) - F.floor(at(p))).alias("share")) for p in quantiles for i, f in enumerate((F.floor, F.ceil))]
    hit = value_counts(df, columns).select("column", "value", "hi", "k", F.explode(F.array(*ends)).alias("q")).filter((F.col("q.r") < F.col("hi")) & (F.col("q.r") >= F.col("hi") - F.col("k")))
    low, high = F.max(F.when(F.col("q.end") == 0, F.col("value"))), F.max(F.when(F.col("q.end") == 1, F.col("value")))
    both = hit.groupBy("column", F.col("q.p").alias("p")).agg(low.alias("a"), high.alias("b"), F.max("q.share").alias("s"))
    return both.select("column", "p", (F.col("a") + (F.col("b") - F.col("a")) * F.col("s")).alias("value"))


def sketched(df: DataFrame, columns: list[str], quantiles: tuple[float, ...] = QUANTILES, accuracy: int = 10_000) -> DataFrame:
    """Mergeable approximate quantiles: bounded state whatever the number of rows."""
    got = stacked(df, columns).groupBy("column").agg(F.percentile_approx("value", list(quantiles), accuracy).alias("v"))
    return got.select("column", F.explode(F.arrays_zip(F.lit(list(quantiles)).alias("p"), F.col("v").alias("value"))).alias("x")).select("column", "x.p", "x.value")


def top_values(df: DataFrame, column: str, k: int) -> DataFrame:
    """The k most frequent values with their counts (ties: smaller value first)."""
    return df.filter(F.col(column).isNotNull()).groupBy(F.col(column).cast("string").alias("value")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "value").limit(k)


def correlation_pairs(df: DataFrame, columns: list[str], listwise: bool) -> DataFrame:
    """Pearson correlation of all pairs, in one aggregation.  listwise: only rows without any
    missing value; else all rows where both are present.  Zero variance gives 0 (listwise) or
    null (pairwise)."""
    vals = {c: number(F.col(c)) for c in columns}
    rows = df.select(*[v.alias(c) for c, v in vals.items()])
    if listwise:
        rows = rows.dropna()
    aggs, names = [], []
    for i, a in enumerate(columns):
        for b in columns[i + 1 :]:
            both = F.col(a).isNotNull() & F.col(b).isNotNull()
            x, y = F.when(both, F.col(a)), F.when(both, F.col(b))
            r = F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y))
            r = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.coalesce(r, F.lit(0.0)) if listwise else r))
            aggs.append((F.when(F.lit(True), r)).alias(f"r{len(names)}"))
            names.append((a, b))
    one = rows.agg(*aggs)
    return one.select(F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"r{i}").alias("r")) for i, (a, b) in enumerate(names)])).alias("x")).select("x.*")


def iqr_outliers(df: DataFrame, columns: list[str]) -> DataFrame:
    """Share of values outside 1.5 IQR of linear quartiles; nulls stay in the denominator."""
    cells = stacked(df, columns)
    at = lambda p: F.max(F.when(F.col("p") == p, F.col("value")))
    q = linear_quantiles(df, columns, (0.25, 0.75)).groupBy("column").agg(at(0.25).alias("q1"), at(0.75).alias("q3"))
    low, high = F.col("q1") - 1.5 * (F.col("q3") - F.col("q1")), F.col("q3") + 1.5 * (F.col("q3") - F.col("q1"))
    # one row a column
    return cells.join(F.broadcast(q), "column", "left").groupBy("column").agg((F.count_if((F.col("value") < low) | (F.col("value") > high)) / F.count("*") * 100).alias("outlier_pct"))


def histogram(value: Column, edges: list[float], open_end: bool = False) -> Column:
    """Index of the bin ``[e_i, e_i+1)``; null outside; ``open_end``: the last reaches on."""
    out = F.lit(None).cast("int")
    last = len(edges) - 1
    for i in range(last - 1, -1, -1):
        out = F.when((value >= edges[i]) & (value < edges[i + 1]), i).otherwise(out)
    return F.when(value >= edges[last], last).otherwise(out) if open_end else out
