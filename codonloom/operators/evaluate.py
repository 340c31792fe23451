"""Evaluation of regressors and rankers, losses and conformal intervals."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def regression_metrics(rows: DataFrame, truth: str, guess: str, by: list[str]) -> DataFrame:
    """MAE, MSE, RMSE, R2 (null without variance), MAPE, median and largest error, quantiles."""
    e = F.abs(F.col(truth) - F.col(guess))
    n = F.count(e)
    q = F.percentile(e, F.lit([0.5, 0.75, 0.9, 0.95, 0.99]))
    out = rows.groupBy(*by).agg(
        n.alias("n"), F.avg(e).alias("mae"), F.avg(e * e).alias("mse"), F.sqrt(F.avg(e * e)).alias("rmse"), (1 - F.try_divide(F.sum(e * e), F.var_pop(truth) * n)).alias("r2"),
        (F.avg(F.abs(F.try_divide(F.col(truth) - F.col(guess), F.col(truth)))) * 100).alias("mape"), F.max(e).alias("max_ae"), q.alias("q"),
    )
    return out.select("*", *[F.col("q")[i].alias(k) for i, k in enumerate(("median_ae", "p75", "p90", "p95", "p99"))]).drop("q")


def average_ranks(rows: DataFrame, part: list[str], value: str, out: str) -> DataFrame:
    w = Window.partitionBy(*part)
    return rows.withColumn(out, F.rank().over(w.orderBy(value)) + (F.count("*").over(Window.partitionBy(*part, value)) - 1) / 2.0)


def group_spearman(rows: DataFrame, part: list[str], score: str, truth: str) -> DataFrame:
    """Spearman by average ranks per group; null when the truth or the score has one value."""
    r = average_ranks(average_ranks(rows, part, score, "_rs"), part, truth, "_rt")
    return r.groupBy(*part).agg(F.count("*").alias("n"), F.try_divide(F.covar_pop("_rs", "_rt"), F.stddev_pop("_rs") * F.stddev_pop("_rt")).alias("spearman"))


def top_hits(rows: DataFrame, part: list[str], score: str, truth: str, tie: str) -> DataFrame:
    """Whether the best row is ranked first, and whether it is among the first three."""
    by = Window.partitionBy(*part)
    best = rows.withColumn("_b", F.row_number().over(by.orderBy(F.desc(truth), tie))).withColumn("_s", F.row_number().over(by.orderBy(F.desc(score), tie)))
    top = best.groupBy(*part).agg(F.max(F.when(F.col("_b") == 1, F.col("_s"))).alias("rank_of_best"), F.count("*").alias("n"))
    return top.select(*part, (F.col("rank_of_best") == 1).cast("int").alias("top1"), (F.col("rank_of_best") <= 3).cast("int").alias("top3"), (1 / F.col("n")).alias("random1"), F.least(F.lit(1.0), 3 / F.col("n")).alias("random3"))


def pairwise_accuracy(pairs: DataFrame, by: list[str]) -> DataFrame:
    """Share of pairs ordered as their truth; equal scores count a half (``ds``, ``dt``)."""
    hit = F.when(F.col("ds") == 0, 0.5).otherwise((F.signum("ds") == F.signum("dt")).cast("double"))
    return pairs.filter("dt <> 0").groupBy(*by).agg(F.count("*").alias("n_pairs"), F.avg(hit).alias("accuracy"))


def margin_loss(ds: Column, y: Column, margin: float = 1.0) -> Column:
    return F.greatest(F.lit(0.0), margin - y * ds)


def ranknet_loss(ds: Column, y01: Column) -> Column:
    """Binary cross entropy of sigmoid(ds), in its stable form."""
    return F.greatest(ds, F.lit(0.0)) - ds * y01 + F.log1p(F.exp(-F.abs(ds)))


def two_way_ce(si: Column, sj: Column, y01: Column) -> Column:
    m = F.greatest(si, sj)
    lse = m + F.log(F.exp(si - m) + F.exp(sj - m))
    return lse - F.when(y01 == 1, si).otherwise(sj)


def listnet_kl(rows: DataFrame, part: list[str], score: str, truth: str) -> DataFrame:
    """KL divergence of the softmax of scores from that of truths, per list."""
    m = rows.groupBy(*part).agg(F.max(score).alias("_ms"), F.max(truth).alias("_mt"))
    e = rows.join(m, part).withColumns({"_es": F.exp(F.col(score) - F.col("_ms")), "_et": F.exp(F.col(truth) - F.col("_mt"))})
    sums = e.groupBy(*part).agg(F.sum("_es").alias("_zs"), F.sum("_et").alias("_zt"), F.sum(F.col("_et") * (F.col(truth) - F.col("_mt") - F.col(score) + F.col("_ms"))).alias("_x"))
    return sums.select(*part, (F.col("_x") / F.col("_zt") - F.log("_zt") + F.log("_zs")).alias("kl"))


def conformal(rows: DataFrame, truth: str, guess: str, low: str, high: str, calibration: Column, alpha: float) -> DataFrame:
    """Half width of the symmetric interval and margin of the quantile interval (CQR), and the
    coverage of both on the rows outside the calibration set.  Too few calibration rows take the
    largest score."""
    y = F.col(truth)
    scored = rows.withColumns({"_c": calibration, "_e": F.abs(y - F.col(guess)), "_q": F.greatest(F.col(low) - y, y - F.col(high))})
    n = scored.filter("_c").agg(F.count("*").alias("n")).first()["n"]  # one number
    level = min(1.0, math.ceil((n + 1) * (1 - alpha)) / n) if n else 1.0
    cut = scored.filter("_c").agg(F.lit(n).alias("n_calibration"), F.percentile("_e", F.lit(level)).alias("width"), F.percentile("_q", F.lit(level)).alias("margin"))
    test = scored.filter("not _c").crossJoin(F.broadcast(cut))  # one row
    return test.groupBy("n_calibration", "width", "margin").agg(F.avg((F.col("_e") <= F.col("width")).cast("double")).alias("coverage"), F.avg((F.col("_q") <= F.col("margin")).cast("double")).alias("cqr_coverage"), F.count("*").alias("n_test"))
