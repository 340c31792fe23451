"""Surrogates, ensembles, out-of-fold labels and rankers on ``pyspark.ml``."""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.seeded import BITS, seeded
from ..sources import files


def assembled(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Rows with ``features`` in order of name; missing and NaN values are 0."""
    filled = rows.withColumns({f"_f_{c}": F.coalesce(F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double")), F.lit(0.0)) for c in columns})
    return VectorAssembler(inputCols=[f"_f_{c}" for c in sorted(columns)], outputCol="features").transform(filled).drop(*[f"_f_{c}" for c in columns])


def regressor(kind: str, label: str, seed: int = 42, loss: str = "squared", trees: int = 20, depth: int = 5):
    if kind == "gbt":
        return GBTRegressor(featuresCol="features", labelCol=label, maxIter=trees, maxDepth=depth, stepSize=0.1, lossType=loss, seed=seed)
    if kind == "forest":
        return RandomForestRegressor(featuresCol="features", labelCol=label, numTrees=trees, maxDepth=min(10, depth * 2), seed=seed)
    return LinearRegression(featuresCol="features", labelCol=label, regParam=0.1, elasticNetParam=0.0)


class QuantileSurrogate:
    """Median model and an upper quantile of each row.

    Boosted trees with absolute loss give the median; a second boosted model gives the usual size
    of a row's residual, and its multiple that ``upper`` of the training rows stay under is the
    distance of the upper quantile (Spark has no pinball loss): ``sigma = max(1e-6, upper -
    median)`` differs from row to row.  The multiple comes from a quantile sketch.  Without rows
    to fit there is no model: mu and sigma are null."""

    def __init__(self, model: PipelineModel | None, spread: PipelineModel | None, times: float):
        self.model, self.spread, self.times = model, spread, times

    @classmethod
    def fit(cls, rows: DataFrame, label: str, upper: float = 0.84, seed: int = 42, trees: int = 20) -> QuantileSurrogate:
        def boosted(target: str, rows: DataFrame) -> PipelineModel:
            gbt = regressor("gbt", target, seed, "absolute", trees)
            gbt.setFeaturesCol("scaled")
            return Pipeline(stages=[StandardScaler(inputCol="features", outputCol="scaled", withMean=True), gbt]).fit(rows)

        if rows.isEmpty():
            return cls(None, None, 0.0)
        model = boosted(label, rows)
        res = model.transform(rows).select("features", (F.col(label) - F.col("prediction")).alias("_res")).withColumn("_size", F.abs("_res"))
        spread = boosted("_size", res)
        ratio = F.col("_res") / F.greatest(F.col("prediction"), F.lit(1e-6))
        times = spread.transform(res).agg(F.percentile_approx(ratio, upper, 10_000).alias("q")).first()["q"]
        return cls(model, spread, max(0.0, float(times or 0.0)))

    def save(self, path: str) -> None:
        """The pipelines under ``path/model`` and ``path/spread``, the multiple beside them."""
        for name, model in (("model", self.model), ("spread", self.spread)):
            if model is not None:
                model.write().overwrite().save(f"{path}/{name}")
        spark = SparkSession.getActiveSession()
        spark.createDataFrame([(self.times,)], "times double").coalesce(1).write.mode("overwrite").json(f"{path}/times")

    @classmethod
    def load(cls, path: str) -> QuantileSurrogate:
        spark = SparkSession.getActiveSession()
        model, spread = (PipelineModel.load(f"{path}/{n}") if files.exists(spark, f"{path}/{n}") else None for n in ("model", "spread"))
        return cls(model, spread, spark.read.schema("times double").json(f"{path}/times").first()["times"])

    def predict(self, rows: DataFrame) -> DataFrame:
        if self.model is None or self.spread is None:
            return rows.withColumns({"mu": F.lit(None).cast("double"), "sigma": F.lit(None).cast("double")})
        out = self.model.transform(rows).withColumnRenamed("prediction", "mu").drop("scaled")
        out = self.spread.transform(out).drop("scaled")
        return out.withColumn("sigma", F.greatest(F.lit(1e-6), F.col("prediction") * self.times)).drop("prediction")

    def importances(self) -> list[float]:
        """Of each feature in the order of the vectors; none without a model."""
        return [float(x) for x in self.model.stages[-1].featureImportances.toArray()] if self.model else []


def training_vectors(records: DataFrame) -> DataFrame:
    """Records as ``host, y, features``: sorted features of the sequence, every record with the
    same keys; records without a usable value or sequence are left out."""
    from ..functions import kernels as K
    from ..functions.text_norm import sequence_key

    s = F.col("_s")
    v = F.col("expression.value")
    r = records.withColumn("_s", K.without_stop(sequence_key("sequence"))).filter(v.isNotNull() & ~F.isnan(v) & s.isNotNull()).withColumn("_cs", K.codons(s)).withColumn("_f", K.codon_facts(F.col("_cs"), F.col("host")))
    ok = K.validate_cds(s) == "OK"
    named = {"cai": F.when(ok, K.cai(F.col("_f"))), "tai": F.when(ok, K.tai(F.col("_f"))), "fop": F.when(ok, K.fop(F.col("_f"))), "gc": K.gc(s), "len_nt": F.length(s), "cpb": K.codon_pair_bias(F.col("_cs"), F.col("host"))}
    out = assembled(r.select("host", v.alias("y"), *[c.cast("double").alias(n) for n, c in named.items()]), list(named))
    return out.select("host", "y", "features")


def fit_by_host(rows: DataFrame, label: str, hosts: list[str], least: int = 20, trees: int = 20) -> dict[str, QuantileSurrogate]:
    """One surrogate per host with at least ``least`` rows."""
    out = {}
    for h in hosts:
        own = rows.filter(F.col("host") == h)
        if own.count() >= least:
            out[h] = QuantileSurrogate.fit(own, label, trees=trees)
    return out


def ensemble(rows: DataFrame, label: str, id_col: str, members: int = 3, share: float = 0.9, seed: int = 42, trees: int = 10) -> list[QuantileSurrogate]:
    """Surrogates on bootstraps of ``share`` of the rows."""
    return [QuantileSurrogate.fit(rows.sample(withReplacement=True, fraction=share, seed=seed + i), label, seed=seed + i, trees=trees) for i in range(members)]


def ensemble_predict(models: list[QuantileSurrogate], rows: DataFrame) -> DataFrame:
    """``mu`` = mean, ``sigma`` = sqrt(variance between + mean variance within)."""
    out = rows
    for i, m in enumerate(models):
        out = m.predict(out).withColumnRenamed("mu", f"_m{i}").withColumnRenamed("sigma", f"_s{i}")
    n = len(models)
    mu = sum((F.col(f"_m{i}") for i in range(n)), F.lit(0.0)) / n
    out = out.withColumn("mu", mu)
    between = sum(((F.col(f"_m{i}") - F.col("mu")) * (F.col(f"_m{i}") - F.col("mu")) for i in range(n)), F.lit(0.0)) / n
    within = sum((F.col(f"_s{i}") * F.col(f"_s{i}") for i in range(n)), F.lit(0.0)) / n
    return out.withColumn("sigma", F.sqrt(between + within)).drop(*[f"_m{i}" for i in range(n)], *[f"_s{i}" for i in range(n)])


def ensemble_with_conformal(rows: DataFrame, label: str, id_col: str, alpha: float = 0.1, members: int = 3, trees: int = 10, seed: int = 42) -> tuple[DataFrame, list[QuantileSurrogate]]:
    """``(report, models)``: an ensemble on 65 % of the rows, intervals calibrated on 20 %, both
    measured on the other 15 %; rows go to the parts by seeded number.

    report, one row: ``n_train, n_cal, n_test, mae, r2, width, coverage``; the calibrated half
    width is that multiple of sigma that ``1 - alpha`` of the calibration rows lie within."""
    u = seeded(seed, id_col) / float(1 << BITS)
    parts = rows.withColumn("_part", F.when(u < 0.15, "test").when(u < 0.35, "cal").otherwise("train"))
    train = parts.filter("_part = 'train'")
    models = ensemble(train, label, id_col, members, seed=seed, trees=trees)
    scored = ensemble_predict(models, parts.filter("_part <> 'train'")).withColumn("_e", F.abs(F.col(label) - F.col("mu")))
    n_train = train.agg(F.count("*").alias("n_train"))
    cal = scored.filter("_part = 'cal'").agg(F.count("*").alias("n_cal"), F.percentile_approx(F.col("_e") / F.col("sigma"), 1 - alpha, 10_000).alias("_times"))
    test = scored.filter("_part = 'test'").crossJoin(F.broadcast(cal)).crossJoin(F.broadcast(n_train))  # two single rows
    e, half = F.col("_e"), F.col("_times") * F.col("sigma")
    report = test.groupBy("n_train", "n_cal").agg(
        F.count("*").alias("n_test"), F.avg(e).alias("mae"), (1 - F.try_divide(F.sum(e * e), F.var_pop(label) * F.count("*"))).alias("r2"), F.avg(2 * half).alias("width"), F.avg((e <= half).cast("double")).alias("coverage")
    )
    return report, models


def importance_summary(models: list[QuantileSurrogate], names: list[str]) -> list[tuple[str, float, float]]:
    """``(feature, mean, std)`` of the members' importances; names in the order of the vectors."""
    got = [x for m in models if (x := m.importances())]
    if not got:
        return []
    out = []
    for i, name in enumerate(sorted(names)):
        own = [g[i] for g in got]
        mean = sum(own) / len(own)
        out.append((name, mean, (sum((x - mean) ** 2 for x in own) / len(own)) ** 0.5))
    return out


def out_of_fold(rows: DataFrame, label: str, id_col: str, folds: int = 5, kind: str = "linear", seed: int = 5) -> DataFrame:
    """``id, fold, weak, confidence``: predictions of each row by models that never saw it;
    confidence = 1 - |residual| / the fold's largest.  Features must not hold the label."""
    r = rows.withColumn("fold", F.pmod(seeded(seed, id_col), F.lit(folds)).cast("int"))
    out = None
    for f in range(folds):
        rest, own = r.filter(F.col("fold") != f), r.filter(F.col("fold") == f)
        scored = own.withColumn("prediction", F.lit(None).cast("double")) if rest.isEmpty() else regressor(kind, label).fit(rest).transform(own)
        got = scored.select(id_col, "fold", F.col("prediction").alias("weak"), F.abs(F.col(label) - F.col("prediction")).alias("e"))
        out = got if out is None else out.unionByName(got)
    top = out.groupBy("fold").agg(F.max("e").alias("top"))
    return out.join(F.broadcast(top), "fold").select(id_col, "fold", "weak", (1 - F.coalesce(F.try_divide("e", "top"), F.lit(0.0))).alias("confidence"))


def rank_net(pairs: DataFrame, xi: str = "xi", xj: str = "xj", label: str = "label"):
    """Linear pairwise ranker: logistic regression on differences of array features, no intercept;
    None without pairs."""
    diff = pairs.select(array_to_vector(F.zip_with(xi, xj, lambda a, b: a - b)).alias("features"), F.col(label).cast("double").alias("label"))
    if diff.isEmpty():
        return None
    return LogisticRegression(fitIntercept=False, regParam=1e-3).fit(diff)


def rank_score(model, rows: DataFrame, vector: str) -> DataFrame:
    if model is None:
        return rows.withColumn("score", F.lit(None).cast("double"))
    weights = [float(w) for w in model.coefficients]
    return rows.withColumn("score", F.aggregate(F.zip_with(vector, F.lit(weights), lambda a, w: a * w), F.lit(0.0), lambda s, x: s + x))


__all__ = ["QuantileSurrogate", "assembled", "ensemble", "ensemble_predict", "ensemble_with_conformal", "importance_summary", "out_of_fold", "rank_net", "rank_score", "regressor", "fit_by_host", "training_vectors", "vector_to_array"]
