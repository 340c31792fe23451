"""Command line: ``python -m codonloom COMMAND --input ... --output ...``."""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import profile as P
from .plans import pipeline as L
from .sources import readers as S
from .sources import schemas as H
from .sources import writers as W
from .streaming import enrich


def session(checkpoints: str | None = None) -> SparkSession:
    b = SparkSession.builder.appName("codonloom").config("spark.sql.adaptive.enabled", "true").config("spark.sql.session.timeZone", "UTC")
    return (b.config("spark.checkpoint.dir", checkpoints) if checkpoints else b).getOrCreate()


def feature_map(rows: DataFrame, column: str) -> DataFrame:
    """Keyed feature rows with the numeric fields of a struct column as a map."""
    s = F.col(column)
    names = rows.schema[column].dataType.names
    return rows.select("protein_id", L.as_map({n: s[n].try_cast("double") for n in names}, "").alias("features"), F.monotonically_increasing_id().alias("line"))


def convert(spark: SparkSession, a: argparse.Namespace) -> None:
    tsv = S.read_tsv_directory(spark, a.input, a.max_records) if a.directory else S.read_tsv(spark, a.input)
    rows = L.to_records(tsv, a.filter_reviewed).filter("reject is null").drop("reject")
    W.write_jsonl(rows.limit(a.max_records) if a.max_records and not a.directory else rows, a.output)


def complete(spark: SparkSession, a: argparse.Namespace) -> None:
    structure = feature_map(spark.read.json(a.structure_features), "structure_features") if a.structure_features else None
    msa = feature_map(S.read_jsonl(spark, a.msa_features, H.MSA_RECORD), "msa_features") if a.msa_features else None
    W.write_jsonl(L.complete(S.read_tsv(spark, a.input), a.mode, structure, msa), a.output)


def integrate(spark: SparkSession, a: argparse.Namespace) -> None:
    structure = feature_map(spark.read.json(a.structure_features), "structure_features") if a.structure_features else None
    msa = feature_map(S.read_jsonl(spark, a.msa_features, H.MSA_RECORD), "msa_features") if a.msa_features else None
    W.write_jsonl(L.integrated(S.read_json_any(spark, a.input, H.RECORD), structure, msa), a.output)


def refresh(spark: SparkSession, a: argparse.Namespace) -> None:
    W.write_jsonl(L.selective_refresh(S.read_json_any(spark, a.input, H.RECORD)), a.output)


def enhance(spark: SparkSession, a: argparse.Namespace) -> None:
    from .operators.ordinals import with_ordinal

    rows = S.read_json_any(spark, a.input, H.RECORD)
    if a.evo2_results:
        rows = with_ordinal(rows.withColumn("_line", F.monotonically_increasing_id()), ["_line"], "position").drop("_line")
        rows = L.with_lm_results(rows, S.read_lm_results(spark, a.evo2_results), "position").drop("position")
    W.write_jsonl(L.enhanced_expression(rows, a.mode), a.output)


def analyze(spark: SparkSession, a: argparse.Namespace) -> None:
    W.write_jsonl(enrich.task_results(spark.read.schema(H.TASK).option("multiLine", True).json(a.input)), a.output)


def describe(spark: SparkSession, a: argparse.Namespace) -> None:
    rows = S.read_many(spark, S.discover(spark, a.input.split(","), ".jsonl"), H.RECORD)
    cells = rows.select(F.explode("extra_features").alias("column", "raw")).withColumn("value", P.number(F.col("raw")))
    q = F.percentile_approx("value", list(P.QUANTILES), 10_000)
    out = cells.groupBy("column").agg(
        F.count("value").alias("count"), F.count_if(F.col("value").isNull()).alias("missing"), F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"), F.min("value").alias("min"), F.max("value").alias("max"), q.alias("q")
    )
    W.write_csv(out.select("*", *[F.col("q")[i].alias(f"p{int(p * 100):02d}") for i, p in enumerate(P.QUANTILES)]).drop("q"), a.output)


def extract(spark: SparkSession, a: argparse.Namespace) -> None:
    rows = S.read_json_any(spark, a.input, H.RECORD)
    keys = sorted(r["k"] for r in rows.select(F.explode(F.map_keys("extra_features")).alias("k")).distinct().collect())  # the vocabulary of features
    W.write_csv(L.family(rows, a.features.split(","), keys).drop("expression"), a.output)


def candidates(spark: SparkSession, a: argparse.Namespace) -> None:
    from .functions import kernels as K
    from .functions import rules as R
    from .operators import generate as N

    proteins = spark.createDataFrame([("query", a.aa)], "id string, aa string")
    c = N.candidates(proteins, "id", "aa", a.host, a.n, a.method, a.forbid.split(",") if a.forbid else [], a.seed, temperature=a.temperature)
    s = c.withColumn("cs", K.codons(F.col("dna"))).withColumn("f", K.codon_facts(F.col("cs"), F.lit(a.host)))
    q = R.quality_score(K.cai(F.col("f")), K.gc(F.col("dna")), F.size(K.rare_runs(K.rare_flags(F.col("cs"), F.lit(a.host)))), F.size(K.homopolymers(F.col("dna"))))
    W.write_jsonl(N.ranked(s.select("id", "candidate", "dna", q.alias("score")), "score", a.top), a.output)


def train(spark: SparkSession, a: argparse.Namespace) -> None:
    from .operators.models import QuantileSurrogate, training_vectors

    rows = training_vectors(L.merged_datasets(spark, a.input.split(","), hosts=a.hosts.split(",") if a.hosts else None, least=a.min_length, most=a.max_length, balance=a.balance_hosts)).cache()
    QuantileSurrogate.fit(rows, "y", a.quantile_hi).save(a.output)


def testmodel(spark: SparkSession, a: argparse.Namespace) -> None:
    """Errors of a saved model on datasets, over all and by host, as CSV."""
    from .operators.evaluate import regression_metrics
    from .operators.models import QuantileSurrogate, training_vectors

    rows = training_vectors(L.merged_datasets(spark, a.input.split(","), least=a.min_length, most=a.max_length))
    scored = QuantileSurrogate.load(a.model).predict(rows)
    scored = scored.withColumn("host", F.explode(F.array("host", F.lit("all"))))
    W.write_csv(regression_metrics(scored, "y", "mu", ["host"]), a.output)


def stream(spark: SparkSession, a: argparse.Namespace) -> None:
    enrich.enrich_stream(spark, a.input, a.output, a.checkpoint).awaitTermination()


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="codonloom")
    p.add_argument("--checkpoint-dir", help="shared folder for intermediate tables, unless spark.checkpoint.dir names one")
    sub = p.add_subparsers(dest="command", required=True)

    def add(run, *options: tuple[str, dict]) -> None:
        c = sub.add_parser(run.__name__)
        if run is not candidates:
            c.add_argument("--input", required=True)
        c.add_argument("--output", required=True)
        for name, kw in options:
            c.add_argument(name, **kw)
        c.set_defaults(run=run)

    extra = [("--structure-features", {}), ("--msa-features", {})]
    mode = ("--mode", {"choices": L.MODES, "default": "model_enhanced"})
    add(convert, ("--max-records", {"type": int}), ("--filter-reviewed", {"action": "store_true"}), ("--directory", {"action": "store_true"}))
    add(complete, mode, *extra)
    add(integrate, *extra)
    add(refresh)
    add(enhance, mode, ("--evo2-results", {}))
    add(analyze)
    add(describe)
    add(extract, ("--features", {"default": "codon,struct,evo,ctx,evo2"}))
    add(
        candidates, ("--aa", {"required": True}), ("--host", {"default": "E_coli"}), ("--n", {"type": int, "default": 10}), ("--top", {"type": int, "default": 5}), ("--method", {"choices": ("hfc", "bfc", "urc", "softmax"), "default": "bfc"}),
        ("--forbid", {"default": ""}), ("--seed", {"type": int, "default": 1}), ("--temperature", {"type": float, "default": 1.0}),
    )
    add(
        train, ("--hosts", {}), ("--min-length", {"type": int, "default": 50}), ("--max-length", {"type": int, "default": 10_000}), ("--balance-hosts", {"action": "store_true"}), ("--quantile-hi", {"type": float, "default": 0.84})
    )
    add(testmodel, ("--model", {"required": True}), ("--min-length", {"type": int, "default": 50}), ("--max-length", {"type": int, "default": 10_000}))
    add(stream, ("--checkpoint", {"required": True}))
    return p


def main(args: list[str] | None = None) -> None:
    a = parser().parse_args(args)
    a.run(session(a.checkpoint_dir) if a.checkpoint_dir else session(), a)


if __name__ == "__main__":
    main()
