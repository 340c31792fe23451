"""Queries of profiling, aggregation and evaluation metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators import profile as P
from .registry import RECORDS, query, records, table
from .sequence_queries import r6

NUM = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
CELLS = "c AS (SELECT * FROM (SELECT l_quantity, l_extendedprice, l_discount, l_tax FROM lineitem) UNPIVOT INCLUDE NULLS (v FOR col IN (l_quantity, l_extendedprice, l_discount, l_tax)))"
BUN = ["plDDT_mean", "plDDT_min", "msa_depth", "conservation_mean", "kd_hydropathy_mean"]
BCELLS = "b AS (SELECT * FROM (SELECT plDDT_mean, plDDT_min, msa_depth, conservation_mean, kd_hydropathy_mean FROM feature_bundle) UNPIVOT INCLUDE NULLS (v0 FOR col IN (plDDT_mean, plDDT_min, msa_depth, conservation_mean, kd_hydropathy_mean))), bc AS (SELECT col, CASE WHEN NOT isnan(v0) THEN v0 END AS v FROM b)"


@query(f"WITH {BCELLS} SELECT col AS \"column\", count(v) AS n, count(*) - count(v) AS missing, round(avg(v), 6) AS mean, round(stddev_samp(v), 6) AS std, min(v) AS min, max(v) AS max FROM bc GROUP BY col")
def ag_numeric_summary(spark, d) -> DataFrame:
    return P.numeric_summary(table(spark, d, "feature_bundle"), BUN).withColumns({"mean": r6(F.col("mean")), "std": r6(F.col("std"))})


QS = ", ".join(f"({p}::DOUBLE)" for p in P.QUANTILES)


@query(
    f"WITH {BCELLS}, s AS (SELECT col, list_sort(list(v) FILTER (v IS NOT NULL)) AS l, count(v) AS n FROM bc GROUP BY col), q(p) AS (VALUES {QS}) SELECT col AS \"column\", p, l[round_even(p * (n - 1), 0)::INT + 1] AS value FROM s, q WHERE n > 0"
)
def ag_quantiles_nearest_rank(spark, d) -> DataFrame:
    return P.nearest_rank(table(spark, d, "feature_bundle"), BUN)


@query()
def ag_quantiles_sketch(spark, d) -> DataFrame:
    return P.sketched(table(spark, d, "lineitem"), NUM)


@query(" UNION ALL ".join(f"SELECT '{c}' AS \"column\", unnest([{', '.join(map(str, P.QUANTILES))}])::DOUBLE AS p, true AS within" for c in NUM))
def ag_sketch_error(spark, d) -> DataFrame:
    """Whether each sketched quantile's exact rank lies within a thousandth of its level."""
    t = table(spark, d, "lineitem")
    got = P.sketched(t, NUM).join(P.value_counts(t, NUM), ["column", "value"])
    within = ((F.col("hi") - F.col("k")) / F.col("n") <= F.col("p") + 1e-3) & (F.col("hi") / F.col("n") >= F.col("p") - 1e-3)
    return got.select("column", "p", within.alias("within"))


@query("SELECT event_type AS value, count(*) AS n FROM events WHERE event_type IS NOT NULL GROUP BY event_type ORDER BY n DESC, value LIMIT 3")
def ag_top_values(spark, d) -> DataFrame:
    return P.top_values(table(spark, d, "events"), "event_type", 3)


@query("SELECT 'source' AS \"column\", count(source) AS n, count(*) - count(source) AS missing, count(DISTINCT source) AS n_distinct FROM documents UNION ALL SELECT 'lang', count(lang), count(*) - count(lang), count(DISTINCT lang) FROM documents")
def ag_categorical_summary(spark, d) -> DataFrame:
    t = table(spark, d, "documents")
    cells = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("value")) for c in ("source", "lang")])
    return t.select(F.explode(cells).alias("x")).groupBy("x.column").agg(F.count("x.value").alias("n"), F.count_if(F.col("x.value").isNull()).alias("missing"), F.countDistinct("x.value").alias("n_distinct"))


@query(
    "WITH l AS (SELECT label, len(embedding) AS n, sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))) AS l2 FROM embeddings) SELECT label, count(*) AS n_lists, sum(n)::BIGINT AS n_items, min(n)::INT AS min_len, max(n)::INT AS max_len, round(avg(l2), 5) AS mean_l2, round(stddev_samp(l2), 5) AS std_l2 FROM l GROUP BY label"
)
def ag_list_summary(spark, d) -> DataFrame:
    l2 = F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    t = table(spark, d, "embeddings").select("label", F.size("embedding").alias("n"), l2.alias("l2"))
    return t.groupBy("label").agg(
        F.count("*").alias("n_lists"), F.sum("n").alias("n_items"), F.min("n").alias("min_len"), F.max("n").alias("max_len"), F.round(F.avg("l2"), 5).alias("mean_l2"), F.round(F.stddev_samp("l2"), 5).alias("std_l2")
    )


@query(
    """WITH k AS (SELECT unnest(map_entries(extra_features), recursive := false) AS e FROM integrated_test_1), v AS (SELECT e.key AS key, CASE WHEN NOT isnan(e.value) THEN e.value END AS v FROM k)
SELECT key, count(*) AS n_present, count(v) AS n, round(avg(v), 6) AS mean, round(stddev_samp(v), 6) AS std, min(v) AS min, max(v) AS max FROM v GROUP BY key"""
)
def ag_map_key_summary(spark, d) -> DataFrame:
    t = table(spark, d, "integrated_test_1").select(F.explode("extra_features").alias("key", "raw")).withColumn("v", P.number(F.col("raw")))
    return t.groupBy("key").agg(F.count("*").alias("n_present"), F.count("v").alias("n"), r6(F.avg("v")).alias("mean"), r6(F.stddev_samp("v")).alias("std"), F.min("v").alias("min"), F.max("v").alias("max"))


def _sql_corr(cols: list[str], src: str, listwise: bool) -> str:
    parts = []
    for i, a in enumerate(cols):
        for b in cols[i + 1 :]:
            r = f"CASE WHEN var_pop({a}) FILTER ({b} IS NOT NULL) > 0 AND var_pop({b}) FILTER ({a} IS NOT NULL) > 0 THEN corr({a}, {b}) END"
            parts.append(f"SELECT '{a}' AS a, '{b}' AS b, round({'coalesce(' + r + ', 0)' if listwise else r}, 6) AS r FROM {src}")
    return " UNION ALL ".join(parts)


CLEAN = "n0 AS (SELECT " + ", ".join(f"CASE WHEN NOT isnan({c}) THEN {c} END AS {c}" for c in BUN) + " FROM feature_bundle), n1 AS (SELECT * FROM n0 WHERE " + " AND ".join(f"{c} IS NOT NULL" for c in BUN) + ")"


@query(f"WITH {CLEAN} {_sql_corr(BUN, 'n1', True)}")
def ag_correlation_listwise(spark, d) -> DataFrame:
    return P.correlation_pairs(table(spark, d, "feature_bundle"), BUN, True).withColumn("r", r6(F.col("r")))


@query(f"WITH {CLEAN} {_sql_corr(BUN, 'n0', False)}")
def ag_correlation_pairwise(spark, d) -> DataFrame:
    return P.correlation_pairs(table(spark, d, "feature_bundle"), BUN, False).withColumn("r", r6(F.col("r")))


@query("SELECT 'k' AS field, 'numeric' AS kind, count(*) AS n FROM events WHERE json_type(props::JSON, '$.k') IN ('UBIGINT', 'BIGINT', 'DOUBLE', 'BOOLEAN')")
def ag_type_inference(spark, d) -> DataFrame:
    """Kinds of the JSON fields of ``events.props`` by most frequent kind (numbers and booleans:
    numeric; texts: categorical; lists; dicts)."""
    v = table(spark, d, "events").select(F.expr("try_parse_json(props)").alias("v"))
    pairs = v.select(F.expr("cast(v as map<string, variant>)").alias("m")).select(F.explode("m").alias("field", "x"))
    t = F.schema_of_variant("x")
    kind = (
        F.when(t.rlike("^(BIGINT|INT|DOUBLE|DECIMAL|FLOAT|BOOLEAN|SMALLINT|TINYINT)"), "numeric").when(t.startswith("STRING"), "categorical").when(t.startswith("ARRAY"), "list").when(t.startswith("OBJECT"), "dict").otherwise("other")
    )
    n = pairs.filter(t != "VOID").groupBy("field", kind.alias("kind")).agg(F.count("*").alias("n"))
    return n.withColumn("r", F.row_number().over(Window.partitionBy("field").orderBy(F.desc("n"), "kind"))).filter("r = 1").drop("r")


GROUPS = f"WITH {RECORDS}, g AS (SELECT aa, host, count(*) AS n, median(expression.value) AS med, min(expression.value) AS lo, max(expression.value) AS hi FROM rec WHERE aa IS NOT NULL GROUP BY aa, host HAVING count(*) >= 2)"


@query(f"{GROUPS} SELECT md5(aa) AS aa_key, host, n, round(med, 6) AS median_value, lo AS min_value, hi AS max_value FROM g")
def ag_group_median(spark, d) -> DataFrame:
    """Groups of two or more records with the same protein and host: median, range, size."""
    v = F.col("expression.value")
    g = records(spark, d).filter("aa is not null").groupBy("aa", "host").agg(F.count("*").alias("n"), F.median(v).alias("med"), F.min(v).alias("min_value"), F.max(v).alias("max_value")).filter("n >= 2")
    return g.select(F.md5("aa").alias("aa_key"), "host", "n", r6(F.col("med")).alias("median_value"), "min_value", "max_value")


@query(f"WITH {RECORDS}, g AS (SELECT aa, host, count(*) AS n FROM rec WHERE aa IS NOT NULL GROUP BY aa, host) SELECT host, count(*) AS n_groups, min(n) AS min_size, max(n) AS max_size, round(avg(n), 6) AS mean_size, count(*) FILTER (n >= 2) AS n_multi FROM g GROUP BY host")
def ag_group_sizes(spark, d) -> DataFrame:
    g = records(spark, d).filter("aa is not null").groupBy("aa", "host").agg(F.count("*").alias("n"))
    return g.groupBy("host").agg(F.count("*").alias("n_groups"), F.min("n").alias("min_size"), F.max("n").alias("max_size"), r6(F.avg("n")).alias("mean_size"), F.count_if(F.col("n") >= 2).alias("n_multi"))


@query(f"WITH {RECORDS} SELECT host, count(*) AS n FROM rec GROUP BY host")
def ag_count_by_host(spark, d) -> DataFrame:
    return records(spark, d).groupBy("host").agg(F.count("*").alias("n"))


@query(
    """SELECT user_id, count(*)::DOUBLE AS msa_depth, count(*) FILTER (value >= 50)::DOUBLE AS msa_effective_depth, round(least(1.0, avg(len(event_type)) / 100), 6) AS msa_coverage, round(avg(value) / 100, 6) AS conservation_mean, round(min(value) / 100, 6) AS conservation_min,
round(max(value) / 100, 6) AS conservation_max, round(stddev_pop(value / 100), 6) AS conservation_entropy_mean,
0.5::DOUBLE AS coevolution_score, 0.3::DOUBLE AS contact_density, 1.0::DOUBLE AS pfam_count, 1.0::DOUBLE AS domain_count FROM events GROUP BY user_id"""
)
def ag_alignment_hits(spark, d) -> DataFrame:
    """Alignment-hit aggregation, with events as hits: user = query, value = identity in percent,
    length of the type's name = aligned length."""
    from ..operators.records import hit_features

    hits = table(spark, d, "events").select(F.col("user_id").alias("query"), F.col("value").alias("pident"), F.length("event_type").alias("alnlen"))
    out = hit_features(hits)
    return out.select(F.col("query").alias("user_id"), *[r6(F.col(c)).alias(c) for c in out.columns[1:]])


FAM = ["struct_plddt_mean", "struct_helix_ratio", "evo_msa_depth", "evo_conservation_mean", "ctx_promoter_strength", "codon_gc"]


@query(" UNION ALL ".join(f"SELECT '{k}' AS feature, round(count(extra_features['{k}']) / count(*), 6) AS rate FROM integrated_test_1" for k in FAM))
def ag_availability(spark, d) -> DataFrame:
    t = table(spark, d, "integrated_test_1").agg(*[F.try_divide(F.count(F.try_element_at("extra_features", F.lit(k))), F.count("*")).alias(k) for k in FAM])
    return t.unpivot([], FAM, "feature", "rate").withColumn("rate", r6(F.col("rate")))


@query(f"WITH {CELLS} SELECT col AS \"column\", count(v) AS n, round(avg(v), 6) AS mean, round(stddev_samp(v), 6) AS std, min(v) AS min, round(quantile_cont(v, 0.25), 6) AS p25, round(quantile_cont(v, 0.5), 6) AS p50, round(quantile_cont(v, 0.75), 6) AS p75, max(v) AS max FROM c GROUP BY col")
def ag_describe(spark, d) -> DataFrame:
    t = table(spark, d, "lineitem")
    out = P.stacked(t, NUM).groupBy("column").agg(F.count("value").alias("n"), r6(F.avg("value")).alias("mean"), r6(F.stddev_samp("value")).alias("std"), F.min("value").alias("min"), F.max("value").alias("max"))
    q = P.linear_quantiles(t, NUM, (0.25, 0.5, 0.75)).groupBy("column").agg(*[r6(F.max(F.when(F.col("p") == p, F.col("value")))).alias(f"p{int(100 * p)}") for p in (0.25, 0.5, 0.75)])
    return out.join(F.broadcast(q), "column", "left").select("column", "n", "mean", "std", "min", "p25", "p50", "p75", "max")  # one row a column


@query("SELECT o_orderpriority AS value, count(*) AS n FROM orders GROUP BY o_orderpriority")
def ag_value_counts(spark, d) -> DataFrame:
    return table(spark, d, "orders").groupBy(F.col("o_orderpriority").alias("value")).agg(F.count("*").alias("n")).orderBy(F.desc("n"))


@query(f"WITH {BCELLS}, p AS (SELECT col, avg((v IS NULL)::INT) * 100 AS pct FROM bc GROUP BY col) SELECT col AS \"column\", round(pct, 6) AS missing_pct, pct > 10 AS reported FROM p")
def ag_missing_pct(spark, d) -> DataFrame:
    p = P.stacked(table(spark, d, "feature_bundle"), BUN).groupBy("column").agg((F.avg(F.col("value").isNull().cast("int")) * 100).alias("pct"))
    return p.select("column", r6(F.col("pct")).alias("missing_pct"), (F.col("pct") > 10).alias("reported"))


@query(
    f"WITH {BCELLS}, q AS (SELECT col, quantile_cont(v, 0.25) AS a, quantile_cont(v, 0.75) AS b FROM bc GROUP BY col) SELECT col AS \"column\", round(count(*) FILTER (v < a - 1.5 * (b - a) OR v > b + 1.5 * (b - a)) / count(*) * 100, 6) AS outlier_pct FROM bc JOIN q USING (col) GROUP BY col"
)
def ag_iqr_outliers(spark, d) -> DataFrame:
    return P.iqr_outliers(table(spark, d, "feature_bundle"), BUN).withColumn("outlier_pct", r6(F.col("outlier_pct")))


@query(
    f"WITH {RECORDS} SELECT host, round(avg((abs(length(aa) - length(raw) / 3) <= 1)::INT) * 100, 6) AS length_ok_pct, round(avg((expression.value BETWEEN 0 AND 100)::INT) * 100, 6) AS range_ok_pct FROM rec GROUP BY host"
)
def ag_consistency(spark, d) -> DataFrame:
    r = records(spark, d)
    ok = F.abs(F.length("aa") - F.length("raw") / 3) <= 1
    return r.groupBy("host").agg(r6(F.avg(ok.cast("int")) * 100).alias("length_ok_pct"), r6(F.avg(F.col("expression.value").between(0, 100).cast("int")) * 100).alias("range_ok_pct"))


@query(
    f"""WITH {RECORDS}, v AS (SELECT host, expression.value AS e, length(aa) AS n, extra_features['struct_plddt_mean'] AS p, extra_features['evo_msa_depth'] AS m FROM rec)
SELECT host, count(*) AS n_records, round(avg(CASE WHEN NOT isnan(e) THEN e END), 6) AS mean_expression, round(avg(n), 6) AS mean_length, round(avg(CASE WHEN NOT isnan(p) THEN p END), 6) AS mean_plddt, round(avg(CASE WHEN NOT isnan(m) THEN m END), 6) AS mean_depth FROM v GROUP BY host"""
)
def ag_species_means(spark, d) -> DataFrame:
    x = lambda k: P.number(F.try_element_at("extra_features", F.lit(k)))
    return records(spark, d).groupBy("host").agg(
        F.count("*").alias("n_records"), r6(F.avg(P.number(F.col("expression.value")))).alias("mean_expression"), r6(F.avg(F.length("aa"))).alias("mean_length"), r6(F.avg(x("struct_plddt_mean"))).alias("mean_plddt"), r6(F.avg(x("evo_msa_depth"))).alias("mean_depth")
    )


@query(
    """WITH v AS (SELECT abs(expression.value - expression.original_value) AS x FROM integrated_test_1), w AS (SELECT x FROM v WHERE x IS NOT NULL AND NOT isnan(x))
SELECT CASE WHEN x < 5 THEN 0 WHEN x < 10 THEN 1 WHEN x < 15 THEN 2 WHEN x < 20 THEN 3 ELSE 4 END AS bin, count(*) AS n, round(avg(x), 6) AS mean, round(median(x), 6) AS median, round(max(x), 6) AS max, round(stddev_pop(x), 6) AS std FROM w GROUP BY 1"""
)
def ag_delta_histogram(spark, d) -> DataFrame:
    x = P.number(F.abs(F.col("expression.value") - F.col("expression.original_value")))
    w = table(spark, d, "integrated_test_1").select(x.alias("x")).dropna()
    return w.groupBy(P.histogram(F.col("x"), [0, 5, 10, 15, 20], True).alias("bin")).agg(F.count("*").alias("n"), r6(F.avg("x")).alias("mean"), r6(F.median("x")).alias("median"), r6(F.max("x")).alias("max"), r6(F.stddev_pop("x")).alias("std"))


@query(
    """WITH v AS (SELECT event_type, value AS x, min(value) OVER (PARTITION BY event_type) AS lo, max(value) OVER (PARTITION BY event_type) AS hi FROM events WHERE value IS NOT NULL), b AS (SELECT event_type, lo, hi, least(9, floor((x - lo) / ((hi - lo) / 10))) AS bin, count(*) AS k FROM v WHERE hi > lo GROUP BY ALL),
t AS (SELECT *, k / sum(k) OVER (PARTITION BY event_type) / ((hi - lo) / 10) AS h FROM b) SELECT event_type, round(-sum(h * ln(h)), 6) AS entropy FROM t GROUP BY event_type"""
)
def ag_density_entropy(spark, d) -> DataFrame:
    """-sum h ln h over the density histogram of ten equal bins (empty bins aside)."""
    t = table(spark, d, "events").select("event_type", "value").filter("value is not null")
    ends = t.groupBy("event_type").agg(F.min("value").alias("lo"), F.max("value").alias("hi"), F.count("*").alias("n")).filter("hi > lo")
    bins = t.join(ends, "event_type").groupBy("event_type", "lo", "hi", "n", F.least(F.lit(9), F.floor((F.col("value") - F.col("lo")) / ((F.col("hi") - F.col("lo")) / 10))).alias("bin")).agg(F.count("*").alias("k"))
    h = F.col("k") / F.col("n") / ((F.col("hi") - F.col("lo")) / 10)
    return bins.groupBy("event_type").agg(r6(-F.sum(h * F.log(h))).alias("entropy"))


ERR = "e AS (SELECT o_orderpriority AS grp, o_totalprice AS y, o_totalprice * 0.9 + 1000 AS p FROM orders)"


@query(
    f"""WITH {ERR} SELECT grp, round(avg(abs(y - p)), 4) AS mae, round(avg((y - p) * (y - p)), 2) AS mse, round(sqrt(avg((y - p) * (y - p))), 4) AS rmse, round(1 - sum((y - p) * (y - p)) / (var_pop(y) * count(*)), 6) AS r2, round(avg(abs((y - p) / y)) * 100, 6) AS mape,
round(median(abs(y - p)), 4) AS median_ae, round(max(abs(y - p)), 4) AS max_ae, round(quantile_cont(abs(y - p), 0.75), 4) AS p75, round(quantile_cont(abs(y - p), 0.90), 4) AS p90, round(quantile_cont(abs(y - p), 0.95), 4) AS p95, round(quantile_cont(abs(y - p), 0.99), 4) AS p99 FROM e GROUP BY grp"""
)
def ag_regression_metrics(spark, d) -> DataFrame:
    from ..operators.evaluate import regression_metrics

    t = table(spark, d, "orders").select(F.col("o_orderpriority").alias("grp"), F.col("o_totalprice").alias("y"), (F.col("o_totalprice") * 0.9 + 1000).alias("p"))
    m = regression_metrics(t, "y", "p", ["grp"])
    return m.select("grp", F.round("mae", 4).alias("mae"), F.round("mse", 2).alias("mse"), F.round("rmse", 4).alias("rmse"), r6(F.col("r2")).alias("r2"), r6(F.col("mape")).alias("mape"), *[F.round(c, 4).alias(c) for c in ("median_ae", "max_ae", "p75", "p90", "p95", "p99")])


@query(
    """WITH v AS (SELECT l_quantity * 2 AS y, l_quantity * 2 + l_discount * 10 AS p FROM lineitem) SELECT CASE WHEN y < 30 THEN 0 WHEN y < 40 THEN 1 WHEN y < 50 THEN 2 WHEN y < 60 THEN 3 WHEN y < 100 THEN 4 END AS bin, count(*) AS n, round(avg(abs(y - p)), 6) AS mae FROM v WHERE y >= 0 AND y < 100 GROUP BY 1"""
)
def ag_mae_by_bin(spark, d) -> DataFrame:
    t = table(spark, d, "lineitem").select((F.col("l_quantity") * 2).alias("y"), (F.col("l_quantity") * 2 + F.col("l_discount") * 10).alias("p"))
    return t.groupBy(P.histogram(F.col("y"), [0, 30, 40, 50, 60, 100]).alias("bin")).agg(F.count("*").alias("n"), r6(F.avg(F.abs(F.col("y") - F.col("p")))).alias("mae")).filter("bin is not null")


@query(
    """WITH k AS (SELECT unnest(map_entries(extra_features), recursive := false) AS e FROM integrated_test_1), i AS (SELECT e.key AS feature, coalesce(stddev_pop(CASE WHEN NOT isnan(e.value) THEN e.value END), 0) AS w FROM k GROUP BY 1)
SELECT regexp_extract(feature, '^([a-z0-9]+)_', 1) AS family, count(*) AS n, round(avg(w), 6) AS mean_importance, round(sum(w), 6) AS sum_importance FROM i GROUP BY 1"""
)
def ag_importance_by_family(spark, d) -> DataFrame:
    """Feature weights (here: spread of each feature) summed by prefix family."""
    t = table(spark, d, "integrated_test_1").select(F.explode("extra_features").alias("feature", "raw")).withColumn("v", P.number(F.col("raw")))
    w = t.groupBy("feature").agg(F.coalesce(F.stddev_pop("v"), F.lit(0.0)).alias("w"))
    return w.groupBy(F.regexp_extract("feature", "^([a-z0-9]+)_", 1).alias("family")).agg(F.count("*").alias("n"), r6(F.avg("w")).alias("mean_importance"), r6(F.sum("w")).alias("sum_importance"))


@query(
    f"""WITH {RECORDS}, e AS (SELECT DISTINCT protein_id FROM evolutionary_features), b AS (SELECT DISTINCT protein_id FROM feature_bundle) SELECT count(*) AS processed, count(*) FILTER (raw IS NULL) AS errors,
count(*) FILTER (protein_id IN (SELECT protein_id FROM e)) AS with_msa, count(*) FILTER (protein_id IN (SELECT protein_id FROM b)) AS with_structure FROM rec"""
)
def ag_pipeline_counters(spark, d) -> DataFrame:
    r = records(spark, d)
    msa = table(spark, d, "evolutionary_features").select("protein_id").dropna().distinct().withColumn("m", F.lit(1))
    st = table(spark, d, "feature_bundle").select("protein_id").dropna().distinct().withColumn("b", F.lit(1))
    j = r.join(msa, "protein_id", "left").join(st, "protein_id", "left")
    return j.agg(F.count("*").alias("processed"), F.count_if(F.col("raw").isNull()).alias("errors"), F.count("m").alias("with_msa"), F.count("b").alias("with_structure"))


@query(
    """WITH a AS (SELECT protein_id, median(CASE WHEN NOT isnan(msa_depth) THEN msa_depth END) AS m FROM feature_bundle WHERE protein_id IS NOT NULL GROUP BY 1), b AS (SELECT protein_id, median(CASE WHEN NOT isnan(msa_features.msa_depth) THEN msa_features.msa_depth END) AS m FROM evolutionary_features WHERE protein_id IS NOT NULL GROUP BY 1)
SELECT coalesce(a.protein_id, b.protein_id) AS protein_id, round(a.m, 6) AS bundle_median, round(b.m, 6) AS evo_median FROM a FULL JOIN b ON a.protein_id = b.protein_id"""
)
def ag_two_medians(spark, d) -> DataFrame:
    """Medians from two sources under the union of their keys."""
    a = table(spark, d, "feature_bundle").filter("protein_id is not null").groupBy("protein_id").agg(r6(F.median(P.number(F.col("msa_depth")))).alias("bundle_median"))
    b = table(spark, d, "evolutionary_features").filter("protein_id is not null").groupBy("protein_id").agg(r6(F.median(P.number(F.col("msa_features.msa_depth")))).alias("evo_median"))
    return a.join(b, "protein_id", "full")
