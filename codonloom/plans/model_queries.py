"""Queries of pairs, clusters, audits, models, evaluation and generation."""

from __future__ import annotations

import math
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import genetics as G
from ..functions import kernels as K
from ..functions import rules as R
from ..functions.seeded import sql_seeded, sql_uniform
from ..functions.text_norm import protein_key
from ..operators import evaluate as E
from ..operators import generate as N
from ..operators import pairs as C
from ..operators.profile import number
from .lineage import checkpoint_dir, cut
from .registry import ORACLE, RECORDS, coding, query, records, spread, sql_protein, table
from .sequence_queries import r6

GRP = f"{RECORDS}, g AS (SELECT md5(aa || '_' || host) AS grp, rec_id, CASE WHEN NOT isnan(expression.value) THEN expression.value END AS v, length(aa)::DOUBLE AS n FROM rec WHERE aa IS NOT NULL)"

REAL = f"{GRP}, real AS (SELECT grp, a.rec_id AS i, b.rec_id AS j, a.v AS vi, b.v AS vj, (a.v > b.v)::INT AS label FROM g a JOIN g b USING (grp) WHERE a.rec_id < b.rec_id AND abs(a.v - b.v) > 0)"
LONGER = "weak AS (SELECT grp, a.rec_id AS i, b.rec_id AS j, a.n AS vi, b.n AS vj, (a.n > b.n)::INT AS label FROM g a JOIN g b USING (grp) WHERE a.rec_id < b.rec_id AND a.n <> b.n)"
RAWLEN = "length(protein_aa)::DOUBLE"


def grouped(spark, d, written: bool = False) -> DataFrame:
    """Records as members of their (protein, host) group: ``grp, rec_id, v, n``; n is the length
    of the protein, with ``written`` of its text as it stands."""
    r = records(spark, d).filter("aa is not null")
    return r.select(F.md5(F.concat("aa", F.lit("_"), "host")).alias("grp"), "rec_id", number(F.col("expression.value")).alias("v"), F.length("protein_aa" if written else "aa").cast("double").alias("n"))


@query(f"WITH {GRP} SELECT grp, a.rec_id AS i, b.rec_id AS j, (a.v > b.v)::INT AS label FROM g a JOIN g b USING (grp) WHERE a.rec_id < b.rec_id AND abs(a.v - b.v) > 0")
def cp_pairs(spark, d) -> DataFrame:
    return C.group_pairs(grouped(spark, d), "grp", "rec_id", "v").select("grp", "i", "j", "label")


@query(f"WITH {REAL.replace('length(aa)::DOUBLE', RAWLEN)}, {LONGER} SELECT grp, i, j, label FROM weak")
def cp_weak_pairs(spark, d) -> DataFrame:
    """All pairs of a group by a weak label (the length of the protein as written)."""
    return C.group_pairs(grouped(spark, d, written=True), "grp", "rec_id", "n").select("grp", "i", "j", "label")


@query(f"WITH {GRP} SELECT grp, a.rec_id AS i, b.rec_id AS j, CASE WHEN abs(a.v - b.v) <= 2.5 THEN 'hard' ELSE 'easy' END AS level FROM g a JOIN g b USING (grp) WHERE a.rec_id < b.rec_id AND abs(a.v - b.v) >= 0.5")
def cp_hard_easy(spark, d) -> DataFrame:
    """Hard and easy pairs under the greedy participation cap of 100; the SQL has no cap and agrees
    while no member has more than 100 pairs."""
    return C.hard_easy(C.group_pairs(grouped(spark, d), "grp", "rec_id", "v"), "grp").select("grp", "i", "j", "level")


@query(
    f"""WITH {REAL.replace("length(aa)::DOUBLE", RAWLEN)}, {LONGER}, c AS (SELECT *, {sql_seeded(3, 'grp', 'i', 'j')} AS h FROM weak), d AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY h, i, j) AS r FROM c), e AS (SELECT *, row_number() OVER (ORDER BY h, grp, i, j) AS k FROM d WHERE r <= 200)
SELECT grp, i, j, label, 'real' AS source FROM real UNION ALL SELECT grp, i, j, label, 'weak' FROM e WHERE k <= greatest(0, least(30000 - (SELECT count(*) FROM real), 9000))"""
)
def cp_topped_up(spark, d) -> DataFrame:
    """Real pairs topped up by weak ones (length as written as weak value) towards a target."""
    g = grouped(spark, d, written=True)
    real, weak = C.group_pairs(g, "grp", "rec_id", "v"), C.group_pairs(g, "grp", "rec_id", "n")
    return C.topped_up(real, weak, 30_000, 0.3, "grp", 200, 3).select("grp", "i", "j", "label", "source")


@query()
def cp_robust_pairs(spark, d) -> DataFrame:
    """Real pairs with a difference above 0.1, pairs of out-of-fold weak labels and, if both are
    fewer than 30 000, synthetic noise pairs; 500 a group."""
    from ..operators.models import out_of_fold

    g = grouped(spark, d)
    real = C.group_pairs(g, "grp", "rec_id", "v", 0.1)
    labels = out_of_fold(model_rows(spark, d), "y", "rec_id").select("rec_id", "weak")
    weak = C.group_pairs(g.join(labels, "rec_id"), "grp", "rec_id", "weak")
    noise = C.noise_pairs(g, "grp", "rec_id", "v", 1.0, 5)
    return C.robust_pairs(real, weak, noise, "grp", 30_000).select("grp", "i", "j", "label", "source")


@query(
    f"""WITH {REAL}, p AS (SELECT *, CASE WHEN abs(vi - vj) <= 2.5 THEN 'hard' ELSE 'easy' END AS level FROM real WHERE abs(vi - vj) >= 0.5), k AS (SELECT *, row_number() OVER (PARTITION BY level ORDER BY {sql_seeded(7, 'i', 'j')}, i, j) AS r FROM p)
SELECT grp, i, j, label, level FROM k WHERE r <= CASE level WHEN 'hard' THEN 150 ELSE 50 END"""
)
def cp_sampled_levels(spark, d) -> DataFrame:
    pairs = C.hard_easy(C.group_pairs(grouped(spark, d), "grp", "rec_id", "v"), "grp")
    return C.sample_levels(pairs.select("grp", "i", "j", "label", "level"), 200, 0.75, 7)


@query(
    f"""WITH {GRP}, f AS (SELECT count(*) AS k, avg(v) AS mx, avg(n) AS my, covar_pop(v, n) AS c, var_pop(v) AS s FROM g WHERE v IS NOT NULL AND n IS NOT NULL) SELECT rec_id, round(v - (my + c * k / (s * k + 0.1) * (v - mx)) / 10, 6) AS residual FROM g, f"""
)
def cp_detrend(spark, d) -> DataFrame:
    """One-variable ridge residuals (all rows train)."""
    return C.ridge_residual(grouped(spark, d), "v", "n", F.lit(True)).select("rec_id", r6(F.col("residual")).alias("residual"))


@query(f"WITH {GRP} SELECT grp, a.rec_id AS i, b.rec_id AS j, (a.v > b.v)::INT AS label, [a.v, a.n] AS xi, [b.v, b.n] AS xj FROM g a JOIN g b USING (grp) WHERE a.rec_id < b.rec_id AND abs(a.v - b.v) > 0")
def cp_pair_vectors(spark, d) -> DataFrame:
    g = grouped(spark, d)
    pairs = C.group_pairs(g, "grp", "rec_id", "v").select("grp", "i", "j", "label")
    return C.pair_vectors(pairs, g.withColumn("x", F.array("v", "n")), "grp", "rec_id", "x").select("grp", "i", "j", "label", "xi", "xj")


@query()
def cp_average_linkage(spark, d) -> DataFrame:
    g = table(spark, d, "protein_group").select("group_no", "cluster_id", protein_key("protein_aa").alias("aa"))
    return C.average_linkage(g, "cluster_id", "group_no", "aa")


LINKED = f"""g AS (SELECT group_no AS id, {sql_protein('protein_aa')} AS aa FROM protein_group), k AS (SELECT DISTINCT id, substr(aa, i::INT, 5) AS mer FROM (SELECT id, aa, unnest(range(1, length(aa) - 3)) AS i FROM g WHERE length(aa) >= 5)), n AS (SELECT id, count(*) AS n FROM k GROUP BY id),
c AS (SELECT a.id AS a, b.id AS b, count(*) AS nb FROM k a JOIN k b ON a.mer = b.mer AND a.id < b.id GROUP BY ALL), e AS (SELECT a, b FROM c JOIN n x ON x.id = a JOIN n y ON y.id = b WHERE nb / (x.n + y.n - nb) >= 0.5), t AS (SELECT a AS u, b AS v FROM e UNION SELECT b, a FROM e),
r(id, c) AS (SELECT id, id FROM g UNION SELECT t.v, r.c FROM r JOIN t ON t.u = r.id WHERE r.c < t.v), cl AS (SELECT id, min(c) AS cluster FROM r GROUP BY id)"""


@query("SELECT cluster_id::VARCHAR AS part, count(*) AS n_rows, greatest(least(2, count(*)), least(10, count(*) // 5)) AS n_clusters FROM protein_group WHERE cluster_id IS NOT NULL AND nullif(regexp_replace(upper(protein_aa), '[\\s*]', '', 'g'), '') IS NOT NULL GROUP BY 1")
def cp_identity_linkage(spark, d) -> DataFrame:
    """Average linkage on the identity of aligned beginnings: rows and clusters of each part (the
    merging itself is tested against brute force)."""
    g = table(spark, d, "protein_group").select("group_no", "cluster_id", protein_key("protein_aa").alias("aa"))
    return C.identity_linkage(g, "cluster_id", "group_no", "aa").groupBy("part").agg(F.count("*").alias("n_rows"), F.countDistinct("cluster").alias("n_clusters"))


@query(f"WITH RECURSIVE {LINKED} SELECT id, cluster FROM cl")
def cp_linked_clusters(spark, d) -> DataFrame:
    g = table(spark, d, "protein_group").select("group_no", protein_key("protein_aa").alias("aa"))
    return C.linked_clusters(g, "group_no", "aa", 5, 0.5)


@query(
    f"""WITH RECURSIVE {LINKED}, o AS (SELECT cluster, row_number() OVER (ORDER BY {sql_seeded(11, 'cluster')}, cluster) - 1 AS i, count(*) OVER () AS n FROM (SELECT DISTINCT cluster FROM cl))
SELECT id, cluster, CASE WHEN i < floor(n * 0.7) THEN 'train' WHEN i < floor(n * 0.85) THEN 'val' ELSE 'test' END AS split FROM cl JOIN o USING (cluster)"""
)
def cp_cluster_split(spark, d) -> DataFrame:
    return C.cluster_splits(cp_linked_clusters(spark, d), 11)


@query(
    f"""WITH RECURSIVE {LINKED}, o AS (SELECT cluster, row_number() OVER (ORDER BY m DESC, cluster) - 1 AS i FROM (SELECT cluster, count(*) AS m FROM cl GROUP BY cluster))
SELECT id, cluster, CASE i % 5 WHEN 1 THEN 'val' WHEN 3 THEN 'test' ELSE 'train' END AS split FROM cl JOIN o USING (cluster)"""
)
def cp_round_robin_split(spark, d) -> DataFrame:
    return C.round_robin_splits(cp_linked_clusters(spark, d))


@query(
    f"""WITH {RECORDS}, p AS (SELECT rec_id, split, aa FROM rec WHERE aa IS NOT NULL AND split IS NOT NULL), k AS (SELECT DISTINCT rec_id, split, substr(aa, i::INT, 5) AS mer FROM (SELECT *, unnest(range(1, length(aa) - 3)) AS i FROM p WHERE length(aa) >= 5)), n AS (SELECT rec_id, count(*) AS n FROM k GROUP BY 1),
c AS (SELECT a.rec_id AS a, b.rec_id AS b, least(a.split, b.split) || '|' || greatest(a.split, b.split) AS splits, count(*) AS nb FROM k a JOIN k b ON a.mer = b.mer AND a.rec_id < b.rec_id AND a.split <> b.split GROUP BY ALL), j AS (SELECT splits, nb / (x.n + y.n - nb) AS j FROM c JOIN n x ON x.rec_id = c.a JOIN n y ON y.rec_id = c.b)
SELECT splits, count(*) AS n_pairs, round(max(j), 6) AS max_jaccard FROM j WHERE j >= 0.8 GROUP BY splits"""
)
def cp_leakage_audit(spark, d) -> DataFrame:
    r = records(spark, d).select(F.col("rec_id").alias("id"), "split", F.col("aa").alias("txt")).filter("txt is not null")
    return C.leakage_audit(r).withColumn("max_jaccard", r6(F.col("max_jaccard")))


@query(
    f"""WITH {RECORDS}, s AS (SELECT split, count(*) AS n, count(DISTINCT aa) AS n_proteins FROM rec WHERE split IS NOT NULL GROUP BY split), x AS (SELECT aa FROM rec WHERE split IS NOT NULL AND aa IS NOT NULL GROUP BY aa HAVING count(DISTINCT split) > 1), t AS (SELECT sum(n) AS t FROM s)
SELECT round(((SELECT count(*) FROM x) = 0)::INT / 3 + ((SELECT min(n) FROM s) > 0)::INT / 3 + ((SELECT abs(n / t - 0.7) <= 0.1 FROM s, t WHERE split = 'train'))::INT / 3, 6) AS score, (SELECT count(*) FROM x) AS n_shared"""
)
def cp_split_quality(spark, d) -> DataFrame:
    """Mean of three checks: no protein in two splits, no empty split, train share near 70 %."""
    r = records(spark, d).filter("split is not null")
    n = r.groupBy("split").agg(F.count("*").alias("n"))
    shape = n.agg(F.min("n").alias("least"), (F.max(F.when(F.col("split") == "train", F.col("n"))) / F.sum("n")).alias("train"))
    shared = r.filter("aa is not null").groupBy("aa").agg(F.min("split").alias("a"), F.max("split").alias("b")).agg(F.count_if(F.col("a") != F.col("b")).alias("n_shared"))
    both = shared.crossJoin(shape)  # two single rows
    return both.select(r6(((F.col("n_shared") == 0).cast("int") + (F.col("least") > 0).cast("int") + (F.abs(F.col("train") - 0.7) <= 0.1).cast("int")) / 3).alias("score"), "n_shared")


# --- losses and evaluation -------------------------------------------------------------------


@query(
    """WITH p AS (SELECT a.l_orderkey AS k, a.l_linenumber AS i, b.l_linenumber AS j, a.l_partkey AS pa, b.l_partkey AS pb, a.l_quantity / 10 AS s1, b.l_quantity / 10 AS s2, (a.l_extendedprice > b.l_extendedprice)::INT AS y FROM lineitem a JOIN lineitem b USING (l_orderkey) WHERE a.l_linenumber < b.l_linenumber)
SELECT y AS label, count(*) AS n, round(avg(greatest(0.0, 1 - (2 * y - 1) * (s1 - s2))), 6) AS margin, round(avg(greatest(s1 - s2, 0.0) - (s1 - s2) * y + ln(1 + exp(-abs(s1 - s2)))), 6) AS ranknet,
round(avg(greatest(s1, s2) + ln(exp(s1 - greatest(s1, s2)) + exp(s2 - greatest(s1, s2))) - CASE WHEN y = 1 THEN s1 ELSE s2 END), 6) AS cross_entropy FROM p GROUP BY y"""
)
def md_losses(spark, d) -> DataFrame:
    t = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_quantity") / 10, "l_extendedprice")
    p = t.toDF("k", "i", "s1", "x").join(t.toDF("k", "j", "s2", "z"), "k").filter("i < j").withColumn("y", (F.col("x") > F.col("z")).cast("int"))
    ds, y = F.col("s1") - F.col("s2"), F.col("y")
    return p.groupBy(y.alias("label")).agg(
        F.count("*").alias("n"), r6(F.avg(E.margin_loss(ds, 2 * y - 1))).alias("margin"), r6(F.avg(E.ranknet_loss(ds, y))).alias("ranknet"), r6(F.avg(E.two_way_ce(F.col("s1"), F.col("s2"), y))).alias("cross_entropy")
    )


@query(
    """WITH r AS (SELECT l_orderkey AS g, l_quantity / 10 AS s, l_discount * 10 AS t FROM lineitem), m AS (SELECT *, max(s) OVER w AS ms, max(t) OVER w AS mt FROM r WINDOW w AS (PARTITION BY g)), z AS (SELECT g, sum(exp(s - ms)) AS zs, sum(exp(t - mt)) AS zt, sum(exp(t - mt) * (t - mt - s + ms)) AS x FROM m GROUP BY g)
SELECT g AS l_orderkey, round(x / zt - ln(zt) + ln(zs), 6) AS kl FROM z"""
)
def md_listnet(spark, d) -> DataFrame:
    t = table(spark, d, "lineitem").select("l_orderkey", (F.col("l_quantity") / 10).alias("s"), (F.col("l_discount") * 10).alias("t"))
    return E.listnet_kl(t, ["l_orderkey"], "s", "t").withColumn("kl", r6(F.col("kl")))


CONF = "c AS (SELECT o_orderstatus = 'F' AS cal, o_totalprice AS y, o_totalprice * 0.9 + 1000 AS p, o_totalprice * 0.8 AS lo, o_totalprice * 0.95 + 500 AS hi FROM orders), s AS (SELECT *, abs(y - p) AS e, greatest(lo - y, y - hi) AS q FROM c), n AS (SELECT count(*) AS n, least(1.0, ceil((count(*) + 1) * (1 - 0.1)) / count(*)) AS lv FROM s WHERE cal)"


@query(
    f"""WITH {CONF}, l AS (SELECT list_sort(list(e)) AS le, list_sort(list(q)) AS lq, any_value(n) AS n, any_value(lv) * (any_value(n) - 1) AS pos FROM s, n WHERE cal),
w AS (SELECT n, le[floor(pos)::INT + 1] + (pos - floor(pos)) * (le[least(floor(pos)::INT + 2, n)::INT] - le[floor(pos)::INT + 1]) AS width, lq[floor(pos)::INT + 1] + (pos - floor(pos)) * (lq[least(floor(pos)::INT + 2, n)::INT] - lq[floor(pos)::INT + 1]) AS margin FROM l)
SELECT w.n AS n_calibration, round(width, 4) AS width, round(margin, 4) AS margin, round(avg((e <= width)::INT), 6) AS coverage, round(avg((q <= margin)::INT), 6) AS cqr_coverage, count(*) AS n_test FROM s, w WHERE NOT cal GROUP BY ALL"""
)
def md_conformal(spark, d) -> DataFrame:
    """Split-conformal and quantile intervals, calibrated on the fulfilled orders."""
    y = F.col("o_totalprice")
    t = table(spark, d, "orders").select("o_orderstatus", y.alias("y"), (y * 0.9 + 1000).alias("p"), (y * 0.8).alias("lo"), (y * 0.95 + 500).alias("hi"))
    c = E.conformal(t, "y", "p", "lo", "hi", F.col("o_orderstatus") == "F", 0.1)
    return c.select("n_calibration", F.round("width", 4).alias("width"), F.round("margin", 4).alias("margin"), r6(F.col("coverage")).alias("coverage"), r6(F.col("cqr_coverage")).alias("cqr_coverage"), "n_test")


PAIRACC = "pa AS (SELECT l_orderkey, count(*) AS n_pairs, avg(CASE WHEN a.l_quantity = b.l_quantity THEN 0.5 ELSE (sign(a.l_quantity - b.l_quantity) = sign(a.l_extendedprice - b.l_extendedprice))::INT END) AS acc FROM lineitem a JOIN lineitem b USING (l_orderkey) WHERE a.l_linenumber < b.l_linenumber AND a.l_extendedprice <> b.l_extendedprice GROUP BY 1)"


@query(
    f"""WITH {PAIRACC}, sp AS ({ORACLE['wn_spearman']}), th AS ({ORACLE['wn_top_hits'].replace('round(', '(').replace(', 6)', ')')}), x AS (SELECT sp.l_orderkey, sp.n, sp.spearman, th.top1, th.top3, th.random1, th.random3, pa.acc FROM sp JOIN th USING (l_orderkey) LEFT JOIN pa USING (l_orderkey)),
s AS (SELECT *, CASE WHEN n = 1 THEN '1' WHEN n <= 3 THEN '2-3' WHEN n <= 6 THEN '4-6' ELSE '7+' END AS stratum FROM x), u AS (SELECT * FROM s UNION ALL SELECT * REPLACE ('4+' AS stratum) FROM s WHERE n >= 4)
SELECT stratum, count(*) AS n_groups, round(avg(spearman), 5) AS spearman, round(avg(top1), 6) AS top1, round(avg(top3), 6) AS top3, round(avg(acc), 6) AS pairwise, round(avg(random1), 6) AS random1, round(avg(random3), 6) AS random3 FROM u GROUP BY stratum"""
)
def md_stratified_eval(spark, d) -> DataFrame:
    """Ranking quality by group-size stratum, with random baselines and the joint stratum 4+."""
    t = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice", F.struct("l_linenumber", "l_partkey").alias("tie"))
    sp = E.group_spearman(t.drop("tie", "l_linenumber"), ["l_orderkey"], "l_quantity", "l_extendedprice")
    th = E.top_hits(t, ["l_orderkey"], "l_quantity", "l_extendedprice", "tie")
    a, b = t.select("l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice").toDF("l_orderkey", "i", "s1", "t1"), t.select("l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice").toDF("l_orderkey", "j", "s2", "t2")
    pairs = a.join(b, "l_orderkey").filter("i < j").select("l_orderkey", (F.col("s1") - F.col("s2")).alias("ds"), (F.col("t1") - F.col("t2")).alias("dt"))
    pa = E.pairwise_accuracy(pairs, ["l_orderkey"])
    x = sp.join(th, "l_orderkey").join(pa, "l_orderkey", "left")
    n = F.col("n")
    s = x.withColumn("stratum", F.when(n == 1, F.array(F.lit("1"))).when(n <= 3, F.array(F.lit("2-3"))).when(n <= 6, F.array(F.lit("4-6"), F.lit("4+"))).otherwise(F.array(F.lit("7+"), F.lit("4+"))))
    return s.withColumn("stratum", F.explode("stratum")).groupBy("stratum").agg(
        F.count("*").alias("n_groups"), F.round(F.avg("spearman"), 5).alias("spearman"), r6(F.avg("top1")).alias("top1"), r6(F.avg("top3")).alias("top3"), r6(F.avg("accuracy")).alias("pairwise"), r6(F.avg("random1")).alias("random1"), r6(F.avg("random3")).alias("random3")
    )


@query(
    f"""WITH {PAIRACC}, sp AS ({ORACLE['wn_spearman']}), h AS (SELECT o_orderkey AS l_orderkey, o_orderpriority AS host FROM orders) SELECT host, count(*) AS n_groups, round(avg(spearman), 5) AS macro_spearman, round(median(spearman), 5) AS median_spearman, round(quantile_cont(spearman, 0.25), 5) AS p25, round(quantile_cont(spearman, 0.75), 5) AS p75, round(avg(acc), 6) AS accuracy FROM sp JOIN h USING (l_orderkey) LEFT JOIN pa USING (l_orderkey) GROUP BY host"""
)
def md_group_metrics(spark, d) -> DataFrame:
    """Macro, median and quartile metrics of groups, per host (an own column, not cut from a
    key; the order's priority stands for it)."""
    t = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice")
    sp = E.group_spearman(t.select("l_orderkey", "l_quantity", "l_extendedprice"), ["l_orderkey"], "l_quantity", "l_extendedprice").withColumn("spearman", r6(F.col("spearman")))
    a, b = t.toDF("l_orderkey", "i", "s1", "t1"), t.toDF("l_orderkey", "j", "s2", "t2")
    pa = E.pairwise_accuracy(a.join(b, "l_orderkey").filter("i < j").select("l_orderkey", (F.col("s1") - F.col("s2")).alias("ds"), (F.col("t1") - F.col("t2")).alias("dt")), ["l_orderkey"])
    h = table(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_orderpriority").alias("host"))
    q = F.percentile("spearman", F.lit([0.25, 0.5, 0.75]))
    g = sp.join(h, "l_orderkey").join(pa, "l_orderkey", "left").groupBy("host").agg(F.count("*").alias("n_groups"), F.avg("spearman").alias("m"), q.alias("q"), r6(F.avg("accuracy")).alias("accuracy"))
    return g.select("host", "n_groups", F.round("m", 5).alias("macro_spearman"), F.round(F.col("q")[1], 5).alias("median_spearman"), F.round(F.col("q")[0], 5).alias("p25"), F.round(F.col("q")[2], 5).alias("p75"), "accuracy")


@query(
    """WITH p AS (SELECT a.l_quantity - b.l_quantity AS ds, sign(a.l_extendedprice - b.l_extendedprice) AS y FROM lineitem a JOIN lineitem b USING (l_orderkey) WHERE a.l_linenumber < b.l_linenumber AND a.l_extendedprice <> b.l_extendedprice), r AS (SELECT ds, y, rank() OVER (ORDER BY ds) + (count(*) OVER (PARTITION BY ds) - 1) / 2 AS x, rank() OVER (ORDER BY y) + (count(*) OVER (PARTITION BY y) - 1) / 2 AS z FROM p)
SELECT count(*) AS n, round(avg((sign(ds) = y)::INT), 6) AS accuracy, round(corr(x, z), 6) AS spearman FROM r"""
)
def md_global_rank(spark, d) -> DataFrame:
    """Accuracy and Spearman over all pairs.  Ranks come from the counts of distinct values, so
    no window runs over all rows."""
    from ..operators.ordinals import running_sum

    t = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice")
    p = t.toDF("k", "i", "s1", "t1").join(t.toDF("k", "j", "s2", "t2"), "k").filter("i < j and t1 <> t2").select((F.col("s1") - F.col("s2")).alias("ds"), F.signum(F.col("t1") - F.col("t2")).alias("y"))
    cells = p.groupBy("ds", "y").agg(F.count("*").alias("n"))

    def ranks(c: str, out: str) -> DataFrame:
        by = cells.groupBy(c).agg(F.sum("n").alias("k"))  # one row a distinct value
        return running_sum(by, [], [c], "k", "hi").select(c, (F.col("hi") - (F.col("k") - 1) / 2.0).alias(out))

    r = cells.join(ranks("ds", "x"), "ds").join(ranks("y", "z"), "y")
    n = F.sum("n")
    mx, mz = F.sum(F.col("n") * F.col("x")) / n, F.sum(F.col("n") * F.col("z")) / n
    cov = F.sum(F.col("n") * F.col("x") * F.col("z")) / n - mx * mz
    vx, vz = F.sum(F.col("n") * F.col("x") * F.col("x")) / n - mx * mx, F.sum(F.col("n") * F.col("z") * F.col("z")) / n - mz * mz
    hit = F.sum(F.when(F.signum("ds") == F.col("y"), F.col("n")).otherwise(0)) / n
    return r.agg(n.alias("n"), r6(hit).alias("accuracy"), r6(F.try_divide(cov, F.sqrt(vx * vz))).alias("spearman"))


# --- models ----------------------------------------------------------------------------------


MODEL_KEYS = ["struct_plddt_mean", "struct_helix_ratio", "evo_msa_depth", "evo_conservation_mean", "ctx_promoter_strength"]
LABELLED = "m AS (SELECT rec_id, expression.value AS y FROM integrated_test_1 WHERE expression.value IS NOT NULL AND NOT isnan(expression.value))"


def model_rows(spark, d) -> DataFrame:
    """Labelled records with their vectors, written once: every tree reads them again."""
    from ..operators.models import assembled

    r = records(spark, d).select("rec_id", "host", number(F.col("expression.value")).alias("y"), F.length("aa").alias("n"), *[F.try_element_at("extra_features", F.lit(k)).alias(k) for k in MODEL_KEYS])
    return cut(assembled(spread(r.filter("y is not null")), ["n", *MODEL_KEYS]).select("rec_id", "host", "y", "features"))


def _checked(scored: DataFrame, spark, d) -> DataFrame:
    """One row: rows, rows with a usable sigma, and whether mu errs less than one constant."""
    e = scored.agg(F.count("*").alias("n_rows"), F.count_if(F.col("sigma") > 0).alias("n_sigma"), F.countDistinct(r6(F.col("sigma"))).alias("k"), F.avg(F.abs(F.col("y") - F.col("mu"))).alias("mae"), F.avg("y").alias("m"))
    flat = scored.crossJoin(F.broadcast(e.select("m"))).agg(F.avg(F.abs(F.col("y") - F.col("m"))).alias("flat"))  # one row
    return e.crossJoin(flat).select("n_rows", "n_sigma", (F.col("k") > 1).alias("sigma_differs"), (F.col("mae") < F.col("flat")).alias("beats_constant"))  # two single rows


CHECKED = f"WITH {LABELLED} SELECT count(*) AS n_rows, count(*) AS n_sigma, true AS sigma_differs, true AS beats_constant FROM m"


@query()
def md_surrogate(spark, d) -> DataFrame:
    """Median and upper-quantile surrogate: mu and sigma of every record (its properties are
    checked by md_surrogate_checks)."""
    from ..operators.models import QuantileSurrogate

    rows = model_rows(spark, d)
    return QuantileSurrogate.fit(rows, "y").predict(rows).select("rec_id", r6(F.col("mu")).alias("mu"), r6(F.col("sigma")).alias("sigma"))


@query(CHECKED)
def md_surrogate_checks(spark, d) -> DataFrame:
    """The surrogate on its own rows, half as many trees, saved and loaded in between: every sigma
    is positive, sigmas differ, and mu errs less than the mean."""
    from ..operators.models import QuantileSurrogate

    rows = model_rows(spark, d)
    path = f"{checkpoint_dir(spark)}/surrogate-{uuid.uuid4().hex}"
    QuantileSurrogate.fit(rows, "y", trees=10).save(path)
    return _checked(QuantileSurrogate.load(path).predict(rows), spark, d)


@query()
def md_ensemble(spark, d) -> DataFrame:
    from ..operators.models import ensemble, ensemble_predict

    rows = model_rows(spark, d)
    return ensemble_predict(ensemble(rows, "y", "rec_id"), rows).select("rec_id", r6(F.col("mu")).alias("mu"), r6(F.col("sigma")).alias("sigma"))


@query(
    f"WITH {LABELLED}, p AS (SELECT {sql_seeded(42, 'rec_id')} / {1 << 60}.0::DOUBLE AS u FROM m) SELECT count(*) FILTER (u >= 0.35) AS n_train, count(*) FILTER (u >= 0.15 AND u < 0.35) AS n_cal, count(*) FILTER (u < 0.15) AS n_test, true AS near_level, true AS has_width FROM p"
)
def md_ensemble_conformal(spark, d) -> DataFrame:
    """Ensemble with calibrated intervals, in three parts: sizes, and whether the coverage on the
    test rows lies within a tenth of the level of 90 %."""
    from ..operators.models import ensemble_with_conformal

    report, _ = ensemble_with_conformal(model_rows(spark, d), "y", "rec_id", members=2, trees=5)
    return report.select("n_train", "n_cal", "n_test", (F.abs(F.col("coverage") - 0.9) <= 0.1).alias("near_level"), (F.col("width") > 0).alias("has_width"))


@query("SELECT * FROM (VALUES ('ctx', 1, true), ('evo', 2, true), ('n', 1, true), ('struct', 2, true)) AS t(family, n_features, is_share)")
def md_importance(spark, d) -> DataFrame:
    """Feature importances of an ensemble by family: features, and whether their sum is a share."""
    from ..operators.models import ensemble, importance_summary

    got = importance_summary(ensemble(model_rows(spark, d), "y", "rec_id", members=2, trees=5), ["n", *MODEL_KEYS])
    rows = spark.createDataFrame(got, "feature string, mean double, std double")
    by = rows.groupBy(F.regexp_extract("feature", "^([a-z0-9]+)", 1).alias("family")).agg(F.count("*").cast("int").alias("n_features"), F.sum("mean").alias("s"))
    return by.select("family", "n_features", F.col("s").between(0, 1 + 1e-9).alias("is_share"))


@query(f"WITH {RECORDS}, {LABELLED} SELECT host, count(*) AS n_rows, true AS mae_is_least, true AS quantiles_rise FROM m JOIN rec USING (rec_id) GROUP BY host")
def md_model_test(spark, d) -> DataFrame:
    """Test of a model by host: rows, and whether its errors are in order (mean error at most the
    root of the mean square, error quantiles rising)."""
    from ..operators.models import QuantileSurrogate

    rows = model_rows(spark, d)
    m = E.regression_metrics(QuantileSurrogate.fit(rows, "y", trees=5).predict(rows), "y", "mu", ["host"])
    return m.select("host", F.col("n").alias("n_rows"), (F.col("mae") <= F.col("rmse") + 1e-9).alias("mae_is_least"), ((F.col("median_ae") <= F.col("p90")) & (F.col("p90") <= F.col("max_ae"))).alias("quantiles_rise"))


@query()
def md_out_of_fold(spark, d) -> DataFrame:
    """Weak labels by models that never saw the row, with their confidence."""
    from ..operators.models import out_of_fold

    return out_of_fold(model_rows(spark, d), "y", "rec_id")


@query(f"WITH {LABELLED} SELECT rec_id, ({sql_seeded(5, 'rec_id')} % 5)::INT AS fold, true AS has_weak, true AS sure FROM m")
def md_out_of_fold_checks(spark, d) -> DataFrame:
    """The weak labels' folds, and whether label and confidence are in their ranges."""
    r = md_out_of_fold(spark, d)
    return r.select("rec_id", "fold", F.col("weak").isNotNull().alias("has_weak"), F.col("confidence").between(0, 1).alias("sure"))


@query()
def md_rank_net(spark, d) -> DataFrame:
    """Linear pairwise ranker on the group pairs: codon adaptation, composition and length of the
    sequences of one protein; scores of every record."""
    from ..operators.models import rank_net, rank_score

    s, f = F.col("s"), F.col("f")
    vectors = coding(spark, d).select("rec_id", "s", "cs", "host", K.codon_facts(F.col("cs"), F.col("host")).alias("f")).select(
        "rec_id", F.array(K.cai(f), K.tai(f), K.fop(f), K.gc(s), K.codon_pair_bias(F.col("cs"), F.col("host")), K.pair_bias(s, "CG")["obs_exp"], K.five_prime_structure(s) / 10).alias("x")
    )
    g = cut(grouped(spark, d).filter("v is not null").join(vectors, "rec_id"))
    pairs = C.pair_vectors(C.group_pairs(g, "grp", "rec_id", "v").select("grp", "i", "j", "label"), g, "grp", "rec_id", "x")
    return rank_score(rank_net(pairs), g, "x").select("rec_id", r6(F.col("score")).alias("score"))


# --- generation ------------------------------------------------------------------------------

BEST = ", ".join(f"('{aa}', '{max(cs, key=lambda c: G.usage('E_coli')[c])}')" for aa, cs in G.CODONS_OF.items() if aa != "*")


@query(
    f"""WITH {RECORDS}, best(r, codon) AS (VALUES {BEST}), l AS (SELECT rec_id, i, substr(aa, i::INT, 1) AS r FROM (SELECT rec_id, aa, unnest(range(1, length(aa) + 1)) AS i FROM rec WHERE aa IS NOT NULL)) SELECT rec_id, string_agg(codon, '' ORDER BY i) AS dna FROM l LEFT JOIN best USING (r) GROUP BY rec_id"""
)
def gn_highest_frequency(spark, d) -> DataFrame:
    """Back-translation with the most used codon of E. coli; unknown residues are left out."""
    r = spread(records(spark, d).filter("aa is not null").select("rec_id", "aa"))
    return r.select("rec_id", N.back_translate(F.col("aa"), "E_coli", "hfc", F.col("rec_id")).alias("dna"))


def _sql_steps(method: str) -> str:
    """``(r, upto, codon)``: the cumulative shares of each residue's codons in E. coli."""
    rows = []
    for aa, cs in G.CODONS_OF.items():
        use = [G.usage("E_coli")[c] for c in cs] if aa != "*" else []
        w = {"urc": [1.0] * len(use), "bfc": use, "softmax": [math.exp(x - max(use)) for x in use]}[method] if use else []
        rows += [f"('{aa}', {sum(w[: i + 1]) / sum(w)!r}::DOUBLE, '{c}', {i == len(w) - 1})" for i, c in enumerate(cs[: len(w)])]
    return f"{method}(r, upto, codon, final) AS (VALUES {', '.join(rows)})"


def _sql_drawn(method: str) -> str:
    return f"""SELECT group_no, '{method}' AS method, md5(string_agg(codon, '' ORDER BY i)) AS dna_key, count(*) AS n_codons FROM (SELECT group_no, i, arg_min(codon, CASE WHEN u < upto THEN upto WHEN final THEN 2 ELSE 3 END) AS codon FROM l JOIN {method} USING (r) GROUP BY group_no, i) GROUP BY group_no"""


@query(
    f"""WITH {', '.join(_sql_steps(m) for m in ('bfc', 'urc', 'softmax'))}, g AS (SELECT group_no, {sql_protein('protein_aa')} AS aa FROM protein_group), l AS (SELECT group_no, i, substr(aa, i::INT + 1, 1) AS r, {sql_uniform('group_no', 'i')} AS u FROM (SELECT group_no, aa, unnest(range(0, length(aa))) AS i FROM g WHERE aa IS NOT NULL))
{' UNION ALL '.join(_sql_drawn(m) for m in ('bfc', 'urc', 'softmax'))}"""
)
def gn_back_translations(spark, d) -> DataFrame:
    """Back-translation by use, uniformly and by softmax: the digest of each sequence."""
    g = spread(table(spark, d, "protein_group").select("group_no", protein_key("protein_aa").alias("aa")).filter("aa is not null"))
    made = F.array(*[F.struct(F.lit(m).alias("method"), N.back_translate(F.col("aa"), "E_coli", m, F.col("group_no")).alias("dna")) for m in ("bfc", "urc", "softmax")])
    return g.select("group_no", F.explode(made).alias("x")).select("group_no", "x.method", F.md5("x.dna").alias("dna_key"), (F.length("x.dna") / 3).cast("long").alias("n_codons"))


@query()
def gn_candidates(spark, d) -> DataFrame:
    """Three valid candidates per protein group, scored by the rule-based quality; the two best
    of each protein with their rank."""
    g = spread(table(spark, d, "protein_group").select("group_no", protein_key("protein_aa").alias("aa")))
    c = N.candidates(g, "group_no", "aa", "E_coli", 3, motifs=["GAATTC", "GGATCC"])
    cs = F.col("cs")
    s = c.withColumn("cs", K.codons(F.col("dna"))).withColumn("f", K.codon_facts(cs, F.lit("E_coli")))
    q = R.quality_score(K.cai(F.col("f")), K.gc(F.col("dna")), F.size(K.rare_runs(K.rare_flags(cs, F.lit("E_coli")))), F.size(K.homopolymers(F.col("dna"))))
    scored = s.select("id", "candidate", "dna", q.alias("score"))
    return N.ranked(scored, "score", 2).select(F.col("id").alias("group_no"), "rank", "candidate", r6(F.col("score")).alias("score"), F.md5("dna").alias("dna_key"))


@query()
def gn_constrained(spark, d) -> DataFrame:
    """Constrained decoding: motif hits left after up to five draws a position."""
    g = spread(table(spark, d, "protein_group").select("group_no", protein_key("protein_aa").alias("aa")).filter("aa is not null"))
    dna = g.select("group_no", N.constrained(F.col("aa"), "E_coli", ["GAATTC", "AAGCTT"], F.col("group_no")).alias("dna"))
    return dna.select("group_no", F.length("dna").alias("n_nt"), K.motif_hits(F.col("dna"), ["GAATTC", "AAGCTT"]).alias("n_hits"))


@query()
def gn_policy(spark, d) -> DataFrame:
    """Log probability of each sequence under a uniform policy and after one update towards high
    expression."""
    r = spread(records(spark, d).filter("raw is not null").select("rec_id", "s", number(F.col("expression.value")).alias("v"))).withColumn("cs", K.codons(F.col("s")))
    logits = N.policy_update(r, "cs", "v", {}, 0.1)
    return r.select("rec_id", r6(N.policy_log_prob(F.col("cs"), {})).alias("uniform_log_prob"), r6(N.policy_log_prob(F.col("cs"), logits)).alias("updated_log_prob"))
