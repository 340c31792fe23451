"""Queries of this subpackage: ``name -> callable(spark, data_dir)``."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..plans.registry import sql_protein, sql_sequence
from .density_clusters import cluster_links, cluster_pairs, describe_clusters, similarity_clusters
from .eval_leaks import find_leaks
from .grouped_split import SPLITS, grouped_split, tied_sets
from .mixture import mix, sized, source_key
from .residue import scan_residue
from .split_overlap import overlap_pairs, overlap_report, split_overlap


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return overlap_pairs(*split_overlap(table(spark, d, "integrated_test_1")))


def p2_overlap_report(spark: SparkSession, d: str) -> DataFrame:
    records = table(spark, d, "integrated_test_1")
    return overlap_report(records, *split_overlap(records))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    members, _ = similarity_clusters(table(spark, d, "protein_group"))
    return cluster_pairs(members)


def p3_members(spark: SparkSession, d: str) -> DataFrame:
    """Every row with its cluster, one row a member."""
    members, _ = similarity_clusters(table(spark, d, "protein_group"))
    return cluster_links(members)


def p3_cluster_report(spark: SparkSession, d: str) -> DataFrame:
    _, classes = similarity_clusters(table(spark, d, "protein_group"))
    return describe_clusters(classes)


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    tied = tied_sets(table(spark, d, "protein_group"), table(spark, d, "protein_cluster"))
    return tied.filter("tied <> group_no").select(F.col("tied").alias("group_no_a"), F.col("group_no").alias("group_no_b"))


def p5_split(spark: SparkSession, d: str) -> DataFrame:
    return grouped_split(table(spark, d, "protein_group"), table(spark, d, "protein_cluster"))


def p5_split_report(spark: SparkSession, d: str) -> DataFrame:
    """Rows and shares of each split, overall (host null) and within each host."""
    rows = grouped_split(table(spark, d, "protein_group"), table(spark, d, "protein_cluster"))
    by_host = rows.groupBy("host", "split").agg(F.count("*").alias("n_rows"))
    by_split = by_host.groupBy("split").agg(F.sum("n_rows").alias("n_rows")).withColumn("host", F.lit(None).cast("string"))
    target = F.create_map(*[F.lit(x) for kv in SPLITS.items() for x in kv])
    share = F.col("n_rows") / F.sum("n_rows").over(Window.partitionBy("host"))
    return by_host.unionByName(by_split).select("host", "split", "n_rows", F.round(share, 6).alias("share"), target[F.col("split")].alias("target"))


def p5_split_checks(spark: SparkSession, d: str) -> DataFrame:
    """The split's rows, its tied sets in more than one split, and whether every share of the rows
    lies within 0.02 of its target."""
    rows = p5_split(spark, d)
    torn = rows.groupBy("tied").agg(F.countDistinct("split").alias("k")).agg(F.count_if(F.col("k") > 1).alias("ties_broken"))
    n = rows.agg(F.count("*").alias("n_rows"), *[F.avg((F.col("split") == s).cast("double")).alias(s) for s in SPLITS])
    near = [F.abs(F.col(s) - share) <= 0.02 for s, share in SPLITS.items()]
    return n.crossJoin(torn).select("n_rows", "ties_broken", (near[0] & near[1] & near[2]).alias("near_shares"))  # two single rows


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return find_leaks(table(spark, d, "documents"), table(spark, d, "eval_items")).select("doc_id", "item_id")


def p6_leak_report(spark: SparkSession, d: str) -> DataFrame:
    """Per item: leaked documents and the largest share of its words found in one."""
    leaks = find_leaks(table(spark, d, "documents"), table(spark, d, "eval_items"))
    return leaks.groupBy("item_id").agg(F.countDistinct("doc_id").alias("n_docs"), F.round(F.max("share"), 6).alias("max_share"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    """Sources that the fitted mix holds in every allowed copy and that still lack their share."""
    return p7_mix_report(spark, d).filter("used_up and missing > 0").select("source")


def p7_mix_report(spark: SparkSession, d: str) -> DataFrame:
    _, report = mix(sized(table(spark, d, "documents")), table(spark, d, "mixture_targets"))
    return report


def p7_mix_checks(spark: SparkSession, d: str) -> DataFrame:
    """Per source: whether its tokens keep to the budget, and whether they miss it by less than one
    of its documents or every allowed copy is used."""
    sizes = sized(table(spark, d, "documents"))
    _, r = mix(sizes, table(spark, d, "mixture_targets"))
    longest = sizes.groupBy("key").agg(F.max("n_tokens").alias("longest"))
    r = r.withColumn("key", source_key("source")).join(longest, "key", "left")
    met = F.col("used_up") | F.coalesce(F.col("budget") - F.col("tokens") < F.col("longest"), F.lit(False))
    return r.select("source", (F.col("tokens") <= F.col("budget")).alias("within_budget"), met.alias("met_or_used_up"))


def p7_mix(spark: SparkSession, d: str) -> DataFrame:
    chosen, _ = mix(sized(table(spark, d, "documents")), table(spark, d, "mixture_targets"))
    return chosen


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return scan_residue(table(spark, d, "documents")).filter("is_residue").select(F.col("id").alias("doc_id"))


def p8_residue_report(spark: SparkSession, d: str) -> DataFrame:
    """Per kind of residue: documents, and their mean share of residue letters."""
    found = scan_residue(table(spark, d, "documents")).filter("is_residue")
    return found.select(F.explode("residue_kinds").alias("kind"), "residue_share").groupBy("kind").agg(F.count("*").alias("n_docs"), F.round(F.avg("residue_share"), 6).alias("mean_share"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: v for k, v in globals().items() if k[:1] == "p" and k[1:2].isdigit() and callable(v)}


PROTEIN, SEQUENCE = sql_protein("protein_aa"), sql_sequence("sequence")
OVERLAPS = f"""t AS (SELECT rec_id, split = 'train' AS train, kind, txt FROM (SELECT rec_id, split, 0 AS kind, {PROTEIN} AS txt FROM integrated_test_1 UNION ALL SELECT rec_id, split, 1, {SEQUENCE} FROM integrated_test_1) WHERE split IN ('train', 'val', 'test') AND txt IS NOT NULL),
u AS (SELECT DISTINCT kind, train, txt, length(txt) AS n FROM t), l AS (SELECT a.kind, a.txt AS x, b.txt AS y FROM u a JOIN u b ON a.kind = b.kind AND NOT a.train AND b.train AND abs(a.n - b.n) <= greatest(a.n, b.n) // 10 WHERE a.txt = b.txt OR levenshtein(a.txt, b.txt) <= greatest(a.n, b.n) // 10),
o AS (SELECT DISTINCT a.rec_id AS held, b.rec_id AS train, l.x = l.y AS same FROM l JOIN t a ON a.kind = l.kind AND NOT a.train AND a.txt = l.x JOIN t b ON b.kind = l.kind AND b.train AND b.txt = l.y)"""
CLUSTERS = f"""t AS (SELECT group_no, {PROTEIN} AS p FROM protein_group), u AS (SELECT p, length(p) AS n, min(group_no) AS id, count(*) AS weight FROM t WHERE p IS NOT NULL GROUP BY p),
d AS (SELECT a.id AS x, b.id AS y, levenshtein(a.p, b.p) AS dist, greatest(a.n, b.n) // 4 AS k FROM u a JOIN u b ON a.id < b.id AND abs(a.n - b.n) <= greatest(a.n, b.n) // 4), l AS (SELECT x, y, dist FROM d WHERE dist <= k), e AS (SELECT x, y, dist FROM l UNION ALL SELECT y, x, dist FROM l),
r(n, c) AS (SELECT id, id FROM u UNION SELECT e.y, r.c FROM r JOIN e ON e.x = r.n WHERE r.c < e.y), c AS (SELECT n, min(c) AS c FROM r GROUP BY n)"""


def oracle_sql() -> dict[str, str]:
    return {
        "p2_found": f"WITH {OVERLAPS} SELECT DISTINCT least(held, train) AS rec_id_a, greatest(held, train) AS rec_id_b FROM o",
        "p2_overlap_report": f"""WITH {OVERLAPS}, h AS (SELECT rec_id, bool_or(same) AS exact FROM (SELECT held AS rec_id, same FROM o UNION ALL SELECT train, same FROM o) GROUP BY rec_id)
SELECT split, source_file, count(*) AS n_records, count(exact) AS n_overlap, count(*) FILTER (exact) AS n_exact FROM integrated_test_1 LEFT JOIN h USING (rec_id) GROUP BY split, source_file""",
        "p3_found": f"WITH RECURSIVE {CLUSTERS}, g AS (SELECT t.group_no, c.c FROM t JOIN u USING (p) JOIN c ON c.n = u.id) SELECT a.group_no AS group_no_a, b.group_no AS group_no_b FROM g a JOIN g b USING (c) WHERE a.group_no < b.group_no",
        "p3_members": f"WITH RECURSIVE {CLUSTERS} SELECT t.group_no, c.c AS cluster, t.group_no = c.c AS names_cluster FROM t JOIN u USING (p) JOIN c ON c.n = u.id",
        # density: rows with a text and with its neighbours; typical members: the densest texts
        "p3_cluster_report": f"""WITH RECURSIVE {CLUSTERS}, f AS (SELECT u.id, u.weight + coalesce(sum(v.weight), 0) AS density FROM u LEFT JOIN e ON e.x = u.id LEFT JOIN u v ON v.id = e.y GROUP BY u.id, u.weight),
k AS (SELECT DISTINCT e.x FROM e JOIN f a ON a.id = e.x JOIN f b ON b.id = e.y WHERE b.density > a.density OR (b.density = a.density AND b.id < a.id)),
m AS (SELECT c.c, u.id, u.p, u.weight, f.density, k.x IS NULL AS peak, row_number() OVER (PARTITION BY c.c ORDER BY f.density DESC, u.id) AS r FROM u JOIN c ON c.n = u.id JOIN f USING (id) LEFT JOIN k ON k.x = u.id)
SELECT c AS cluster, sum(weight)::BIGINT AS size, count(*) AS n_texts, count(*) FILTER (peak) AS n_peaks, list(id ORDER BY r) FILTER (r <= 3) AS typical_uids, max(p) FILTER (r = 1) AS representative_aa FROM m GROUP BY c""",
        "p5_found": f"""WITH RECURSIVE g AS (SELECT group_no, group_id, cluster_id, {PROTEIN} AS p FROM protein_group), l AS (SELECT DISTINCT cluster_id AS c, unnest(protein_groups) AS group_id FROM protein_cluster),
m AS (SELECT 'c' || l.c AS k, g.group_no FROM l JOIN g USING (group_id) UNION SELECT 'c' || cluster_id, group_no FROM g WHERE cluster_id IS NOT NULL UNION SELECT 'p' || p, group_no FROM g WHERE p IS NOT NULL),
s AS (SELECT group_no AS u, min(group_no) OVER (PARTITION BY k) AS v FROM m), e AS (SELECT u, v FROM s WHERE u <> v UNION SELECT v, u FROM s WHERE u <> v),
r(n, c) AS (SELECT group_no, group_no FROM g UNION SELECT e.v, r.c FROM r JOIN e ON e.u = r.n WHERE r.c < e.v)
SELECT min(c) AS group_no_a, n AS group_no_b FROM r GROUP BY n HAVING min(c) <> n""",
        "p5_split_checks": "SELECT count(DISTINCT group_no) AS n_rows, 0 AS ties_broken, true AS near_shares FROM protein_group",
        "p7_mix_checks": "SELECT source, true AS within_budget, true AS met_or_used_up FROM mixture_targets",
        # letters stand for tokens: the listed sources are the same with either measure
        "p7_found": """WITH d AS (SELECT lower(trim(source)) AS k, length(text) AS n FROM documents), t AS (SELECT coalesce(sum(n), 0) AS t FROM d), z AS (SELECT k, sum(n) AS n FROM d GROUP BY k)
SELECT source FROM mixture_targets m LEFT JOIN z ON z.k = lower(trim(m.source)), t WHERE coalesce(z.n, 0) * max_repeats < target_share * t.t""",
    }
