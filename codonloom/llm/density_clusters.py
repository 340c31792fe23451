"""Density-peak clusters of similar proteins."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text_norm import protein_key
from ..plans.lineage import cut
from ..operators.components import components, follow_pointers
from .segjoin import edit_pairs

#: Rows of a cluster that one task pairs with the whole cluster.
PAIRED = 1000


def similarity_clusters(rows: DataFrame, id_col: str = "group_no", text_col: str = "protein_aa", num: int = 1, den: int = 4) -> tuple[DataFrame, DataFrame]:
    """``(members, classes)`` of the clusters of texts within ``num/den`` of the longer one.

    classes: one row per distinct text: ``uid, txt, weight`` (rows with it), ``density`` (weight
    of itself and of all its neighbours), ``parent`` (nearest denser neighbour, itself for a
    peak), ``delta`` (distance to it, null for a peak), ``peak`` (where the pointers lead),
    ``cluster``.  members: ``id, uid, cluster``.  Peaks whose trees touch - a text of one lies
    within reach of a text of the other - share a cluster, so clusters are closed under
    similarity; the cluster is named after its smallest uid.

    Ties: equal densities rank the smaller uid as denser; equally near parents go to the denser,
    then the smaller uid.  Rows with a null id are left out; rows whose text is null or empty
    (case, white space and ``*`` aside) are no members of any cluster.  Repeated rows count with
    their number.  An empty table gives empty results.
    """
    forms = rows.select(F.col(id_col).cast("long").alias("id"), protein_key(text_col).alias("txt")).dropna()
    keyed = forms.withColumn("key", F.unhex(F.sha2("txt", 256)))
    texts = cut(keyed.groupBy("key").agg(F.min("id").alias("uid"), F.any_value("txt").alias("txt"), F.count("*").alias("weight")))
    sizes = texts.select(F.lit(0).alias("kind"), F.length("txt").cast("long").alias("n"), F.lit(True).alias("home"), F.lit(True).alias("other"))
    sides = texts.select(F.lit(0).alias("kind"), "uid", "txt", F.lit(True).alias("home"), F.lit(True).alias("other"))
    links = cut(edit_pairs(sides, sizes, num, den, q=3, same=True, align=True, home_letters=6_000_000, other_letters=(4_000_000, 64_000_000)).select("uid_a", "uid_b", "dist"))
    both = links.select(F.col("uid_a").alias("uid"), F.col("uid_b").alias("near"), "dist").unionByName(
        links.select(F.col("uid_b").alias("uid"), F.col("uid_a").alias("near"), "dist")
    )
    weights = texts.select("uid", "weight")
    around = both.join(weights.select(F.col("uid").alias("near"), "weight"), "near").groupBy("uid").agg(F.sum("weight").alias("around"))
    dense = cut(weights.join(around, "uid", "left").select("uid", "weight", (F.col("weight") + F.coalesce("around", F.lit(0))).alias("density")))
    ranked = both.join(dense.select("uid", "density"), "uid").join(dense.select(F.col("uid").alias("near"), F.col("density").alias("near_density")), "near")
    denser = ranked.filter("near_density > density or (near_density = density and near < uid)")
    parents = denser.groupBy("uid").agg(F.min(F.struct("dist", (-F.col("near_density")).alias("d"), "near")).alias("p"))
    pointed = cut(
        dense.join(parents, "uid", "left").select("uid", "weight", "density", F.coalesce("p.near", "uid").alias("parent"), F.col("p.dist").alias("delta"))
    )
    peaks = follow_pointers(pointed.select(F.col("uid").alias("node"), "parent")).select(F.col("node").alias("uid"), F.col("root").alias("peak"))
    touching = (
        links.join(peaks.select(F.col("uid").alias("uid_a"), F.col("peak").alias("u")), "uid_a")
        .join(peaks.select(F.col("uid").alias("uid_b"), F.col("peak").alias("v")), "uid_b")
        .filter("u <> v")
        .select("u", "v")
        .distinct()
    )
    merged = components(touching).select(F.col("node").alias("peak"), F.col("comp"))
    labelled = peaks.join(merged, "peak", "left").withColumn("comp", F.coalesce("comp", "peak"))
    names = labelled.groupBy("comp").agg(F.min("uid").alias("cluster"))
    labels = cut(labelled.join(names, "comp").select("uid", "peak", "cluster"))
    classes = texts.select("uid", "txt").join(pointed, "uid").join(labels, "uid")
    members = keyed.select("id", "key").join(texts.select("key", "uid"), "key").join(labels.select("uid", "cluster"), "uid").select("id", "uid", "cluster")
    return members, classes


def cluster_pairs(members: DataFrame) -> DataFrame:
    """Every pair of rows of a cluster, the smaller id first.

    The rows of a large cluster are dealt to one part for each PAIRED of them, and each part
    meets the whole cluster, so no task makes the pairs of a hot cluster alone."""
    rows = cut(members.select("cluster", "id").distinct())
    parts = rows.groupBy("cluster").agg(F.ceil(F.count("*") / PAIRED).cast("int").alias("parts"))
    rows = rows.join(parts, "cluster")
    one = rows.select("cluster", F.pmod(F.xxhash64("id"), "parts").cast("int").alias("part"), F.col("id").alias("group_no_a"))
    two = rows.select("cluster", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.col("id").alias("group_no_b"))
    return one.join(two, ["cluster", "part"]).filter("group_no_a < group_no_b").select("group_no_a", "group_no_b")


def cluster_links(members: DataFrame) -> DataFrame:
    """The clusters as one row a member, which grows with the rows and not with their pairs:
    ``group_no``, its ``cluster`` and whether it is the cluster's representative row."""
    first = F.min("id").over(Window.partitionBy("uid"))
    return members.select(F.col("id").alias("group_no"), "cluster", ((F.col("uid") == F.col("cluster")) & (F.col("id") == first)).alias("names_cluster"))


def describe_clusters(classes: DataFrame, typical: int = 3) -> DataFrame:
    """Per cluster: rows, distinct texts, peaks and the ``typical`` densest texts.

    Typical members are the densest texts (ties: smaller uid); the first is the representative.
    """
    order = Window.partitionBy("cluster").orderBy(F.desc("density"), "uid")
    sums = classes.groupBy("cluster").agg(F.sum("weight").alias("size"), F.count("*").alias("n_texts"), F.count_if(F.col("parent") == F.col("uid")).alias("n_peaks"))
    top = (
        classes.select("cluster", "uid", "density", "txt")
        .withColumn("r", F.row_number().over(order))
        .filter(F.col("r") <= typical)
        .groupBy("cluster")
        .agg(F.sort_array(F.collect_list(F.struct("r", "uid"))).alias("t"), F.max(F.when(F.col("r") == 1, F.col("txt"))).alias("representative_aa"))
    )
    return sums.join(top, "cluster").select("cluster", "size", "n_texts", "n_peaks", F.col("t.uid").alias("typical_uids"), "representative_aa")
