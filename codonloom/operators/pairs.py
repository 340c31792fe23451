"""Pair generation within groups, weak labels, clusters and split audits."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.seeded import seeded, uniform
from ..plans.lineage import cut
from .components import components
from .kmer_join import forest
from .records import take_lowest
from .similarity import kmer_jaccard, near_texts, text_classes


def group_pairs(rows: DataFrame, group: str, index: str, value: str, least: float = 0.0) -> DataFrame:
    """``group, i, j, vi, vj, label`` of all pairs i < j of a group whose values differ by more
    than ``least`` (ties never pair); label 1 if the first is larger.  Null values pair with none."""
    r = rows.select(group, index, value).filter(F.col(value).isNotNull())
    diff = F.abs(F.col("vi") - F.col("vj"))
    return met(r, group, index, value).filter(diff > least).withColumn("label", (F.col("vi") > F.col("vj")).cast("int"))


#: Members of a group that one task pairs with the whole group.
PAIRED = 1000


def met(rows: DataFrame, group: str, index: str, value: str) -> DataFrame:
    """``group, i, j, vi, vj`` of all members i < j of a group.

    The members of a large group are dealt to one part for each ``PAIRED`` of them, and each part
    meets the whole group, so a group with a third of all rows is no single task."""
    parts = rows.groupBy(group).agg(F.ceil(F.count("*") / PAIRED).cast("int").alias("_parts")).filter("_parts > 0")
    r = rows.join(parts, group)
    part = F.pmod(F.xxhash64(index), F.col("_parts")).cast("int")
    a = r.select(group, part.alias("_part"), F.col(index).alias("i"), F.col(value).alias("vi"))
    b = r.select(group, F.explode(F.sequence(F.lit(0), F.col("_parts") - 1)).alias("_part"), F.col(index).alias("j"), F.col(value).alias("vj"))
    return a.join(b, [group, "_part"]).filter(F.col("i") < F.col("j")).drop("_part")


def capped(pairs: DataFrame, part: list[str], order: list[Column | str], cap: int) -> DataFrame:
    return pairs.withColumn("_r", F.row_number().over(Window.partitionBy(*part).orderBy(*order))).filter(F.col("_r") <= cap).drop("_r")


def topped_up(real: DataFrame, weak: DataFrame, target: int, share: float, group: str, cap: int, seed: int) -> DataFrame:
    """Real pairs and, if they are fewer than ``target``, seeded weak pairs: at most ``cap`` a
    group and ``share`` of the target in all (the sample is the feature)."""
    n = real.count()
    room = max(0, min(target - n, int(share * target)))
    h = seeded(seed, group, "i", "j")
    few = take_lowest(take_lowest(weak, [group], h, ["i", "j"], F.lit(cap)), [], h, [group, "i", "j"], F.lit(room))
    return real.withColumn("source", F.lit("real")).unionByName(few.withColumn("source", F.lit("weak")))


def noise_pairs(rows: DataFrame, group: str, index: str, value: str, scale: float, seed: int) -> DataFrame:
    """Synthetic pairs: values with seeded uniform noise of the given scale decide the label."""
    u = uniform(F.lit(seed), F.col(group), F.col(index)) - 0.5
    return group_pairs(rows.withColumn(value, F.col(value) + u * scale), group, index, value).withColumn("source", F.lit("synthetic"))


def robust_pairs(real: DataFrame, weak: DataFrame, synthetic: DataFrame, group: str, target: int, weak_share: float = 0.7, synthetic_share: float = 0.5, cap: int = 500, least: float = 0.1, seed: int = 5) -> DataFrame:
    """Real pairs, weak pairs (at most ``weak_share`` of the target) and, only if both are fewer
    than ``target``, synthetic pairs (at most ``synthetic_share`` of it); of each group the first
    ``cap`` in this order.  Weak and synthetic values differ by ``least`` or more; what exceeds a
    share is drawn by seeded hash."""
    h = seeded(seed, group, "i", "j")

    def drawn(pairs: DataFrame, source: str, share: float) -> DataFrame:
        few = pairs.filter(F.abs(F.col("vi") - F.col("vj")) >= least)
        return take_lowest(few, [], h, [group, "i", "j"], F.lit(int(target * share))).withColumn("source", F.lit(source))

    out = real.withColumn("source", F.lit("real")).unionByName(drawn(weak, "weak", weak_share))
    if out.count() < target:
        out = out.unionByName(drawn(synthetic.drop("source"), "synthetic", synthetic_share))
    turn = F.array_position(F.array(*map(F.lit, ("real", "weak", "synthetic"))), F.col("source"))
    return capped(out, [group], [turn, "i", "j"], cap)


def hard_easy(pairs: DataFrame, group: str, cap: int = 100, low: float = 0.5, high: float = 2.5) -> DataFrame:
    """Pairs as ``hard`` (difference in [low, high]) or ``easy`` (above), each member in at most
    ``cap`` of them.

    The cap is greedy: a group's pairs are taken in order of i, then j, unless a member has its
    ``cap`` pairs already, so the members after a saturated run pair with each other.  A group is
    one sorted run of rows in one task; only the counts of its members are kept in memory."""
    d = F.abs(F.col("vi") - F.col("vj"))
    kept = pairs.filter(d >= low).withColumn("level", F.when(d <= high, "hard").otherwise("easy"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, used = None, {}
        for batch in batches:
            keep = []
            for g, i, j in zip(*(batch.column(c).to_pylist() for c in (group, "i", "j")), strict=True):
                if g != at:
                    at, used = g, {}
                a, b = used.get(i, 0), used.get(j, 0)
                free = a < cap and b < cap
                if free:
                    used[i], used[j] = a + 1, b + 1
                keep.append(free)
            yield batch.filter(pa.array(keep, pa.bool_()))

    return kept.repartition(group).sortWithinPartitions(group, "i", "j").mapInArrow(run, kept.schema)


def sample_levels(pairs: DataFrame, target: int, hard_share: float, seed: int) -> DataFrame:
    """``target`` pairs, ``hard_share`` of them hard, by seeded hash (the sample is the feature)."""
    hard = int(target * hard_share)
    quota = F.when(F.col("level") == "hard", hard).otherwise(target - hard)
    return take_lowest(pairs, ["level"], seeded(seed, "i", "j"), ["i", "j"], quota)


def ridge_residual(rows: DataFrame, x: str, y: str, train: Column, alpha: float = 0.1, divisor: float = 10.0, least: int = 10) -> DataFrame:
    """``rows`` with ``residual`` = x - predicted(y | x) / divisor from a one-variable ridge fit on
    the training rows; with fewer than ``least`` of them the residual is x."""
    ok = train & F.col(x).isNotNull() & F.col(y).isNotNull()
    tx, ty = F.when(ok, F.col(x)), F.when(ok, F.col(y))
    fit = rows.agg(F.count(tx).alias("_n"), F.avg(tx).alias("_mx"), F.avg(ty).alias("_my"), F.covar_pop(tx, ty).alias("_cxy"), F.var_pop(tx).alias("_vx"))
    slope = F.col("_cxy") * F.col("_n") / (F.col("_vx") * F.col("_n") + alpha)
    guess = F.col("_my") + slope * (F.col(x) - F.col("_mx"))
    out = rows.crossJoin(F.broadcast(fit))  # one row
    return out.withColumn("residual", F.when(F.col("_n") < least, F.col(x)).otherwise(F.col(x) - guess / divisor)).drop("_n", "_mx", "_my", "_cxy", "_vx")


def pair_vectors(pairs: DataFrame, vectors: DataFrame, group: str, index: str, vector: str) -> DataFrame:
    """Pairs with both members' vectors, joined by group and index."""
    a = vectors.select(group, F.col(index).alias("i"), F.col(vector).alias("xi"))
    b = vectors.select(group, F.col(index).alias("j"), F.col(vector).alias("xj"))
    return pairs.join(a, [group, "i"]).join(b, [group, "j"])


def _kmer_distance(texts: list[str], k: int) -> np.ndarray:
    """1 - Jaccard of the texts' k-mer sets, each row counted from the holders of its k-mers."""
    sets = [{t[i : i + k] for i in range(len(t) - k + 1)} for t in texts]
    held: dict[str, list[int]] = {}
    for i, own in enumerate(sets):
        for mer in own:
            held.setdefault(mer, []).append(i)
    holders = {mer: np.array(own) for mer, own in held.items()}
    n, size = len(sets), np.array([len(own) for own in sets], dtype=float)
    dist = np.ones((n, n))
    for i, own in enumerate(sets):
        if own:
            both = np.bincount(np.concatenate([holders[mer] for mer in own]), minlength=n)
            dist[i] = 1 - both / (size[i] + size - both)
    return dist


def _linkage(dist: np.ndarray, want: int) -> np.ndarray:
    """Labels (index of the first member) of ``want`` clusters by average linkage; of equally near
    clusters the first two in order of index merge.  ``dist`` is used up.

    Averages are not below both their parts, so a row's old minimum bounds the new one and is
    only renewed when it comes up as the least of all."""
    n = len(dist)
    np.fill_diagonal(dist, np.inf)
    size, label = np.ones(n), np.arange(n)
    near = dist.argmin(axis=1) if n else label
    least, stale = dist[np.arange(n), near], np.zeros(n, dtype=bool)
    for _ in range(n - min(n, want)):
        while stale[i := int(least.argmin())]:
            near[i] = dist[i].argmin()
            least[i], stale[i] = dist[i, near[i]], False
        j = int(near[i])
        row = (dist[i] * size[i] + dist[j] * size[j]) / (size[i] + size[j])
        dist[i], dist[:, i] = row, row
        dist[i, i] = np.inf
        dist[j], dist[:, j] = np.inf, np.inf
        size[i] += size[j]
        label[label == j] = i
        stale |= (near == i) | (near == j)
        lower = row < least  # by rounding only
        first = ~stale & (row == least) & (near > i)
        near[lower | first] = i
        least[lower], stale[lower] = row[lower], False
        near[i] = dist[i].argmin()
        least[i], stale[i] = dist[i, near[i]], False
        least[j], stale[j] = np.inf, False
    return label


def average_linkage(rows: DataFrame, part: str, id_col: str, text: str, k: int = 3, most: int | None = None, linked: float = 0.3) -> DataFrame:
    """``part, id, cluster`` by average linkage on 1 - Jaccard of k-mers, ``max(2, n // 3)``
    clusters a part, each named after its smallest id.  Null parts, ids and texts are left out.

    The rule is the same at all sizes; a part of n rows takes 8 n^2 bytes in one task.  Only a
    caller that gives ``most`` gets another one for parts above it: similarity edges of at least
    ``linked`` and connected components."""
    kind = rows.schema[id_col].dataType.simpleString()
    src = rows.select(F.col(part).cast("string").alias("part"), F.col(id_col).alias("id"), F.col(text).alias("txt")).dropna()

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("id")
        first = pdf["id"].to_numpy()[_linkage(_kmer_distance(pdf["txt"].tolist(), k), max(2, len(pdf) // 3))]
        return pd.DataFrame({"part": pdf["part"], "id": pdf["id"], "cluster": first})

    if most is None:
        return src.groupBy("part").applyInPandas(run, f"part string, id {kind}, cluster {kind}")
    src = src.join(src.groupBy("part").agg(F.count("*").alias("n")), "part")
    small = src.filter(F.col("n") <= most).groupBy("part").applyInPandas(run, f"part string, id {kind}, cluster {kind}")
    big = src.filter(F.col("n") > most).select("part", "id", "txt")
    edges = kmer_jaccard(big.select("id", "part", "txt"), k, linked).select(F.col("id_a").alias("u"), F.col("id_b").alias("v"))
    comp = components(edges).select(F.col("node").alias("id"), F.col("comp").alias("cluster"))
    rest = big.select("part", "id").join(comp, "id", "left").select("part", "id", F.coalesce("cluster", "id").alias("cluster"))
    return small.unionByName(rest)


def _identity_distance(texts: list[str]) -> np.ndarray:
    """1 - share of equal letters at equal places, over the shorter of two texts (1 if it is empty)."""
    n, size = len(texts), np.array([len(t) for t in texts])
    codes = np.zeros((n, int(size.max(initial=0))), dtype=np.uint32)
    for i, t in enumerate(texts):
        codes[i, : len(t)] = np.frombuffer(t.encode("utf-32-le"), dtype=np.uint32)
    dist = np.ones((n, n))
    for i in range(n):
        both = np.minimum(size, size[i])
        same = np.cumsum(codes[:, : size[i]] == codes[i, : size[i]], axis=1)
        at = np.flatnonzero(both)
        if size[i] and len(at):
            dist[i, at] = 1 - same[at, both[at] - 1] / both[at]
    return dist


def identity_linkage(rows: DataFrame, part: str, id_col: str, text: str, most: int = 10, per: int = 5) -> DataFrame:
    """``part, id, cluster`` by average linkage on 1 - identity of the aligned beginnings, into
    ``max(2, min(most, n // per))`` clusters a part, each named after its smallest id.

    Null parts, ids and texts are left out.  A part of n rows takes 8 n^2 bytes in one task."""
    kind = rows.schema[id_col].dataType.simpleString()
    src = rows.select(F.col(part).cast("string").alias("part"), F.col(id_col).alias("id"), F.col(text).alias("txt")).dropna()

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("id")
        first = pdf["id"].to_numpy()[_linkage(_identity_distance(pdf["txt"].tolist()), max(2, min(most, len(pdf) // per)))]
        return pd.DataFrame({"part": pdf["part"], "id": pdf["id"], "cluster": first})

    return src.groupBy("part").applyInPandas(run, f"part string, id {kind}, cluster {kind}")


def linked_clusters(rows: DataFrame, id_col: str, text: str, k: int, least: float) -> DataFrame:
    """``id, cluster`` by similarity edges and connected components: clusters at any scale."""
    r = rows.select(F.col(id_col).alias("id"), F.lit("all").alias("part"), F.col(text).alias("txt"))
    texts, members = text_classes(r, k)
    edges = near_texts(texts, k, least).select(F.col("uid_a").alias("u"), F.col("uid_b").alias("v"))
    if dict(edges.dtypes)["u"] in ("int", "bigint"):
        edges = edges.mapInArrow(forest(), edges.schema)
    comp = components(edges)
    named = members.join(comp.withColumnRenamed("node", "uid"), "uid", "left").select("id", F.coalesce("comp", "uid").alias("cluster"))
    return r.select("id").join(named, "id", "left").select("id", F.coalesce("cluster", "id").alias("cluster"))


def cluster_splits(clusters: DataFrame, seed: int, shares: tuple[float, float, float] = (0.70, 0.15, 0.15)) -> DataFrame:
    """Whole clusters by seeded rank: the first 70 % of the clusters train, then val, then test."""
    clusters = cut(clusters)  # ranked, counted and joined
    ids = clusters.select("cluster").distinct().withColumn("_h", seeded(seed, "cluster"))
    from .ordinals import with_ordinal

    ranked = with_ordinal(ids, ["_h", "cluster"], "_i")
    n = ranked.count()
    a, b = int(n * shares[0]), int(n * round(shares[0] + shares[1], 9))
    split = F.when(F.col("_i") < a, "train").when(F.col("_i") < b, "val").otherwise("test")
    return clusters.join(ranked.select("cluster", split.alias("split")), "cluster")


def round_robin_splits(clusters: DataFrame, pattern: tuple[str, ...] = ("train", "val", "train", "test", "train"), least: int = 1) -> DataFrame:
    """Whole clusters in turn to the splits of the pattern (60/20/20), the largest first; clusters
    under ``least`` rows are left out.  Clusters are never divided for balance."""
    from .ordinals import with_ordinal

    clusters = cut(clusters)  # ranked and joined
    sizes = clusters.groupBy("cluster").agg((-F.count("*")).alias("_m")).filter(-F.col("_m") >= least)
    ranked = with_ordinal(sizes, ["_m", "cluster"], "_i")
    split = F.get(F.lit(list(pattern)), F.pmod("_i", F.lit(len(pattern))).cast("int"))
    return clusters.join(ranked.select("cluster", split.alias("split")), "cluster")


def leakage_audit(rows: DataFrame, k: int = 5, least: float = 0.8) -> DataFrame:
    """Pairs of different splits with a k-mer Jaccard of ``least`` or more: exact, over all rows
    (``id, split, txt``; null splits take no part).

    Distinct texts are paired and their rows counted by split, so no pairs of rows are made."""
    r = rows.filter("split is not null")
    texts, members = text_classes(r.select("id", F.lit("all").alias("part"), "txt"), k)
    n = cut(members.join(r.select("id", "split").distinct(), "id").groupBy("uid", "split").agg(F.count("*").alias("n")))
    same = texts.select(F.col("uid").alias("uid_a"), F.col("uid").alias("uid_b"), F.lit(1.0).alias("jaccard"))
    sim = near_texts(texts, k, least).unionByName(same)
    both = sim.join(n.toDF("uid_a", "split_a", "n_a"), "uid_a").join(n.toDF("uid_b", "split_b", "n_b"), "uid_b")
    both = both.filter((F.col("split_a") < F.col("split_b")) | ((F.col("split_a") > F.col("split_b")) & (F.col("uid_a") != F.col("uid_b"))))
    pair = F.array_join(F.array_sort(F.array("split_a", "split_b")), "|")
    return both.groupBy(pair.alias("splits")).agg(F.sum(F.col("n_a") * F.col("n_b")).alias("n_pairs"), F.max("jaccard").alias("max_jaccard"))
