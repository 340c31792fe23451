"""Train, validation and test splits that keep related rows together."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.hosts import HOST_NAMES, host_key
from ..functions.text_norm import protein_key
from ..plans.lineage import cut
from ..operators.components import components, star_edges

#: Tied sets with more than 1/BIG of all rows are classes of their own: fewer than BIG exist.
BIG = 1000
#: Sets of up to SMALL rows share a class if their label vectors are equal, larger ones if they
#: hold the same labels and sizes within STEP: under ten thousand classes whatever the table.
SMALL = 8
STEP = 1.25
SALTS = 64
SPLITS = {"train": 0.70, "val": 0.15, "test": 0.15}


def tied_sets(groups: DataFrame, clusters: DataFrame) -> DataFrame:
    """``(group_no, tied)``: every group with the smallest ``group_no`` of its tied set.

    Two groups are tied by an equal protein (case, white space and ``*`` aside), by the same own
    ``cluster_id``, or by a cluster that is one group's own and names the other (or names both)
    in ``protein_groups``; ties pass on.  Null proteins, null cluster ids, null or unknown ids in
    the lists and a null list tie nothing; repeated entries tie once.  A group without ties is its
    own set; rows with a null ``group_no`` are left out.  Empty tables are allowed.
    """
    rows = groups.select(F.col("group_no").cast("long").alias("group_no"), "group_id", "cluster_id", protein_key("protein_aa").alias("txt")).filter("group_no is not null")
    by_text = rows.select("group_no", F.lit("p").alias("what"), F.sha2("txt", 256).alias("key"))
    by_own = rows.select("group_no", F.lit("c").alias("what"), F.col("cluster_id").cast("string").alias("key"))
    named = clusters.filter("cluster_id is not null").select(F.col("cluster_id").cast("string").alias("key"), F.explode("protein_groups").alias("group_id")).dropna().distinct()
    by_list = rows.select("group_no", "group_id").join(named, "group_id").select("group_no", F.lit("c").alias("what"), "key")
    edges = star_edges(by_text.unionByName(by_own).unionByName(by_list), "group_no", ["what", "key"])
    comps = components(edges).select(F.col("node").alias("group_no"), F.col("comp").alias("tied"))
    return rows.select("group_no").distinct().join(comps, "group_no", "left").select("group_no", F.coalesce("tied", "group_no").alias("tied"))


def _quotas(classes: list[tuple[str, int, list[float]]], splits: dict[str, float]) -> dict[str, dict[str, int]]:
    """How many tied sets of each class go to each split: grouped iterative stratification.

    classes: (class, its sets, rows by label of all of them).  The label with the fewest rows
    outstanding goes first, its classes with the largest sets first; the sets of a class go to
    the splits by how much of the label each still wants, what is left over singly to the split
    that then wants most (ties: wants most rows, then the order of the splits).
    """
    labels = len(classes[0][2]) if classes else 0
    left = [sum(v[i] for _, _, v in classes) for i in range(labels)]
    want = {s: [share * x for x in left] for s, share in splits.items()}
    spare = {s: share * sum(left) for s, share in splits.items()}
    out: dict[str, dict[str, int]] = {}
    while open_labels := [i for i in range(labels) if left[i] > 1e-9]:
        i = min(open_labels, key=lambda x: (left[x], x))
        mine = sorted((c for c in classes if c[2][i] > 0 and c[0] not in out), key=lambda c: (-c[2][i] / c[1], -sum(c[2]) / c[1], c[0]))
        for name, n, v in mine:
            each, size = v[i] / n, sum(v) / n
            need = {s: max(0.0, want[s][i]) for s in splits}
            every = sum(need.values())
            got = {s: int(n * need[s] / every) if every else 0 for s in splits}
            wait = {s: [want[s][i] - got[s] * each, spare[s] - got[s] * size] for s in splits}
            for _ in range(n - sum(got.values()) if every else 0):
                best = max(splits, key=lambda s: wait[s])
                got[best] += 1
                wait[best] = [wait[best][0] - each, wait[best][1] - size]
            if not every:  # rows above all shares
                got[max(splits, key=lambda s: wait[s])] = n
            for s in splits:
                want[s] = [w - got[s] * x / n for w, x in zip(want[s], v, strict=True)]
                spare[s] -= got[s] * size
            left = [x - y for x, y in zip(left, v, strict=True)]
            out[name] = got
        left[i] = 0.0
    return out


def grouped_split(groups: DataFrame, clusters: DataFrame, splits: dict[str, float] | None = None, seed: int = 7) -> DataFrame:
    """``(group_no, tied, host, split)``: whole tied sets placed by grouped iterative stratification.

    Labels are the hosts (any spelling; unknown or null hosts form a label of their own).  The
    label vectors of the tied sets are aggregated to classes of like sets, at most some thousands
    (see ``BIG`` and ``SMALL``); only they reach the driver, which gives each class its number of
    sets per split.  Within a class the sets are dealt by seeded hash.  The rule is the same at
    all sizes.  A set larger than a split's share makes that split exceed it: ties go before shares.
    Null ``group_no`` are left out; repeated rows count once; empty tables give an empty result.
    """
    splits = splits or SPLITS
    names = [*HOST_NAMES, "other"]
    tied = tied_sets(groups, clusters)
    hosts = groups.select(F.col("group_no").cast("long").alias("group_no"), F.coalesce(host_key("host"), F.lit("other")).alias("host")).groupBy("group_no").agg(F.min("host").alias("host"))
    rows = cut(tied.join(hosts, "group_no"))
    cols = [f"n{i}" for i in range(len(names))]
    sets = rows.groupBy("tied").agg(*[F.count_if(F.col("host") == n).alias(c) for n, c in zip(names, cols, strict=True)], F.count("*").alias("n"))
    n_rows = rows.count()
    mask = F.concat(*[(F.col(c) > 0).cast("int").cast("string") for c in cols])
    kind = (
        F.when(F.col("n") * BIG > n_rows, F.concat(F.lit("set "), F.col("tied").cast("string")))
        .when(F.col("n") <= SMALL, F.concat_ws(",", *cols))
        .otherwise(F.concat_ws(" ", mask, F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(STEP))).cast("string")))
    )
    h = F.xxhash64("tied", F.lit(seed))
    sets = cut(sets.select("tied", *cols, kind.alias("kind"), h.alias("h"), F.pmod(h, F.lit(SALTS)).alias("salt")))
    classes = sets.groupBy("kind").agg(F.count("*").alias("sets"), *[F.sum(c).alias(c) for c in cols]).collect()  # bounded, see above
    quotas = _quotas(sorted((r["kind"], r["sets"], [float(r[c]) for c in cols]) for r in classes), splits)
    ends, deals = dict.fromkeys(splits, 0), []
    for name, got in quotas.items():
        upto = 0
        for s in splits:
            upto += got[s]
            ends[s] = upto
        deals.append((name, *ends.values()))
    ddl = ", ".join(["kind string", *(f"upto{i} long" for i in range(len(splits)))])
    deal = F.broadcast(rows.sparkSession.createDataFrame(deals, ddl))
    before = Window.partitionBy("kind").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)  # one row a salt
    cells = sets.groupBy("kind", "salt").count().select("kind", "salt", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("before"))
    place = F.row_number().over(Window.partitionBy("kind", "salt").orderBy("h", "tied")) + F.col("before")
    split = F.coalesce(*[F.when(F.col("place") <= F.col(f"upto{i}"), F.lit(s)) for i, s in enumerate(splits)])
    dealt = sets.select("tied", "kind", "salt", "h").join(cells, ["kind", "salt"]).withColumn("place", place).join(deal, "kind").select("tied", split.alias("split"))
    return rows.join(dealt, "tied").select("group_no", "tied", "host", "split")
