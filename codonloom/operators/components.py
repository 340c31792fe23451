"""Connected components by alternating large-star and small-star rounds on DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.lineage import cut, release


def star_edges(membership: DataFrame, node: str, keys: list[str]) -> DataFrame:
    """``(u, v)`` with u > v: each node tied to the smallest node that shares a key with it.

    A key held by a third of all rows yields one edge a row; no group is collected and no pairs
    are made.  Rows with a null node or key tie nothing.
    """
    rows = membership.select(node, *keys).dropna()
    least = rows.groupBy(*keys).agg(F.min(node).alias("v"), F.max(node).alias("top")).filter("v < top").drop("top")
    return rows.join(least, keys).select(F.col(node).alias("u"), "v").filter("u > v").distinct()


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """``(node, comp)`` of every node named in ``edges(u, v)``; comp is the smallest node.

    Self loops, repeated and reversed edges are allowed; nulls are dropped; no edges give no
    rows.  Each round is written to the checkpoint folder; rounds grow with the logarithm of the
    longest path.
    """
    e = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).dropna()
    e = cut(e.filter("u > v").distinct())
    last = None
    for _ in range(max_rounds):
        state = e.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if last == (state["n"], state["h"]) or state["n"] == 0:
            break
        last = (state["n"], state["h"])
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("m", "u"))
        large = both.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low2 = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low2, "u").select(F.explode(F.array(F.struct(F.col("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("x"))
        e = cut(small.select("x.u", "x.v").filter("u > v").distinct())
        del both, low, large, low2, small
        release(e.sparkSession)  # the round's shuffles and the edges before it
    else:
        raise RuntimeError(f"components not settled after {max_rounds} rounds")
    roots = e.select(F.col("v").alias("node")).distinct().withColumn("comp", F.col("node"))
    return e.select(F.col("u").alias("node"), F.col("v").alias("comp")).unionByName(roots)


def follow_pointers(pointers: DataFrame, max_rounds: int = 40) -> DataFrame:
    """``(node, root)`` from ``(node, parent)`` where a root is its own parent (doubling)."""
    p = cut(pointers.select("node", F.col("parent").alias("root")))
    for _ in range(max_rounds):
        up = p.select(F.col("node").alias("root"), F.col("root").alias("next"))
        nxt = cut(p.join(up, "root").select("node", F.col("next").alias("root"), (F.col("next") != F.col("root")).alias("moved")))
        moved = nxt.filter("moved").limit(1).count()
        p = nxt.drop("moved")
        if not moved:
            return p
    raise RuntimeError("pointers not settled")
