"""Exact k-mer Jaccard joins: texts meet in blocks, k-mers are made where they meet."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ..plans.lineage import cut, release
from .kmer_join import BUCKET_BITS, NARROW, cell_join, counter, order_of, pack, pack_join

#: Rows of a text that one task meets with the rows of another.
MET = 2000
#: Letters of a block, which bounds a task's memory, and letters of a part below which it is no
#: use to divide it among the cores.
BLOCK_LETTERS, EVEN_LETTERS = 16_000_000, 250_000
#: Letters of a part above which its blocks are not copied to their cells but packed and crossed.
CROSS_LETTERS = 4_000_000


def text_classes(rows: DataFrame, k: int) -> tuple[DataFrame, DataFrame]:
    """``part, uid, txt`` of the distinct texts of each part with k letters or more, named after
    the smallest id, and the ``uid, id`` of their rows.  Null parts, ids and texts are left out."""
    keyed = rows.select("id", "part", "txt").dropna().filter(F.length("txt") >= k).withColumn("key", F.unhex(F.sha2("txt", 256)))
    texts = cut(keyed.groupBy("part", "key").agg(F.min("id").alias("uid"), F.any_value("txt").alias("txt")))
    members = keyed.select("id", "part", "key").join(texts.select("part", "key", "uid"), ["part", "key"]).select("uid", "id", "part").distinct()
    return texts.select("part", "uid", "txt"), members


def near_texts(texts: DataFrame, k: int, least: float) -> DataFrame:
    """``part, uid_a, uid_b, jaccard`` of texts (``part, uid, txt``, uid unique in its part) of a
    part whose k-mer sets have a Jaccard index of at least ``least``, each pair once.

    A text travels to the cells where it can have partners: small parts share a cell, a large part
    is cut into blocks and each two blocks are a cell, so a text is copied once for each block of
    its part and no k-mer leaves its task.  The blocks of a part that is larger still are packed
    and written once (:func:`_crossed`), so its disk does not grow with their number."""
    spark = texts.sparkSession
    cores = spark.sparkContext.defaultParallelism
    texts = texts.select(F.col("part").cast("string").alias("part"), "uid", "txt")
    sizes = cut(texts.groupBy("part").agg(F.sum(F.length("txt")).alias("n"), F.max(F.col("txt").rlike("[^A-Z]")).alias("odd")))
    total, odd = sizes.agg(F.coalesce(F.sum("n"), F.lit(0)), F.max("odd")).first()
    narrow = k <= NARROW and not odd
    even = next(i for i in range(1, cores + 2) if i * (i + 1) // 2 >= cores)
    least_letters = min(BLOCK_LETTERS, max(EVEN_LETTERS, total // (2 * cores)))
    bins = max(4 * cores, math.ceil(4 * total / BLOCK_LETTERS))
    large, crossed, cells = [], [], bins
    for r in sizes.filter(F.col("n") > least_letters).collect():  # at most one for each block and two for each core
        blocks = max(math.ceil(r["n"] / BLOCK_LETTERS), min(even, math.ceil(r["n"] / EVEN_LETTERS)))
        if r["n"] > min(CROSS_LETTERS, BLOCK_LETTERS):
            crossed.append((r["part"], blocks))
            continue
        large.append((r["part"], blocks, cells))
        cells += blocks * blocks
    seen = texts.select("txt").mapInArrow(counter(k, narrow), "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect()  # one row a bucket
    counts = np.zeros(1 << BUCKET_BITS, dtype=np.int64)
    for r in seen:
        counts[r["bucket"]] = r["n"]
    turn = order_of(counts, narrow)
    kind = texts.schema["uid"].dataType
    schema = pa.schema([("uid_a", to_arrow_type(kind)), ("uid_b", to_arrow_type(kind)), ("jaccard", pa.float64())])
    ddl = f"uid_a {kind.simpleString()}, uid_b {kind.simpleString()}, jaccard double"
    far = [_crossed(texts.filter(F.col("part") == part), blocks, k, least, turn, schema, ddl) for part, blocks in crossed]
    if crossed:
        texts = texts.filter(~F.col("part").isin([part for part, _ in crossed]))
    # a large part's blocks i <= j meet in the cell first + i * blocks + j
    i, n, first = F.pmod(F.xxhash64("uid"), "blocks").cast("int"), F.col("blocks"), F.col("first")
    small = F.array(F.struct(F.pmod(F.xxhash64("part"), F.lit(bins)).cast("int").alias("cell"), F.lit(2).alias("side")))
    if large:
        rows = texts.join(F.broadcast(spark.createDataFrame(large, "part string, blocks int, first int")), "part", "left")
        met = F.transform(F.sequence(F.lit(0), n - 1), lambda j: F.struct((first + F.least(i, j) * n + F.greatest(i, j)).cast("int").alias("cell"), F.when(i == j, 2).when(i < j, 0).otherwise(1).alias("side")))
        rows = rows.withColumn("x", F.explode(F.when(n.isNull(), small).otherwise(met)))
    else:
        rows = texts.withColumn("x", F.explode(small))
    parts = min(cells, max(4 * cores, int(spark.conf.get("spark.sql.shuffle.partitions"))))
    near = (
        rows.select("x.cell", "x.side", "part", "uid", "txt")
        .repartitionById(parts, F.pmod(F.xxhash64("cell"), F.lit(parts)).cast("int"))
        .sortWithinPartitions("cell", "side")
        .mapInArrow(cell_join(k, least, turn, schema), ddl)
    )
    for pairs in far:
        near = near.unionByName(pairs)
    return near


def _crossed(texts: DataFrame, blocks: int, k: int, least: float, turn: np.ndarray, schema: pa.Schema, ddl: str) -> DataFrame:
    """The pairs of one part: each block becomes a row of packed texts in a partition of its own,
    and the blocks i <= j meet in a Cartesian product that reads them from the checkpoint."""
    block = F.pmod(F.xxhash64("uid"), F.lit(blocks)).cast("int")
    packs = cut(texts.select(block.alias("block"), "part", "uid", "txt").repartitionById(blocks, F.col("block")).mapInArrow(pack, "block int, texts binary"))
    release(texts.sparkSession)
    a, b = packs.toDF("block_a", "a"), packs.toDF("block_b", "b")
    met = a.hint("shuffle_replicate_nl").join(b, F.col("block_a") <= F.col("block_b"))
    return met.mapInArrow(pack_join(k, least, turn, schema), ddl)


def kmer_jaccard(rows: DataFrame, k: int, least: float) -> DataFrame:
    """``id_a < id_b, jaccard`` of rows (``id, part, txt``) of the same part whose k-mer sets have
    a Jaccard index of at least ``least`` (above 0).

    Distinct texts are joined (:func:`near_texts`) and then take their rows.  Null parts, ids and
    texts, and texts shorter than k, are in no pair."""
    texts, members = text_classes(rows, k)
    near = near_texts(texts, k, least)
    if least <= 1:
        near = near.unionByName(texts.select(F.col("uid").alias("uid_a"), F.col("uid").alias("uid_b"), F.lit(1.0).alias("jaccard")))
    # the rows of a hot text are dealt to parts
    deals = members.groupBy("uid").agg(F.ceil(F.count("*") / MET).cast("int").alias("deals"))
    dealt = members.join(deals, "uid").withColumn("deal", F.pmod(F.xxhash64("id"), "deals").cast("int"))
    pairs = near
    for s in "ab":
        pairs = pairs.join(deals.toDF(f"uid_{s}", "deals"), f"uid_{s}").withColumn(f"deal_{s}", F.explode(F.sequence(F.lit(0), F.col("deals") - 1))).drop("deals")
    for s, x in zip("ab", "xy", strict=True):
        pairs = pairs.join(dealt.select(F.col("uid").alias(f"uid_{s}"), F.col("deal").alias(f"deal_{s}"), F.col("id").alias(x)), [f"uid_{s}", f"deal_{s}"])
    one = (F.col("uid_a") != F.col("uid_b")) | (F.col("x") < F.col("y"))
    return pairs.filter(one & (F.col("x") != F.col("y"))).select(F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b"), "jaccard")
