"""Global ordinals without a single-task window."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.lineage import cut


def with_ordinal(rows: DataFrame, order: list[str], name: str) -> DataFrame:
    """``rows`` with a 0-based position in the given order.

    Rows are range-partitioned and ranked inside their partition; the partitions' sizes (one row
    each) give the offsets.  Ties take any order; nulls come first.  The sorted table is
    checkpointed, so that a lost executor cannot change the partitions between the two passes."""
    spark = rows.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    placed = cut(rows.repartitionByRange(parts, *order).withColumn("_p", F.spark_partition_id()))
    sizes = placed.groupBy("_p").agg(F.count("*").alias("_n"))
    offsets = sizes.withColumn("_o", F.coalesce(F.sum("_n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_n")  # one row a partition
    inside = F.row_number().over(Window.partitionBy("_p").orderBy(*order)) - 1
    return placed.withColumn("_r", inside).join(F.broadcast(offsets), "_p").withColumn(name, F.col("_r") + F.col("_o")).drop("_p", "_r", "_o")


def running_sum(rows: DataFrame, part: list[str], order: list[str], value: str, name: str) -> DataFrame:
    """``rows`` with the running sum of ``value`` in each part up to and with the row, in the given
    order (which must tell the rows of a part apart).

    Like :func:`with_ordinal`: rows are range-partitioned by part and order, summed inside their
    partition, and the partitions' sums (one row a part and partition) give the offsets, so a part
    that holds all rows is no single task."""
    spark = rows.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    placed = cut(rows.repartitionByRange(parts, *part, *order).withColumn("_p", F.spark_partition_id()))
    sums = placed.groupBy(*part, "_p").agg(F.sum(value).alias("_v"))
    before = Window.partitionBy(*part, F.lit(0)).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)  # one row a partition
    offsets = sums.withColumn("_o", F.coalesce(F.sum("_v").over(before), F.lit(0))).drop("_v")
    inside = F.sum(value).over(Window.partitionBy(*part, "_p").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    return placed.withColumn("_i", inside).join(F.broadcast(offsets) if not part else offsets, [*part, "_p"]).withColumn(name, F.col("_i") + F.col("_o")).drop("_p", "_i", "_o")
