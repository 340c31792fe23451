"""Filling missing cells from records of the same entity, in order of time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Days of an entity's timeline that are looked at together.
SPAN_DAYS = 7


def time_fill(rows: DataFrame, row_id: Column, entity: Column, at: Column, value: Column, numeric: bool, gap_days: float | None = None) -> DataFrame:
    """``row_id, value, method, distance_s`` of each cell without value whose entity has one.

    ``value`` must be null where it is not usable.  Numerics between two observed times are
    interpolated (``interpolated``; distance to the nearer one), before the first or after the
    last they take that value (``carried_back``, ``carried_forward``).  Categories take the
    nearer observed value (ties: the earlier) within ``gap_days``; beyond it, and for rows
    without a time, the entity's most frequent value (``entity_mode``; numerics without a time:
    its mean, ``entity_mean``), with a null distance.  Several values of an entity at one time
    count as their mean, or as the most frequent one (ties: the smallest).

    Null entities fill nothing; rows with a null id are left out; repeated ids are each answered.
    A hot entity is no single task: equal times are aggregated first, then its timeline is cut
    into spans of ``SPAN_DAYS`` whose first and last values are carried from span to span.
    """
    base = rows.select(row_id.alias("row_id"), entity.alias("entity"), at.cast("timestamp").alias("at"), value.alias("value")).filter("entity is not null and row_id is not null")
    lacking = base.filter("value is null").select("row_id", "entity", "at")
    seen = base.filter("value is not null")
    pick = F.avg("value") if numeric else F.mode("value", True)
    points = seen.filter("at is not null").groupBy("entity", "at").agg(pick.alias("value"))
    asked = lacking.filter("at is not null").select("entity", "at").distinct()
    span = F.floor(F.unix_micros("at") / (SPAN_DAYS * 86_400_000_000)).cast("long")
    line = (
        points.withColumn("ask", F.lit(False))
        .unionByName(asked.withColumn("value", F.lit(None).cast(points.schema["value"].dataType)).withColumn("ask", F.lit(True)))
        .groupBy("entity", "at")
        .agg(F.max("value").alias("value"), F.max("ask").alias("ask"))
        .withColumn("span", span)
    )
    point = F.when(F.col("value").isNotNull(), F.struct("at", "value"))
    ends = line.groupBy("entity", "span").agg(F.min(point).alias("head"), F.max(point).alias("tail"))
    spans = Window.partitionBy("entity").orderBy("span")  # one row a span
    ends = ends.select(
        "entity",
        "span",
        F.last("tail", ignorenulls=True).over(spans.rowsBetween(Window.unboundedPreceding, -1)).alias("before_span"),
        F.first("head", ignorenulls=True).over(spans.rowsBetween(1, Window.unboundedFollowing)).alias("after_span"),
    )
    inside = Window.partitionBy("entity", "span").orderBy("at")
    near = (
        line.withColumn("p", point)
        .withColumn("prev", F.last("p", ignorenulls=True).over(inside.rowsBetween(Window.unboundedPreceding, 0)))
        .withColumn("next", F.first("p", ignorenulls=True).over(inside.rowsBetween(0, Window.unboundedFollowing)))
        .filter("ask")
        .join(ends, ["entity", "span"])
        .select("entity", "at", F.coalesce("prev", "before_span").alias("prev"), F.coalesce("next", "after_span").alias("next"))
    )
    whole = seen.groupBy("entity").agg(pick.alias("entity_value"))
    back = (F.unix_micros("at") - F.unix_micros("prev.at")) / 1e6
    ahead = (F.unix_micros("next.at") - F.unix_micros("at")) / 1e6
    out = lacking.join(whole, "entity").join(near, ["entity", "at"], "left")
    has_prev, has_next = F.col("prev").isNotNull(), F.col("next").isNotNull()
    nearest = F.least(back, ahead)
    if numeric:
        share = F.coalesce(F.try_divide(back, back + ahead), F.lit(0.0))
        between = F.col("prev.value") + (F.col("next.value") - F.col("prev.value")) * share
        got = F.when(has_prev & has_next, F.struct(between.alias("value"), F.lit("interpolated").alias("method"), nearest.alias("distance_s")))
        far = F.struct(F.col("entity_value").alias("value"), F.lit("entity_mean").alias("method"), F.lit(None).cast("double").alias("distance_s"))
        near_enough = F.lit(True)
    else:
        got = None
        far = F.struct(F.col("entity_value").alias("value"), F.lit("entity_mode").alias("method"), F.lit(None).cast("double").alias("distance_s"))
        near_enough = nearest <= gap_days * 86_400 if gap_days is not None else F.lit(True)
    forward = F.struct(F.col("prev.value").alias("value"), F.lit("carried_forward").alias("method"), back.alias("distance_s"))
    backward = F.struct(F.col("next.value").alias("value"), F.lit("carried_back").alias("method"), ahead.alias("distance_s"))
    carry = F.when(near_enough & has_prev & (~has_next | (back <= ahead)), forward).when(near_enough & has_next, backward).otherwise(far)
    chosen = carry if got is None else F.coalesce(got, carry)
    return out.withColumn("x", chosen).select("row_id", "x.value", "x.method", "x.distance_s")
