"""Tracks of irregular samples (track, t, value) read at other times, by an as-of join in buckets of time.

Samples and wanted times of a track meet in buckets; each bucket also knows the last sample before it and the first after it,
from one row for each bucket. So no task holds a track, however long, and nothing is joined by inequality.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def resample(samples: DataFrame, times: DataFrame, width: int) -> DataFrame:
    """(track, t, before, after, value): for each wanted time (track, t) the samples at or before and at or after it (t, value), and
    the value between them in proportion; before the first sample and after the last, the value of that one. Of samples at one time
    the greatest value counts. width: of a bucket, in the units of t (long)."""
    bucket = F.floor(F.col("t") / width)
    s = samples.where("t is not null and value is not null").groupBy("track", "t").agg(F.max("value").alias("value")).withColumn("bucket", bucket)
    w = times.select("track", "t").where("t is not null").distinct().withColumn("bucket", bucket)
    point = F.struct("t", "value")
    ends = s.groupBy("track", "bucket").agg(F.min(point).alias("first"), F.max(point).alias("last"))
    # a row for each bucket in which a track has anything
    every = w.select("track", "bucket").distinct().join(ends, ["track", "bucket"], "full")
    order = Window.partitionBy("track").orderBy("bucket")
    around = every.select("track", "bucket", F.last("last", True).over(order.rowsBetween(Window.unboundedPreceding, -1)).alias("earlier"), F.first("first", True).over(order.rowsBetween(1, Window.unboundedFollowing)).alias("later"))
    both = s.select("track", "bucket", "t", point.alias("point"), F.lit(0).alias("asked")).unionAll(w.select("track", "bucket", "t", F.lit(None).cast("struct<t:bigint,value:double>").alias("point"), F.lit(1).alias("asked")))
    inner = Window.partitionBy("track", "bucket").orderBy("t", "asked")
    outer = Window.partitionBy("track", "bucket").orderBy(F.desc("t"), "asked")
    met = both.withColumns({"before": F.last("point", True).over(inner), "after": F.last("point", True).over(outer)}).where("asked = 1")
    met = met.join(around, ["track", "bucket"], "left").select("track", "t", F.coalesce("before", "earlier").alias("before"), F.coalesce("after", "later").alias("after"))
    a, b = F.col("before"), F.col("after")
    share = (F.col("t") - a["t"]) / (b["t"] - a["t"])
    value = F.when(a.isNull(), b["value"]).when(b.isNull() | (a["t"] == b["t"]), a["value"]).otherwise(a["value"] + (b["value"] - a["value"]) * share)
    return met.select("track", "t", a.alias("before"), b.alias("after"), value.alias("value"))


def dominant(weights: DataFrame) -> DataFrame:
    """(track, t, unit): the unit with the largest weight of each frame (track, t, unit, weight); of several the first."""
    return weights.groupBy("track", "t").agg(F.max_by("unit", F.struct("weight", -F.col("unit"))).alias("unit"))
