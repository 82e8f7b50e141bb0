"""Joins of events with series: windows around events, last state before, nearest mark."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewell.functions.columns import ratio, seconds

from .chronic import KEYS


def around_events(series: DataFrame, events: DataFrame, before_s: float, after_s: float, keys: list[str] | None = None) -> DataFrame:
    """Each sample with each event of its series that it lies within [-before_s, after_s] of.

    A range join by buckets as wide as the window: an event is sent to the two or three buckets its window
    meets, a sample to its own, so that the join is on equal keys and grows with its result.
    """
    keys = keys or KEYS
    width = float(before_s + after_s) or 1.0
    s = series.withColumn("s", seconds(F.col("t"))).withColumn("bucket", F.floor(F.col("s") / width))
    e = events.select(*keys, F.col("row_ord").alias("event"), seconds(F.col("t")).alias("event_s"))
    first, last = F.floor((F.col("event_s") - before_s) / width), F.floor((F.col("event_s") + after_s) / width)
    e = e.withColumn("bucket", F.explode(F.sequence(first, last)))
    near = F.col("s").between(F.col("event_s") - before_s, F.col("event_s") + after_s)
    return s.join(e, [*keys, "bucket"]).where(near).drop("bucket").withColumn("lag_s", F.col("s") - F.col("event_s"))


def event_aligned(
    series: DataFrame, events: DataFrame, before_min: int, after_min: int, bin_min: int, keys: list[str] | None = None, least_cover: float = 0.4, relative: bool = False
) -> DataFrame:
    """Median and quartiles over events of the series around them, by bins of time.

    The last sample of a bin stands for it. Events whose window has under least_cover of its bins are left
    out. relative: in percent of the median before the event.
    """
    keys = keys or KEYS
    x = around_events(series.where(F.col("lfp").isNotNull()), events, before_min * 60, after_min * 60, keys)
    x = x.withColumn("bin", F.floor((F.col("lag_s") / 60 + before_min) / bin_min + 0.5).cast("int"))
    cell = x.groupBy(*keys, "event", "bin").agg(F.max_by("lfp", F.struct("s", "row_ord")).alias("v"))
    bins = (before_min + after_min) // bin_min + 1
    trial = Window.partitionBy(*keys, "event")
    cell = cell.withColumn("k", F.count("*").over(trial)).where(F.col("k") >= least_cover * bins)
    if relative:
        base = cell.where(F.col("bin") * bin_min < before_min).groupBy(*keys, "event").agg(F.expr("percentile(v, 0.5)").alias("base"))
        cell = cell.join(base, [*keys, "event"]).withColumn("v", 100 * ratio(F.col("v"), F.col("base")))
    q = cell.groupBy(*keys, "bin").agg(F.count("v").alias("n_trials"), F.expr("percentile(v, array(0.25, 0.5, 0.75))").alias("q"))
    return q.select(*keys, (F.col("bin") * bin_min - before_min).alias("minute"), "n_trials", *[F.get("q", i).alias(c) for i, c in enumerate(("q1", "median", "q3"))])


def as_of(left: DataFrame, right: DataFrame, value: str, keys: list[str] | None = None, out: str = "as_of") -> DataFrame:
    """left with the last non-null `value` of right at or before its time; at equal times right comes first, then by row_ord.

    One sort by key and time over the union, no join. A series is one window partition; series are bounded by their
    device's life.
    """
    keys = keys or KEYS
    order = Window.partitionBy(*keys).orderBy("t", "_side", "row_ord").rowsBetween(Window.unboundedPreceding, 0)
    a = left.withColumns({"_side": F.lit(1), "_v": F.lit(None).cast(right.schema[value].dataType)})
    b = right.select(*keys, "t", "row_ord", F.lit(0).alias("_side"), F.col(value).alias("_v"))
    both = a.unionByName(b, allowMissingColumns=True)
    return both.withColumn(out, F.last("_v", ignorenulls=True).over(order)).where("_side = 1").drop("_side", "_v")


def nearest(left: DataFrame, marks: DataFrame, within_s: float, keys: list[str] | None = None) -> DataFrame:
    """left with the mark nearest in time, at most within_s away (`mark`, `mark_lag_s`; null without one); the earlier
    mark of two equally near ones."""
    keys = keys or KEYS
    near = around_events(left, marks, within_s, within_s, keys)
    best = near.groupBy(*keys, "row_ord").agg(F.min(F.struct(F.abs("lag_s").alias("d"), "event_s", "event", "lag_s")).alias("m"))
    best = best.select(*keys, "row_ord", F.col("m.event").alias("mark"), F.col("m.lag_s").alias("mark_lag_s"))
    return left.join(best, [*keys, "row_ord"], "left")


def dose_markers(events: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Events a day and their median distance within a day."""
    keys = keys or KEYS
    x = events.withColumns({"day": F.to_date("t"), "s": seconds(F.col("t"))})
    x = x.withColumn("apart", F.col("s") - F.lag("s").over(Window.partitionBy(*keys, "day").orderBy("s", "row_ord")))
    return x.groupBy(*keys).agg(F.count("*").alias("n"), ratio(F.count("*"), F.count_distinct("day")).alias("per_day"), F.expr("percentile(apart, 0.5)").alias("median_apart_s"))
