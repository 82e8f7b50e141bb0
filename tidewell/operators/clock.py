"""Clocks: breaks of the local offset, offsets of each sample, stretches of one offset, and resampling to a uniform grid."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewell.functions.columns import local_day, local_hour

from .chronic import KEYS


def offset_candidates(series: DataFrame, keys: list[str] | None = None, offset: int = 0, days: int = 3, least_hours: float = 0.75) -> DataFrame:
    """(keys, day, delta_minutes): days whose mean hour on the clock, by medians of `days` = 3 days before and from it on,
    moves by at least `least_hours`. Series of fewer than 48 samples a day for 3 days, or 6 days, give none."""
    keys = keys or KEYS
    x = series.where("lfp is not null").select(*keys, local_day(F.col("t"), offset).alias("day"), (local_hour(F.col("t"), offset) * (2 * math.pi / 24)).alias("a"))
    d = x.groupBy(*keys, "day").agg(F.count("*").alias("n"), F.avg(F.cos("a")).alias("c"), F.avg(F.sin("a")).alias("s"))
    d = d.withColumn("hour", F.pmod(F.atan2("s", "c") * (24 / (2 * math.pi)) + 24, F.lit(24.0)))
    w = Window.partitionBy(*keys).orderBy("day")
    whole = Window.partitionBy(*keys)
    middle = lambda hours: F.get(F.array_sort(F.array(*hours)), F.lit(1))  # noqa: E731  of three
    d = d.withColumns({
        "before": middle([F.lag("hour", i).over(w) for i in (1, 2, 3)]), "after": middle(["hour", F.lead("hour", 1).over(w), F.lead("hour", 2).over(w)]),
        "k": F.row_number().over(w), "days": F.count("*").over(whole), "rows": F.sum("n").over(whole),
    })
    delta = F.pmod(F.col("after") - F.col("before") + 36, F.lit(24.0)) - 12
    d = d.where((F.col("rows") >= 48 * days) & (F.col("days") >= 2 * days) & (F.col("k") > days) & (F.col("k") <= F.col("days") - days)).withColumn("delta", delta)
    return d.where(F.abs("delta") >= least_hours).select(*keys, "day", F.floor(F.col("delta") * 60 + 0.5).cast("int").alias("delta_minutes"))


def offset_breaks(candidates: DataFrame, keys: list[str] | None = None, rest_days: int = 5) -> DataFrame:
    """Those candidates (day, delta_minutes) that lie more than `rest_days` after the last one kept. A fold over a series'
    candidates, of which there is one a day at most."""
    keys = keys or KEYS
    own = candidates.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("day", "delta_minutes"))).alias("all"))
    empty = F.filter("all", lambda x: F.lit(False))
    far = lambda kept, x: F.coalesce(F.datediff(x["day"], F.get(kept, F.size(kept) - 1)["day"]) > rest_days, F.lit(True))
    kept = F.aggregate("all", empty, lambda kept, x: F.when(far(kept, x), F.concat(kept, F.array(x))).otherwise(kept))
    return own.select(*keys, F.inline(kept))


def resolve_offsets(series: DataFrame, breaks: DataFrame, keys: list[str] | None = None, base: int = -180) -> DataFrame:
    """series (t, row_ord) with `offset_min`: the base and the deltas of all breaks (t, delta_minutes) at or before it."""
    keys = keys or KEYS
    w = Window.partitionBy(*keys).orderBy("_t", "_kind", "row_ord").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    both = series.withColumns({"_t": F.unix_micros("t"), "_kind": F.lit(1), "_d": F.lit(0)})
    marks = breaks.select(*keys, F.unix_micros("t").alias("_t"), F.lit(0).alias("_kind"), F.col("delta_minutes").cast("int").alias("_d"))
    both = both.unionByName(marks, allowMissingColumns=True).withColumn("offset_min", (F.sum("_d").over(w) + base).cast("long"))
    return both.where("_kind = 1").drop("_t", "_kind", "_d")


def offset_segments(resolved: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """(keys, segment, offset_min, n, from_s, to_s): stretches of one offset; circadian measures never go across two."""
    keys = keys or KEYS
    w = Window.partitionBy(*keys).orderBy("t", "row_ord")
    x = resolved.withColumn("_new", F.coalesce(F.col("offset_min") != F.lag("offset_min").over(w), F.lit(False)).cast("int"))
    x = x.withColumn("segment", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)).cast("long"))
    s = F.unix_micros("t") / 1e6
    return x.groupBy(*keys, "segment").agg(F.max("offset_min").alias("offset_min"), F.count("*").alias("n"), F.min(s).alias("from_s"), F.max(s).alias("to_s"))


def resample(series: DataFrame, step_s: float, most_gap_s: float | None = None, keys: list[str] | None = None, value: str = "lfp") -> DataFrame:
    """(keys, i, v): values at the first sample's time and every `step_s` after it, on the line between the samples around;
    null within gaps over `most_gap_s` (three steps). Each pair of neighbours makes its own points: no join."""
    keys = keys or KEYS
    step, most = int(step_s * 1e6), int((3 * step_s if most_gap_s is None else most_gap_s) * 1e6)
    w = Window.partitionBy(*keys).orderBy("a", "row_ord")
    x = series.where(F.col(value).isNotNull()).select(*keys, "row_ord", F.unix_micros("t").alias("a"), F.col(value).alias("y"))
    x = x.withColumns({"b": F.lead("a").over(w), "z": F.lead("y").over(w), "t0": F.min("a").over(Window.partitionBy(*keys)), "k": F.row_number().over(w), "n": F.count("*").over(Window.partitionBy(*keys))})
    first = F.when(F.col("k") == 1, F.lit(0).cast("long")).otherwise(F.expr(f"(a - t0) div {step} + 1"))
    x = x.where("n >= 4 and b is not null").withColumns({"lo": first, "hi": F.expr(f"(b - t0) div {step}")}).where("lo <= hi")
    x = x.withColumn("i", F.explode(F.sequence("lo", "hi")))
    at = F.col("t0") + F.col("i") * step
    v = F.when(F.col("b") - F.col("a") > most, F.lit(None)).when(F.col("b") == F.col("a"), F.col("y")).otherwise(F.col("y") + (F.col("z") - F.col("y")) * (at - F.col("a")) / (F.col("b") - F.col("a")))
    return x.select(*keys, "i", v.alias("v"))
