"""Permutation test of contiguous differences between two paired curves.

The unit of inference is a run of neighbouring points whose t is over a threshold with one sign. Its mass, the sum of t,
is held against the greatest mass of each permutation, in which the signs of whole trials are drawn anew. A run that
stands out says that there is a difference somewhere in it, not at each of its points.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def drawn_sign(draw: Column, trial: Column) -> Column:
    """1 or -1 by a multiplicative hash of draw and trial; draw 0 is the observation itself and keeps all signs."""
    h = (draw * 7919 + trial * 104729 + 12345) % 2147483647
    h = (h * 48271) % 2147483647
    h = (h * 48271) % 2147483647
    return F.when((draw > 0) & (F.floor(h / 65536) % 2 == 1), -1.0).otherwise(1.0)


def _masses(stats: DataFrame, keys: list[str], threshold: float) -> DataFrame:
    """(keys, draw, first, last, mass): runs of neighbouring points of stats (keys, draw, point, t) over the threshold."""
    over = stats.where(F.abs("t") >= threshold).withColumn("s", F.signum("t"))
    w = Window.partitionBy(*keys, "draw", "s").orderBy("point")
    run = over.withColumn("run", F.col("point") - F.row_number().over(w))
    return run.groupBy(*keys, "draw", "s", "run").agg(F.min("point").alias("first"), F.max("point").alias("last"), F.sum("t").alias("mass"))


def cluster_test(pairs: DataFrame, keys: list[str], draws: int = 2000, threshold: float = 2.0) -> DataFrame:
    """(keys, first, last, mass, p) of each run of pairs (keys, trial, point, d): d is the difference of a trial at a point.

    Each difference meets every draw once, as a row of two numbers that aggregate before the shuffle; what is shuffled is
    one row for each key, draw and point of each task. Points are whole numbers; a point with under two
    trials or without spread ends a run. Series without a run give no row.
    """
    x = pairs.where("d is not null").select(*keys, "trial", "point", "d")
    dealt = x.select(*keys, "trial", "point", "d", F.explode(F.sequence(F.lit(0), F.lit(draws))).alias("draw"))
    signed = drawn_sign(F.col("draw").cast("long"), F.col("trial").cast("long")) * F.col("d")
    m = dealt.groupBy(*keys, "draw", "point").agg(F.count("*").alias("n"), F.sum(signed).alias("s"), F.sum(F.col("d") ** 2).alias("q"))
    mean = F.col("s") / F.col("n")
    spread = (F.col("q") - F.col("n") * mean * mean) / (F.col("n") - 1)
    m = m.where("n >= 2").withColumn("t", F.when(spread > 1e-12 * F.col("q"), mean / F.sqrt(spread / F.col("n"))))
    runs = _masses(m, keys, threshold)
    found = runs.where("draw = 0").select(*keys, "first", "last", "mass")
    null = runs.where("draw > 0").groupBy(*keys, "draw").agg(F.max(F.abs("mass")).alias("most"))
    same = [found[k].eqNullSafe(null[k]) for k in keys]
    beyond = found.join(null, [*same, null["most"] >= F.abs(found["mass"]) - 1e-9], "left")
    out = beyond.groupBy(*[found[k].alias(k) for k in keys], "first", "last", "mass").agg(F.count("most").alias("k"))
    return out.select(*keys, "first", "last", "mass", ((F.col("k") + 1) / (draws + 1)).alias("p"))
