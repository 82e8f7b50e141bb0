"""Two states of a series by its level, their episodes, and the merging of short ones, for series of any length.

Centres of the two levels come from rounds of sums for all series at once. From there on a series is its runs of one state:
runs shorter than the least duration take the state before them round by round, and each round is one pass over runs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewell.functions.columns import ratio, seconds
from tidewell.sources.shared import stored

from .chronic import KEYS
from .ranges import by_ranges, filled, runs

#: The least number of samples, the most rounds of centres, the step at which they stand still.
LEAST, TURNS, STILL = 8, 60, 1e-9
#: Rounds that one plan holds.
AT_ONCE = 6


def two_levels(series: DataFrame, keys: list[str] | None = None, value: str = "lfp") -> DataFrame:
    """(keys, n, low, high): centres of two clusters on the line, from the quartiles on; a value as near to both is low. Series of under
    eight samples, or with equal quartiles, are left out. Rounds of sums for all series that still move, AT_ONCE of them to a table."""
    keys = keys or KEYS
    x = stored(series.where(F.col(value).isNotNull()).select(*keys, F.col(value).alias("v")), "values")
    q = x.groupBy(*keys).agg(F.count("*").alias("n"), F.expr("percentile(v, array(0.25, 0.75))").alias("q"))
    moving = q.where(F.col("n") >= LEAST).select(*keys, "n", F.get("q", 0).alias("low"), F.get("q", 1).alias("high")).where("high > low")
    moving = stored(moving, "levels")
    is_low = F.abs(F.col("v") - F.col("low")) <= F.abs(F.col("v") - F.col("high"))
    out = None
    for last in range(AT_ONCE, TURNS + 1, AT_ONCE):
        for _ in range(AT_ONCE):
            means = x.join(moving, keys).groupBy(*keys, "n", "low", "high").agg(F.avg(F.when(is_low, F.col("v"))).alias("_low"), F.avg(F.when(~is_low, F.col("v"))).alias("_high"))
            to_low, to_high = F.coalesce("_low", "low"), F.coalesce("_high", "high")
            moves = (F.abs(to_low - F.col("low")) >= STILL) | (F.abs(to_high - F.col("high")) >= STILL)
            moving = means.select(*keys, "n", to_low.alias("low"), to_high.alias("high"), moves.alias("moves"))
        moving = stored(moving, "levels")
        done = moving if last == TURNS else moving.where("not moves")
        out = done if out is None else out.unionByName(done)
        moving = moving.where("moves")
        if moving.isEmpty():
            break
        moving = moving.drop("moves")
    return out.drop("moves")


def merge_short(found: DataFrame, keys: list[str], least_s: float) -> DataFrame:
    """Runs (keys, run, state, from_s, to_s, n, total) after short ones took the state before them.

    In a round every run under least_s goes to the last longer run before it, and those before the first longer one take the
    state of the second run; runs of equal states then become one. A run's duration is the time between its first and last sample.
    Rounds end when none changes a state; a series of one run stays.
    """
    now = stored(found, "runs")
    while True:
        ranged = by_ranges(now, keys, ["run"])
        short = F.col("to_s") - F.col("from_s") < least_s
        second = now.groupBy(*keys).agg(F.max(F.when(F.col("run") == 2, F.col("state"))).alias("_second"))
        to = filled(ranged, keys, ["run"], F.when(~short, F.col("state")), "_long").join(second, keys)
        to = stored(to.withColumn("_to", F.coalesce("_long", "_second", "state")).drop("_long", "_second"), "runs")
        if to.where("_to <> state").isEmpty():
            return now
        again = runs(to, keys, ["run"], F.col("_to"), "_run")
        merged = again.groupBy(*keys, "_run").agg(
            F.first("_to").alias("state"), F.min("from_s").alias("from_s"), F.max("to_s").alias("to_s"), F.sum("n").alias("n"), F.sum("total").alias("total")
        )
        now = stored(merged.withColumnRenamed("_run", "run"), "runs")


def state_episodes(series: DataFrame, levels: DataFrame, keys: list[str] | None = None, least_s: float = 0.0, parts: int | None = None) -> DataFrame:
    """(keys, run, state, from_s, to_s, n, total) of the episodes above (high) and up to (low) the middle of the levels."""
    keys = keys or KEYS
    x = series.where("lfp is not null").select(*keys, "t", "row_ord", "lfp").join(levels.select(*keys, ((F.col("low") + F.col("high")) / 2).alias("middle")), keys)
    x = x.withColumns({"state": F.when(F.col("lfp") > F.col("middle"), "high").otherwise("low"), "s": seconds(F.col("t"))})
    x = runs(by_ranges(x, keys, ["t", "row_ord"], parts), keys, ["t", "row_ord"], F.col("state"))
    found = x.groupBy(*keys, "run").agg(F.first("state").alias("state"), F.min("s").alias("from_s"), F.max("s").alias("to_s"), F.count("*").alias("n"), F.sum("lfp").alias("total"))
    return merge_short(found, keys, least_s) if least_s > 0 else found


def detect_states(series: DataFrame, keys: list[str] | None = None, least_s: float = 0.0) -> DataFrame:
    """(keys, n, low, high, threshold, separation, off_fraction, n_off, n_on, mean_off_s, mean_on_s): the two levels, how far they lie
    apart in pooled deviations, and the episodes of the high (off) and the low (on) state after the merging of short ones.
    Episodes of a single sample have no duration and don't count in the means."""
    keys = keys or KEYS
    levels = stored(two_levels(series, keys), "levels")
    x = series.where("lfp is not null").join(levels, keys)
    above = F.col("lfp") > (F.col("low") + F.col("high")) / 2
    inner = lambda c, name: [F.count_if(c).alias(f"n_{name}"), F.var_samp(F.when(c, F.col("lfp"))).alias(f"v_{name}")]
    spread = x.groupBy(*keys).agg(*inner(~above, "a"), *inner(above, "b"))
    weight = lambda c: F.greatest(F.lit(1), F.col(f"n_{c}") - 1) * F.coalesce(f"v_{c}", F.lit(0.0))
    pooled = F.sqrt((weight("a") + weight("b")) / F.greatest(F.lit(1), F.col("n_a") + F.col("n_b") - 2))
    ep = state_episodes(series, levels, keys, least_s).withColumn("dur", F.col("to_s") - F.col("from_s"))
    off = F.col("state") == "high"
    mean = lambda c: F.avg(F.when(c & (F.col("dur") > 0), F.col("dur")))
    counts = ep.groupBy(*keys).agg(ratio(F.sum(F.when(off, F.col("n")).otherwise(0)), F.sum("n")).alias("off_fraction"), F.count_if(off).alias("n_off"), F.count_if(~off).alias("n_on"), mean(off).alias("mean_off_s"), mean(~off).alias("mean_on_s"))
    out = levels.join(spread.select(*keys, pooled.alias("pooled")), keys).join(counts, keys)
    return out.select(*keys, "n", "low", "high", ((F.col("low") + F.col("high")) / 2).alias("threshold"), ratio(F.col("high") - F.col("low"), F.col("pooled")).alias("separation"), "off_fraction", "n_off", "n_on", "mean_off_s", "mean_on_s")
