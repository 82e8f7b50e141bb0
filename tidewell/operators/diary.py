"""Diaries and day grids: states around the clock, conditions compared, signals on the same grid, cycles around doses."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewell.functions.columns import local_day, local_hour, ratio

from .chronic import KEYS
from .cohort import icc
from .ranges import with_group


def clock_profile(cells: DataFrame, by: list[str]) -> DataFrame:
    """(by, bin, state, n, percent): of the days with a state in a bin (cells: day, bin, state), the share of each state."""
    m = cells.where("state is not null").groupBy(*by, "bin", "state").agg(F.count("*").alias("k"))
    return m.withColumn("n", F.sum("k").over(Window.partitionBy(*by, "bin"))).select(*by, "bin", "state", "n", (100 * F.col("k") / F.col("n")).alias("percent"))


def peak_bin(profile: DataFrame, cells: DataFrame, by: list[str], state: str) -> DataFrame:
    """(by, bin, percent): where a state is most frequent (the first of equal bins), among bins of half the days, two at least."""
    days = cells.groupBy(*by).agg(F.count_distinct("day").alias("days"))
    x = profile.where(F.col("state") == state).join(days, by).where((F.col("n") >= 2) & (F.col("n") >= 0.5 * F.col("days")))
    return x.groupBy(*by).agg(F.max_by("bin", F.struct("percent", -F.col("bin"))).alias("bin"), F.max("percent").alias("percent"))


def compare_conditions(days: DataFrame, by: list[str]) -> DataFrame:
    """(by, first, last, n_first, n_last, delta, sem, low, high): the mean daily value of the last condition less that of the first, with
    the interval of the difference of unpaired means; null bounds under two days a side. days: (condition, value)."""
    m = days.groupBy(*by, "condition").agg(F.count("value").alias("n"), F.avg("value").alias("m"), F.var_samp("value").alias("v"))
    s = F.struct("condition", "n", "m", "v")
    x = m.groupBy(*by).agg(F.min_by(s, "condition").alias("a"), F.max_by(s, "condition").alias("b"), F.count("*").alias("k")).where("k >= 2")
    sem = F.when((F.col("a.n") > 1) & (F.col("b.n") > 1), F.sqrt(F.col("a.v") / F.col("a.n") + F.col("b.v") / F.col("b.n")))
    delta = F.col("b.m") - F.col("a.m")
    return x.select(*by, F.col("a.condition").alias("first"), F.col("b.condition").alias("last"), F.col("a.n").alias("n_first"), F.col("b.n").alias("n_last"), delta.alias("delta"), sem.alias("sem"), (delta - 1.96 * sem).alias("low"), (delta + 1.96 * sem).alias("high"))


def signal_grid(series: DataFrame, keys: list[str] | None = None, minutes: int = 30, quantile: float = 0.5, offset: int = 0) -> DataFrame:
    """(keys, day, bin, v, threshold, state): medians of each day and bin, high above a quantile of all of them, else low."""
    keys = keys or KEYS
    bins = 24 * 60 // minutes
    b = F.least(F.floor(local_hour(F.col("t"), offset) * 60 / minutes), F.lit(bins - 1)).cast("int")
    cell = series.where("lfp is not null").groupBy(*keys, local_day(F.col("t"), offset).alias("day"), b.alias("bin")).agg(F.median("lfp").alias("v"))
    limit = cell.groupBy(*keys).agg(F.percentile("v", F.lit(quantile)).alias("threshold"))
    return cell.join(limit, keys).withColumn("state", F.when(F.col("v") > F.col("threshold"), "high").otherwise("low"))


def grid_summary(grid: DataFrame, keys: list[str] | None = None, bins: int = 48) -> DataFrame:
    """(keys, n_days, n_filled, percent_missing, high_fraction) of a signal_grid()."""
    m = grid.groupBy(*(keys or KEYS)).agg(F.count_distinct("day").alias("n_days"), F.count("*").alias("n_filled"), F.count_if(F.col("state") == "high").alias("k"))
    return m.select(*(keys or KEYS), "n_days", "n_filled", (100 - 100 * F.col("n_filled") / (F.col("n_days") * bins)).alias("percent_missing"), (F.col("k") / F.col("n_filled")).alias("high_fraction"))


def dose_cycle(series: DataFrame, doses: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """(keys, n_doses, delta, passes): the mean of log10(lfp + 1) from 10 to 90 minutes after doses less that from 90 to 10 before, over
    the means of steps of 10 minutes, three of each side at least; it passes where it falls.

    Samples meet doses by hours of time: each dose, of which there are few, goes to the two hours before, of and after its own.
    """
    keys = keys or KEYS
    hour = 3_600_000_000
    s = series.where("lfp is not null").select(*keys, F.unix_micros("t").alias("us"), F.log10(F.col("lfp") + 1).alias("x"))
    s = s.withColumn("h", F.expr(f"us div {hour}"))
    own = F.expr(f"unix_micros(t) div {hour}")
    d = doses.select(*keys, F.unix_micros("t").alias("at"), F.explode(F.transform(F.array(*[F.lit(i) for i in range(-2, 3)]), lambda i: own + i)).alias("h"))
    minutes = (F.col("us") - F.col("at")) / 60e6
    x = s.join(d, [*keys, "h"]).withColumn("m", minutes).where("m between -95 and 95")
    b = F.least(F.lit(18), F.greatest(F.lit(0), F.floor((F.col("m") + 90) / 10 + 0.5)))
    curve = x.groupBy(*keys, b.alias("b")).agg(F.avg("x").alias("v"))
    side = lambda c: (F.avg(F.when(c, F.col("v"))), F.count_if(c))
    (pre, n_pre), (post, n_post) = side(F.col("b") <= 8), side(F.col("b") >= 10)
    m = curve.groupBy(*keys).agg((post - pre).alias("delta"), n_pre.alias("n_pre"), n_post.alias("n_post")).where("n_pre >= 3 and n_post >= 3")
    total = doses.groupBy(*keys).agg(F.count("*").alias("n_doses"))
    return m.join(total, keys).select(*keys, "n_doses", "delta", (F.col("delta") < 0).alias("passes"))


def suggested_limits(series: DataFrame, keys: list[str] | None = None, duty: float = 0.5) -> DataFrame:
    """(keys, criterion, lower, upper): the 10th and 90th percentile, and the quantiles around the one that leaves a share `duty` of
    the time above it; of eight samples at least."""
    keys = keys or KEYS
    q = 1 - duty
    at = [0.10, 0.90, max(0.02, q - 0.15), min(0.98, q + 0.15)]
    m = series.where("lfp is not null").groupBy(*keys).agg(F.count("*").alias("n"), F.percentile("lfp", F.array(*map(F.lit, at))).alias("p")).where("n >= 8")
    row = lambda name, i: F.struct(F.lit(name).alias("criterion"), F.get("p", F.lit(i)).alias("lower"), F.get("p", F.lit(i + 1)).alias("upper"))
    return m.select(*keys, F.inline(F.array(row("percentiles", 0), row("duty", 2))))


def session_reliability(sessions: DataFrame, by: list[str], subject: str, value: str, order: list[str], least: int = 2) -> DataFrame:
    """ICC of a value between sessions: the first sessions of each subject with `least` of them, as many as all of these have."""
    w = Window.partitionBy(*by, subject).orderBy(*order)
    x = sessions.where(F.col(value).isNotNull()).withColumns({"session": F.row_number().over(w), "own": F.count("*").over(Window.partitionBy(*by, subject))}).where(F.col("own") >= least)
    common = x.groupBy(*by).agg(F.min("own").alias("common"))
    return icc(with_group(x, common, by, [subject]).where("session <= common"), subject, "session", value, by)
