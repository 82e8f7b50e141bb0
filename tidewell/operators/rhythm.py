"""Daily rhythm: cosinor, phase statistics, profiles and rest-activity measures."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewell.functions.columns import local_day, local_hour, ratio

from .chronic import KEYS


def cosinor(series: DataFrame, keys: list[str] | None = None, period: float = 24.0, offset: int = 0) -> DataFrame:
    """Least squares of lfp on a constant, cosine and sine of one period: MESOR, amplitude, acrophase (hours) and R².

    The sums of the normal equations aggregate before the shuffle; the 3 x 3 system is solved by columns.
    Series of fewer than four samples, or with a singular system, give null.
    """
    keys = keys or KEYS
    angle = local_hour(F.col("t"), offset) * (2 * math.pi / period)
    x = series.where(F.col("lfp").isNotNull()).select(*keys, F.cos(angle).alias("c"), F.sin(angle).alias("s"), F.col("lfp").alias("y"))
    total = lambda e, name: F.sum(F.expr(e)).alias(name)
    m = x.groupBy(*keys).agg(
        F.count("*").cast("double").alias("n"), total("c", "sc"), total("s", "ss"), total("c * c", "cc"), total("s * s", "s2"), total("c * s", "cs"),
        total("y", "sy"), total("c * y", "cy"), total("s * y", "s_y"), total("y * y", "yy"),
    )
    n, sc, ss, cc, s2, cs, sy, cy, s_y, yy = (F.col(c) for c in ("n", "sc", "ss", "cc", "s2", "cs", "sy", "cy", "s_y", "yy"))

    def det(a: list[list[Column]]) -> Column:
        return a[0][0] * (a[1][1] * a[2][2] - a[1][2] * a[2][1]) - a[0][1] * (a[1][0] * a[2][2] - a[1][2] * a[2][0]) + a[0][2] * (a[1][0] * a[2][1] - a[1][1] * a[2][0])

    rows, right = [[n, sc, ss], [sc, cc, cs], [ss, cs, s2]], [sy, cy, s_y]
    whole = det(rows)
    solved = [F.when((n >= 4) & (F.abs(whole) > 1e-9), ratio(det([[right[i] if j == k else rows[i][j] for j in range(3)] for i in range(3)]), whole)) for k in range(3)]
    out = m.withColumns({"mesor": solved[0], "b": solved[1], "g": solved[2]})
    explained = F.col("mesor") * sy + F.col("b") * cy + F.col("g") * s_y
    return out.select(
        *keys, n.cast("long").alias("n"), "mesor", F.sqrt(F.col("b") ** 2 + F.col("g") ** 2).alias("amplitude"),
        F.pmod(F.atan2("g", "b") * (period / (2 * math.pi)) + period, F.lit(period)).alias("acrophase"),
        ratio(explained - sy * sy / n, yy - sy * sy / n).alias("r2"),
    )


def rayleigh(hours: DataFrame, keys: list[str] | None = None, hour: str = "hour", period: float = 24.0) -> DataFrame:
    """Concentration of times on the clock: length of the mean vector, z, its p value and the mean hour; three times at least."""
    keys = keys or KEYS
    a = F.col(hour) * (2 * math.pi / period)
    m = hours.groupBy(*keys).agg(F.count(hour).alias("n"), F.avg(F.cos(a)).alias("c"), F.avg(F.sin(a)).alias("s")).where("n >= 3")
    r = F.sqrt(F.col("c") ** 2 + F.col("s") ** 2)
    m = m.withColumns({"r": r, "z": F.col("n") * r * r})
    z, n = F.col("z"), F.col("n").cast("double")
    p = F.exp(F.sqrt(1 + 4 * n + 4 * (n * n - z * z)) - (1 + 2 * n))
    mean = F.pmod(F.atan2("s", "c") * (period / (2 * math.pi)) + period, F.lit(period))
    return m.select(*keys, "n", "r", "z", F.least(F.lit(1.0), F.greatest(F.lit(0.0), p)).alias("p"), mean.alias("mean_hour"))


def variance_by_hour(series: DataFrame, keys: list[str] | None = None, bins: int = 24, offset: int = 0) -> DataFrame:
    """One-way analysis of variance over hours of the day: eta² and F."""
    keys = keys or KEYS
    x = series.where(F.col("lfp").isNotNull()).withColumn("bin", F.floor(local_hour(F.col("t"), offset) * bins / 24))
    cell = x.groupBy(*keys, "bin").agg(F.count("*").cast("double").alias("n"), F.sum("lfp").alias("y"), F.sum(F.col("lfp") ** 2).alias("yy"))
    a = cell.groupBy(*keys).agg(F.sum("n").alias("n"), F.sum("y").alias("y"), F.sum("yy").alias("yy"), F.sum(F.col("y") ** 2 / F.col("n")).alias("between"), F.count("*").alias("k"))
    mean = F.col("y") ** 2 / F.col("n")
    ssb, sst = F.col("between") - mean, F.col("yy") - mean
    f = ratio(ssb / (F.col("k") - 1), (sst - ssb) / (F.col("n") - F.col("k")))
    return a.where("k > 1 and n > k").select(*keys, F.col("n").cast("long").alias("n"), ratio(ssb, sst).alias("eta2"), f.alias("f"))


def diurnal_profile(series: DataFrame, keys: list[str] | None = None, bin_minutes: int = 60, relative: bool = False, offset: int = 0) -> DataFrame:
    """Median and quartiles, over days, of each day's medians by time of day; `relative`: in percent of the day's median."""
    keys = keys or KEYS
    x = series.where(F.col("lfp").isNotNull()).withColumns({"day": local_day(F.col("t"), offset), "bin": F.floor(local_hour(F.col("t"), offset) * 60 / bin_minutes).cast("int")})
    cell = x.groupBy(*keys, "day", "bin").agg(F.expr("percentile(lfp, 0.5)").alias("v"))
    if relative:
        daily = x.groupBy(*keys, "day").agg(F.expr("percentile(lfp, 0.5)").alias("d"))
        cell = cell.join(daily, [*keys, "day"]).withColumn("v", 100 * ratio(F.col("v"), F.col("d")))
    q = cell.groupBy(*keys, "bin").agg(F.count("v").alias("n_days"), F.expr("percentile(v, array(0.25, 0.5, 0.75))").alias("q"))
    return q.select(*keys, "bin", "n_days", *[F.get("q", i).alias(c) for i, c in enumerate(("q1", "median", "q3"))])


def _hourly(series: DataFrame, keys: list[str], offset: int) -> DataFrame:
    hour = F.floor(local_hour(F.col("t"), offset)).cast("int")
    x = series.where(F.col("lfp").isNotNull()).select(*keys, local_day(F.col("t"), offset).alias("day"), hour.alias("h"), "lfp")
    return x.groupBy(*keys, "day", "h").agg(F.avg("lfp").alias("v"))


def interdaily_stability(series: DataFrame, keys: list[str] | None = None, least_cover: float = 0.66, least_days: int = 3, offset: int = 0) -> DataFrame:
    """Share of the variance of hourly means that the mean day explains, over days with enough hours."""
    keys = keys or KEYS
    x = _hourly(series, keys, offset)
    x = x.withColumn("k", F.count("*").over(Window.partitionBy(*keys, "day"))).where(F.col("k") >= least_cover * 24)
    all_ = x.groupBy(*keys).agg(F.count("*").alias("n"), F.count_distinct("day").alias("n_days"), F.avg("v").alias("m"), (F.var_pop("v") * F.count("*")).alias("sst"))
    by_hour = x.groupBy(*keys, "h").agg(F.avg("v").alias("mh"))
    between = by_hour.join(all_.select(*keys, "m"), keys).groupBy(*keys).agg(F.sum((F.col("mh") - F.col("m")) ** 2).alias("ssb"), F.count("*").alias("p"))
    out = all_.join(between, keys).where(F.col("n_days") >= least_days)
    return out.select(*keys, "n_days", ratio(F.col("n") * F.col("ssb"), F.col("p") * F.col("sst")).alias("stability"))


def intradaily_variability(series: DataFrame, keys: list[str] | None = None, offset: int = 0, least_cover: float = 0.66, least_days: int = 3) -> DataFrame:
    """(keys, n_days, n_pairs, n_skipped, variability): mean squared step between hours of the days with enough of them, one day after the
    other, over the variance. Steps to or from a missing hour are left out and counted, and the sum is scaled to all steps of the days;
    series of too few days are left out."""
    keys = keys or KEYS
    x = covered_hours(series, keys, offset, least_cover, least_days)
    place = x.select(*keys, "day").distinct().withColumn("place", F.row_number().over(Window.partitionBy(*keys).orderBy("day")))
    x = x.join(place, [*keys, "day"]).withColumn("slot", F.col("place") * 24 + F.col("h"))
    w = Window.partitionBy(*keys).orderBy("slot")
    step = F.when(F.col("slot") - F.lag("slot").over(w) == 1, (F.col("v") - F.lag("v").over(w)) ** 2)
    out = x.withColumn("step", step).groupBy(*keys, "n_days").agg(F.count("*").alias("n"), F.count("step").alias("n_pairs"), F.sum("step").alias("sum"), (F.var_pop("v") * F.count("*")).alias("ss"))
    steps = 24 * F.col("n_days") - 1
    value = ratio(F.col("n") * F.col("sum") * steps / F.nullif("n_pairs", F.lit(0)), (F.col("n") - 1) * F.col("ss"))
    return out.select(*keys, "n_days", "n_pairs", (steps - F.col("n_pairs")).alias("n_skipped"), value.alias("variability"))


def covered_hours(series: DataFrame, keys: list[str], offset: int = 0, least_cover: float = 0.66, least_days: int = 3) -> DataFrame:
    """(keys, day, h, v): hourly means of the days that have `least_cover` of their hours, of series with `least_days` such days."""
    x = _hourly(series, keys, offset)
    x = x.withColumn("k", F.count("*").over(Window.partitionBy(*keys, "day"))).where(F.col("k") >= 24 * least_cover).drop("k")
    days = x.groupBy(*keys).agg(F.count_distinct("day").alias("n_days")).where(F.col("n_days") >= least_days)
    return x.join(days, keys)


def m10_l5(series: DataFrame, keys: list[str] | None = None, offset: int = 0, least_cover: float = 0.66, fill: float = 0.8) -> DataFrame:
    """Highest 10-hour and lowest 5-hour means of the mean day, on the clock, when they begin (the first of equal ones), and
    their relative amplitude. Windows with under `fill` of their hours are left out; a profile is 24 values a series."""
    keys = keys or KEYS
    day = covered_hours(series, keys, offset, least_cover).groupBy(*keys, "h").agg(F.avg("v").alias("v"), F.max("n_days").alias("n_days"))
    x = day.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("h", "v"))).alias("m"), F.max("n_days").alias("n_days"))
    hours = F.sequence(F.lit(0), F.lit(23))

    def means(size: int) -> Column:
        own = lambda i: F.filter(F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda k: F.try_element_at(F.col("m"), (i + k) % 24)), lambda v: v.isNotNull())
        mean = lambda a: F.aggregate(a, F.lit(0.0), lambda s, v: s + v) / F.size(a)
        return F.transform(hours, lambda i: F.when(F.size(own(i)) >= size * fill, F.struct(mean(own(i)).alias("v"), i.alias("i"))))

    best = lambda a, sign: F.array_min(F.transform(F.filter(a, lambda x: x.isNotNull()), lambda x: F.struct((sign * x["v"]).alias("v"), x["i"].alias("i"))))
    x = x.withColumns({"a": best(means(10), -1), "b": best(means(5), 1)})
    high, low = -F.col("a.v"), F.col("b.v")
    return x.select(*keys, "n_days", high.alias("m10"), F.col("a.i").alias("m10_hour"), low.alias("l5"), F.col("b.i").alias("l5_hour"), ratio(high - low, F.nullif(high + low, F.lit(0.0))).alias("relative_amplitude"))


def actogram(series: DataFrame, keys: list[str] | None = None, offset: int = 0, minutes: int = 30) -> DataFrame:
    """(keys, day, n, phase, drift): the clock hour of the vector of each day's medians of `minutes`, as % of the day's median
    and above the day's least, of days with four of these; and the step from the day before it that has samples."""
    keys = keys or KEYS
    bins = 24 * 60 // minutes
    x = series.where("lfp is not null").select(*keys, local_day(F.col("t"), offset).alias("day"), F.least(F.floor(local_hour(F.col("t"), offset) * 60 / minutes), F.lit(bins - 1)).alias("bin"), "lfp")
    whole = x.groupBy(*keys, "day").agg(F.median("lfp").alias("middle"))
    cell = x.groupBy(*keys, "day", "bin").agg(F.median("lfp").alias("v")).join(whole, [*keys, "day"]).withColumn("v", 100 * ratio(F.col("v"), F.nullif(F.col("middle"), F.lit(0.0))))
    a = (F.col("bin") + 0.5) * (minutes / 60 * 2 * math.pi / 24)
    cell = cell.withColumn("u", F.col("v") - F.min("v").over(Window.partitionBy(*keys, "day")))
    d = cell.groupBy(*keys, "day").agg(F.count("v").alias("n"), F.sum(F.col("u") * F.cos(a)).alias("c"), F.sum(F.col("u") * F.sin(a)).alias("s"), F.sum("u").alias("w"))
    phase = F.when((F.col("n") >= 4) & (F.col("w") > 0), F.pmod(F.atan2("s", "c") * (24 / (2 * math.pi)) + 24, F.lit(24.0)))
    w = Window.partitionBy(*keys).orderBy("day")
    drift = F.pmod(F.col("phase") - F.lag("phase").over(w) + 36, F.lit(24.0)) - 12
    return d.withColumn("phase", phase).select(*keys, "day", "n", "phase", drift.alias("drift"))


def drift_of_phase(days: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """(keys, n_days, drift, total): the median step of the phase a day, and what it adds up to; of two days at least."""
    out = days.groupBy(*(keys or KEYS)).agg(F.count("*").alias("n_days"), F.median("drift").alias("drift")).where("n_days >= 2")
    return out.withColumn("total", F.col("drift") * (F.col("n_days") - 1))


def cosinor_test(series: DataFrame, keys: list[str] | None = None, period: float = 24.0, offset: int = 0) -> DataFrame:
    """(keys, n, f, rho, n_eff, f_adjusted, df2_adjusted, residual_sd) of the cosinor of one period: the F of its two terms, and the
    same after the number of samples that the residuals' first autocorrelation leaves. Samples in the order of time;
    their number must be over five."""
    keys = keys or KEYS
    fit = cosinor(series, keys, period, offset).where("n > 5").select(*keys, "mesor", "amplitude", "acrophase")
    turn = 2 * math.pi / period
    x = series.where("lfp is not null").join(fit, keys)
    fitted = F.col("mesor") + F.col("amplitude") * F.cos((local_hour(F.col("t"), offset) - F.col("acrophase")) * turn)
    x = x.withColumn("r", F.col("lfp") - fitted)
    x = x.withColumn("rr", F.col("r") * F.lag("r").over(Window.partitionBy(*keys).orderBy("t", "row_ord")))
    m = x.groupBy(*keys).agg(F.count("*").cast("double").alias("n"), F.sum(F.col("r") ** 2).alias("sse"), F.sum("rr").alias("num"), (F.var_pop("lfp") * F.count("*")).alias("sst"))
    n, sse = F.col("n"), F.col("sse")
    m = m.withColumns({"f": (F.col("sst") - sse) / 2 / (sse / (n - 3)), "rho": ratio(F.col("num"), sse)}).withColumn("n_eff", n * (1 - F.col("rho")) / (1 + F.col("rho")))
    adjusted = F.col("f") * F.greatest(F.lit(0.02), F.col("n_eff") / n)
    df2 = F.greatest(F.lit(2.0), F.floor(F.col("n_eff") + 0.5) - 3)
    return m.select(*keys, n.cast("long").alias("n"), "f", "rho", "n_eff", adjusted.alias("f_adjusted"), df2.alias("df2_adjusted"), F.sqrt(sse / (n - 3)).alias("residual_sd"))


def panel(series: DataFrame, keys: list[str] | None = None, offset: int = 0, least_cover: float = 0.66) -> DataFrame:
    """Stability, variability and the highest and lowest hours of each series side by side; null where one isn't to be had."""
    keys = keys or KEYS
    a = interdaily_stability(series, keys, offset=offset, least_cover=least_cover).select(*keys, "stability")
    b = intradaily_variability(series, keys, offset, least_cover).select(*keys, "variability")
    return a.join(b, keys, "full").join(m10_l5(series, keys, offset, least_cover), keys, "full")
