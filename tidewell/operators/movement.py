"""Epochs and windows of raw records: normalisation, changes with movement, ratios of bands, paired tests, quality lights."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewell.functions.columns import ratio

#: Bands of a spectrum in Hz, half-open; edges of burst durations in ms.
BANDS = {"delta": (1, 4), "theta": (4, 8), "alpha": (8, 13), "lowbeta": (13, 20), "highbeta": (20, 35), "gamma": (35, 100)}
DURATIONS = (200, 350, 500, 650, 800)


def zscore_epochs(samples: DataFrame, scope: list[str]) -> DataFrame:
    """samples (v) with `z`: by mean and deviation of the scope, a record or a session; null without spread. The scope's keys aren't null."""
    m = samples.groupBy(*scope).agg(F.avg("v").alias("_m"), F.nullif(F.stddev_samp("v"), F.lit(0.0)).alias("_sd"))
    return samples.join(m, scope).withColumn("z", ratio(F.col("v") - F.col("_m"), F.col("_sd"))).drop("_m", "_sd")


def band_of(f: Column) -> Column:
    """The band of a frequency; null outside."""
    out = F.lit(None).cast("string")
    for name, (lo, hi) in BANDS.items():
        out = F.when((f >= lo) & (f < hi), name).otherwise(out)
    return out


def band_power(lo: float, hi: float, f: str = "f", p: str = "p", df: float = 1.0) -> Column:
    """Aggregate: the sum of a spectrum over a closed band times its step; null without a line in it."""
    return F.sum(F.when(F.col(f).between(lo, hi), F.col(p))) * df


def band_table(spectra: DataFrame, by: list[str], df: float = 1.0) -> DataFrame:
    """(by, band, absolute, relative, peak_f): power of each band, its share of 1 to 100 Hz in %, and its highest line."""
    bands = F.explode(F.array(*[F.struct(F.lit(k).alias("band"), F.lit(lo).alias("lo"), F.lit(hi).alias("hi")) for k, (lo, hi) in BANDS.items()])).alias("b")
    total = spectra.groupBy(*by).agg(band_power(1, 100, df=df).alias("total"))
    x = spectra.select("*", bands).where("f between b.lo and b.hi")
    own = x.groupBy(*by, F.col("b.band").alias("band")).agg((F.sum("p") * df).alias("absolute"), F.max_by("f", F.struct("p", -F.col("f"))).alias("peak_f"))
    return own.join(total, by).select(*by, "band", "absolute", (100 * ratio(F.col("absolute"), F.col("total"))).alias("relative"), "peak_f")


def movement_change(pairs: DataFrame, by: list[str], bands: dict[str, tuple[float, float]], whole: tuple[float, float], floor: float = 0.05) -> DataFrame:
    """(by, band, change, relative, total, verdict): (move - rest) / rest of each band, of its share, and of the whole spectrum,
    from lines (f, rest, move); and whether the change is broad, of a band, both or none by the floor."""
    part = lambda p, q: ratio(p - q, F.when(q > 0, q))
    sums = {f"{k}_{c}": F.sum(F.when(F.col("f").between(*b), F.col(c))) for k, b in {**bands, "_": whole}.items() for c in ("rest", "move")}
    m = pairs.groupBy(*by).agg(*[v.alias(k) for k, v in sums.items()])
    rows = []
    for k in bands:
        r, v, rt, vt = (F.col(x) for x in (f"{k}_rest", f"{k}_move", "__rest", "__move"))
        rows.append(F.struct(F.lit(k).alias("band"), part(v, r).alias("change"), part(ratio(v, vt), ratio(r, rt)).alias("relative")))
    x = m.select(*by, part(F.col("__move"), F.col("__rest")).alias("total"), F.array(*rows).alias("rows"))
    broad = F.coalesce(F.abs("total") >= floor, F.lit(False))
    single = F.exists("rows", lambda b: F.coalesce(F.abs(b["relative"]) >= floor, F.lit(False)))
    verdict = F.when(broad & ~single, "broadband").when(~broad & single, "band").when(broad & single, "mixed").otherwise("none")
    return x.withColumn("verdict", verdict).select(*by, "total", "verdict", F.inline("rows"))


def sign_flip_test(diffs: DataFrame, by: list[str], most: int = 20) -> DataFrame:
    """(by, n, mean, t, p, least_p): exact test of paired differences `d` by all 2^n signs, for 2 to `most` of them; t beside it. Only
    groups of up to `most` are gathered."""
    d = diffs.where("d is not null")
    m = d.groupBy(*by).agg(F.count("*").alias("n"), F.avg("d").alias("mean"), F.stddev_samp("d").alias("sd")).where("n >= 2")
    few = d.join(m.where(F.col("n") <= most).select(*by, "n"), by).groupBy(*by, "n").agg(F.sort_array(F.collect_list("d")).alias("all"))
    flips = few.select(*by, "n", "all", F.explode(F.sequence(F.lit(0), (F.pow(F.lit(2), F.col("n")) - 1).cast("int"))).alias("mask"))
    total = F.expr("aggregate(transform(all, (x, i) -> if((shiftright(mask, i) & 1) = 1, -x, x)), 0D, (s, x) -> s + x)")
    own = F.expr("aggregate(all, 0D, (s, x) -> s + x)")
    p = flips.groupBy(*by).agg((F.count_if(F.abs(total / F.col("n")) >= F.abs(own / F.col("n")) - 1e-12) / F.count("*")).alias("p"))
    out = m.join(p, by, "left")
    return out.select(*by, "n", "mean", ratio(F.col("mean"), F.nullif(F.col("sd"), F.lit(0.0)) / F.sqrt("n")).alias("t"), "p", (2 / F.pow(F.lit(2.0), F.col("n"))).alias("least_p"))


def band_ratio(windows: DataFrame, by: list[str]) -> DataFrame:
    """windows (theta, gamma, lowbeta) with odr_log, the sum of the z scores of log theta and gamma less that of log low beta
    over all windows of a record, and odr_literal, (z theta · z gamma) / z low beta of the powers themselves."""
    w = Window.partitionBy(*by)
    z = lambda c: ratio(c - F.avg(c).over(w), F.nullif(F.stddev_samp(c).over(w), F.lit(0.0)))
    log = lambda c: F.when(F.col(c) > 0, F.log10(c))
    out = windows.withColumn("odr_log", z(log("theta")) + z(log("gamma")) - z(log("lowbeta")))
    return out.withColumn("odr_literal", ratio(z(F.col("theta")) * z(F.col("gamma")), F.nullif(z(F.col("lowbeta")), F.lit(0.0))))


def pairable(records: DataFrame, by: list[str], tolerance: float = 0.01) -> DataFrame:
    """(by, ok, mismatches): whether the records of both sides (hemisphere, t0, fs, n, tick_base) are of one recording."""
    side = lambda h, p: records.where(F.col("hemisphere") == h).select(*by, *[F.col(c).alias(p + c) for c in ("t0", "fs", "n", "tick_base")])
    x = side("Left", "l_").join(side("Right", "r_"), by, "full")
    differ = lambda c: ~F.col(f"l_{c}").eqNullSafe(F.col(f"r_{c}"))
    fs = F.coalesce(F.abs(F.col("l_fs") - F.col("r_fs")) > tolerance, F.lit(True))
    base = F.coalesce(F.col("l_tick_base") != F.col("r_tick_base"), F.lit(False))
    found = F.array_compact(F.array(F.when(differ("t0"), "t0"), F.when(fs, "fs"), F.when(differ("n"), "n"), F.when(base, "tick_base")))
    return x.select(*by, (F.size(found) == 0).alias("ok"), F.array_join(found, ",").alias("mismatches"))


def find_peaks(spectra: DataFrame, by: list[str], least: float = 0.0, most: int = 6) -> DataFrame:
    """(by, f, p, width): the `most` highest local maxima over `least` of spectra (f, p arrays), and their width at half height."""
    n = F.size("p")
    at = lambda i: F.get(F.col("p"), i)
    tops = F.filter(F.when(n >= 3, F.sequence(F.lit(1), n - 2)).otherwise(F.array().cast("array<int>")), lambda i: (at(i) > at(i - 1)) & (at(i) >= at(i + 1)) & (at(i) > least))
    x = spectra.select(*by, "f", "p", F.explode(tops).alias("i"))
    low = lambda j: at(j) <= at(F.col("i")) / 2
    left = F.coalesce(F.array_max(F.filter(F.sequence(F.lit(0), F.col("i")), low)), F.lit(0))
    right = F.coalesce(F.array_min(F.filter(F.sequence(F.col("i"), n - 1), low)), n - 1)
    freq = lambda i: F.get(F.col("f"), i)
    out = x.select(*by, freq(F.col("i")).alias("freq"), at(F.col("i")).alias("power"), (freq(right) - freq(left)).alias("width"))
    return out.withColumn("k", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("power"), "freq"))).where(F.col("k") <= most)


def burst_histogram(bursts: DataFrame, by: list[str]) -> DataFrame:
    """(by, bin, n, percent): bursts by their duration `ms`, between the fixed edges."""
    b = F.lit(len(DURATIONS))
    for i, edge in reversed(list(enumerate(DURATIONS))):
        b = F.when(F.col("ms") < edge, i).otherwise(b)
    x = bursts.withColumn("bin", b).groupBy(*by, "bin").agg(F.count("*").alias("n"))
    return x.withColumn("percent", 100 * F.col("n") / F.sum("n").over(Window.partitionBy(*by)))


def modulation_index(samples: DataFrame, by: list[str], bins: int = 18, least: int = 200) -> DataFrame:
    """(by, n, mi, bin): how far the mean amplitude `amp` over bins of the phase `phase` (radians) is from even, by entropy, and
    the highest bin; null under `least` samples."""
    x = samples.where("phase is not null and amp is not null")
    b = F.least(F.greatest(F.floor((F.col("phase") + math.pi) / (2 * math.pi) * bins), F.lit(0)), F.lit(bins - 1)).cast("int")
    m = x.withColumn("bin", b).groupBy(*by, "bin").agg(F.avg("amp").alias("m"), F.count("*").alias("k"))
    w = Window.partitionBy(*by)
    m = m.withColumn("q", ratio(F.col("m"), F.when(F.sum("m").over(w) > 0, F.sum("m").over(w))))
    out = m.groupBy(*by).agg(F.sum("k").alias("n"), (-F.sum(F.when(F.col("q") > 0, F.col("q") * F.log("q")))).alias("h"), F.max_by("bin", F.struct("q", -F.col("bin"))).alias("bin"))
    enough = F.col("n") >= least
    return out.select(*by, "n", F.when(enough, (math.log(bins) - F.col("h")) / math.log(bins)).alias("mi"), F.when(enough, F.col("bin")).alias("bin"))


def removal_checks(lines: DataFrame, by: list[str], peak_hz: float, lo: float, hi: float, half: float = 5.0) -> DataFrame:
    """(by, suppression_db, recovery, preservation) of spectra before and after a removal, lines (f, raw, clean): the fall of the
    mean over 0.5 to 40 Hz, the peak's height over the edges around it, and the power of a band, each clean by raw."""
    d = F.col("f") - peak_hz
    edge = F.abs(d).between(half - 1, half)
    mean = lambda c: F.avg(F.when(F.col("f").between(0.5, 40), F.col(c)))
    height = lambda c: F.max(F.when(F.abs(d) <= 1, F.col(c))) - F.avg(F.when(edge & (F.abs(d) > 1), F.col(c)))
    m = lines.groupBy(*by).agg(
        (10 * F.log10(ratio(mean("raw"), F.when(mean("clean") > 0, mean("clean"))))).alias("suppression_db"),
        ratio(height("clean"), F.nullif(height("raw"), F.lit(0.0))).alias("recovery"),
        ratio(band_power(lo, hi, p="clean"), F.nullif(band_power(lo, hi, p="raw"), F.lit(0.0))).alias("preservation"),
    )
    return m


def nan_stats(records: DataFrame, by: list[str]) -> DataFrame:
    """(by, n, n_missing, percent, longest): missing samples (null or NaN) of each record `x`, and the longest run of them."""
    gone = lambda v: v.isNull() | F.isnan(v)
    run = F.aggregate(
        "x", F.struct(F.lit(0).alias("now"), F.lit(0).alias("most")),
        lambda s, v: F.when(gone(v), F.struct((s["now"] + 1).alias("now"), F.greatest(s["most"], s["now"] + 1).alias("most"))).otherwise(F.struct(F.lit(0).alias("now"), s["most"].alias("most"))),
        lambda s: s["most"],
    )
    n, k = F.size("x"), F.size(F.filter("x", gone))
    return records.select(*by, n.alias("n"), k.alias("n_missing"), F.coalesce(100 * ratio(k, n), F.lit(0.0)).alias("percent"), run.alias("longest"))


def whole_windows(records: DataFrame, by: list[str], size: int, step: int, most_percent: float = 0.0) -> DataFrame:
    """(by, starts, dropped): starts of the windows of records `x` of which at most `most_percent` % is missing."""
    n = F.size("x")
    starts = F.when(n >= size, F.sequence(F.lit(0), n - size, F.lit(step))).otherwise(F.array().cast("array<int>"))
    bad = lambda s: 100 * F.size(F.filter(F.slice(F.col("x"), s + 1, size), lambda v: v.isNull() | F.isnan(v))) / size
    good = F.filter(starts, lambda s: bad(s) <= most_percent)
    return records.select(*by, good.alias("starts"), (F.size(starts) - F.size(good)).alias("dropped"))


def quality_light(items: DataFrame, by: list[str]) -> DataFrame:
    """(by, light, n, n_unverified, percent_verified): the worst colour of the items (colour); grey ones are no verdict."""
    m = items.groupBy(*by).agg(F.count("*").alias("n"), *[F.count_if(F.col("colour") == c).alias(c) for c in ("red", "amber", "grey")])
    light = F.when(F.col("red") > 0, "red").when(F.col("amber") > 0, "amber").otherwise("green")
    return m.select(*by, light.alias("light"), "n", F.col("grey").alias("n_unverified"), (100 * ratio(F.col("n") - F.col("grey"), F.col("n"))).alias("percent_verified"))


def dose_response(samples: DataFrame, by: list[str], least: int = 4) -> DataFrame:
    """(by, levels, least_ma, most_ma, slope, r2): the line through the medians of lfp at each amplitude ma (two decimals) with at
    least `least` samples; no line under three levels."""
    m = samples.where("ma is not null").groupBy(*by, F.round("ma", 2).alias("ma")).agg(F.count("*").alias("k"), F.median("lfp").alias("y")).where(F.col("k") >= least)
    out = m.groupBy(*by).agg(F.count("*").alias("levels"), F.min("ma").alias("lo"), F.max("ma").alias("hi"), F.regr_slope("y", "ma").alias("slope"), F.regr_r2("y", "ma").alias("r2"))
    enough = lambda c: F.when(F.col("levels") >= 3, F.col(c))
    return out.select(*by, "levels", enough("lo").alias("least_ma"), enough("hi").alias("most_ma"), enough("slope").alias("slope"), enough("r2").alias("r2"))


def window_table(windows: DataFrame, by: list[str], values: list[str]) -> DataFrame:
    """One row for each window with the values of both sides, `left_` and `right_`, and how many sides it has."""
    aggregates = [F.max(F.when(F.col("hemisphere") == h, F.col(v))).alias(f"{h.lower()}_{v}") for h in ("Left", "Right") for v in values]
    return windows.groupBy(*by).agg(*aggregates, F.count_distinct("hemisphere").alias("sides"))
