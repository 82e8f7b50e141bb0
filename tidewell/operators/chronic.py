"""Long irregular series: censoring, merging, cleaning, zones, days and gaps.

Series are long tables keyed by `KEYS`; a missing value is null and is never filled in.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewell.functions.columns import local_day, millis, missing, ratio, seconds, zone

KEYS = ["subject", "hemisphere"]


def censor(raw: DataFrame, value: str = "lfp_raw") -> DataFrame:
    """Negative readings are censored by the device: null, and marked apart from lost ones."""
    x = missing(F.col(value))
    return raw.withColumns({"censored": F.coalesce(x < 0, F.lit(False)), "lfp": F.when(x >= 0, x)}).drop(value)


def censoring_summary(series: DataFrame) -> DataFrame:
    """Points, censored points and their share: for each hemisphere and (hemisphere null) for all."""
    out = series.rollup("hemisphere").agg(F.count("*").alias("n"), F.count_if("censored").alias("n_censored"))
    return out.withColumn("share_censored", ratio(F.col("n_censored"), F.col("n")))


def merge_series(series: DataFrame, keys: list[str] | None = None, time: str = "t", order: str = "row_ord") -> DataFrame:
    """One row for each key and time: the first in the order of files and rows."""
    keys = keys or KEYS
    rows = F.struct(*[c for c in series.columns if c not in (*keys, time)])
    first = series.groupBy(*keys, time).agg(F.min_by(rows, order).alias("r"))
    return first.select(*keys, time, "r.*")


def mad_limits(series: DataFrame, keys: list[str] | None = None, value: str = "lfp", k: float = 4.0) -> DataFrame:
    """(keys, med, mad, n): exact median and scaled median absolute deviation of each series; a MAD of 0 counts as 1e-9."""
    keys = keys or KEYS
    med = series.groupBy(*keys).agg(F.expr(f"percentile({value}, 0.5)").alias("med"))
    apart = series.join(med, keys).groupBy(*keys, "med").agg(F.expr(f"1.4826 * percentile(abs({value} - med), 0.5)").alias("mad"), F.count(value).alias("n"))
    return apart.withColumn("mad", F.when(F.col("mad") == 0, 1e-9).otherwise(F.col("mad")))


def clean(series: DataFrame, keys: list[str] | None = None, value: str = "lfp", k: float = 4.0) -> DataFrame:
    """The rows whose value is within k MADs of its series' median."""
    keys = keys or KEYS
    limits = mad_limits(series, keys, value, k).select(*keys, "med", "mad")
    return series.join(limits, keys).where(F.abs(F.col(value) - F.col("med")) <= k * F.col("mad")).drop("med", "mad")


def quartiles(series: DataFrame, keys: list[str] | None = None, value: str = "lfp") -> DataFrame:
    keys = keys or KEYS
    q = F.expr(f"percentile({value}, array(0.1, 0.25, 0.5, 0.75, 0.9))")
    return series.groupBy(*keys).agg(q.alias("q")).select(*keys, *[F.get("q", i).alias(c) for i, c in enumerate(("p10", "q1", "median", "q3", "p90"))])


def zone_summary(series: DataFrame, limits: DataFrame, keys: list[str] | None = None, value: str = "lfp") -> DataFrame:
    """Shares of each series below, between and above its `lower` and `upper`."""
    keys = keys or KEYS
    x = series.where(F.col(value).isNotNull()).join(limits, keys).withColumn("zone", zone(F.col(value), F.col("lower"), F.col("upper")))
    parts = [ratio(F.count_if(F.col("zone") == z), F.count("*")).alias(f"share_{z}") for z in ("below", "between", "above")]
    return x.groupBy(*keys).agg(F.count("*").alias("n"), *parts)


def zone_transitions(series: DataFrame, limits: DataFrame, keys: list[str] | None = None, value: str = "lfp", offset: int = 0) -> DataFrame:
    """Changes of zone between neighbouring samples, for each civil day of each series."""
    keys = keys or KEYS
    x = series.where(F.col(value).isNotNull()).join(limits, keys)
    x = x.withColumns({"zone": zone(F.col(value), F.col("lower"), F.col("upper")), "day": local_day(F.col("t"), offset)})
    w = Window.partitionBy(*keys, "day").orderBy("t", "row_ord")
    x = x.withColumn("change", F.coalesce(F.lag("zone").over(w) != F.col("zone"), F.lit(False)))
    return x.groupBy(*keys, "day").agg(F.count("*").alias("n"), F.count_if("change").alias("n_transitions"))


def hampel(series: DataFrame, keys: list[str] | None = None, value: str = "lfp", half: int = 5, k: float = 3.0) -> DataFrame:
    """Mark artifacts: values more than k scaled MADs from the median of the samples half before to half - 1 after.
    With under four values, or a MAD of 1e-12 or less, nothing is an artifact."""
    keys = keys or KEYS
    w = Window.partitionBy(*keys).orderBy("t", "row_ord").rowsBetween(-half, half - 1)
    x = series.withColumn("around", F.array_sort(F.collect_list(value).over(w)))
    x = x.withColumn("med", sorted_median(F.col("around")))
    x = x.withColumn("mad", 1.4826 * sorted_median(F.array_sort(F.transform("around", lambda v: F.abs(v - F.col("med"))))))
    far = (F.size("around") >= 4) & (F.col("mad") > 1e-12) & (F.abs(F.col(value) - F.col("med")) > k * F.col("mad"))
    return x.withColumn("artifact", F.coalesce(far, F.lit(False))).drop("around", "med", "mad")


def sorted_median(a: Column) -> Column:
    n = F.size(a)
    return (F.get(a, F.floor((n - 1) / 2).cast("int")) + F.get(a, F.floor(n / 2).cast("int"))) / 2


def audit_days(marked: DataFrame, keys: list[str] | None = None, per_day: int = 144, least_cover: float = 0.7, most_rejected: float = 0.2, offset: int = 0) -> DataFrame:
    """Whether each civil day is used: its coverage of the expected samples and its share of artifacts, with the reason against it."""
    keys = keys or KEYS
    x = marked.withColumn("day", local_day(F.col("t"), offset))
    out = x.groupBy(*keys, "day").agg(F.count("lfp").alias("n_valid"), F.count_if(F.col("artifact") & F.col("lfp").isNotNull()).alias("n_rejected"))
    cover, rejected = F.col("n_valid") / F.lit(float(per_day)), F.coalesce(ratio(F.col("n_rejected"), F.col("n_valid")), F.lit(0.0))
    reason = F.when(cover < least_cover, "low_coverage").when(rejected > most_rejected, "many_artifacts")
    return out.withColumns({"coverage": cover, "rejected": rejected, "reason": reason, "used": reason.isNull()})


def day_segments(series: DataFrame, keys: list[str] | None = None, gap_factor: float = 3.0, offset: int = 0) -> DataFrame:
    """Stretches without gaps of each civil day. A gap is a step of over gap_factor times the series' median positive
    step; days without samples inside the range come with no stretch and n of 0."""
    keys = keys or KEYS
    x = series.where(F.col("lfp").isNotNull()).select(*keys, "t", "row_ord", seconds(F.col("t")).alias("s"), local_day(F.col("t"), offset).alias("day"))
    w = Window.partitionBy(*keys).orderBy("t", "row_ord")
    x = x.withColumn("step", F.col("s") - F.lag("s").over(w))
    usual = x.where("step > 0").groupBy(*keys).agg(F.expr("percentile(step, 0.5)").alias("usual"))
    x = x.join(usual, keys)
    day = Window.partitionBy(*keys, "day").orderBy("t", "row_ord")
    cut = F.lag("s").over(day).isNull() | (F.col("s") - F.lag("s").over(day) > gap_factor * F.col("usual"))
    x = x.withColumn("cut", cut.cast("int")).withColumn("segment", F.sum("cut").over(day))
    parts = x.groupBy(*keys, "day", "segment").agg(F.count("*").alias("n"), F.min("s").alias("from_s"), F.max("s").alias("to_s"))
    span = x.groupBy(*keys).agg(F.explode(F.sequence(F.min("day"), F.max("day"))).alias("day"))
    return span.join(parts, [*keys, "day"], "left").withColumn("n", F.coalesce("n", F.lit(0)))


def wake_percentiles(series: DataFrame, keys: list[str] | None = None, begin: float = 8.0, end: float = 22.0, last_days: int = 14, offset: int = 0) -> DataFrame:
    """Quartiles of the waking hours of each of the last days, for all of them, and how steady the daily medians are."""
    from tidewell.functions.columns import in_hours, local_hour

    keys = keys or KEYS
    x = series.where(F.col("lfp").isNotNull() & in_hours(local_hour(F.col("t"), offset), begin, end)).withColumn("day", local_day(F.col("t"), offset))
    days = x.select(*keys, "day").distinct().withColumn("age", F.row_number().over(Window.partitionBy(*keys).orderBy(F.col("day").desc())))
    x = x.join(days.where(F.col("age") <= last_days).select(*keys, "day"), [*keys, "day"], "left_semi")
    p = F.expr("percentile(lfp, array(0.25, 0.5, 0.75))")
    daily = x.groupBy(*keys, "day").agg(p.alias("p"))
    pooled = x.groupBy(*keys).agg(p.alias("p"), F.count_distinct("day").alias("n_days"))
    steady = daily.groupBy(*keys).agg((100 * ratio(F.stddev_samp(F.get("p", 1)), F.avg(F.get("p", 1)))).alias("cv_percent"))
    return pooled.join(steady, keys).select(*keys, "n_days", *[F.get("p", i).alias(c) for i, c in enumerate(("p25", "p50", "p75"))], "cv_percent")


def causal_mean(series: DataFrame, window_s: float, keys: list[str] | None = None) -> DataFrame:
    """Mean of the samples of the last window_s seconds, the sample itself included; times count in rounded milliseconds."""
    keys = keys or KEYS
    w = Window.partitionBy(*keys).orderBy("ms").rangeBetween(-int(window_s * 1000) + 1, 0)
    return series.withColumn("ms", millis(F.col("t"))).withColumn("mean", F.avg("lfp").over(w))


def moving_days(series: DataFrame, days: float, keys: list[str] | None = None) -> DataFrame:
    """Centred mean of the samples within days / 2 to either side; times count in rounded milliseconds."""
    keys = keys or KEYS
    half = int(days * 86_400_000 / 2)
    w = Window.partitionBy(*keys).orderBy("ms").rangeBetween(-half, half)
    return series.withColumn("ms", millis(F.col("t"))).withColumn("mean", F.avg("lfp").over(w))
