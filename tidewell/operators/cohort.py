"""Cohorts and reliability: prevalence, intraclass correlation, agreement, paired designs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewell.functions.columns import ratio, wilson

from .ranges import by_ranges, running_sum, with_group


def prevalence(rows: DataFrame, group: str, flag: str) -> DataFrame:
    """How many of each group, and (group null) of all, have a flag, with the score interval; `descriptive` if under five."""
    out = rows.rollup(group).agg(F.count("*").alias("n"), F.count_if(flag).alias("k"))
    low, high = wilson(F.col("k"), F.col("n"))
    return out.select(group, "n", "k", ratio(F.col("k"), F.col("n")).alias("p"), low.alias("low"), high.alias("high"), (F.col("n") < 5).alias("descriptive"))


def icc(rows: DataFrame, subject: str, rater: str, value: str, by: list[str]) -> DataFrame:
    """ICC(2,1) and ICC(3,1) from sums of squares, over subjects that every rater of the group has; 3 x 2 at least."""
    cell = rows.groupBy(*by, subject, rater).agg(F.avg(value).alias("v")).where("v is not null")
    raters = cell.groupBy(*by).agg(F.count_distinct(rater).alias("k"))
    full = with_group(cell, raters, by, [subject]).withColumn("have", F.count("*").over(Window.partitionBy(*by, subject))).where("have = k")
    s = full.groupBy(*by, subject).agg(F.sum("v").alias("x")).groupBy(*by).agg(F.sum(F.col("x") ** 2).alias("ss_s"), F.count("*").alias("n"))
    r = full.groupBy(*by, rater).agg(F.sum("v").alias("x")).groupBy(*by).agg(F.sum(F.col("x") ** 2).alias("ss_r"), F.count("*").alias("k"))
    t = full.groupBy(*by).agg(F.sum("v").alias("x"), F.sum(F.col("v") ** 2).alias("xx"))
    m = s.join(r, by).join(t, by).where("n >= 3 and k >= 2")
    n, k = F.col("n").cast("double"), F.col("k").cast("double")
    base = F.col("x") ** 2 / (n * k)
    msr, msc = (F.col("ss_s") / k - base) / (n - 1), (F.col("ss_r") / n - base) / (k - 1)
    mse = (F.col("xx") - F.col("ss_s") / k - F.col("ss_r") / n + base) / ((n - 1) * (k - 1))
    m = m.withColumns({"msr": msr, "msc": msc, "mse": mse})
    a, b, c = F.col("msr"), F.col("msc"), F.col("mse")
    return m.select(*by, "n", "k", ratio(a - c, a + (k - 1) * c + k * (b - c) / n).alias("icc21"), ratio(a - c, a + (k - 1) * c).alias("icc31"))


def kappa(rows: DataFrame, a: str, b: str, least: int = 20) -> DataFrame:
    """Agreement of two binary columns beyond chance, with sensitivity and specificity of b for a; null under `least` rows."""
    x = rows.where(F.col(a).isNotNull() & F.col(b).isNotNull())
    m = x.agg(
        F.count("*").cast("double").alias("n"), F.count_if((F.col(a) == 1) & (F.col(b) == 1)).alias("tp"), F.count_if((F.col(a) == 0) & (F.col(b) == 0)).alias("tn"),
        F.count_if((F.col(a) == 0) & (F.col(b) == 1)).alias("fp"), F.count_if((F.col(a) == 1) & (F.col(b) == 0)).alias("fn"),
    )
    n, tp, tn, fp, fn = (F.col(c) for c in ("n", "tp", "tn", "fp", "fn"))
    po = ratio(tp + tn, n)
    pe = ratio((tp + fn) * (tp + fp) + (tn + fp) * (tn + fn), n * n)
    k = F.when(n >= least, ratio(po - pe, 1 - pe))
    return m.select(n.cast("long").alias("n"), "tp", "tn", "fp", "fn", k.alias("kappa"), ratio(tp, tp + fn).alias("sensitivity"), ratio(tn, tn + fp).alias("specificity"))


def mean_ranks(rows: DataFrame, value: str, by: list[str], name: str) -> DataFrame:
    """(by, value, name): the averaged rank of each value of a group. Counts of values are summed up over ranges of them: no task has a group."""
    n = rows.groupBy(*by, value).agg(F.count("*").alias("_n"))
    n = running_sum(by_ranges(n, by, [value]), by, [value], F.col("_n"), "_upto")
    return n.select(*by, value, (F.col("_upto") - (F.col("_n") - 1) / 2).alias(name))


def spearman(rows: DataFrame, x: str, y: str, by: list[str]) -> DataFrame:
    """Rank correlation with averaged ranks of ties, for each group."""
    r = rows.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(*by, x, y)
    r = r.join(mean_ranks(r, x, by, "rx"), [*by, x]).join(mean_ranks(r, y, by, "ry"), [*by, y])
    return r.groupBy(*by).agg(F.count("*").alias("n"), F.corr("rx", "ry").alias("rho"))


def histogram(rows: DataFrame, value: str, by: list[str], bins: int = 40) -> DataFrame:
    """Counts of equal bins from the least to the greatest value of each group, the last bin closed."""
    span = rows.where(F.col(value).isNotNull()).groupBy(*by).agg(F.min(value).alias("lo"), F.max(value).alias("hi"))
    at = F.coalesce(F.floor(ratio(F.col(value) - F.col("lo"), F.col("hi") - F.col("lo")) * bins), F.lit(0))
    x = rows.where(F.col(value).isNotNull()).join(span, by).withColumn("bin", F.least(at, F.lit(bins - 1)).cast("int"))
    return x.groupBy(*by, "bin").agg(F.count("*").alias("n"))


def ecdf(rows: DataFrame, value: str, by: list[str], order: str = "row_ord") -> DataFrame:
    """Sorted values of each group with their share i / n; ties keep their own places. Places are counted over ranges of values."""
    x = rows.where(F.col(value).isNotNull()).select(*by, order, value)
    placed = running_sum(by_ranges(x, by, [value, order]), by, [value, order], F.lit(1), "_i")
    n = x.groupBy(*by).agg(F.count("*").alias("_n"))
    return placed.join(n, by).select(*by, order, value, (F.col("_i") / F.col("_n")).alias("p"))


def bimodality(rows: DataFrame, value: str, by: list[str]) -> DataFrame:
    """Sarle's coefficient from moments about the mean; four values at least."""
    m = rows.where(F.col(value).isNotNull()).groupBy(*by).agg(F.count("*").cast("double").alias("n"), F.avg(value).alias("m"), F.stddev_samp(value).alias("s"))
    z = (F.col(value) - F.col("m")) / F.nullif(F.col("s"), F.lit(0.0))
    x = rows.where(F.col(value).isNotNull()).join(m.where("n >= 4"), by).groupBy(*by, "n").agg(F.avg(z**3).alias("g"), F.avg(z**4).alias("k"))
    n = F.col("n")
    bc = ratio(F.col("g") ** 2 + 1, F.col("k") - 3 + 3 * (n - 1) ** 2 / ((n - 2) * (n - 3)))
    return x.select(*by, n.cast("long").alias("n"), F.col("g").alias("skew"), (F.col("k") - 3).alias("excess"), bc.alias("bc"))


def latest(rows: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """The last row of each group."""
    rest = F.struct(*[c for c in rows.columns if c not in by])
    return rows.groupBy(*by).agg(F.max_by(rest, F.struct(*order)).alias("r")).select(*by, "r.*")


def survey_rank(spectra: DataFrame, low: float, high: float, by: list[str], item: str) -> DataFrame:
    """Rank of the items of a group by the power of their spectrum (f, p) within a closed band."""
    x = spectra.select(*by, item, F.explode(F.arrays_zip("f", "p")).alias("z")).where(F.col("z.f").between(low, high))
    area = x.groupBy(*by, item).agg(F.sum("z.p").alias("area"))
    return area.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(F.col("area").desc(), item)))
