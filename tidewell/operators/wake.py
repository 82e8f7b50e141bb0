"""Waking hours of a series from its own rhythm, without a movement sensor.

A constant and waves of 24 and 12 hours are fitted to all samples. The longest stretch of the clock over the
constant is the first guess; each of its ends then moves to the best single step of the mean day within three hours.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewell.functions.columns import local_hour

from .chronic import KEYS

#: Bins of the mean day: ten minutes each.
BINS = 144
#: Bins to either side of an end that are looked at.
REACH = 18
#: The window where the rhythm is too weak, and the share of variance under which it is.
FIXED, LEAST_R2 = (8.0, 22.0), 0.1


def two_waves(series: DataFrame, keys: list[str] | None = None, offset: int = 0) -> DataFrame:
    """(keys, n, yy, g, r): the sums of the normal equations of a constant, cos and sin of 24 hours and of 12 hours, g in rows,
    r of lfp. They aggregate before the shuffle: 21 numbers a series, however long."""
    keys = keys or KEYS
    a = local_hour(F.col("t"), offset) * (2 * math.pi / 24)
    waves = [F.lit(1.0), F.cos(a), F.sin(a), F.cos(2 * a), F.sin(2 * a)]
    x = series.where("lfp is not null").select(*keys, F.col("lfp").alias("y"), *[w.alias(f"w{i}") for i, w in enumerate(waves)])
    pairs = [(i, j) for i in range(5) for j in range(i, 5)]
    sums = [F.sum(F.col(f"w{i}") * F.col(f"w{j}")).alias(f"g{i}{j}") for i, j in pairs] + [F.sum(F.col(f"w{i}") * F.col("y")).alias(f"r{i}") for i in range(5)]
    m = x.groupBy(*keys).agg(F.count("*").alias("n"), F.sum(F.col("y") ** 2).alias("yy"), *sums)
    g = F.array(*[F.col(f"g{min(i, j)}{max(i, j)}") for i in range(5) for j in range(5)])
    return m.select(*keys, "n", "yy", g.alias("g"), F.array(*[F.col(f"r{i}") for i in range(5)]).alias("r"))


def solve(n: int, yy: float, g: np.ndarray, r: np.ndarray) -> tuple[np.ndarray, float] | None:
    """(coefficients, R²) of the sums of two_waves; None for under six samples or a singular system."""
    g, r = np.asarray(g, float).reshape(5, 5), np.asarray(r, float)
    if n < 6 or np.linalg.cond(g) > 1e12:
        return None
    b = np.linalg.solve(g, r)
    mean = r[0] / n
    total = yy - n * mean * mean
    return b, float((b @ r - n * mean * mean) / total) if total > 0 else math.nan


def best_step(v: np.ndarray) -> int:
    """Where one step cuts the values into two of least squared rest, two at least to each side; -1 where the
    Bayesian criterion, with two more parameters, does not favour it over none."""
    n = len(v)
    if n < 6:
        return -1
    at = np.arange(2, n - 1)
    s, q = np.cumsum(v)[at - 1], np.cumsum(v * v)
    rest = q[-1] - s * s / at - (v.sum() - s) ** 2 / (n - at)
    i = int(np.argmin(rest))
    none, one = (max(float(x), 1e-12) for x in (q[-1] - v.sum() ** 2 / n, rest[i]))
    return int(at[i]) if n * math.log(one / n) + 2 * math.log(n) < n * math.log(none / n) else -1


def window(fit: tuple[np.ndarray, float] | None, profile: np.ndarray) -> tuple[float, float, str]:
    """(begin, end, method) in hours of the clock, from a fit and the means of BINS bins (NaN where empty)."""
    if fit is None or not fit[1] >= LEAST_R2:
        return *FIXED, "fixed: weak rhythm"
    a = (np.arange(BINS) + 0.5) * (2 * math.pi / BINS)
    over = fit[0][1:] @ np.stack([np.cos(a), np.sin(a), np.cos(2 * a), np.sin(2 * a)]) > 0
    if over.all() or not over.any():
        return *FIXED, "fixed: no trough"
    starts = np.flatnonzero(over & ~np.roll(over, 1))
    lengths = [int(np.argmin(np.roll(over, -s))) for s in starts]
    k = int(np.argmax(lengths))

    def moved(end: int) -> float:
        v = profile[np.arange(end - REACH, end + REACH + 1) % BINS]
        i = best_step(v[np.isfinite(v)])
        return (end if i < 0 else end - REACH + i) % BINS / 6

    return round(moved(int(starts[k])), 2), round(moved(int(starts[k] + lengths[k]) % BINS), 2), "rhythm"


def wake_window(series: DataFrame, keys: list[str] | None = None, offset: int = 0) -> DataFrame:
    """(keys, n, r2, wake_begin, wake_end, method): the waking hours of each series. What reaches Python is one row a series:
    the sums of the fit and at most BINS means."""
    keys = keys or KEYS
    hour = local_hour(F.col("t"), offset)
    bins = series.where("lfp is not null").groupBy(*keys, F.least(F.floor(hour * 6), F.lit(BINS - 1)).cast("int").alias("bin")).agg(F.avg("lfp").alias("v"))
    day = bins.groupBy(*keys).agg(F.collect_list(F.struct("bin", "v")).alias("day"))
    kinds = dict(series.dtypes)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for row in b.itertuples(index=False):
                profile = np.full(BINS, math.nan)
                for cell in row.day:
                    profile[cell["bin"]] = cell["v"]
                fit = solve(row.n, row.yy, row.g, row.r)
                out.append((fit[1] if fit else None, *window(fit, profile)))
            yield pd.concat([b[[*keys, "n"]].reset_index(drop=True), pd.DataFrame(out, columns=["r2", "wake_begin", "wake_end", "method"])], axis=1)

    schema = ", ".join(f"`{k}` {kinds[k]}" for k in keys) + ", n long, r2 double, wake_begin double, wake_end double, method string"
    return two_waves(series, keys, offset).join(day, keys).mapInPandas(run, schema)


def in_wake(series: DataFrame, windows: DataFrame, keys: list[str] | None = None, offset: int = 0) -> DataFrame:
    """The samples within their series' waking hours, over midnight where the end comes first."""
    keys = keys or KEYS
    w = windows.select(*keys, "wake_begin", "wake_end")
    h, a, z = local_hour(F.col("t"), offset), F.col("wake_begin"), F.col("wake_end")
    inside = F.when(a < z, (h >= a) & (h < z)).otherwise((h >= a) | (h < z))
    return series.join(w, keys).where(inside).drop("wake_begin", "wake_end")

