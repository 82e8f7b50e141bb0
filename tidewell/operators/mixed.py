"""Rhythms with effects of days: a mixed cosinor with autocorrelated residuals, and a cyclic spline.

A day enters by sums of products of its design columns, its samples and the samples before them: from these, its normal
equations follow for any autocorrelation and any spread of days. Spark makes the sums, a day at a time; what is fitted
for a series reads one row for each of its days.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewell.functions.columns import local_day, local_hour

from .chronic import KEYS

#: Least days and samples of a series; knots of the cyclic spline.
LEAST_DAYS, LEAST_SAMPLES, KNOTS = 3, 24, 12


def day_sums(series: DataFrame, columns: list[Column], keys: list[str], offset: int, lagged: bool) -> DataFrame:
    """(keys, day, n, first, own, cross, before): sums of products, upper triangles row by row, of a = (1, columns, lfp): of each day's first sample, of
    its later ones, of those with the ones before them (both ways) and of the ones before. Without `lagged`, all samples count as first."""
    x = series.where("lfp is not null").select(*keys, "t", "row_ord", local_day(F.col("t"), offset).alias("day"), F.array(F.lit(1.0), *columns, F.col("lfp").cast("double")).alias("a"))
    before = F.lag("a").over(Window.partitionBy(*keys, "day").orderBy("t", "row_ord")) if lagged else F.lit(None).cast("array<double>")
    x = x.withColumn("b", before)
    m, a, b = len(columns) + 2, F.col("a"), F.col("b")
    pairs = [(i, j) for i in range(m) for j in range(i, m)]
    later = b.isNotNull()
    total = lambda f, when: F.array(*[F.coalesce(F.sum(F.when(when, f(i, j))), F.lit(0.0)) for i, j in pairs])
    sums = [F.count("*").alias("n"), total(lambda i, j: a[i] * a[j], ~later).alias("first")]
    if lagged:
        sums += [total(lambda i, j: a[i] * a[j], later).alias("own"), total(lambda i, j: a[i] * b[j] + b[i] * a[j], later).alias("cross"), total(lambda i, j: b[i] * b[j], later).alias("before")]
    return x.groupBy(*keys, "day").agg(*sums)


def squares(column: pd.Series) -> np.ndarray:
    """Symmetric matrices of the upper triangles in a column."""
    flat = np.stack([np.asarray(v, float) for v in column])
    m = int((math.isqrt(8 * flat.shape[1] + 1) - 1) // 2)
    out = np.zeros((len(flat), m, m))
    i, j = np.triu_indices(m)
    out[:, i, j] = out[:, j, i] = flat
    return out


class Days:
    """The days of one series."""

    def __init__(self, b: pd.DataFrame):
        self.n = b["n"].to_numpy(float)
        self.parts = [squares(b[c]) for c in ("first", "own", "cross", "before") if c in b]

    def products(self, phi: float = 0.0) -> np.ndarray:
        """Sums of products of each day after its autocorrelation is taken out."""
        if len(self.parts) == 1:
            return self.parts[0]
        first, own, cross, before = self.parts
        return (1 - phi**2) * first + own - phi * cross + phi**2 * before

    def solve(self, t: np.ndarray, spread: float, cols: slice, ridge: np.ndarray | float = 0.0):
        """(effects, their matrix without the ridge, residual sum, weights) where days vary with `spread` times the residual variance."""
        w = spread / (1 + spread * t[:, 0, 0])
        z, y = t[:, 0], t[:, -1]
        a = t[:, cols, cols].sum(axis=0) - np.einsum("d,di,dj->ij", w, z[:, cols], z[:, cols])
        g = y[:, cols].sum(axis=0) - np.einsum("d,di,d->i", w, z[:, cols], z[:, -1])
        c = y[:, -1].sum() - (w * z[:, -1] ** 2).sum()
        effects = np.linalg.solve(a + ridge, g)
        return effects, a, max(c - 2 * g @ effects + effects @ a @ effects, 1e-300), w

    def likelihood(self, spread: float, phi: float, cols: slice) -> float:
        """Restricted log likelihood, up to a constant."""
        t = self.products(phi)
        try:
            _, a, rest, _ = self.solve(t, spread, cols)
        except np.linalg.LinAlgError:
            return -math.inf
        sign, log_det = np.linalg.slogdet(a)
        free = self.n.sum() - a.shape[0]
        if sign <= 0 or free <= 0:
            return -math.inf
        return -0.5 * (free * math.log(rest / free) + np.log1p(spread * t[:, 0, 0]).sum() + log_det - len(self.n) * math.log(1 - phi**2))

    def best(self, cols: slice, correlated: bool) -> tuple[float, float]:
        """(spread, phi) of the greatest likelihood, on grids that close in on it."""
        spreads, phis = np.concatenate([[0.0], np.logspace(-4, 3, 22)]), np.linspace(-0.6, 0.96, 27) if correlated else np.zeros(1)
        for _ in range(9):
            _, s, p = max((self.likelihood(s, p, cols), s, p) for s in spreads for p in phis)
            i, j = int(np.argmin(np.abs(spreads - s))), int(np.argmin(np.abs(phis - p)))
            spreads = np.unique(np.append(np.linspace(spreads[max(i - 1, 0)], spreads[min(i + 1, len(spreads) - 1)], 7), s))
            if correlated:
                phis = np.unique(np.append(np.linspace(phis[max(j - 1, 0)], phis[min(j + 1, len(phis) - 1)], 7), p))
        return float(s), float(p)


def mixed_cosinor(series: DataFrame, keys: list[str] | None = None, periods: tuple[float, ...] = (24.0, 12.0), correlated: bool = True, offset: int = 0) -> DataFrame:
    """(keys, n, n_days, mesor, mesor_se, phi, sd_day, sd_residual, period, amplitude, acrophase_h, reason): waves of the given periods with a random
    effect of each day and residuals that follow the sample before in the day by phi, by restricted likelihood; a row for each period. A series of
    under three days or 24 samples, or whose equations are singular, has one row with a reason."""
    keys = keys or KEYS
    h = local_hour(F.col("t"), offset)
    waves = [f(h * (2 * math.pi / p)) for p in periods for f in (F.cos, F.sin)]
    days = day_sums(series, waves, keys, offset, correlated)
    names = [*keys, "n", "n_days", "mesor", "mesor_se", "phi", "sd_day", "sd_residual", "period", "amplitude", "acrophase_h", "reason"]

    def run(b: pd.DataFrame) -> pd.DataFrame:
        own = Days(b)
        head, n, d = [b[k].iloc[0] for k in keys], int(own.n.sum()), len(b)
        reason = "few_days" if d < LEAST_DAYS else "few_samples" if n < LEAST_SAMPLES else None
        cols = slice(0, 1 + 2 * len(periods))
        if reason is None and not np.isfinite(own.likelihood(0.0, 0.0, cols)):
            reason = "singular"
        if reason:
            return pd.DataFrame([[*head, n, d, *[None] * 8, reason]], columns=names)
        spread, phi = own.best(cols, correlated)
        effects, a, rest, _ = own.solve(own.products(phi), spread, cols)
        variance = rest / (n - len(effects))
        out = []
        for i, p in enumerate(periods):
            c, s = effects[1 + 2 * i : 3 + 2 * i]
            out.append([*head, n, d, effects[0], math.sqrt(variance * np.linalg.inv(a)[0, 0]), phi, math.sqrt(spread * variance), math.sqrt(variance / (1 - phi**2)), p, math.hypot(c, s), (math.atan2(s, c) / (2 * math.pi) * p) % p, None])
        return pd.DataFrame(out, columns=names)

    kinds = ", ".join(f"{k} {t}" for k, t in series.select(*keys).dtypes)
    return days.groupBy(*keys).applyInPandas(run, f"{kinds}, n long, n_days int, mesor double, mesor_se double, phi double, sd_day double, sd_residual double, period double, amplitude double, acrophase_h double, reason string")


def spline_column(hour: Column, j: int, knots: int = KNOTS) -> Column:
    """The j-th of the cubic splines on evenly spaced knots round the clock."""
    u = F.pmod(hour * (knots / 24.0) - j, F.lit(float(knots)))
    v, w, q = u - 1, u - 2, 4 - u
    return F.when(u < 1, u**3 / 6).when(u < 2, (1 + 3 * v + 3 * v**2 - 3 * v**3) / 6).when(u < 3, (4 - 6 * w**2 + 3 * w**3) / 6).when(u < 4, q**3 / 6).otherwise(0.0)


def spline_values(hours: np.ndarray, knots: int = KNOTS) -> np.ndarray:
    u = np.mod(hours[:, None] * (knots / 24.0) - np.arange(knots), knots)
    v, w = u - 1, u - 2
    return np.select([u < 1, u < 2, u < 3, u < 4], [u**3 / 6, (1 + 3 * v + 3 * v**2 - 3 * v**3) / 6, (4 - 6 * w**2 + 3 * w**3) / 6, (4 - u) ** 3 / 6], 0.0)


def cyclic_rhythm(series: DataFrame, keys: list[str] | None = None, offset: int = 0, step_h: float = 1.0) -> DataFrame:
    """(keys, n, n_days, edf, explained, sd_day, hour, fitted, reason): the mean day as a smooth curve of any shape that closes at midnight, with a random effect of
    each day; a row for each step of the clock.

    Splines are penalised by their second differences round the clock, with the weight of the least generalised cross-validation; the spread of days is that
    of the greatest restricted likelihood without a penalty. `explained` is the share of the samples' variance that curve and days explain. A series of under
    three days or 24 samples, or without samples at some knots, has one row with a reason.
    """
    keys = keys or KEYS
    h = local_hour(F.col("t"), offset)
    days = day_sums(series, [spline_column(h, j) for j in range(KNOTS)], keys, offset, False)
    names = [*keys, "n", "n_days", "edf", "explained", "sd_day", "hour", "fitted", "reason"]
    second = np.roll(np.eye(KNOTS), 1, axis=1) - 2 * np.eye(KNOTS) + np.roll(np.eye(KNOTS), -1, axis=1)
    hours = np.arange(0, 24, step_h)

    def run(b: pd.DataFrame) -> pd.DataFrame:
        own = Days(b)
        head, n, d = [b[k].iloc[0] for k in keys], int(own.n.sum()), len(b)
        cols = slice(1, 1 + KNOTS)
        reason = "few_days" if d < LEAST_DAYS else "few_samples" if n < LEAST_SAMPLES else None if np.isfinite(own.likelihood(0.0, 0.0, cols)) else "singular"
        if reason:
            return pd.DataFrame([[*head, n, d, *[None] * 5, reason]], columns=names)
        spread, _ = own.best(cols, False)
        t, fits = own.products(), []
        for weight in np.logspace(-4, 6, 41):
            effects, a, rest, w = own.solve(t, spread, cols, weight * second.T @ second)
            edf = np.trace(np.linalg.solve(a + weight * second.T @ second, a))
            fits.append((n * rest / (n - edf) ** 2, -weight, edf, effects, rest, w))
        _, _, edf, effects, rest, w = min(fits, key=lambda f: f[:2])
        miss = t[:, 0, -1] - t[:, 0, cols] @ effects  # sums of each day's residuals
        squared = t[:, -1, -1] - 2 * t[:, -1, cols] @ effects + np.einsum("i,dij,j->d", effects, t[:, cols, cols], effects)
        shift = w * miss
        left = (squared - 2 * shift * miss + own.n * shift**2).sum()
        whole = t[:, -1, -1].sum() - t[:, 0, -1].sum() ** 2 / n
        explained = 1 - left / whole if whole > 0 else None
        curve = spline_values(hours) @ effects
        return pd.DataFrame([[*head, n, d, edf, explained, math.sqrt(spread * rest / (n - edf)), x, v, None] for x, v in zip(hours, curve, strict=True)], columns=names)

    kinds = ", ".join(f"{k} {t}" for k, t in series.select(*keys).dtypes)
    return days.groupBy(*keys).applyInPandas(run, f"{kinds}, n long, n_days int, edf double, explained double, sd_day double, hour double, fitted double, reason string")
