"""Models fitted series by series: mixtures, change points and resampling.

Each series is a group of a grouped map. What goes in is pre-aggregated where the model allows it: days, not samples,
for change points and bootstraps; sorted values for mixtures. A refusal is a row with a reason, never a missing row.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewell.functions.columns import local_day, local_hour, ratio

from .chronic import KEYS

#: Fixed value: the seed of resampling.
SEED = 20240517


class Lcg:
    """Fixed generator of uniform numbers: s = 1664525 s + 1013904223 modulo 2 to the 32."""

    def __init__(self, seed: int = SEED):
        self.s = seed & 0xFFFFFFFF

    def __call__(self) -> float:
        self.s = (self.s * 1664525 + 1013904223) & 0xFFFFFFFF
        return self.s / 2**32


#: Most rounds of centres and of a mixture, the relative step of its likelihood at rest, the least variance; least waking samples,
#: the separation above which two components count, the percentiles that stand in for them.
CENTRE_TURNS, MIXTURE_TURNS, REST, LEAST_VARIANCE = 50, 300, 1e-9, 1e-8
LEAST_WAKING, LEAST_SEPARATION, STAND_INS = 30, 2.0, (0.3, 0.7)


class Counted:
    """Sorted values of a series with the number of samples of each."""

    def __init__(self, values: np.ndarray, counts: np.ndarray):
        order = np.argsort(values)
        self.x, self.n = np.asarray(values, float)[order], np.asarray(counts, float)[order]
        self.total = self.n.sum()
        self._upto = np.cumsum(self.n)

    def mean(self, weight: np.ndarray | float = 1.0) -> float:
        w = self.n * weight
        return float((w * self.x).sum() / w.sum())

    def quantile(self, p: float) -> float:
        at = p * (self.total - 1)
        low, high = (self.x[np.searchsorted(self._upto, i, "right")] for i in (math.floor(at), math.ceil(at)))
        return float(low + (at - math.floor(at)) * (high - low))

    def centres(self) -> tuple[float, float]:
        """Of two clusters, from the quartiles on; a value as near to both is the lower one's."""
        a, b = self.quantile(0.25), self.quantile(0.75)
        b = b if b > a else a + 1e-6
        for _ in range(CENTRE_TURNS):
            low = np.abs(self.x - a) <= np.abs(self.x - b)
            if low.all() or not low.any():
                break
            last, (a, b) = (a, b), (self.mean(low), self.mean(~low))
            if abs(a - last[0]) + abs(b - last[1]) < 1e-10:
                break
        return min(a, b), max(a, b)


def log_normal(x: np.ndarray, mean: np.ndarray, var: np.ndarray) -> np.ndarray:
    return -0.5 * (np.log(2 * np.pi * var) + (x[:, None] - mean) ** 2 / var)


def one_normal(c: Counted) -> float:
    """The BIC of one component."""
    mean = c.mean()
    var = max(LEAST_VARIANCE, float((c.n * (c.x - mean) ** 2).sum() / c.total))
    return -2 * float((c.n * log_normal(c.x, np.array([mean]), np.array([var]))[:, 0]).sum()) + 2 * math.log(c.total)


def two_normals(c: Counted) -> dict:
    """Two components by expectation maximisation from the clusters' centres, in the order of their means, with the BIC."""
    mean, weight = np.array(c.centres()), np.array([0.5, 0.5])
    var = np.full(2, max(1e-6, (c.quantile(0.75) - c.quantile(0.25)) ** 2 / 8))
    last = -math.inf
    for _ in range(MIXTURE_TURNS):
        each = np.log(weight) + log_normal(c.x, mean, var)
        top = each.max(axis=1)
        both = top + np.log(np.exp(each - top[:, None]).sum(axis=1))
        now = float((c.n * both).sum())
        share = c.n[:, None] * np.exp(each - both[:, None])
        mass = share.sum(axis=0)
        if (mass < 1e-6).any():
            break
        mean = share.T @ c.x / mass
        var = np.maximum(LEAST_VARIANCE, (share * (c.x[:, None] - mean) ** 2).sum(axis=0) / mass)
        weight = mass / c.total
        rest, last = abs(now - last) < REST * abs(now), now
        if rest:
            break
    order = np.argsort(mean, kind="stable")
    return {"mean": mean[order], "sd": np.sqrt(var[order]), "weight": weight[order], "bic": -2 * last + 5 * math.log(c.total)}


def crossing(g: dict) -> float | None:
    """Where the weighted densities of two components are equal, between their means: a root of the difference of their logarithms, a parabola."""
    (m1, m2), (s1, s2), (w1, w2) = g["mean"], g["sd"], g["weight"]
    p, q = 0.5 / s1**2, 0.5 / s2**2
    roots = np.roots([q - p, 2 * (p * m1 - q * m2), q * m2**2 - p * m1**2 + math.log(w1 * s2 / (w2 * s1))])
    inside = [float(r.real) for r in roots if abs(r.imag) < 1e-9 and m1 < r.real < m2]
    return min(inside) if inside else None


def thresholds(c: Counted) -> tuple[str, float, float, float, float]:
    """(method, lower, upper, separation, BIC gain) proposed for log10 powers: from two components where they fit better and lie
    apart, else from percentiles."""
    two = two_normals(c)
    apart = math.sqrt(2) * abs(two["mean"][1] - two["mean"][0]) / math.hypot(*two["sd"])
    gain = one_normal(c) - two["bic"]
    method = "percentile"
    if gain > 0 and apart > LEAST_SEPARATION:
        lower, upper = float(two["mean"][0] + 0.5 * two["sd"][0]), crossing(two)
        if upper is not None and lower < upper:
            return "bimodal", lower, upper, apart, gain
        method = "percentile_without_crossing"
    return method, c.quantile(STAND_INS[0]), c.quantile(STAND_INS[1]), apart, gain


def propose_thresholds(series: DataFrame, keys: list[str] | None = None, least: int = LEAST_WAKING) -> DataFrame:
    """(keys, n, method, lower, upper, lower_log, upper_log, separation, bic_gain, reason) of the waking samples of each series: limits in whole units of
    power, at least one apart, from log10(1 + lfp).

    Equal values are counted together: what a task holds of a series is its different values, of which a device's resolution leaves at most some
    tens of thousands, however long the series is.
    """
    keys = keys or KEYS
    counts = series.where("lfp is not null").groupBy(*keys, "lfp").agg(F.count("*").alias("k"))
    x = counts.groupBy(*keys).agg(F.sum("k").alias("n"), F.collect_list(F.struct(F.log10(1 + F.col("lfp")).alias("v"), "k")).alias("c"))
    x = x.select(*keys, "n", F.col("c.v").alias("v"), F.col("c.k").alias("k"))

    def run(batches):
        for b in batches:
            out = []
            for r in b.itertuples(index=False):
                head = [*[getattr(r, k) for k in keys], r.n]
                if r.n < least or len(r.v) < 2:
                    out.append([*head, *[None] * 7, "too_few" if r.n < least else "constant"])
                    continue
                m, lo, hi, apart, gain = thresholds(Counted(np.asarray(r.v), np.asarray(r.k)))
                lower, upper = (float(max(0, math.floor(10**v - 1 + 0.5))) for v in (lo, hi))
                out.append([*head, m, lower, max(upper, lower + 1), lo, hi, apart, gain, None])
            yield pd.DataFrame(out, columns=names)

    names = [*keys, "n", "method", "lower", "upper", "lower_log", "upper_log", "separation", "bic_gain", "reason"]
    kinds = ", ".join(f"{k} {t}" for k, t in series.select(*keys).dtypes)
    return x.mapInPandas(run, f"{kinds}, n long, method string, lower double, upper double, lower_log double, upper_log double, separation double, bic_gain double, reason string")


def cut_points(y: np.ndarray, least: int = 3, permutations: int = 500, alpha: float = 0.05, most: int = 8, seed: int = SEED) -> list[tuple[int, float, float]]:
    """(index, p, difference) where the mean of a sequence changes: the strongest split of a stretch is kept if shuffles
    seldom match it, and both sides are split again."""

    def best(v: np.ndarray) -> tuple[int, float]:
        n = len(v)
        k = np.arange(least, n - least + 1)
        c, cc = np.cumsum(v), np.cumsum(v**2)
        a, b = c[k - 1] / k, (c[-1] - c[k - 1]) / (n - k)
        within = (cc[k - 1] - k * a**2) + (cc[-1] - cc[k - 1] - (n - k) * b**2)
        stat = np.abs(a - b) / np.sqrt(np.maximum(within / max(1, n - 2), 1e-12) * (1 / k + 1 / (n - k)))
        i = int(np.argmax(stat))
        return int(k[i]), float(stat[i])

    rng, found, todo = np.random.default_rng(seed), [], [(0, len(y))]
    while todo and len(found) < most:
        a, z = todo.pop(0)
        if z - a < 2 * least:
            continue
        at, stat = best(y[a:z])
        beaten = sum(best(rng.permutation(y[a:z]))[1] >= stat for _ in range(permutations))
        p = (1 + beaten) / (permutations + 1)
        if p < alpha:
            found.append((a + at, p, float(y[a + at : z].mean() - y[a : a + at].mean())))
            todo += [(a, a + at), (a + at, z)]
    return sorted(found)


def change_points(series: DataFrame, keys: list[str] | None = None, least_days: int = 6, offset: int = 0) -> DataFrame:
    """(keys, day, p, difference) of the days on which the daily median changes; a row with a reason for too short series."""
    keys = keys or KEYS
    days = series.where("lfp is not null").groupBy(*keys, local_day(F.col("t"), offset).alias("day")).agg(F.expr("percentile(lfp, 0.5)").alias("v"))

    def run(b: pd.DataFrame) -> pd.DataFrame:
        b = b.sort_values("day")
        head = [b[k].iloc[0] for k in keys]
        if len(b) < least_days:
            return pd.DataFrame([[*head, None, None, None, "too_few_days"]], columns=names)
        rows = [[*head, b["day"].iloc[i], p, d, None] for i, p, d in cut_points(b["v"].to_numpy())]
        return pd.DataFrame(rows or [[*head, None, None, None, "none_found"]], columns=names)

    names = [*keys, "day", "p", "difference", "reason"]
    kinds = ", ".join(f"{k} {t}" for k, t in series.select(*keys).dtypes)
    return days.groupBy(*keys).applyInPandas(run, f"{kinds}, day date, p double, difference double, reason string")


def cosinor_bootstrap(series: DataFrame, keys: list[str] | None = None, replicas: int = 200, period: float = 24.0, offset: int = 0) -> DataFrame:
    """Intervals of MESOR and amplitude by resampling whole days: the days' normal equations are summed in Spark, and a
    replica adds those of its days up again; three days at least."""
    keys = keys or KEYS
    a = local_hour(F.col("t"), offset) * (2 * math.pi / period)
    x = series.where("lfp is not null").select(*keys, local_day(F.col("t"), offset).alias("day"), F.cos(a).alias("c"), F.sin(a).alias("s"), F.col("lfp").alias("y"))
    parts = {"n": "1.0D", "c": "c", "s": "s", "cc": "c * c", "cs": "c * s", "ss": "s * s", "y": "y", "cy": "c * y", "sy": "s * y"}
    days = x.groupBy(*keys, "day").agg(*[F.sum(F.expr(e)).alias(f"g_{k}") for k, e in parts.items()])

    def run(b: pd.DataFrame) -> pd.DataFrame:
        b = b.sort_values("day")
        head, g, n = [b[k].iloc[0] for k in keys], b[[f"g_{k}" for k in parts]].to_numpy(), len(b)
        if n < 3:
            return pd.DataFrame([[*head, n, *[None] * 4]], columns=names)
        draw = Lcg()
        picks = np.array([[int(draw() * n) for _ in range(n)] for _ in range(replicas)])
        t = g[picks].sum(axis=1)
        gram = np.stack([t[:, [0, 1, 2]], t[:, [1, 3, 4]], t[:, [2, 4, 5]]], axis=1)
        good = np.abs(np.linalg.det(gram)) > 1e-9
        beta = np.linalg.solve(gram[good], t[good][:, 6:9, None])[:, :, 0]
        amp = np.hypot(beta[:, 1], beta[:, 2])
        return pd.DataFrame([[*head, n, *np.quantile(beta[:, 0], [0.025, 0.975]), *np.quantile(amp, [0.025, 0.975])]], columns=names)

    names = [*keys, "n_days", "mesor_low", "mesor_high", "amplitude_low", "amplitude_high"]
    kinds = ", ".join(f"{k} {t}" for k, t in series.select(*keys).dtypes)
    return days.groupBy(*keys).applyInPandas(run, f"{kinds}, n_days int, mesor_low double, mesor_high double, amplitude_low double, amplitude_high double")


def permutation_test(rows: DataFrame, group: str, value: str, by: list[str], permutations: int = 2000, exact_up_to: int = 30_000) -> DataFrame:
    """(by, n_a, n_b, difference, p, exact): difference of the means of two groups (false, true) against regroupings: all of them
    where there are few, else seeded shuffles."""
    x = rows.where(F.col(value).isNotNull() & F.col(group).isNotNull()).select(*by, F.col(group).cast("boolean").alias("g"), F.col(value).cast("double").alias("v"))

    def run(b: pd.DataFrame) -> pd.DataFrame:
        import itertools

        head, v = [b[k].iloc[0] for k in by], np.sort(b.loc[~b["g"], "v"].to_numpy())
        w = np.sort(b.loc[b["g"], "v"].to_numpy())
        n, m = len(v), len(w)
        if n < 2 or m < 2:
            return pd.DataFrame([[*head, n, m, None, None, None]], columns=names)
        every, seen = np.concatenate([v, w]), float(w.mean() - v.mean())
        exact = math.comb(n + m, n) <= exact_up_to
        if exact:
            picks = np.array(list(itertools.combinations(range(n + m), n)))
        else:
            rng = np.random.default_rng(SEED)
            picks = np.array([rng.permutation(n + m)[:n] for _ in range(permutations)])
        a = every[picks].sum(axis=1)
        diff = (every.sum() - a) / m - a / n
        hits = int((np.abs(diff) >= abs(seen) - 1e-12).sum())
        return pd.DataFrame([[*head, n, m, seen, hits / len(picks) if exact else (hits + 1) / (len(picks) + 1), exact]], columns=names)

    names = [*by, "n_a", "n_b", "difference", "p", "exact"]
    kinds = ", ".join(f"{k} {t}" for k, t in rows.select(*by).dtypes)
    return x.groupBy(*by).applyInPandas(run, f"{kinds}, n_a long, n_b long, difference double, p double, exact boolean")
