"""Tail probabilities, waking hours, clusters and coherence against brute force and planted truth."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidewell.functions import distributions as dist
from tidewell.operators import clusters, signal, wake


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


@pytest.mark.parametrize("x", [0.05, 0.5, 1.0, 2.5, 7.0, 60.5, 4000.0])
def test_log_gamma(spark, x):
    assert math.isclose(one(spark, dist.log_gamma(F.lit(x))), math.lgamma(x), rel_tol=1e-10, abs_tol=1e-10)


@pytest.mark.parametrize(("f", "d1", "d2"), [(3.0, 2, 20), (0.4, 2, 5), (2.5, 4, 33), (1.1, 7, 2), (8.0, 1, 900)])
def test_f_p_value(spark, f, d1, d2):
    grid = np.linspace(-40, math.log(f), 400_001)  # of the density over the logarithm
    log_density = (d1 / 2) * (math.log(d1 / d2) + grid) - ((d1 + d2) / 2) * np.log1p(d1 / d2 * np.exp(grid)) - (math.lgamma(d1 / 2) + math.lgamma(d2 / 2) - math.lgamma((d1 + d2) / 2))
    want = 1 - np.trapezoid(np.exp(log_density), grid)
    got = one(spark, dist.f_p_value(F.lit(f), F.lit(d1), F.lit(d2)))
    assert math.isclose(got, want, abs_tol=1e-7)
    if d1 == 2:
        assert math.isclose(got, (1 + 2 * f / d2) ** (-d2 / 2), rel_tol=1e-9)


def test_t_and_normal(spark):
    assert math.isclose(one(spark, dist.t_p_value(F.lit(2.228138852), F.lit(10))), 0.05, abs_tol=1e-8)
    for z in (-3.0, 0.0, 0.7, 4.5, 9.0):
        assert math.isclose(one(spark, dist.erf(F.lit(z))), math.erf(z), abs_tol=1e-9)
    assert math.isclose(one(spark, dist.normal_cdf(F.lit(1.959964))), 0.975, abs_tol=1e-7)
    assert one(spark, dist.f_p_value(F.lit(1.0), F.lit(0), F.lit(5))) is None


def test_wake_window(spark):
    """A step at 7 and one at 23 hours are found; a flat series falls back; few samples too."""
    rng = np.random.default_rng(3)
    t = pd.date_range("2024-03-01", periods=144 * 6, freq="10min")
    hour = np.asarray(t.hour + t.minute / 60)
    awake = (hour >= 7) & (hour < 23)
    parts = {1: 100 + 60 * awake + rng.normal(0, 3, len(t)), 2: rng.normal(100, 5, len(t))}
    x = pd.concat([pd.DataFrame({"subject": s, "hemisphere": "Left", "t": t, "lfp": v}) for s, v in parts.items()] + [pd.DataFrame({"subject": 3, "hemisphere": "Left", "t": t[:4], "lfp": 1.0})])
    got = wake.wake_window(spark.createDataFrame(x)).toPandas().set_index("subject")
    assert (got.loc[1, "wake_begin"], got.loc[1, "wake_end"], got.loc[1, "method"]) == (7.0, 23.0, "rhythm")
    for s in (2, 3):
        assert (got.loc[s, "wake_begin"], got.loc[s, "wake_end"]) == wake.FIXED
    a = 2 * np.pi * hour / 24
    design = np.stack([np.ones(len(t)), np.cos(a), np.sin(a), np.cos(2 * a), np.sin(2 * a)], 1)
    rest = parts[1] - design @ np.linalg.lstsq(design, parts[1], rcond=None)[0]
    assert math.isclose(got.loc[1, "r2"], 1 - rest.var() / parts[1].var(), abs_tol=1e-9)
    kept = wake.in_wake(spark.createDataFrame(x).where("subject = 1"), wake.wake_window(spark.createDataFrame(x))).count()
    assert kept == int(awake.sum())
    assert wake.wake_window(spark.createDataFrame(x).where("false")).count() == 0


def test_clusters(spark):
    """A planted difference at points 5 to 9 comes out as one run with a small p; noise gives none."""
    rng = np.random.default_rng(5)
    d = rng.normal(0, 1, (24, 20))
    d[:, 5:10] += 2.5
    curves = {"planted": d, "noise": rng.normal(0, 1, (24, 20))}
    rows = pd.DataFrame([(s, i, p, float(c[i, p])) for s, c in curves.items() for i in range(24) for p in range(20)], columns=["study", "trial", "point", "d"])
    got = clusters.cluster_test(spark.createDataFrame(rows), ["study"], 199, 2.0).toPandas()
    hit = got[(got["study"] == "planted") & (got["p"] < 0.05)]
    assert [(int(r["first"]), int(r["last"])) for _, r in hit.iterrows()] == [(5, 9)]
    assert not (got[got["study"] == "noise"]["p"] < 0.01).any()
    t = d.mean(0) / (d.std(0, ddof=1) / math.sqrt(24))
    assert math.isclose(hit["mass"].iloc[0], t[5:10].sum(), rel_tol=1e-9)


def test_coherence(spark):
    """A shared 10 Hz wave is significant, independent noise is not; missing samples cost segments only."""
    rng = np.random.default_rng(11)
    t = np.arange(250 * 40) / 250
    wave = np.sin(2 * np.pi * 10 * t)
    a, b = (wave + rng.normal(0, 1, len(t)) for _ in range(2))
    a[1000:1010] = math.nan
    rows = [("shared", a.tolist(), b.tolist(), 250.0), ("apart", rng.normal(0, 1, len(t)).tolist(), rng.normal(0, 1, len(t)).tolist(), 250.0), ("short", [1.0] * 10, [1.0] * 10, 250.0)]
    pairs = spark.createDataFrame(rows, "rec string, a array<double>, b array<double>, fs double")
    got = signal.coherence_rows(pairs, {"alpha": (8, 12)}).toPandas().set_index("rec")
    assert got.loc["shared", "significant"] and got.loc["shared", "peak_hz"] == 10 and got.loc["shared", "peak"] > 0.9
    assert got.loc["apart", "significant"] is False or not got.loc["apart", "significant"]
    assert pd.isna(got.loc["short", "peak"])
