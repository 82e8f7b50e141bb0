"""Scans over ranges of rows, controllers, states and alignments against versions that go sample by sample."""

from __future__ import annotations

import math
from datetime import datetime, timedelta, timezone

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewell.operators import align, controller, ranges, rhythm, states

T0 = datetime(2024, 3, 1, tzinfo=timezone.utc)
SERIES = "subject long, hemisphere string, t timestamp, row_ord long, lfp double"
KEYS = ["subject", "hemisphere"]


def series(spark, values: dict, step_s=600):
    """values: (subject, hemisphere) -> list of (seconds or None for even steps, lfp)."""
    rows = []
    for (s, h), xs in values.items():
        for i, x in enumerate(xs):
            at, v = x if isinstance(x, tuple) else (i * step_s, x)
            rows.append((s, h, T0 + timedelta(seconds=float(at)), i, None if v is None else float(v)))
    return spark.createDataFrame(rows, SERIES).repartition(3)


def limit_rows(spark, rows):
    return spark.createDataFrame(rows, "subject long, hemisphere string, cell int, lower double, upper double")


# --- ranges


def test_ranges(spark):
    rng = np.random.default_rng(1)
    rows = [(int(k), int(i), None if rng.random() < 0.4 else int(rng.integers(5))) for k, n in ((0, 200), (1, 1), (2, 37)) for i in range(n)]
    r = ranges.by_ranges(spark.createDataFrame(rows, "k long, i long, v long"), ["k"], ["i"], 6)
    assert r.select("_part").distinct().count() > 3
    r = ranges.previous(r, ["k"], ["i"], F.col("v"), "prev")
    r = ranges.running_sum(r, ["k"], ["i"], F.coalesce("v", F.lit(0)), "total")
    r = ranges.filled(r, ["k"], ["i"], F.col("v"), "fill")
    r = ranges.runs(r, ["k"], ["i"], F.col("v"), "run")
    got = {(x["k"], x["i"]): (x["prev"], x["total"], x["fill"], x["run"]) for x in r.collect()}
    for k in (0, 1, 2):
        prev, total, fill, run = None, 0, None, 0
        for i, (_, _, v) in enumerate(x for x in rows if x[0] == k):
            total += v or 0
            fill = fill if v is None else v
            run += i == 0 or v != prev
            assert got[k, i] == (prev, total, fill, run)
            prev = v


# --- controllers


def stepwise(values, lower, upper, least=0.0, most=3.0, step=0.1):
    level, out = (least + most) / 2, []
    for v in values:
        if v > upper:
            level = min(most, round(level + step, 4))
        elif v < lower:
            level = max(least, round(level - step, 4))
        out.append(level)
    return out


def measures(values, lower, upper, **more):
    levels = stepwise(values, lower, upper, **more)
    n = len(values)
    below, above = sum(v < lower for v in values), sum(v > upper for v in values)
    low, high = sum(x <= more.get("least", 0.0) + 1e-9 for x in levels), sum(x >= more.get("most", 3.0) - 1e-9 for x in levels)
    return [100 * below / n, 100 * (n - below - above) / n, 100 * above / n, 100 * low / n, 100 * high / n, 100 * (low + high) / n, sum(levels) / n]


@pytest.mark.parametrize("parts", [1, 9])
def test_stepwise_controller(spark, parts):
    rng = np.random.default_rng(2)
    values = {(1, "Left"): list(rng.normal(40, 12, 300)), (1, "Right"): [50.0] * 20 + [10.0] * 20, (2, "Left"): [42.0], (3, "Left"): [None, 90.0, None]}
    cells = [(1, "Left", c, 30.0 + c, 45.0 + c) for c in range(5)] + [(1, "Right", 0, 20.0, 40.0), (2, "Left", 7, 41.0, 43.0), (1, "Left", 9, 50.0, 50.0), (3, "Left", 0, 1.0, 2.0)]
    got = controller.simulate_controller(series(spark, values), limit_rows(spark, cells), parts=parts).collect()
    assert len(got) == 8
    names = ["pct_below", "pct_within", "pct_above", "pct_sat_low", "pct_sat_high", "pct_saturated", "mean_current"]
    for r in got:
        v = [x for x in values[r["subject"], r["hemisphere"]] if x is not None]
        want = measures(v, r["lower"], r["upper"])
        assert [r[c] for c in names] == pytest.approx(want)
        assert r["accepted"] == (10 <= want[0] <= 35 and 45 <= want[1] <= 75 and 10 <= want[2] <= 35)
    # worked by hand: 15 steps reach the upper limit, six samples stay there; 20 steps down from 3 mA end at 1 mA
    assert [(r["pct_sat_high"], r["pct_sat_low"]) for r in got if r["hemisphere"] == "Right"] == [(15.0, 0.0)]
    levels = controller.step_levels(series(spark, values), limit_rows(spark, cells[:1]), parts=parts).orderBy("t").collect()
    assert [r["current"] for r in levels] == pytest.approx(stepwise(values[1, "Left"], 30.0, 45.0))


def test_saturation_counts_samples_at_a_limit(spark):
    """Thirty samples above from the middle of a range of one mA: five steps, then 26 samples at the limit."""
    x = series(spark, {(1, "Left"): [9.0] * 30})
    r = controller.simulate_controller(x, limit_rows(spark, [(1, "Left", 0, 1.0, 2.0)]), least=1.0, most=2.0, parts=4).first()
    assert (r["pct_saturated"], r["pct_above"], r["accepted"]) == (pytest.approx(100 * 26 / 30), 100.0, False)
    with pytest.raises(ValueError):
        controller.Steps(0.0, 3.0, 4.0, 0.1)


def test_tuning(spark):
    rng = np.random.default_rng(3)
    values = {(1, "Left"): list(rng.gamma(9, 5, 400)), (2, "Right"): list(rng.normal(60, 5, 50))}
    base = {(1, "Left"): (30.4, 55.2), (2, "Right"): (57.0, 63.0)}
    limits = limit_rows(spark, [(*k, 0, *v) for k, v in base.items()]).drop("cell")
    got = {(r["subject"], r["hemisphere"]): r for r in controller.tune_limits(series(spark, values), limits, parts=5).collect()}
    for k, (lower, upper) in base.items():
        cost = lambda m: abs(m[0] - 20) + abs(m[1] - 60) + abs(m[2] - 20) + 0.5 * m[5]
        best = first = cost(measures(values[k], lower, upper))
        pair = (lower, upper)
        for a in range(-15, 16):
            for b in range(-15, 16):
                lo, hi = math.floor(lower * (100 + a) / 100 + 0.5), math.floor(upper * (100 + b) / 100 + 0.5)
                c = cost(measures(values[k], lo, hi)) if hi > lo else math.inf
                if c < best - 1e-9:
                    best, pair = c, (lo, hi)
        r = got[k]
        assert (r["lower"], r["upper"]) == pair and r["cost"] == pytest.approx(best) and r["base_cost"] == pytest.approx(first) and r["improved"] == (best < first)


def ramp_by_hand(rows, lower, upper, least, most, window_s, rate, single):
    out, level = [], None
    for i, (s, _) in enumerate(rows):
        inside = [v for t, v in rows[: i + 1] if s - t <= window_s]
        m = sum(inside) / len(inside)
        share = float(m > upper) if single else min(1.0, max(0.0, (m - lower) / (upper - lower)))
        target = most if share >= 1 else least + share * (most - least)
        reach = rate * (s - rows[i - 1][0]) if i else math.inf
        level = target if level is None else level + min(reach, max(-reach, target - level))
        out.append(level)
    return out


@pytest.mark.parametrize(("single", "rate"), [(False, 0.002), (True, 0.002), (False, 1e-6)])
def test_ramp_controller(spark, single, rate):
    rng = np.random.default_rng(4)
    times = np.cumsum(rng.integers(20, 200, 150))
    rows = [(float(t), float(v)) for t, v in zip(times, rng.normal(40, 15, 150), strict=True)]
    values = {(1, "Left"): rows, (2, "Left"): rows[:7], (3, "Left"): rows[:8]}
    cells = [(s, "Left", c, 30.0, 40.0 + 10 * c) for s in (1, 2, 3) for c in (0, 1)]
    more = {"least": 1.0, "most": 3.0, "window_ms": 300_000, "rate": rate, "single": single, "parts": 7}
    found = controller.simulate_ramp(series(spark, values), limit_rows(spark, cells), **more).collect()
    swept = {(r["subject"], r["cell"]): r for r in controller.limit_sweep(series(spark, values), limit_rows(spark, cells), **more).collect()}
    assert {(r["subject"], r["cell"]) for r in found} == {(1, 0), (1, 1), (3, 0), (3, 1)} == set(swept)
    for r in found:
        own = values[r["subject"], "Left"]
        c = ramp_by_hand(own, r["lower"], r["upper"], 1.0, 3.0, 300, rate, single)
        z = ["high" if x >= 3 - 1e-9 else "low" if x <= 1 + 1e-9 else "middle" for x in c]
        begins = [i for i in range(len(z)) if i == 0 or z[i] != z[i - 1]]
        spans = {"high": [], "low": [], "middle": []}
        for i, j in zip(begins, [*begins[1:], len(z) - 1], strict=True):
            spans[z[i]].append((own[j][0] - own[i][0]) / 60)
        middle = lambda s: np.median([m for m in spans[s] if m > 0]) if any(m > 0 for m in spans[s]) else None  # noqa: E731,B023
        n = len(c)
        want = [n, 100 * z.count("low") / n, 100 * z.count("middle") / n, 100 * z.count("high") / n, len(begins) - 1, middle("low"), middle("high"), np.mean(c), np.mean(np.square(c)) / 9]
        got = [r[k] for k in ("n", "pct_low", "pct_mid", "pct_high", "transitions", "median_low_min", "median_high_min", "mean_current", "energy")]
        assert got == pytest.approx(want)
        s = swept[r["subject"], r["cell"]]
        assert all(s[k] == pytest.approx(r[k]) for k in ("n", "pct_high", "transitions_per_hour", "duty_cycle", "energy"))


# --- states


def merged_by_hand(times, labels, least):
    labels, changed = list(labels), True
    while changed:
        changed, i = False, 0
        while i < len(labels):
            j = i
            while j < len(labels) and labels[j] == labels[i]:
                j += 1
            if times[j - 1] - times[i] < least and not (i == 0 and j == len(labels)):
                to = labels[i - 1] if i else labels[j]
                if to != labels[i]:
                    labels[i:j], changed = [to] * (j - i), True
            i = j
    return labels


def test_short_states_are_merged(spark):
    rng = np.random.default_rng(5)
    values = {}
    for s in range(12):
        n = int(rng.integers(8, 120))
        times = np.cumsum(rng.integers(1, 100, n))
        level = np.cumsum(rng.random(n) < (0.1 if s % 2 else 0.6)) % 2
        values[s, "Left"] = [(float(t), float(20 + 30 * z + rng.random())) for t, z in zip(times, level, strict=True)]
    values[20, "Left"] = [(float(60 * i), 20.0 + 30 * (i % 2)) for i in range(40)]  # nothing but short ones
    values[21, "Left"] = [(float(60 * i), 20.0 + 30 * (i > 3) + i / 100) for i in range(40)]
    levels = spark.createDataFrame([(*k, 20.0, 50.0) for k in values], "subject long, hemisphere string, low double, high double")
    got = states.state_episodes(series(spark, values), levels, least_s=250.0, parts=6).collect()
    for k, xs in values.items():
        times, labels = [t for t, _ in xs], merged_by_hand([t for t, _ in xs], [v > 35 for _, v in xs], 250)
        begins = [i for i in range(len(xs)) if i == 0 or labels[i] != labels[i - 1]]
        want = [("high" if labels[i] else "low", times[i], times[j - 1], j - i) for i, j in zip(begins, [*begins[1:], len(xs)], strict=True)]
        own = sorted((r for r in got if r["subject"] == k[0]), key=lambda r: r["run"])
        assert [(r["state"], r["from_s"] - T0.timestamp(), r["to_s"] - T0.timestamp(), r["n"]) for r in own] == want


def test_levels_of_states(spark):
    rng = np.random.default_rng(6)
    x = np.where(np.arange(400) // 50 % 2, rng.normal(60, 3, 400), rng.normal(30, 3, 400))
    values = {(1, "Left"): list(x), (2, "Left"): [5.0] * 50, (3, "Left"): [1.0, 2.0, 3.0]}
    got = states.detect_states(series(spark, values), least_s=3600.0).collect()
    assert [r["subject"] for r in got] == [1]
    r = got[0]
    assert r["low"] == pytest.approx(30, abs=1) and r["high"] == pytest.approx(60, abs=1) and r["separation"] > 8
    assert (r["n_off"], r["n_on"], r["off_fraction"]) == (4, 4, 0.5) and r["mean_off_s"] == pytest.approx(49 * 600)


# --- alignment


def record(spark, rows):
    return spark.createDataFrame([(k, int(i), float(x)) for k, xs in rows.items() for i, x in enumerate(xs)], "k string, i long, x double").repartition(3)


def test_lag_is_found(spark):
    rng = np.random.default_rng(7)
    base = np.abs(np.convolve(rng.normal(size=3000), np.ones(5) / 5, "same"))
    late = np.concatenate([rng.random(17) / 10, base[:-17]]) + 0.01 * rng.normal(size=3000)
    late[40:60] = np.nan
    first = record(spark, {"a": base, "b": rng.random(3000), "c": base[:50], "d": [1.0] * 2000})
    second = record(spark, {"a": late, "b": rng.random(3000), "c": late[:50], "d": late[:2000]})
    got = {r["k"]: r for r in align.align_by_lag(first, second, ["k"], rate=25.0, reach=30, width=256).collect()}
    a = got["a"]
    assert a["ok"] and a["lag_ms"] == 680.0 and a["confidence"] == "high" and a["n_far"] == 200 and a["p"] == pytest.approx(1 / 201) and a["z"] > 5
    assert got["b"]["confidence"] == "low" and not got["c"]["ok"] and set(got) == {"a", "b", "c", "d"} and not got["d"]["ok"]
    # the sums of a lag, in one piece
    lag = spark.createDataFrame([("a", 17), ("a", -300)], "k string, lag long")
    sums = {r["lag"]: r for r in align.lag_sums(first, second, lag, ["k"], 256).collect()}
    x, y = base[:-17], late[17:]
    fine = np.isfinite(y)
    want = [fine.sum(), x[fine].sum(), y[fine].sum(), (x[fine] ** 2).sum(), (y[fine] ** 2).sum(), (x[fine] * y[fine]).sum()]
    assert [sums[17][c] for c in ("n", "a", "b", "aa", "bb", "ab")] == pytest.approx(want)
    assert sums[-300]["n"] == np.isfinite(late[:-300]).sum()


def test_steps(spark):
    rng = np.random.default_rng(8)
    x = rng.normal(size=1600)
    x[400:800] *= 6
    x[1203:] *= 5
    got = align.steps(record(spark, {"a": x, "b": rng.normal(size=1600), "c": x[:40]}), ["k"], 32.0, window_s=1.0, parts=5).orderBy("at_s").collect()
    assert [(r["k"], r["up"]) for r in got] == [("a", True), ("a", False), ("a", True)]
    assert [r["at_s"] for r in got] == pytest.approx([12.5, 25.0, 37.6], abs=1.01)


def greedy(a, b, most):
    used, out = set(), []
    for s, i, kind in sorted(a):
        near = [(abs(t - s), t, j) for t, j, other in b if other == kind and j not in used and abs(t - s) <= most]
        if near:
            used.add(min(near)[2])
            out.append((i, min(near)[2]))
    return sorted(out)


def test_matching_is_what_choosing_one_by_one_gives(spark):
    rng = np.random.default_rng(9)
    rows = {}
    for k in range(6):
        a = [(float(s), i, bool(rng.random() < 0.5)) for i, s in enumerate(rng.integers(0, 40 * (k + 1), 60))]
        b = [(float(s) + 0.5 * (k % 2), 1000 + i, bool(rng.random() < 0.5)) for i, s in enumerate(rng.integers(0, 40 * (k + 1), 50))]
        rows[k] = (a, b)
    rows[7] = ([(1.0, 1, True)], [])
    frame = lambda n: spark.createDataFrame([(k, i, s, kind) for k, ab in rows.items() for s, i, kind in ab[n]], "k long, id long, s double, kind boolean")
    got = align.match_events(frame(0), frame(1), ["k"], 3.0).collect()
    for k, (a, b) in rows.items():
        assert sorted((r["a"], r["b"]) for r in got if r["k"] == k) == greedy(a, b, 3.0)
    out = {r["k"]: r for r in align.align_by_events(frame(0), frame(1), ["k"]).collect()}
    assert (out[7]["n_first"], out[7]["n_second"], out[7]["n_matched"], out[7]["confidence"]) == (1, 0, 0, None)
    late = [(10.0 * i, i, True) for i in range(20)], [(10.0 * i + 1.25, i, True) for i in range(20)]
    frame = lambda n: spark.createDataFrame([(0, i, s, kind) for s, i, kind in late[n]], "k long, id long, s double, kind boolean")
    r = align.align_by_events(frame(0), frame(1), ["k"]).first()
    assert (r["n_matched"], r["lag_ms"], r["spread_ms"], r["confidence"]) == (20, 1250.0, 0.0, "high")


# --- variability


def test_intradaily_variability_by_hand(spark):
    """Three days of 20 hours that alternate between 0 and 2: n 60, variance 1, steps of 4 within days; the last hours are missing, so
    no step crosses midnight: 57 of 71 steps. A day of a few hours is dropped."""
    rows = [(d * 86400 + h * 3600, 2.0 * (h % 2)) for d in range(3) for h in range(20)] + [(3 * 86400 + h * 3600, 9.0) for h in range(5)]
    r = rhythm.intradaily_variability(series(spark, {(1, "Left"): rows, (2, "Left"): rows[:30]})).collect()
    assert len(r) == 1 and (r[0]["n_days"], r[0]["n_pairs"], r[0]["n_skipped"]) == (3, 57, 14)
    assert r[0]["variability"] == pytest.approx(60 * (57 * 4 * 71 / 57) / (59 * 60))
