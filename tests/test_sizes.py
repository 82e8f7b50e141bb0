"""What only shows where tables are larger or denser than the test tables."""

from __future__ import annotations

from datetime import datetime, timedelta, timezone
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

T0 = datetime(2024, 3, 1, tzinfo=timezone.utc)
SERIES = "subject long, hemisphere string, t timestamp, row_ord long, lfp double"
DATA = "/root/testdata/sf0.001"


@pytest.fixture
def conf(spark):
    """Set configurations for one test."""
    before = {}

    def put(name, value):
        before.setdefault(name, spark.conf.get(name, None))
        spark.conf.set(name, value)

    yield put
    for name, value in before.items():
        spark.conf.set(name, value) if value is not None else spark.conf.unset(name)


def test_windows_count_rounded_milliseconds(spark):
    """191315 and 191889 microseconds are 191 and 192 ms: the later sample isn't in the earlier one's window, as it is not in SQL's epoch_ms."""
    from tidewell.operators import chronic, controller

    rows = [(1, "Left", T0 + timedelta(microseconds=us), i, x) for i, (us, x) in enumerate([(191_315, 1.0), (191_889, 3.0), (999_500, 8.0)])]
    x = spark.createDataFrame(rows, SERIES)
    mean = lambda df: {r["row_ord"]: r["mean"] for r in df.collect()}
    assert mean(chronic.causal_mean(x, 3600)) == {0: 1.0, 1: 2.0, 2: 4.0}
    assert mean(controller.smoothed(x, 3_600_000)) == {0: 1.0, 1: 2.0, 2: 4.0}
    assert mean(chronic.causal_mean(x, 0.808)) == {0: 1.0, 1: 2.0, 2: 8.0}  # 191, 192 and 1000 ms
    assert mean(chronic.moving_days(x, 2 * 0.808 / 86400)) == {0: 2.0, 1: 4.0, 2: 5.5}


def test_side_signals_have_one_file_a_subject(spark, conf, tmp_path):
    from tidewell.plans import signals

    # as large tables are: joined by a shuffle in the first plan, by a broadcast and local reads once it runs
    conf("spark.sql.adaptive.coalescePartitions.enabled", "false")
    conf("spark.sql.autoBroadcastJoinThreshold", "-1")
    conf("spark.sql.adaptive.autoBroadcastJoinThreshold", "10MB")
    spark.read.parquet(f"{DATA}/events.parquet").repartition(4).write.parquet(f"{tmp_path}/events.parquet")
    folder = Path(signals.folder(spark, str(tmp_path)).removeprefix("file://"))
    files = [f.parent.name for f in folder.glob("*/subject=*/*.csv")]
    assert len(files) == len(set(files)) == 8


def test_steps_of_times_in_seconds_are_exact(spark, tmp_path):
    """Seconds since the epoch to the millisecond, 35934 ms apart: doubles of them lie some ten-thousandths of a ms off."""
    from tidewell.sources.dialects import Signals

    ms = [1_704_067_211_172 + 35_934 * i for i in range(40)]
    (tmp_path / "a.csv").write_text("tempo;x\n" + "".join(f"{m // 1000},{m % 1000:03d};{i}\n" for i, m in enumerate(ms)))
    (tmp_path / "b.csv").write_text("t,x\n" + "".join(f"{i * 35.9345e-6!r},{i}\n" for i in range(40)))
    got = {r["file"][-5]: r for r in Signals(spark, f"file://{tmp_path}").files().collect()}
    assert (got["a"]["time_kind"], got["a"]["step_ms"], got["a"]["jitter_pct"], got["a"]["n"]) == ("epoch_s", 35934.0, 0.0, 40)
    assert (got["b"]["time_kind"], got["b"]["n_dropped"]) == ("relative_s", 0)
    assert got["b"]["step_ms"] == pytest.approx(0.0359345, abs=1e-12)


def test_trials_search_the_last_sample_of_each_bin():
    """Samples and doses at whole minutes and microseconds beside the bins' edges, against a loop over all of them."""
    from tidewell.operators import response

    rng = np.random.default_rng(5)
    at = np.unique(1.7e9 + 60.0 * rng.integers(0, 3000, 1500) + 1e-6 * rng.integers(-1, 2, 1500))
    values, doses = rng.normal(50, 9, len(at)), 1.7e9 + 60.0 * rng.integers(-200, 3200, 300) + 1e-6 * rng.integers(-1, 2, 300)
    got, there = response.trials(at, values, doses, 60, 120, 10)
    want = []
    for d in doses:
        lag = at - d
        b = np.floor((lag / 60 + 60) / 10 + 0.5)
        cells = {int(k): v for k, v, s in zip(b, values, lag, strict=True) if 0 <= k <= 18 and -3900 <= s <= 7500}
        if len(cells) >= 0.4 * 19:
            before = [v for k, v in cells.items() if k < 6]
            base = np.median(before) if before else 0
            want.append({k: 100 * v / base if base else v for k, v in cells.items()})
    assert len(got) == len(want) > 200
    for v, some, cells in zip(got, there, want, strict=True):
        assert np.flatnonzero(some).tolist() == sorted(cells)
        assert np.allclose(v[some], [cells[k] for k in sorted(cells)], rtol=1e-12)


def test_shifted_doses_are_not_joined(spark):
    """What a shift costs is a search, not rows: the plan of a response has no join of samples with doses and no rows for each shift."""
    from tidewell.plans import responses

    for q in (responses.curve, responses.milestones):
        plan = q(spark, DATA)._jdf.queryExecution().optimizedPlan().toString()
        assert "bucket" not in plan and "lag_s" not in plan


def test_matching_of_dense_events_is_one_pass(spark):
    """Events far denser than the window, with ties and repeated rows, against choosing one by one; no job for each round of choices."""
    from tidewell.operators import align

    rng = np.random.default_rng(4)
    a = [(float(s) / 4, i, bool(i % 2)) for i, s in enumerate(rng.integers(0, 1200, 700))]
    b = [(float(s) / 4, 5000 - i, bool(i % 3 % 2)) for i, s in enumerate(rng.integers(0, 1200, 800))]
    frame = lambda rows: spark.createDataFrame([(1, i, s, kind) for s, i, kind in rows], "k long, id long, s double, kind boolean")
    used, want = set(), []
    for s, i, kind in sorted(a):
        near = [(abs(t - s), t, j) for t, j, other in b if other == kind and j not in used and abs(t - s) <= 10]
        if near:
            used.add(min(near)[2])
            want.append((i, min(near)[2], min(near)[1] - s))
    tracker = spark.sparkContext.statusTracker()
    before = len(tracker.getJobIdsForGroup(None))
    got = align.match_events(frame(a + a[:50]), frame(b + b[:50]), ["k"], 10.0).collect()
    assert sorted((r["a"], r["b"], r["diff_s"]) for r in got) == sorted(want)
    assert len(tracker.getJobIdsForGroup(None)) - before <= 4


def test_reliability_deals_a_large_group_out(spark):
    """Rows of a few sites meet what is known of their site in many places."""
    from tidewell.operators import diary

    rng = np.random.default_rng(6)
    rows = [(s % 2, s, T0 + timedelta(days=k), 10 * s + k, float(s % 7 + rng.normal())) for s in range(60) for k in range(2 + s % 3)]
    x = spark.createDataFrame(rows, "site long, subject long, t timestamp, row_ord long, centre double")
    out = diary.session_reliability(x, ["site"], "subject", "centre", ["t", "row_ord"])
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    joins = [line for line in plan.splitlines() if "Join" in line]
    assert sum("_deal" in j for j in joins) >= 2
    for r in out.collect():
        first = {(s, o % 10): c for site, s, _, o, c in rows if site == r["site"]}
        v = np.array([[first[s, i] for i in range(2)] for s in range(r["site"], 60, 2)])
        n, k = v.shape
        msr, msc = k * v.mean(1).var(ddof=1), n * v.mean(0).var(ddof=1)
        mse = ((v - v.mean(1, keepdims=True) - v.mean(0) + v.mean()) ** 2).sum() / ((n - 1) * (k - 1))
        assert (r["n"], r["k"]) == (30, 2)
        assert r["icc31"] == pytest.approx((msr - mse) / (msr + (k - 1) * mse))
        assert r["icc21"] == pytest.approx((msr - mse) / (msr + (k - 1) * mse + k * (msc - mse) / n))


def test_ramp_over_slabs_is_that_of_single_steps(monkeypatch):
    """Slabs of 7 values against one step at a time, from one start, from two at once and from none."""
    from tidewell.operators import controller

    rng = np.random.default_rng(8)
    values, seconds = rng.normal(50, 20, 40), np.cumsum(rng.integers(1, 40, 40)).astype(float)
    lower, upper = np.array([20.0, 40.0, 45.0]), np.array([60.0, 55.0, 46.0])
    monkeypatch.setattr(controller, "SLAB", 7)
    for single in (False, True):
        ramp = controller.Ramp(1.0, 3.0, 0.02, single)

        def stepped(level, before):
            for v, s in zip(values, seconds, strict=True):
                share = (v > upper).astype(float) if single else np.clip((v - lower) / (upper - lower), 0, 1)
                target = np.where(share >= 1, 3.0, 1.0 + share * 2.0)
                level = target if level is None else level + np.clip(target - level, -0.02 * (s - before), 0.02 * (s - before))
                before = s
                yield level

        begins = np.array([[1.0] * 3, [3.0] * 3])
        both = np.concatenate(list(ramp.follow(values, seconds, lower, upper, begins, 0.0)))
        for k in range(2):
            assert np.array_equal(both[:, k], list(stepped(begins[k], 0.0)))
        assert np.array_equal(np.concatenate(list(ramp.follow(values, seconds, lower, upper, None, None))), list(stepped(None, None)))
