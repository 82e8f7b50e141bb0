"""Responses to doses, fits, manifests and rules on planted cases."""

from __future__ import annotations

import math
from datetime import datetime, timedelta, timezone

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewell.operators import fits, manifest, response, rules

T0 = datetime(2024, 3, 1, tzinfo=timezone.utc)
SERIES = "subject long, hemisphere string, t timestamp, row_ord long, lfp double"
EVENTS = "subject long, hemisphere string, t timestamp, row_ord long"


def at(seconds):
    return T0 + timedelta(seconds=float(seconds))


# --- response


def test_draws_follow_the_generator():
    s, want = response.SEED, []
    for _ in range(50):
        s = (s * 1664525 + 1013904223) % 2**32
        want.append(s / 2**32)
    assert list(response.draws(50)) == want and list(response.draws(10, 40)) == want[40:]


def test_planted_response(spark):
    """Subject 1 falls by 40 % from 30 to 150 minutes after each dose, subject 2 does not; subjects 3 to 5 are refused."""
    rng = np.random.default_rng(1)
    minutes = np.arange(0, 12 * 1440, 10)
    doses = [d * 1440 + h for d in range(12) for h in (450 + 7 * d % 60, 830 - 11 * d % 90, 1200 + 13 * d % 50)]
    rows, events = [], []
    for subject in (1, 2):
        level = 100 + rng.normal(0, 4, len(minutes))
        if subject == 1:
            for d in doses:
                level[(minutes >= d + 30) & (minutes < d + 150)] *= 0.6
        rows += [(subject, "Left", at(60 * m), int(i), float(v)) for i, (m, v) in enumerate(zip(minutes, level, strict=True))]
        events += [(subject, "Left", at(60 * d), i) for i, d in enumerate(doses)]
    rows += [(3, "Left", at(600 * i), i, 1.0) for i in range(10)] + [(4, "Left", at(600 * i), i, 1.0) for i in range(100)] + [(5, "Left", at(600 * i), i, 1.0) for i in range(100)]
    events += [(3, "Left", at(0), 1), (4, "Left", at(0), 1)] + [(5, "Left", at(86400 * 9 + i), i) for i in range(5)] + [(9, "Left", at(0), 1)]
    series, marks = spark.createDataFrame(rows, SERIES).repartition(3), spark.createDataFrame(events, EVENTS)
    got = {r["subject"]: r for r in response.dose_response_milestones(series, marks, shifts=60, resamples=30).collect()}
    assert {k: got[k]["reason"] for k in got} == {1: None, 2: None, 3: "short_series", 4: "few_doses", 5: "few_trials"}
    r = got[1]
    assert r["detected"] and r["p"] < 0.05 and r["n_shifts"] == 60 and r["nadir_pct"] == pytest.approx(60, abs=3)
    assert r["latency_min"] == 30 and r["return_min"] in (150, 160) and r["duration_min"] == r["return_min"] - 30 and not r["censored"] and 30 <= r["time_to_nadir_min"] < 150
    assert not got[2]["detected"] and got[2]["latency_min"] is None and got[2]["p"] > 0.05
    curve = {r["minute"]: r for r in response.dose_response_curve(series, marks, resamples=30).where("subject = 1").collect()}
    assert len(curve) == 31 and all(c["ci_low"] <= c["median"] + 3 and c["ci_high"] >= c["median"] - 3 for c in curve.values())
    assert curve[90]["median"] == pytest.approx(60, abs=3) and curve[200]["median"] == pytest.approx(100, abs=3) and curve[90]["n"] >= 34


# --- fits


def test_planted_curves(spark):
    x = np.arange(0, 4.1, 0.1)
    rows = [("decay", float(v), 30 * math.exp(-1.3 * (v - 0.2)) + 12) for v in x for _ in range(3)]
    rows += [("sigmoid", float(v), 25 / (1 + math.exp(3.1 * (v - 1.7))) + 8) for v in x]
    rows += [("rising", float(v), 5 + 2.0 * float(v)) for v in x] + [("few", 1.0, 2.0)] * 3 + [("flat", 1.0, 2.0)] * 5 + [("few", None, 1.0), ("few", 2.0, float("nan"))]
    out = fits.fit_dose_response(spark.createDataFrame(rows, "g string, ma double, power double"), ["g"]).collect()
    got = {r["g"]: r for r in out}
    d, s = got["decay"], got["sigmoid"]
    assert d["best"] == "decay" and d["mse"] < 1e-12 and d["k"] == pytest.approx(1.3, abs=1e-6) and d["l0"] == pytest.approx(12, abs=1e-6)
    assert d["l"] * math.exp(d["k"] * d["x0"]) == pytest.approx(30 * math.exp(1.3 * 0.2), rel=1e-6)
    assert s["best"] == "inverse_sigmoid" and [s[c] for c in ("l", "k", "x0", "l0")] == pytest.approx([25, 3.1, 1.7, 8], abs=1e-6) and s["r2"] == pytest.approx(1)
    assert s["half_suppression"] == pytest.approx(1.7, abs=0.03) and s["max_suppression_pct"] > 70 and not s["artifact_suspected"]
    assert got["rising"]["artifact_suspected"] and got["few"]["reason"] == "few_pairs" and got["few"]["best"] is None
    assert got["flat"]["n"] == 5 and got["flat"]["r2"] is None
    # the same by rounds over all groups
    own = [r for r in rows if r[0] == "sigmoid"]
    levels = spark.createDataFrame([("s", r[1], 1, r[2] + 0.1 * math.sin(7 * i), 0.0) for i, r in enumerate(own)], "g string, x double, n long, y double, within double")
    start = spark.createDataFrame([("s", "inverse_sigmoid", [25.0, 0.5, 2.0, 8.0])], "g string, model string, trial array<double>")
    ways = [fits.fit_curves(levels, start, ["g"], few=few).first() for few in (0, 100)]
    assert all(w["converged"] for w in ways) and list(ways[0]["p"]) == pytest.approx(list(ways[1]["p"]), abs=1e-6) and list(ways[0]["p"]) == pytest.approx([25, 3.1, 1.7, 8], abs=0.3)


# --- manifests


def test_manifest_names_what_differs(spark):
    rows = [(i, f"v{i % 7}", None if i % 5 == 0 else i * 0.5) for i in range(500)]
    df = spark.createDataFrame(rows, "id long, a string, b double")
    kept = manifest.table_manifest(df, ["id"])
    again = manifest.table_manifest(df.repartition(7).orderBy(F.desc("b")), ["id"])
    assert manifest.manifest_changes(kept, again).where("status <> 'equal'").isEmpty() and kept.count() == 16 * 3
    edited = df.withColumn("b", F.when(F.col("id") == 123, 1.0).otherwise(F.col("b")))
    changes = manifest.manifest_changes(kept, manifest.table_manifest(edited, ["id"])).where("status <> 'equal'").collect()
    assert [(r["column"], r["status"]) for r in changes] == [("b", "changed")]
    fewer = manifest.manifest_changes(kept, manifest.table_manifest(df.where("id <> 123").drop("a"), ["id"])).where("status <> 'equal'").collect()
    assert {r["status"] for r in fewer if r["column"] == "a"} == {"missing"} and {r["column"] for r in fewer if r["status"] == "changed"} == {"key", "b"}
    assert manifest.table_manifest(df.limit(0), ["id"]).isEmpty()


def test_steps(spark):
    kind = "id int, step string, params map<string,string>, n_in long, n_out long"
    a = [(1, "censor", {"a": "1", "b": "2"}, 10, 9), (2, "clean", {"k": "4"}, 9, 8), (3, "zones", None, 8, 8)]
    b = [(1, "censor", {"b": "2", "a": "1"}, 10, 9), (2, "clean", {"k": "3"}, 9, 7), (3, "zones", None, 8, 7), (4, "more", {}, 1, 1)]
    one, two = (manifest.record_steps(spark.createDataFrame(x, kind)) for x in (a, b))
    got = {r["id"]: (r["field"], r["kept"], r["now"]) for r in manifest.step_differences(one, two).collect()}
    assert got == {2: ("params", '{"k":"4"}', '{"k":"3"}'), 3: ("n_out", "8", "7"), 4: ("step", None, "more")}
    d = [{r["id"]: r["digest"] for r in x.collect()} for x in (one, two)]
    assert d[0][1] == d[1][1] and d[0][2] != d[1][2]


# --- rules


def test_rules_say_what_was_not_checked(spark):
    rows = [(1, 1000, 2, 5.0, 0.0, True, 5.0, 1.0, 0.5), (2, 1000, 50, 80.0, 25.0, True, -30.0, 10.0, 21.0), (3, 50, 2, None, 8.0, False, None, None, 5.0), (4, 1000, 2, 5.0, 6.0, True, None, 1.0, 0.0)]
    df = spark.createDataFrame(rows, "rec int, n_valid long, n_extreme long, sd double, pct_lost double, loss_known boolean, drift_ms double, high_pass_hz double, pct_censored double")
    found = rules.findings(df, ["rec"])
    got = {(r["rec"], r["check"]): (r["status"], r["reason"]) for r in found.collect()}
    assert len(got) == 24 and {s for (r, _), (s, _) in got.items() if r == 1} == {"passed"}
    assert {c: s for (r, c), (s, _) in got.items() if r == 2} == {"clipping": "critical", "amplitude": "warning", "packet_loss": "critical", "clock_drift": "warning", "high_pass": "critical", "device_censoring": "critical"}
    assert got[3, "clipping"] == ("not_checked", "under 100 samples") and got[3, "amplitude"] == ("not_checked", "missing: sd") and got[3, "packet_loss"] == ("not_checked", "no sequence numbers or ticks")
    assert got[3, "high_pass"] == ("not_checked", "missing: high_pass_hz") and got[4, "packet_loss"][0] == "warning"
    v = {r["rec"]: r for r in rules.verdicts(found, ["rec"]).collect()}
    assert [v[i]["level"] for i in (1, 2, 3, 4)] == ["clean", "critical", "warning", "warning"] and v[3]["n_not_checked"] == 5 and v[2]["worst"] == "clipping" and v[1]["worst"] is None
    assert v[3]["pct_verified"] == pytest.approx(100 / 6)
    bare = {(r["check"], r["status"]) for r in rules.findings(df.select("rec"), ["rec"]).collect()}
    assert {s for _, s in bare} == {"not_checked"} and len(bare) == 6
    assert rules.summary(found).orderBy("place").first()["check"] == "device_censoring"


def test_eligibility(spark):
    kinds = "rec int, has_peak boolean, has_signal boolean, pct_lost double, loss_known boolean, n_channels int, n_unstable int, state string, rate_hz double, pulse_us double, n_days int, n_points int, p_adjusted double, rhythm_share double"
    rows = [(1, True, True, 0.0, True, 3, 0, "ON", 130.0, 60.0, 9, 900, 0.001, 0.2), (2, False, True, 12.0, True, 3, 3, "ON", 130.0, 60.0, 2, 200, 0.001, 0.2), (3, None, False, 12.0, True, None, None, "UNKNOWN", None, None, 9, 20, None, None), (4, True, True, 12.0, False, 3, 1, "ON", 80.0, 60.0, 4, 400, 0.2, 0.2)]
    df = spark.createDataFrame(rows, kinds)
    got = {r["rec"]: (r["verdict"], r["blockers"], r["missing"], r["reserves"]) for r in rules.eligibility(rules.findings(df, ["rec"], rules.ELIGIBILITY), ["rec"]).collect()}
    assert got[1] == ("eligible", "", "", "") and got[2] == ("not_eligible", "artifact,chronic_days,peak,reproducibility", "", "")
    assert got[3] == ("insufficient", "", "artifact,parameters,peak,reproducibility,rhythm", "") and got[4] == ("with_reserve", "", "", "chronic_days,parameters,reproducibility,rhythm")


def test_reproducible_peaks(spark):
    rows = [("a", 20.0, 1.0, True), ("a", 20.5, 2.0, True), ("a", 21.0, 3.0, None), ("b", 20.0, 1.0, True), ("b", 21.5, 1.0, False), ("c", 20.0, 1.0, True), ("c", None, 1.0, True)]
    got = {r["c"]: r for r in rules.peak_reproducibility(spark.createDataFrame(rows, "c string, f double, magnitude double, flag boolean"), ["c"]).collect()}
    assert {k: r["verdict"] for k, r in got.items()} == {"a": "stable", "b": "unstable", "c": "not_enough"}
    assert got["a"]["magnitude_cv"] == pytest.approx(0.5) and got["a"]["flags_agree"] and not got["b"]["flags_agree"] and got["c"]["flags_agree"] is None


# --- mixed models


def days_of(rng, days, per_day, phi, sd_day, sd, wave):
    rows = []
    for d in range(days):
        shift, e = rng.normal(0, sd_day), rng.normal(0, sd)
        for i in range(per_day):
            e = phi * e + rng.normal(0, sd * math.sqrt(1 - phi**2)) if i else e
            h = 24 * i / per_day
            rows.append((d * 86400 + h * 3600, wave(h) + shift + e))
    return rows


def planted(spark, values):
    return spark.createDataFrame([(s, "Left", at(t), i, float(v)) for s, xs in values.items() for i, (t, v) in enumerate(xs)], SERIES).repartition(3)


def test_mixed_cosinor(spark):
    from tidewell.operators.mixed import mixed_cosinor

    wave = lambda h: 40 + 8 * math.cos(2 * math.pi * (h - 16) / 24) + 3 * math.cos(2 * math.pi * (h - 5) / 12)
    rng = np.random.default_rng(3)
    values = {1: days_of(rng, 60, 144, 0.8, 4.0, 2.0, wave), 2: days_of(rng, 20, 48, 0.0, 0.0, 1.0, wave), 3: days_of(rng, 2, 48, 0, 0, 1, wave), 4: [(86400.0 * d, 1.0) for d in range(30)]}
    got = {(r["subject"], r["period"]): r for r in mixed_cosinor(planted(spark, values)).collect()}
    a, b = got[1, 24.0], got[1, 12.0]
    assert a["phi"] == pytest.approx(0.8, abs=0.02) and a["sd_day"] == pytest.approx(4, abs=1) and a["sd_residual"] == pytest.approx(2, abs=0.15) and (a["n"], a["n_days"]) == (8640, 60)
    assert a["amplitude"] == pytest.approx(8, abs=0.3) and a["acrophase_h"] == pytest.approx(16, abs=0.2) and b["amplitude"] == pytest.approx(3, abs=0.3) and b["acrophase_h"] == pytest.approx(5, abs=0.2)
    assert a["mesor"] == pytest.approx(40, abs=3 * a["mesor_se"]) and a["mesor_se"] == pytest.approx(4 / math.sqrt(60), rel=0.3)
    assert got[3, None]["reason"] == "few_days" and got[4, None]["reason"] == "singular"
    # without effects of days and correlation it is the plain fit
    plain = {(r["subject"], r["period"]): r for r in mixed_cosinor(planted(spark, {2: values[2]}), correlated=False).collect()}[2, 24.0]
    h = np.array([t % 86400 / 3600 for t, _ in values[2]])
    x = np.stack([np.ones(len(h)), *[f(2 * np.pi * h / p) for p in (24, 12) for f in (np.cos, np.sin)]], axis=1)
    beta = np.linalg.lstsq(x, np.array([v for _, v in values[2]]), rcond=None)[0]
    assert plain["sd_day"] < 0.15 and plain["mesor"] == pytest.approx(beta[0], abs=1e-6) and plain["amplitude"] == pytest.approx(math.hypot(*beta[1:3]), abs=1e-6)


def test_cyclic_rhythm(spark):
    from tidewell.operators.mixed import cyclic_rhythm, spline_values

    wave = lambda h: 30 + 10 * math.exp(-(((h - 21 + 12) % 24 - 12) ** 2) / 8)
    rng = np.random.default_rng(4)
    values = {1: days_of(rng, 40, 96, 0.0, 3.0, 1.0, wave), 2: days_of(rng, 2, 48, 0, 0, 1, wave), 3: [(86400.0 * d + 60 * i, 1.0) for d in range(5) for i in range(30)]}
    got = cyclic_rhythm(planted(spark, values)).collect()
    one = {r["hour"]: r for r in got if r["subject"] == 1}
    level = np.mean([one[h]["fitted"] - wave(h) for h in range(24)])
    assert len(one) == 24 and abs(level) < 1.5 and all(abs(one[h]["fitted"] - level - wave(h)) < 0.7 for h in range(24))
    assert one[0]["sd_day"] == pytest.approx(3, abs=0.8) and one[0]["explained"] > 0.9 and 5 < one[0]["edf"] < 12
    assert {r["subject"]: r["reason"] for r in got if r["reason"]} == {2: "few_days", 3: "singular"}
    v = spline_values(np.array([0.0, 23.999999, 24.0, 7.3]))
    assert np.allclose(v.sum(axis=1), 1) and np.allclose(v[0], v[2]) and np.allclose(v[0], v[1], atol=1e-5)


# --- thresholds


def test_thresholds_of_planted_states(spark):
    from tidewell.operators.models import Counted, crossing, propose_thresholds, two_normals

    rng = np.random.default_rng(5)
    low, high = rng.normal(1.3, 0.05, 6000), rng.normal(1.7, 0.06, 4000)
    lfp = np.round(10 ** np.concatenate([low, high]) - 1, 2)
    rows = [(1, "Left", at(600 * i), i, float(v)) for i, v in enumerate(lfp)] + [(2, "Left", at(600 * i), i, float(v)) for i, v in enumerate(10 ** rng.normal(1.5, 0.1, 500) - 1)]
    rows += [(3, "Left", at(600 * i), i, 5.0) for i in range(40)] + [(4, "Left", at(600 * i), i, float(i)) for i in range(29)] + [(5, "Left", at(600 * i), i, 0.1 * (i % 2)) for i in range(40)]
    got = {r["subject"]: r for r in propose_thresholds(spark.createDataFrame(rows, SERIES)).collect()}
    one = got[1]
    assert one["method"] == "bimodal" and one["separation"] > 4 and one["lower_log"] == pytest.approx(1.325, abs=0.01) and one["upper_log"] == pytest.approx(1.49, abs=0.02)
    assert one["lower"] == round(10 ** one["lower_log"] - 1) and one["upper"] == round(10 ** one["upper_log"] - 1)
    assert got[2]["method"] == "percentile" and got[3]["reason"] == "constant" and got[4]["reason"] == "too_few"
    assert (got[5]["lower"], got[5]["upper"]) == (0.0, 1.0)
    c = Counted(np.array([3.0, 1.0, 2.0]), np.array([1, 2, 4]))
    assert [c.quantile(p) for p in (0, 0.25, 0.3, 0.5, 1)] == pytest.approx(list(np.quantile([1, 1, 2, 2, 2, 2, 3], [0, 0.25, 0.3, 0.5, 1])))
    x = crossing(two_normals(Counted(np.log10(lfp + 1), np.ones(len(lfp)))))
    assert 1.4 < x < 1.6
    equal = {"mean": np.array([0.0, 1.0]), "sd": np.array([1.0, 1.0]) * 0.2, "weight": np.array([0.5, 0.5])}
    assert crossing(equal) == pytest.approx(0.5)


# --- names


def test_channel_names(spark):
    from tidewell.operators import device

    names = {
        "ZERO_THREE_LEFT": ("03", ["0", "3"]), "ONE_AND_THREE_RIGHT": ("1-3", ["1", "3"]), "ONE_C_AND_TWO_C_LEFT": ("1c-2c", ["1c", "2c"]), "ZERO_A_AND_TWO_LEFT_RING": ("0a-2", ["0a", "2"]),
        "SensingChannelDef.TWO_B_AND_TWO_B_RIGHT_SEGMENT": ("SensingChannelDef.2b-2b", ["2b"]), "0-3": ("0-3", ["0", "3"]), "1c-2c": ("1c-2c", ["1c", "2c"]), "other": ("other", []), "02": ("02", []), "ZERO_AND_RING": ("0-RING", ["0"]),
    }
    df = spark.createDataFrame([(n,) for n in names], "c string")
    got = {r["c"]: (r["l"], r["k"]) for r in df.select("c", device.channel_label(F.col("c")).alias("l"), device.channel_contacts(F.col("c")).alias("k")).collect()}
    assert got == names
    e = spark.createDataFrame([("ElectrodeDef.SenSight_ZERO",), ("SENSIGHT_1a",), ("ElectrodeDef.Case",), ("THREE",)], "e string").select(device.electrode_name(F.col("e"))).collect()
    assert [r[0] for r in e] == ["ZERO", "1a", "Case", "THREE"]
