"""Reports, diaries and side signals as they come: whole, damaged and empty."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from tidewell.sources import reports, tables

POINTS = [
    {"DateTime": "2025-01-06T00:00:00Z", "LFP": 41.0, "AmplitudeInMilliAmps": 1.5},
    {"DateTime": "2025-01-06T00:10:00Z", "LFP": -1.0, "AmplitudeInMilliAmps": 1.5},
    {"DateTime": "2025-01-06T00:00:00Z", "LFP": 99.0, "AmplitudeInMilliAmps": 1.0},
]


def report() -> dict:
    return {
        "SessionDate": "2025-01-07T10:00:00Z",
        "ProgrammerUtcOffset": "-03:00",
        "PatientInformation": {"Final": {"PatientId": "secret-id"}},
        "DiagnosticData": {"LFPTrendLogs": {"HemisphereLocationDef.Left": {"2025-01-06": POINTS}}},
        "Impedance": [{"Hemisphere": [{"Hemisphere": "HemisphereLocationDef.Right", "SessionImpedance": {"Monopolar": [{"Electrode1": "E.ZERO", "Electrode2": "E.CASE", "ResultValue": 900.0}], "Bipolar": []}}]}],
        "BrainSenseTimeDomain": [{"Channel": "ZERO_TWO_LEFT", "SampleRateInHz": 250.0, "GlobalPacketSizes": "63,62,", "TicksInMses": "0,250,", "TimeDomainData": [1.0, 2.0]}],
    }


def test_reports(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps(report()))
    (tmp_path / "b.json").write_text("{not json")
    (tmp_path / "c.json").write_text("{}")
    read = reports.read_reports(spark, str(tmp_path)).cache()
    rows = {r["file"].rsplit("/", 1)[-1]: r for r in read.drop("doc").collect()}
    assert rows["a.json"]["offset_minutes"] == -180 and not rows["a.json"]["malformed"]
    assert "secret" not in rows["a.json"]["subject"]
    assert rows["b.json"]["malformed"]
    line = reports.timeline(read).orderBy("t").collect()
    assert [(r["hemisphere"], r["lfp"], r["censored"]) for r in line] == [("Left", 41.0, False), ("Left", None, True)]
    ohm = reports.impedances(read).collect()
    assert [(r["hemisphere"], r["kind"], r["contact"], r["ohm"]) for r in ohm] == [("Right", "monopolar", "ZERO-CASE", 900.0)]
    (rec,) = reports.records(read).collect()
    assert rec["sizes"] == [63.0, 62.0] and rec["ticks"] == [0.0, 250.0] and rec["x"] == [1.0, 2.0]
    have = {r["modality"]: r["n"] for r in reports.availability(read).where(F.col("file").endswith("a.json")).collect()}
    assert have["timeline"] == 1 and have["montage"] == 0 and have["time_domain"] == 1


def test_diary(spark, tmp_path):
    path = tmp_path / "diary.csv"
    path.write_text("paciente,dia,hora,estado\np,2025-01-06,8.0,OFF\np,2025-01-06,8.25,On No Dysk\np,2025-01-06,9.0,what\np,2025-01-06,,asleep\np,2025-01-06,10,asleep\n")
    rows = tables.read_diary(spark, str(path)).cache()
    assert sorted(r["problem"] for r in rows.where("problem is not null").collect()) == ["no_hour", "unknown_state"]
    grid = {r["bin"]: (r["state"], r["n_conflicts"]) for r in tables.diary_grid(rows).collect()}
    assert grid == {16: ("Off", 1), 20: ("Asleep", 0)}
    (day,) = tables.day_composition(tables.diary_grid(rows)).collect()
    assert day["Off"] == 0.5 and day["Asleep"] == 0.5 and not day["complete"]


def test_signal(spark, tmp_path):
    path = tmp_path / "imu.csv"
    path.write_text("time,x\n1736121600,1.5\n1736121601,bad\n1736121602,2\n")
    out = tables.read_signal(spark, str(path), "time").orderBy("row_ord").collect()
    assert [r["x"] for r in out] == [1.5, None, 2.0]
    assert [r["malformed"] for r in out] == [False, True, False]
