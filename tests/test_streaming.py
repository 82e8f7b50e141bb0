"""The live operators, run over a folder until it is used up."""

from __future__ import annotations

import json
from datetime import datetime

from tidewell.streaming import ingest

ROWS = [("00:00", 10.0), ("00:10", 30.0), ("00:10", 99.0), ("00:20", -1.0), ("02:00", 30.0), ("02:10", 5.0)]


def collected(spark, df, name, mode, tmp_path):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / f"cp-{name}")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert q.exception() is None
    return spark.table(name).collect()


def source(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    lines = [json.dumps({"subject": 1, "hemisphere": "Left", "t": f"2025-01-06T{t}:00", "lfp_raw": v}) for t, v in ROWS]
    (folder / "a.json").write_text("\n".join(lines))
    return ingest.read_series(spark, str(folder))


def test_first_and_controller(spark, tmp_path):
    clean = ingest.first_of_each(source(spark, tmp_path))
    got = collected(spark, ingest.controller(clean, 8, 20), "steps", "append", tmp_path)
    # the repeated and the censored sample give no step: 15, then 16, then 17, then 16
    assert [r["level"] for r in sorted(got, key=lambda r: r["t"])] == [15, 16, 17, 16]
    assert all(r["n_old"] == 0 for r in got)


def test_zone_windows(spark, tmp_path):
    got = collected(spark, ingest.zone_windows(ingest.first_of_each(source(spark, tmp_path), "10 minutes"), 8, 20), "zones", "append", tmp_path)
    # a window comes out once the watermark has passed it
    assert [(r["start"], r["below"], r["between"], r["above"]) for r in got] == [(datetime(2025, 1, 6, 0, 0), 0, 1, 1)]


def test_sessions(spark, tmp_path):
    series = source(spark, tmp_path).withWatermark("t", "10 minutes")
    got = collected(spark, ingest.sessions(series), "stretches", "append", tmp_path)
    assert {(r["start"], r["n"]) for r in got} <= {(datetime(2025, 1, 6, 0, 0), 4), (datetime(2025, 1, 6, 2, 0), 2)}
    assert (datetime(2025, 1, 6, 0, 0), 4) in {(r["start"], r["n"]) for r in got}
