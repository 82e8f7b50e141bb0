"""Side signals of several dialects in one folder."""

from __future__ import annotations

import pytest

from tidewell.sources.dialects import Signals, dialect


def write(folder, name, lines, end="\n"):
    (folder / name).write_text(end.join(lines) + end)


def test_folder_of_dialects(spark, tmp_path):
    write(tmp_path, "iso.csv", ["recorder 7, export, v1", "Time,AccX (g),EMG [uV],label"] + [f"2024-03-01T10:00:{i:02d}Z,{i}.5,{i * 2},walk" for i in range(30)])
    write(tmp_path, "comma.csv", ["tempo;ecg"] + [f"{1709287200 + i / 4:.2f}".replace(".", ",") + f";{i}.25" for i in range(20) if i not in (7, 8, 9, 10)], end="\r\n")
    write(tmp_path, "tabs.txt", [f"{1709287200000 + 4 * i}\t{i}\t{-i}" for i in range(40)] + ["1\t2", "broken"])
    write(tmp_path, "pipes.txt", ["ms|gyro x"] + [f"{20 * i + (i % 2)}|{'' if i % 5 == 0 else i}" for i in range(50)])
    write(tmp_path, "seconds.csv", ["a,b"] + [f"{3 - i},{5 + i / 100}" for i in range(60)])
    write(tmp_path, "short.csv", ["a,b", "1,2", "2,3"])
    write(tmp_path, "words.csv", ["time,x"] + [f"then,{i}" for i in range(10)])
    (tmp_path / "empty.csv").write_text("")
    s = Signals(spark, str(tmp_path), parts=5)
    got = {r["file"].rsplit("/", 1)[1]: r for r in s.files().collect()}
    assert len(got) == 7
    iso = got["iso.csv"]
    assert (iso["delimiter"], iso["time_kind"], iso["absolute"], iso["header"]) == (",", "iso", True, 0) or iso["header"] in (0, 1)
    c = got["comma.csv"]
    assert (c["delimiter"], c["header"], c["time_column"], c["time_kind"], c["n"], c["n_gaps"]) == (";", 0, "tempo", "epoch_s", 16, 1) and c["step_ms"] == pytest.approx(250) and c["rate"] == pytest.approx(4)
    t = got["tabs.txt"]
    assert (t["delimiter"], t["header"], t["time_kind"], t["n"], t["n_dropped"], t["n_channels"], t["jitter_pct"]) == ("\t", -1, "epoch_ms", 40, 2, 2, 0.0) and t["duration_s"] == pytest.approx(0.156)
    p = got["pipes.txt"]
    assert (p["delimiter"], p["time_kind"], p["absolute"]) == ("|", "relative_ms", False) and p["jitter_pct"] == pytest.approx(200 / 21)
    b = got["seconds.csv"]  # the second column is the one that grows
    assert (b["time_column"], b["time_kind"]) == ("b", "relative_s") and b["step_ms"] == pytest.approx(10)
    assert got["short.csv"]["reason"] == "too_few_lines" and got["words.csv"]["reason"] == "no_time"
    x = {(r["channel"], r["unit"], r["kind"]) for r in s.samples().collect()}
    assert {("ecg", None, "ecg"), ("gyro x", None, "imu"), ("col2", None, "unknown"), ("a", None, "unknown")} <= x
    e = [(r["t_ms"], r["x"]) for r in s.samples().where("channel = 'ecg'").orderBy("t_ms").collect()]
    assert len(e) == 16 and e[1] == (pytest.approx(1709287200250.0), 1.25)
    gaps = [r["x"] for r in s.samples().where("channel = 'gyro x'").orderBy("t_ms").collect()]
    assert gaps[0] is None and gaps[1] == 1.0 and len(gaps) == 50


def test_dialect_of_first_lines():
    assert dialect(["a;b", "1,5;2", "2,5;3", "3,5;4", "4;5"])["delimiter"] == ";"
    assert dialect(["x"])["reason"] == "too_few_lines"
    d = dialect(["5|1", "4|2", "3|3", "2|4", "1|5"])
    assert (d["header"], d["names"], d["time_column"]) == (-1, ["col1", "col2"], 1)
