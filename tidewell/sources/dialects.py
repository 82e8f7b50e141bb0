"""Delimited side signals of many dialects in one folder: delimiter, header, decimal sign, time column and its unit are found file by file.

What a file's dialect is shows in its first lines, of which some hundreds of each file are looked at; every line is then read by its
file's dialect. Lines keep the order of their file by where their split begins and their number in it. Lines that don't fit, irregular
steps and gaps are counted, nothing is filled in.
"""

from __future__ import annotations

import re
from decimal import Decimal

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewell.operators.ranges import by_ranges, previous

from .shared import stored

#: Delimiters in the order in which equally good ones win, names of time columns, words of kinds of channels.
DELIMITERS = (",", ";", "\t", "|")
TIME_NAME = re.compile(r"(time|tempo|timestamp|t|datetime|date|sec|seconds|ms)\b", re.IGNORECASE)
KINDS = (("imu", "acc|aceler|imu|gyro|giro"), ("emg", "emg|musc"), ("ecg", "ecg|ekg|card"))
#: Lines by which a delimiter, a header, a number of columns and a growing column are judged; the least lines of a file.
FOR_DELIMITER, FOR_HEADER, FOR_COLUMNS, FOR_TIME, LEAST = 12, 5, 50, 200, 4
#: The share of growing steps of a time column, the first times from which they are milliseconds or seconds since the epoch, and the
#: step from which relative times are milliseconds; steps of a gap, and the share of numbers of a channel.
GROWING, EPOCH_MS, EPOCH_S, STEP_MS, GAP, NUMERIC = 0.95, 1e11, 1e8, 1.0, 3.0, 0.5
#: The type of a time's written digits.
DIGITS = "decimal(30,15)"


def number(c: Column) -> Column:
    """A number with a decimal point, or a comma where there is no point; null otherwise."""
    t = F.trim(c)
    x = F.when(F.contains(t, F.lit(",")) & ~F.contains(t, F.lit(".")), F.regexp_replace(t, ",", ".")).otherwise(t).try_cast("double")
    return F.when(~F.isnan(x) & (F.abs(x) < float("inf")), x)


def decimal(c: Column) -> Column:
    """The digits of such a number, null where they are more than DIGITS holds."""
    t = F.trim(c)
    return F.when(F.contains(t, F.lit(",")) & ~F.contains(t, F.lit(".")), F.regexp_replace(t, ",", ".")).otherwise(t).try_cast(DIGITS)


def _number(t: str) -> float | None:
    try:
        x = float(t.replace(",", ".", 1) if "," in t and "." not in t else t)
    except ValueError:
        return None
    return x if abs(x) < float("inf") else None


def _cells(line: str, delimiter: str) -> list[str]:
    return [re.sub(r'^"|"$', "", c.strip()) for c in line.split(delimiter)]


def dialect(lines: list[str]) -> dict:
    """The dialect that a file's first lines show: delimiter, header (place, or -1), names, n_columns, time_column; or a reason."""
    if len(lines) < LEAST:
        return {"reason": "too_few_lines"}
    scores = []
    for d in DELIMITERS:
        counts = pd.Series([x.count(d) + 1 for x in lines[:FOR_DELIMITER]])
        middle = counts.median()
        scores.append(middle * (counts == middle).mean() if middle >= 2 else -1)
    best = max(scores)
    d = DELIMITERS[scores.index(best)] if best > 0 else DELIMITERS[0]
    cells = [_cells(x, d) for x in lines]
    words = [sum(bool(c) and _number(c) is None for c in row) for row in cells[:FOR_HEADER]]
    header = next((i for i, n in enumerate(words) if n >= -(-len(cells[i]) // 2)), -1)
    body = cells[header + 1 :]
    n = int(pd.Series([len(r) for r in body[:FOR_COLUMNS]]).median()) if body else 0
    rows = [r for r in body if len(r) == n]
    if len(rows) < LEAST:
        return {"reason": "no_consistent_lines"}
    names = cells[header] if header >= 0 else []
    names = [names[i].strip() if i < len(names) and names[i].strip() else f"col{i + 1}" for i in range(n)]
    at = next((i for i, c in enumerate(names) if header >= 0 and TIME_NAME.match(c)), None)
    if at is None:
        for i in range(n):
            col = [_number(r[i]) for r in rows[:FOR_TIME]]
            if sum(b is not None and a is not None and b > a for a, b in zip(col, col[1:], strict=False)) > GROWING * (len(col) - 1):
                at = i
                break
    at = at or 0
    first = [r[at] for r in rows[:5]]
    iso = all(c and _number(c) is None and not pd.isna(pd.to_datetime(c, errors="coerce", utc=True)) for c in first)
    return {"delimiter": d, "header": header, "names": names, "n_columns": n, "time_column": at, "iso": iso}


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, split, line, text): the lines of all files that aren't blank, in their order."""
    x = spark.read.text(path, recursiveFileLookup=True).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"), F.monotonically_increasing_id().alias("line"))
    return x.select("file", "split", "line", F.regexp_replace("value", "\r$", "").alias("text")).where("trim(text) <> ''")


def find_dialects(lines: DataFrame) -> DataFrame:
    """(file, delimiter, header, names, n_columns, time_column, iso, header_split, header_line, reason): one row a file."""
    most = FOR_HEADER + FOR_TIME
    place = F.row_number().over(Window.partitionBy("file").orderBy("split", "line"))
    head = lines.withColumn("place", place).where(F.col("place") <= most)
    names = ["file", "delimiter", "header", "names", "n_columns", "time_column", "iso", "header_split", "header_line", "reason"]

    def run(b: pd.DataFrame) -> pd.DataFrame:
        b = b.sort_values("place")
        found = dialect(b["text"].tolist())
        at = b.iloc[found["header"]] if found.get("header", -1) >= 0 else None
        found |= {"file": b["file"].iloc[0], "header_split": -1 if at is None else at["split"], "header_line": -1 if at is None else at["line"]}
        return pd.DataFrame([[found.get(c) for c in names]], columns=names)

    return head.groupBy("file").applyInPandas(run, "file string, delimiter string, header int, names array<string>, n_columns int, time_column int, iso boolean, header_split long, header_line long, reason string")


class Signals:
    """The signals of a folder: `files` says how each file was read, `samples` what is in it."""

    def __init__(self, spark: SparkSession, path: str, parts: int | None = None):
        lines = read_lines(spark, path)
        self.found = stored(find_dialects(lines), "dialects")
        good = self.found.where("reason is null")
        x = lines.join(good, "file").where("split > header_split or split = header_split and line > header_line")
        quoted = F.expr("split(text, concat('\\\\Q', delimiter, '\\\\E'), -1)")
        x = x.withColumn("cells", F.transform(quoted, lambda c: F.regexp_replace(F.trim(c), '^"|"$', "")))
        x = x.select("file", "split", "line", "names", "n_columns", "time_column", "iso", "cells")
        self.dropped = x.groupBy("file").agg(F.count_if(F.size("cells") != F.col("n_columns")).alias("n_dropped"), F.count_if(F.size("cells") == F.col("n_columns")).alias("n"))
        x = x.where(F.size("cells") == F.col("n_columns"))
        raw = F.get("cells", F.col("time_column"))
        iso = F.unix_micros(F.try_to_timestamp(raw)) / 1000
        x = x.withColumn("raw", F.when(F.col("iso"), iso).otherwise(number(raw)))
        # seconds since the epoch have too many digits for their differences as floating numbers: the decimals that are written go along
        digits = F.when(F.col("iso"), F.unix_micros(F.try_to_timestamp(raw)).cast("decimal(19,0)") * F.lit(Decimal("0.001"))).otherwise(decimal(raw)).try_cast(DIGITS)
        x = x.withColumn("exact", F.when(digits.cast("double") == F.col("raw"), digits))
        order = ["split", "line"]
        x = previous(by_ranges(x, ["file"], order, parts), ["file"], order, F.struct("raw", "exact"), "before").withColumn("d", F.col("raw") - F.col("before.raw"))
        x = stored(x.drop("_part"), "lines")
        # the unit of time by the first value and the usual step
        first = x.where("raw is not null").groupBy("file").agg(F.min_by("raw", F.struct(*order)).alias("first"), F.min_by("exact", F.struct(*order)).alias("first_exact"), F.count("*").alias("n_times"), F.expr("percentile(case when d > 0 then d end, 0.5)").alias("step"), F.first("iso").alias("iso"))
        kind = F.when(F.col("iso"), "iso").when(F.col("n_times") < LEAST, None).when(F.col("first") > EPOCH_MS, "epoch_ms").when(F.col("first") > EPOCH_S, "epoch_s").when(F.col("step") >= STEP_MS, "relative_ms").otherwise("relative_s")
        self.times = stored(first.select("file", "first", "first_exact", kind.alias("time_kind")), "times")
        whole, relative = F.col("time_kind").isin("epoch_s", "relative_s"), F.col("time_kind").startswith("relative")

        def ms(time: str) -> Column:
            exact = F.col(f"{time}exact") - F.when(relative, F.col("first_exact")).otherwise(F.lit(Decimal(0)))
            exact = (exact * F.when(whole, F.lit(Decimal(1000))).otherwise(F.lit(Decimal(1)))).cast("double")
            return F.coalesce(exact, (F.col(f"{time}raw") - F.when(relative, F.col("first")).otherwise(0.0)) * F.when(whole, 1000.0).otherwise(1.0))

        self.rows = x.join(self.times.where("time_kind is not null"), "file").withColumns({"t_ms": ms(""), "d_ms": ms("") - ms("before.")})
        cells = self.rows.select("file", "split", "line", "t_ms", "names", "time_column", F.posexplode("cells").alias("at", "cell")).where("at <> time_column").withColumn("x", number(F.col("cell")))
        counted = cells.groupBy("file", "at").agg(F.count("*").alias("k"), F.count("x").alias("n_valid"), F.first(F.get("names", F.col("at"))).alias("channel")).where(F.col("n_valid") >= NUMERIC * F.col("k"))
        kinds = F.lit("unknown")
        for k, words in reversed(KINDS):
            kinds = F.when(F.lower("channel").rlike(words), k).otherwise(kinds)
        unit = F.nullif(F.regexp_extract("channel", r"[(\[]([^)\]]+)[)\]]", 1), F.lit(""))
        self.channels = stored(counted.select("file", "at", "channel", unit.alias("unit"), kinds.alias("kind"), "n_valid", (F.col("k") - F.col("n_valid")).alias("n_missing")), "channels")
        self._cells = cells

    def files(self) -> DataFrame:
        """(file, delimiter, header, time_column, time_kind, absolute, n, n_dropped, n_channels, rate, step_ms, jitter_pct, n_gaps, duration_s, reason) of each file. The rate is that
        of the median step, the jitter the quartiles' distance in percent of it, a gap a step of over three times it; relative times can't be aligned by
        themselves. A file that can't be read has a reason."""
        positive = F.when(F.col("d_ms") > 0, F.col("d_ms"))
        q = self.rows.groupBy("file").agg(F.percentile(positive, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias("q"), ((F.max("t_ms") - F.min("t_ms")) / 1000).alias("duration_s"))
        gaps = self.rows.join(q.select("file", F.get("q", 1).alias("usual")), "file").groupBy("file").agg(F.count_if(F.col("d_ms") > GAP * F.col("usual")).alias("n_gaps"))
        n = self.channels.groupBy("file").agg(F.count("*").alias("n_channels"))
        out = self.found.select("file", "delimiter", "header", "names", "time_column", "reason").join(self.dropped, "file", "left").join(self.times, "file", "left").join(q, "file", "left").join(gaps, "file", "left").join(n, "file", "left")
        reason = F.coalesce("reason", F.when(F.col("time_kind").isNull(), "no_time").when(F.col("n_channels").isNull(), "no_channel"))
        step = F.get("q", 1)
        return out.select(
            "file", "delimiter", "header", F.get("names", F.col("time_column")).alias("time_column"), "time_kind", (~F.col("time_kind").startswith("relative")).alias("absolute"), "n", "n_dropped", "n_channels",
            (1000 / step).alias("rate"), step.alias("step_ms"), (100 * (F.get("q", 2) - F.get("q", 0)) / step).alias("jitter_pct"), "n_gaps", "duration_s", reason.alias("reason"),
        )

    def samples(self) -> DataFrame:
        """(file, split, line, t_ms, channel, unit, kind, x) of the channels: the columns beside the time that are mostly numbers."""
        return self._cells.join(self.channels.drop("channel", "n_valid", "n_missing"), ["file", "at"]).select("file", "split", "line", "t_ms", F.get("names", F.col("at")).alias("channel"), "unit", "kind", "x")
