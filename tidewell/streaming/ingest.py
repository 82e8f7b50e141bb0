"""Live series: late and repeated samples, zones by time windows, gaps by session windows, and a controller with keyed state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tidewell.functions.columns import zone

SERIES = "subject long, hemisphere string, t timestamp, lfp_raw double"


def read_series(spark: SparkSession, path: str, files_per_trigger: int = 100) -> DataFrame:
    return spark.readStream.schema(SERIES).option("maxFilesPerTrigger", files_per_trigger).json(path)


def first_of_each(series: DataFrame, late: str = "1 day") -> DataFrame:
    """Censored readings to null; of samples with equal keys and time the first within the watermark."""
    x = series.withWatermark("t", late).dropDuplicatesWithinWatermark(["subject", "hemisphere", "t"])
    return x.select("subject", "hemisphere", "t", F.when(F.col("lfp_raw") >= 0, F.col("lfp_raw")).alias("lfp"), (F.col("lfp_raw") < 0).alias("censored"))


def zone_windows(series: DataFrame, lower: float, upper: float, width: str = "1 hour") -> DataFrame:
    """Samples by zone in windows of time."""
    x = series.where("lfp is not null").withColumn("zone", zone(F.col("lfp"), F.lit(lower), F.lit(upper)))
    w = x.groupBy(F.window("t", width), "subject", "hemisphere").agg(*[F.count_if(F.col("zone") == z).alias(z) for z in ("below", "between", "above")])
    return w.select("subject", "hemisphere", F.col("window.start").alias("start"), "below", "between", "above")


def sessions(series: DataFrame, gap: str = "30 minutes") -> DataFrame:
    """Stretches without a gap."""
    w = series.groupBy(F.session_window("t", gap), "subject", "hemisphere").agg(F.count("*").alias("n"))
    return w.select("subject", "hemisphere", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")


def controller(series: DataFrame, lower: float, upper: float, least: int = 0, most: int = 30, start: int = 15, forget_ms: int = 7 * 86_400_000) -> DataFrame:
    """The steps of a two-threshold controller, its level kept by series. Samples of a trigger are taken in time order; a sample
    older than the last one taken is left out and counted. Series that are silent for forget_ms start anew."""

    def run(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        level, last, old = state.get if state.exists else (start, -1, 0)
        rows = pd.concat(list(batches)).dropna(subset=["lfp"]).sort_values("t")
        out = []
        for t, v in zip(rows["t"], rows["lfp"], strict=True):
            at = t.value // 1000
            if at <= last:
                old += 1
                continue
            level, last = min(most, max(least, level + (v > upper) - (v < lower))), at
            out.append((*key, t, int(level), old))
        state.update((int(level), int(last), int(old)))
        state.setTimeoutDuration(forget_ms)
        yield pd.DataFrame(out, columns=["subject", "hemisphere", "t", "level", "n_old"])

    return series.groupBy("subject", "hemisphere").applyInPandasWithState(
        run, "subject long, hemisphere string, t timestamp, level int, n_old long", "level int, last long, old long", "append", GroupStateTimeout.ProcessingTimeTimeout
    )
