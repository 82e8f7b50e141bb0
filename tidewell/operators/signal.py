"""Raw records: one row is one record with its samples as an array. Kernels run on Arrow batches, one record at a time."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewell.functions import dsp

#: The bands of a spectrum, in Hz.
BANDS = {"theta": (4, 8), "alpha": (8, 12), "low_beta": (12, 20), "high_beta": (20, 35), "gamma": (60, 90)}


def per_record(records: DataFrame, kernel: Callable[[np.ndarray, float], list[tuple]], schema: str, key: str = "rec") -> DataFrame:
    """Rows (key, ...) that a kernel gives for each record (key, x, fs). A missing sample is NaN for the kernel."""
    names = [part.split()[0] for part in schema.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = [(k, *row) for k, x, fs in zip(b[key], b["x"], b["fs"], strict=True) if x is not None for row in kernel(np.asarray(x, dtype=float), float(fs))]
            yield pd.DataFrame(out, columns=[key, *names])

    kind = dict(records.dtypes)[key]
    return records.select(key, "x", "fs").mapInPandas(run, f"{key} {kind}, {schema}")


def power_spectra(records: DataFrame, key: str = "rec", window: int | None = None) -> DataFrame:
    """(key, f, p, n_segments): Welch spectra; empty where too few whole segments are left."""
    return per_record(records, lambda x, fs: [(list(r[0]), list(r[1]), r[2]) for r in [dsp.welch(x, fs, window)]], "f array<double>, p array<double>, n_segments int", key)


def spectral_rows(records: DataFrame, key: str = "rec", window: int | None = None) -> DataFrame:
    """(key, band, power, relative, peak_hz) of each band of each record; null without a spectrum."""

    def kernel(x, fs):
        f, p, _ = dsp.welch(x, fs, window)
        total = dsp.band_power(f, p, 1, fs / 2) if len(f) else math.nan
        rows = []
        for name, (lo, hi) in BANDS.items():
            power = dsp.band_power(f, p, lo, hi) if len(f) else math.nan
            top = dsp.peak(f, p, lo, hi)[0] if len(f) else math.nan
            rows.append((name, *(v if math.isfinite(v) else None for v in (power, power / total if total else math.nan, top))))
        return rows

    return per_record(records, kernel, "band string, power double, relative double, peak_hz double", key)


def burst_rows(records: DataFrame, low: float = 13, high: float = 30, key: str = "rec") -> DataFrame:
    """(key, n_bursts, mean_s, rate): bursts of a band and how long and frequent they are."""

    def kernel(x, fs):
        b = dsp.bursts(x, fs, low, high)
        return [(len(b), float(np.mean([d for _, d, _ in b])) if b else None, len(b) * fs / len(x) if len(x) else None)]

    return per_record(records, kernel, "n_bursts int, mean_s double, rate double", key)


def aperiodic_rows(records: DataFrame, low: float = 2, high: float = 30, key: str = "rec", window: int | None = None) -> DataFrame:
    """(key, offset, exponent, r2) of each record's spectrum."""

    def kernel(x, fs):
        f, p, _ = dsp.welch(x, fs, window)
        return [tuple(v if math.isfinite(v) else None for v in dsp.aperiodic(f, p, low, high))]

    return per_record(records, kernel, "offset double, exponent double, r2 double", key)


def dft_power(records: DataFrame, frequencies: int = 32, key: str = "rec") -> DataFrame:
    """(key, k, power): periodogram of a record by sums over its samples, all in columns."""
    x = records.select(key, F.size("x").alias("n"), F.posexplode("x").alias("i", "v"))
    rows = x.select(key, "n", "i", "v", F.explode(F.sequence(F.lit(0), F.lit(frequencies))).alias("k"))
    a = F.col("k") * F.col("i") * (2 * math.pi) / F.col("n")
    return rows.groupBy(key, "k").agg(((F.sum(F.col("v") * F.cos(a)) ** 2 + F.sum(F.col("v") * F.sin(a)) ** 2) / F.max("n")).alias("power"))


def band_share(spectrum: DataFrame, low: int, high: int, key: str = "rec") -> DataFrame:
    """Share of each record's power (k > 0) within a closed band."""
    inside = F.sum(F.when(F.col("k").between(low, high), F.col("power")).otherwise(0.0))
    return spectrum.where("k > 0").groupBy(key).agg((inside / F.sum("power")).alias("share"))


def packet_gaps(packets: DataFrame, usual_s: float, by: list[str]) -> DataFrame:
    """Packets, lost ones (steps of several usual distances) and the effective rate of each stream of arrival times `s`."""
    from pyspark.sql import Window

    step = F.col("s") - F.lag("s").over(Window.partitionBy(*by).orderBy("s", "row_ord"))
    x = packets.withColumn("step", step)
    lost = F.greatest(F.floor(F.col("step") / usual_s + 0.5) - 1, F.lit(0))
    out = x.groupBy(*by).agg(F.count("*").alias("n"), F.coalesce(F.sum(lost), F.lit(0)).cast("long").alias("n_lost"), (F.max("s") - F.min("s")).alias("span_s"))
    return out.withColumn("per_hour", F.try_divide((F.col("n") - 1) * 3600.0, F.col("span_s")))


def coherence_rows(pairs: DataFrame, bands: dict[str, tuple[float, float]], key: str = "rec", window: int | None = None, alpha: float = 0.05) -> DataFrame:
    """(key, band, mean, peak, peak_hz, threshold, significant) of pairs (key, a, b, fs) of records of one clock.

    `threshold` is what the greatest of a band's bins passes by chance with probability alpha: the limit of one bin for the
    number of segments that half-overlapping ones are worth, corrected for the number of bins. Nulls where under three
    whole segments or bins are left.
    """

    def kernel(a, b, fs):
        f, c, n = dsp.coherence(a, b, fs, window)
        rows = []
        for name, (lo, hi) in bands.items():
            at = np.flatnonzero((f >= lo) & (f <= hi)) if len(f) else np.zeros(0, int)
            if len(at) < 3:
                rows.append((name, None, None, None, None, None))
                continue
            free = max(2, math.floor(n / 1.5 + 0.5))
            limit = 1 - (1 - (1 - alpha) ** (1 / len(at))) ** (1 / (free - 1))
            top = at[int(np.argmax(c[at]))]
            rows.append((name, float(c[at].mean()), float(c[top]), float(f[top]), float(limit), bool(c[top] > limit)))
        return rows

    names = [key, "band", "mean", "peak", "peak_hz", "threshold", "significant"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in batches:
            rows = zip(x[key], x["a"], x["b"], x["fs"], strict=True)
            yield pd.DataFrame([(k, *r) for k, a, b, fs in rows if a is not None and b is not None for r in kernel(np.asarray(a, float), np.asarray(b, float), float(fs))], columns=names)

    return pairs.select(key, "a", "b", "fs").mapInPandas(run, f"{key} {dict(pairs.dtypes)[key]}, band string, mean double, peak double, peak_hz double, threshold double, significant boolean")
