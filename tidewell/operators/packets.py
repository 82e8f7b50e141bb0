"""Integrity of raw streams: counters that wrap, lost packets, gaps as missing samples, measured rates and stitched records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The documented wrap of ticks (65536 ticks of 50 ms), its fallback, and the wraps of sequence numbers.
TICK_WRAP, TICK_WRAP_FALLBACK = 65536 * 50, 65536
SEQUENCE_WRAP = {"B35200|PERCEPT\\s*PC": 256, "B35300|PERCEPT\\s*RC": 65536}
#: Streams whose sequence numbers are shared with another stream.
INTERLEAVED = ("BrainSenseTimeDomain", "BrainSenseLfp")


def nearest(x: Column) -> Column:
    """To the nearest whole number, halves up."""
    return F.floor(x + 0.5)


def sequence_wrap(model: Column) -> Column:
    """Where the sequence numbers of a stimulator model wrap; null for an unknown model."""
    out = F.lit(None).cast("int")
    for pattern, wrap in reversed(SEQUENCE_WRAP.items()):
        out = F.when(F.upper(model).rlike(pattern), wrap).otherwise(out)
    return out


def unwrap_counter(rows: DataFrame, value: str, wrap: int | Column, by: list[str], order: str = "ord", out: str = "unwrapped") -> DataFrame:
    """A cyclic counter made to go on: a whole wrap is added at each fall."""
    w = Window.partitionBy(*by).orderBy(order)
    fall = F.coalesce((F.col(value) < F.lag(value).over(w)).cast("long"), F.lit(0))
    total = F.sum("_fall").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    wrap = wrap if isinstance(wrap, Column) else F.lit(wrap)
    return rows.withColumn("_fall", fall).withColumn(out, F.col(value) + wrap * total).drop("_fall")


def unwrap_ticks(packets: DataFrame, by: list[str], order: str = "ord") -> DataFrame:
    """packets (ticks) with `unwrapped` and the `wrap` used.

    Without a fall the ticks stay. Else the documented wrap is used, unless it leaves a step that isn't positive or
    the fallback makes the steps ten times as even; where neither gives positive steps the ticks stay, wrap null.
    """
    w = Window.partitionBy(*by).orderBy(order)
    x = unwrap_counter(unwrap_counter(packets, "ticks", TICK_WRAP, by, order, "_doc"), "ticks", TICK_WRAP_FALLBACK, by, order, "_alt")
    x = x.withColumns({"_d": F.col("_doc") - F.lag("_doc").over(w), "_a": F.col("_alt") - F.lag("_alt").over(w)})
    middle = x.groupBy(*by).agg(F.percentile("_d", F.lit(0.5)).alias("_md"), F.percentile("_a", F.lit(0.5)).alias("_ma"), F.min("_d").alias("_ld"), F.min("_a").alias("_la"), F.max(F.col("_doc") != F.col("ticks")).alias("_falls"))
    spread = lambda d, m: F.avg(F.abs(F.col(d) - F.col(m))) / F.abs(F.when(F.max(m) == 0, 1).otherwise(F.max(m)))
    score = x.join(middle, by).groupBy(*by).agg(spread("_d", "_md").alias("_sd"), spread("_a", "_ma").alias("_sa"), F.max("_ld").alias("_ld"), F.max("_la").alias("_la"), F.max("_falls").alias("_falls"))
    doc, alt = F.col("_ld") > 0, F.col("_la") > 0
    wrap = F.when(~F.col("_falls"), F.lit(None)).when(doc & ~(alt & (F.col("_sa") * 10 < F.col("_sd"))), TICK_WRAP).when(alt, TICK_WRAP_FALLBACK)
    x = x.join(score.select(*by, wrap.cast("int").alias("wrap")), by)
    value = F.when(F.col("wrap") == TICK_WRAP, F.col("_doc")).when(F.col("wrap") == TICK_WRAP_FALLBACK, F.col("_alt")).otherwise(F.col("ticks"))
    return x.withColumn("unwrapped", value).drop("_doc", "_alt", "_d", "_a")


def _most_frequent(rows: DataFrame, value: Column, by: list[str], out: str) -> DataFrame:
    """The most frequent value of each group, the smallest of several."""
    return rows.where(value.isNotNull()).groupBy(*by).agg(F.mode(value, True).alias(out))


def packet_gaps(packets: DataFrame, by: list[str], fs: float = 250.0, order: str = "ord") -> DataFrame:
    """(by, ord, method, start_idx, n_packets, n_samples): what is lost before a packet of streams (ticks, seq, size, model, stream).

    Sequence numbers count where the stream has them for itself and the model tells their wrap: a step over one is a
    loss. Else ticks: a step longer than the packet before it and one sample is a loss of as many packets as usual
    steps fit into it, one at least.
    """
    w = Window.partitionBy(*by).orderBy(order)
    x = unwrap_ticks(packets, by, order).drop("wrap").withColumnRenamed("unwrapped", "_t").withColumn("_wrap", sequence_wrap(F.col("model")))
    x = unwrap_counter(x, "seq", F.coalesce("_wrap", F.lit(0)), by, order, "_s")
    x = x.withColumns({
        "method": F.when(F.col("_wrap").isNotNull() & ~F.col("stream").isin(*INTERLEAVED), "sequences").otherwise("ticks"),
        "_dt": F.col("_t") - F.lag("_t").over(w), "_ds": F.col("_s") - F.lag("_s").over(w), "_before": F.lag("size").over(w),
        "start_idx": F.coalesce(F.sum("size").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)),
    })
    usual = _most_frequent(x, F.col("size"), by, "_size").join(_most_frequent(x, nearest(F.col("_dt")), by, "_step"), by, "left")
    x = x.join(usual, by)
    step = F.when(F.col("_step") > 0, F.col("_step")).otherwise(1000 * F.col("_before") / fs)
    lost = F.when(F.col("method") == "sequences", F.col("_ds") - 1)
    lost = lost.when(F.col("_dt") > 1000 * (1 + F.col("_before")) / fs, F.greatest(F.lit(1), nearest(F.col("_dt") / step) - 1)).otherwise(0)
    x = x.withColumn("n_packets", lost.cast("long")).where("n_packets >= 1")
    return x.select(*by, order, "method", F.col("start_idx").cast("long").alias("start_idx"), "n_packets", (F.col("n_packets") * F.col("_size")).cast("long").alias("n_samples"))


def packet_loss(packets: DataFrame, by: list[str], fs: float = 250.0) -> DataFrame:
    """(by, n_received, n_missing, n_expected, percent_missing, n_gaps): samples of each stream."""
    gaps = packet_gaps(packets, by, fs).groupBy(*by).agg(F.count("*").alias("n_gaps"), F.sum("n_samples").alias("n_missing"))
    out = packets.groupBy(*by).agg(F.sum("size").cast("long").alias("n_received")).join(gaps, by, "left").fillna(0, ["n_gaps", "n_missing"])
    expected = F.col("n_received") + F.col("n_missing")
    return out.select(*by, "n_received", "n_missing", expected.alias("n_expected"), (100 * F.try_divide(F.col("n_missing"), expected)).alias("percent_missing"), "n_gaps")


def effective_rate(packets: DataFrame, by: list[str], fs: float = 250.0, order: str = "ord") -> DataFrame:
    """(by, n_samples, fs_eff, ppm, drift_ms, warn): the rate that the ticks show, from the first packet to the last one's
    start; what its difference from the nominal rate adds up to, warned of beyond 20 ms."""
    x = unwrap_ticks(packets, by, order)
    m = x.groupBy(*by).agg(F.sum("size").cast("double").alias("n"), F.max_by("size", order).alias("last"), (F.max_by("unwrapped", order) - F.min_by("unwrapped", order)).alias("span"), F.count("*").alias("k"))
    m = m.where("k >= 2 and span > 0 and n > last").withColumn("fs_eff", (F.col("n") - F.col("last")) / (F.col("span") / 1000))
    drift = F.col("n") * 1000 * (1 / F.lit(fs) - 1 / F.col("fs_eff"))
    return m.select(*by, F.col("n").cast("long").alias("n_samples"), "fs_eff", ((F.col("fs_eff") - fs) / fs * 1e6).alias("ppm"), drift.alias("drift_ms"), (F.abs(drift) > 20).alias("warn"))


def insert_gaps(samples: DataFrame, gaps: DataFrame, by: list[str]) -> DataFrame:
    """(by, i, v, missing): samples (by, i, v) moved on by what is lost before them, and a row without value for each lost
    sample of gaps (by, start_idx, n_samples). Nothing is interpolated or joined over a gap."""
    w = Window.partitionBy(*by).orderBy("pos", "kind", "n").rowsBetween(Window.unboundedPreceding, -1)
    both = samples.select(*by, F.col("i").cast("long").alias("pos"), F.lit(1).alias("kind"), F.lit(0).cast("long").alias("n"), "v")
    both = both.unionByName(gaps.select(*by, F.col("start_idx").cast("long").alias("pos"), F.lit(0).alias("kind"), F.col("n_samples").cast("long").alias("n"), F.lit(None).cast("double").alias("v")))
    both = both.withColumn("at", F.col("pos") + F.coalesce(F.sum("n").over(w), F.lit(0)))
    lost = both.where("kind = 0 and n > 0").select(*by, F.explode(F.sequence(F.col("at"), F.col("at") + F.col("n") - 1)).alias("i"), F.lit(None).cast("double").alias("v"), F.lit(True).alias("missing"))
    return both.where("kind = 1").select(*by, F.col("at").alias("i"), "v", F.lit(False).alias("missing")).unionByName(lost)


def stitch_streams(streams: DataFrame, by: list[str], most_gap_s: float = 600.0) -> DataFrame:
    """(by, t0_ms, ord, segment, start_idx, filler): records (t0_ms, n, fs, ord) one after another, with as many missing samples
    between two as their distance holds, if that is at most `most_gap_s`."""
    w = Window.partitionBy(*by).orderBy("t0_ms", "ord")
    gap = F.col("t0_ms") - F.lag(F.col("t0_ms") + F.col("n") / F.col("fs") * 1000).over(w)
    filler = F.when((gap > 0) & (gap / 1000 <= most_gap_s), nearest(gap / 1000 * F.first("fs").over(w))).otherwise(0)
    x = streams.withColumns({"filler": filler.cast("long"), "segment": (F.row_number().over(w) - 1).cast("long")})
    before = F.coalesce(F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) + F.sum("filler").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return x.select(*by, "t0_ms", "ord", "segment", before.cast("long").alias("start_idx"), "filler")
