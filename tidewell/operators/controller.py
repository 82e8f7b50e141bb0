"""Two-limit controllers over series of any length, as scans of composed steps.

A step of the stepwise controller is a clamp, x -> min(hi, max(lo, x + d)), and clamps compose to a clamp. Each piece of a
series (its rows in one range) becomes one clamp; the clamps of a series' pieces, in order, tell the level at which
each piece begins; a second pass over the pieces starts there. A delivered current that follows a target by a ramp isn't
a clamp, but its steps keep order and never move levels apart: a piece whose lowest and highest start end alike has
told its end without its start.

No task holds more of a series than a piece. The cells of a grid of limits are followed side by side in arrays.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewell.functions.columns import millis, ratio
from tidewell.sources.shared import stored

from .chronic import KEYS
from .ranges import by_ranges, previous, runs

#: A controller's step in mA, the shares aimed at and accepted below, within and above the limits in percent,
#: the weight of saturation in tuning, the span and the step of tuning in percent.
STEP = 0.1
TARGETS = (20.0, 60.0, 20.0)
ACCEPTED = ((10.0, 35.0), (45.0, 75.0), (10.0, 35.0))
SATURATION_WEIGHT, SPAN, SPAN_STEP = 0.5, 15, 1
#: Values of a series whose targets are computed at once.
SLAB = 4096
#: Currents are kept in ten-thousandths of a mA.
UNIT = 10_000
FAR = 1 << 40


def _units(ma: float) -> int:
    return round(ma * UNIT)


def _sorted(b: pd.DataFrame) -> np.ndarray:
    return b.sort_values(["t", "row_ord"])["lfp"].to_numpy(float)


class Steps:
    """The stepwise controller: a step up above the upper limit, down below the lower one, held in [least, most]."""

    def __init__(self, least: float, most: float, start: float, step: float):
        if not least <= start <= most or least >= most or step <= 0:
            raise ValueError("current limits must be ordered, with the start between them and a positive step")
        self.least, self.most, self.start, self.step = map(_units, (least, most, start, step))

    def clamp(self, values: np.ndarray, lower: np.ndarray, upper: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The values' steps as one clamp (d, lo, hi) for each cell."""
        d, lo, hi = np.zeros(len(lower), np.int64), np.full(len(lower), -FAR), np.full(len(lower), FAR)
        for v in values:
            move = self.step * ((v > upper).astype(np.int64) - (v < lower))
            d, lo, hi = d + move, np.clip(lo + move, self.least, self.most), np.clip(hi + move, self.least, self.most)
        return d, lo, hi

    def follow(self, values: np.ndarray, lower: np.ndarray, upper: np.ndarray, level: np.ndarray):
        """The levels after each value."""
        for v in values:
            move = self.step * ((v > upper).astype(np.int64) - (v < lower))
            level = np.clip(level + move, self.least, self.most)
            yield level


def _cells(b: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    return np.asarray(b["lower"].iloc[0], float), np.asarray(b["upper"].iloc[0], float)


def _kinds(df: DataFrame, keys: list[str]) -> str:
    return ", ".join(f"{k} {t}" for k, t in df.select(*keys).dtypes)


def _grouped(limits: DataFrame, keys: list[str]) -> DataFrame:
    """One row a series, with arrays of its cells' limits by cell."""
    each = F.sort_array(F.collect_list(F.struct("cell", "lower", "upper")))
    return limits.groupBy(*keys).agg(each.alias("c")).select(*keys, F.col("c.cell").alias("cell"), F.col("c.lower").alias("lower"), F.col("c.upper").alias("upper"))


def _starts(ranged: DataFrame, cells: DataFrame, keys: list[str], steps: Steps) -> DataFrame:
    """(_part, keys, cell, lower, upper, level): the levels of all cells at which each piece begins."""
    names = ["_part", *keys, "d", "lo", "hi"]

    def composed(key, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if left.empty or right.empty:
            return pd.DataFrame(columns=names)
        return pd.DataFrame([[*key, *steps.clamp(_sorted(left), *_cells(right))]], columns=names)

    spread = stored(ranged.select("_part", *keys).distinct().join(cells, keys), "cells")
    by = ["_part", *keys]
    kinds = f"_part int, {_kinds(ranged, keys)}"
    clamps = ranged.groupBy(*by).cogroup(spread.groupBy(*by)).applyInPandas(composed, f"{kinds}, d array<long>, lo array<long>, hi array<long>")

    def chained(b: pd.DataFrame) -> pd.DataFrame:
        """A row for each piece of one series."""
        b = b.sort_values("_part")
        level, out = np.full(len(b["d"].iloc[0]), steps.start), []
        for d, lo, hi in zip(b["d"], b["lo"], b["hi"], strict=True):
            out.append(level)
            level = np.minimum(hi, np.maximum(lo, level + d))
        return b[by].assign(level=out)

    return spread.join(clamps.groupBy(*keys).applyInPandas(chained, f"{kinds}, level array<long>"), by)


def step_levels(series: DataFrame, limits: DataFrame, keys: list[str] | None = None, least: float = 0.0, most: float = 3.0, start: float | None = None, step: float = STEP, parts: int | None = None) -> DataFrame:
    """(keys, t, row_ord, lfp, current): the current in mA after each sample of the stepwise controller; missing samples and
    series without limits are left out. `limits` (keys, lower, upper) has one row a series."""
    keys = keys or KEYS
    steps = Steps(least, most, (least + most) / 2 if start is None else start, step)
    ranged = by_ranges(series.where("lfp is not null").select(*keys, "t", "row_ord", "lfp"), keys, ["t", "row_ord"], parts)
    begun = _starts(ranged, _grouped(limits.withColumn("cell", F.lit(0)), keys), keys, steps)
    by = ["_part", *keys]

    def run(key, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if left.empty or right.empty:
            return left.drop(columns="_part").assign(current=0.0).iloc[:0]
        left = left.sort_values(["t", "row_ord"]).drop(columns="_part")
        level = steps.follow(left["lfp"].to_numpy(float), *_cells(right), np.asarray(right["level"].iloc[0]))
        return left.assign(current=[x[0] / UNIT for x in level])

    return ranged.groupBy(*by).cogroup(begun.groupBy(*by)).applyInPandas(run, f"{_kinds(series, keys)}, t timestamp, row_ord long, lfp double, current double")


def simulate_controller(series: DataFrame, limits: DataFrame, keys: list[str] | None = None, least: float = 0.0, most: float = 3.0, start: float | None = None, step: float = STEP, parts: int | None = None) -> DataFrame:
    """(keys, cell, lower, upper, n, pct_below, pct_within, pct_above, pct_sat_low, pct_sat_high, pct_saturated, mean_current,
    accepted) of the stepwise controller for each cell of `limits` (keys, cell, lower, upper).

    Saturated are samples that leave the current at one of its own limits, whether or not they moved it. Accepted are cells whose
    shares lie in the bands. The start is the middle of the range unless given. Cells whose upper limit isn't above the lower
    one are left out, as are missing samples.
    """
    keys = keys or KEYS
    steps = Steps(least, most, (least + most) / 2 if start is None else start, step)
    ranged = by_ranges(series.where("lfp is not null").select(*keys, "t", "row_ord", "lfp"), keys, ["t", "row_ord"], parts)
    begun = _starts(ranged, _grouped(limits.where("upper > lower").select(*keys, "cell", "lower", "upper"), keys), keys, steps)
    by = ["_part", *keys]
    sums = ["n", "below", "above", "sat_low", "sat_high", "total"]
    names = [*keys, "cell", "lower", "upper", *sums]

    def run(key, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if left.empty or right.empty:
            return pd.DataFrame(columns=names)
        values, (lower, upper) = _sorted(left), _cells(right)
        low, high, total = (np.zeros(len(lower), np.int64) for _ in range(3))
        for level in steps.follow(values, lower, upper, np.asarray(right["level"].iloc[0])):
            low, high, total = low + (level <= steps.least), high + (level >= steps.most), total + level
        ordered = np.sort(values)
        below, above = np.searchsorted(ordered, lower, "left"), len(values) - np.searchsorted(ordered, upper, "right")
        head = dict(zip(keys, key[1:], strict=True))
        return pd.DataFrame(head | dict(zip(names[len(keys) :], (right["cell"].iloc[0], lower, upper, len(values), below, above, low, high, total), strict=True)))

    kinds = f"{_kinds(series, keys)}, cell int, lower double, upper double, {', '.join(f'{c} long' for c in sums)}"
    parts_ = ranged.groupBy(*by).cogroup(begun.groupBy(*by)).applyInPandas(run, kinds)
    out = parts_.groupBy(*keys, "cell", "lower", "upper").agg(*[F.sum(c).alias(c) for c in sums])
    share = lambda c: 100 * ratio(c, F.col("n"))
    out = out.select(
        *keys, "cell", "lower", "upper", "n", share(F.col("below")).alias("pct_below"), share(F.col("n") - F.col("below") - F.col("above")).alias("pct_within"), share(F.col("above")).alias("pct_above"),
        share(F.col("sat_low")).alias("pct_sat_low"), share(F.col("sat_high")).alias("pct_sat_high"), share(F.col("sat_low") + F.col("sat_high")).alias("pct_saturated"),
        ratio(F.col("total"), F.col("n") * UNIT).alias("mean_current"),
    )
    bands = [F.col(c).between(*b) for c, b in zip(("pct_below", "pct_within", "pct_above"), ACCEPTED, strict=True)]
    return out.withColumn("accepted", bands[0] & bands[1] & bands[2])


def tuning_grid(limits: DataFrame, keys: list[str] | None = None, span: int = SPAN, step: int = SPAN_STEP) -> DataFrame:
    """(keys, cell, lower, upper): cell 0 has the limits themselves, the others both limits changed by whole percents and rounded
    to whole units, lower ones first; equal pairs come once, and pairs out of order not at all."""
    keys = keys or KEYS
    share = lambda: F.explode(F.sequence(F.lit(-span), F.lit(span), F.lit(step)))
    grid = limits.withColumn("a", share()).withColumn("b", share())
    near = lambda c, f: F.floor(F.col(c) * (100 + F.col(f)) / 100 + 0.5).cast("double")
    grid = grid.select(*keys, (1 + (F.col("a") + span) * (2 * span + 1) + F.col("b") + span).cast("int").alias("cell"), near("lower", "a").alias("lower"), near("upper", "b").alias("upper"))
    grid = grid.where("upper > lower").groupBy(*keys, "lower", "upper").agg(F.min("cell").alias("cell"))
    return limits.select(*keys, F.lit(0).alias("cell"), F.col("lower").cast("double"), F.col("upper").cast("double")).unionByName(grid)


def tune_limits(series: DataFrame, limits: DataFrame, keys: list[str] | None = None, **current) -> DataFrame:
    """(keys, lower, upper, cost, base_cost, improved, pct_below, pct_within, pct_above, pct_saturated): of the limits and those
    around them the pair whose shares come nearest to the targets, with half the saturation as a penalty. A pair must be better
    than the limits themselves to take their place; of equally good ones the first in the grid's order wins."""
    keys = keys or KEYS
    seen = simulate_controller(series, tuning_grid(limits, keys), keys, **current)
    apart = sum((F.abs(F.col(c) - t) for c, t in zip(("pct_below", "pct_within", "pct_above"), TARGETS, strict=True)), F.lit(0.0))
    seen = seen.withColumn("cost", F.round(apart + SATURATION_WEIGHT * F.col("pct_saturated"), 9))
    best = F.struct("cost", "cell", "lower", "upper", "pct_below", "pct_within", "pct_above", "pct_saturated")
    out = seen.groupBy(*keys).agg(F.min(best).alias("b"), F.max(F.when(F.col("cell") == 0, F.col("cost"))).alias("base_cost"))
    shares = [f"b.{c}" for c in ("pct_below", "pct_within", "pct_above", "pct_saturated")]
    return out.select(*keys, "b.lower", "b.upper", "b.cost", "base_cost", (F.col("b.cost") < F.col("base_cost")).alias("improved"), *shares)


def smoothed(series: DataFrame, window_ms: int, keys: list[str] | None = None) -> DataFrame:
    """Add `mean`, over the samples of the last window_ms milliseconds up to the row. Each sample also stands in the next bucket of
    that length, so that a window is one bucket, not one series."""
    keys = keys or KEYS
    x = series.withColumn("_ms", millis(F.col("t")))
    own = F.floor(F.col("_ms") / window_ms)
    x = x.select("*", F.explode(F.array(own, own + 1)).alias("_bucket")).withColumn("_own", F.col("_bucket") == own)
    w = Window.partitionBy(*keys, "_bucket").orderBy("_ms").rangeBetween(-window_ms, 0)
    return x.withColumn("mean", F.avg("lfp").over(w)).where("_own").drop("_ms", "_bucket", "_own")


class Ramp:
    """A current that follows a target between [least, most] at no more than `rate` mA a second: the target is least up to the
    lower limit, most from the upper one on and in proportion between, or with `single` most above the upper limit only."""

    def __init__(self, least: float, most: float, rate: float, single: bool):
        self.least, self.most, self.rate, self.single = least, most, rate, single

    def follow(self, values: np.ndarray, seconds: np.ndarray, lower: np.ndarray, upper: np.ndarray, level: np.ndarray | None, before: float | None):
        """The levels after each value, SLAB values at a time; `before` is the time of the sample that left `level`, which may have more axes before the
        one of the cells. The first one takes its target at once."""
        # targets and reaches of a slab are arrays; what is left for each value are four operations on the level
        for first in range(0, len(values), SLAB):
            v, s = values[first : first + SLAB, None], seconds[first : first + SLAB]
            share = (v > upper).astype(float) if self.single else np.clip((v - lower) / (upper - lower), 0.0, 1.0)
            target = np.where(share >= 1, self.most, self.least + share * (self.most - self.least))
            reach = self.rate * np.diff(s, prepend=s[0] if before is None else before)
            out = np.empty((len(v), *(target.shape[1:] if level is None else np.shape(level))))
            back = -reach
            for i in range(len(v)):
                if level is None:
                    out[i] = target[i]
                else:
                    step = np.subtract(target[i], level, out=out[i])
                    np.minimum(step, reach[i], out=step)
                    np.maximum(step, back[i], out=step)
                    np.add(step, level, out=step)
                level = out[i]
            before = s[-1]
            yield out


def _ramp_pass(ranged: DataFrame, begun: DataFrame, keys: list[str], ramp: Ramp, what: str) -> DataFrame:
    """Follow the pieces of `begun` (_part, keys, cell, lower, upper, low, high, before): `ends` are the levels they end at from
    the lowest and the highest they may begin at, `levels` those of each sample from `low`, `sums` their sums for each cell."""
    by = ["_part", *keys]
    schema = {
        "ends": "low_end array<double>, high_end array<double>, end_s double",
        "levels": "t timestamp, row_ord long, s double, cell int, current double",
        "sums": "cell int, n long, n_low long, n_high long, changes long, first int, last int, total double, square double, from_s double, to_s double",
    }[what]
    kinds = f"_part int, {_kinds(ranged, keys)}, {schema}"
    names = [c.split()[0] for c in kinds.split(", ")]

    def run(key, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if left.empty or right.empty:
            return pd.DataFrame(columns=names)
        left, r = left.sort_values(["t", "row_ord"]), right.iloc[0]
        values, seconds, cells = left["mean"].to_numpy(float), left["s"].to_numpy(float), _cells(right)
        before = None if pd.isna(r["before"]) else r["before"]

        def levels(begin):
            return ramp.follow(values, seconds, *cells, None if begin is None else np.asarray(begin, float), before)

        if what == "ends":
            if r["low"] is None:
                (*_, last) = levels(r["low"])
                ends = [last[-1]] * 2
            else:  # from both ends at once
                (*_, last) = levels(np.stack([np.asarray(r["low"], float), np.asarray(r["high"], float)]))
                ends = list(last[-1])
            return pd.DataFrame([[*key, *ends, seconds[-1]]], columns=names)
        if what == "levels":
            out = left[[*by, "t", "row_ord", "s"]].assign(cell=[r["cell"]] * len(left), current=list(np.concatenate(list(levels(r["low"])))))
            return out.explode(["cell", "current"]).astype({"cell": "int32", "current": float})
        low, high, changes = (np.zeros(len(cells[0]), np.int64) for _ in range(3))
        total, square, first, last = np.zeros(len(low)), np.zeros(len(low)), None, None
        for level in levels(r["low"]):
            state = (level >= ramp.most - 1e-9).astype(np.int8) - (level <= ramp.least + 1e-9)
            first = state[0] if first is None else first
            changes += np.count_nonzero(np.diff(state, axis=0, prepend=state[:1] if last is None else last[None]), axis=0)
            low, high, total, square, last = low + (state < 0).sum(axis=0), high + (state > 0).sum(axis=0), total + level.sum(axis=0), square + (level**2).sum(axis=0), state[-1]
        rest = (r["cell"], len(values), low, high, changes, first, last, total, square, seconds[0], seconds[-1])
        return pd.DataFrame(dict(zip(names, [*key, *rest], strict=True)))

    return ranged.groupBy(*by).cogroup(begun.groupBy(*by)).applyInPandas(run, kinds)


class RampRun:
    """The pieces of all series with the levels at which they begin, for each cell of `limits` (keys, cell, lower, upper with upper
    > lower). Times of a series must differ; series under eight samples are left out.

    Pieces are followed from both ends of the range of currents; where that leaves the start of a later piece open, they are
    followed again from what is known by then, each round settling at least one more piece of each series, until all starts are.
    """

    def __init__(self, series: DataFrame, limits: DataFrame, keys: list[str] | None = None, least: float = 1.0, most: float = 3.0, window_ms: int = 3000, rate: float = 0.2, single: bool = False, parts: int | None = None):
        self.keys = keys = keys or KEYS
        x = series.where("lfp is not null").select(*keys, "t", "row_ord", "lfp")
        x = x.join(x.groupBy(*keys).agg(F.count("*").alias("_n")).where("_n >= 8").select(*keys), keys)
        x = smoothed(x, window_ms, keys).withColumn("s", millis(F.col("t")) / 1000.0)
        self.ranged = by_ranges(x.select(*keys, "t", "row_ord", "s", "mean"), keys, ["t", "row_ord"], parts)
        self.ramp, by = Ramp(least, most, rate, single), ["_part", *keys]
        cells = _grouped(limits.where("upper > lower").select(*keys, "cell", "lower", "upper"), keys)
        pieces = self.ranged.groupBy(*by).agg(F.max("s").alias("_last"))
        order = Window.partitionBy(*keys).orderBy("_part")
        pieces = pieces.withColumn("before", F.lag("_last").over(order)).drop("_last").join(cells, keys)
        later = F.col("before").isNotNull()
        bound = lambda c: F.when(later, F.transform("cell", lambda _: F.lit(float(c))))
        pieces = stored(pieces.withColumns({"low": bound(least), "high": bound(most)}), "pieces")
        # two levels that agree to a billionth of a mA are one
        apart = later & F.exists(F.zip_with("low", "high", lambda a, b: b - a), lambda d: d > 1e-9)
        while True:
            ends = _ramp_pass(self.ranged, pieces, keys, self.ramp, "ends")
            took = ends.select(*by, F.lag("low_end").over(order).alias("_low"), F.lag("high_end").over(order).alias("_high"))
            pieces = stored(pieces.join(took, by).withColumns({c: F.when(later, F.col(f"_{c}")) for c in ("low", "high")}).drop("_low", "_high"), "pieces")
            if pieces.where(apart).isEmpty():
                break
        self.pieces = pieces

    def levels(self) -> DataFrame:
        """(_part, keys, t, row_ord, s, cell, current): the current delivered after each sample."""
        return _ramp_pass(self.ranged, self.pieces, self.keys, self.ramp, "levels")

    def sums(self) -> DataFrame:
        """A row for each piece and cell: samples by state, changes of state, the current and its square summed."""
        return _ramp_pass(self.ranged, self.pieces, self.keys, self.ramp, "sums")


def _state(least: float, most: float):
    c = F.col("current")
    return F.when(c >= most - 1e-9, "high").when(c <= least + 1e-9, "low").otherwise("middle")


def simulate_ramp(series: DataFrame, limits: DataFrame, keys: list[str] | None = None, least: float = 1.0, most: float = 3.0, **more) -> DataFrame:
    """(keys, cell, lower, upper, n, pct_low, pct_mid, pct_high, transitions, transitions_per_hour, median_low_min,
    median_high_min, duty_cycle, mean_current, energy) of the delivered current for each cell of `limits`.

    An episode lasts from its first sample to the next episode's; energy is the mean square over that of the greatest current.
    """
    keys = keys or KEYS
    rows = stored(RampRun(series, limits, keys, least, most, **more).levels().withColumn("state", _state(least, most)), "levels")
    each = [*keys, "cell"]
    rows = stored(runs(rows, each, ["t", "row_ord"], F.col("state")), "runs")
    count = lambda s: F.count_if(F.col("state") == s)
    out = rows.groupBy(*each).agg(
        F.count("*").alias("n"), count("low").alias("_low"), count("middle").alias("_mid"), count("high").alias("_high"), (F.max("run") - 1).alias("transitions"),
        (F.max("s") - F.min("s")).alias("_span"), F.avg("current").alias("mean_current"), (F.avg(F.col("current") ** 2) / (most * most)).alias("energy"),
    )
    # episodes in the order of their ends, as pieces of ranges of their own
    spans = by_ranges(rows.groupBy(*each, "run").agg(F.min("s").alias("from_s"), F.max("s").alias("to_s"), F.first("state").alias("state")), each, ["run"])
    nexts = previous(spans.withColumn("_back", -F.col("run")).withColumn("_part", -F.col("_part")), each, ["_back"], F.col("from_s"), "_next")
    minutes = (F.coalesce("_next", "to_s") - F.col("from_s")) / 60
    middle = lambda s: F.expr("percentile(m, 0.5)").alias(f"median_{s}_min")
    times = nexts.withColumn("m", minutes).where("m > 0")
    for s in ("low", "high"):
        out = out.join(times.where(F.col("state") == s).groupBy(*each).agg(middle(s)), each, "left")
    share = lambda c: 100 * ratio(F.col(c), F.col("n"))
    hours = F.col("_span") / 3600
    return out.join(limits.select(*each, "lower", "upper"), each).select(
        *each, "lower", "upper", "n", share("_low").alias("pct_low"), share("_mid").alias("pct_mid"), share("_high").alias("pct_high"), "transitions",
        ratio(F.col("transitions"), hours).alias("transitions_per_hour"), "median_low_min", "median_high_min",
        ratio(F.col("_high") + 0.5 * F.col("_mid"), F.col("n")).alias("duty_cycle"), "mean_current", "energy",
    )


def limit_grid(series: DataFrame, keys: list[str] | None = None, n: int = 12) -> DataFrame:
    """(keys, cell, lower, upper): all ordered pairs of n limits evenly between a series' 5th and 95th percentiles."""
    keys = keys or KEYS
    ends = series.where("lfp is not null").groupBy(*keys).agg(F.expr("percentile(lfp, array(0.05, 0.95))").alias("p"))
    steps = lambda: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    at = lambda i: F.get("p", 0) + (F.get("p", 1) - F.get("p", 0)) * F.col(i) / (n - 1)
    grid = ends.withColumn("i", steps()).withColumn("j", steps())
    return grid.select(*keys, (F.col("i") * n + F.col("j")).cast("int").alias("cell"), at("i").alias("lower"), at("j").alias("upper")).where("upper > lower")


def limit_sweep(series: DataFrame, limits: DataFrame, keys: list[str] | None = None, least: float = 1.0, most: float = 3.0, **more) -> DataFrame:
    """(keys, cell, lower, upper, n, pct_high, transitions_per_hour, duty_cycle, energy) for each cell of a grid of limits, summed
    inside the pieces of the series: no row for a sample and a cell is made."""
    keys = keys or KEYS
    each = [*keys, "cell"]
    x = RampRun(series, limits, keys, least, most, **more).sums()
    border = F.lag("last").over(Window.partitionBy(*each).orderBy("_part")) != F.col("first")
    x = x.withColumn("changes", F.col("changes") + F.coalesce(border.cast("int"), F.lit(0)))
    x = x.groupBy(*each).agg(*[F.sum(c).alias(c) for c in ("n", "n_low", "n_high", "changes", "square")], (F.max("to_s") - F.min("from_s")).alias("span"))
    n = F.col("n")
    return x.join(limits.select(*each, "lower", "upper"), each).select(
        *each, "lower", "upper", "n", (100 * ratio(F.col("n_high"), n)).alias("pct_high"), ratio(F.col("changes"), F.col("span") / 3600).alias("transitions_per_hour"),
        ratio(F.col("n_high") + 0.5 * (n - F.col("n_high") - F.col("n_low")), n).alias("duty_cycle"), (F.col("square") / n / (most * most)).alias("energy"),
    )
