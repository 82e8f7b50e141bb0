"""Checks of recordings from one table of rules: what was found, what was checked, and what could not be.

A rule names the columns it needs, its measure and the bounds at which that warns or forbids to read on. All rules are compiled into
one projection: a recording with a missing column isn't passed, it is `not_checked`, with what is missing.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewell.functions.columns import local_day
from tidewell.functions.distributions import f_p_value

from .chronic import clean
from .rhythm import cosinor, cosinor_test


@dataclass(frozen=True)
class Rule:
    """measure, warning and critical are SQL expressions over the columns of a recording; `when` is a condition without which the check cannot be
    made, `why` says what it takes. critical goes before warning."""

    check: str
    needs: tuple[str, ...]
    measure: str
    warning: str = "false"
    critical: str = "false"
    when: str = "true"
    why: str = ""

    def compiled(self) -> Column:
        missing = F.array_compact(F.array(*[F.when(F.col(c).isNull(), F.lit(c)) for c in self.needs]))
        able = (F.size(missing) == 0) & F.coalesce(F.expr(self.when), F.lit(False))
        level = F.when(F.expr(self.critical), "critical").when(F.expr(self.warning), "warning").otherwise("passed")
        reason = F.when(F.size(missing) > 0, F.concat(F.lit("missing: "), F.array_join(missing, ", "))).when(~able, F.lit(self.why))
        return F.struct(
            F.lit(self.check).alias("check"), F.when(able, level).otherwise("not_checked").alias("status"), F.when(able, F.expr(self.measure).cast("double")).alias("measure"), reason.alias("reason")
        )


#: Bounds of lost samples, censored samples (percent), samples at the extremes (share), deviation (microvolts), drift (ms), high pass (Hz).
ALARMS = (
    Rule("clipping", ("n_valid", "n_extreme"), "n_extreme / n_valid", critical="n_extreme / n_valid >= 0.005", when="n_valid >= 100", why="under 100 samples"),
    Rule("amplitude", ("n_valid", "sd"), "sd", warning="sd < 0.2 or sd > 60", when="n_valid >= 100", why="under 100 samples"),
    Rule("packet_loss", ("pct_lost",), "pct_lost", "pct_lost >= 5", "pct_lost >= 20", "loss_known", "no sequence numbers or ticks"),
    Rule("clock_drift", ("drift_ms",), "drift_ms", "abs(drift_ms) > 20"),
    Rule("high_pass", ("high_pass_hz",), "high_pass_hz", critical="high_pass_hz >= 10"),
    Rule("device_censoring", ("pct_censored",), "pct_censored", "pct_censored >= 3", "pct_censored >= 20"),
)

#: Lights of a quality panel: green, yellow and red for passed, warning and critical, grey for what can't be verified.
PANEL = (
    Rule("packets", ("pct_lost",), "pct_lost", "pct_lost > 0", "pct_lost > 20", "loss_known", "no sequence numbers or ticks"),
    Rule("rate", ("drift_ms",), "drift_ms", "abs(drift_ms) > 20"),
    Rule("device_state", ("state_confidence",), "state_confidence", "state_confidence < 2", "state_confidence < 1"),
    Rule("reproducibility", ("n_channels", "n_unstable"), "n_unstable", "n_unstable > 0", "n_unstable = n_channels", "n_channels > 0", "one record a channel"),
)


def findings(recordings: DataFrame, keys: list[str], rules: tuple[Rule, ...] = ALARMS) -> DataFrame:
    """(keys, check, status, measure, reason): every rule for every recording, with status critical, warning, passed or not_checked. A column that
    a rule needs and the table lacks counts as missing in every recording."""
    absent = {c: F.lit(None).cast("double") for r in rules for c in r.needs if c not in recordings.columns}
    flags = {c: F.lit(None).cast("boolean") for c in ("loss_known",) if c not in recordings.columns}
    x = recordings.withColumns(absent | flags) if absent or flags else recordings
    return x.select(*keys, F.inline(F.array(*[r.compiled() for r in rules])))


def verdicts(found: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, level, n_critical, n_warning, n_passed, n_not_checked, worst, pct_verified) of findings(): a recording is clean only as far as it was
    checked. `worst` is the first check, by severity and name, that isn't passed."""
    count = lambda s: F.count_if(F.col("status") == s)
    rank = F.when(F.col("status") == "critical", 0).when(F.col("status") == "warning", 1)
    out = found.groupBy(*keys).agg(
        count("critical").alias("n_critical"), count("warning").alias("n_warning"), count("passed").alias("n_passed"), count("not_checked").alias("n_not_checked"),
        F.min(F.when(rank.isNotNull(), F.struct(rank.alias("rank"), "check"))).alias("w"),
    )
    level = F.when(F.col("n_critical") > 0, "critical").when(F.col("n_warning") > 0, "warning").otherwise("clean")
    total = F.col("n_critical") + F.col("n_warning") + F.col("n_passed") + F.col("n_not_checked")
    return out.select(
        *keys, level.alias("level"), "n_critical", "n_warning", "n_passed", "n_not_checked", F.col("w.check").alias("worst"), (100 * (total - F.col("n_not_checked")) / total).alias("pct_verified")
    )


def measured(samples: DataFrame, keys: list[str], value: str = "x") -> DataFrame:
    """(keys, n, n_valid, n_extreme, sd): the measures of recordings in long form: samples at the greatest or least value, the deviation of those
    that are there. Two passes of sums, no recording in one row."""
    ends = samples.groupBy(*keys).agg(F.max(value).alias("_max"), F.min(value).alias("_min"))
    extreme = (F.col(value) == F.col("_max")) | (F.col(value) == F.col("_min"))
    return samples.join(ends, keys).groupBy(*keys).agg(F.count("*").alias("n"), F.count(value).alias("n_valid"), F.count_if(extreme).alias("n_extreme"), F.stddev_samp(value).alias("sd"))


#: Fixed value: how far the peaks of a channel's records may lie apart, in Hz.
PEAK_TOLERANCE = 1.0


def peak_reproducibility(peaks: DataFrame, keys: list[str], tolerance: float = PEAK_TOLERANCE) -> DataFrame:
    """(keys, n, median_f, max_deviation, magnitude_cv, flags_agree, verdict) of the peaks (keys, f, magnitude, flag) of each channel's records: stable
    where all lie within the tolerance, unstable beyond, not_enough for a single one. Records without a peak don't count; of flags two are needed to
    agree or not."""
    x = peaks.where(F.col("f").isNotNull())
    m = F.col("magnitude")
    out = x.groupBy(*keys).agg(
        F.count("*").alias("n"), F.expr("percentile(f, 0.5)").alias("median_f"), (F.max("f") - F.min("f")).alias("max_deviation"),
        F.when((F.count(m) > 1) & (F.avg(m) > 0), F.stddev_samp(m) / F.avg(m)).alias("magnitude_cv"),
        F.when(F.count("flag") > 1, F.min("flag") == F.max("flag")).alias("flags_agree"),
    )
    verdict = F.when(F.col("n") < 2, "not_enough").when(F.col("max_deviation") <= tolerance, "stable").otherwise("unstable")
    return out.withColumn("verdict", verdict)


def panel_inputs(recordings: DataFrame, reproducibility: DataFrame, keys: list[str]) -> DataFrame:
    """recordings with n_channels and n_unstable of their keys' channels that have enough records."""
    n = reproducibility.where("verdict <> 'not_enough'").groupBy(*keys).agg(F.count("*").alias("n_channels"), F.count_if(F.col("verdict") == "unstable").alias("n_unstable"))
    return recordings.join(n, keys, "left")


def summary(found: DataFrame) -> DataFrame:
    """(check, n_critical, n_warning, n_passed, n_not_checked) over all recordings, most severe first by `place`."""
    count = lambda s: F.count_if(F.col("status") == s).alias(f"n_{s}")
    out = found.groupBy("check").agg(*[count(s) for s in ("critical", "warning", "passed", "not_checked")])
    # a row a rule: few, however many recordings there are
    return out.withColumn("place", F.row_number().over(Window.orderBy(F.desc("n_critical"), F.desc("n_warning"), "check")))


#: Fixed values of eligibility: lost samples (percent), rate (Hz), pulse width (microseconds), days of the chronic series, samples, p and share of the mean of its rhythm.
ELIGIBILITY = (
    Rule("peak", ("has_peak",), "int(has_peak)", critical="not has_peak"),
    Rule("artifact", ("has_signal", "pct_lost"), "pct_lost", critical="loss_known and pct_lost > 10", when="has_signal", why="no raw signal"),
    Rule("reproducibility", ("n_channels", "n_unstable"), "n_unstable", "n_unstable > 0", "n_unstable = n_channels", "n_channels > 0", "one record a channel"),
    Rule("parameters", ("state",), "rate_hz", "rate_hz > 0 and rate_hz < 100 or pulse_us > 90", when="state <> 'UNKNOWN'", why="device state unknown"),
    Rule("chronic_days", ("n_days",), "n_days", "n_days < 5", "n_days < 3"),
    Rule("rhythm", ("n_points",), "p_adjusted", "not coalesce(p_adjusted < 0.05 and rhythm_share > 0.05, false)", when="n_points >= 24", why="under 24 samples"),
)


def eligibility(found: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, verdict, blockers, missing, reserves) of findings() by ELIGIBILITY: not_eligible where a criterion isn't met, else insufficient where one couldn't be
    judged, else with_reserve or eligible; the criteria of each kind by name."""
    named = lambda s, name: F.array_join(F.array_sort(F.collect_list(F.when(F.col("status") == s, F.col("check")))), ",").alias(name)
    # a row a rule and recording: few for each
    out = found.groupBy(*keys).agg(named("critical", "blockers"), named("not_checked", "missing"), named("warning", "reserves"))
    verdict = F.when(F.col("blockers") != "", "not_eligible").when(F.col("missing") != "", "insufficient").when(F.col("reserves") != "", "with_reserve").otherwise("eligible")
    return out.select(*keys, verdict.alias("verdict"), "blockers", "missing", "reserves")


def chronic_evidence(series: DataFrame, keys: list[str], offset: int = 0) -> DataFrame:
    """(keys, n_days, n_points, rhythm_share, p_adjusted) of each series: its civil days and samples, and of the samples within four deviations of the median the
    amplitude of 24 hours as a share of the mean level and its p by the samples that autocorrelation leaves."""
    counts = series.groupBy(*keys).agg(F.count_distinct(local_day(F.col("t"), offset)).alias("n_days"), F.count("*").alias("n_points"))
    kept = clean(series, keys)
    wave = cosinor(kept, keys, 24.0, offset).select(*keys, (F.col("amplitude") / F.nullif("mesor", F.lit(0.0))).alias("rhythm_share"))
    test = cosinor_test(kept, keys, 24.0, offset).select(*keys, f_p_value(F.col("f_adjusted"), F.lit(2), F.col("df2_adjusted")).alias("p_adjusted"))
    return counts.join(wave, keys, "left").join(test, keys, "left")
