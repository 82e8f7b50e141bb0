"""What the device did: documented and inferred stimulation state, names of leads, channels and contacts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The documented stimulation state of a modality, specific names first.
STATES = (
    ("(?i)IndefiniteStreaming|record\\s*streaming", "OFF"), ("(?i)MostRecentInSessionSignalCheck", "OFF"), ("(?i)SenseChannelTests", "OFF"), ("(?i)CalibrationTests", "ON"),
    ("(?i)LFPMontage|LfpMontageTimeDomain|survey", "OFF"), ("(?i)BrainSenseTimeDomain|BrainSenseLfp", "USER"), ("(?i)trend|timeline|snapshot|event", "ANY"),
)
#: Lead models that are known, and digits of contact names.
LEADS = ("B33005", "B33015", "3389", "3387", "3391")
DIGITS = {"ZERO": "0", "ONE": "1", "TWO": "2", "THREE": "3"}
#: Amplitude in mA above which stimulation counts as therapeutic.
LEAST_MA = 0.05


def documented_state(modality: Column) -> Column:
    """OFF, ON, USER or ANY by the maker's table; null for an unknown modality."""
    out = F.lit(None).cast("string")
    for pattern, state in reversed(STATES):
        out = F.when(modality.rlike(pattern), state).otherwise(out)
    return out


def last_status(records: DataFrame, status: DataFrame, by: list[str]) -> DataFrame:
    """records (t, row_ord) with `status`: ON or OFF by the last of the table (t, row_ord, detail) at or before it."""
    w = Window.partitionBy(*by).orderBy("_t", "_kind", "_o").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    told = F.when(F.col("detail").rlike("(?i)ON"), "ON").when(F.col("detail").rlike("(?i)OFF"), "OFF").otherwise("-")
    left = records.withColumns({"_t": F.unix_micros("t"), "_kind": F.lit(1), "_o": F.col("row_ord"), "_s": F.lit(None).cast("string")})
    right = status.select(*by, F.unix_micros("t").alias("_t"), F.lit(0).alias("_kind"), F.col("row_ord").alias("_o"), told.alias("_s"))
    both = left.unionByName(right, allowMissingColumns=True).withColumn("status", F.nullif(F.last("_s", True).over(w), F.lit("-")))
    return both.where("_kind = 1").drop("_t", "_kind", "_o", "_s")


def device_state(records: DataFrame) -> DataFrame:
    """records (max_ma, group_ma, status, modality) with `ma`, `state` and `evidence`.

    The amplitude recorded in the series comes first, then that of the active group; the state goes by the recorded
    amplitude, the last status before, and the documented state, in this order; an amplitude over LEAST_MA is never OFF.
    """
    ma = F.coalesce("max_ma", "group_ma")
    on = F.when(ma > LEAST_MA, "ON_THERAPEUTIC").otherwise("ON_0mA")
    known = documented_state(F.col("modality"))
    by_series = F.when(F.col("max_ma").isNotNull(), on)
    by_status = F.when(F.col("status") == "OFF", "OFF").when(F.col("status") == "ON", on)
    by_table = F.when(known == "OFF", "OFF").when(known.isin("ON", "USER"), on)
    state = F.coalesce(by_series, by_status, by_table, F.lit("UNKNOWN"))
    state = F.when((state == "OFF") & (ma > LEAST_MA), "ON_THERAPEUTIC").otherwise(state)
    seen = [F.when(F.col("max_ma").isNotNull(), "series"), F.when(F.col("max_ma").isNull() & F.col("group_ma").isNotNull(), "group"), F.when(F.col("status").isNotNull(), "status")]
    seen.append(F.when(by_series.isNull() & by_status.isNull() & by_table.isNotNull(), "documented"))
    return records.withColumns({"ma": ma, "state": state, "evidence": F.array_join(F.array_compact(F.array(*seen)), ",")})


def states_comparable(a: Column, b: Column) -> Column:
    """Whether spectra of two states may be compared: equal ones that are known."""
    return F.coalesce((a == b) & (a != "UNKNOWN"), F.lit(False))


def short_threshold(model: Column) -> Column:
    """Ohms below which a contact counts as shorted."""
    return F.when(model.rlike("(?i)B330[0-9][0-9]|sensight"), 350).otherwise(250)


def lead_model(model: Column) -> Column:
    """The known model that a declared lead model names; null if none, never a guess."""
    plain = F.regexp_replace(F.upper(model), "[^A-Z0-9]", "")
    out = F.lit(None).cast("string")
    for name in reversed(LEADS):
        out = F.when(F.contains(plain, F.lit(name)), name).otherwise(out)
    return out


#: The sides and the kinds of electrodes that end a channel's name, and the family that begins an electrode's.
SIDES, SHAPES, FAMILY = ("LEFT", "RIGHT"), ("RING", "SEGMENT"), "sensight"


def _lookup(words: dict[str, str], c: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in words.items() for x in kv]), c)


def _parts(name: Column) -> Column:
    """The parts of a channel's name between underscores, without the side and the shape at its end."""
    parts = F.split(name, "_")
    last, before = F.element_at(parts, -1), F.try_element_at(parts, F.lit(-2))
    ends = F.when(F.upper(last).isin(*SHAPES) & F.upper(before).isin(*SIDES), 2).when(F.upper(last).isin(*SIDES), 1).otherwise(0)
    return F.slice(parts, F.lit(1), F.size(parts) - ends)


def _after_level(parts: Column, i: Column) -> Column:
    """Whether a part is a segment's letter behind a level's word."""
    return F.get(parts, i).isin("A", "B", "C") & F.coalesce(_lookup(DIGITS, F.get(parts, i - 1)).isNotNull(), F.lit(False))


def electrode_name(name: Column) -> Column:
    """The last part of an electrode's name, without the family that it begins with."""
    own = F.element_at(F.split(name, "\\."), -1)
    return F.when(F.lower(own).startswith(FAMILY), F.ltrim(F.substr(own, F.lit(len(FAMILY) + 1)), F.lit("_"))).otherwise(own)


def channel_label(channel: Column) -> Column:
    """ZERO_AND_TWO_LEFT as 0-2: levels as digits, segments in lower case behind them, AND as a dash, other parts as they are. What stands before
    the last point stays."""
    names = F.split(channel, "\\.")
    head, parts = F.slice(names, F.lit(1), F.size(names) - 1), _parts(F.element_at(names, -1))
    said = F.transform(parts, lambda p, i: F.coalesce(_lookup({**DIGITS, "AND": "-"}, p), F.when(_after_level(parts, i), F.lower(p)), p))
    return F.array_join(F.concat(head, F.array(F.array_join(said, ""))), ".")


def channel_contacts(channel: Column) -> Column:
    """The contacts that a channel's name refers to, each once, in their order: a level's word with the segment's letter behind it, or in a label such
    as 0-2 a digit with its letter; empty for an unknown form."""
    parts = _parts(F.element_at(F.split(F.upper(channel), "\\."), -1))
    level = lambda p, i: F.concat(_lookup(DIGITS, p), F.when(F.coalesce(_after_level(parts, i + 1), F.lit(False)), F.lower(F.get(parts, i + 1))).otherwise(""))
    long = F.array_compact(F.transform(parts, level))
    brief = F.filter(F.split(F.lower(channel), "[^0-9a-z]+"), lambda p: p.rlike("^[0-3][abc]?$"))
    return F.array_distinct(F.when(F.size(long) > 0, long).otherwise(brief))


def collect_thresholds(settings: DataFrame, snapshots: DataFrame, by: list[str]) -> DataFrame:
    """(by, lower, upper): of the last setting with a lower threshold, else of the first snapshot with one; tables (t, row_ord,
    lower, upper)."""
    both = F.struct("lower", "upper")
    late = settings.where("lower is not null").groupBy(*by).agg(F.max_by(both, F.struct("t", "row_ord")).alias("a"))
    early = snapshots.where("lower is not null").groupBy(*by).agg(F.min_by(both, F.struct("t", "row_ord")).alias("b"))
    return late.join(early, by, "full").select(*by, F.coalesce("a.lower", "b.lower").alias("lower"), F.coalesce("a.upper", "b.upper").alias("upper"))


def usage(sessions: DataFrame, by: list[str]) -> DataFrame:
    """(by, n, battery_per_month, hours_per_day) from the first and last session (t, row_ord, battery, hours): the battery's
    fall per month of 30.44 days if they are over half a month apart, the therapy per day if over a day."""
    day = F.unix_micros("t") / 86_400e6
    ends = lambda c: (F.min_by(F.struct(day.alias("d"), F.col(c).alias("v")), F.struct("t", "row_ord")), F.max_by(F.struct(day.alias("d"), F.col(c).alias("v")), F.struct("t", "row_ord")))
    (b0, b1), (h0, h1) = ends("battery"), ends("hours")
    m = sessions.groupBy(*by).agg(F.count("*").alias("n"), b0.alias("b0"), b1.alias("b1"), h0.alias("h0"), h1.alias("h1"))
    months, days = (F.col("b1.d") - F.col("b0.d")) / 30.44, F.col("h1.d") - F.col("h0.d")
    return m.select(*by, "n", F.when(months > 0.5, (F.col("b0.v") - F.col("b1.v")) / months).alias("battery_per_month"), F.when(days > 1, (F.col("h1.v") - F.col("h0.v")) / days).alias("hours_per_day"))
