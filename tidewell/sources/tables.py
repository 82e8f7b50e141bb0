"""Delimited side signals and state diaries, with bad rows counted and kept apart."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Names of a diary's columns and words for its states.
DIARY_NAMES = {
    "patient_id": ("patient_id", "patient", "paciente", "subject", "subject_id", "id"), "condition": ("condition", "condicao", "grupo", "group"), "day": ("day", "dia", "date", "data"),
    "hour": ("hour_decimal", "hora_decimal", "hour", "hora"), "time": ("time",), "bin": ("bin_index",), "state": ("state", "estado", "status"),
}
DIARY_STATES = {"asleep": "Asleep", "off": "Off", "onnodysk": "On_NoDysk", "onnontroublesomedysk": "On_NonTroublesomeDysk", "ontroublesomedysk": "On_TroublesomeDysk"}


def normal_state(c: Column) -> Column:
    """A diary state whatever its case, spaces and underscores; null if unknown."""
    known = F.create_map(*[F.lit(x) for kv in DIARY_STATES.items() for x in kv])
    return F.try_element_at(known, F.regexp_replace(F.lower(c), r"[\s_-]+", ""))


def read_diary(spark: SparkSession, path: str, sep: str = ",") -> DataFrame:
    """(patient_id, condition, day, hour, state, row_ord, problem): a row with an unknown state, or no hour or day, keeps its problem."""
    raw = spark.read.csv(path, header=True, sep=sep, mode="PERMISSIVE").withColumn("row_ord", F.monotonically_increasing_id())
    have = {c.strip().lower(): c for c in raw.columns}
    col = lambda k: next((F.col(f"`{have[n]}`") for n in DIARY_NAMES[k] if n in have), F.lit(None).cast("string"))
    clock = F.regexp_extract(F.coalesce(col("time"), F.lit("")), r"^(\d{1,2}):(\d{2})", 1).try_cast("int") + F.regexp_extract(F.coalesce(col("time"), F.lit("")), r"^(\d{1,2}):(\d{2})", 2).try_cast("int") / 60
    hour = F.coalesce(col("hour").try_cast("double"), clock.cast("double"), col("bin").try_cast("double") / 2)
    x = raw.select(col("patient_id").alias("patient_id"), col("condition").alias("condition"), F.to_date(F.try_to_timestamp(col("day"))).alias("day"), hour.alias("hour"), normal_state(col("state")).alias("state"), "row_ord")
    problem = F.when(F.col("state").isNull(), "unknown_state").when(F.col("hour").isNull() | ~F.col("hour").between(0, 24), "no_hour").when(F.col("day").isNull(), "no_day")
    return x.withColumn("problem", problem)


def diary_grid(rows: DataFrame, bin_hours: float = 0.5) -> DataFrame:
    """(patient_id, condition, day, bin, state, n_conflicts): the first state of a bin, and how many others disagree."""
    x = rows.where("problem is null").withColumn("bin", F.floor(F.col("hour") / bin_hours).cast("int"))
    keys = ["patient_id", "condition", "day", "bin"]
    g = x.groupBy(*keys).agg(F.min_by("state", "row_ord").alias("state"), F.collect_list("state").alias("all"))
    return g.select(*keys, "state", F.size(F.filter("all", lambda s: s != F.col("state"))).alias("n_conflicts"))


def day_composition(grid: DataFrame, bin_hours: float = 0.5, least_cover: float = 0.8) -> DataFrame:
    """Hours of each state a day, and whether the day is covered enough."""
    out = grid.groupBy("patient_id", "condition", "day").pivot("state", list(DIARY_STATES.values())).agg(F.count(F.lit(1)) * bin_hours)
    out = out.na.fill(0.0, list(DIARY_STATES.values()))
    covered = sum((F.col(c) for c in DIARY_STATES.values()), F.lit(0.0))
    return out.withColumn("complete", covered / 24 >= least_cover)


def read_signal(spark: SparkSession, path: str, time: str, sep: str = ",") -> DataFrame:
    """(t, row_ord, malformed, <channels>): a delimited signal with a time column in ISO form or seconds or milliseconds since the epoch."""
    raw = spark.read.csv(path, header=True, sep=sep, mode="PERMISSIVE").withColumn("row_ord", F.monotonically_increasing_id())
    number = F.col(f"`{time}`").try_cast("double")
    t = F.when(number.isNull(), F.try_to_timestamp(F.col(f"`{time}`"))).when(number > 1e11, F.timestamp_micros((number * 1000).cast("long"))).otherwise(F.timestamp_micros((number * 1e6).cast("long")))
    channels = [c for c in raw.columns if c not in (time, "row_ord")]
    x = raw.select(t.alias("t"), "row_ord", *[F.col(f"`{c}`").try_cast("double").alias(c) for c in channels])
    return x.withColumn("malformed", F.col("t").isNull() | F.coalesce(*[F.col(f"`{c}`") for c in channels]).isNull())
