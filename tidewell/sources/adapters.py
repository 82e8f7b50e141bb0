"""The test tables as the library's typed tables: series, events, spectra, sessions and impedances."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Samples that a series of the test tables has at most on average, and the least number of subjects.
SAMPLES, SUBJECTS = 32_768, 8


def event_keys(events: DataFrame) -> DataFrame:
    """Add subject and hemisphere: users are dealt to subjects, of whom there are more the more events there are, so that a series is
    as long as a device's memory allows and no longer. The count is read from the files' footers."""
    subjects = max(SUBJECTS, -(-events.count() // (2 * SAMPLES)))
    return events.withColumns({
        "subject": F.floor(F.col("user_id") / 2).cast("long") % subjects,
        "hemisphere": F.when(F.col("user_id") % 2 == 0, "Left").otherwise("Right"),
    })


#: The same as DuckDB SQL, by the name of keyed.
EVENT_KEYS_SQL = f"""keyed as (select *, floor(user_id/2)::bigint % (select greatest({SUBJECTS}, ceil(count(*)/{2 * SAMPLES}))::bigint from events) as subject,
 case when user_id%2=0 then 'Left' else 'Right' end as hemisphere from events)"""


def raw_timeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(subject, hemisphere, t, lfp_raw, row_ord): a negative value is one that the device censored."""
    return event_keys(read(spark, sf_dir, "events")).select(
        "subject", "hemisphere", F.col("ts").cast("timestamp").alias("t"),
        F.when(F.col("event_type") == "error", -F.col("value")).otherwise(F.col("value")).alias("lfp_raw"),
        F.col("event_id").alias("row_ord"),
    )


#: The same table as DuckDB SQL.
RAW_TIMELINE_SQL = EVENT_KEYS_SQL + """,
raw as (select subject, hemisphere, ts as t, case when event_type='error' then -value else value end as lfp_raw, event_id as row_ord from keyed)"""


def timeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """raw_timeline with `lfp` null where censored."""
    from tidewell.operators.chronic import censor

    return censor(raw_timeline(spark, sf_dir))


TIMELINE_SQL = RAW_TIMELINE_SQL + """,
tl as (select subject, hemisphere, t, row_ord, case when lfp_raw < 0 then null else lfp_raw end as lfp, lfp_raw < 0 as censored from raw)"""


def marks(spark: SparkSession, sf_dir: str, kind: str) -> DataFrame:
    """(subject, hemisphere, t, row_ord) of the events of one type."""
    e = event_keys(read(spark, sf_dir, "events")).where(F.col("event_type") == kind)
    return e.select("subject", "hemisphere", F.col("ts").cast("timestamp").alias("t"), F.col("event_id").alias("row_ord"))


def marks_sql(name: str, kind: str) -> str:
    """The same as DuckDB SQL, after TIMELINE_SQL."""
    return f"{name} as (select subject, hemisphere, ts as t, event_id as row_ord from keyed where event_type='{kind}')"


def signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(rec, x, fs): each embedding as a record of 64 samples at 64 Hz."""
    return read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("rec"), F.col("embedding").cast("array<double>").alias("x"), F.lit(64.0).alias("fs"))


def sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(subject, t, channel, centre, row_ord): each order as a sensing configuration of a session."""
    o = read(spark, sf_dir, "orders")
    return o.select(
        F.col("o_custkey").alias("subject"), F.col("o_orderdate").cast("timestamp").alias("t"), F.col("o_orderpriority").alias("channel"),
        F.col("o_totalprice").alias("centre"), F.col("o_orderkey").alias("row_ord"),
    )


def impedances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(contact, t, ohm, row_ord): each line item as a measurement of a contact."""
    x = read(spark, sf_dir, "lineitem")
    order = F.col("l_orderkey") * 10 + F.col("l_linenumber")
    return x.select(F.col("l_partkey").alias("contact"), F.col("l_shipdate").cast("timestamp").alias("t"), F.col("l_quantity").alias("ohm"), order.alias("row_ord"))
