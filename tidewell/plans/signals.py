"""Queries of side signals: the test tables' events, written to the shared folder as files of five dialects, and read back."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.sources.adapters import TIMELINE_SQL, timeline
from tidewell.sources.dialects import Signals
from tidewell.sources.shared import shared_folder, stored

from .chronic import rounded


def folder(spark: SparkSession, d: str) -> str:
    """A folder with one file a subject: its first sample of each millisecond, in the dialect of subject % 5."""
    ms = F.floor(F.unix_micros("t") / 1000).cast("long")
    x = timeline(spark, d).withColumn("ms", ms).groupBy("subject", "ms").agg(F.min_by(F.struct("lfp", "row_ord"), "row_ord").alias("r"))
    x = x.join(x.groupBy("subject").agg(F.min("ms").alias("ms0")), "subject").select("subject", "ms", (F.col("ms") - F.col("ms0")).alias("after"), F.col("r.lfp").cast("string").alias("v"), F.col("r.row_ord").alias("row_ord"))
    # read from files, its partitioning is unknown: the deal by subject below stays a shuffle of its own, whose partitions aren't split
    x = stored(x, "side")
    time = F.date_format(F.timestamp_millis("ms"), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
    seconds = F.concat(F.expr("string(ms div 1000)"), F.lit(","), F.lpad(F.expr("string(ms % 1000)"), 3, "0"))
    dialects = [
        (",", True, [time.alias("timestamp"), F.col("v").alias("acc_x [g]"), F.concat(F.lit("note "), F.col("row_ord").cast("string")).alias("remark")]),
        (";", True, [seconds.alias("tempo"), F.col("v").alias("EMG (uV)")]),
        ("\t", False, [F.col("ms").alias("a"), F.col("v").alias("b")]),
        ("|", True, [F.col("after").alias("ms"), F.col("v").alias("ecg"), F.when(F.col("row_ord") % 3 == 0, "x").otherwise("1").alias("flag")]),
        (",", True, [(F.col("after") / 1e9).alias("t"), F.col("v").alias("x")]),
    ]
    path = f"{shared_folder(spark)}/signals-{uuid.uuid4().hex}"
    for k, (sep, header, columns) in enumerate(dialects):
        own = x.where(F.col("subject") % 5 == k).repartition("subject").sortWithinPartitions("subject", "ms")
        own.select("subject", *columns).write.partitionBy("subject").csv(f"{path}/dialect{k}", sep=sep, header=header, emptyValue="")
    return path


def subject() -> Column:
    return F.regexp_extract("file", r"subject=(\d+)/", 1).cast("long").alias("subject")


def signal_files(spark: SparkSession, d: str) -> DataFrame:
    return rounded(Signals(spark, folder(spark, d)).files().select(subject(), "*").drop("file"))


def signal_samples(spark: SparkSession, d: str) -> DataFrame:
    x = Signals(spark, folder(spark, d)).samples().select(subject(), "channel", "unit", "kind", "t_ms", "x")
    return rounded(x.groupBy("subject", "channel", "unit", "kind").agg(F.count("*").alias("n"), F.count("x").alias("n_valid"), F.avg("x").alias("mean_x"), F.max("t_ms").alias("last_ms"), F.max_by("x", "t_ms").alias("last_x")))


FOLDER_SQL = f"""{TIMELINE_SQL}, f0 as (select subject, (epoch_us(t)//1000)::bigint ms, arg_min(coalesce(lfp, -1), row_ord) v, min(row_ord) row_ord from tl group by all),
f1 as (select subject, ms, nullif(v, -1) v, row_ord, ms - min(ms) over (partition by subject) after, subject % 5 k from f0),
f2 as (select *, case when k in (0, 1, 2) then ms when k = 3 then after else after/1000000.0::double end tm from f1)"""

ORACLE = {
    "signal_files": f"""with {FOLDER_SQL}, f3 as (select *, tm - lag(tm) over (partition by subject order by ms) dt from f2),
q as (select subject, k, count(*) n, quantile_cont(dt, 0.25) filter (dt > 0) a, quantile_cont(dt, 0.5) filter (dt > 0) m, quantile_cont(dt, 0.75) filter (dt > 0) b, (max(tm)-min(tm))/1000 dur from f3 group by all),
g as (select subject, count(*) filter (dt > 3*m) n_gaps from f3 join q using (subject) group by all)
select subject, [',', ';', chr(9), '|', ','][k+1] delimiter, case when k = 2 then -1 else 0 end as header, ['timestamp', 'tempo', 'col1', 'ms', 't'][k+1] time_column, ['iso', 'epoch_s', 'epoch_ms', 'relative_ms', 'relative_s'][k+1] time_kind, k < 3 absolute,
n, 0 n_dropped, case when k = 3 then 2 else 1 end n_channels, round(1000/m,6) rate, round(m,6) step_ms, round(100*(b-a)/m,6) jitter_pct, n_gaps, round(dur,6) duration_s, null reason from q join g using (subject)""",
    "signal_samples": f"""with {FOLDER_SQL}, c as (select subject, ['acc_x [g]', 'EMG (uV)', 'col2', 'ecg', 'x'][k+1] channel, ['g', 'uV', null, null, null][k+1] unit, ['imu', 'emg', 'unknown', 'ecg', 'unknown'][k+1] kind, tm, v from f2
union all select subject, 'flag', null, 'unknown', tm, case when row_ord % 3 = 0 then null else 1 end from f2 where k = 3)
select subject, channel, unit, kind, count(*) n, count(v) n_valid, round(avg(v),6) mean_x, round(max(tm),6) last_ms, round(nullif(arg_max(coalesce(v, -1), tm), -1),6) last_x from c group by all""",
}

QUERIES = {"signal_files": signal_files, "signal_samples": signal_samples}
