"""Queries of waking hours, tail probabilities, clusters and paired spectra over the test tables, with DuckDB SQL where it can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.functions import distributions
from tidewell.operators import clusters, rhythm, signal, wake
from tidewell.sources.adapters import read, signals, timeline

from .chronic import rounded
from .records import ORACLE as RECORDS_SQL
from .records import PAIRS_SQL, _pairs

K = ["subject", "hemisphere"]
#: Draws of the cluster query.
DRAWS = 99


def wake_windows(spark: SparkSession, d: str) -> DataFrame:
    return rounded(wake.wake_window(timeline(spark, d)), 5)


def wake_limits(spark: SparkSession, d: str) -> DataFrame:
    """Quartiles of each series over its own waking hours."""
    x = timeline(spark, d)
    awake = wake.in_wake(x.where("lfp is not null"), wake.wake_window(x))
    q = awake.groupBy(*K).agg(F.count("*").alias("n"), F.expr("percentile(lfp, array(0.25, 0.75))").alias("q"))
    return rounded(q.select(*K, "n", F.get("q", 0).alias("lower"), F.get("q", 1).alias("upper")))


def cosinor_p(spark: SparkSession, d: str) -> DataFrame:
    """p of the cosinor's F, with all samples and with the number that the autocorrelation leaves."""
    x = rhythm.cosinor_test(timeline(spark, d))
    p = distributions.f_p_value(F.col("f"), F.lit(2), F.col("n") - 3)
    adjusted = distributions.f_p_value(F.col("f_adjusted"), F.lit(2), F.col("df2_adjusted"))
    return rounded(x.select(*K, "n", p.alias("p"), adjusted.alias("p_adjusted")))


def band_clusters(spark: SparkSession, d: str) -> DataFrame:
    x = _pairs(spark, d).select(F.lit(0).alias("study"), F.col("unit").alias("trial"), F.col("f").cast("int").alias("point"), (F.col("b") - F.col("a")).alias("d"))
    return rounded(clusters.cluster_test(x, ["study"], DRAWS, 1.0), 4)


def coherence_bands(spark: SparkSession, d: str) -> DataFrame:
    """Coherence between neighbouring records of 64 samples, in windows of 16."""
    label = read(spark, d, "embeddings").select(F.col("vec_id").alias("rec"))
    x = signals(spark, d).join(label, "rec")
    left = x.where("rec % 2 = 0").select(F.expr("rec div 2").alias("unit"), F.col("x").alias("a"), "fs")
    right = x.where("rec % 2 = 1").select(F.expr("rec div 2").alias("unit"), F.col("x").alias("b"))
    return rounded(signal.coherence_rows(left.join(right, "unit"), {"alpha": (8, 12), "beta": (13, 30)}, "unit", window=16), 5)


#: Of two terms, the F's tail has a closed form.
TAIL_SQL = "pow(1 + 2*({f})/({d})::double, -({d})/2.0::double)"
COSINOR_SQL = RECORDS_SQL["cosinor_test"].rpartition("\nselect ")[0]

ORACLE = {
    "cosinor_p": f"""{COSINOR_SQL}
select subject, hemisphere, n::bigint n, round({TAIL_SQL.format(f="f", d="n-3")}, 6) p, round({TAIL_SQL.format(f="f*greatest(0.02, ne/n)", d="greatest(2.0, floor(ne+0.5)-3)")}, 6) p_adjusted from fe""",
    "band_clusters": f"""with {PAIRS_SQL}, k as (select unnest(generate_series(0, {DRAWS})) draw), h0 as (select draw, unit, (draw*7919 + unit*104729 + 12345) % 2147483647 h from k, (select distinct unit from pr)),
h1 as (select draw, unit, (((h*48271) % 2147483647)*48271) % 2147483647 h from h0), sg as (select draw, unit, case when draw > 0 and (h//65536) % 2 = 1 then -1.0::double else 1.0::double end s from h1),
m as (select draw, f::int point, count(*) n, avg(s*(b-a)) me, stddev_samp(s*(b-a)) sd from pr join sg using (unit) group by all having count(*) >= 2), t as (select draw, point, me/nullif(sd/sqrt(n), 0) t from m),
o as (select *, sign(t) s, point - row_number() over (partition by draw, sign(t) order by point) run from t where abs(t) >= 1), r as (select draw, s, run, min(point) a, max(point) z, sum(t) mass from o group by all),
n as (select draw, max(abs(mass)) most from r where draw > 0 group by all)
select 0 study, a as "first", z as "last", round(mass, 4) mass, round(((select count(*) from n where most >= abs(mass) - 1e-9) + 1)/({DRAWS}+1)::double, 4) p from r where draw = 0""",
}

QUERIES = {"wake_windows": wake_windows, "wake_limits": wake_limits, "cosinor_p": cosinor_p, "band_clusters": band_clusters, "coherence_bands": coherence_bands}
