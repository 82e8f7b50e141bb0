"""Queries of configuration, cohort and signal operators over the test tables, with their DuckDB SQL where it can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.functions.columns import seconds
from tidewell.operators import blocks, cohort, rhythm, signal
from tidewell.sources.adapters import TIMELINE_SQL, impedances, read, sessions, signals, timeline

from .chronic import rounded


def config_blocks(spark: SparkSession, d: str) -> DataFrame:
    b = blocks.config_blocks(sessions(spark, d))
    return b.select("subject", "block", "n_sessions", F.to_date("start").alias("start"), F.to_date("end").alias("end"), "channel")


def segment_by_block(spark: SparkSession, d: str) -> DataFrame:
    s = sessions(spark, d)
    later = s.select("subject", (F.col("t") + F.expr("INTERVAL 30 DAYS")).alias("t"), "row_ord")
    return blocks.in_blocks(later, blocks.config_blocks(s)).select("subject", "row_ord", "block")


def impedance_drift(spark: SparkSession, d: str) -> DataFrame:
    return rounded(blocks.impedance_drift(impedances(spark, d)))


def cohort_wilson(spark: SparkSession, d: str) -> DataFrame:
    c, n = read(spark, d, "customer"), read(spark, d, "nation")
    x = c.join(n, c["c_nationkey"] == n["n_nationkey"]).select(F.col("n_name").alias("nation"), (F.col("c_acctbal") < 0).alias("overdrawn"))
    return rounded(cohort.prevalence(x, "nation", "overdrawn"))


def icc(spark: SparkSession, d: str) -> DataFrame:
    x = timeline(spark, d).where("lfp is not null").withColumn("week", F.floor((F.dayofmonth("t") - 1) / 7))
    return rounded(cohort.icc(x, "subject", "week", "lfp", ["hemisphere"]))


def kappa(spark: SparkSession, d: str) -> DataFrame:
    return rounded(cohort.kappa(read(spark, d, "labels"), "quality", "toxic"))


def spearman(spark: SparkSession, d: str) -> DataFrame:
    o = read(spark, d, "lineitem").select(F.col("l_returnflag").alias("flag"), "l_quantity", "l_extendedprice")
    return rounded(cohort.spearman(o, "l_quantity", "l_extendedprice", ["flag"]))


def histogram(spark: SparkSession, d: str) -> DataFrame:
    return cohort.histogram(timeline(spark, d), "lfp", ["subject", "hemisphere"])


def ecdf(spark: SparkSession, d: str) -> DataFrame:
    return rounded(cohort.ecdf(timeline(spark, d), "lfp", ["subject", "hemisphere"]))


def bimodality(spark: SparkSession, d: str) -> DataFrame:
    return rounded(cohort.bimodality(timeline(spark, d), "lfp", ["subject", "hemisphere"]))


def latest_session(spark: SparkSession, d: str) -> DataFrame:
    x = cohort.latest(sessions(spark, d), ["subject"], ["t", "row_ord"])
    return rounded(x.select("subject", F.to_date("t").alias("t"), "channel", "centre", "row_ord"))


def acrophase_by_hemisphere(spark: SparkSession, d: str) -> DataFrame:
    c = rhythm.cosinor(timeline(spark, d)).select("hemisphere", F.col("acrophase").alias("hour"))
    return rounded(rhythm.rayleigh(c, ["hemisphere"]))


def dft_power(spark: SparkSession, d: str) -> DataFrame:
    return rounded(signal.dft_power(signals(spark, d), 16))


def band_share(spark: SparkSession, d: str) -> DataFrame:
    return rounded(signal.band_share(signal.dft_power(signals(spark, d)), 13, 30))


def packet_gaps(spark: SparkSession, d: str) -> DataFrame:
    x = timeline(spark, d).select("subject", "hemisphere", "row_ord", seconds(F.col("t")).alias("s"))
    return rounded(signal.packet_gaps(x, 3600.0, ["subject", "hemisphere"]))


def welch_bands(spark: SparkSession, d: str) -> DataFrame:
    return rounded(signal.spectral_rows(signals(spark, d), window=16))


def burst_rows(spark: SparkSession, d: str) -> DataFrame:
    return rounded(signal.burst_rows(signals(spark, d)))


def aperiodic_rows(spark: SparkSession, d: str) -> DataFrame:
    return rounded(signal.aperiodic_rows(signals(spark, d), window=16))


def survey_rank(spark: SparkSession, d: str) -> DataFrame:
    e = read(spark, d, "embeddings").select(F.col("vec_id").alias("rec"), "label")
    x = signal.power_spectra(signals(spark, d), window=16).join(e, "rec")
    return rounded(cohort.survey_rank(x, 12, 30, ["label"], "rec"))


ORACLE = {
    "config_blocks": """with s as (select o_custkey subject, o_orderdate t, o_orderpriority ch, o_totalprice c, o_orderkey r from orders),
k as (select *, coalesce(ch <> lag(ch) over w or abs(c - lag(c) over w) > 0.5*abs(lag(c) over w), false)::int cut from s window w as (partition by subject order by t, r)),
b as (select *, sum(cut) over (partition by subject order by t, r rows unbounded preceding)::bigint block from k),
g as (select subject, block, count(*) n_sessions, min(t) st, arg_min(ch, (t, r)) channel from b group by all)
select subject, block, n_sessions, st::date "start", (lead(st) over (partition by subject order by block))::date "end", channel from g""",
    "segment_by_block": """with s as (select o_custkey subject, o_orderdate t, o_orderpriority ch, o_totalprice c, o_orderkey r from orders),
k as (select *, coalesce(ch <> lag(ch) over w or abs(c - lag(c) over w) > 0.5*abs(lag(c) over w), false)::int cut from s window w as (partition by subject order by t, r)),
b as (select *, sum(cut) over (partition by subject order by t, r rows unbounded preceding)::bigint block from k),
g as (select subject, block, min(t) st from b group by all)
select s.subject, s.r row_ord, max(block) block from s left join g on s.subject = g.subject and g.st <= s.t + interval 30 day group by all""",
    "impedance_drift": """with x as (select l_partkey contact, l_shipdate t, l_quantity ohm, l_orderkey*10+l_linenumber r, epoch_us(l_shipdate)/86400000000.0::double dy from lineitem),
g as (select contact, count(*) n, arg_min(ohm, (t, r)) first_ohm, arg_max(ohm, (t, r)) last_ohm, regr_slope(ohm, dy) sl from x group by all)
select contact, n, first_ohm, last_ohm, round(case when n >= 3 then sl end, 6) slope, round(100*(last_ohm-first_ohm)/nullif(first_ohm,0), 6) change_percent, coalesce(abs(100*(last_ohm-first_ohm)/nullif(first_ohm,0)) >= 25, false) flag from g""",
    "cohort_wilson": """with g as (select n_name nation, count(*) n, count(*) filter (c_acctbal < 0) k from customer join nation on c_nationkey=n_nationkey group by rollup(n_name)),
p as (select *, k/n::double p, 1.959964::double z from g)
select nation, n, k, round(p,6) p, round(greatest(0.0, ((p+z*z/(2*n))-z*sqrt(p*(1-p)/n+z*z/(4.0*n*n)))/(1+z*z/n)),6) low, round(least(1.0, ((p+z*z/(2*n))+z*sqrt(p*(1-p)/n+z*z/(4.0*n*n)))/(1+z*z/n)),6) high, n < 5 descriptive from p""",
    "icc": f"""with {TIMELINE_SQL}, c as (select hemisphere, subject, floor((day(t)-1)/7) w, avg(lfp) v from tl where lfp is not null group by all), r as (select hemisphere, count(distinct w) k from c group by all),
h as (select c.*, k, count(*) over (partition by hemisphere, subject) hv from c join r using (hemisphere)), f as (select * from h where hv = k),
s as (select hemisphere, sum(x*x) ss, count(*)::double n from (select hemisphere, subject, sum(v) x from f group by all) group by all), rr as (select hemisphere, sum(x*x) sr, count(*)::double k from (select hemisphere, w, sum(v) x from f group by all) group by all),
t as (select hemisphere, sum(v) x, sum(v*v) xx from f group by all),
m as (select hemisphere, n, k, (ss/k-x*x/(n*k))/(n-1) a, (sr/n-x*x/(n*k))/(k-1) b, (xx-ss/k-sr/n+x*x/(n*k))/((n-1)*(k-1)) c from s join rr using (hemisphere) join t using (hemisphere))
select hemisphere, n::bigint n, k::bigint k, round((a-c)/(a+(k-1)*c+k*(b-c)/n),6) icc21, round((a-c)/(a+(k-1)*c),6) icc31 from m where n >= 3 and k >= 2""",
    "kappa": """with m as (select count(*)::double n, count(*) filter (quality=1 and toxic=1) tp, count(*) filter (quality=0 and toxic=0) tn, count(*) filter (quality=0 and toxic=1) fp, count(*) filter (quality=1 and toxic=0) fn from labels where quality is not null and toxic is not null),
k as (select *, (tp+tn)/n po, ((tp+fn)*(tp+fp)+(tn+fp)*(tn+fn))/(n*n) pe from m)
select n::bigint n, tp, tn, fp, fn, round(case when n >= 20 then (po-pe)/(1-pe) end, 6) kappa, round(tp/nullif(tp+fn,0)::double,6) sensitivity, round(tn/nullif(tn+fp,0)::double,6) specificity from k""",
    "spearman": """with r as (select l_returnflag flag, rank() over (partition by l_returnflag order by l_quantity) + (count(*) over (partition by l_returnflag, l_quantity)-1)/2.0::double rx,
rank() over (partition by l_returnflag order by l_extendedprice) + (count(*) over (partition by l_returnflag, l_extendedprice)-1)/2.0::double ry from lineitem) select flag, count(*) n, round(corr(rx, ry),6) rho from r group by all""",
    "histogram": f"""with {TIMELINE_SQL}, s as (select subject, hemisphere, min(lfp) lo, max(lfp) hi from tl where lfp is not null group by all)
select subject, hemisphere, least(coalesce(floor((lfp-lo)/nullif(hi-lo,0)*40),0),39)::int bin, count(*) n from tl join s using (subject, hemisphere) where lfp is not null group by all""",
    "ecdf": f"""with {TIMELINE_SQL} select subject, hemisphere, row_ord, round(lfp,6) lfp, round(row_number() over (partition by subject, hemisphere order by lfp, row_ord)/(count(*) over (partition by subject, hemisphere))::double,6) p from tl where lfp is not null""",
    "bimodality": f"""with {TIMELINE_SQL}, m as (select subject, hemisphere, count(lfp)::double n, avg(lfp) m, stddev_samp(lfp) s from tl where lfp is not null group by all having count(lfp) >= 4),
z as (select subject, hemisphere, n, avg(power((lfp-m)/s,3)) g, avg(power((lfp-m)/s,4)) k from tl join m using (subject, hemisphere) where lfp is not null group by all)
select subject, hemisphere, n::bigint n, round(g,6) skew, round(k-3,6) excess, round((g*g+1)/(k-3+3*(n-1)*(n-1)/((n-2)*(n-3))),6) bc from z""",
    "latest_session": """with o as (select *, row_number() over (partition by o_custkey order by o_orderdate desc, o_orderkey desc) k from orders)
select o_custkey subject, o_orderdate::date t, o_orderpriority channel, round(o_totalprice,6) centre, o_orderkey row_ord from o where k = 1""",
    "dft_power": """with x as (select vec_id rec, generate_subscripts(embedding, 1)-1 i, unnest(embedding)::double v, len(embedding) n from embeddings), k as (select unnest(generate_series(0, 16)) k)
select rec, k::int k, round((power(sum(v*cos(k*i*2*pi()/n)),2)+power(sum(v*sin(k*i*2*pi()/n)),2))/max(n),6) power from x, k group by all""",
    "band_share": """with x as (select vec_id rec, generate_subscripts(embedding, 1)-1 i, unnest(embedding)::double v, len(embedding) n from embeddings), k as (select unnest(generate_series(0, 32)) k),
p as (select rec, k, (power(sum(v*cos(k*i*2*pi()/n)),2)+power(sum(v*sin(k*i*2*pi()/n)),2))/max(n) p from x, k group by all)
select rec, round(sum(case when k between 13 and 30 then p else 0 end)/sum(p),6) share from p where k > 0 group by all""",
    "packet_gaps": f"""with {TIMELINE_SQL}, x as (select subject, hemisphere, epoch_us(t)/1e6 s, row_ord from tl), st as (select *, s - lag(s) over (partition by subject, hemisphere order by s, row_ord) step from x)
select subject, hemisphere, count(*) n, coalesce(sum(greatest(floor(step/3600.0+0.5)-1, 0)),0)::bigint n_lost, round(max(s)-min(s),6) span_s, round((count(*)-1)*3600.0/nullif(max(s)-min(s),0),6) per_hour from st group by all""",
}

QUERIES = {
    "config_blocks": config_blocks, "segment_by_block": segment_by_block, "impedance_drift": impedance_drift, "cohort_wilson": cohort_wilson, "icc": icc, "kappa": kappa,
    "spearman": spearman, "histogram": histogram, "ecdf": ecdf, "bimodality": bimodality, "latest_session": latest_session, "acrophase_by_hemisphere": acrophase_by_hemisphere,
    "dft_power": dft_power, "band_share": band_share, "packet_gaps": packet_gaps, "welch_bands": welch_bands, "burst_rows": burst_rows, "aperiodic_rows": aperiodic_rows,
    "survey_rank": survey_rank,
}
