"""Queries of the series operators over the test tables, each with its DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.functions.columns import local_hour
from tidewell.operators import chronic, events, rhythm
from tidewell.sources.adapters import EVENT_KEYS_SQL, RAW_TIMELINE_SQL, TIMELINE_SQL, marks, marks_sql, raw_timeline, timeline

DIGITS = 6


def rounded(df: DataFrame, digits: int = DIGITS) -> DataFrame:
    """Fractions rounded for comparison."""
    return df.select(*[F.round(c, digits).alias(c) if t in ("double", "float") else F.col(c) for c, t in df.dtypes])


LIMITS_SQL = TIMELINE_SQL + """,
limits as (select subject, hemisphere, quantile_cont(lfp, 0.25) as lower, quantile_cont(lfp, 0.75) as upper from tl where lfp is not null group by all)"""
CLEAN_SQL = TIMELINE_SQL + """,
med as (select subject, hemisphere, quantile_cont(lfp, 0.5) as med from tl group by all),
mads as (select subject, hemisphere, med, case when m = 0 then 1e-9 else m end as mad, n from
 (select subject, hemisphere, med, 1.4826*quantile_cont(abs(lfp-med), 0.5) as m, count(lfp) as n from tl join med using (subject, hemisphere) group by all)),
cl as (select tl.* from tl join mads using (subject, hemisphere) where abs(lfp-med) <= 4*mad)"""
HOUR = "(epoch(t) % 86400) / 3600.0"


def limits(series: DataFrame) -> DataFrame:
    return chronic.quartiles(series).select("subject", "hemisphere", F.col("q1").alias("lower"), F.col("q3").alias("upper"))


def censor_summary(spark: SparkSession, d: str) -> DataFrame:
    return rounded(chronic.censoring_summary(timeline(spark, d)))


def merge_dedup(spark: SparkSession, d: str) -> DataFrame:
    hourly = raw_timeline(spark, d).withColumn("t", F.date_trunc("hour", "t"))
    m = chronic.merge_series(chronic.censor(hourly))
    return rounded(m.select("subject", "hemisphere", F.unix_micros("t").alias("t_us"), "row_ord", "lfp", "censored"))


def mad_clean(spark: SparkSession, d: str) -> DataFrame:
    c = chronic.clean(timeline(spark, d))
    return rounded(c.groupBy("subject", "hemisphere").agg(F.count("*").alias("n_kept"), F.min("lfp").alias("least"), F.max("lfp").alias("most"), F.avg("lfp").alias("mean_lfp")))


def quantiles(spark: SparkSession, d: str) -> DataFrame:
    return rounded(chronic.quartiles(timeline(spark, d)))


def zones(spark: SparkSession, d: str) -> DataFrame:
    x = timeline(spark, d)
    return rounded(chronic.zone_summary(x, limits(x)))


def transitions(spark: SparkSession, d: str) -> DataFrame:
    x = timeline(spark, d)
    return chronic.zone_transitions(x, limits(x))


def hampel_days(spark: SparkSession, d: str) -> DataFrame:
    x = chronic.hampel(timeline(spark, d))
    return rounded(chronic.audit_days(x, per_day=30))


def day_gaps(spark: SparkSession, d: str) -> DataFrame:
    return rounded(chronic.day_segments(timeline(spark, d)).drop("segment"))


def wake(spark: SparkSession, d: str) -> DataFrame:
    return rounded(chronic.wake_percentiles(timeline(spark, d)))


def causal(spark: SparkSession, d: str) -> DataFrame:
    x = chronic.causal_mean(timeline(spark, d), 6 * 3600)
    return rounded(x.select("subject", "hemisphere", "row_ord", F.col("mean").alias("mean_lfp")), 10)


def moving(spark: SparkSession, d: str) -> DataFrame:
    x = chronic.moving_days(timeline(spark, d), 2)
    return rounded(x.select("subject", "hemisphere", "row_ord", F.col("mean").alias("mean_lfp")), 10)


def cosinor24(spark: SparkSession, d: str) -> DataFrame:
    return rounded(rhythm.cosinor(timeline(spark, d)))


def rayleigh_high(spark: SparkSession, d: str) -> DataFrame:
    x = timeline(spark, d)
    high = x.join(limits(x), ["subject", "hemisphere"]).where("lfp > upper").withColumn("hour", local_hour(F.col("t")))
    return rounded(rhythm.rayleigh(high))


def eta2(spark: SparkSession, d: str) -> DataFrame:
    return rounded(rhythm.variance_by_hour(timeline(spark, d)))


def profile(spark: SparkSession, d: str) -> DataFrame:
    return rounded(rhythm.diurnal_profile(timeline(spark, d), relative=True))


def stability(spark: SparkSession, d: str) -> DataFrame:
    return rounded(rhythm.interdaily_stability(timeline(spark, d), least_cover=0.3))


def variability(spark: SparkSession, d: str) -> DataFrame:
    return rounded(rhythm.intradaily_variability(timeline(spark, d), least_cover=0.3))


def m10l5(spark: SparkSession, d: str) -> DataFrame:
    return rounded(rhythm.m10_l5(timeline(spark, d), least_cover=0.3))


def actogram(spark: SparkSession, d: str) -> DataFrame:
    return rounded(rhythm.actogram(timeline(spark, d)))


def aligned(spark: SparkSession, d: str) -> DataFrame:
    return rounded(events.event_aligned(timeline(spark, d), marks(spark, d, "signup"), 120, 240, 60, relative=False))


def asof_status(spark: SparkSession, d: str) -> DataFrame:
    status = marks(spark, d, "purchase").withColumn("status", F.col("row_ord"))
    x = timeline(spark, d).where("not censored")
    return events.as_of(x, status, "status").select("subject", "hemisphere", "row_ord", "as_of")


def nearest_mark(spark: SparkSession, d: str) -> DataFrame:
    x = timeline(spark, d).where("censored").select("subject", "hemisphere", "t", "row_ord")
    return rounded(events.nearest(x, marks(spark, d, "signup"), 3 * 3600).drop("t"))


def doses(spark: SparkSession, d: str) -> DataFrame:
    return rounded(events.dose_markers(marks(spark, d, "purchase")))


def threshold_report(spark: SparkSession, d: str) -> DataFrame:
    """The flagship: cleaned series, their shares by zone and their rhythm."""
    x = chronic.clean(chronic.merge_series(timeline(spark, d)))
    return rounded(chronic.zone_summary(x, limits(x)).join(rhythm.cosinor(x).drop("n"), ["subject", "hemisphere"]))


def _cosinor_sql(source: str) -> str:
    return f"""xs as (select subject, hemisphere, cos({HOUR}*2*pi()/24) c, sin({HOUR}*2*pi()/24) s, lfp y from {source} where lfp is not null),
mo as (select subject, hemisphere, count(*)::double n, sum(c) sc, sum(s) ss, sum(c*c) cc, sum(s*s) s2, sum(c*s) cs, sum(y) sy, sum(c*y) cy, sum(s*y) s_y, sum(y*y) yy from xs group by all),
de as (select *, n*(cc*s2-cs*cs)-sc*(sc*s2-cs*ss)+ss*(sc*cs-cc*ss) dd from mo),
so as (select *, (sy*(cc*s2-cs*cs)-sc*(cy*s2-cs*s_y)+ss*(cy*cs-cc*s_y))/dd m, (n*(cy*s2-cs*s_y)-sy*(sc*s2-cs*ss)+ss*(sc*s_y-cy*ss))/dd b,
 (n*(cc*s_y-cy*cs)-sc*(sc*s_y-cy*ss)+sy*(sc*cs-cc*ss))/dd g from de),
co as (select subject, hemisphere, n::bigint n, round(m, 6) mesor, round(sqrt(b*b+g*g), 6) amplitude, round(((atan2(g,b)*24/(2*pi())+24) % 24), 6) acrophase,
 round((m*sy+b*cy+g*s_y-sy*sy/n)/(yy-sy*sy/n), 6) r2 from so)"""


_HOURLY = TIMELINE_SQL + f""",
hr as (select subject, hemisphere, t::date as day, floor({HOUR})::int as h, avg(lfp) v from tl where lfp is not null group by all)"""

ORACLE = {
    "censor_summary": f"with {TIMELINE_SQL} select hemisphere, count(*) n, count(*) filter (censored) n_censored, round(count(*) filter (censored)/count(*)::double, 6) share_censored from tl group by rollup(hemisphere)",
    "merge_dedup": f"""with {RAW_TIMELINE_SQL}, o as (select *, row_number() over (partition by subject, hemisphere, date_trunc('hour', t) order by row_ord) k from raw)
select subject, hemisphere, epoch_us(date_trunc('hour', t)) t_us, row_ord, case when lfp_raw >= 0 then round(lfp_raw, 6) end lfp, lfp_raw < 0 censored from o where k = 1""",
    "mad_clean": f"with {CLEAN_SQL} select subject, hemisphere, count(*) n_kept, round(min(lfp),6) least, round(max(lfp),6) most, round(avg(lfp),6) mean_lfp from cl group by all",
    "quantiles": f"with {TIMELINE_SQL} select subject, hemisphere, " + ", ".join(f"round(quantile_cont(lfp, {q}),6) {c}" for q, c in ((0.1, "p10"), (0.25, "q1"), (0.5, "median"), (0.75, "q3"), (0.9, "p90"))) + " from tl group by all",
    "zones": f"""with {LIMITS_SQL} select subject, hemisphere, count(*) n, round(count(*) filter (lfp<lower)/count(*)::double,6) share_below,
round(count(*) filter (lfp>=lower and lfp<=upper)/count(*)::double,6) share_between, round(count(*) filter (lfp>upper)/count(*)::double,6) share_above
from tl join limits using (subject, hemisphere) where lfp is not null group by all""",
    "zone_transitions": f"""with {LIMITS_SQL}, z as (select subject, hemisphere, t::date as day, t, row_ord, case when lfp<lower then 'below' when lfp>upper then 'above' else 'between' end z
from tl join limits using (subject, hemisphere) where lfp is not null), c as (select *, coalesce(lag(z) over (partition by subject, hemisphere, day order by t, row_ord) <> z, false) ch from z)
select subject, hemisphere, day, count(*) n, count(*) filter (ch) n_transitions from c group by all""",
    "hampel_days": f"""with {TIMELINE_SQL}, w as (select *, list(lfp) over (partition by subject, hemisphere order by t, row_ord rows between 5 preceding and 4 following) a0 from tl),
a as (select *, list_filter(a0, lambda x: x is not null) a from w),
m as (select *, list_aggregate(a, 'quantile_cont', 0.5) med from a), k as (select *, 1.4826*list_aggregate(list_transform(a, lambda x: abs(x-med)), 'quantile_cont', 0.5) mad from m),
r as (select *, coalesce(len(a)>=4 and mad>1e-12 and abs(lfp-med)>3*mad, false) artifact from k),
g as (select subject, hemisphere, t::date as day, count(lfp) n_valid, count(*) filter (artifact and lfp is not null) n_rejected from r group by all),
f as (select *, round(n_valid/30.0::double,6) coverage, round(coalesce(n_rejected/nullif(n_valid,0)::double,0),6) rejected,
 case when n_valid/30.0::double < 0.7 then 'low_coverage' when coalesce(n_rejected/nullif(n_valid,0)::double,0) > 0.2 then 'many_artifacts' end reason from g) select *, reason is null used from f""",
    "day_gaps": f"""with {TIMELINE_SQL}, x as (select subject, hemisphere, row_ord, t, epoch_us(t)/1e6 s, t::date as day from tl where lfp is not null),
st as (select *, s - lag(s) over (partition by subject, hemisphere order by t, row_ord) step from x), u as (select subject, hemisphere, quantile_cont(step, 0.5) usual from st where step > 0 group by all),
c as (select st.*, coalesce(s - lag(s) over (partition by subject, hemisphere, day order by t, row_ord) > 3*usual, true)::int cut from st join u using (subject, hemisphere)),
g as (select *, sum(cut) over (partition by subject, hemisphere, day order by t, row_ord rows unbounded preceding) seg from c),
p as (select subject, hemisphere, day, seg, count(*) n, round(min(s),6) from_s, round(max(s),6) to_s from g group by all),
r as (select subject, hemisphere, min(day) a, max(day) z from x group by all), d as (select subject, hemisphere, unnest(generate_series(a::timestamp, z::timestamp, interval 1 day))::date as day from r)
select subject, hemisphere, day, coalesce(n, 0) n, from_s, to_s from d left join p using (subject, hemisphere, day)""",
    "wake_percentiles": f"""with {TIMELINE_SQL}, x as (select *, t::date as day from tl where lfp is not null and {HOUR} >= 8 and {HOUR} < 22),
a as (select *, dense_rank() over (partition by subject, hemisphere order by day desc) age from x), l as (select * from a where age <= 14),
dy as (select subject, hemisphere, day, quantile_cont(lfp, 0.5) m from l group by all), cv as (select subject, hemisphere, round(100*stddev_samp(m)/avg(m),6) cv_percent from dy group by all)
select subject, hemisphere, count(distinct day) n_days, round(quantile_cont(lfp,0.25),6) p25, round(quantile_cont(lfp,0.5),6) p50, round(quantile_cont(lfp,0.75),6) p75, any_value(cv_percent) cv_percent
from l join cv using (subject, hemisphere) group by subject, hemisphere""",
    "causal_mean": f"""with {TIMELINE_SQL} select subject, hemisphere, row_ord, round(avg(lfp) over (partition by subject, hemisphere order by epoch_ms(t) range between 21599999 preceding and current row),10) mean_lfp from tl""",
    "moving_days": f"""with {TIMELINE_SQL} select subject, hemisphere, row_ord, round(avg(lfp) over (partition by subject, hemisphere order by epoch_ms(t) range between 86400000 preceding and 86400000 following),10) mean_lfp from tl""",
    "cosinor": f"with {TIMELINE_SQL}, {_cosinor_sql('tl')} select * from co",
    "rayleigh": f"""with {LIMITS_SQL}, h as (select subject, hemisphere, {HOUR}*2*pi()/24 a from tl join limits using (subject, hemisphere) where lfp > upper),
m as (select subject, hemisphere, count(*) n, avg(cos(a)) c, avg(sin(a)) s from h group by all having count(*) >= 3), z as (select *, sqrt(c*c+s*s) r, n*(c*c+s*s) z from m)
select subject, hemisphere, n, round(r,6) r, round(z,6) z, round(least(1.0, greatest(0.0, exp(sqrt(1+4*n+4*(n*n-z*z))-(1+2*n)))),6) p,
round((atan2(s,c)*24/(2*pi())+24) % 24, 6) mean_hour from z""",
    "eta2": f"""with {TIMELINE_SQL}, b as (select subject, hemisphere, floor({HOUR}) b, count(*)::double n, sum(lfp) y, sum(lfp*lfp) yy from tl where lfp is not null group by all),
a as (select subject, hemisphere, sum(n) n, sum(y) y, sum(yy) yy, sum(y*y/n) bt, count(*) k from b group by all)
select subject, hemisphere, n::bigint n, round((bt-y*y/n)/(yy-y*y/n),6) eta2, round(((bt-y*y/n)/(k-1))/((yy-bt)/(n-k)),6) f from a where k > 1 and n > k""",
    "diurnal_profile": f"""with {TIMELINE_SQL}, x as (select *, t::date as day, floor({HOUR})::int as bin from tl where lfp is not null), c as (select subject, hemisphere, day, bin, quantile_cont(lfp,0.5) v from x group by all),
d as (select subject, hemisphere, day, quantile_cont(lfp,0.5) d from x group by all), r as (select c.*, 100*v/nullif(d,0) w from c join d using (subject, hemisphere, day))
select subject, hemisphere, bin, count(w) n_days, round(quantile_cont(w,0.25),6) q1, round(quantile_cont(w,0.5),6) median, round(quantile_cont(w,0.75),6) q3 from r group by all""",
    "interdaily_stability": f"""with {_HOURLY}, k as (select *, count(*) over (partition by subject, hemisphere, day) k from hr), x as (select * from k where k >= 0.3*24),
a as (select subject, hemisphere, count(*) n, count(distinct day) n_days, avg(v) m, var_pop(v)*count(*) sst from x group by all), b as (select subject, hemisphere, h, avg(v) mh from x group by all),
c as (select subject, hemisphere, sum((mh-m)*(mh-m)) ssb, count(*) p from b join a using (subject, hemisphere) group by all)
select subject, hemisphere, n_days, round(n*ssb/(p*sst),6) stability from a join c using (subject, hemisphere) where n_days >= 3""",
    "intradaily_variability": f"""with {_HOURLY}, k as (select *, count(*) over (partition by subject, hemisphere, day) k from hr), x as (select * from k where k >= 0.3*24),
s as (select *, dense_rank() over (partition by subject, hemisphere order by day)*24+h as slot from x),
d as (select *, case when slot - lag(slot) over w = 1 then (v - lag(v) over w)*(v - lag(v) over w) end step from s window w as (partition by subject, hemisphere order by slot)),
a as (select subject, hemisphere, count(distinct day) n_days, count(*) n, count(step) n_pairs, sum(step) st, var_pop(v)*count(*) ss from d group by all)
select subject, hemisphere, n_days, n_pairs, 24*n_days - 1 - n_pairs n_skipped, round(n*(st*(24*n_days-1)/n_pairs)/((n-1)*ss),6) variability from a where n_days >= 3""",
    "event_aligned": f"""with {TIMELINE_SQL}, {marks_sql('ev', 'signup')}, j as (select tl.subject, tl.hemisphere, ev.row_ord e, tl.row_ord, epoch_us(tl.t)/1e6 s, epoch_us(tl.t)/1e6 - epoch_us(ev.t)/1e6 lag, lfp
from tl join ev on tl.subject=ev.subject and tl.hemisphere=ev.hemisphere and epoch_us(tl.t) between epoch_us(ev.t)-7200000000 and epoch_us(ev.t)+14400000000 where lfp is not null),
b as (select *, floor((lag/60+120)/60+0.5)::int b from j), c as (select subject, hemisphere, e, b, arg_max(lfp, (s, row_ord)) v from b group by all),
k as (select *, count(*) over (partition by subject, hemisphere, e) k from c), o as (select * from k where k >= 0.4*7)
select subject, hemisphere, b*60-120 as minute, count(v) n_trials, round(quantile_cont(v,0.25),6) q1, round(quantile_cont(v,0.5),6) median, round(quantile_cont(v,0.75),6) q3 from o group by subject, hemisphere, b""",
    "asof_status": f"""with {TIMELINE_SQL}, {marks_sql('st', 'purchase')} select tl.subject, tl.hemisphere, tl.row_ord, st.row_ord as as_of from tl asof left join st on tl.subject=st.subject and tl.hemisphere=st.hemisphere and tl.t >= st.t where not censored""",
    "nearest_mark": f"""with {TIMELINE_SQL}, {marks_sql('st', 'signup')}, x as (select * from tl where censored),
j as (select x.subject, x.hemisphere, x.row_ord, st.row_ord e, epoch_us(x.t)/1e6 - epoch_us(st.t)/1e6 lag, epoch_us(st.t) et from x join st on x.subject=st.subject and x.hemisphere=st.hemisphere and abs(epoch_us(x.t)-epoch_us(st.t)) <= 10800000000),
m as (select subject, hemisphere, row_ord, arg_min(e, (abs(lag), et)) mark, arg_min(lag, (abs(lag), et)) lag from j group by all)
select x.subject, x.hemisphere, x.row_ord, mark, round(lag,6) mark_lag_s from x left join m using (subject, hemisphere, row_ord)""",
    "dose_markers": f"""with {EVENT_KEYS_SQL}, {marks_sql('st', 'purchase')}, d as (select *, t::date as day, epoch_us(t)/1e6 - lag(epoch_us(t)/1e6) over (partition by subject, hemisphere, t::date order by t, row_ord) ap from st)
select subject, hemisphere, count(*) n, round(count(*)/count(distinct day)::double,6) per_day, round(quantile_cont(ap,0.5),6) median_apart_s from d group by all""",
    "threshold_report": f"""with {CLEAN_SQL}, li as (select subject, hemisphere, quantile_cont(lfp,0.25) lower, quantile_cont(lfp,0.75) upper from cl group by all),
zs as (select subject, hemisphere, count(*) n, round(count(*) filter (lfp<lower)/count(*)::double,6) share_below, round(count(*) filter (lfp>=lower and lfp<=upper)/count(*)::double,6) share_between,
 round(count(*) filter (lfp>upper)/count(*)::double,6) share_above from cl join li using (subject, hemisphere) group by all), {_cosinor_sql('cl')}
select zs.*, mesor, amplitude, acrophase, r2 from zs join co using (subject, hemisphere)""",
}

QUERIES = {
    "censor_summary": censor_summary, "merge_dedup": merge_dedup, "mad_clean": mad_clean, "quantiles": quantiles, "zones": zones, "zone_transitions": transitions,
    "hampel_days": hampel_days, "day_gaps": day_gaps, "wake_percentiles": wake, "causal_mean": causal, "moving_days": moving, "cosinor": cosinor24, "rayleigh": rayleigh_high,
    "eta2": eta2, "diurnal_profile": profile, "interdaily_stability": stability, "intradaily_variability": variability, "m10_l5": m10l5, "actogram": actogram,
    "event_aligned": aligned, "asof_status": asof_status, "nearest_mark": nearest_mark, "dose_markers": doses, "threshold_report": threshold_report,
}
