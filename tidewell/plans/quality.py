"""Queries of the rule tables and of reproducible peaks over the test tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.operators import rules
from tidewell.operators.chronic import KEYS
from tidewell.sources.adapters import RAW_TIMELINE_SQL, raw_timeline, read, timeline

from .chronic import CLEAN_SQL, HOUR, rounded


def recordings(spark: SparkSession, d: str) -> DataFrame:
    """Each side of each subject as a recording; what a report may lack is missing for some."""
    raw = raw_timeline(spark, d)
    x = rules.measured(raw.select(*KEYS, F.when(F.col("lfp_raw") >= 0, F.col("lfp_raw")).alias("x")), KEYS)
    more = raw.groupBy(*KEYS).agg((100 * F.count_if(F.col("lfp_raw") < 0) / F.count("*")).alias("pct_censored"), (100 * F.count_if(F.col("row_ord") % 13 == 0) / F.count("*")).alias("pct_lost"))
    s = F.col("subject")
    x = x.join(more, KEYS).withColumns({
        "loss_known": s % 4 != 3, "drift_ms": F.when(s % 3 != 0, (s - 4) * 11.0), "high_pass_hz": F.when(s % 2 == 0, F.when(s == 4, 10.0).otherwise(1.0)), "state_confidence": s % 3,
    })
    return x


def alarms(spark: SparkSession, d: str) -> DataFrame:
    return rounded(rules.findings(recordings(spark, d), KEYS))


def alarm_levels(spark: SparkSession, d: str) -> DataFrame:
    return rounded(rules.verdicts(rules.findings(recordings(spark, d), KEYS), KEYS))


def peaks(spark: SparkSession, d: str) -> DataFrame:
    """Embeddings as spectra of 1 to 64 Hz: the greatest magnitude between 13 and 35 Hz, the first of equal ones."""
    e = read(spark, d, "embeddings").select("vec_id", "label", F.posexplode("embedding").alias("at", "v")).where(F.col("at").between(12, 34))
    top = F.max(F.struct(F.abs("v").cast("double").alias("m"), (-F.col("at")).alias("back"))).alias("t")
    e = e.groupBy("vec_id", "label").agg(top)
    channel = F.concat(F.col("label").cast("string"), F.lit("-"), (F.col("vec_id") % 25).cast("string"))
    return e.select((F.col("vec_id") % 8).alias("subject"), F.when(F.col("vec_id") % 2 == 0, "Left").otherwise("Right").alias("hemisphere"), channel.alias("channel"), (1.0 - F.col("t.back")).alias("f"), F.col("t.m").alias("magnitude"), F.when(F.col("vec_id") % 3 > 0, F.col("vec_id") % 5 > 1).alias("flag"))


def reproducibility(spark: SparkSession, d: str) -> DataFrame:
    return rounded(rules.peak_reproducibility(peaks(spark, d), [*KEYS, "channel"]))


def panel(spark: SparkSession, d: str) -> DataFrame:
    x = rules.panel_inputs(recordings(spark, d), rules.peak_reproducibility(peaks(spark, d), [*KEYS, "channel"]), KEYS)
    return rounded(rules.findings(x, KEYS, rules.PANEL))


def eligible(spark: SparkSession, d: str) -> DataFrame:
    s = F.col("subject")
    x = recordings(spark, d).select(*KEYS, "pct_lost", "loss_known").withColumns({
        "has_peak": F.when(s != 6, s != 5), "has_signal": s != 7, "state": F.when(s == 3, "UNKNOWN").otherwise("ON"), "rate_hz": F.when(s == 2, 85.0).otherwise(130.0), "pulse_us": F.lit(60.0),
    })
    x = rules.panel_inputs(x, rules.peak_reproducibility(peaks(spark, d), [*KEYS, "channel"]), KEYS)
    x = x.join(rules.chronic_evidence(timeline(spark, d), KEYS), KEYS, "left")
    return rules.eligibility(rules.findings(x, KEYS, rules.ELIGIBILITY), KEYS)


MEASURED_SQL = """v as (select *, case when lfp_raw >= 0 then lfp_raw end x from raw),
en as (select subject, hemisphere, max(x) mx, min(x) mn from v group by all),
rc as (select subject, hemisphere, count(*) n, count(x) n_valid, count(*) filter (x = mx or x = mn) n_extreme, stddev_samp(x) sd, 100.0*count(*) filter (lfp_raw < 0)/count(*) pct_censored,
 100.0*count(*) filter (row_ord % 13 = 0)/count(*) pct_lost, subject % 4 <> 3 loss_known, case when subject % 3 <> 0 then (subject-4)*11.0 end drift_ms, case when subject % 2 = 0 then case when subject = 4 then 10.0 else 1.0 end end high_pass_hz,
 subject % 3 state_confidence from v join en using (subject, hemisphere) group by subject, hemisphere)"""
RECORDINGS_SQL = f"{RAW_TIMELINE_SQL}, {MEASURED_SQL}"


def _rule(check: str, column: str, level: str, able: str = "true", why: str = "null", measure: str | None = None) -> str:
    return f"""select subject, hemisphere, '{check}' as "check", case when {column} is null or not ({able}) then 'not_checked' else {level} end status,
 case when {column} is not null and {able} then {measure or column} end measure, case when {column} is null then 'missing: {column}' when not ({able}) then {why} end reason from"""


ALARMS_SQL = f"""{RECORDINGS_SQL}, al as ({_rule('clipping', 'n_valid', "case when n_extreme/n_valid >= 0.005 then 'critical' else 'passed' end", 'n_valid >= 100', "'under 100 samples'", 'n_extreme/n_valid')} rc
union all {_rule('amplitude', 'sd', "case when sd < 0.2 or sd > 60 then 'warning' else 'passed' end", 'n_valid >= 100', "'under 100 samples'")} rc
union all {_rule('packet_loss', 'pct_lost', "case when pct_lost >= 20 then 'critical' when pct_lost >= 5 then 'warning' else 'passed' end", 'loss_known', "'no sequence numbers or ticks'")} rc
union all {_rule('clock_drift', 'drift_ms', "case when abs(drift_ms) > 20 then 'warning' else 'passed' end")} rc
union all {_rule('high_pass', 'high_pass_hz', "case when high_pass_hz >= 10 then 'critical' else 'passed' end")} rc
union all {_rule('device_censoring', 'pct_censored', "case when pct_censored >= 20 then 'critical' when pct_censored >= 3 then 'warning' else 'passed' end")} rc)"""

PEAKS_SQL = """ex as (select vec_id, label, unnest(range(12, 35)) a, embedding from embeddings),
pk as (select vec_id, label, max(abs(embedding[a+1])::double) m, arg_min(a, (-abs(embedding[a+1]), a)) a from ex group by all),
pr as (select vec_id % 8 subject, case when vec_id % 2 = 0 then 'Left' else 'Right' end hemisphere, label || '-' || (vec_id % 25) channel, a + 1.0 f, m, case when vec_id % 3 > 0 then vec_id % 5 > 1 end flag from pk),
rp as (select subject, hemisphere, channel, count(*) n, quantile_cont(f, 0.5) median_f, max(f)-min(f) max_deviation, case when count(m) > 1 and avg(m) > 0 then stddev_samp(m)/avg(m) end magnitude_cv,
 case when count(flag) > 1 then bool_and(flag) = bool_or(flag) end flags_agree, case when count(*) < 2 then 'not_enough' when max(f)-min(f) <= 1 then 'stable' else 'unstable' end verdict from pr group by all)"""

ORACLE = {
    "alarm_findings": f"with {ALARMS_SQL} select * replace (round(measure::double,6) as measure) from al",
    "alarm_levels": f"""with {ALARMS_SQL} select subject, hemisphere, case when count(*) filter (status='critical') > 0 then 'critical' when count(*) filter (status='warning') > 0 then 'warning' else 'clean' end as level,
count(*) filter (status='critical') n_critical, count(*) filter (status='warning') n_warning, count(*) filter (status='passed') n_passed, count(*) filter (status='not_checked') n_not_checked,
arg_min("check", (status, "check")) filter (status in ('critical', 'warning')) worst, round(100.0*count(*) filter (status<>'not_checked')/count(*),6) pct_verified from al group by subject, hemisphere""",
    "peak_reproducibility": f"with {PEAKS_SQL} select * replace (round(median_f,6) as median_f, round(max_deviation,6)::double as max_deviation, round(magnitude_cv,6) as magnitude_cv) from rp",
    "quality_panel": f"""with {RECORDINGS_SQL}, {PEAKS_SQL}, nc as (select subject, hemisphere, count(*) n_channels, count(*) filter (verdict='unstable') n_unstable from rp where verdict <> 'not_enough' group by all),
pi as (select rc.*, n_channels, n_unstable from rc left join nc on rc.subject=nc.subject and rc.hemisphere=nc.hemisphere),
al as ({_rule('packets', 'pct_lost', "case when pct_lost > 20 then 'critical' when pct_lost > 0 then 'warning' else 'passed' end", 'loss_known', "'no sequence numbers or ticks'")} pi
union all {_rule('rate', 'drift_ms', "case when abs(drift_ms) > 20 then 'warning' else 'passed' end")} pi
union all {_rule('device_state', 'state_confidence', "case when state_confidence < 1 then 'critical' when state_confidence < 2 then 'warning' else 'passed' end")} pi
union all {_rule('reproducibility', 'n_channels', "case when n_unstable = n_channels then 'critical' when n_unstable > 0 then 'warning' else 'passed' end", 'n_channels > 0', "'one record a channel'", 'n_unstable').replace("'missing: n_channels'", "'missing: n_channels, n_unstable'")} pi)
select * replace (round(measure::double,6) as measure) from al""",
    # P(F >= f) with two degrees above is (1 + 2 f / d) ^ (-d / 2)
    "eligibility": f"""with {CLEAN_SQL}, {MEASURED_SQL}, {PEAKS_SQL}, nc as (select subject, hemisphere, count(*) n_channels, count(*) filter (verdict='unstable') n_unstable from rp where verdict <> 'not_enough' group by all),
xs as (select subject, hemisphere, t, row_ord, cos({HOUR}*2*pi()/24) c, sin({HOUR}*2*pi()/24) s, lfp y from cl where lfp is not null),
mo as (select subject, hemisphere, count(*)::double n, sum(c) sc, sum(s) ss, sum(c*c) cc, sum(s*s) s2, sum(c*s) cs, sum(y) sy, sum(c*y) cy, sum(s*y) s_y from xs group by all),
de as (select *, n*(cc*s2-cs*cs)-sc*(sc*s2-cs*ss)+ss*(sc*cs-cc*ss) dd from mo),
so as (select *, (sy*(cc*s2-cs*cs)-sc*(cy*s2-cs*s_y)+ss*(cy*cs-cc*s_y))/dd m, (n*(cy*s2-cs*s_y)-sy*(sc*s2-cs*ss)+ss*(sc*s_y-cy*ss))/dd b, (n*(cc*s_y-cy*cs)-sc*(sc*s_y-cy*ss)+sy*(sc*cs-cc*ss))/dd g from de where n > 5),
re as (select xs.*, y - (m + b*c + g*s) r from xs join so using (subject, hemisphere)), rl as (select *, r*lag(r) over (partition by subject, hemisphere order by t, row_ord) rr from re),
fi as (select subject, hemisphere, count(*)::double n, sum(r*r) sse, sum(rr) num, var_pop(y)*count(*) sst from rl group by all), fo as (select *, (sst-sse)/2/(sse/(n-3)) f, num/sse rho from fi), fe as (select *, n*(1-rho)/(1+rho) ne from fo),
fp as (select subject, hemisphere, f*greatest(0.02, ne/n) fa, greatest(2.0, floor(ne+0.5)-3) d2 from fe), pv as (select subject, hemisphere, case when fa <= 0 then 1 else power(1 + 2*fa/d2, -d2/2) end p from fp),
dy as (select subject, hemisphere, count(distinct t::date) n_days, count(*) n_points from tl group by all),
al as (select rc.subject, rc.hemisphere, case when rc.subject <> 6 then rc.subject <> 5 end hp, rc.pct_lost, loss_known, n_channels, n_unstable, n_days, n_points, sqrt(b*b+g*g)/nullif(m, 0) sh, p
 from rc left join nc on rc.subject=nc.subject and rc.hemisphere=nc.hemisphere left join dy on rc.subject=dy.subject and rc.hemisphere=dy.hemisphere left join so on rc.subject=so.subject and rc.hemisphere=so.hemisphere left join pv on rc.subject=pv.subject and rc.hemisphere=pv.hemisphere),
st as (select subject, hemisphere, unnest([{{'c': 'peak', 's': case when hp is null then 'n' when not hp then 'k' else 'p' end}}, {{'c': 'artifact', 's': case when subject = 7 or pct_lost is null then 'n' when loss_known and pct_lost > 10 then 'k' else 'p' end}},
 {{'c': 'reproducibility', 's': case when n_channels is null or n_channels = 0 then 'n' when n_unstable = n_channels then 'k' when n_unstable > 0 then 'w' else 'p' end}}, {{'c': 'parameters', 's': case when subject = 3 then 'n' when subject = 2 then 'w' else 'p' end}},
 {{'c': 'chronic_days', 's': case when n_days is null then 'n' when n_days < 3 then 'k' when n_days < 5 then 'w' else 'p' end}}, {{'c': 'rhythm', 's': case when n_points is null or n_points < 24 then 'n' when not coalesce(p < 0.05 and sh > 0.05, false) then 'w' else 'p' end}}]) u from al),
g as (select subject, hemisphere, coalesce(string_agg(u.c, ',' order by u.c) filter (u.s = 'k'), '') blockers, coalesce(string_agg(u.c, ',' order by u.c) filter (u.s = 'n'), '') missing, coalesce(string_agg(u.c, ',' order by u.c) filter (u.s = 'w'), '') reserves from st group by all)
select *, case when blockers <> '' then 'not_eligible' when missing <> '' then 'insufficient' when reserves <> '' then 'with_reserve' else 'eligible' end verdict from g""",
}

QUERIES = {"alarm_findings": alarms, "alarm_levels": alarm_levels, "peak_reproducibility": reproducibility, "quality_panel": panel, "eligibility": eligible}
