"""Queries of the controllers over the test tables, with SQL that follows them sample by sample."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.operators import chronic, controller
from tidewell.operators.states import detect_states, state_episodes, two_levels
from tidewell.sources.adapters import TIMELINE_SQL, timeline

from .chronic import LIMITS_SQL, limits, rounded

#: A ramp in mA a second that binds between samples about an hour apart.
RATE = 0.00015


def merged(spark: SparkSession, d: str) -> DataFrame:
    return chronic.merge_series(timeline(spark, d).where("lfp is not null"))


def simulated(spark: SparkSession, d: str) -> DataFrame:
    x = timeline(spark, d)
    out = controller.simulate_controller(x, limits(x).withColumn("cell", F.lit(0)))
    return rounded(out.drop("cell", "lower", "upper"))


def tuned(spark: SparkSession, d: str) -> DataFrame:
    x = timeline(spark, d)
    return rounded(controller.tune_limits(x, limits(x)))


def ramp(spark: SparkSession, d: str) -> DataFrame:
    x = merged(spark, d)
    return rounded(controller.simulate_ramp(x, limits(x).withColumn("cell", F.lit(0)), window_ms=7_200_000, rate=RATE).drop("cell"))


def sweep(spark: SparkSession, d: str) -> DataFrame:
    x = merged(spark, d)
    return rounded(controller.limit_sweep(x, controller.limit_grid(x, n=6), window_ms=7_200_000, rate=RATE))


#: Seconds under which a state is merged with the one before it.
LEAST_S = 7200.0


def states(spark: SparkSession, d: str) -> DataFrame:
    return rounded(detect_states(timeline(spark, d), least_s=LEAST_S))


def episodes(spark: SparkSession, d: str) -> DataFrame:
    x = timeline(spark, d)
    found = state_episodes(x, two_levels(x), least_s=LEAST_S)
    return rounded(found.select("subject", "hemisphere", "run", "state", "from_s", "to_s", "n", (F.col("total") / F.col("n")).alias("mean_lfp")))


SHARES = """100.0*count(*) filter (lfp<lower)/count(*) pct_below, 100.0*count(*) filter (lfp>=lower and lfp<=upper)/count(*) pct_within, 100.0*count(*) filter (lfp>upper)/count(*) pct_above,
100.0*count(*) filter (a=0)/count(*) pct_sat_low, 100.0*count(*) filter (a=30)/count(*) pct_sat_high, 100.0*count(*) filter (a in (0,30))/count(*) pct_saturated"""

# levels in tenths of a mA, of 0 to 3 mA from 1.5; `cells` gives each series' pairs of limits
STEPS_SQL = """o as (select subject, hemisphere, lfp, row_number() over (partition by subject, hemisphere order by t, row_ord) k from tl where lfp is not null),
f as (select subject, hemisphere, cell, lower, upper, 0::bigint k, 15 as a, null::double as lfp from cells union all
 select f.subject, f.hemisphere, cell, lower, upper, o.k, least(30, greatest(0, a + case when o.lfp > upper then 1 when o.lfp < lower then -1 else 0 end)), o.lfp
 from f join o on f.subject = o.subject and f.hemisphere = o.hemisphere and o.k = f.k + 1)"""

RAMP_SQL = """dd as (select subject, hemisphere, t, arg_min(lfp, row_ord) lfp from tl where lfp is not null group by all),
mm as (select *, avg(lfp) over (partition by subject, hemisphere order by epoch_ms(t) range between 7200000 preceding and current row) m, epoch_ms(t)/1000.0::double s,
 row_number() over (partition by subject, hemisphere order by t) k from dd),
f as (select mm.subject, mm.hemisphere, cell, lower, upper, k, s, 1.0 + 2.0*least(1, greatest(0, (m-lower)/(upper-lower))) c from mm join cells using (subject, hemisphere) where k = 1 union all
 select f.subject, f.hemisphere, cell, lower, upper, mm.k, mm.s, f.c + least(0.00015*(mm.s-f.s), greatest(-0.00015*(mm.s-f.s), 1.0 + 2.0*least(1, greatest(0, (m-lower)/(upper-lower))) - f.c))
 from f join mm on f.subject = mm.subject and f.hemisphere = mm.hemisphere and mm.k = f.k + 1),
st as (select *, case when c >= 3-1e-9 then 'high' when c <= 1+1e-9 then 'low' else 'middle' end z from f),
ch as (select *, coalesce(z <> lag(z) over w, false)::int ch, coalesce(z <> lag(z) over w, true)::int beg from st window w as (partition by subject, hemisphere, cell order by k))"""

# centres of two levels, then runs of states with four rounds of merging: after one only the first run can be short, and another may merge it
LEVELS_SQL = """xs as (select subject, hemisphere, lfp v from tl where lfp is not null),
q as (select subject, hemisphere, count(*) n, quantile_cont(v, 0.25) lo, quantile_cont(v, 0.75) hi from xs group by all having count(*) >= 8),
km as (select subject, hemisphere, n, 0 as i, lo, hi, true as moves from q where hi > lo union all
 select subject, hemisphere, n, i + 1, l2, h2, abs(l2-lo) >= 1e-9 or abs(h2-hi) >= 1e-9 from (select subject, hemisphere, n, i, lo, hi,
 coalesce(avg(v) filter (abs(v-lo) <= abs(v-hi)), lo) l2, coalesce(avg(v) filter (abs(v-lo) > abs(v-hi)), hi) h2 from km join xs using (subject, hemisphere) where moves and i < 60 group by subject, hemisphere, n, i, lo, hi)),
lv as (select subject, hemisphere, n, arg_max(lo, i) low, arg_max(hi, i) high from km group by all)"""


def _merged_sql(rounds: int) -> str:
    """Runs r0 and their merging round by round, the last one by the name of ep."""
    out = """s0 as (select subject, hemisphere, epoch_us(t)/1e6 s, t, row_ord, lfp, lfp > (low+high)/2 z from tl join lv using (subject, hemisphere) where lfp is not null),
c0 as (select *, coalesce(z <> lag(z) over w, true)::int ch from s0 window w as (partition by subject, hemisphere order by t, row_ord)),
g0 as (select *, sum(ch) over (partition by subject, hemisphere order by t, row_ord) run from c0),
r0 as (select subject, hemisphere, run, bool_or(z) z, min(s) a, max(s) b, count(*) n, sum(lfp) total from g0 group by all)"""
    for i in range(rounds):
        out += f""",
f{i} as (select *, coalesce(last_value(case when b - a >= {LEAST_S} then z end ignore nulls) over (partition by subject, hemisphere order by run rows between unbounded preceding and current row),
 max(case when run = 2 then z::int end) over (partition by subject, hemisphere)::bool, z) y from r{i}),
h{i} as (select *, coalesce(y <> lag(y) over (partition by subject, hemisphere order by run), true)::int ch from f{i}),
k{i} as (select *, sum(ch) over (partition by subject, hemisphere order by run) run2 from h{i}),
r{i + 1} as (select subject, hemisphere, run2 run, bool_or(y) z, min(a) a, max(b) b, sum(n) n, sum(total) total from k{i} group by all)"""
    return out + f",\nep as (select * from r{rounds})"


ORACLE = {
    "states": f"""with recursive {TIMELINE_SQL}, {LEVELS_SQL}, {_merged_sql(4)},
sd as (select subject, hemisphere, count(*) filter (not z) na, count(*) filter (z) nb, coalesce(var_samp(lfp) filter (not z), 0) va, coalesce(var_samp(lfp) filter (z), 0) vb from s0 group by all),
co as (select subject, hemisphere, sum(n) filter (z)/sum(n)::double off, count(*) filter (z) n_off, count(*) filter (not z) n_on, avg(b-a) filter (z and b > a) mo, avg(b-a) filter (not z and b > a) mn from ep group by all)
select subject, hemisphere, n, round(low,6) low, round(high,6) high, round((low+high)/2,6) threshold, round((high-low)/sqrt((greatest(1,na-1)*va+greatest(1,nb-1)*vb)/greatest(1,na+nb-2)),6) separation,
round(coalesce(off,0),6) off_fraction, n_off, n_on, round(mo,6) mean_off_s, round(mn,6) mean_on_s from lv join sd using (subject, hemisphere) join co using (subject, hemisphere)""",
    "state_episodes": f"""with recursive {TIMELINE_SQL}, {LEVELS_SQL}, {_merged_sql(4)}
select subject, hemisphere, run::bigint run, case when z then 'high' else 'low' end as state, round(a,6) from_s, round(b,6) to_s, n::bigint n, round(total/n,6) mean_lfp from ep""",
    "controller": f"""with recursive {LIMITS_SQL}, cells as (select *, 0 as cell from limits), {STEPS_SQL}, m as (select subject, hemisphere, count(*) n, {SHARES}, avg(a)/10 mean_current from f where k > 0 group by all)
select subject, hemisphere, n, round(pct_below,6) pct_below, round(pct_within,6) pct_within, round(pct_above,6) pct_above, round(pct_sat_low,6) pct_sat_low, round(pct_sat_high,6) pct_sat_high,
round(pct_saturated,6) pct_saturated, round(mean_current,6) mean_current, pct_below between 10 and 35 and pct_within between 45 and 75 and pct_above between 10 and 35 as accepted from m""",
    "tuned_limits": f"""with recursive {LIMITS_SQL}, g as (select i - 15 as x from range(31) r(i)),
grid as (select subject, hemisphere, floor(lower*(100+a.x)/100+0.5) lower, floor(upper*(100+b.x)/100+0.5) upper, min(1+(a.x+15)*31+b.x+15)::int cell from limits, g a, g b group by subject, hemisphere, floor(lower*(100+a.x)/100+0.5), floor(upper*(100+b.x)/100+0.5)),
cells as (select subject, hemisphere, 0 as cell, lower, upper from limits union all select subject, hemisphere, cell, lower, upper from grid where upper > lower), {STEPS_SQL},
m as (select subject, hemisphere, cell, lower, upper, {SHARES} from f where k > 0 group by all),
c as (select *, round(abs(pct_below-20)+abs(pct_within-60)+abs(pct_above-20)+0.5*pct_saturated, 9) cost from m),
b as (select *, max(cost) filter (cell = 0) over (partition by subject, hemisphere) base_cost from c qualify row_number() over (partition by subject, hemisphere order by cost, cell) = 1)
select subject, hemisphere, round(lower,6) lower, round(upper,6) upper, round(cost,6) as cost, round(base_cost,6) base_cost, cost < base_cost improved,
round(pct_below,6) pct_below, round(pct_within,6) pct_within, round(pct_above,6) pct_above, round(pct_saturated,6) pct_saturated from b""",
    "ramp_controller": f"""with recursive {LIMITS_SQL}, cells as (select *, 0 as cell from limits), {RAMP_SQL},
ep as (select *, sum(beg) over (partition by subject, hemisphere order by k) e from ch), es as (select subject, hemisphere, e, min(z) z, min(s) a, max(s) b from ep group by all),
ed as (select *, (coalesce(lead(a) over (partition by subject, hemisphere order by e), b) - a)/60 m from es),
md as (select subject, hemisphere, quantile_cont(m, 0.5) filter (z='low') lo, quantile_cont(m, 0.5) filter (z='high') hi from ed where m > 0 group by all)
select subject, hemisphere, round(lower,6) lower, round(upper,6) upper, count(*) n, round(100.0*count(*) filter (z='low')/count(*),6) pct_low, round(100.0*count(*) filter (z='middle')/count(*),6) pct_mid,
round(100.0*count(*) filter (z='high')/count(*),6) pct_high, sum(ch)::bigint transitions, round(sum(ch)/((max(s)-min(s))/3600),6) transitions_per_hour, round(any_value(lo),6) median_low_min, round(any_value(hi),6) median_high_min,
round((count(*) filter (z='high')+0.5*count(*) filter (z='middle'))/count(*),6) duty_cycle, round(avg(c),6) mean_current, round(avg(c*c)/9,6) energy from ch left join md using (subject, hemisphere)
group by subject, hemisphere, lower, upper having count(*) >= 8""",
    "limit_sweep": f"""with recursive {TIMELINE_SQL}, pq as (select subject, hemisphere, quantile_cont(lfp, 0.05) p, quantile_cont(lfp, 0.95) q from (select subject, hemisphere, t, arg_min(lfp, row_ord) lfp from tl where lfp is not null group by all) group by all),
cells as (select subject, hemisphere, (i*6+j)::int cell, p+(q-p)*i/5 lower, p+(q-p)*j/5 upper from pq, range(6) a(i), range(6) b(j) where p+(q-p)*j/5 > p+(q-p)*i/5), {RAMP_SQL}
select subject, hemisphere, cell, round(lower,6) lower, round(upper,6) upper, count(*) n, round(100.0*count(*) filter (z='high')/count(*),6) pct_high, round(sum(ch)/((max(s)-min(s))/3600),6) transitions_per_hour,
round((count(*) filter (z='high')+0.5*count(*) filter (z='middle'))/count(*),6) duty_cycle, round(avg(c*c)/9,6) energy from ch group by subject, hemisphere, cell, lower, upper having count(*) >= 8""",
}

QUERIES = {"controller": simulated, "tuned_limits": tuned, "ramp_controller": ramp, "limit_sweep": sweep, "states": states, "state_episodes": episodes}
