"""Queries of streams, clocks, device states, grids and epochs over the test tables, with their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.operators import clock, device, diary, movement, packets, rhythm, signal
from tidewell.sources.adapters import EVENT_KEYS_SQL, RAW_TIMELINE_SQL, TIMELINE_SQL, marks, marks_sql, read, sessions, signals, timeline

from .chronic import HOUR, rounded

K = ["subject", "hemisphere"]


def stream(spark: SparkSession, d: str) -> DataFrame:
    """(rec, ord, ticks, seq, size, model, stream): each event as a packet of its user's stream."""
    e = read(spark, d, "events")
    return e.select(
        F.col("user_id").alias("rec"), F.col("event_id").alias("ord"), (F.unix_millis(F.col("ts").cast("timestamp")) % 3276800).alias("ticks"), (F.col("event_id") % 256).alias("seq"),
        (60 + F.col("event_id") % 4).alias("size"), F.get(F.array(*map(F.lit, ("B35200", "Percept RC", "other"))), (F.col("user_id") % 3).cast("int")).alias("model"),
        F.when(F.col("user_id") % 5 == 0, "BrainSenseTimeDomain").otherwise("Survey").alias("stream"),
    )


STREAM_SQL = """pk as (select user_id rec, event_id ord, (epoch_us(ts)//1000) % 3276800 ticks, event_id % 256 seq, 60 + event_id % 4 size,
 case user_id % 3 when 0 then 'B35200' when 1 then 'Percept RC' else 'other' end model, case when user_id % 5 = 0 then 'BrainSenseTimeDomain' else 'Survey' end stream from events)"""
UNWRAP_SQL = STREAM_SQL + """,
f as (select *, coalesce((ticks < lag(ticks) over w)::int, 0) fl from pk window w as (partition by rec order by ord)),
u0 as (select *, sum(fl) over (partition by rec order by ord rows unbounded preceding) k from f),
u1 as (select *, ticks + 3276800*k dc, ticks + 65536*k al from u0),
u2 as (select *, dc - lag(dc) over (partition by rec order by ord) d, al - lag(al) over (partition by rec order by ord) a from u1),
um as (select rec, quantile_cont(d, 0.5) md, quantile_cont(a, 0.5) ma, min(d) ld, min(a) la, max(k) > 0 falls from u2 group by all),
us as (select rec, avg(abs(d-md))/abs(max(case when md = 0 then 1 else md end)) sd, avg(abs(a-ma))/abs(max(case when ma = 0 then 1 else ma end)) sa, max(ld) ld, max(la) la, bool_or(falls) falls from u2 join um using (rec) group by all),
uw as (select rec, case when not falls then null when ld > 0 and not coalesce(la > 0 and sa*10 < sd, false) then 3276800 when la > 0 then 65536 end wrap from us),
un as (select u2.*, wrap, case wrap when 3276800 then dc when 65536 then al else ticks end::bigint unwrapped from u2 join uw using (rec))"""
GAPS_SQL = UNWRAP_SQL + """,
q0 as (select *, case when model = 'B35200' then 256 when model = 'Percept RC' then 65536 end cap, coalesce((seq < lag(seq) over (partition by rec order by ord))::int, 0) sf from un),
q1 as (select *, seq + coalesce(cap, 0)*sum(sf) over (partition by rec order by ord rows unbounded preceding) sq from q0),
q2 as (select *, case when cap is not null and stream <> 'BrainSenseTimeDomain' then 'sequences' else 'ticks' end as "method", unwrapped - lag(unwrapped) over w dt, sq - lag(sq) over w ds, lag(size) over w bf,
 coalesce(sum(size) over (partition by rec order by ord rows between unbounded preceding and 1 preceding), 0)::bigint start_idx from q1 window w as (partition by rec order by ord)),
ms as (select rec, arg_min(size, (-n, size)) msz from (select rec, size, count(*) n from q2 group by all) group by rec),
mt as (select rec, arg_min(st, (-n, st)) mst from (select rec, floor(dt+0.5) st, count(*) n from q2 where dt is not null group by all) group by rec),
q3 as (select q2.*, msz, case when "method" = 'sequences' then ds - 1 when dt > 1000*(1+bf)/250.0::double then greatest(1, floor(dt/(case when mst > 0 then mst else 1000*bf/250.0::double end)+0.5)-1) else 0 end np from q2 join ms using (rec) left join mt using (rec)),
gp as (select rec, ord, "method", start_idx, np::bigint n_packets, (np*msz)::bigint n_samples from q3 where np >= 1)"""


def unwrapped_ticks(spark: SparkSession, d: str) -> DataFrame:
    return packets.unwrap_ticks(stream(spark, d), ["rec"]).select("rec", "ord", "wrap", F.col("unwrapped").cast("long").alias("unwrapped"))


def lost_packets(spark: SparkSession, d: str) -> DataFrame:
    return packets.packet_gaps(stream(spark, d), ["rec"])


def packet_loss(spark: SparkSession, d: str) -> DataFrame:
    return rounded(packets.packet_loss(stream(spark, d), ["rec"]))


def effective_rate(spark: SparkSession, d: str) -> DataFrame:
    return rounded(packets.effective_rate(stream(spark, d), ["rec"]), 4)


def gaps_inserted(spark: SparkSession, d: str) -> DataFrame:
    x = signals(spark, d).select("rec", F.posexplode("x").alias("i", "v"))
    g = signals(spark, d).select("rec", (F.col("rec") % 60 + 1).alias("start_idx"), (F.col("rec") % 4).alias("n_samples"))
    return rounded(packets.insert_gaps(x, g, ["rec"]))


def stitched(spark: SparkSession, d: str) -> DataFrame:
    e = read(spark, d, "events")
    x = e.select(F.col("user_id").alias("subject"), F.unix_millis(F.col("ts").cast("timestamp")).alias("t0_ms"), F.col("event_id").alias("ord"), (F.floor("value") % 500 + 1).alias("n"), F.lit(250.0).alias("fs"))
    return packets.stitch_streams(x, ["subject"], 86_400.0)


def offset_candidates(spark: SparkSession, d: str) -> DataFrame:
    return clock.offset_candidates(timeline(spark, d))


def offset_breaks(spark: SparkSession, d: str) -> DataFrame:
    return clock.offset_breaks(clock.offset_candidates(timeline(spark, d)))


def _resolved(spark: SparkSession, d: str) -> DataFrame:
    breaks = marks(spark, d, "signup").withColumn("delta_minutes", (F.col("row_ord") % 3 - 1) * 60)
    return clock.resolve_offsets(timeline(spark, d), breaks)


def resolved_offsets(spark: SparkSession, d: str) -> DataFrame:
    return _resolved(spark, d).select(*K, "row_ord", "offset_min")


def offset_segments(spark: SparkSession, d: str) -> DataFrame:
    return rounded(clock.offset_segments(_resolved(spark, d)))


def resampled(spark: SparkSession, d: str) -> DataFrame:
    return rounded(clock.resample(timeline(spark, d), 3600.0, 6 * 3600.0))


def _states(spark: SparkSession, d: str) -> DataFrame:
    names = ("SenseChannelTests", "CalibrationTests", "BrainSenseLfp", "LFPMontage", "IndefiniteStreaming", "Timeline", "Other", "MostRecentInSessionSignalCheck")
    e = marks(spark, d, "purchase")
    amount = read(spark, d, "events").select(F.col("event_id").alias("row_ord"), "value")
    r = e.join(amount, "row_ord").select(
        *K, "t", "row_ord", F.get(F.array(*map(F.lit, names)), (F.col("row_ord") % 8).cast("int")).alias("modality"),
        F.when(F.col("row_ord") % 5 == 0, F.col("value") / 100).alias("max_ma"), F.when(F.col("row_ord") % 3 == 0, (F.col("row_ord") % 2) * 1.5).alias("group_ma"),
    )
    s = marks(spark, d, "signup").withColumn("detail", F.get(F.array(F.lit("TherapyStatusDef.ON"), F.lit("TherapyStatusDef.OFF"), F.lit("changed")), (F.col("row_ord") % 3).cast("int")))
    return device.device_state(device.last_status(r, s, K))


def device_states(spark: SparkSession, d: str) -> DataFrame:
    return rounded(_states(spark, d).select(*K, "row_ord", "status", "ma", "state", "evidence"))


def comparable_states(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.sql import Window

    w = Window.partitionBy(*K).orderBy("t", "row_ord")
    x = _states(spark, d).withColumn("before", F.lag("state").over(w)).where("before is not null")
    return x.select(*K, "row_ord", device.states_comparable(F.col("before"), F.col("state")).alias("comparable"))


CHANNELS = ("ZERO_TWO_LEFT", "ONE_AND_THREE_RIGHT", "ONE_C_AND_TWO_C_LEFT", "ZERO_A_AND_TWO_LEFT_RING", "SensingChannelDef.ZERO_AND_THREE_LEFT")
MODELS = ("LeadModelDef.B33005", "Model 3389", "SenSight B33015", "unknown", "B3300542M")


def lead_names(spark: SparkSession, d: str) -> DataFrame:
    pick = lambda names: F.get(F.array(*map(F.lit, names)), (F.col("p_partkey") % len(names)).cast("int"))
    x = read(spark, d, "part").select(F.col("p_partkey").alias("part"), pick(CHANNELS).alias("c"), pick(MODELS).alias("m"))
    return x.select("part", device.channel_label(F.col("c")).alias("label"), device.lead_model(F.col("m")).alias("model"), device.short_threshold(F.col("m")).alias("short_ohm"), device.electrode_name(F.concat(F.lit("ElectrodeDef.SenSight_"), "c")).alias("electrode"))


def channel_contacts(spark: SparkSession, d: str) -> DataFrame:
    x = read(spark, d, "part").select(F.col("p_partkey").alias("part"), F.get(F.array(*map(F.lit, CHANNELS)), (F.col("p_partkey") % len(CHANNELS)).cast("int")).alias("c"))
    return x.select("part", F.array_join(device.channel_contacts(F.col("c")), "-").alias("contacts"))


def collected_thresholds(spark: SparkSession, d: str) -> DataFrame:
    v = read(spark, d, "events").select(F.col("event_id").alias("row_ord"), F.col("value").alias("lower"), (F.col("value") * 2).alias("upper"))
    own = lambda kind: marks(spark, d, kind).join(v, "row_ord").where(F.col("subject") % 2 == (0 if kind == "signup" else F.col("subject") % 2))
    return rounded(device.collect_thresholds(own("signup"), own("purchase"), K))


def usage_battery(spark: SparkSession, d: str) -> DataFrame:
    s = sessions(spark, d).select("subject", "t", "row_ord", (100 - F.col("centre") % 90).alias("battery"), (F.col("row_ord") % 1000).alias("hours"))
    return rounded(device.usage(s, ["subject"]))


def circadian_profile(spark: SparkSession, d: str) -> DataFrame:
    return rounded(diary.clock_profile(_cells(spark, d), ["subject"]))


def _cells(spark: SparkSession, d: str) -> DataFrame:
    e = read(spark, d, "events").select((F.col("user_id") % 8).alias("subject"), F.to_date("ts").alias("day"), F.hour("ts").alias("bin"), "event_type", "event_id")
    return e.groupBy("subject", "day", "bin").agg(F.min_by("event_type", "event_id").alias("state"))


def peak_of_state(spark: SparkSession, d: str) -> DataFrame:
    c = _cells(spark, d)
    return rounded(diary.peak_bin(diary.clock_profile(c, ["subject"]), c, ["subject"], "error"))


def compared_conditions(spark: SparkSession, d: str) -> DataFrame:
    c = _cells(spark, d).groupBy("subject", "day").agg(F.count_if(F.col("state") == "error").cast("double").alias("value"))
    return rounded(diary.compare_conditions(c.withColumn("condition", F.floor(F.dayofmonth("day") / 7).cast("int")), ["subject"]))


def timeline_grid(spark: SparkSession, d: str) -> DataFrame:
    return rounded(diary.grid_summary(diary.signal_grid(timeline(spark, d))))


def dose_cycle(spark: SparkSession, d: str) -> DataFrame:
    return rounded(diary.dose_cycle(timeline(spark, d), marks(spark, d, "purchase")))


def suggested_limits(spark: SparkSession, d: str) -> DataFrame:
    return rounded(diary.suggested_limits(timeline(spark, d)))


def session_reliability(spark: SparkSession, d: str) -> DataFrame:
    s = sessions(spark, d).select((F.col("subject") % 3).alias("site"), "subject", "t", "row_ord", "centre")
    return rounded(diary.session_reliability(s, ["site"], "subject", "centre", ["t", "row_ord"]))


def cosinor_test(spark: SparkSession, d: str) -> DataFrame:
    return rounded(rhythm.cosinor_test(timeline(spark, d)), 5)


def phase_drift(spark: SparkSession, d: str) -> DataFrame:
    return rounded(rhythm.drift_of_phase(rhythm.actogram(timeline(spark, d))))


def rest_activity_panel(spark: SparkSession, d: str) -> DataFrame:
    return rounded(rhythm.panel(timeline(spark, d), least_cover=0.3).select(*K, "stability", "variability", "m10", "l5", "relative_amplitude"))


def zscores(spark: SparkSession, d: str) -> DataFrame:
    s = read(spark, d, "embeddings").select(F.col("vec_id").alias("rec"), F.col("label").alias("session"))
    x = signals(spark, d).select("rec", F.posexplode("x").alias("i", "v")).join(s, "rec")
    by_record, by_session = movement.zscore_epochs(x, ["rec"]).withColumnRenamed("z", "zr"), ["session"]
    z = movement.zscore_epochs(by_record, by_session)
    return rounded(z.groupBy("rec").agg(F.var_samp("zr").alias("var_record"), F.avg("z").alias("mean_session"), F.var_samp("z").alias("var_session"), F.max("z").alias("most")))


def _lines(spark: SparkSession, d: str) -> DataFrame:
    return signal.dft_power(signals(spark, d)).where("k > 0").select("rec", F.col("k").cast("double").alias("f"), F.col("power").alias("p"))


def _pairs(spark: SparkSession, d: str) -> DataFrame:
    x = _lines(spark, d)
    rest = x.where("rec % 2 = 0").select((F.col("rec") / 2).cast("long").alias("unit"), "f", F.col("p").alias("a"))
    move = x.where("rec % 2 = 1").select(((F.col("rec") - 1) / 2).cast("long").alias("unit"), "f", F.col("p").alias("b"))
    return rest.join(move, ["unit", "f"])


LINES_SQL = """sx as (select vec_id rec, generate_subscripts(embedding, 1)-1 i, unnest(embedding)::double v, len(embedding) n from embeddings), sk as (select unnest(generate_series(1, 32)) k),
ln as (select rec, k::double f, (power(sum(v*cos(k*i*2*pi()/n)),2)+power(sum(v*sin(k*i*2*pi()/n)),2))/max(n) p from sx, sk group by all)"""
PAIRS_SQL = LINES_SQL + """,
pr as (select r.rec//2 unit, r.f, r.p a, m.p b from ln r join ln m on m.rec = r.rec+1 and m.f = r.f where r.rec % 2 = 0)"""


def movement_change(spark: SparkSession, d: str) -> DataFrame:
    x = _pairs(spark, d).withColumnsRenamed({"a": "rest", "b": "move"})
    return rounded(movement.movement_change(x, ["unit"], {"beta": (13.0, 30.0), "theta": (4.0, 8.0)}, (2.0, 32.0)))


def sign_flip(spark: SparkSession, d: str) -> DataFrame:
    x = read(spark, d, "supplier").select(F.col("s_nationkey").alias("nation"), F.col("s_acctbal").alias("d"))
    return rounded(movement.sign_flip_test(x, ["nation"]))


def band_ratios(spark: SparkSession, d: str) -> DataFrame:
    x = timeline(spark, d).where("lfp is not null").groupBy(*K, F.unix_micros(F.date_trunc("hour", "t")).alias("window")).agg(F.avg("lfp").alias("theta"), (F.max("lfp") + 1).alias("gamma"), (F.min("lfp") + 1).alias("lowbeta"))
    return rounded(movement.band_ratio(x, K).select(*K, "window", "odr_log", "odr_literal"), 5)


def pairable_records(spark: SparkSession, d: str) -> DataFrame:
    x = timeline(spark, d).groupBy(*K).agg(F.to_date(F.min("t")).alias("t0"), F.count("*").alias("n"))
    return movement.pairable(x.select(*K, "t0", (250 + (F.col("n") % 2) * 0.02).alias("fs"), "n", (F.col("n") % 3).alias("tick_base")), ["subject"])


def spectral_peaks(spark: SparkSession, d: str) -> DataFrame:
    x = _lines(spark, d).groupBy("rec").agg(F.sort_array(F.collect_list(F.struct("f", "p"))).alias("a"))
    return rounded(movement.find_peaks(x.select("rec", F.col("a.f").alias("f"), F.col("a.p").alias("p")), ["rec"]))


def band_table(spark: SparkSession, d: str) -> DataFrame:
    return rounded(movement.band_table(_lines(spark, d), ["rec"]))


def burst_histogram(spark: SparkSession, d: str) -> DataFrame:
    return rounded(movement.burst_histogram(read(spark, d, "lineitem").select(F.col("l_returnflag").alias("flag"), (F.col("l_quantity") * 20).alias("ms")), ["flag"]))


def modulation(spark: SparkSession, d: str) -> DataFrame:
    import math

    e = read(spark, d, "events")
    phase = (F.hour("ts") * 60 + F.minute("ts")) / 1440 * (2 * math.pi) - math.pi
    return rounded(movement.modulation_index(e.select(F.col("event_type").alias("kind"), phase.alias("phase"), F.col("value").alias("amp")), ["kind"]))


def removal_checks(spark: SparkSession, d: str) -> DataFrame:
    x = _pairs(spark, d).withColumnsRenamed({"a": "raw", "b": "clean"})
    return rounded(movement.removal_checks(x, ["unit"], 20.0, 13.0, 30.0), 5)


def missing_samples(spark: SparkSession, d: str) -> DataFrame:
    x = signals(spark, d).select("rec", F.transform("x", lambda v: F.when(v >= -0.5, v)).alias("x"))
    return rounded(movement.nan_stats(x, ["rec"]))


def whole_windows(spark: SparkSession, d: str) -> DataFrame:
    x = signals(spark, d).select("rec", F.transform("x", lambda v: F.when(v >= -1.5, v)).alias("x"))
    w = movement.whole_windows(x, ["rec"], 16, 8)
    return w.select("rec", F.array_join(F.transform("starts", lambda s: s.cast("string")), ",").alias("starts"), "dropped")


def quality_lights(spark: SparkSession, d: str) -> DataFrame:
    e = read(spark, d, "events")
    colour = F.when(F.col("event_type") == "error", "red").when(F.col("event_type") == "purchase", "amber").when(F.col("event_type") == "signup", "grey").otherwise("green")
    return rounded(movement.quality_light(e.select((F.col("event_id") % 97).alias("rec"), colour.alias("colour")), ["rec"]))


def dose_response(spark: SparkSession, d: str) -> DataFrame:
    x = read(spark, d, "lineitem").select(F.col("l_suppkey").alias("unit"), F.col("l_discount").alias("ma"), F.col("l_extendedprice").alias("lfp"))
    return rounded(movement.dose_response(x, ["unit"]), 3)


def window_table(spark: SparkSession, d: str) -> DataFrame:
    x = timeline(spark, d).where("lfp is not null").groupBy(*K, F.unix_micros(F.date_trunc("hour", "t")).alias("window")).agg(F.avg("lfp").alias("mean"), F.count("*").alias("n"))
    return rounded(movement.window_table(x, ["subject", "window"], ["mean", "n"]))


SEGMENTS_SQL = f"""{TIMELINE_SQL}, {marks_sql('br', 'signup')},
bo as (select subject, hemisphere, t, row_ord, 1 kind, 0 d from tl union all select subject, hemisphere, t, null, 0, (row_ord % 3 - 1)*60 from br),
ro as (select *, -180 + sum(d) over (partition by subject, hemisphere order by t, kind, row_ord nulls first rows unbounded preceding) offset_min from bo),
rs as (select subject, hemisphere, t, row_ord, offset_min::bigint offset_min from ro where kind = 1)"""
STATES_SQL = f"""{RAW_TIMELINE_SQL}, {marks_sql('rc', 'purchase')}, {marks_sql('st', 'signup')},
r0 as (select rc.*, ['SenseChannelTests','CalibrationTests','BrainSenseLfp','LFPMontage','IndefiniteStreaming','Timeline','Other','MostRecentInSessionSignalCheck'][row_ord % 8 + 1] modality,
 case when row_ord % 5 = 0 then value/100 end max_ma, case when row_ord % 3 = 0 then (row_ord % 2)*1.5::double end group_ma from rc join events on event_id = row_ord),
b0 as (select subject, hemisphere, t, row_ord, 1 kind, null s from rc union all select subject, hemisphere, t, row_ord, 0, ['ON','OFF','-'][row_ord % 3 + 1] from st),
b1 as (select *, nullif(last_value(s ignore nulls) over (partition by subject, hemisphere order by t, kind, row_ord rows unbounded preceding), '-') status from b0),
d0 as (select r0.*, status, coalesce(max_ma, group_ma) ma, case row_ord % 8 when 1 then 'ON' when 2 then 'USER' when 5 then 'ANY' when 6 then null else 'OFF' end known from r0 join b1 using (subject, hemisphere, row_ord) where kind = 1),
d1 as (select *, case when coalesce(ma > 0.05, false) then 'ON_THERAPEUTIC' else 'ON_0mA' end o from d0),
d2 as (select *, case when max_ma is not null then o end a, case when status = 'OFF' then 'OFF' when status = 'ON' then o end b, case when known = 'OFF' then 'OFF' when known in ('ON', 'USER') then o end c from d1),
ds as (select *, case when coalesce(a, b, c, 'UNKNOWN') = 'OFF' and coalesce(ma > 0.05, false) then 'ON_THERAPEUTIC' else coalesce(a, b, c, 'UNKNOWN') end state from d2)"""
CELLS_SQL = "ce as (select user_id % 8 subject, ts::date as day, hour(ts)::int bin, arg_min(event_type, event_id) state from events group by all)"
ACTOGRAM_SQL = f"""{TIMELINE_SQL}, ax as (select subject, hemisphere, t::date as day, least(floor({HOUR}*2), 47) bin, lfp from tl where lfp is not null),
am as (select subject, hemisphere, day, quantile_cont(lfp, 0.5) m from ax group by all), ac as (select subject, hemisphere, day, bin, quantile_cont(lfp, 0.5) v from ax group by all),
av as (select subject, hemisphere, day, bin, 100*v/nullif(m, 0) v from ac join am using (subject, hemisphere, day)), au as (select *, v - min(v) over (partition by subject, hemisphere, day) u, (bin+0.5)*pi()/24 a from av),
ad as (select subject, hemisphere, day, count(v) n, sum(u*cos(a)) c, sum(u*sin(a)) s, sum(u) w from au group by all),
ap as (select *, case when n >= 4 and w > 0 then (atan2(s, c)*24/(2*pi())+24) % 24 end phase from ad),
ag as (select *, ((phase - lag(phase) over (partition by subject, hemisphere order by day) + 36) % 24) - 12 drift from ap)"""
COVERED_SQL = f"""{TIMELINE_SQL}, hr as (select subject, hemisphere, t::date as day, floor({HOUR})::int as h, avg(lfp) v from tl where lfp is not null group by all),
hk as (select *, count(*) over (partition by subject, hemisphere, day) k from hr), hc as (select * from hk where k >= 24*0.3), hd as (select subject, hemisphere, count(distinct day) n_days from hc group by all having count(distinct day) >= 3),
hp as (select subject, hemisphere, h, avg(v) v, max(n_days) n_days from hc join hd using (subject, hemisphere) group by all),
hi as (select subject, hemisphere, n_days, i, k, v from hp, (select unnest(generate_series(0, 23)) i), (select unnest(generate_series(0, 9)) k) where h = (i + k) % 24),
hm as (select subject, hemisphere, max(n_days) n_days, i, avg(v) filter (k < 10) a, count(*) filter (k < 10) na, avg(v) filter (k < 5) b, count(*) filter (k < 5) nb from hi group by subject, hemisphere, i),
ml as (select subject, hemisphere, max(n_days) n_days, max(a) filter (na >= 8) m10, arg_min(i, (-a, i)) filter (na >= 8) m10_hour, min(b) filter (nb >= 4) l5, arg_min(i, (b, i)) filter (nb >= 4) l5_hour from hm group by all)"""
M10_SQL = f"with {COVERED_SQL} select subject, hemisphere, n_days, round(m10, 6) m10, m10_hour::int m10_hour, round(l5, 6) l5, l5_hour::int l5_hour, round((m10-l5)/nullif(m10+l5, 0), 6) relative_amplitude from ml"
ACTOGRAM_DAYS_SQL = f"with {ACTOGRAM_SQL} select subject, hemisphere, day, n, round(phase, 6) phase, round(drift, 6) drift from ag"

ORACLE = {
    "unwrapped_ticks": f"with {UNWRAP_SQL} select rec, ord, wrap::int wrap, unwrapped from un",
    "lost_packets": f"with {GAPS_SQL} select * from gp",
    "packet_loss": f"""with {GAPS_SQL}, g as (select rec, count(*) n_gaps, sum(n_samples)::bigint n_missing from gp group by all), r as (select rec, sum(size)::bigint n_received from pk group by all)
select rec, n_received, coalesce(n_missing, 0) n_missing, n_received + coalesce(n_missing, 0) n_expected, round(100*coalesce(n_missing, 0)/(n_received + coalesce(n_missing, 0))::double, 6) percent_missing, coalesce(n_gaps, 0) n_gaps from r left join g using (rec)""",
    "effective_rate": f"""with {UNWRAP_SQL}, m as (select rec, sum(size)::double n, arg_max(size, ord) l, arg_max(unwrapped, ord) - arg_min(unwrapped, ord) span, count(*) k from un group by all),
e as (select *, (n-l)/(span/1000.0::double) fe from m where k >= 2 and span > 0 and n > l), x as (select *, n*1000*(1/250.0::double - 1/fe) dr from e)
select rec, n::bigint n_samples, round(fe, 4) fs_eff, round((fe-250)/250*1e6, 4) ppm, round(dr, 4) drift_ms, abs(dr) > 20 warn from x""",
    "gaps_inserted": """with x as (select vec_id rec, generate_subscripts(embedding, 1)-1 i, unnest(embedding)::double v from embeddings),
b as (select rec, i pos, 1 kind, 0 n, v from x union all select vec_id, vec_id % 60 + 1, 0, vec_id % 4, null from embeddings),
a as (select *, pos + coalesce(sum(n) over (partition by rec order by pos, kind, n rows between unbounded preceding and 1 preceding), 0)::bigint pl from b)
select rec, pl i, round(v, 6) v, false missing from a where kind = 1 union all select rec, unnest(generate_series(pl, pl + n - 1)) i, null, true from a where kind = 0 and n > 0""",
    "stitched": """with x as (select user_id subject, (epoch_us(ts)//1000) t0_ms, event_id ord, floor(value)::bigint % 500 + 1 n, 250.0::double fs from events),
g as (select *, t0_ms - lag(t0_ms + n/fs*1000) over w gap, row_number() over w - 1 segment from x window w as (partition by subject order by t0_ms, ord)),
f as (select *, case when gap > 0 and gap/1000 <= 86400 then floor(gap/1000*fs+0.5)::bigint else 0 end filler from g)
select subject, t0_ms, ord, segment, (coalesce(sum(n) over (partition by subject order by t0_ms, ord rows between unbounded preceding and 1 preceding), 0) + sum(filler) over (partition by subject order by t0_ms, ord rows unbounded preceding))::bigint start_idx, filler from f""",
    "offset_candidates": f"""with {TIMELINE_SQL}, x as (select subject, hemisphere, t::date as day, {HOUR}*2*pi()/24 a from tl where lfp is not null),
d as (select subject, hemisphere, day, count(*) n, (atan2(avg(sin(a)), avg(cos(a)))*24/(2*pi())+24) % 24 h from x group by all),
w as (select *, list_sort([lag(h, 1) over w, lag(h, 2) over w, lag(h, 3) over w])[2] bf, list_sort([h, lead(h, 1) over w, lead(h, 2) over w])[2] af, row_number() over w k, count(*) over (partition by subject, hemisphere) nd, sum(n) over (partition by subject, hemisphere) rws
 from d window w as (partition by subject, hemisphere order by day)), z as (select *, ((af - bf + 36) % 24) - 12 delta from w where rws >= 144 and nd >= 6 and k > 3 and k <= nd - 3)
select subject, hemisphere, day, floor(delta*60+0.5)::int delta_minutes from z where abs(delta) >= 0.75""",
    "resolved_offsets": f"with {SEGMENTS_SQL} select subject, hemisphere, row_ord, offset_min from rs",
    "offset_segments": f"""with {SEGMENTS_SQL}, n as (select *, coalesce((offset_min <> lag(offset_min) over (partition by subject, hemisphere order by t, row_ord))::int, 0) c from rs),
s as (select *, sum(c) over (partition by subject, hemisphere order by t, row_ord rows unbounded preceding)::bigint segment from n)
select subject, hemisphere, segment, max(offset_min) offset_min, count(*) n, round(min(epoch_us(t)/1e6), 6) from_s, round(max(epoch_us(t)/1e6), 6) to_s from s group by all""",
    "resampled": f"""with {TIMELINE_SQL}, x as (select subject, hemisphere, row_ord, epoch_us(t) a, lfp y from tl where lfp is not null),
s as (select *, lead(a) over w b, lead(y) over w z, min(a) over (partition by subject, hemisphere) t0, row_number() over w k, count(*) over (partition by subject, hemisphere) n from x window w as (partition by subject, hemisphere order by a, row_ord)),
g as (select *, case when k = 1 then 0 else (a-t0)//3600000000 + 1 end lo, (b-t0)//3600000000 hi from s where n >= 4 and b is not null), e as (select *, unnest(generate_series(lo, hi)) i from g where lo <= hi)
select subject, hemisphere, i, round(case when b-a > 21600000000 then null when b = a then y else y+(z-y)*(t0+i*3600000000-a)/(b-a) end, 6) v from e""",
    "device_states": f"""with {STATES_SQL} select subject, hemisphere, row_ord, status, round(ma, 6) ma, state, concat_ws(',', case when max_ma is not null then 'series' end, case when max_ma is null and group_ma is not null then 'group' end,
 case when status is not null then 'status' end, case when a is null and b is null and c is not null then 'documented' end) evidence from ds""",
    "comparable_states": f"""with {STATES_SQL}, l as (select *, lag(state) over (partition by subject, hemisphere order by t, row_ord) bf from ds) select subject, hemisphere, row_ord, bf = state and state <> 'UNKNOWN' comparable from l where bf is not null""",
    "lead_names": """with x as (select p_partkey part, ['ZERO_TWO_LEFT','ONE_AND_THREE_RIGHT','ONE_C_AND_TWO_C_LEFT','ZERO_A_AND_TWO_LEFT_RING','SensingChannelDef.ZERO_AND_THREE_LEFT'][p_partkey % 5 + 1] c, p_partkey % 5 m from part)
select part, case part % 5 when 0 then '02' when 1 then '1-3' when 2 then '1c-2c' when 3 then '0a-2' else 'SensingChannelDef.0-3' end as label, case m when 0 then 'B33005' when 1 then '3389' when 2 then 'B33015' when 4 then 'B33005' end model,
case m when 0 then 350 when 2 then 350 when 4 then 350 else 250 end short_ohm, case when part % 5 = 4 then 'ZERO_AND_THREE_LEFT' else c end electrode from x""",
    "channel_contacts": "select p_partkey part, ['0-2', '1-3', '1c-2c', '0a-2', '0-3'][p_partkey % 5 + 1] contacts from part",
    "collected_thresholds": f"""with {EVENT_KEYS_SQL}, {marks_sql('a0', 'signup')}, {marks_sql('b0', 'purchase')}, a as (select a0.*, value from a0 join events on event_id = row_ord where subject % 2 = 0), b as (select b0.*, value from b0 join events on event_id = row_ord),
x as (select subject, hemisphere, arg_max(value, (t, row_ord)) v from a group by all), y as (select subject, hemisphere, arg_min(value, (t, row_ord)) v from b group by all)
select coalesce(x.subject, y.subject) subject, coalesce(x.hemisphere, y.hemisphere) hemisphere, round(coalesce(x.v, y.v), 6) lower, round(2*coalesce(x.v, y.v), 6) upper from x full join y on x.subject = y.subject and x.hemisphere = y.hemisphere""",
    "usage_battery": """with s as (select o_custkey subject, o_orderdate t, o_orderkey r, 100 - o_totalprice % 90 b, o_orderkey % 1000 h, epoch_us(o_orderdate)/86400e6 d from orders),
m as (select subject, count(*) n, arg_min(b, (t, r)) b0, arg_max(b, (t, r)) b1, arg_min(h, (t, r)) h0, arg_max(h, (t, r)) h1, max(d) - min(d) nd from s group by all)
select subject, n, round(case when nd/30.44 > 0.5 then (b0-b1)/(nd/30.44) end, 6) battery_per_month, round(case when nd > 1 then (h1-h0)/nd end, 6) hours_per_day from m""",
    "circadian_profile": f"""with {CELLS_SQL}, m as (select subject, bin, state, count(*) k from ce group by all) select subject, bin, state, (sum(k) over (partition by subject, bin))::bigint n, round(100*k/sum(k) over (partition by subject, bin), 6) as "percent" from m""",
    "peak_of_state": f"""with {CELLS_SQL}, m as (select subject, bin, state, count(*) k from ce group by all), p as (select *, sum(k) over (partition by subject, bin) n from m), d as (select subject, count(distinct day) nd from ce group by all)
select subject, arg_min(bin, (-100*k/n::double, bin)) bin, round(max(100*k/n::double), 6) as "percent" from p join d using (subject) where state = 'error' and n >= 2 and n >= 0.5*nd group by all""",
    "compared_conditions": f"""with {CELLS_SQL}, v as (select subject, floor(day(day)/7)::int c, count(*) filter (state = 'error')::double x from ce group by subject, day),
m as (select subject, c, count(*) n, avg(x) m, var_samp(x) v from v group by all), f as (select subject, min(c) a, max(c) b from m group by all having count(*) >= 2),
j as (select f.subject, f.a, f.b, x.n na, y.n nb, y.m - x.m delta, case when x.n > 1 and y.n > 1 then sqrt(x.v/x.n + y.v/y.n) end sem from f join m x on x.subject = f.subject and x.c = f.a join m y on y.subject = f.subject and y.c = f.b)
select subject, a as "first", b as "last", na n_first, nb n_last, round(delta, 6) delta, round(sem, 6) sem, round(delta - 1.96*sem, 6) low, round(delta + 1.96*sem, 6) high from j""",
    "timeline_grid": f"""with {TIMELINE_SQL}, c as (select subject, hemisphere, t::date as day, least(floor({HOUR}*2), 47) bin, quantile_cont(lfp, 0.5) v from tl where lfp is not null group by all), l as (select subject, hemisphere, quantile_cont(v, 0.5) th from c group by all)
select subject, hemisphere, count(distinct day) n_days, count(*) n_filled, round(100 - 100*count(*)/(count(distinct day)*48)::double, 6) percent_missing, round(count(*) filter (v > th)/count(*)::double, 6) high_fraction from c join l using (subject, hemisphere) group by all""",
    "dose_cycle": f"""with {TIMELINE_SQL}, {marks_sql('ds', 'purchase')}, j as (select tl.subject, tl.hemisphere, (epoch_us(tl.t)-epoch_us(ds.t))/60e6 m, log10(lfp+1) x from tl join ds on tl.subject = ds.subject and tl.hemisphere = ds.hemisphere
 and epoch_us(tl.t) between epoch_us(ds.t)-5700000000 and epoch_us(ds.t)+5700000000 where lfp is not null),
c as (select subject, hemisphere, least(18, greatest(0, floor((m+90)/10+0.5))) b, avg(x) v from j group by all), s as (select subject, hemisphere, avg(v) filter (b >= 10) - avg(v) filter (b <= 8) delta, count(*) filter (b <= 8) a, count(*) filter (b >= 10) z from c group by all),
n as (select subject, hemisphere, count(*) n_doses from ds group by all) select subject, hemisphere, n_doses, round(delta, 6) delta, delta < 0 passes from s join n using (subject, hemisphere) where a >= 3 and z >= 3""",
    "suggested_limits": f"""with {TIMELINE_SQL}, m as (select subject, hemisphere, count(lfp) n, quantile_cont(lfp, [0.1, 0.9, 0.35, 0.65]) p from tl where lfp is not null group by all having count(lfp) >= 8)
select subject, hemisphere, 'percentiles' criterion, round(p[1], 6) lower, round(p[2], 6) upper from m union all select subject, hemisphere, 'duty', round(p[3], 6), round(p[4], 6) from m""",
    "session_reliability": """with o as (select o_custkey % 3 site, o_custkey subject, o_totalprice v, row_number() over (partition by o_custkey order by o_orderdate, o_orderkey) k, count(*) over (partition by o_custkey) own from orders),
e as (select * from o where own >= 2), c0 as (select site, min(own) mn from e group by all), f as (select e.* from e join c0 using (site) where k <= mn),
s as (select site, sum(x*x) ss, count(*)::double n from (select site, subject, sum(v) x from f group by all) group by all), r as (select site, sum(x*x) sr, count(*)::double k from (select site, k, sum(v) x from f group by all) group by all),
t as (select site, sum(v) x, sum(v*v) xx from f group by all), m as (select site, n, k, (ss/k-x*x/(n*k))/(n-1) a, (sr/n-x*x/(n*k))/(k-1) b, (xx-ss/k-sr/n+x*x/(n*k))/((n-1)*(k-1)) c from s join r using (site) join t using (site))
select site, n::bigint n, k::bigint k, round((a-c)/(a+(k-1)*c+k*(b-c)/n), 6) icc21, round((a-c)/(a+(k-1)*c), 6) icc31 from m where n >= 3 and k >= 2""",
    "phase_drift": f"with {ACTOGRAM_SQL} select subject, hemisphere, count(*) n_days, round(quantile_cont(drift, 0.5), 6) drift, round(quantile_cont(drift, 0.5)*(count(*)-1), 6) total from ag group by all having count(*) >= 2",
    "zscores": """with x as (select vec_id rec, label, unnest(embedding)::double v from embeddings), z as (select *, (v - avg(v) over (partition by rec))/nullif(stddev_samp(v) over (partition by rec), 0) zr, (v - avg(v) over (partition by label))/nullif(stddev_samp(v) over (partition by label), 0) zs from x)
select rec, round(var_samp(zr), 6) var_record, round(avg(zs), 6) mean_session, round(var_samp(zs), 6) var_session, round(max(zs), 6) most from z group by all""",
    "movement_change": f"""with {PAIRS_SQL}, m as (select unit, sum(a) filter (f between 13 and 30) br, sum(b) filter (f between 13 and 30) bm, sum(a) filter (f between 4 and 8) tr, sum(b) filter (f between 4 and 8) tm, sum(a) filter (f between 2 and 32) r, sum(b) filter (f between 2 and 32) m from pr group by all),
q as (select *, (m-r)/r total, ((bm/m)-(br/r))/(br/r) rb, ((tm/m)-(tr/r))/(tr/r) rt from m), v as (select *, case when abs(total) >= 0.05 and not (abs(rb) >= 0.05 or abs(rt) >= 0.05) then 'broadband' when abs(total) < 0.05 and (abs(rb) >= 0.05 or abs(rt) >= 0.05) then 'band'
 when abs(total) >= 0.05 then 'mixed' else 'none' end verdict from q)
select unit, round(total, 6) total, verdict, 'beta' band, round((bm-br)/br, 6) change, round(rb, 6) relative from v union all select unit, round(total, 6), verdict, 'theta', round((tm-tr)/tr, 6), round(rt, 6) from v""",
    "sign_flip": """with m as (select s_nationkey nation, count(*) n, avg(s_acctbal) me, stddev_samp(s_acctbal) sd, list(s_acctbal order by s_acctbal) a from supplier group by all having count(*) >= 2),
f as (select nation, n, a, unnest(generate_series(0, (pow(2, n)-1)::int)) k from m where n <= 20), s as (select nation, n, abs(list_sum(list_transform(a, lambda x, i: case when (k >> (i-1)::int) & 1 = 1 then -x else x end))/n) t, abs(list_sum(a)/n) o from f),
p as (select nation, count(*) filter (t >= o - 1e-12)/count(*)::double p from s group by all) select nation, n, round(me, 6) mean, round(me/(nullif(sd, 0)/sqrt(n)), 6) t, round(p, 6) p, round(2/pow(2, n), 6) least_p from m left join p using (nation)""",
    "band_ratios": f"""with {TIMELINE_SQL}, x as (select subject, hemisphere, epoch_us(date_trunc('hour', t)) as "window", avg(lfp) a, max(lfp)+1 g, min(lfp)+1 b from tl where lfp is not null group by all),
y as (select *, case when a > 0 then log10(a) end la, log10(g) lg, log10(b) lb from x), z as (select *, (la-avg(la) over w)/nullif(stddev_samp(la) over w, 0) za, (lg-avg(lg) over w)/nullif(stddev_samp(lg) over w, 0) zg, (lb-avg(lb) over w)/nullif(stddev_samp(lb) over w, 0) zb,
 (a-avg(a) over w)/nullif(stddev_samp(a) over w, 0) ra, (g-avg(g) over w)/nullif(stddev_samp(g) over w, 0) rg, (b-avg(b) over w)/nullif(stddev_samp(b) over w, 0) rb from y window w as (partition by subject, hemisphere))
select subject, hemisphere, "window", round(za+zg-zb, 5) odr_log, round(ra*rg/nullif(rb, 0), 5) odr_literal from z""",
    "pairable_records": f"""with {TIMELINE_SQL}, x as (select subject, hemisphere, min(t)::date t0, count(*) n, 250 + (count(*) % 2)*0.02::double fs, count(*) % 3 tb from tl group by all), l as (select * from x where hemisphere = 'Left'), r as (select * from x where hemisphere = 'Right'),
j as (select coalesce(l.subject, r.subject) subject, concat_ws(',', case when l.t0 is distinct from r.t0 then 't0' end, case when coalesce(abs(l.fs-r.fs) > 0.01, true) then 'fs' end, case when l.n is distinct from r.n then 'n' end, case when l.tb <> r.tb then 'tick_base' end) mismatches from l full join r on l.subject = r.subject)
select subject, mismatches = '' ok, mismatches from j""",
    "spectral_peaks": f"""with {LINES_SQL}, s as (select *, lag(p) over w a, lead(p) over w b from ln window w as (partition by rec order by f)), t as (select rec, f, p from s where p > a and p >= b and p > 0),
r as (select t.rec, t.f, t.p, coalesce(max(l.f) filter (l.f <= t.f and l.p <= t.p/2), 1) lo, coalesce(min(l.f) filter (l.f >= t.f and l.p <= t.p/2), 32) hi from t join ln l on l.rec = t.rec group by all),
k as (select *, row_number() over (partition by rec order by p desc, f) k from r) select rec, f freq, round(p, 6) power, hi - lo width, k::int k from k where k <= 6""",
    "band_table": f"""with {LINES_SQL}, b(band, lo, hi) as (values ('delta',1,4),('theta',4,8),('alpha',8,13),('lowbeta',13,20),('highbeta',20,35),('gamma',35,100)), t as (select rec, sum(p) tot from ln group by all)
select rec, band, round(sum(p), 6) absolute, round(100*sum(p)/max(tot), 6) relative, arg_min(f, (-p, f)) peak_f from ln join b on f between lo and hi join t using (rec) group by rec, band""",
    "burst_histogram": """with b as (select l_returnflag flag, case when l_quantity*20 < 200 then 0 when l_quantity*20 < 350 then 1 when l_quantity*20 < 500 then 2 when l_quantity*20 < 650 then 3 when l_quantity*20 < 800 then 4 else 5 end bin, count(*) n from lineitem group by all)
select flag, bin, n, round(100*n/sum(n) over (partition by flag), 6) as "percent" from b""",
    "modulation": """with x as (select event_type kind, (hour(ts)*60+minute(ts))/1440.0::double*2*pi()-pi() ph, value amp from events where value is not null), b as (select kind, least(greatest(floor((ph+pi())/(2*pi())*18), 0), 17)::int bin, avg(amp) m, count(*) k from x group by all),
q as (select *, m/sum(m) over (partition by kind) q from b), o as (select kind, sum(k)::bigint n, -sum(case when q > 0 then q*ln(q) end) h, arg_min(bin, (-q, bin)) bin from q group by all)
select kind, n, round(case when n >= 200 then (ln(18)-h)/ln(18) end, 6) mi, case when n >= 200 then bin end bin from o""",
    "removal_checks": f"""with {PAIRS_SQL}, m as (select unit, avg(a) filter (f between 0.5 and 40) ma, avg(b) filter (f between 0.5 and 40) mb, max(a) filter (abs(f-20) <= 1) - avg(a) filter (abs(f-20) between 4 and 5) ha, max(b) filter (abs(f-20) <= 1) - avg(b) filter (abs(f-20) between 4 and 5) hb,
 sum(a) filter (f between 13 and 30) pa, sum(b) filter (f between 13 and 30) pb from pr group by all) select unit, round(10*log10(ma/mb), 5) suppression_db, round(hb/nullif(ha, 0), 5) recovery, round(pb/nullif(pa, 0), 5) preservation from m""",
    "missing_samples": """with x as (select vec_id rec, generate_subscripts(embedding, 1) i, unnest(embedding)::double v from embeddings), g as (select *, v < -0.5 m, i - row_number() over (partition by rec, v < -0.5 order by i) grp from x),
r as (select rec, grp, count(*) k from g where m group by all), l as (select rec, max(k) longest from r group by all)
select rec, count(*)::int n, count(*) filter (v < -0.5)::int n_missing, round(100*count(*) filter (v < -0.5)/count(*)::double, 6) as "percent", coalesce(max(longest), 0)::int longest from x left join l using (rec) group by all""",
    "whole_windows": """with x as (select vec_id rec, embedding e, unnest(generate_series(0, len(embedding)-16, 8)) s from embeddings), w as (select rec, s, len(list_filter(e[s+1:s+16], lambda v: v < -1.5)) = 0 ok from x)
select rec, coalesce(string_agg(s::varchar, ',' order by s) filter (ok), '') starts, count(*) filter (not ok)::int dropped from w group by all""",
    "quality_lights": """with m as (select event_id % 97 rec, count(*) n, count(*) filter (event_type = 'error') r, count(*) filter (event_type = 'purchase') a, count(*) filter (event_type = 'signup') g from events group by all)
select rec, case when r > 0 then 'red' when a > 0 then 'amber' else 'green' end light, n, g n_unverified, round(100*(n-g)/n::double, 6) percent_verified from m""",
    "dose_response": """with m as (select l_suppkey unit, round(l_discount, 2) ma, count(*) k, quantile_cont(l_extendedprice, 0.5) y from lineitem group by all having count(*) >= 4),
o as (select unit, count(*) levels, min(ma) lo, max(ma) hi, regr_slope(y, ma) s, regr_r2(y, ma) r from m group by all)
select unit, levels, case when levels >= 3 then lo end least_ma, case when levels >= 3 then hi end most_ma, round(case when levels >= 3 then s end, 3) slope, round(case when levels >= 3 then r end, 3) r2 from o""",
    "window_table": f"""with {TIMELINE_SQL}, x as (select subject, hemisphere, epoch_us(date_trunc('hour', t)) as "window", avg(lfp) m, count(*) n from tl where lfp is not null group by all)
select subject, "window", round(max(m) filter (hemisphere = 'Left'), 6) left_mean, max(n) filter (hemisphere = 'Left') left_n, round(max(m) filter (hemisphere = 'Right'), 6) right_mean, max(n) filter (hemisphere = 'Right') right_n, count(distinct hemisphere) sides from x group by all""",
    "rest_activity_panel": f"""with {COVERED_SQL}, sl as (select *, dense_rank() over (partition by subject, hemisphere order by day)*24+h as slot from hc), sd as (select *, case when slot - lag(slot) over w = 1 then power(v - lag(v) over w, 2) end st from sl window w as (partition by subject, hemisphere order by slot)),
iv as (select subject, hemisphere, count(*)*(sum(st)*(24*count(distinct day)-1)/nullif(count(st), 0))/((count(*)-1)*nullif(var_pop(v)*count(*), 0)) variability from sd group by all having count(distinct day) >= 3), ia as (select subject, hemisphere, count(*) n, avg(v) m, var_pop(v)*count(*) sst from hc group by all), ib as (select subject, hemisphere, h, avg(v) mh from hc group by all),
ic as (select subject, hemisphere, sum((mh-m)*(mh-m)) ssb, count(*) p from ib join ia using (subject, hemisphere) group by all), si as (select subject, hemisphere, n*ssb/(p*sst) stability from ia join ic using (subject, hemisphere) join hd using (subject, hemisphere))
select subject, hemisphere, round(stability, 6) stability, round(variability, 6) variability, round(m10, 6) m10, round(l5, 6) l5, round((m10-l5)/nullif(m10+l5, 0), 6) relative_amplitude from iv left join si using (subject, hemisphere) left join ml using (subject, hemisphere)""",
    "cosinor_test": f"""with {TIMELINE_SQL}, xs as (select subject, hemisphere, t, row_ord, cos({HOUR}*2*pi()/24) c, sin({HOUR}*2*pi()/24) s, lfp y from tl where lfp is not null),
mo as (select subject, hemisphere, count(*)::double n, sum(c) sc, sum(s) ss, sum(c*c) cc, sum(s*s) s2, sum(c*s) cs, sum(y) sy, sum(c*y) cy, sum(s*y) s_y from xs group by all),
de as (select *, n*(cc*s2-cs*cs)-sc*(sc*s2-cs*ss)+ss*(sc*cs-cc*ss) dd from mo),
so as (select *, (sy*(cc*s2-cs*cs)-sc*(cy*s2-cs*s_y)+ss*(cy*cs-cc*s_y))/dd m, (n*(cy*s2-cs*s_y)-sy*(sc*s2-cs*ss)+ss*(sc*s_y-cy*ss))/dd b, (n*(cc*s_y-cy*cs)-sc*(sc*s_y-cy*ss)+sy*(sc*cs-cc*ss))/dd g from de where n > 5),
re as (select xs.*, y - (m + b*c + g*s) r from xs join so using (subject, hemisphere)), rl as (select *, r*lag(r) over (partition by subject, hemisphere order by t, row_ord) rr from re),
fi as (select subject, hemisphere, count(*)::double n, sum(r*r) sse, sum(rr) num, var_pop(y)*count(*) sst from rl group by all), fo as (select *, (sst-sse)/2/(sse/(n-3)) f, num/sse rho from fi), fe as (select *, n*(1-rho)/(1+rho) ne from fo)
select subject, hemisphere, n::bigint n, round(f, 5) f, round(rho, 5) rho, round(ne, 5) n_eff, round(f*greatest(0.02, ne/n), 5) f_adjusted, greatest(2.0, floor(ne+0.5)-3)::double df2_adjusted, round(sqrt(sse/(n-3)), 5) residual_sd from fe""",
    "m10_l5": M10_SQL,
    "actogram": ACTOGRAM_DAYS_SQL,
}

QUERIES = {
    "unwrapped_ticks": unwrapped_ticks, "lost_packets": lost_packets, "packet_loss": packet_loss, "effective_rate": effective_rate, "gaps_inserted": gaps_inserted, "stitched": stitched,
    "offset_candidates": offset_candidates, "offset_breaks": offset_breaks, "resolved_offsets": resolved_offsets, "offset_segments": offset_segments, "resampled": resampled, "device_states": device_states,
    "comparable_states": comparable_states, "lead_names": lead_names, "channel_contacts": channel_contacts, "collected_thresholds": collected_thresholds, "usage_battery": usage_battery, "circadian_profile": circadian_profile,
    "peak_of_state": peak_of_state, "compared_conditions": compared_conditions, "timeline_grid": timeline_grid, "dose_cycle": dose_cycle, "suggested_limits": suggested_limits, "session_reliability": session_reliability,
    "cosinor_test": cosinor_test, "phase_drift": phase_drift, "rest_activity_panel": rest_activity_panel, "zscores": zscores, "movement_change": movement_change, "sign_flip": sign_flip, "band_ratios": band_ratios,
    "pairable_records": pairable_records, "spectral_peaks": spectral_peaks, "band_table": band_table, "burst_histogram": burst_histogram, "modulation": modulation, "removal_checks": removal_checks,
    "missing_samples": missing_samples, "whole_windows": whole_windows, "quality_lights": quality_lights, "dose_response": dose_response, "window_table": window_table,
}
