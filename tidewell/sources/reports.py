"""Session reports: one JSON document for each visit, read as raw text and unfolded into typed tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.functions.columns import missing

_POINT = "array<struct<DateTime:string,LFP:double,AmplitudeInMilliAmps:double>>"
_RECORD = "struct<Channel:string,SampleRateInHz:double,FirstPacketDateTime:string,GlobalPacketSizes:string,TicksInMses:string,GlobalSequences:string,TimeDomainData:array<double>>"
#: The parts of a report that are read; all are optional.
REPORT = f"""SessionDate string, SessionEndDate string, ProgrammerUtcOffset string,
PatientInformation struct<Initial:struct<PatientId:string,Diagnosis:string>,Final:struct<PatientId:string,Diagnosis:string>>,
DiagnosticData struct<LFPTrendLogs:map<string,map<string,{_POINT}>>,
 LfpFrequencySnapshotEvents:array<struct<DateTime:string,EventID:int,EventName:string,LfpFrequencySnapshotEvents:map<string,struct<FFTBinData:array<double>,Frequency:array<double>,GroupId:string,SenseID:string>>>>,
 EventLogs:array<struct<DateTime:string,SessionType:string,ParameterTrendId:string,TherapyStatus:string,NewGroupId:string,OldGroupId:string>>>,
Impedance array<struct<Hemisphere:array<struct<Hemisphere:string,SessionImpedance:struct<Monopolar:array<struct<Electrode1:string,Electrode2:string,ResultValue:double>>,Bipolar:array<struct<Electrode1:string,Electrode2:string,ResultValue:double>>>>>>>,
LFPMontage array<struct<Hemisphere:string,SensingElectrodes:string,PeakFrequencyInHertz:double,PeakMagnitudeInMicroVolt:double,ArtifactStatus:string,LFPFrequency:array<double>,LFPMagnitude:array<double>>>,
BrainSenseTimeDomain array<{_RECORD}>, IndefiniteStreaming array<{_RECORD}>, LfpMontageTimeDomain array<{_RECORD}>"""


def tail(c):
    """The last part of a dotted enumeration value."""
    return F.element_at(F.split(c, r"\."), -1)


def hemisphere(c):
    return F.when(F.lower(c).contains("left"), "Left").when(F.lower(c).contains("right"), "Right")


def read_reports(spark: SparkSession, path: str) -> DataFrame:
    """(file, subject, session, offset_minutes, doc, malformed): one row for each file. The subject is a hash of the patient's
    id; the id itself goes no further. A file that is no JSON object is a row with `malformed`."""
    raw = spark.read.text(path, wholetext=True).withColumn("file", F.col("_metadata.file_path"))
    x = raw.withColumn("doc", F.from_json("value", REPORT))
    patient = F.coalesce("doc.PatientInformation.Final.PatientId", "doc.PatientInformation.Initial.PatientId")
    sign = F.when(F.col("doc.ProgrammerUtcOffset").startswith("-"), -1).otherwise(1)
    part = lambda i: F.regexp_extract(F.col("doc.ProgrammerUtcOffset"), r"(\d+):(\d+)", i).try_cast("int")
    return x.select(
        "file", F.concat(F.lit("sub-"), F.substring(F.sha2(patient, 256), 1, 12)).alias("subject"), F.try_to_timestamp("doc.SessionDate").alias("session"),
        F.coalesce(sign * (part(1) * 60 + part(2)), F.lit(0)).alias("offset_minutes"), "doc", (F.get_json_object("value", "$.SessionDate").isNull()).alias("malformed"),
    )


def timeline(reports: DataFrame) -> DataFrame:
    """(subject, hemisphere, t, lfp, ma, censored, file, row_ord): the chronic series; of equal times within a file the first stays."""
    sides = reports.select("file", "subject", F.explode("doc.DiagnosticData.LFPTrendLogs").alias("side", "days"))
    days = sides.select("file", "subject", hemisphere(F.col("side")).alias("hemisphere"), F.explode("days").alias("day", "points"))
    p = days.select("file", "subject", "hemisphere", "day", F.posexplode("points").alias("i", "p"))
    x = missing(F.col("p.LFP"))
    rows = p.select(
        "subject", "hemisphere", F.try_to_timestamp("p.DateTime").alias("t"), F.when(x >= 0, x).alias("lfp"), missing(F.col("p.AmplitudeInMilliAmps")).alias("ma"),
        F.coalesce(x < 0, F.lit(False)).alias("censored"), "file", F.struct("day", "i").alias("row_ord"),
    ).where("t is not null")
    rest = F.struct("lfp", "ma", "censored", "row_ord")
    return rows.groupBy("subject", "hemisphere", "file", "t").agg(F.min_by(rest, "row_ord").alias("r")).select("subject", "hemisphere", "t", "r.*", "file")


def records(reports: DataFrame, part: str = "BrainSenseTimeDomain") -> DataFrame:
    """(subject, file, rec, channel, hemisphere, fs, t0, x, sizes, ticks): raw records, packet lists as arrays."""
    r = reports.select("file", "subject", F.posexplode(f"doc.{part}").alias("rec", "r"))
    numbers = lambda c: F.transform(F.filter(F.split(c, ","), lambda s: F.trim(s) != ""), lambda s: s.try_cast("double"))
    return r.select(
        "subject", "file", "rec", F.col("r.Channel").alias("channel"), hemisphere(F.col("r.Channel")).alias("hemisphere"), F.col("r.SampleRateInHz").alias("fs"),
        F.try_to_timestamp("r.FirstPacketDateTime").alias("t0"), F.col("r.TimeDomainData").alias("x"), numbers("r.GlobalPacketSizes").alias("sizes"), numbers("r.TicksInMses").alias("ticks"),
    )


def impedances(reports: DataFrame) -> DataFrame:
    """(subject, t, hemisphere, kind, contact, ohm)."""
    h = reports.select("subject", "session", F.explode("doc.Impedance").alias("i")).select("subject", "session", F.explode("i.Hemisphere").alias("h"))
    parts = [h.select("subject", "session", "h.Hemisphere", F.lit(k.lower()).alias("kind"), F.explode(f"h.SessionImpedance.{k}").alias("m")) for k in ("Monopolar", "Bipolar")]
    x = parts[0].union(parts[1])
    contact = F.concat_ws("-", tail(F.col("m.Electrode1")), tail(F.col("m.Electrode2")))
    return x.select("subject", F.col("session").alias("t"), hemisphere(F.col("Hemisphere")).alias("hemisphere"), "kind", contact.alias("contact"), F.col("m.ResultValue").alias("ohm"))


def snapshots(reports: DataFrame) -> DataFrame:
    """(subject, t, event, hemisphere, f, p, n_censored): spectra that patients' events triggered; negative bins are censored."""
    e = reports.select("subject", F.explode("doc.DiagnosticData.LfpFrequencySnapshotEvents").alias("e"))
    s = e.select("subject", F.try_to_timestamp("e.DateTime").alias("t"), F.col("e.EventName").alias("event"), F.explode("e.LfpFrequencySnapshotEvents").alias("side", "s"))
    kept = F.transform("s.FFTBinData", lambda v: F.when(v >= 0, v))
    return s.select("subject", "t", "event", hemisphere(F.col("side")).alias("hemisphere"), F.col("s.Frequency").alias("f"), kept.alias("p"), F.size(F.filter("s.FFTBinData", lambda v: v < 0)).alias("n_censored"))


def event_logs(reports: DataFrame) -> DataFrame:
    """(subject, t, kind, status, old_group, new_group) of the device's own log."""
    e = reports.select("subject", F.explode("doc.DiagnosticData.EventLogs").alias("e"))
    return e.select(
        "subject", F.try_to_timestamp("e.DateTime").alias("t"), tail(F.coalesce("e.SessionType", "e.ParameterTrendId")).alias("kind"), tail(F.col("e.TherapyStatus")).alias("status"),
        tail(F.col("e.OldGroupId")).alias("old_group"), tail(F.col("e.NewGroupId")).alias("new_group"),
    )


def availability(reports: DataFrame) -> DataFrame:
    """(file, modality, n): how much of each modality a report holds, none included."""
    size = lambda c: F.greatest(F.coalesce(F.size(c), F.lit(0)), F.lit(0))
    parts = {
        "timeline": size(F.map_keys("doc.DiagnosticData.LFPTrendLogs")), "snapshots": size(F.col("doc.DiagnosticData.LfpFrequencySnapshotEvents")), "event_logs": size(F.col("doc.DiagnosticData.EventLogs")),
        "impedance": size(F.col("doc.Impedance")), "montage": size(F.col("doc.LFPMontage")), "time_domain": size(F.col("doc.BrainSenseTimeDomain")), "streaming": size(F.col("doc.IndefiniteStreaming")),
    }
    return reports.select("file", F.explode(F.array(*[F.struct(F.lit(k).alias("modality"), v.alias("n")) for k, v in parts.items()])).alias("m")).select("file", "m.*")
