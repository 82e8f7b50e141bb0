"""Configuration blocks: stretches of sessions without a breaking change, and the samples within them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewell.functions.columns import ratio


def config_blocks(sessions: DataFrame, channel: str = "channel", centre: str = "centre", tolerance: float = 0.5) -> DataFrame:
    """(subject, block, n_sessions, start, end, channel): sessions in order, cut where the channel changes or the centre
    moves by over `tolerance` of its last value. A block reaches to the start of the next, exclusive; the last is open."""
    w = Window.partitionBy("subject").orderBy("t", "row_ord")
    moved = F.abs(F.col(centre) - F.lag(centre).over(w)) > tolerance * F.abs(F.lag(centre).over(w))
    cut = F.coalesce((F.col(channel) != F.lag(channel).over(w)) | moved, F.lit(False))
    x = sessions.withColumn("cut", cut.cast("int")).withColumn("block", F.sum("cut").over(w))
    b = x.groupBy("subject", "block").agg(F.count("*").alias("n_sessions"), F.min("t").alias("start"), F.min_by(channel, F.struct("t", "row_ord")).alias("channel"))
    return b.withColumn("end", F.lead("start").over(Window.partitionBy("subject").orderBy("block")))


def in_blocks(rows: DataFrame, blocks: DataFrame) -> DataFrame:
    """rows (subject, t, ...) with the number of their block, null before the first: nothing is dropped. The latest block
    that starts at or before a row is its block, by one sort of both."""
    order = Window.partitionBy("subject").orderBy("t", "_side", "block").rowsBetween(Window.unboundedPreceding, 0)
    a = rows.withColumn("_side", F.lit(1))
    b = blocks.select("subject", F.col("start").alias("t"), "block", F.lit(0).alias("_side"))
    both = a.unionByName(b, allowMissingColumns=True)
    return both.withColumn("block", F.last("block", ignorenulls=True).over(order)).where("_side = 1").drop("_side")


def impedance_drift(measures: DataFrame, flag_percent: float = 25.0) -> DataFrame:
    """Change of each contact from its first to its last measurement, and its slope a day where three or more are there."""
    order = F.struct("t", "row_ord")
    days = F.unix_micros("t") / 86_400_000_000
    x = measures.withColumn("days", days)
    out = x.groupBy("contact").agg(
        F.count("*").alias("n"), F.min_by("ohm", order).alias("first_ohm"), F.max_by("ohm", order).alias("last_ohm"), F.regr_slope("ohm", "days").alias("slope")
    )
    change = 100 * ratio(F.col("last_ohm") - F.col("first_ohm"), F.col("first_ohm"))
    out = out.withColumns({"change_percent": change, "slope": F.when(F.col("n") >= 3, F.col("slope"))})
    return out.withColumn("flag", F.coalesce(F.abs("change_percent") >= flag_percent, F.lit(False)))
