"""Queries of the models over the test tables; most are beyond SQL and are tested against known truth."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.operators import fits, mixed, models, wake
from tidewell.sources.adapters import read, timeline

from .chronic import rounded


def gmm_thresholds(spark: SparkSession, d: str) -> DataFrame:
    x = timeline(spark, d)
    return rounded(models.propose_thresholds(wake.in_wake(x, wake.wake_window(x))))


def changepoints(spark: SparkSession, d: str) -> DataFrame:
    return rounded(models.change_points(timeline(spark, d)))


def bootstrap(spark: SparkSession, d: str) -> DataFrame:
    return rounded(models.cosinor_bootstrap(timeline(spark, d)))


def permutation(spark: SparkSession, d: str) -> DataFrame:
    x = timeline(spark, d).withColumn("night", F.hour("t") < 8)
    daily = x.where("lfp is not null").groupBy("subject", "hemisphere", F.to_date("t").alias("day"), "night").agg(F.avg("lfp").alias("v"))
    return rounded(models.permutation_test(daily, "night", "v", ["subject", "hemisphere"]))


def mixed_cosinor(spark: SparkSession, d: str) -> DataFrame:
    return rounded(mixed.mixed_cosinor(timeline(spark, d)))


def cyclic_rhythm(spark: SparkSession, d: str) -> DataFrame:
    return rounded(mixed.cyclic_rhythm(timeline(spark, d)))


def dose_fits(spark: SparkSession, d: str) -> DataFrame:
    """Line items as powers at currents of 0 to 4.9 mA: the open ones fall by a sigmoid, the closed ones decay, returned ones rise; discounts are noise."""
    ma = (F.col("l_quantity") - 1) / 10
    falls = F.when(F.col("l_linestatus") == "O", 8 + 25 / (1 + F.exp(3.1 * (ma - 1.7)))).otherwise(12 + 30 * F.exp(-1.3 * ma))
    power = F.when(F.col("l_returnflag") == "R", 5 + 2 * ma).otherwise(falls) + 10 * (F.col("l_discount") - 0.05)
    pairs = read(spark, d, "lineitem").select(F.col("l_returnflag").alias("flag"), F.col("l_linestatus").alias("status"), ma.alias("ma"), power.alias("power"))
    return rounded(fits.fit_dose_response(pairs, ["flag", "status"]))


ORACLE: dict[str, str] = {}

QUERIES = {
    "gmm_thresholds": gmm_thresholds, "changepoints": changepoints, "bootstrap": bootstrap,
    "permutation": permutation, "mixed_cosinor": mixed_cosinor, "cyclic_rhythm": cyclic_rhythm, "dose_fits": dose_fits,
}
