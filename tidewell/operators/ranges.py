"""Ordered computations over series of any length: ranges of rows in place of one window over a series.

`by_ranges` deals the rows to ranges of (keys, order), `_part` by name; a range's rows of one series are a piece. What a
row needs of earlier rows it has from its own piece, or from one row for each earlier piece. Keys and order must not be
null, and order must not repeat within a series.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewell.sources.shared import stored


def by_ranges(rows: DataFrame, keys: list[str], order: list[str], parts: int | None = None) -> DataFrame:
    parts = parts or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return stored(rows.repartitionByRange(parts, *keys, *order).withColumn("_part", F.spark_partition_id()), "ranges")


def _pieces(keys: list[str]):
    """The pieces of a series in order; there are no more of them than ranges."""
    return Window.partitionBy(*keys).orderBy("_part")


def _piece(keys: list[str]):
    return Window.partitionBy("_part", *keys)


def previous(ranged: DataFrame, keys: list[str], order: list[str], value: Column, name: str) -> DataFrame:
    """Add the value that the row before in the series has, null for its first row."""
    boxed = F.struct(value.alias("v"))
    last = ranged.groupBy("_part", *keys).agg(F.max_by(boxed, F.struct(*order)).alias("_last"))
    carried = last.select("_part", *keys, F.lag("_last").over(_pieces(keys)).alias("_before"))
    own = F.lag(boxed).over(_piece(keys).orderBy(*order))
    return ranged.withColumn("_own", own).join(carried, ["_part", *keys]).withColumn(name, F.coalesce("_own", "_before")["v"]).drop("_own", "_before")


def running_sum(ranged: DataFrame, keys: list[str], order: list[str], value: Column, name: str) -> DataFrame:
    """Add the sum of the value over the row and all before it in the series."""
    total = ranged.groupBy("_part", *keys).agg(F.sum(value).alias("_total"))
    before = F.sum("_total").over(_pieces(keys).rowsBetween(Window.unboundedPreceding, -1))
    base = total.select("_part", *keys, F.coalesce(before, F.lit(0)).alias("_base"))
    own = F.sum(value).over(_piece(keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    return ranged.withColumn("_own", F.coalesce(own, F.lit(0))).join(base, ["_part", *keys]).withColumn(name, F.col("_base") + F.col("_own")).drop("_own", "_base")


def runs(ranged: DataFrame, keys: list[str], order: list[str], state: Column, name: str = "run") -> DataFrame:
    """Add the number of the run of equal states that a row belongs to, counted from 1 in each series."""
    boxed = F.struct(state.alias("state"))  # a null state is a state too
    marked = previous(ranged, keys, order, boxed, "_state")
    return running_sum(marked, keys, order, (~boxed.eqNullSafe(F.col("_state"))).cast("int"), name).drop("_state")


def filled(ranged: DataFrame, keys: list[str], order: list[str], value: Column, name: str) -> DataFrame:
    """Add the last value that isn't null of the row and those before it in the series."""
    last = ranged.groupBy("_part", *keys).agg(F.max_by(value, F.when(value.isNotNull(), F.struct(*order))).alias("_last"))
    before = F.last("_last", ignorenulls=True).over(_pieces(keys).rowsBetween(Window.unboundedPreceding, -1))
    own = F.last(value, ignorenulls=True).over(_piece(keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    return ranged.withColumn("_own", own).join(last.select("_part", *keys, before.alias("_before")), ["_part", *keys]).withColumn(name, F.coalesce("_own", "_before")).drop("_own", "_before")


def with_group(rows: DataFrame, groups: DataFrame, by: list[str], over: list[str], parts: int = 256) -> DataFrame:
    """rows with the columns of groups (one row for each `by`): each row of groups goes to `parts` places, to which the rows of its
    group are dealt by `over`, so that few large groups aren't few large tasks."""
    deal = F.pmod(F.xxhash64(*over), F.lit(parts)).cast("int")
    many = groups.withColumn("_deal", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    return rows.withColumn("_deal", deal).join(many, [*by, "_deal"]).drop("_deal")
