"""Provenance: digests of tables that don't depend on the order of rows, steps with their parameters, and comparisons.

A table's rows are dealt to blocks by their key. For every block and column the manifest has the number of rows, of nulls and the sum
of a hash of (key, column, cell): equal tables have equal manifests however they are ordered or partitioned, and of tables
that differ the blocks and columns that do are named. Sums are made before the shuffle: a manifest of any table is a few rows
from each task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Hexadecimal digits of a hash: sums of 60-bit numbers over 1e20 rows fit in a decimal.
DIGITS = 15
NULL = "\u0000null"


def _number(text: Column) -> Column:
    return F.conv(F.substring(F.md5(text), 1, DIGITS), 16, 10).cast("decimal(38,0)")


def _text(c: str) -> Column:
    return F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(NULL))


def table_manifest(table: DataFrame, key: list[str], columns: list[str] | None = None, blocks: int = 16) -> DataFrame:
    """(block, column, n, n_null, digest) of the columns (all but the key unless given) and of the key itself, by the name of `key`.

    Cells count by their text. Rows without a key have one of nulls; repeated rows count each. An empty table has no rows.
    """
    columns = columns or [c for c in table.columns if c not in key]
    name = F.concat_ws("\u0001", *[_text(c) for c in key])
    cells = [F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").isNull().alias("null"), _text(c).alias("text")) for c in columns]
    own = F.struct(F.lit("key").alias("column"), F.lit(False).alias("null"), F.lit("").alias("text"))
    x = table.select(name.alias("_key"), F.explode(F.array(own, *cells)).alias("_c"))
    x = x.withColumn("block", (_number(F.col("_key")) % blocks).cast("int"))
    digest = F.sum(_number(F.concat_ws("\u0001", F.col("_key"), F.col("_c.column"), F.col("_c.text"))))
    return x.groupBy("block", F.col("_c.column").alias("column")).agg(F.count("*").alias("n"), F.count_if("_c.null").alias("n_null"), digest.cast("string").alias("digest"))


def manifest_changes(kept: DataFrame, now: DataFrame) -> DataFrame:
    """(block, column, status, n_kept, n_now): how each block and column of two table manifests compares: equal, changed, missing (only in
    the kept one) or added."""
    side = lambda m, s: m.select("block", "column", F.col("n").alias(f"n_{s}"), F.struct("n", "n_null", "digest").alias(s))
    both = side(kept, "kept").join(side(now, "now"), ["block", "column"], "full")
    status = F.when(F.col("kept").isNull(), "added").when(F.col("now").isNull(), "missing").when(F.col("kept") == F.col("now"), "equal").otherwise("changed")
    return both.select("block", "column", status.alias("status"), "n_kept", "n_now")


def canonical(params: Column) -> Column:
    """Parameters (a map) as JSON with sorted keys, so that their order has no effect; null counts as none."""
    entries = F.array_sort(F.map_entries(F.coalesce(params, F.create_map().cast("map<string,string>"))))
    return F.to_json(F.map_from_entries(entries))


def record_steps(steps: DataFrame) -> DataFrame:
    """(id, step, params, n_in, n_out, n_dropped, digest) of steps (id, step, params map<string,string>, n_in, n_out): the digest is of the step with its
    canonical parameters and counts, not of when it ran."""
    text = canonical(F.col("params"))
    out = steps.select("id", "step", text.alias("params"), "n_in", "n_out", (F.col("n_in") - F.col("n_out")).alias("n_dropped"))
    parts = [F.coalesce(F.col(c).cast("string"), F.lit(NULL)) for c in ("step", "params", "n_in", "n_out")]
    return out.withColumn("digest", F.sha2(F.concat_ws("\u0001", *parts), 256))


def step_differences(kept: DataFrame, now: DataFrame) -> DataFrame:
    """(id, field, kept, now): where two records of steps differ: a step that only one has, its name, else its parameters, else its counts out."""
    side = lambda m, s: m.select("id", F.struct("step", "params", "n_out").alias(s))
    both = side(kept, "a").join(side(now, "b"), "id", "full")
    only = F.col("a").isNull() | F.col("b").isNull()
    counts = (F.col("a.n_out") != F.col("b.n_out")) & F.col("a.n_out").isNotNull() & F.col("b.n_out").isNotNull()
    field = F.when(only | ~F.col("a.step").eqNullSafe(F.col("b.step")), "step").when(~F.col("a.params").eqNullSafe(F.col("b.params")), "params").when(counts, "n_out")
    pick = lambda s: F.when(F.col("field") == "step", F.col(f"{s}.step")).when(F.col("field") == "params", F.col(f"{s}.params")).otherwise(F.col(f"{s}.n_out").cast("string"))
    return both.withColumn("field", field).where("field is not null").select("id", "field", pick("a").alias("kept"), pick("b").alias("now"))
