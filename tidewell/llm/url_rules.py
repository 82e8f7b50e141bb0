"""URL filters by a sort-merge range join of canonical keys.

The key of a rule is its host, labels reversed, a slash, and its path; a page has one such key for its host and each
parent host that some rule names. A rule fits a key if it is a prefix of it: it stands for the interval of keys that
begin with it. Rules and keys are sorted together by ranges; a sweep keeps a stack of the rules whose interval is
open, nested in one another, and the top one is the longest that fits. A rule that opened in an earlier range is
carried to the ranges that begin inside its interval.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Host and path of a URL: what follows the first ://, up to / ? # and up to ? #.
PLACE = r"(?s)^.*?://([^/?#]*)([^?#]*)"


def _fold(host):
    return F.translate(host, UPPER, LOWER)


def _reversed(host):
    return F.array_join(F.reverse(F.split(host, r"\.", -1)), ".")


def split_urls(pages: DataFrame, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """(id, host, path) of each row; a null URL or one without :// has neither."""
    url = F.coalesce(F.col(f"`{url_col}`").cast("string"), F.lit(""))
    return pages.select(F.col(f"`{id_col}`").alias(id_col), _fold(F.regexp_extract(url, PLACE, 1)).alias("host"), F.regexp_extract(url, PLACE, 2).alias("path"))


def _sweep(batches):
    import pyarrow as pa

    stack: list[tuple] = []
    now = None
    for b in batches:
        found, rules = [], []
        for i, (part, key, kind, rule) in enumerate(zip(*(b.column(c).to_pylist() for c in ("_part", "_key", "_kind", "_rule")), strict=True)):
            if part != now:
                now, stack = part, []
            while stack and not key.startswith(stack[-1][0]):
                stack.pop()
            if kind == 0:
                stack.append((key, rule))
            elif stack:
                found.append(i)
                rules.append(stack[-1][1])
        at = b.take(pa.array(found, pa.int64()))
        kind = b.schema.field("_rule").type
        yield pa.RecordBatch.from_arrays([at.column("_id"), at.column("host"), at.column("path"), pa.array(rules, kind)], ["_id", "host", "path", "_rule"])


def url_verdicts(pages: DataFrame, rules: DataFrame, default: str = "allow", id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """(id, host, path, rule, verdict) for each row of pages under `rules` (host, path, verdict).

    A rule fits its host and all subdomains where the URL's path begins with the rule's; of several the longest
    (host and path together, then host) wins, and without one `rule` is null and the verdict is `default`. Hosts
    compare with A-Z lower-cased, paths as they are. A rule given twice with different verdicts counts with the
    greatest (block before allow), one without host or verdict fits nothing, a null path fits every path. A null
    URL has an empty host and path and meets no rule. Repeated rows and null ids keep a row each; other columns
    don't pass; empty tables are fine.

    Neither pages nor rules are bounded: hosts that rules name are found by a join, keys and rules are sorted by
    ranges, and a task holds one stack, at most one rule for each character of a key. Rows of one hot URL are
    spread over ranges by id and by the partition that read them.
    """
    spark = pages.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    found = split_urls(pages, id_col, url_col).withColumnRenamed(id_col, "_id")
    host = _fold(F.col("host"))
    known = (
        rules.where("host <> '' and verdict is not null").select(host.alias("host"), F.coalesce("path", F.lit("")).alias("path"), "verdict")
        .groupBy("host", "path").agg(F.max("verdict").alias("verdict"))
        .select(_reversed(F.col("host")).alias("_host"), F.struct(F.length("host") + F.length("path"), F.length("host"), F.concat("host", "path").alias("rule"), "verdict").alias("_rule"), "path")
    )
    known = cut(known.select("_host", F.concat("_host", F.lit("/"), "path").alias("_key"), "_rule"), "rules")
    bounds = known.agg(F.max(F.size(F.split("_host", r"\."))), F.max(F.length("_key"))).first()
    deepest, longest = bounds[0] or 0, bounds[1] or 0

    labels = F.reverse(F.split("host", r"\.", -1))
    parents = F.transform(F.sequence(F.lit(1), F.least(F.size(labels), F.lit(max(deepest, 1)))), lambda i: F.array_join(F.slice(labels, 1, i), "."))
    keys = found.where("host <> ''").select("_id", "host", "path", F.explode(parents).alias("_at"), F.spark_partition_id().alias("_spread"))
    keys = keys.join(known.select(F.col("_host").alias("_at")).distinct(), "_at", "left_semi")
    keys = keys.select("_id", "host", "path", F.concat("_at", F.lit("/"), "path").alias("_key"), F.lit(1).alias("_kind"), F.lit(None).cast(known.schema["_rule"].dataType).alias("_rule"), "_spread")
    rows = keys.unionByName(known.select("_key", F.lit(0).alias("_kind"), "_rule"), allowMissingColumns=True)
    order = ["_key", "_kind", "_id", "_spread"]
    rows = cut(rows.repartitionByRange(n, *order).withColumn("_part", F.spark_partition_id()).drop("_spread"), "keys")

    first = rows.groupBy("_part").agg(F.min("_key").alias("first"))
    # a rule with the very key may stand at the end of the range before; one that meets its part twice does no harm
    lengths = F.sequence(F.lit(1), F.least(F.length("first"), F.lit(max(longest, 1))))
    first = first.select("_part", F.explode(F.transform(lengths, lambda k: F.substring(F.col("first"), F.lit(1), k))).alias("_key"))
    carried = known.join(first, "_key").select("_part", "_key", F.lit(0).alias("_kind"), "_rule")
    rows = rows.unionByName(carried, allowMissingColumns=True)

    # ranges of whole parts: a part's rows meet in one task, in order
    rows = rows.repartitionByRange(n, "_part").sortWithinPartitions("_part", "_key", "_kind")
    of = {f.name: f.dataType.simpleString() for f in rows.schema}
    hits = rows.select("_part", "_key", "_kind", "_id", "host", "path", "_rule").mapInArrow(_sweep, f"_id {of['_id']}, host string, path string, _rule {of['_rule']}")
    every = hits.withColumn("_rows", F.lit(0)).unionByName(found.withColumn("_rows", F.lit(1)), allowMissingColumns=True)
    out = every.groupBy("_id", "host", "path").agg(F.max("_rule").alias("_rule"), F.sum("_rows").alias("_rows"))
    out = out.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_rows"))))
    return out.select(F.col("_id").alias(id_col), "host", "path", F.col("_rule.rule").alias("rule"), F.coalesce("_rule.verdict", F.lit(default)).alias("verdict"))
