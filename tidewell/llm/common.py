"""What the corpus operators share: reading, cutting lineage, prefix sums and components."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Java and Spark pattern of the white space that separates words in the contracts.
SPACE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: spark.checkpoint.dir. Only on one machine,
    where it is unset (tests), a folder of this process takes its place; a cluster without it is refused."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="tidewell-")
        atexit.register(shutil.rmtree, folder, True)
        found = f"file://{folder}"
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame, name: str = "cut") -> DataFrame:
    """df, written to the shared folder and read again: later stages start from files that outlive
    any executor, and each row is computed once."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop(df: DataFrame) -> None:
    """Delete the files of a table made by cut() that no later plan reads."""
    spark = df.sparkSession
    for file in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = spark._jvm.org.apache.hadoop.fs.Path(file)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def meet(left: DataFrame, right: DataFrame, on: str | list[str] | Column, how: str = "inner") -> DataFrame:
    """A join of tables that both grow with the input, by shuffles and merging. Left to itself Spark judges a table of cut()
    by its compressed files, before rows are repeated, and sends what seems small whole through the driver."""
    return left.join(right.hint("merge"), on, how)


def add_offsets(df: DataFrame, order: list[str], size: str | list[str], by: list[str] | None = None, out: str | list[str] = "start") -> DataFrame:
    """Add the sum of each `size` over all earlier rows of the group `by`, in the order of `order`, as `out`.

    Rows are range-partitioned by (by, order), summed within each partition, and each partition's
    total is carried to the later ones: no group passes through one task, however large. The
    result is a table in the shared folder, sorted within its files.
    """
    by, sizes, outs = by or [], [size] if isinstance(size, str) else size, [out] if isinstance(out, str) else out
    spark = df.sparkSession
    keys = [*by, *order]
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    part = cut(
        df.repartitionByRange(n, *keys).withColumn("_part", F.spark_partition_id()).sortWithinPartitions("_part", *keys),
        "ranges",
    )
    total = part.groupBy("_part", *by).agg(*[F.sum(c).alias(f"_total{i}") for i, c in enumerate(sizes)])
    w = Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    base = total.select("_part", *by, *[F.coalesce(F.sum(f"_total{i}").over(w), F.lit(0)).alias(f"_base{i}") for i in range(len(sizes))])
    inside = Window.partitionBy("_part", *by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    local = part.withColumns({f"_inside{i}": F.coalesce(F.sum(c).over(inside), F.lit(0)) for i, c in enumerate(sizes)})
    for c in ["_part", *by]:  # null is a group of its own
        base = base.withColumnRenamed(c, f"_b_{c}")
    same: Column = F.col("_part") == F.col("_b__part")
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"_b_{c}"))
    joined = local.join(base, same).withColumns({o: F.col(f"_base{i}") + F.col(f"_inside{i}") for i, o in enumerate(outs)})
    return joined.drop("_part", "_b__part", *[f"_{x}{i}" for x in ("inside", "base") for i in range(len(sizes))], *[f"_b_{c}" for c in by])


def connected_components(links: DataFrame) -> DataFrame:
    """(id, component): each id of `links` (a, b) with the smallest id reachable from it.

    Alternating large-star and small-star steps on the link table, until only stars are left. Each
    step lowers the neighbours of every id to its smallest neighbour; minima are aggregated before
    the shuffle and joined back, so that a hot id is split by the adaptive skew join.
    """
    pair = lambda x, y: F.struct(F.col(x).alias("a"), F.col(y).alias("b"))
    both = [pair("a", "b"), pair("b", "a")]

    def directed(edges: DataFrame) -> DataFrame:
        return edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()

    def star(edges: DataFrame, large: bool) -> DataFrame:
        """Large: greater neighbours of each id go to its smallest; small: smaller ones and the id itself do."""
        side = edges.select(F.inline(F.array(*both))) if large else edges
        least = side.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("k"), F.least("a", "m").alias("m"))
        hop = meet(side, least, F.col("a") == F.col("k"))
        if large:
            return directed(hop.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")))
        return directed(hop.select(F.inline(F.array(pair("b", "m"), pair("a", "m")))))

    def step(edges: DataFrame, large: bool) -> DataFrame:
        out = cut(star(edges, large), "links")
        drop(edges)
        return out

    def done(edges: DataFrame) -> bool:
        """Whether every id has one edge to an id that has none: only stars are left."""
        ends = edges.select(F.inline(F.array(F.struct(F.col("a").alias("id"), F.lit(1).alias("low"), F.lit(0).alias("high")), F.struct(F.col("b").alias("id"), F.lit(0).alias("low"), F.lit(1).alias("high")))))
        ends = ends.groupBy("id").agg(F.sum("low").alias("low"), F.sum("high").alias("high"))
        return ends.where("low > 1 or low > 0 and high > 0").isEmpty()

    now = cut(directed(links.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b"))), "links")
    while True:
        now = step(step(now, True), False)
        if done(now):
            break
    roots = now.select(F.col("b").alias("id")).distinct().select("id", F.col("id").alias("component"))
    return now.select(F.col("a").alias("id"), F.col("b").alias("component")).union(roots)


#: Bits of a membership map for each id, and of the largest map: 64 MB, however many ids there are.
BITS_EACH, MOST_BITS = 16, 1 << 29


def membership(ids: DataFrame) -> np.ndarray:
    """A bit map of a column of 64-bit hashes, made by Spark's bitmap aggregates: at most MOST_BITS bits reach the
    driver. It tells for sure only that a number is not there; an exact join follows its use. Beyond some 1e9
    numbers it fills up and filters less: that join then meets more rows, with the same result."""
    n = ids.count()
    bits = 1 << 15
    while bits < min(n * BITS_EACH, MOST_BITS):
        bits *= 2
    at = F.pmod(ids[ids.columns[0]], F.lit(bits)) + 1
    rows = ids.select(at.alias("at")).groupBy(F.bitmap_bucket_number("at").alias("b")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("at")).alias("m"))
    out = np.zeros(bits // 8, np.uint8)
    for r in rows.toLocalIterator():
        first = (r["b"] - 1) * 4096
        out[first : first + 4096] |= np.frombuffer(r["m"], np.uint8)
    return out


def maybe_in(map_: np.ndarray, ids: np.ndarray) -> np.ndarray:
    at = ids & (8 * len(map_) - 1)  # a power of two: the same as the positive remainder
    return (map_[at >> 3] >> (at & 7).astype(np.uint8)) & 1 > 0


def pack_set(s: np.ndarray) -> bytes:
    """A sorted set of 64-bit hashes."""
    return s.astype("<u8").tobytes()


def unpack_set(b) -> np.ndarray:
    return np.frombuffer(b, "<u8")


def stars(rows: DataFrame, pivots: int = 1) -> DataFrame:
    """(a, b): each id b of a group (key, id) with up to `pivots` of its ids a, those with the smallest hashes. These are
    aggregated before the shuffle; as the hash is of the id alone, groups of nearly the same ids mostly pick the same ones."""
    picks = [F.min_by("id", F.xxhash64(F.lit(i), "id")).alias(f"p{i}") for i in range(pivots)]
    chosen = rows.groupBy("key").agg(*picks).select("key", F.explode(F.array_distinct(F.array(*[f"p{i}" for i in range(pivots)]))).alias("a"))
    return rows.join(chosen, "key").where(F.col("id") != F.col("a")).select("a", F.col("id").alias("b"))
