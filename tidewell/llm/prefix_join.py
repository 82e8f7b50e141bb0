"""Exact similarity join of sets by their rarest shingles.

Shingles have one order, rare ones first. Of two sets with an intersection of at least p % of their union, the
first shingle in that order which both hold is among the first n - ceil(p n / 100) + 1 of each, so sets meet under
one of these shingles. Groups under a rare shingle give their pairs. Of those under a hot one, the ids that a
few stars don't join to the group's largest component are compared with the whole group on full sets, in blocks
dealt over many tasks (`block_pairs`).
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import connected_components, cut, drop, meet, stars, unpack_set

#: Counters of shingles that share one by hash: 4 MB for a task. They only tell which shingles come first.
COUNTERS = 1 << 22
#: Groups of up to this many ids give all their pairs; larger ones are split into blocks of about BLOCK ids.
SMALL, BLOCK = 12, 256
#: Ids of a large group that all others are compared with first.
PIVOTS = 4
#: Shingles of a block that are compared at once.
WIDTH = 4096


def _tokens(column) -> list[np.ndarray]:
    return [unpack_set(x.as_buffer()) for x in column]


def rarity(sets: DataFrame) -> np.ndarray:
    """The binary logarithm of the number of sets under each counter."""

    def run(batches):
        import pyarrow as pa

        for b in batches:
            if not b.num_rows:
                continue
            at, n = np.unique(np.concatenate(_tokens(b.column(0))) % np.uint64(COUNTERS), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(n, pa.int64())], ["at", "n"])

    counts = sets.select("set").mapInArrow(run, "at int, n long").groupBy("at").agg(F.sum("n").alias("n")).where("n > 1")
    found = counts.select("at", F.floor(F.log2("n")).cast("byte").alias("level")).toArrow()  # COUNTERS rows at most
    out = np.zeros(COUNTERS, np.uint8)
    out[found.column(0).to_numpy()] = found.column(1).to_numpy()
    return out


def _prefixes(sets: DataFrame, percent: int) -> DataFrame:
    """(key, id, component, n, pos): the shingles under which each set meets others, and their places in its order."""
    shared = sets.sparkSession.sparkContext.broadcast(rarity(sets))  # COUNTERS bytes

    def run(batches):
        import pyarrow as pa

        for b in batches:
            for k in range(0, b.num_rows, 500):
                part = b.slice(k, 500)
                keys = []
                tokens = _tokens(part.column(2))
                for t in tokens:
                    first = np.lexsort((t, shared.value[t % np.uint64(COUNTERS)]))
                    keys.append(t[first[: len(t) - -(-percent * len(t) // 100) + 1]])
                n = np.array([len(x) for x in keys], np.int64)
                at = pa.array(np.repeat(np.arange(len(n)), n))
                size = np.repeat(np.array([len(t) for t in tokens], np.int64), n)
                pos = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
                cols = [pa.array(np.concatenate(keys).view(np.int64)), part.column(0).take(at), part.column(1).take(at), pa.array(size), pa.array(pos)]
                yield pa.RecordBatch.from_arrays(cols, ["key", "id", "component", "n", "pos"])

    return sets.select("id", "component", "set").mapInArrow(run, "key long, id long, component long, n long, pos long")


def _small_pairs(rows: DataFrame, percent: int) -> DataFrame:
    """(a, b) of small groups whose sizes and places allow the similarity, if no shingle before is common."""
    groups = rows.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("id", "component", "n", "pos"))).alias("m"))
    both = groups.select(F.posexplode("m").alias("i", "x"), "m").select("x", F.explode(F.expr("slice(m, i + 2, size(m))")).alias("y"))
    left = F.least(F.col("x.n") - F.col("x.pos"), F.col("y.n") - F.col("y.pos"))
    enough = left * (100 + percent) >= percent * (F.col("x.n") + F.col("y.n"))
    return both.where(enough & (F.col("x.component") != F.col("y.component"))).select(F.col("x.id").alias("a"), F.col("y.id").alias("b"))


def _compare(percent: int, shingles: Callable[[bytes], np.ndarray]):
    """The similar pairs of different components between blocks i and j of a group."""

    def run(table):
        import pyarrow as pa

        own, ids, component = (table.column(c).to_numpy() for c in ("own", "id", "component"))
        i, j = table.column("i")[0].as_py(), table.column("j")[0].as_py()
        left, right = np.flatnonzero(own == i), np.flatnonzero(own == j)
        tokens = [shingles(t) for t in table.column("text").to_pylist()]
        n = np.array([len(t) for t in tokens], np.int64)
        owner = np.repeat(np.arange(len(n)), n)
        _, number, count = np.unique(np.concatenate(tokens), return_inverse=True, return_counts=True)
        common = count > 1  # others add to no intersection
        number, owner = (np.cumsum(common) - 1)[number[common[number]]], owner[common[number]]
        order = np.argsort(number, kind="stable")
        number, owner = number[order], owner[order]
        same = np.zeros((len(left), len(right)), np.float32)
        for k in range(0, int(common.sum()), WIDTH):
            lo, hi = np.searchsorted(number, [k, k + WIDTH])
            held = np.zeros((len(n), WIDTH), np.float32)
            held[owner[lo:hi], number[lo:hi] - k] = 1
            same += held[left] @ held[right].T
        good = 100 * same >= percent * (n[left][:, None] + n[right][None, :] - same)
        good &= component[left][:, None] != component[right][None, :]
        if i == j:
            good &= left[:, None] < right[None, :]
        links = spanning(left[(at := np.nonzero(good))[0]].tolist(), right[at[1]].tolist())
        x, y = (ids[np.array([link[k] for link in links], np.int64)] for k in (0, 1))
        return pa.table({"a": pa.array(np.minimum(x, y), pa.int64()), "b": pa.array(np.maximum(x, y), pa.int64())})

    return run


def spanning(x: list[int], y: list[int]) -> list[tuple[int, int]]:
    """Those of the links between x and y, one after another, that join what earlier ones don't."""
    up: dict[int, int] = {}

    def root(i: int) -> int:
        while (p := up.get(i, i)) != i:
            up[i] = i = up.get(p, p)
        return i

    out = []
    for i, j in zip(x, y, strict=True):
        a, b = root(i), root(j)
        if a != b:
            up[a] = b
            out.append((i, j))
    return out


def block_pairs(rows: DataFrame, content: DataFrame, percent: int, shingles: Callable[[bytes], np.ndarray]) -> DataFrame:
    """(a, b): similar pairs of different components of large groups (key, id, component), by the texts of content (id, text):
    as many as join what similar pairs join. The ids outside of a group's largest component are compared with all of it,
    block by block."""
    most = rows.groupBy("key", "component").agg(F.count("*").alias("k"))
    most = most.groupBy("key").agg(F.max_by("component", "k").alias("main"), F.max("k").alias("inside"), F.sum("k").alias("n"))
    blocks = lambda n: F.ceil(n / F.lit(BLOCK)).cast("long")
    most = most.select("key", "main", blocks(F.col("inside")).alias("mains"), blocks(F.col("n") - F.col("inside")).alias("others"))
    placed = rows.join(most, "key").withColumn("other", F.col("component") != F.col("main"))
    spread = lambda n: F.pmod(F.xxhash64("id"), n)
    placed = placed.withColumn("own", F.when(F.col("other"), spread(F.col("others"))).otherwise(-1 - spread(F.col("mains"))))
    pair = lambda i, j: F.struct(i.alias("i"), j.alias("j"))
    zero, one, own = F.lit(0).cast("long"), F.lit(1).cast("long"), F.col("own")
    with_others = F.transform(F.sequence(zero, F.col("others") - one), lambda k: pair(F.least(own, k), F.greatest(own, k)))
    with_mains = F.transform(F.sequence(-F.col("mains"), -one), lambda k: pair(own, k))
    of_mains = F.transform(F.sequence(zero, F.col("others") - one), lambda k: pair(k, own))
    dealt = placed.select("key", "id", "component", "own", F.inline(F.when(F.col("other"), F.concat(with_others, with_mains)).otherwise(of_mains)))
    return meet(dealt, content.select("id", "text"), "id").groupBy("key", "i", "j").applyInArrow(_compare(percent, shingles), "a long, b long")


def similar_pairs(
    sets: DataFrame, content: DataFrame, percent: int, known: DataFrame, verify: Callable[[DataFrame], DataFrame], shingles: Callable[[bytes], np.ndarray]
) -> DataFrame:
    """Pairs (a < b) that with the components `known` (id, component) join all ids of `sets` (id, set), whose texts are in
    content, that similar pairs join: those that are similar and of different components, and some more candidates.

    verify(pairs) keeps the similar ones of some pairs. The result is a table in the shared folder.
    """
    with_component = lambda rows, c: meet(rows.drop("component"), c, "id", "left").withColumn("component", F.coalesce("component", "id"))
    nodes = cut(_prefixes(with_component(sets, known), percent), "prefixes")

    def open_groups(rows: DataFrame) -> DataFrame:
        c = F.col("component")
        return rows.groupBy("key").agg(F.count("*").alias("group"), F.min(c).alias("lo"), F.max(c).alias("hi")).where("lo <> hi").select("key", "group")

    several = cut(nodes.join(open_groups(nodes), "key"), "several")
    drop(nodes)
    out = _small_pairs(several.where(F.col("group") <= SMALL), percent)
    large = cut(several.where(F.col("group") > SMALL).select("key", "id", "component").distinct(), "hot")
    written = [several, large]
    if not large.isEmpty():
        near = cut(verify(stars(large.select("key", "id"), PIVOTS).distinct()), "near")
        all_known = known.select(F.col("id").alias("a"), F.col("component").alias("b"))
        joined = cut(connected_components(all_known.union(near)), "joined")
        now = cut(with_component(large, joined), "hot")
        left = cut(now.join(open_groups(now), "key", "left_semi").select("key", "id", "component"), "open")
        out = out.union(near)
        if not left.isEmpty():
            out = out.union(block_pairs(left, content, percent, shingles))
        written += [near, joined, now, left]
    pairs = cut(out.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct(), "similar")
    for df in written:
        drop(df)
    return pairs
