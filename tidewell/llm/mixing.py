"""Mixing sources to target weights by fixed-length blocks.

The words of each source, in the order of its documents, are packed into blocks of equal length, shorter
ones where few words are to be drawn. The slots of a source are drawn over the output shards, multinomially
and all shards alike, so each shard's counts of the sources are; slots are numbered within their source and
mapped to blocks by a pseudorandom permutation for each pass over the source; blocks join by index.

Sources are rows of a table all the way, however many there are: a source's draws are made from its number, first
over ranges of shards, then over the shards of a range.
"""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import WORD, add_offsets, cut

#: Words of a block, and slots that a source with a smaller target gets at least, by shorter blocks: these bound what
#: rounding to whole slots and the shorter last block leave between a source's target and what is taken.
BLOCK, LEAST_SLOTS = 64, 32
#: Slots of an output shard on average, and shards of a range.
SHARD, RANGE = 4096, 4096
#: Weights of the sources in order, repeating; share of all words that is drawn; most passes over a source.
WEIGHTS, SHARE, PASSES = (5, 2, 1), 1.5, 2
#: Rows that a task of draws makes at once.
ROWS = 1 << 16
#: Characters of stretches that a task gives back at once, unless one has more.
CHARS = 1 << 20


def targets(sizes: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE, passes: int = PASSES) -> DataFrame:
    """(source, source_no, source_size, target) from rows (source, size).

    Sources are numbered by code point, null last. What is shared goes by weight, but no target is
    above `passes` times its source's size: sources sorted by that bound over their weight are filled
    up to a common level, those at their bound first. The sums over earlier sources go by ranges.
    """
    total = sizes.groupBy("source").agg(F.sum("size").cast("long").alias("source_size"))
    numbered = add_offsets(total.withColumns({"last": F.col("source").isNull(), "one": F.lit(1)}), ["last", "source"], "one", out="source_no")
    weight = F.get(F.array(*[F.lit(float(w)) for w in weights]), F.col("source_no") % len(weights))
    out = numbered.withColumns({"weight": weight, "most": F.lit(float(passes)) * F.col("source_size")}).withColumn("ratio", F.col("most") / F.col("weight"))
    out = add_offsets(out.drop("last", "one"), ["ratio", "source_no"], ["most", "weight"], out=["most_before", "weight_before"])
    words, weight_sum = out.agg(F.sum("source_size"), F.sum("weight")).first()
    out = out.withColumn("level", (share * (words or 0) - F.col("most_before")) / ((weight_sum or 0.0) - F.col("weight_before")))
    reached = out.where("ratio > level").agg(F.min(F.struct("ratio", "source_no", "level"))).first()[0]  # one row
    target = F.least(F.col("most"), reached["level"] * F.col("weight")) if reached else F.col("most")
    return out.select("source", F.col("source_no").cast("long").alias("source_no"), "source_size", target.alias("target"))


def permute(x: np.ndarray, n: np.ndarray, key: np.ndarray) -> np.ndarray:
    """Images of x under a pseudorandom permutation of range(n), another for each key: Feistel rounds on
    the next even power of two, walked until the image is below n."""
    half = np.maximum(1, (np.ceil(np.log2(np.maximum(n, 2))) + 1) // 2).astype(np.uint64)
    mask = (np.uint64(1) << half) - np.uint64(1)
    out, todo = x.astype(np.uint64), np.arange(len(x))
    while len(todo):
        h, m, k = half[todo], mask[todo], key[todo].astype(np.uint64)
        left, right = out[todo] >> h, out[todo] & m
        for r in range(6):
            f = (right + k * np.uint64(0x9E3779B97F4A7C15) + np.uint64(r + 1)) * np.uint64(0xBF58476D1CE4E5B9)
            f = (f ^ (f >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
            left, right = right, left ^ ((f ^ (f >> np.uint64(32))) & m)
        out[todo] = (left << h) | right
        todo = todo[out[todo] >= n[todo].astype(np.uint64)]
    return out.astype(np.int64)


def cuts(block: int = BLOCK) -> dict[str, Column]:
    """Words of a block, blocks and slots of each source, one after another: the slots' words come to the target on average."""
    size, length = F.col("source_size"), F.col("length")
    up = lambda x, y: F.ceil(x / y)
    least = F.greatest(F.least(F.floor(F.col("target") / LEAST_SLOTS), F.lit(block)), F.lit(1))
    even = F.greatest(up(size, F.greatest(up(size, least), F.lit(1))), F.lit(1))  # the same number of blocks, as equal as can be
    slots = F.least(F.rint(F.col("target") * F.col("blocks") / F.greatest(size, F.lit(1))).cast("long"), PASSES * F.col("blocks"))
    return {"length": even.cast("long"), "blocks": up(size, length).cast("long"), "slots": slots}


def drawn(seed: list[int], n: int, places: int) -> tuple[np.ndarray, np.ndarray]:
    """(place, count) of the places that get any of n slots, drawn multinomially over equal places."""
    rng = np.random.default_rng(seed)
    if n < places:
        return np.unique(rng.integers(0, places, n), return_counts=True)
    count = rng.multinomial(n, np.full(places, 1 / places))
    at = np.flatnonzero(count)
    return at, count[at]


def _draws(rows: DataFrame, seed: int, level: int) -> DataFrame:
    """(source_no, blocks, place, first, n): the slots `n` from number `first` on of rows, each over its `places` places."""

    def run(batches):
        import pyarrow as pa

        names = ["source_no", "blocks", "place", "first", "n"]
        for b in batches:
            for source, blocks, place, first, n, places in zip(*(c.to_pylist() for c in b.columns), strict=True):
                at, count = drawn([seed, level, source, place], n, places)
                start = first + np.cumsum(count) - count
                for k in range(0, len(at), ROWS):
                    own = [at[k : k + ROWS] + place * RANGE, start[k : k + ROWS], count[k : k + ROWS]]
                    fixed = [np.full(len(own[0]), source), np.full(len(own[0]), blocks)]
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in fixed + own], names)

    kinds = "source_no long, blocks long, place long, first long, n long"
    return rows.select("source_no", "blocks", "place", "first", "n", "places").mapInArrow(run, kinds)


def _slots(rows: DataFrame, seed: int) -> DataFrame:
    """(shard, source_no, turn, block) of each slot of rows (source_no, blocks, place, first, n)."""

    def run(batches):
        import pyarrow as pa

        for b in batches:
            source, blocks, shard, first, n = (b.column(i).to_numpy() for i in range(5))
            ends = np.cumsum(n)
            lo = 0
            while lo < len(n):
                hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + ROWS, "right")))
                at = np.repeat(np.arange(lo, hi), n[lo:hi])
                slot = np.arange(len(at)) - np.repeat(ends[lo:hi] - n[lo:hi] - (ends[lo - 1] if lo else 0), n[lo:hi]) + first[at]
                turn, place = np.divmod(slot, blocks[at])
                key = (np.uint64(seed) << np.uint64(56)) + (source[at].astype(np.uint64) << np.uint64(8)) + turn.astype(np.uint64)
                columns = [shard[at], source[at], turn, permute(place, blocks[at], key)]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["shard", "source_no", "turn", "block"])
                lo = hi

    return rows.mapInArrow(run, "shard long, source_no long, turn long, block long")


class Mix:
    """A drawn mix of documents (source, size, ...): its sources, its slots and the documents' pieces."""

    def __init__(self, sizes: DataFrame, order: list[str], block: int = BLOCK, seed: int = 7):
        self.spark: SparkSession = sizes.sparkSession
        self.seed = seed
        sources = targets(sizes)
        for name, column in cuts(block).items():
            sources = sources.withColumn(name, column)
        self.sources = cut(sources, "sources")
        named = self.sources.withColumnRenamed("source", "_s").drop("slots", "blocks")
        self.documents = sizes.join(named, sizes["source"].eqNullSafe(F.col("_s"))).drop("_s")
        self.placed = add_offsets(self.documents.where("size > 0"), order, "size", by=["source_no"])

    def slots(self) -> DataFrame:
        """(shard, source_no, turn, block): every slot of the mix."""
        total = self.sources.agg(F.sum("slots")).first()[0] or 0
        shards = max(1, total // SHARD)
        ranges = -(-shards // RANGE)
        some = self.sources.where("slots > 0").select("source_no", "blocks", F.lit(0).cast("long").alias("place"), F.lit(0).cast("long").alias("first"), F.col("slots").alias("n"))
        if ranges > 1:
            some = _draws(some.withColumn("places", F.lit(ranges)), self.seed, 0).repartition("source_no", "place")
        each = _draws(some.withColumn("places", F.lit(RANGE if ranges > 1 else shards)), self.seed, 1)
        return _slots(each.repartition("source_no", "place"), self.seed)

    def pieces(self) -> DataFrame:
        """The placed documents with one row for each block they reach: `block`, and `begin` and `stop`, their
        words in it."""
        last = F.floor((F.col("start") + F.col("size") - 1) / F.col("length"))
        out = self.placed.withColumn("block", F.explode(F.sequence(F.floor(F.col("start") / F.col("length")), last)))
        begin = F.greatest(F.col("block") * F.col("length") - F.col("start"), F.lit(0))
        stop = F.least((F.col("block") + 1) * F.col("length") - F.col("start"), F.col("size"))
        return out.withColumns({"begin": begin, "stop": stop})

    def picked(self) -> DataFrame:
        """pieces() with `picks`, the number of slots that took their block."""
        taken = self.slots().groupBy("source_no", "block").agg(F.count("*").alias("picks"))
        # the draws grow from a row for each source: without the hint they would be taken for small and be broadcast
        return self.pieces().join(taken.hint("merge"), ["source_no", "block"])


def word_count(text: str = "text"):
    return F.coalesce(F.size(F.regexp_extract_all(text, F.lit(WORD), F.lit(0))), F.lit(0)).cast("long")


def mixed_sizes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """(doc_id, size, source_size, target, taken) for each row of docs: `taken` is the number of words that the
    mix takes from it, repeats counted, at most twice its size.

    A null or empty text has no words; a null source is the last source; a table without words gives
    targets of 0. Repeated ids are rows of their own, packed after each other. An empty table gives no rows;
    other columns don't pass. A very long text reaches many blocks, a row for each.
    """
    text = F.col(f"`{text_col}`")
    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{source_col}`").alias("source"), word_count(f"`{text_col}`").alias("size"), F.xxhash64(text).alias("tie"))
    mix = Mix(cut(rows, "sizes"), ["doc_id", "tie"])
    keys = ["doc_id", "source_no", "start", "size", "source_size", "target"]
    # every placed document reaches a block, so only the count of picks may be missing
    none = mix.placed.select(*keys, F.lit(0).cast("long").alias("n"))
    some = mix.picked().select(*keys, ((F.col("stop") - F.col("begin")) * F.col("picks")).cast("long").alias("n"))
    taken = none.union(some).groupBy(*keys).agg(F.sum("n").alias("taken")).drop("source_no", "start")
    empty = mix.documents.where("size = 0").select("doc_id", "size", "source_size", "target", F.lit(0).cast("long").alias("taken"))
    return taken.select("doc_id", "size", "source_size", "target", "taken").union(empty)


def mixed_documents(docs: DataFrame, text_col: str = "text", source_col: str = "source", order_col: str = "doc_id", chars_col: str = "n_chars") -> DataFrame:
    """The mix as rows with the columns of docs, whatever their names: for each pass over a document, the stretches of its
    text that taken blocks cover, each a row with the text from its first to its last word (the whole text if all is
    taken). Nulls, repeats and empty tables: as in mixed_sizes(); rows without words give none."""
    kept = docs.columns
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.struct(*[F.col(f"`{c}`") for c in kept]).alias("doc"))
    rows = cut(rows, "documents")
    sizes = rows.select("row", F.col(f"doc.`{source_col}`").alias("source"), F.col(f"doc.`{order_col}`").alias("by"), word_count(f"doc.`{text_col}`").alias("size"))
    mix = Mix(cut(sizes, "sizes"), ["by", "row"])
    # consecutive blocks with a pick for the pass are one stretch
    each = mix.picked().select("row", "size", "block", "begin", "stop", F.explode(F.sequence(F.lit(1), F.col("picks"))).alias("turn"))
    w = Window.partitionBy("row", "turn").orderBy("block")
    each = each.withColumn("run", F.col("block") - F.row_number().over(w))
    runs = each.groupBy("row", "turn", "run").agg(F.min("begin").alias("begin"), F.max("stop").alias("stop"), F.min("size").alias("size"))
    runs = runs.groupBy("row", "size").agg(F.array_sort(F.collect_list(F.struct("turn", "begin", "stop"))).alias("runs"))
    others = F.struct(*[F.col(f"doc.`{c}`") for c in kept if c not in (text_col, chars_col)]).alias("others")
    part = _stretches(rows.join(runs, "row").select(F.col(f"doc.`{text_col}`").alias("text"), "runs.begin", "runs.stop", "size", others))
    made = {text_col: F.col("part"), chars_col: F.length("part").cast("long")}
    return part.select(*[made.get(c, F.col(f"others.`{c}`")).alias(c) for c in kept])


def stretch(text: str, begin: int, stop: int, size: int) -> str:
    """The words begin to stop of the text's `size` words, with the white space between them; the whole text if these are all."""
    if begin == 0 and stop == size:
        return text
    first = last = 0
    for i, m in enumerate(re.finditer(WORD, text)):
        if i == begin:
            first = m.start()
        if i == stop - 1:
            last = m.end()
            break
    return text[first:last]


def _stretches(rows: DataFrame) -> DataFrame:
    """(others, part) for each stretch of rows (text, begin, stop, size, others), whose begin and stop are arrays. A text goes to
    Python once, however many stretches it has, and these come back as soon as they have CHARS characters."""

    def run(batches):
        import pyarrow as pa

        for b in batches:
            at, out, held = [], [], 0
            for k in range(b.num_rows):
                text, begin, stop, size = (b.column(i)[k].as_py() for i in range(4))
                for x, y in zip(begin, stop, strict=True):
                    at.append(k)
                    out.append(stretch(text, x, y, size))
                    held += len(out[-1])
                    if held >= CHARS:
                        yield pa.RecordBatch.from_arrays([b.column(4).take(pa.array(at)), pa.array(out, pa.string())], ["others", "part"])
                        at, out, held = [], [], 0
            if at:
                yield pa.RecordBatch.from_arrays([b.column(4).take(pa.array(at)), pa.array(out, pa.string())], ["others", "part"])

    return rows.mapInArrow(run, T.StructType([rows.schema["others"], T.StructField("part", T.StringType())]))
