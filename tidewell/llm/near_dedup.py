"""Near duplicates of documents by a chosen-path similarity join.

Documents are sets of word shingles; texts of equal words are one unit. Several independent trees branch
the units by minwise tokens: a path's hash picks which minwise value of a document extends it, and now
and then a second one, so that for a pair at the threshold about one common child is expected at each
node. Small nodes are compared exhaustively; the members of large ones are confirmed against a hub, and
where that leaves several components, by an exact join on their rarest shingles. Every link is
confirmed on full sets, and documents are grouped by connected components.
"""

from __future__ import annotations

from functools import lru_cache, partial

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import connected_components, cut, meet
from .fuzzy import UNITS, Fresh, cluster, first_places, later, wanted
from .hashing import mix, runs, shingle_sets, shingles, words

#: Minwise values of a document from which paths choose.
VALUES = 128
#: Levels of a tree.
LEVELS = 4
#: Independent trees. A pair at similarity 0.8 shares a node after 4 levels of one tree with probability
#: 0.58, so 10 trees miss it with probability 2e-4, and one at 0.85 with probability 4e-7.
TREES = 10

_U = np.uint64


def number(h: np.ndarray) -> int:
    """A 64-bit number of a text by its words' hashes."""
    import xxhash

    return xxhash.xxh3_64_intdigest(h.tobytes()) - (1 << 63)


@lru_cache(maxsize=1)
def _families(values: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20_240_901)
    return rng.integers(1, 1 << 32, values, np.uint64).astype(np.uint32) | np.uint32(1), rng.integers(0, 1 << 32, values, np.uint64).astype(np.uint32)


def minwise(s: np.ndarray, values: int) -> np.ndarray:
    """The least value of the set under each of `values` hash functions, 32 bits each."""
    a, b = _families(values)
    low, out = mix(s).astype(np.uint32), np.full(values, 0xFFFFFFFF, np.uint32)
    for k in range(0, len(low), 2048):
        part = low[k : k + 2048]
        h = part[None, :] * a[:, None] + b[:, None]
        h ^= h >> np.uint32(15)
        h *= np.uint32(0x2C1B3C6D)
        out = np.minimum(out, h.min(axis=1))
    return out


def _step(path: np.ndarray, sketch: np.ndarray, which: int) -> np.ndarray:
    """The child of each path: the minwise value that the path's hash picks."""
    pick = (mix(path + _U(7919 * which)) % _U(sketch.shape[1])).astype(np.int64)
    value = sketch[np.arange(len(path)), pick].astype(np.uint64)
    return mix(path * _U(0x9E3779B97F4A7C15) + (value << _U(8)) + _U(which))


def grow(path: np.ndarray, owner: np.ndarray, sketch: np.ndarray, levels: int) -> tuple[np.ndarray, np.ndarray]:
    """Paths `levels` further down, each with its owner (row of sketch). A quarter of the nodes, picked by
    their hash, branch to a second child: 1.25 children a node, one over the threshold."""
    for _ in range(levels):
        second = (mix(path ^ _U(0x5851F42D4C957F2D)) & _U(3)) == 0
        child = _step(path, sketch[owner], 1)
        more = _step(path[second], sketch[owner[second]], 2)
        path, owner = np.concatenate([child, more]), np.concatenate([owner, owner[second]])
    return path, owner


def nodes(sketch: np.ndarray, trees: int) -> list[np.ndarray]:
    """The nodes that each row of minwise values reaches after LEVELS levels of every tree."""
    rows = len(sketch)
    path, owner = grow(np.tile(mix(np.arange(1, trees + 1, dtype=np.uint64)), rows), np.repeat(np.arange(rows), trees), sketch, LEVELS)
    order = np.argsort(owner, kind="stable")
    return np.split(path[order].view(np.int64), np.cumsum(np.bincount(owner, minlength=rows))[:-1])


def _units(rows: DataFrame, size: int, trees: int) -> DataFrame:
    """UNITS of rows (row, doc_id, text): one for each document with words; without words or id a place without unit."""

    def run(batches):
        import pyarrow as pa

        names = ["row", "doc_id", "pos", "size", "n", "unit", "keys", "copy"]
        for b in batches:
            k = b.num_rows
            if not k:
                continue
            row, doc = b.column(0).to_numpy(), np.array(b.column(1).fill_null(np.iinfo(np.int64).min))
            has_id = b.column(1).is_valid().to_numpy(zero_copy_only=False)
            unit, n, sketch = np.zeros(k, np.int64), np.zeros(k, np.int32), np.zeros((k, VALUES), np.uint32)
            for i, t in enumerate(b.column(2)):
                h = words(t.as_py().encode("utf-8", "surrogatepass"))[0]
                if len(h):
                    s = np.unique(runs(h, size))
                    unit[i], n[i] = number(h), len(s)
                    sketch[i] = minwise(s, VALUES)
            known = has_id & (n > 0)
            zero = np.zeros(k, np.int64)
            copy = np.zeros(k, bool)
            at = np.flatnonzero(known)
            copy[at] = later(doc[at], row[at], zero[at], unit[at])
            keyed = np.flatnonzero(known & ~copy)
            found = nodes(sketch[keyed], trees) if len(keyed) else []
            offsets = np.zeros(k + 1, np.int32)
            offsets[keyed + 1] = [len(x) for x in found]
            flat = pa.array(np.concatenate(found) if found else np.zeros(0, np.int64))
            without = np.ones(k + 1, bool)
            without[keyed], without[k] = False, False
            keys = pa.ListArray.from_arrays(pa.array(np.cumsum(offsets, dtype=np.int32), mask=without), flat)
            columns = [b.column(0), b.column(1), pa.array(zero.astype(np.int32)), pa.array(np.ones(k, np.int32)), pa.array(n), pa.array(unit, mask=~known), keys, pa.array(copy)]
            yield pa.RecordBatch.from_arrays(columns, names)

    return rows.mapInArrow(run, UNITS)


def _content(batches, maybe):
    """(id, text) of batches of texts: those whose number may be wanted."""
    import pyarrow as pa

    fresh = Fresh()
    for b in batches:
        texts = [t.as_py().encode("utf-8", "surrogatepass") for t in b.column(0)]
        numbers = np.array([number(words(t)[0]) for t in texts], np.int64)
        at = fresh(np.flatnonzero(maybe(numbers)), numbers)
        yield pa.RecordBatch.from_arrays([pa.array(numbers[at]), pa.array([texts[i] for i in at], pa.binary())], ["id", "text"])


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5, percent: int = 80, trees: int = TREES
) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for each row of docs.

    Documents whose sets of `size`-word shingles (lower case for A-Z; the whole text if it has fewer
    words) have an intersection of at least `percent` % of their union are linked; component_id is
    the smallest id that links lead to, kept tells whether it is the row's own. Rows without words or
    with a null text have an empty set and are linked with nothing. Rows that share an id are one
    document with several texts: what links one links all, and each row is kept or not alike. Rows
    with a null id get a null component and are kept. An empty table gives no rows; other columns don't
    pass. Very long texts are taken whole: a task holds the shingles of one text at a time.
    """
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))
    units = _units(rows.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text"), size, trees)
    marked = cut(first_places(units), "documents")
    first = marked.where("first").select(F.col("unit").alias("id"), "n", "keys")
    members = cluster(first, lambda ids: wanted(rows.select("text"), ids, _content), percent, partial(shingles, size=size), partial(shingle_sets, size=size))
    # the smallest id of each unit, then of each component
    home = meet(marked.where("first").select("unit", "doc_id"), members.withColumnRenamed("id", "unit"), "unit", "left")
    least = home.where("component is not null").groupBy("component").agg(F.min("doc_id").alias("least"))
    home = home.join(least, "component", "left").select("unit", F.coalesce("least", "doc_id").alias("component_id"))
    out = marked.select("doc_id", F.col("n").cast("long").alias("n_shingles"), "unit").join(home, "unit", "left").select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))
    repeated = marked.where("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("k")).where("k > 1").select("doc_id")
    if not repeated.isEmpty():  # all rows of such an id belong together
        out = cut(out, "placed")
        of_id = out.join(repeated, "doc_id", "left_semi").groupBy("doc_id").agg(F.min("component_id").alias("of_id"))
        links = out.join(of_id, "doc_id").select(F.col("component_id").alias("a"), F.col("of_id").alias("b")).where("a <> b")
        joined = connected_components(links).select(F.col("id").alias("component_id"), F.col("component").alias("joined"))
        out = out.join(of_id, "doc_id", "left").withColumn("component_id", F.coalesce("of_id", "component_id")).join(joined, "component_id", "left")
        out = out.select("doc_id", "n_shingles", F.coalesce("joined", "component_id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("component_id") == F.col("doc_id"), F.lit(True)))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """The rows of docs that near_duplicates() keeps, with their columns, whatever their names; of repeated rows of one id
    all stay. Nulls, empty texts and empty tables: as there."""
    kept = docs.columns
    gone = near_duplicates(docs, id_col, text_col, **how).where("not kept").select(F.col("doc_id").alias("gone")).distinct()
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in kept]).alias("row"))
    return rows.join(gone, F.col(f"row.`{id_col}`").cast("long") == F.col("gone"), "left_anti").select("row.*")
