"""Hard negatives by vantage-point trees over norm-augmented vectors.

A vector x of squared norm below M gets one more component, sqrt(M - |x|^2), and an anchor q gets 0: then the squared
distance of q and x is |q|^2 + M - 2 q.x. A window of scores is an annulus around the anchor, and higher scores come
nearer. A tree of vantage points, grown on a bounded sample, deals all rows to cells; each cell is stored in blocks with a
tree of their own, down to leaves of LEAF rows. The bounds that the vantage points give for each cell and leaf are those
of all its rows, so that nothing is missed.

A search goes nearest first. Anchors meet the nearest cell of their annulus; the scores found there shrink it, and the
cells that it still touches follow. Inside a block the leaves are taken by distance with the same shrinking.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, drop

#: Rows the upper tree is grown on, levels it has at most, rows of a block, rows of a leaf, anchors of a pack.
SAMPLE, LEVELS, BLOCK, LEAF, PACK = 4096, 10, 2048, 256, 256
#: Squared norms up to here take part: all scores then fit in a long.
MOST_NORM = 1 << 62
#: Squared norms up to here leave every sum of products exact in a double.
EXACT = 1 << 53


class Tree:
    """A complete tree of vantage points over augmented vectors; node i has the children 2 i + 1 (near) and 2 i + 2."""

    def __init__(self, most: int, vantage: np.ndarray, depth: int):
        self.most, self.depth, self.vantage = float(most), depth, vantage
        self.slack = 1e-6 * math.sqrt(self.most)  # more than distances lose to rounding
        self.path = np.zeros((2**depth, depth), np.int64)
        for level in range(depth):
            self.path[:, level] = 2**level - 1 + (np.arange(2**depth) >> (depth - level))

    @classmethod
    def grow(cls, x: np.ndarray, most: int, depth: int) -> tuple[Tree, np.ndarray]:
        """A tree over rows x whose nodes split at the median distance from one of their rows; with it its radii."""
        tree = cls(most, np.zeros((2**depth - 1, x.shape[1] + 1)), depth)
        points, radius = tree.augmented(x), np.zeros(2**depth - 1)
        at = np.zeros(len(x), np.int64)
        for node in range(2**depth - 1):
            own = np.flatnonzero(at == node)
            if len(own):
                tree.vantage[node] = points[own[0]]
                d = tree.apart(points[own], tree.vantage[node : node + 1])[:, 0]
                radius[node] = np.median(d)
                at[own] = 2 * node + 1 + (d > radius[node])
        return tree, radius

    def augmented(self, x: np.ndarray) -> np.ndarray:
        x = x.astype(np.float64)
        return np.concatenate([x, np.sqrt(np.maximum(self.most - (x * x).sum(axis=1), 0))[:, None]], axis=1)

    @staticmethod
    def apart(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Distances of all rows of a and b."""
        return np.sqrt(np.maximum((a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1)[None] - 2 * (a @ b.T), 0))

    def route(self, x: np.ndarray, radius: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The leaf of each row and its distances from the vantage points on the way."""
        points, at, way = self.augmented(x), np.zeros(len(x), np.int64), np.zeros((len(x), self.depth))
        for level in range(self.depth):
            v = self.vantage[at]
            way[:, level] = np.sqrt(np.maximum(((points - v) ** 2).sum(axis=1), 0))
            at = 2 * at + 1 + (way[:, level] > radius[at])
        return at - (2**self.depth - 1), way

    def bounds(self, q: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Least and greatest distance that the rows of each leaf can have from each anchor; low and high are the least and
        greatest distance of a leaf's rows from its vantage points."""
        q = np.concatenate([q.astype(np.float64), np.zeros((len(q), 1))], axis=1)
        least, most = np.zeros((len(q), 2**self.depth)), np.full((len(q), 2**self.depth), np.inf)
        d = self.apart(q, self.vantage) if self.depth else None
        for level in range(self.depth):
            to = d[:, self.path[:, level]]
            least = np.maximum(least, np.maximum(to - high[:, level], low[:, level] - to))
            most = np.minimum(most, to + high[:, level])
        return least, most

    def distance(self, norm: np.ndarray, score: np.ndarray) -> np.ndarray:
        """Of rows of the given score from anchors of the given squared norm; beyond all rows for a score that none has."""
        return np.sqrt(np.maximum(norm[:, None] + self.most - 2 * score.astype(np.float64), 0))


def _matrix(column, width: int) -> np.ndarray:
    """Vectors of an Arrow list column; a shorter one ends in zeros."""
    if len(column) == 0:
        return np.zeros((0, width), np.int64)
    size = np.diff(column.offsets.to_numpy())
    out = np.zeros((len(column), width), np.int64)
    out[np.arange(width) < size[:, None]] = column.flatten().to_numpy(zero_copy_only=False)
    return out


def _bytes(x: np.ndarray, kind: str = "<i8") -> bytes:
    return np.ascontiguousarray(x, kind).tobytes()


def _pack(table, width: int, most: int):
    """A block: its rows by leaf and id, and the tree over them."""
    import pyarrow as pa

    table = table.combine_chunks()
    x = _matrix(table.column("v").combine_chunks() if table.num_rows else [], width)
    ids, labels = table.column("id").to_numpy(), table.column("label").to_numpy()
    depth = max(0, math.ceil(math.log2(len(ids) / LEAF)))
    tree, radius = Tree.grow(x, most, depth)
    leaf, way = tree.route(x, radius)
    order = np.lexsort((ids, leaf))
    low, high = np.full((2**depth, depth), np.inf), np.full((2**depth, depth), -np.inf)
    np.minimum.at(low, leaf, way)
    np.maximum.at(high, leaf, way)
    size = np.bincount(leaf, minlength=2**depth)
    row = {
        "cell": table.column("cell")[0].as_py(), "depth": depth, "size": _bytes(size), "ids": _bytes(ids[order]), "labels": _bytes(labels[order]), "x": _bytes(x[order]),
        "vantage": _bytes(tree.vantage, "<f8"), "low": _bytes(low, "<f8"), "high": _bytes(high, "<f8"),
    }
    return pa.table({k: pa.array([v], pa.int32() if isinstance(v, int) else pa.binary()) for k, v in row.items()})


BLOCKS = "cell int, depth int, size binary, ids binary, labels binary, x binary, vantage binary, low binary, high binary"
PACKS = "cell int, n int, anchors binary, q_labels binary, q binary, top binary, floor binary"


class Index:
    """Cells and blocks of rows (id, label, v), each id once."""

    def __init__(self, rows: DataFrame):
        n, most, width = rows.agg(F.count("*"), F.max(F.aggregate("v", F.lit(0).cast("long"), lambda s, x: s + x * x)), F.max(F.size("v"))).first()
        self.n, self.most, self.width = n, int(most or 0), width or 0
        self.spark = rows.sparkSession
        depth = min(LEVELS, max(0, math.ceil(math.log2(max(n, 1) / BLOCK))))
        sample = [r[0] for r in rows.orderBy(F.xxhash64("id"), "id").limit(SAMPLE).select("v").collect()]
        x = np.zeros((len(sample), self.width), np.int64)
        for i, v in enumerate(sample):
            x[i, : len(v)] = v
        tree, radius = Tree.grow(x, self.most, depth)
        self.tree, width, most = tree, self.width, self.most

        def route(batches):
            import pyarrow as pa

            for b in batches:
                cell, way = tree.route(_matrix(b.column("v"), width), radius)
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(cell, pa.int32()), pa.array(list(way), pa.list_(pa.float64()))], [*b.schema.names, "cell", "way"])

        routed = cut(rows.mapInArrow(route, "id long, label long, v array<long>, cell int, way array<double>"), "routed")
        ends = [f(F.col("way")[i]).alias(f"{f.__name__}{i}") for f in (F.min, F.max) for i in range(depth)]
        cells = routed.groupBy("cell").agg(F.count("*").alias("size"), *ends)
        # at most 2 ** LEVELS rows
        self.low, self.high = np.full((2**depth, depth), np.inf), np.full((2**depth, depth), -np.inf)
        for r in cells.collect():
            for i in range(depth):
                self.low[r["cell"], i], self.high[r["cell"], i] = r[f"min{i}"], r[f"max{i}"]
        chunk = F.pmod(F.xxhash64("id"), F.ceil(F.col("size") / BLOCK)).alias("chunk")
        dealt = routed.drop("way").join(cells.select("cell", "size"), "cell").select("cell", chunk, "id", "label", "v")
        self.blocks = cut(dealt.groupBy("cell", "chunk").applyInArrow(lambda t: _pack(t, width, most), BLOCKS), "blocks")
        self.routed = routed

    def _packs(self, queries: DataFrame, first: bool) -> DataFrame:
        """For each cell that anchors of a batch must meet, a pack of these: the nearest cell of each, or all others."""
        tree, low, high, width = self.tree, self.low, self.high, self.width

        def run(batches):
            import pyarrow as pa

            for whole in batches:
                for begin in range(0, whole.num_rows, PACK):
                    b = whole.slice(begin, PACK)
                    q = _matrix(b.column("v"), width)
                    wide = max(map(len, b.column("top").to_pylist()), default=0)
                    top, floor, floor0 = (_matrix(b.column(c), wide) for c in ("top", "floor", "floor0"))
                    norm = (q.astype(np.float64) ** 2).sum(axis=1)
                    least, most = tree.bounds(q, low, high)
                    there = np.isfinite(low[:, 0]) if tree.depth else np.ones(1, bool)

                    def touched(floor, there=there, least=least, most=most, top=top, norm=norm):
                        out, near = np.zeros(least.shape, bool), np.full(least.shape, np.inf)
                        for w in range(top.shape[1]):
                            inner, outer = tree.distance(norm, top[:, w : w + 1]) - tree.slack, tree.distance(norm, floor[:, w : w + 1]) + tree.slack
                            hit = (top[:, w] >= floor[:, w])[:, None] & (least <= outer) & (most >= inner) & there
                            out |= hit
                            near = np.where(hit, np.minimum(near, np.maximum(least, inner)), near)
                        return out, near

                    wanted, near = touched(floor0)
                    near[np.arange(len(q)), b.column("cell").to_numpy()] -= tree.slack  # its own before others as near
                    nearest = np.zeros_like(wanted)
                    nearest[np.arange(len(q)), near.argmin(axis=1)] = True
                    wanted = wanted & nearest if first else touched(floor)[0] & ~nearest
                    out = []
                    for cell in np.flatnonzero(wanted.any(axis=0)):
                        i = np.flatnonzero(wanted[:, cell])
                        out.append([int(cell), len(i), *map(_bytes, (b.column("anchor").to_numpy()[i], b.column("label").to_numpy()[i], q[i], top[i], floor[i]))])
                    columns = list(zip(*out, strict=True)) or [[]] * 7
                    kinds = [pa.int32(), pa.int32(), *[pa.binary()] * 5]
                    names = ["cell", "n", "anchors", "q_labels", "q", "top", "floor"]
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

        return queries.select("anchor", "label", "v", "cell", "top", "floor", "floor0").mapInArrow(run, PACKS)

    def _found(self, queries: DataFrame, k: int, same: bool, first: bool) -> DataFrame:
        """(anchor, w, id, score): the first k rows of each block that an anchor meets, for each of its windows."""
        most, width = self.most, self.width

        def run(batches):
            import pyarrow as pa

            for b in batches:
                parts = [search(r, most, width, k, same) for r in b.to_pylist()]
                columns = [np.concatenate(c) if parts else np.zeros(0, np.int64) for c in (zip(*parts, strict=True) if parts else [()] * 4)]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["anchor", "w", "id", "score"])

        # packs are much larger than the anchors they come from, by which their size would be guessed: never broadcast
        return self._packs(queries, first).hint("merge").join(self.blocks, "cell").mapInArrow(run, "anchor long, w long, id long, score long")

    def first_rows(self, queries: DataFrame, k: int, same: bool) -> DataFrame:
        """(anchor, w, rank, id, score): the first k rows, by falling score, then id, of every window of `queries` (anchor, label,
        v, cell, top, floor) with score in [floor, top]; of the anchor's label without itself, or of other labels."""
        rank = F.row_number().over(Window.partitionBy("anchor", "w").orderBy(F.desc("score"), "id"))
        best = lambda df: df.withColumn("rank", rank).where(F.col("rank") <= k)
        queries = queries.withColumn("floor0", F.col("floor"))
        near = best(self._found(queries, k, same, True))
        if self.tree.depth == 0:
            return near
        near = cut(near, "near")
        reached = near.where(F.col("rank") == k).groupBy("anchor").agg(F.map_from_entries(F.collect_list(F.struct("w", "score"))).alias("reached"))
        rise = lambda x, w: F.coalesce(F.col("reached")[w.cast("long")], x)
        queries = queries.join(reached, "anchor", "left").withColumn("floor", F.transform("floor", rise)).drop("reached")
        return best(near.drop("rank").unionByName(self._found(queries, k, same, False)))


def search(r: dict, most: int, width: int, k: int, same: bool) -> tuple[np.ndarray, ...]:
    """Arrays of (anchor, window, id, score) with the first k rows of a block for each anchor of a pack, leaf by leaf, the nearest
    first; a leaf meets only those anchors whose annulus, as shrunk so far, may touch it."""
    longs = lambda c: np.frombuffer(r[c], "<i8")
    ids, labels, size = longs("ids"), longs("labels"), longs("size")
    anchors, q_labels = longs("anchors"), longs("q_labels")
    x, q = longs("x").reshape(len(ids), width), longs("q").reshape(len(anchors), width)
    top, floor = longs("top").reshape(len(anchors), -1), longs("floor").reshape(len(anchors), -1).copy()
    depth = r["depth"]
    tree = Tree(most, np.frombuffer(r["vantage"], "<f8").reshape(-1, width + 1), depth)
    low, high = (np.frombuffer(r[c], "<f8").reshape(2**depth, depth) for c in ("low", "high"))
    least, furthest = tree.bounds(q, low, high)
    norm = (q.astype(np.float64) ** 2).sum(axis=1)
    inner = tree.distance(norm, top) - tree.slack
    number = np.float64 if most <= EXACT else np.int64
    none = -np.inf if number is np.float64 else -MOST_NORM - 1
    qs, xs = q.astype(number), x.astype(number)
    score = np.full((*top.shape, k), none, number)
    which = np.zeros((*top.shape, k), np.int64)
    ends = np.cumsum(size)
    for leaf in np.argsort(least.min(axis=0, initial=np.inf), kind="stable"):
        if not size[leaf]:
            continue
        outer = tree.distance(norm, floor) + tree.slack
        live = (top >= floor) & (least[:, leaf, None] <= outer) & (furthest[:, leaf, None] >= inner)
        at = np.flatnonzero(live.any(axis=1))
        if not len(at):
            continue
        rows = slice(ends[leaf] - size[leaf], ends[leaf])
        s = qs[at] @ xs[rows].T
        fit = labels[rows] == q_labels[at, None]
        fit = fit & (ids[rows] != anchors[at, None]) if same else ~fit
        for w in range(top.shape[1]):
            on = np.flatnonzero(live[at, w])
            if not len(on):
                continue
            to = at[on]
            here = np.where(fit[on] & (s[on] <= top[to, w, None]) & (s[on] >= floor[to, w, None]), s[on], none)
            new, new_ids = np.full((len(on), k), none, number), np.zeros((len(on), k), np.int64)
            for i in range(k):  # the first of equal ones has the least id
                j = here.argmax(axis=1)
                new[:, i], new_ids[:, i] = here[np.arange(len(on)), j], ids[rows][j]
                if (new[:, i] == none).all():
                    break
                here[np.arange(len(on)), j] = none
            both, both_ids = np.concatenate([score[to, w], new], axis=1), np.concatenate([which[to, w], new_ids], axis=1)
            order = np.lexsort((both_ids, -both), axis=1)[:, :k]
            score[to, w], which[to, w] = np.take_along_axis(both, order, 1), np.take_along_axis(both_ids, order, 1)
            full = score[to, w, k - 1] != none
            floor[to[full], w] = score[to[full], w, k - 1].astype(np.int64)
    a, w, i = np.nonzero(score != none)
    return anchors[a], w, which[a, w, i], score[a, w, i].astype(np.int64)


def scaled(rows: DataFrame, id_col: str = "vec_id", label_col: str = "label", vec_col: str = "embedding", scale: float = 256.0) -> DataFrame:
    """(id, label, v): the rows that take part, with components floor(scale * x).

    Rows with a null id, label or vector, a null or non-finite component, or a scaled squared norm over 2^62 (whose scores
    need not fit in a long) take no part. Rows of one id count once, with the least label, then vector.
    """
    x = F.col(f"`{vec_col}`")
    finite = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) < float("inf")))
    rows = rows.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{label_col}`").cast("long").alias("label"), F.when(finite, F.transform(x, lambda c: F.floor(c.cast("double") * scale))).alias("v"))
    norm = F.aggregate("v", F.lit(0.0), lambda s, c: s + c.cast("double") * c.cast("double"))
    rows = rows.where(F.col("id").isNotNull() & F.col("label").isNotNull() & F.col("v").isNotNull() & (norm <= float(MOST_NORM)))
    return rows.groupBy("id").agg(F.min(F.struct("label", "v")).alias("r")).select("id", "r.label", "r.v")


def hard_negatives(rows: DataFrame, anchor: str, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) for the anchors among `rows` (id, label, v
    array<long>, each id once): those for which the SQL condition `anchor` holds.

    Scores are inner products, a shorter vector ending in zeros. An anchor's positives are its first rows of the same
    label; for each, the first rows of other labels with low % to high % of its score follow, ranked from 1. Higher
    scores come first, equal ones by smaller id. A positive of negative score has no such rows. Empty tables give no rows.

    The index is grown on SAMPLE rows and holds every row; the search is exact. A cell of many rows, also of equal ones, is
    cut into blocks of some BLOCK rows by id; anchors travel in packs of PACK, so that a task holds one pack and one block.
    """
    rows = cut(rows, "vectors")
    index = Index(rows)
    drop(rows)
    anchors = cut(index.routed.where(anchor).select(F.col("id").alias("anchor"), "label", "v", "cell").repartition("anchor"), "anchors")
    limit = F.lit(np.iinfo(np.int64).max)
    queries = anchors.select("*", F.array(limit).alias("top"), F.array(-limit).alias("floor"))
    best = cut(index.first_rows(queries, positives, True).select("anchor", F.col("rank").alias("p"), F.col("id").alias("positive"), F.col("score").alias("p_score")), "positives")

    # bounds of scores with 100 * score in [low * s, high * s], without a product that leaves a long
    share = lambda s, percent, up: F.expr(f"({s} div 100) * {percent} + (({s} % 100) * {percent} + {99 if up else 0}) div 100")
    windows = best.where("p_score >= 0").withColumns({"least": share("p_score", low, True), "most": share("p_score", high, False)})
    windows = windows.groupBy("anchor").agg(F.sort_array(F.collect_list(F.struct("p", "most", "least"))).alias("windows"))
    queries = anchors.join(windows, "anchor").select("anchor", "label", "v", "cell", F.col("windows.most").alias("top"), F.col("windows.least").alias("floor"), F.col("windows.p").alias("places"))
    places = cut(queries.select("anchor", F.posexplode("places").alias("w", "p")), "places")
    found = index.first_rows(queries.drop("places"), negatives, False)
    out = found.join(places, ["anchor", "w"]).join(best, ["anchor", "p"])
    return out.select(
        F.col("anchor").alias("anchor_id"), F.col("positive").alias("positive_id"), F.col("rank").cast("int").alias("rank"), F.col("id").alias("negative_id"),
        F.col("p_score").alias("positive_score"), F.col("score").alias("negative_score"),
    )
