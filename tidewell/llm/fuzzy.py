"""Near-duplicate units (documents, lines, passages): what the three operators share.

A unit has a 64-bit number and keys (bands, or nodes of trees). Units that share a key are candidates,
are confirmed on the full shingle sets of their texts and grouped by distributed connected components.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import connected_components, cut, drop, maybe_in, meet, membership, pack_set, stars
from .hashing import flat
from .prefix_join import block_pairs, similar_pairs

#: Groups of a key of up to this many units give all their pairs.
SMALL = 12
#: Groups of up to this many units are compared block by block where several components are left of them; larger ones are
#: joined by their rarest shingles before.
LARGE = 4096
#: Bytes of texts of pairs that are compared at once, unless one pair has more.
CHUNK = 1 << 17

UNITS = "row long, doc_id long, pos int, size int, n int, unit long, keys array<long>, copy boolean"
MARKED = "row long, doc_id long, pos int, size int, n int, unit long, keys array<long>, first boolean"
CONTENT = "id long, text binary"

def long_lists(keys: np.ndarray, valid: np.ndarray | None = None):
    """An Arrow list<long> of the rows of a two-dimensional array, null where not valid."""
    import pyarrow as pa

    rows, width = keys.shape
    if valid is None:
        return pa.ListArray.from_arrays(pa.array(np.arange(rows + 1) * width, pa.int32()), pa.array(keys.reshape(-1)))
    ends = np.concatenate([[0], np.cumsum(valid * width)])
    offsets = pa.array(ends.astype(np.int32), mask=np.append(~valid, False))
    return pa.ListArray.from_arrays(offsets, pa.array(keys[valid].reshape(-1)))


# --- equal units


def later(doc: np.ndarray, row: np.ndarray, pos: np.ndarray, *unit: np.ndarray) -> np.ndarray:
    """Which places are not the first, by doc, row and pos, of their unit among those at hand."""
    order = np.argsort(unit[0])
    same = np.zeros(len(order) + 1, bool)
    same[1:-1] = unit[0][order[1:]] == unit[0][order[:-1]]
    some = order[same[1:] | same[:-1]]  # the others are alone
    order = some[np.lexsort((pos[some], row[some], doc[some], *[u[some] for u in unit]))]
    again = np.ones(len(order), bool)
    for u in unit:
        again[1:] &= u[order[1:]] == u[order[:-1]]
    again[:1] = False
    out = np.zeros(len(doc), bool)
    out[order] = again
    return out


def first_places(units: DataFrame) -> DataFrame:
    """MARKED of UNITS: `first` is whether a unit's place is the first, by doc_id (null first), row and pos, in all
    rows; null for a row without unit. Only first places keep their keys.

    Units that a task has seen before are known as `copy` already; these are dealt out by their place, so that of a
    hot unit one place for each batch meets the others.
    """
    deal = F.when(F.col("copy") | F.col("unit").isNull(), F.xxhash64("row", "pos")).otherwise(F.col("unit"))
    ordered = units.repartition(deal).sortWithinPartitions("unit", "doc_id", "row", "pos")

    def run(batches):
        import pyarrow as pa
        import pyarrow.compute

        last = None
        for b in batches:
            if not b.num_rows:
                continue
            copy, known = b.column(7).to_numpy(zero_copy_only=False), b.column(5).is_valid().to_numpy(zero_copy_only=False)
            main = np.flatnonzero(known & ~copy)
            unit = b.column(5).take(pa.array(main)).to_numpy()
            new = np.ones(len(unit), bool)
            new[1:] = unit[1:] != unit[:-1]
            if len(unit):
                new[0] = last is None or unit[0] != last
                last = unit[-1]
            first = np.zeros(b.num_rows, bool)
            first[main] = new
            keys = pa.compute.if_else(pa.array(first), b.column(6), pa.scalar(None, b.column(6).type))
            yield pa.RecordBatch.from_arrays([*b.columns[:6], keys, pa.array(first, mask=~known)], [*b.schema.names[:7], "first"])

    return ordered.mapInArrow(run, MARKED)


# --- candidates


def _spread(rows: DataFrame) -> DataFrame:
    """(key, id, n, mark) of units (id, n, keys). mark 0: by its key. A key that more than SMALL units at hand hold is hot:
    one of them stands for it, mark -1; the others, mark 1, need no further look and are dealt out by themselves."""

    def run(batches):
        import pyarrow as pa

        for b in batches:
            if not b.num_rows:
                continue
            lists = b.column(2)
            size = np.diff(lists.offsets.to_numpy())
            key, owner = lists.flatten().to_numpy(), np.repeat(np.arange(b.num_rows), size)
            if not len(key):
                continue
            _, one, number, count = np.unique(key, return_index=True, return_inverse=True, return_counts=True)
            mark = (count > SMALL)[number].astype(np.int32)
            mark[one[count > SMALL]] = -1
            at = pa.array(owner)
            yield pa.RecordBatch.from_arrays([pa.array(key), b.column(0).take(at), b.column(1).take(at), pa.array(mark)], ["key", "id", "n", "mark"])

    return rows.select("id", "n", "keys").mapInArrow(run, "key long, id long, n int, mark int")


def candidates(rows: DataFrame, percent: int) -> DataFrame:
    """(key, a, b) of units (id, n, keys): each pair a < b of a group of up to SMALL units under one key whose numbers of
    shingles n allow the similarity; of larger groups every member as a, without b.

    Rows pass one shuffle; a task holds no more than SMALL rows of a group besides a batch.
    """
    deal = F.when(F.col("mark") > 0, F.xxhash64("key", "id")).otherwise(F.col("key"))
    ordered = _spread(rows).repartition(deal).sortWithinPartitions("key", "id")

    def table(key, a, b=None):
        import pyarrow as pa

        none = pa.nulls(len(key), pa.int64()) if b is None else pa.array(b)
        return pa.RecordBatch.from_arrays([pa.array(key), pa.array(a), none], ["key", "a", "b"])

    def whole(key, id_, n, hot) -> Iterator:
        """What whole groups give."""
        if not len(key):
            return
        edge = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        count = np.diff(np.append(edge, len(key)))
        large = (count > SMALL) | np.logical_or.reduceat(hot, edge)
        in_large = np.repeat(large, count)
        if large.any():
            yield table(key[in_large], id_[in_large])
        key, id_, n = key[~in_large], id_[~in_large], n[~in_large]
        for step in range(1, SMALL):
            good = np.flatnonzero(key[step:] == key[:-step])
            if not len(good):
                return
            x, y = n[good], n[good + step]
            good = good[(100 * np.minimum(x, y) >= percent * np.maximum(x, y)) & (id_[good] < id_[good + step])]
            yield table(key[good], id_[good], id_[good + step])

    def run(batches):
        held = [np.zeros(0, t) for t in (np.int64, np.int64, np.int64, bool)]
        open_large = None  # a group that is known to be large and goes on
        for b in batches:
            key, id_, n, mark = (b.column(i).to_numpy() for i in range(4))
            spread = mark > 0
            if spread.any():
                yield table(key[spread], id_[spread])
                key, id_, n, mark = key[~spread], id_[~spread], n[~spread], mark[~spread]
            now = [np.concatenate(x) for x in zip(held, (key, id_, n.astype(np.int64), mark < 0), strict=True)]
            if not len(now[0]):
                continue
            if open_large is not None:
                more = now[0] == open_large
                yield table(now[0][more], now[1][more])
                now = [x[~more] for x in now]
                if not len(now[0]):
                    held = now
                    continue
            last = np.searchsorted(now[0], now[0][-1])
            yield from whole(*(x[:last] for x in now))
            held, open_large = [x[last:] for x in now], None
            if len(held[0]) > SMALL or held[3].any():
                open_large = int(held[0][0])
                yield table(held[0], held[1])
                held = [x[:0] for x in held]
        yield from whole(*held)

    return ordered.mapInArrow(run, "key long, a long, b long")


# --- confirmation


def verify(
    pairs: DataFrame, content: DataFrame, percent: int, shingles: Callable[[bytes], np.ndarray], sets: Callable[[list[bytes]], list[np.ndarray]] | None = None
) -> DataFrame:
    """The pairs (a, b) whose texts in content (id, text) have shingle sets with an intersection of at least `percent` %
    of their union; sets() gives those of several texts of up to CHUNK bytes, where that costs less. Texts of `b` come first: where many
    pairs have one id as `a`, their rows are as long as these texts, and the adaptive skew join splits them. Rows then
    come in the order of `a`, so its set is made once."""
    sets = sets or (lambda texts: [shingles(t) for t in texts])

    def similar(x: list[bytes], y: list[bytes], kept: dict[bytes, np.ndarray]) -> np.ndarray:
        texts = dict.fromkeys([*x, *y])
        short = [t for t in texts if t not in kept and len(t) <= CHUNK]
        kept |= zip(short, sets(short) if short else [], strict=True)
        kept |= {t: shingles(t) for t in texts if t not in kept}
        own, at = [kept[t] for t in texts], {t: k for k, t in enumerate(texts)}
        n = np.array([len(s) for s in own], np.int64)
        first, number = np.cumsum(n) - n, np.unique(np.concatenate(own), return_inverse=True)[1]
        i, j = (np.array([at[t] for t in side], np.int64) for side in (x, y))
        pair, of = np.tile(np.arange(len(i)), 2), np.concatenate([i, j])
        both = np.sort(np.repeat(pair * len(number), n[of]) + number[flat(first[of], n[of])])
        again = both[1:][both[1:] == both[:-1]]
        same = np.bincount(again // max(1, len(number)), minlength=len(i))
        return 100 * same >= percent * (n[i] + n[j] - same)

    def run(batches):
        import pyarrow as pa
        import pyarrow.compute as pc

        kept: dict[bytes, np.ndarray] = {}
        for b in batches:
            if not b.num_rows:
                continue
            x, y = b.column(2), b.column(3)
            size = np.cumsum(pc.add(pc.binary_length(x), pc.binary_length(y)).to_numpy().astype(np.int64))
            edge = np.unique(np.searchsorted(size, np.arange(CHUNK, int(size[-1]) + 1, CHUNK), "right"))
            edge = [0, *edge[(edge > 0) & (edge < b.num_rows)].tolist(), b.num_rows]
            good = []
            for lo, hi in zip(edge, edge[1:], strict=False):
                left, right = x[lo:hi].to_pylist(), y[lo:hi].to_pylist()
                good.append(similar(left, right, kept))
                kept = {left[-1]: kept[left[-1]]}
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], ["a", "b"]).filter(pa.array(np.concatenate(good)))

    left = content.select(F.col("id").alias("a"), F.col("text").alias("x"))
    right = content.select(F.col("id").alias("b"), F.col("text").alias("y"))
    return meet(meet(pairs, right, "b"), left, "a").select("a", "b", "x", "y").mapInArrow(run, "a long, b long")


def sets_of(content: DataFrame, shingles: Callable[[bytes], np.ndarray]) -> DataFrame:
    """(id, set) of content (id, text)."""

    def run(batches):
        import pyarrow as pa

        for b in batches:
            for k in range(0, b.num_rows, 500):
                part = b.slice(k, 500)
                sets = [pack_set(shingles(t)) for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sets, pa.binary())], ["id", "set"])

    return content.mapInArrow(run, "id long, set binary")


def wanted(docs: DataFrame, ids: DataFrame, pick: Callable) -> DataFrame:
    """CONTENT of the ids, each once. pick(maybe) maps batches of docs to (id, text) of those for which maybe(numbers) holds."""
    map_ = docs.sparkSession.sparkContext.broadcast(membership(ids))  # MOST_BITS at most
    found = docs.mapInArrow(lambda batches: pick(batches, lambda numbers: maybe_in(map_.value, numbers)), CONTENT)
    return meet(found, ids, "id", "left_semi").dropDuplicates(["id"])


class Fresh:
    """Which of some numbers weren't met before in this task, as far as a bounded memory tells."""

    def __init__(self, most: int = 200_000):
        self.most, self.met = most, set()

    def __call__(self, at: np.ndarray, numbers: np.ndarray) -> list[int]:
        out = []
        for i, n in zip(at.tolist(), numbers[at].tolist(), strict=True):
            if n not in self.met:
                if len(self.met) >= self.most:
                    self.met.clear()
                self.met.add(n)
                out.append(i)
        return out


def cluster(
    units: DataFrame,
    content_of: Callable[[DataFrame], DataFrame],
    percent: int,
    shingles: Callable[[bytes], np.ndarray],
    sets: Callable[[list[bytes]], list[np.ndarray]] | None = None,
) -> DataFrame:
    """(id, component) of those of the units (id, n, keys) that similar ones join; component is the smallest id.

    content_of(ids) gives CONTENT. The pairs of small groups are confirmed, and each member of a large one against one
    hub, see verify() for sets. Large groups that lie in one component then are done; the members of the others are compared
    block by block, those of huge ones where an exact join by rarest shingles leaves them. The result is a table in the shared folder.
    """
    written: list[DataFrame] = []

    def kept(df: DataFrame, name: str) -> DataFrame:
        written.append(cut(df, name))
        return written[-1]

    groups = kept(candidates(units, percent), "groups")
    small = groups.where("b is not null").select("a", "b")
    large = groups.where("b is null").select("key", F.col("a").alias("id"))
    pairs = kept(small.union(stars(large)).distinct(), "pairs")
    ids = kept(pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct(), "ends")
    content = kept(content_of(ids), "content")
    out = cut(connected_components(verify(pairs, content, percent, shingles, sets)), "members")

    placed = meet(large, out, "id", "left").withColumn("component", F.coalesce("component", "id"))
    found = placed.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.count("*").alias("k"), F.bit_xor(F.xxhash64("id")).alias("print"))
    # groups of the same members, as near copies form under several keys, are one
    several = found.where("lo <> hi").groupBy("k", "print", "lo", "hi").agg(F.min("key").alias("key"))
    left = kept(placed.join(several.select("key", "k"), "key").select("key", "id", "component", "k"), "open")
    if not left.isEmpty():
        more = block_pairs(left.where(F.col("k") <= LARGE).select("key", "id", "component"), content, percent, shingles)
        huge = left.where(F.col("k") > LARGE).select("id").distinct()
        if not huge.isEmpty():
            packed = kept(sets_of(meet(content, huge, "id", "left_semi"), shingles), "sets")
            confirm = lambda pairs: verify(pairs, content, percent, shingles, sets)
            written.append(similar_pairs(packed, content, percent, out, confirm, shingles))
            more = more.union(confirm(written[-1]))
        more = kept(more, "more")
        if not more.isEmpty():
            written.append(out)
            out = cut(connected_components(out.select(F.col("id").alias("a"), F.col("component").alias("b")).union(more)), "members")
    for df in written:
        drop(df)
    return out


def removals(marked: DataFrame, members: DataFrame, nested: bool = False) -> DataFrame:
    """(row, pos, size): the places of MARKED that are not the first of their component, by doc_id (null first), row and pos.
    Where units of a text may lie in one another (`nested`), those that overlap the first place stay with it; of units at
    one place the longest is the first."""
    # units without keys are in no component; without them fewer rows meet the components
    firsts = marked.where("first and keys is not null").select("unit", "row", "doc_id", "pos", "size")
    placed = meet(firsts, members.withColumnRenamed("id", "unit"), "unit").withColumn("at", F.struct("doc_id", "row", "pos", (-F.col("size")).alias("back")))
    keeper = placed.groupBy("component").agg(F.min("at").alias("keeper"))
    stays = F.expr("at <=> keeper")
    if nested:
        stays = (F.col("row") == F.col("keeper.row")) & (F.col("pos") < F.col("keeper.pos") - F.col("keeper.back")) & (F.col("pos") + F.col("size") > F.col("keeper.pos"))
    similar = placed.join(keeper, "component").where(~stays).select("row", "pos", "size")
    return marked.where("not first").select("row", "pos", "size").union(similar)


def by_row(marked: DataFrame, gone: DataFrame) -> DataFrame:
    """(row, doc_id, n_units, gone) of every row, from its head (a place without unit whose size is the number of units):
    `gone` are its places (pos, size) that go, in order."""
    heads = marked.where("unit is null").select("row", "doc_id", F.col("size").cast("long").alias("n_units"))
    grouped = gone.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("pos", "size"))).alias("gone"))
    none = F.array().cast("array<struct<pos:int,size:int>>")
    return meet(heads, grouped, "row", "left").withColumn("gone", F.coalesce("gone", none))


def unit_batch(row, doc_id, pos, size, unit, keys, keyed, heads):
    """UNITS of one batch of texts; those that are not `keyed` have no keys and are equal or nothing. heads: (row, doc_id,
    number of units) of each text, whose own place has no unit. n is 0: units may repeat shingles, so their number
    would be no bound."""
    import pyarrow as pa

    doc, head = (x if isinstance(x, pa.Array) else pa.array(x, pa.int64()) for x in (doc_id, heads[1]))
    rank = np.array(doc.fill_null(np.iinfo(np.int64).min))
    copy = later(rank, row, pos, unit)
    first, texts = len(unit), len(heads[0])
    columns = [
        np.concatenate([row, heads[0]]), pa.concat_arrays([doc, head]), np.concatenate([pos, np.full(texts, -1)]).astype(np.int32),
        np.concatenate([size, heads[2]]).astype(np.int32), np.zeros(first + texts, np.int32),
        pa.array(np.concatenate([unit, np.zeros(texts, np.int64)]), mask=np.arange(first + texts) >= first),
        long_lists(np.concatenate([keys, np.zeros((texts, keys.shape[1]), np.int64)]), np.concatenate([keyed & ~copy, np.zeros(texts, bool)])),
        np.concatenate([copy, np.zeros(texts, bool)]),
    ]
    return pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x) for x in columns], ["row", "doc_id", "pos", "size", "n", "unit", "keys", "copy"])
