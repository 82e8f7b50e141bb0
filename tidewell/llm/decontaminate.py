"""Benchmark decontamination by suffix arrays over the training documents.

Each task cuts its documents into shards of bounded size, sorts the suffixes of each shard's words
(to the length of the longest benchmark item, which no query looks beyond) and looks up every
suffix of every benchmark item by binary search, to the length of a window. The lower and upper bounds
give all places of the window; windows that follow each other in an item and in a document are one
verbatim match, of which each document's longest is told with its locations. A document lies in one
shard, so nothing is shuffled. Words outside the benchmark's vocabulary end a match at once: stretches
between them that are shorter than the shortest window hold no match and get no suffixes.
"""

from __future__ import annotations

import itertools
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Words of a window.
WINDOW = 10
#: Bytes of document text in a shard, unless one document has more.
SHARD = 8 << 20
#: Bytes of benchmark text that are sent to all tasks at once; a larger benchmark goes in several passes.
BENCHMARK_BYTES = 32 << 20

#: Lower case for A-Z; blanks for all other ASCII characters that are no letters or digits.
FOLD = bytes(b if b > 127 or chr(b).isalnum() and not 65 <= b <= 90 else b + 32 if 65 <= b <= 90 else 32 for b in range(256))


def words(text: str) -> list[bytes]:
    return text.encode().translate(FOLD).split()


@dataclass
class Items:
    """Benchmark items as numbered words."""

    ids: list[str]
    vocabulary: dict[bytes, int]
    symbols: np.ndarray  # all items' words, each item followed by 0
    start: np.ndarray  # first word of each item
    size: np.ndarray
    window: np.ndarray  # words of each item's windows

    @classmethod
    def of(cls, rows: list[tuple[str | None, str | None]]) -> Items:
        vocabulary: dict[bytes, int] = {}
        ids, out, start, size = [], [], [], []
        for i, text in rows:
            w = words(text or "")
            if i is None or not w:
                continue
            ids.append(i)
            start.append(len(out))
            size.append(len(w))
            out.extend(vocabulary.setdefault(x, len(vocabulary) + 1) for x in w)
            out.append(0)
        n = np.array(size, np.int64)
        return cls(ids, vocabulary, np.array(out, np.int32), np.array(start, np.int64), n, np.minimum(n, WINDOW))


def suffix_array(symbols: np.ndarray, places: np.ndarray, depth: int) -> np.ndarray:
    """The places, ordered by the symbols from there on, as far as `depth` symbols or a 0.

    Prefix doubling: suffixes are ordered by their first symbol, then those still tied by their
    first 2, 4, ... symbols through the ranks found before, until no ties or `depth` is reached.
    """
    rank = np.zeros(len(symbols) + 1, np.int64)
    rank[places] = symbols[places]
    order = places[np.argsort(rank[places], kind="stable")]
    key = rank[order]
    step = 1
    groups = _groups(key)
    rank[order] = groups
    tied = np.flatnonzero(_tied(groups))
    while len(tied) and step < depth:
        at = order[tied]
        after = rank[np.minimum(at + step, len(symbols))]
        turn = np.lexsort((after, rank[at]))
        at, first, after = at[turn], rank[at][turn], after[turn]
        order[tied] = at
        new = np.ones(len(at), bool)
        new[1:] = (first[1:] != first[:-1]) | (after[1:] != after[:-1])
        rank[at] = tied[np.maximum.accumulate(np.where(new, np.arange(len(at)), 0))] + 1
        same = ~new
        again = same.copy()
        again[:-1] |= same[1:]
        tied = tied[again]
        step *= 2
    return order


def _groups(key: np.ndarray) -> np.ndarray:
    """For sorted keys, 1 + the place of the first equal one."""
    new = np.ones(len(key), bool)
    new[1:] = key[1:] != key[:-1]
    return np.maximum.accumulate(np.where(new, np.arange(len(key)), 0)) + 1


def _tied(groups: np.ndarray) -> np.ndarray:
    same = np.zeros(len(groups), bool)
    same[1:] = groups[1:] == groups[:-1]
    same[:-1] |= same[1:]
    return same


def bounds(symbols: np.ndarray, order: np.ndarray, queries: np.ndarray, size: np.ndarray, upper: bool) -> np.ndarray:
    """For each row of `queries` (symbols, `size` of them count) the first place in `order` whose
    suffix is not before the query, or with `upper` the first that is after all that begin with it."""
    width = queries.shape[1]
    padded = np.concatenate([symbols, np.zeros(width, symbols.dtype)])
    lo, hi = np.zeros(len(queries), np.int64), np.full(len(queries), len(order), np.int64)
    inside = np.arange(width) < size[:, None]
    while True:
        open_ = np.flatnonzero(lo < hi)
        if not len(open_):
            return lo
        mid = (lo[open_] + hi[open_]) // 2
        suffix = padded[order[mid][:, None] + np.arange(width)]
        query, seen = queries[open_], inside[open_]
        differs = (suffix != query) & seen
        first = differs.argmax(axis=1)
        any_ = differs.any(axis=1)
        row = np.arange(len(open_))
        less = np.where(any_, suffix[row, first] < query[row, first], upper)
        lo[open_] = np.where(less, mid + 1, lo[open_])
        hi[open_] = np.where(less, hi[open_], mid)


NO_MATCH = ([], [], None, None, None, None)


def search(shard: list[np.ndarray], items: Items) -> list[tuple]:
    """For each document (its words' symbols, 0 for foreign words) of a shard: the hit words as a list of
    start, end, start, end, ...; the items with a window in it; and its longest verbatim match (words,
    item, item's word, document's word)."""
    size = np.array([len(d) for d in shard], np.int64)
    start = np.cumsum(size + 1) - size - 1
    symbols = np.zeros(int(size.sum()) + len(shard), np.int32)
    for s, d in zip(start, shard, strict=True):
        symbols[s : s + len(d)] = d
    out: list[tuple] = [NO_MATCH] * len(shard)
    if not items.ids:
        return out
    # stretches of known words that are long enough for a window
    edge = np.flatnonzero(np.diff(np.concatenate([[0], (symbols > 0).astype(np.int8), [0]])))
    a, b = edge[::2], edge[1::2]
    fits = b - a >= int(items.window.min())
    a, b = a[fits], b[fits]
    if not len(a):
        return out
    places = _ranges(a, b - a)
    order = suffix_array(symbols, places, int(items.size.max()))

    # every suffix of every item that is no shorter than the item's window, looked up by that window
    n = items.size - items.window + 1
    item = np.repeat(np.arange(len(items.ids)), n)
    at = _ranges(items.start, n)
    window = items.window[item]
    padded = np.concatenate([items.symbols, np.zeros(WINDOW, np.int32)])
    query = np.where(np.arange(WINDOW) < window[:, None], padded[at[:, None] + np.arange(WINDOW)], 0)
    lo, hi = bounds(symbols, order, query, window, False), bounds(symbols, order, query, window, True)
    found = np.flatnonzero(lo < hi)
    if not len(found):
        return out
    times = (hi - lo)[found]
    place = order[_ranges(lo[found], times)]
    at, item, window = (np.repeat(x[found], times) for x in (at, item, window))
    doc = np.searchsorted(start, place, side="right") - 1

    # windows that follow each other in the item and in the document are one verbatim match
    turn = np.lexsort((place, place - at))
    p, q = place[turn], (place - at)[turn]
    first = np.flatnonzero(np.concatenate([[True], (np.diff(q) != 0) | (np.diff(p) != 1)]))
    length = np.diff(np.append(first, len(p))) + window[turn][first] - 1
    first = turn[first]
    best = np.lexsort((item[first], place[first], -length, doc[first]))
    best = best[np.concatenate([[True], np.diff(doc[first][best]) != 0])]
    for k in best.tolist():
        f = int(first[k])
        d, i = int(doc[f]), int(item[f])
        match = (int(length[k]), items.ids[i], int(at[f] - items.start[i]), int(place[f] - start[d]))
        out[d] = ([], [], *match)

    change = np.zeros(len(symbols) + 1, np.int64)
    np.add.at(change, place, 1)
    np.add.at(change, place + window, -1)
    edge = np.flatnonzero(np.diff(np.concatenate([[0], (np.cumsum(change) > 0).astype(np.int8), [0]])))
    for x, y in edge.reshape(-1, 2).tolist():
        d = int(np.searchsorted(start, x, side="right")) - 1
        out[d][0].extend((x - int(start[d]), y - int(start[d])))
    for d, i in np.unique(np.stack([doc, item], axis=1), axis=0).tolist():
        out[d][1].append(items.ids[i])
    return out


def _ranges(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """start, start + 1, ... of each size, one after another."""
    return np.repeat(start - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))


RESULT = "n_words long, hits array<long>, items array<string>, longest long, item_id string, item_word long, doc_word long"


def decontaminate(
    docs: DataFrame, benchmark: DataFrame, keep: list[str] | None = None, text_col: str = "text", item_col: str = "item_id"
) -> DataFrame:
    """(row, n_words, n_hit, hits, items, longest, item_id, item_word, doc_word) for each row of docs.

    `row` holds the columns `keep` of docs (None: all). `hits` are the stretches of words within
    occurrences of windows of 10 item words (of the whole item if it has fewer), as start, end, ...;
    n_hit counts these words; `items` are the ids of the items they belong to, as strings and in their
    order; the rest tell the longest verbatim match of at least a window and where it lies, null without
    one. A null or empty text has no words. Items without id or words are left out; items of equal id count
    once. Rows, also repeated ones, are judged each by itself; an empty table gives no rows, an empty
    benchmark no hits. A text longer than SHARD bytes is a shard of its own.

    The benchmark is read in passes of at most BENCHMARK_BYTES; each pass searches all rows.
    """
    spark = docs.sparkSession
    kept = docs.columns if keep is None else keep
    row = F.struct(*[F.col(f"`{c}`") for c in kept]).alias("row")
    now = docs.select(row, F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))
    passes = list(_passes(spark, benchmark.select(F.col(f"`{item_col}`").cast("string").alias("i"), F.col("text").alias("t"))))
    for k, shared in enumerate(passes):
        now = _one_pass(now, shared, first=k == 0, last=k == len(passes) - 1)
    n_hit = F.expr("aggregate(transform(hits, (x, i) -> if(i % 2 = 0, -x, x)), 0L, (s, x) -> s + x)")
    in_order = F.array_sort(F.array_distinct("items"))
    return now.withColumn("items", in_order).withColumn("n_hit", n_hit)


def _passes(spark, items: DataFrame):
    """The benchmark as broadcast parts, each of at most BENCHMARK_BYTES of text besides its last item."""
    held, size, parts = [], 0, 0
    for r in items.toLocalIterator():
        held.append((r["i"], r["t"]))
        size += len((r["t"] or "").encode())
        if size >= BENCHMARK_BYTES:
            yield spark.sparkContext.broadcast(Items.of(held))
            held, size, parts = [], 0, parts + 1
    if held or not parts:
        yield spark.sparkContext.broadcast(Items.of(held))


def _one_pass(rows: DataFrame, shared, first: bool, last: bool) -> DataFrame:
    """Search every row for one part of the benchmark; later parts add to what earlier ones found."""
    from pyspark.sql import types as T

    schema = T.StructType([rows.schema["row"]] + ([] if last else [rows.schema["text"]]) + T._parse_datatype_string(RESULT).fields)

    def run(batches):
        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_schema

        target = to_arrow_schema(schema)
        items = shared.value
        number = items.vocabulary.get

        def results(texts):
            shard, held, size = [], [], 0
            for t in texts:
                w = words(t)
                shard.append(np.fromiter(map(number, w, itertools.repeat(0)), np.int32, len(w)))
                size += len(t)
                if size >= SHARD:
                    held += [(len(d), *r) for d, r in zip(shard, search(shard, items), strict=True)]
                    shard, size = [], 0
            return held + [(len(d), *r) for d, r in zip(shard, search(shard, items), strict=True)]

        for b in batches:
            found = results(b.column("text").to_pylist())
            if not first:
                earlier = zip(*(b.column(c).to_pylist() for c in ("hits", "items", "longest", "item_id", "item_word", "doc_word")), strict=True)
                found = [_merged(x, y) for x, y in zip(found, earlier, strict=True)]
            columns = list(zip(*found, strict=True)) if found else [[]] * 7
            fixed = [b.column("row")] + ([] if last else [b.column("text")])
            arrays = fixed + [pa.array(c, f.type) for c, f in zip(columns, list(target)[len(fixed) :], strict=True)]
            yield pa.RecordBatch.from_arrays(arrays, schema=pa.schema([pa.field(f.name, x.type) for f, x in zip(target, arrays, strict=True)]))

    return rows.mapInArrow(run, schema)


def _merged(new: tuple, old: tuple) -> tuple:
    """What a row has from one part of the benchmark and from earlier ones."""
    spans = sorted(zip(new[1][::2] + old[0][::2], new[1][1::2] + old[0][1::2], strict=True))
    hits: list[int] = []
    for a, b in spans:
        if hits and a <= hits[-1]:
            hits[-1] = max(hits[-1], b)
        else:
            hits += [a, b]
    match = new[3:] if (new[3] or 0) > (old[2] or 0) else old[2:]
    return (new[0], hits, new[2] + old[1], *match)


def clean_documents(docs: DataFrame, benchmark: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows of docs without a benchmark window, with their columns, whatever their names. Nulls, repeats and empty tables:
    as in decontaminate()."""
    return decontaminate(docs, benchmark, None, text_col).where("n_hit = 0").select("row.*")
