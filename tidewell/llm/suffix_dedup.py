"""Removal of long byte strings that occur earlier in the corpus, by suffix arrays of grouped suffixes.

Where repeats can lie is found first. Every 100-byte string has one anchor, the least of its 32-byte
strings by hash; equal strings have equal anchors at equal places. The 100-byte strings of one anchor
form an extent. Extents are dealt out by anchor: an extent whose 128 bits of hash (anchor and content)
stand at an earlier place goes as a whole. An anchor that stands in different extents (at the edges of
copies and passages) has these cut into windows of up to STARTS strings around a common core; windows are
dealt out by the core, so that hot anchors spread, and those of a core with several contents are settled by
a suffix array. Anchors of one extent and cores of one window need nothing more.

The suffix array is built by grouping: suffixes are grouped by their Lyndon prefix, groups are worked
from the greatest down, each extending the prefixes of the suffixes that its members' previous-smaller
pointers lead to; then the order is emitted group by group from the smallest suffix up.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut
from .fuzzy import later
from .hashing import BYTE, mix, powers, prefix_sums, sliding_least

#: Bytes of a string that is looked for, and of an anchor.
LENGTH, ANCHOR = 100, 32
#: Strings that a window holds at most; they share a core of LENGTH - STARTS + 1 bytes.
STARTS = 17
#: Symbols that one suffix array covers. A core with more is cut into windows of fewer strings.
SHARD = 1 << 15
_SPAN = LENGTH - ANCHOR + 1
_U = np.uint64


def suffix_array(text: Sequence[int]) -> list[int]:
    """Starts of the suffixes of a sequence of symbols in order. Each suffix is moved between groups a bounded number of times
    for each of its Lyndon factors: linear time, no recursion and no renaming."""
    n = len(text)
    buckets = defaultdict(list)
    for i, c in enumerate(text, 1):
        buckets[c].append(i)
    members: list = []
    group = [0] * (n + 1)
    for c in sorted(buckets):
        own = buckets[c]
        for i in own:
            group[i] = len(members)
        members.append(set(own))
    lower = [*range(-1, len(members) - 1)]
    upper = [*range(1, len(members)), -1]
    done = bytearray(n + 1)  # suffixes of groups that are worked off; 0 stands before the text and never is
    previous = [0] * (n + 1)
    g = len(members) - 1
    while g >= 0:
        own = members[g]
        if len(own) == 1:
            (i,) = own
            p = i - 1
            while done[p]:
                p = previous[p]
            previous[i] = p
            done[i] = 1
            g = lower[g]
            if p:
                old = group[p]
                if len(members[old]) > 1:
                    members[old].discard(p)
                    new = len(members)
                    members.append({p})
                    group[p] = new
                    above = upper[old]
                    lower.append(old)
                    upper.append(above)
                    upper[old] = new
                    if above >= 0:
                        lower[above] = new
                    if g == old:
                        g = new
            continue
        # roots: the previous suffixes of smaller groups, with the number of members that lead to each
        count: dict[int, int] = {}
        several = False
        for i in sorted(own):
            p = i - 1
            while done[p]:
                p = previous[p]
            if group[p] == g and p:
                p = previous[p]
            previous[i] = p
            if p in count:
                count[p] += 1
                several = True
            else:
                count[p] = 1
        for i in own:
            done[i] = 1
        count.pop(0, None)
        parts: dict[tuple[int, int], list[int]] = {}
        for p, k in count.items():
            key = (k, group[p])
            if key in parts:
                parts[key].append(p)
            else:
                parts[key] = [p]
        for key in sorted(parts, reverse=True) if several else parts:
            moved, old = parts[key], key[1]
            if len(moved) == len(members[old]):
                continue
            members[old].difference_update(moved)
            new = len(members)
            members.append(set(moved))
            for p in moved:
                group[p] = new
            above = upper[old]
            lower.append(old)
            upper.append(above)
            upper[old] = new
            if above >= 0:
                lower[above] = new
        g = lower[g]
    # groups from the smallest up get their places; each suffix emits those whose next smaller suffix it is, the
    # end of the text, smaller than any, first
    place = [0] * len(members)
    g, at = 0, 0
    while g >= 0 and members:
        place[g] = at
        at += len(members[g])
        g = upper[g]
    out = [0] * n
    placed = bytearray(n + 1)
    placed[0] = 1
    s, r = n, 0
    while True:
        while not placed[s]:
            q = group[s]
            out[place[q]] = s
            place[q] += 1
            placed[s] = 1
            s = previous[s]
        if r == n:
            break
        s = out[r] - 1
        r += 1
    return [i - 1 for i in out]


def extents(data: np.ndarray) -> tuple[np.ndarray, ...]:
    """(anchor's hash, content's hash, first, last string's start, anchor's place) of a text's extents."""
    n = len(data) - LENGTH + 1
    if n <= 0:
        return (np.zeros(0, np.int64),) * 5
    sums, inverse = prefix_sums(BYTE[data]), powers(len(data))[1]
    anchor = mix((sums[ANCHOR:] - sums[:-ANCHOR]) * inverse[: len(data) - ANCHOR + 1])
    low = (anchor & _U(0xFFFFFFFF00000000)) | np.arange(len(anchor), dtype=np.uint64)
    least = sliding_least(low, _SPAN)[:n]
    at = (least & _U(0xFFFFFFFF)).astype(np.int64)
    first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
    last = np.append(first[1:], n) - 1
    size = last - first + LENGTH
    key = mix((sums[first + size] - sums[first]) * inverse[first] + size.astype(np.uint64) * _U(0x9E3779B97F4A7C15))
    return anchor[at[first]].view(np.int64), key.view(np.int64), first, last, at[first]


#: An extent's place packs its first string's start and, less than 2^8 each, how far its last string's start and its
#: anchor lie beyond; places of a text are ordered like these starts.
EXTENT = "h long, e long, doc_id long, tie long, place long, copy boolean"
#: A place is a text's (doc_id, tie) and an offset: tie is a hash of the text, so that places don't depend on how rows are
#: read. Null ids count as NO_ID with a tie of their own.
GONE = "doc_id long, tie long, start int, end int"
NO_ID = -(1 << 63)


def _extents(rows: DataFrame) -> DataFrame:
    """EXTENT of rows (doc_id, tie, text). Those that an earlier one in the same batch equals are known as `copy`."""

    def run(batches):
        import pyarrow as pa

        for b in batches:
            if not b.num_rows:
                continue
            found = [extents(np.frombuffer(t.as_py().encode("utf-8", "surrogatepass"), np.uint8)) for t in b.column(2)]
            size = np.array([len(f[0]) for f in found], np.int64)
            doc, tie = (np.repeat(b.column(i).to_numpy(), size) for i in (0, 1))
            h, e, first, last, anchor = (np.concatenate(x) for x in zip(*found, strict=True))
            place = first << 16 | (last - first) << 8 | (anchor - first)
            copy = later(doc, tie, place, h, e)
            if copy.any():  # the same place of a row that comes twice is no earlier one
                order = np.lexsort((place, tie, doc))
                same = np.zeros(len(order), bool)
                same[1:] = (doc[order[1:]] == doc[order[:-1]]) & (tie[order[1:]] == tie[order[:-1]]) & (place[order[1:]] == place[order[:-1]])
                copy[order[same]] = False
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in (h, e, doc, tie, place, copy)], ["h", "e", "doc_id", "tie", "place", "copy"])

    return rows.mapInArrow(run, EXTENT)


def _sorted_out(ordered: DataFrame) -> DataFrame:
    """From EXTENT in the order (h, e, doc_id, tie, place): the copies of an earlier extent (`copy`), and one of each
    different content of an anchor that has several (not `copy`). Holds one extent from batch to batch."""
    names = ["doc_id", "tie", "place", "copy"]

    def run(batches):
        import pyarrow as pa

        held = None  # the last anchor, content and its first place, and its extent while it is the anchor's only one
        for whole in batches:
            known = whole.column(5).to_numpy(zero_copy_only=False)
            if known.any():
                yield pa.RecordBatch.from_arrays(whole.filter(whole.column(5)).columns[2:], names)
            b = whole.filter(pa.array(~known))
            if not b.num_rows:
                continue
            h, e, doc, tie, place = (b.column(i).to_numpy() for i in range(5))
            new_h = np.concatenate([[held is None or held[0] != h[0]], h[1:] != h[:-1]])
            new_e = new_h | np.concatenate([[held is None or held[1] != e[0]], e[1:] != e[:-1]])
            # the place of the first extent of equal content: a row that comes twice is no copy of itself
            start = np.maximum.accumulate(np.where(new_e, np.arange(len(h)), -1))
            origin = [np.where(start >= 0, x[start], held[2][i] if held else 0) for i, x in enumerate((doc, tie, place))]
            itself = (origin[0] == doc) & (origin[1] == tie) & (origin[2] == place)
            number = np.cumsum(new_h)
            kinds = np.bincount(number, weights=new_e & ~new_h, minlength=int(number[-1]) + 1)
            several = kinds[number] > 0
            if held is not None and held[3] is not None and not new_h[0] and kinds[0] > 0:
                yield held[3]
            show = several & new_e
            if held is not None and held[3] is None:  # the open anchor has several already
                show |= (number == 0) & new_e
            show |= ~itself
            table = pa.RecordBatch.from_arrays([*b.columns[2:5], pa.array(~new_e)], names)
            yield table.filter(pa.array(show))
            k = int(number[-1])
            if k == 0:
                alone = held[3] if held is not None and kinds[0] == 0 else None
            elif kinds[k] == 0:
                alone = table.slice(int(np.flatnonzero(new_h)[-1]), 1)
            else:
                alone = None
            held = (h[-1], e[-1], tuple(int(x[-1]) for x in origin), alone)

    return ordered.mapInArrow(run, "doc_id long, tie long, place long, copy boolean")


def windows(data: bytes, first: int, last: int, anchor: int, starts: int) -> list[tuple[int, int, int, int]]:
    """(core, from, to, lead) of the strings that begin at first to last: those that begin at the same multiple of `starts`
    before the anchor share a window; its core is known by that multiple and the bytes that all of them hold, which
    begin `lead` bytes after the window."""
    import xxhash

    out = []
    for slot in range((anchor - last) // starts, (anchor - first) // starts + 1):
        to, at = anchor - slot * starts, anchor - slot * starts - starts + 1
        a, z = max(first, at), min(last, to)
        core = xxhash.xxh3_64_intdigest(data[to : at + LENGTH], seed=slot % (1 << 32)) - (1 << 63)
        out.append((core, a, z, to - a))
    return out


def _windows(rows: DataFrame, several: DataFrame) -> DataFrame:
    """(core, e, doc_id, tie, first, lead, data): the windows of the extents, with their bytes; lead is the number of
    bytes before the core, e a hash of lead and bytes."""
    at = several.groupBy("doc_id", "tie").agg(F.collect_set("place").alias("at"))
    names = ["core", "e", "doc_id", "tie", "first", "lead", "data"]

    def run(batches):
        import pyarrow as pa
        import xxhash

        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary()]
        for b in batches:
            for k in range(0, b.num_rows, 100):
                out = []
                for doc, tie, text, at in zip(*(c.to_pylist() for c in b.slice(k, 100).columns), strict=True):
                    data = text.encode("utf-8", "surrogatepass")
                    for x in at:
                        first = x >> 16
                        for core, a, z, lead in windows(data, first, first + (x >> 8 & 255), first + (x & 255), STARTS):
                            own = data[a : z + LENGTH]
                            out.append((core, xxhash.xxh3_64_intdigest(own, seed=lead) - (1 << 63), doc, tie, a, lead, own))
                columns = list(zip(*out, strict=True)) if out else [[]] * 7
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names)

    found = rows.join(at, ["doc_id", "tie"]).dropDuplicates(["doc_id", "tie"]).select("doc_id", "tie", "text", "at")
    return found.mapInArrow(run, "core long, e long, doc_id long, tie long, first int, lead int, data binary")


def repeats(group: list[tuple[int, bytes]], cores: list[int], starts: int, rank: np.ndarray) -> list[tuple[int, int, int]]:
    """(window, from, to): the ranges of starts within each window (lead, data) whose strings stand in a window of lower
    rank, or earlier in the same one. cores: a number for each window's core.

    A string holds its whole core, so the core is one symbol: what is sorted are the bytes around it.
    """
    core = LENGTH - starts + 1
    text: list[int] = []
    start, n = np.zeros(len(group), np.int64), np.zeros(len(group), np.int64)
    for k, (lead, data) in enumerate(group):  # 0 ends a window
        start[k], n[k] = len(text), len(data) - LENGTH + 1
        text += data[:lead].translate(_RAISED)
        text.append(256 + cores[k])
        text += data[lead + core :].translate(_RAISED)
        text.append(0)
    order = np.array(suffix_array(text), np.int64)
    own = np.repeat(np.arange(len(group)), np.diff(np.append(start, len(text))))
    place = np.arange(len(text)) - start[own]
    order = order[(place < n[own])[order]]
    symbol = np.array(text, np.int64)
    same = np.ones(len(order) - 1, bool)
    for k in range(starts):  # a string: the bytes before the core, the core, the bytes after it
        s = symbol[order + k]
        same &= s[1:] == s[:-1]
    number = np.concatenate([[0], np.cumsum(~same)])
    key = rank[own[order]] * _U(1 << 32) + place[order].astype(np.uint64)
    least = np.minimum.reduceat(key, np.flatnonzero(np.concatenate([[True], ~same])))
    late = order[key > least[number]]
    late.sort()
    if not len(late):
        return []
    edge = np.flatnonzero(np.concatenate([[True], (np.diff(late) != 1) | (own[late][1:] != own[late][:-1])]))
    stop = np.append(edge[1:], len(late)) - 1
    return [(int(own[late[i]]), int(place[late[i]]), int(place[late[j]])) for i, j in zip(edge, stop, strict=True)]


#: Bytes as symbols, raised by one; 255 is in no UTF-8.
_RAISED = bytes(min(i + 1, 255) for i in range(256))


def finer(group: list[tuple], starts: int) -> tuple[list[tuple], list[list[tuple]]]:
    """(copies, groups): the windows (doc_id, tie, first, lead, data) of one core, too many for a suffix array, as windows of
    fewer strings: those that an earlier one equals, and the different ones of each core that has several."""
    cores: dict[int, dict] = defaultdict(dict)
    copies = []
    for doc, tie, first, lead, data in sorted(group, key=lambda x: x[:3]):
        for core, a, z, own_lead in windows(data, 0, len(data) - LENGTH, lead, starts):
            own = data[a : z + LENGTH]
            if cores[core].setdefault((own_lead, own), (doc, tie, first + a, own_lead, own)) != (doc, tie, first + a, own_lead, own):
                copies.append((doc, tie, first + a, first + a + len(own)))
    return copies, [list(x.values()) for x in cores.values() if len(x) > 1]


def _settle(ordered: DataFrame) -> DataFrame:
    """GONE for windows in the order (core, e, doc_id, tie, first): whole cores up to SHARD symbols share a suffix array."""

    def run(batches):
        import pyarrow as pa

        shards: dict[int, list] = {}  # by starts: symbols, windows, the number of each one's core
        done: list[tuple] = []
        group: list[tuple] = []
        core = None

        def settle(starts: int):
            _, held, cores = shards.pop(starts)
            by = sorted(range(len(held)), key=lambda i: held[i][:3])
            rank = np.zeros(len(held), np.uint64)
            rank[by] = np.arange(len(held), dtype=np.uint64)
            for i, a, z in repeats([x[3:] for x in held], cores, starts, rank):
                done.append((held[i][0], held[i][1], held[i][2] + a, held[i][2] + z + LENGTH))

        def close(own: list[tuple], starts: int):
            if len(own) < 2:
                return
            size = sum(len(x[4]) for x in own) - len(own) * (LENGTH - starts - 1)
            if starts > 1 and size > SHARD:
                copies, parts = finer(own, starts // 4 or 1)
                done.extend(copies)
                for p in parts:
                    close(p, starts // 4 or 1)
                return
            shard = shards.setdefault(starts, [0, [], []])
            shard[0] += size
            shard[2] += [shard[2][-1] + 1 if shard[2] else 0] * len(own)
            shard[1] += own
            if shard[0] >= SHARD:
                settle(starts)

        def flush():
            columns = list(zip(*done, strict=True)) if done else [[]] * 4
            out = [pa.array(c, t) for c, t in zip(columns, [pa.int64(), pa.int64(), pa.int32(), pa.int32()], strict=True)]
            done.clear()
            return pa.RecordBatch.from_arrays(out, ["doc_id", "tie", "start", "end"])

        for b in batches:
            for c, _, *window in zip(*(x.to_pylist() for x in b.columns), strict=True):
                if c != core:
                    close(group, STARTS)
                    group, core = [], c
                if group and window[3:] == group[-1][3:]:
                    if tuple(window[:3]) != group[-1][:3]:
                        done.append((window[0], window[1], window[2], window[2] + len(window[4])))
                else:
                    group.append(tuple(window))
            yield flush()
        close(group, STARTS)
        for starts in list(shards):
            settle(starts)
        yield flush()

    return ordered.mapInArrow(run, GONE)


def repeated_strings(rows: DataFrame) -> DataFrame:
    """GONE: byte ranges of rows (doc_id, tie, text) covered by strings that start earlier; they may overlap."""
    deal = F.when(F.col("copy"), F.xxhash64("doc_id", "tie", "place")).otherwise(F.col("h"))
    ordered = _extents(rows).repartition(deal).sortWithinPartitions("h", "e", "doc_id", "tie", "place")
    sorted_out = cut(_sorted_out(ordered), "extents")
    start, last = F.expr("cast(shiftright(place, 16) as int)"), F.expr("cast(shiftright(place, 8) & 255 as int)")
    copies = sorted_out.where("copy").select("doc_id", "tie", start.alias("start"), (start + last + LENGTH).alias("end"))
    several = _windows(rows, sorted_out.where("not copy"))
    settled = _settle(several.repartition("core").sortWithinPartitions("core", "e", "doc_id", "tie", "first"))
    return copies.union(settled)


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, removed, kept) for each row of docs: the maximal removed byte ranges (start, end) and the
    remaining bytes.

    A byte goes if a 100-byte string that covers it also starts earlier: at a smaller doc_id (null first; rows of
    equal id in the order of a hash of their texts) or earlier in the same text. Strings are judged on the input
    and don't cross texts; texts of under 100 bytes stay whole. A null text has no bytes. Of rows that are equal in
    id and text one is the first. An empty table gives no rows; other columns don't pass. Very long texts are
    taken whole: a task holds the hashes of one batch of texts.
    """
    id_, text = F.col(f"`{id_col}`").cast("long"), F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    rows = docs.select(F.coalesce(id_, F.lit(NO_ID)).alias("doc_id"), F.xxhash64(id_.isNull(), text).alias("tie"), id_.alias("id"), text.alias("text"))
    gone = repeated_strings(rows.select("doc_id", "tie", "text")).groupBy("doc_id", "tie").agg(F.array_sort(F.collect_set(F.struct("start", "end"))).alias("gone"))
    # rows that are equal to an earlier one have no extents of their own: all of their strings start earlier
    numbered = rows.withColumn("k", F.row_number().over(Window.partitionBy("doc_id", "tie").orderBy("tie")))

    def run(batches):
        import pyarrow as pa

        kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
        for b in batches:
            for k in range(0, b.num_rows, 200):
                part = b.slice(k, 200)
                sizes, removed, kept = [], [], []
                spans = part.column(2)
                ends = spans.offsets.to_numpy()
                flat = spans.flatten()
                starts, stops = (flat.field(i).to_numpy()[: ends[-1] - ends[0]] for i in (0, 1))
                ends = ends - ends[0]
                for i, (text, number) in enumerate(zip(part.column(1).to_pylist(), part.column(3).to_pylist(), strict=True)):
                    data, found = text.encode("utf-8", "surrogatepass"), []
                    if number > 1 and len(data) >= LENGTH:
                        found = [[0, len(data)]]
                    elif number == 1 and ends[i + 1] > ends[i]:
                        for a, z in zip(starts[ends[i] : ends[i + 1]].tolist(), stops[ends[i] : ends[i + 1]].tolist(), strict=True):
                            if found and a <= found[-1][1]:
                                found[-1][1] = max(found[-1][1], z)
                            else:
                                found.append([a, z])
                    sizes.append(len(data))
                    removed.append([{"start": a, "end": z} for a, z in found])
                    edge = [0, *(x for r in found for x in r), len(data)]
                    kept.append(b"".join([data[a:z] for a, z in zip(edge[::2], edge[1::2], strict=True)]) if found else data)
                columns = [part.column(0), pa.array(sizes, pa.int64()), pa.array(removed, kind), pa.array(kept, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_bytes", "removed", "kept"])

    none = F.array().cast("array<struct<start:int,end:int>>")
    joined = numbered.join(gone, ["doc_id", "tie"], "left").select(F.col("id").alias("doc_id"), "text", F.coalesce("gone", none).alias("gone"), "k")
    return joined.mapInArrow(run, "doc_id long, n_bytes long, removed array<struct<start:int,end:int>>, kept binary")
