"""Paragraph MinHash banding.

Paragraphs are the lines of a text and, as paragraphs may be wrapped, its blocks of short lines that follow one
another. Each has minwise values of its five-word
shingles in bands of three: shorter bands would make candidates of paragraphs that share some stock phrases. As a
passage may be set into other text with or without line breaks, there are also windows of words that begin at
content-defined places: the same ones wherever the passage stands. These overlap and have no bands: equal ones repeat
each other. Similar ones would not do, as a window that begins some words before a passage would take these with it.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut
from .fuzzy import UNITS, Fresh, by_row, cluster, first_places, removals, unit_batch, wanted
from .hashing import flat, mix, runs, seeds, shingle_sets, shingles, sliding_least, words

#: Words of a window. It begins before a word pair whose hash is the least among REACH to either side: every
#: 2 REACH + 1 words on average, never within REACH words of another. Nearly every passage of over 50 words has one.
WINDOW, REACH = 20, 8
#: Lines and blocks of fewer words are no paragraphs. Lines of under WRAPPED words may be parts of one.
LEAST, WRAPPED = 8, 20
SHINGLE = 5
#: Bands and minwise values of a band: at similarity 0.8 a pair collides with probability 0.993, at 0.9 with 0.9999.
BANDS, ROWS = 7, 3
#: Characters of text that are hashed at once, unless one text has more.
CHUNK = 1 << 16
_SEEDS = seeds(BANDS * ROWS)
_U = np.uint64


def split(*texts: str) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, hash of each word, start and end of each word, first word of each text, first word of each \\n-split line with a
    word, whether it opens its text or follows a blank line) of texts, one after another."""
    parts = [t.encode("utf-8", "surrogatepass") for t in texts]
    data = b"\n".join(parts)
    h, start, stop = words(data)
    begin = np.cumsum([0, *[len(x) + 1 for x in parts[:-1]]])
    breaks = np.flatnonzero(np.frombuffer(data, np.uint8) == 10)
    # a line or text without words has the first word of the next one
    text, (edge, times) = np.searchsorted(start, begin), np.unique(np.searchsorted(start, np.concatenate([[0], breaks])), return_counts=True)
    some = edge < len(h)
    edge, opens = edge[some], times[some] > 1
    opens[np.searchsorted(edge, text[text < len(h)])] = True
    return data, h, start, stop, text, edge, opens


def places(h: np.ndarray, text: np.ndarray | None = None) -> np.ndarray:
    """Starts of the windows in the word hashes of texts, whose first words are `text`: of one if it is not given."""
    n = len(h)
    if n < WINDOW:
        return np.zeros(0, np.int64)
    text = np.zeros(1, np.int64) if text is None else text
    size = np.diff(text, append=n)
    last = (text + size)[size > 0]
    after = np.append(h[1:], _U(0))
    after[last - 1] = 0
    g = mix(h + _U(3) * after)
    # texts lie REACH apart, so that none reaches into another
    at = np.arange(n) + np.repeat(np.arange(len(text)) * REACH, size)
    padded = np.full(n + (len(text) + 1) * REACH, np.iinfo(np.uint64).max, np.uint64)
    padded[at + REACH] = g
    least = (g == sliding_least(padded, 2 * REACH + 1)[at]) & (g != sliding_least(padded, REACH)[at])  # of equal ones the first
    found = np.flatnonzero(least)
    return found[found + WINDOW <= np.repeat(last, size[size > 0])[found]]


def paragraphs(h: np.ndarray, edge: np.ndarray, opens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(start, size) of what is compared by bands: lines, and blocks of two and more short lines without a blank one between."""
    line = np.diff(np.append(edge, len(h)))
    long = line >= WRAPPED
    opens = opens | long
    opens[1:] |= long[:-1]
    first = np.flatnonzero(opens)
    several = np.diff(np.append(first, len(edge))) > 1
    whole = np.diff(np.append(edge[first], len(h)))
    start, size = np.concatenate([edge, edge[first[several]]]), np.concatenate([line, whole[several]])
    return start[size >= LEAST], size[size >= LEAST]


def numbers(h: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the words of each paragraph, in their order."""
    if not len(start):
        return np.zeros(0, np.int64)
    at, edge = flat(start, size), np.cumsum(size) - size
    inner = (at - np.repeat(start, size)).astype(np.uint64)
    terms = mix(h[at] ^ mix(inner + _U(0x632BE59BD9B4E019)))
    return mix(np.add.reduceat(terms, edge) + size.astype(np.uint64)).view(np.int64)


def bands(h: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The bands of paragraphs, from minwise values over stretches of the text's shingles."""
    if not len(start):
        return np.zeros((0, BANDS), np.int64)
    own = np.append(runs(h, SHINGLE), _U(0))
    ends = np.stack([start, start + size - SHINGLE + 1], axis=1).ravel()
    out = np.zeros((len(start), BANDS), np.uint64)
    for k, s in enumerate(_SEEDS):
        value = own * (s | _U(1))
        value += s
        out[:, k // ROWS] = mix(out[:, k // ROWS] + np.minimum.reduceat(value, ends)[::2] + _U(k // ROWS))
    return out.view(np.int64)


def _chunks(column) -> Iterator[list[str]]:
    """The texts of an Arrow column, as many at once as have CHUNK characters together."""
    held, chars = [], 0
    for t in column:
        held.append(t.as_py())
        chars += len(held[-1])
        if chars >= CHUNK:
            yield held
            held, chars = [], 0
    if held:
        yield held


def _units(rows: DataFrame) -> DataFrame:
    """UNITS of rows (row, doc_id, text), where pos and size count words, and a head for each row."""

    def run(batches):
        import pyarrow as pa

        for b in batches:
            if not b.num_rows:
                continue
            found, before = [], 0
            for texts in _chunks(b.column(2)):
                _, h, _, _, text, edge, opens = split(*texts)
                (start, size), window = paragraphs(h, edge, opens), places(h, text)
                window = window[~np.isin(window, start[size == WINDOW])]  # a line that is a window comes once
                all_start, all_size = np.concatenate([start, window]), np.concatenate([size, np.full(len(window), WINDOW)])
                keys = np.concatenate([bands(h, start, size), np.zeros((len(window), BANDS), np.int64)])
                owner = np.searchsorted(text, all_start, "right") - 1
                number, keyed = numbers(h, all_start, all_size), np.arange(len(all_start)) < len(start)
                found.append((owner + before, all_start - text[owner], all_size, number, keys, keyed))
                before += len(texts)
            at, start, size, unit, keys, keyed = (np.concatenate(x) for x in zip(*found, strict=True))
            row, count = b.column(0).to_numpy(), np.bincount(at, minlength=b.num_rows)
            yield unit_batch(row[at], b.column(1).take(pa.array(at)), start, size, unit, keys, keyed, (row, b.column(1), count))

    return rows.mapInArrow(run, UNITS)


def _content(batches, maybe):
    """(id, text) of batches of texts: the paragraphs whose number may be wanted."""
    import pyarrow as pa

    fresh = Fresh()
    for b in batches:
        ids, found = [], []
        for texts in _chunks(b.column(0)):
            data, h, first, stop, _, edge, opens = split(*texts)
            start, size = paragraphs(h, edge, opens)
            number = numbers(h, start, size)
            for i in fresh(np.flatnonzero(maybe(number)), number):
                ids.append(int(number[i]))
                found.append(data[first[start[i]] : stop[start[i] + size[i] - 1]])
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(found, pa.binary())], ["id", "text"])


def repeated_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 80) -> tuple[DataFrame, DataFrame]:
    """(marked, gone): the compared paragraphs with their first places, without windows that nothing repeats, and (row, pos,
    size) of those that are equal or similar to an earlier one. Paragraphs are numbered by 64-bit hashes."""
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))
    # of units without bands only repeats go on
    marked = cut(first_places(_units(rows)).where("unit is null or not first or keys is not null"), "paragraphs")
    texts = rows.select("text")
    members = cluster(marked.where("first and keys is not null").select(F.col("unit").alias("id"), "n", "keys"), lambda ids: wanted(texts, ids, _content), percent, partial(shingles, size=SHINGLE), partial(shingle_sets, size=SHINGLE))
    return marked, removals(marked, members, nested=True)


def passage_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 80) -> DataFrame:
    """(doc_id, n_paragraphs, n_removed, removed_words, removed) for each row of docs: how many of its paragraphs
    repeat, and the words (start, end) that go with them.

    Lines and blocks of short lines are similar if their sets of five-word shingles (lower case for A-Z) have an intersection
    of at least `percent` % of their union, windows if they are equal; paragraphs belong together if similar ones lead
    from one to the other. The first place of a component, by doc_id (null first), row and word, stays.
    Lines and texts of fewer than LEAST words are left alone; a null or empty text has no paragraphs. Repeated rows are texts of their own.
    An empty table gives no rows; other columns don't pass. Texts are hashed whole, CHUNK characters or one text at a time.
    """
    out = by_row(*repeated_passages(docs, id_col, text_col, percent))
    none = F.array().cast("array<struct<start:int,end:int>>")
    # paragraphs in the order of their starts; each either goes on with the open stretch or begins another
    merged = F.aggregate(
        "gone", F.struct(none.alias("done"), F.lit(-1).alias("start"), F.lit(-1).alias("end")),
        lambda s, x: F.when(x["pos"] <= s["end"], F.struct(s["done"].alias("done"), s["start"].alias("start"), F.greatest(s["end"], x["pos"] + x["size"]).alias("end"))).otherwise(
            F.struct(F.when(s["end"] < 0, s["done"]).otherwise(F.concat(s["done"], F.array(F.struct(s["start"].alias("start"), s["end"].alias("end"))))).alias("done"), x["pos"].alias("start"), (x["pos"] + x["size"]).alias("end"))
        ),
        lambda s: F.when(s["end"] < 0, s["done"]).otherwise(F.concat(s["done"], F.array(F.struct(s["start"].alias("start"), s["end"].alias("end"))))),
    )
    out = out.withColumn("removed", merged)
    words = F.aggregate("removed", F.lit(0).cast("long"), lambda s, x: s + x["end"] - x["start"])
    return out.select("doc_id", F.col("n_units").alias("n_paragraphs"), F.size("gone").cast("long").alias("n_removed"), words.alias("removed_words"), "removed")
