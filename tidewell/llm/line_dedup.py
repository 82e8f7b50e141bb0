"""Fuzzy line deduplication by MinHash over character shingles."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut
from .fuzzy import UNITS, Fresh, by_row, cluster, first_places, removals, unit_batch, wanted
from .hashing import distinct, mix, powers, prefix_sums, seeds

#: Characters of a shingle: lines of the same language share few runs of this length by chance.
SHINGLE = 8
#: Bands and minwise values of a band: at similarity 0.8 a pair collides with probability 0.987, at 0.9 with 0.9996.
BANDS, ROWS = 6, 3
#: What a blank line consists of.
BLANK = "\x20\t\n\x0b\x0c\r"
#: Characters of text that are hashed at once, unless one text has more.
CHUNK = 200_000

def _shingles(code: np.ndarray) -> np.ndarray:
    """A hash for each position of the code points: of the SHINGLE ones from there on, from prefix sums."""
    sums = prefix_sums(code.astype(np.uint64))
    return mix((sums[SHINGLE:] - sums[:-SHINGLE]) * powers(len(code))[1][: len(code) - SHINGLE + 1])


def _codes(line: str) -> np.ndarray:
    code = np.frombuffer(line.encode("utf-32-le", "surrogatepass"), np.uint32)
    return code if len(code) >= SHINGLE else np.concatenate([code, np.full(SHINGLE - len(code), 0x110000, np.uint32)])


def line_set(line: bytes) -> np.ndarray:
    """Sorted distinct shingle hashes of a line in UTF-8; of the whole line if it is shorter than a shingle."""
    return np.unique(_shingles(_codes(line.decode("utf-8", "surrogatepass"))))


def line_sets(lines: list[bytes]) -> list[np.ndarray]:
    """line_set() of each of several lines, hashed together."""
    code = [_codes(x.decode("utf-8", "surrogatepass")) for x in lines]
    whole, edge = _shingles(np.concatenate(code)), np.cumsum([0, *[len(c) for c in code]]).tolist()
    return [distinct(whole[lo : hi - SHINGLE + 1]) for lo, hi in zip(edge, edge[1:], strict=False)]


def _number(line: str) -> int:
    import xxhash

    return xxhash.xxh3_64_intdigest(line) - (1 << 63)


_A = (seeds(BANDS * ROWS) >> np.uint64(32)).astype(np.uint32) | np.uint32(1)
_B = (seeds(BANDS * ROWS) & np.uint64(0xFFFFFFFF)).astype(np.uint32)


def signatures(lines: list[str]) -> np.ndarray:
    """Band keys of each line, all lines at once."""
    code = [_codes(x) for x in lines]
    size = np.array([len(c) for c in code], np.int64)
    end = np.cumsum(size)
    whole = _shingles(np.concatenate(code))
    valid = np.ones(len(whole), bool)
    for k in range(1, SHINGLE):  # shingles that would reach into the next line
        valid[end[:-1] - k] = False
    low = whole[valid].astype(np.uint32)
    start = np.concatenate([[0], np.cumsum(size - SHINGLE + 1)[:-1]])
    out = np.zeros((len(lines), BANDS), np.uint64)
    for band in range(BANDS):
        key = np.full(len(lines), band + 1, np.uint64)
        for k in range(band * ROWS, band * ROWS + ROWS):
            key = mix(key * np.uint64(0x9E3779B97F4A7C15) + np.minimum.reduceat(low * _A[k] + _B[k], start))
        out[:, band] = key
    return out.view(np.int64)


def _units(rows: DataFrame) -> DataFrame:
    """UNITS of the non-blank lines of rows (row, doc_id, text), and a head for each row."""

    def run(batches):
        for b in batches:
            if not b.num_rows:
                continue
            row, doc, pos, size, unit, keys, counts, held, chars = [], [], [], [], [], [], [], [], 0
            for r, d, text in zip(*(c.to_pylist() for c in b.columns), strict=True):
                before = len(row)
                for i, line in enumerate(text.split("\n")):
                    if line.strip(BLANK):
                        row.append(r)
                        doc.append(d)
                        pos.append(i)
                        size.append(len(line))
                        unit.append(_number(line))
                        held.append(line)
                        chars += len(line)
                counts.append(len(row) - before)
                if chars >= CHUNK:
                    keys.append(signatures(held))
                    held, chars = [], 0
            if held:
                keys.append(signatures(held))
            all_keys = np.concatenate(keys) if keys else np.zeros((0, BANDS), np.int64)
            numbers = [np.array(x, np.int64) for x in (row, pos, size, unit)]
            heads = (b.column(0).to_numpy(), b.column(1), np.array(counts, np.int64))
            yield unit_batch(numbers[0], doc, numbers[1], numbers[2], numbers[3], all_keys, np.ones(len(row), bool), heads)

    return rows.mapInArrow(run, UNITS)


def _content(batches, maybe):
    """(id, text) of batches of texts: the lines whose number may be wanted."""
    import pyarrow as pa

    fresh = Fresh()
    for b in batches:
        lines = [x for t in b.column(0).to_pylist() for x in t.split("\n") if x.strip(BLANK)]
        number = np.fromiter(map(_number, lines), np.int64, len(lines))
        at = fresh(np.flatnonzero(maybe(number)), number)
        yield pa.RecordBatch.from_arrays([pa.array(number[at]), pa.array([lines[i].encode("utf-8", "surrogatepass") for i in at], pa.binary())], ["id", "text"])


def repeated_lines(rows: DataFrame, percent: int = 80) -> tuple[DataFrame, DataFrame]:
    """(marked, gone) of rows (row, doc_id, text): the lines with their first places, and (row, pos, size) of those
    that are equal or similar to an earlier one. Lines are numbered by 64-bit hashes."""
    marked = cut(first_places(_units(rows)), "lines")
    texts = rows.select("text")
    members = cluster(marked.where("first").select(F.col("unit").alias("id"), "n", "keys"), lambda ids: wanted(texts, ids, _content), percent, line_set, line_sets)
    return marked, removals(marked, members)


def line_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 80) -> DataFrame:
    """(doc_id, n_lines, n_removed, removed) for each row of docs: how many of its non-blank lines go, and which (numbers
    of \\n-split lines, from 0).

    Lines are similar if their sets of 8-character shingles have an intersection of at least `percent` %
    of their union, and belong together if similar lines lead from one to the other. The first place of
    a component, by doc_id (null first), row and line, stays. Blank lines belong to nothing; a null or empty
    text has none and loses none. Repeated rows are texts of their own. An empty table gives no rows; other
    columns don't pass. Long texts are hashed whole, CHUNK characters or one text at a time.
    """
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))
    out = by_row(*repeated_lines(rows, percent))
    return out.select("doc_id", F.col("n_units").alias("n_lines"), F.size("gone").cast("long").alias("n_removed"), F.col("gone.pos").alias("removed"))


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 80) -> DataFrame:
    """docs with the repeated lines taken out of the text; all rows and columns, whatever their names, stay, a null text
    stays null. Which lines go: as in line_report()."""
    kept = docs.columns
    numbered = cut(docs.select(F.monotonically_increasing_id().alias("row"), F.struct(*[F.col(f"`{c}`") for c in kept]).alias("doc")), "documents")
    text = F.col(f"doc.`{text_col}`")
    rows = numbered.select("row", F.col(f"doc.`{id_col}`").cast("long").alias("doc_id"), F.coalesce(text, F.lit("")).alias("text"))
    _, gone = repeated_lines(rows, percent)
    gone = gone.groupBy("row").agg(F.sort_array(F.collect_list("pos")).alias("gone"))
    left = F.filter(F.split(text, "\n", -1), lambda x, i: ~F.array_contains(F.col("gone"), i))
    text = F.when(F.col("gone").isNull(), text).otherwise(F.array_join(left, "\n"))
    return numbered.join(gone, "row", "left").select(*[(text if c == text_col else F.col(f"doc.`{c}`")).alias(c) for c in kept])
