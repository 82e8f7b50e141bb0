"""Token counts of a byte-level BPE vocabulary by rank-synchronous merging of ragged arrays.

Texts are split into pre-tokens; the distinct ones of a batch become one flat symbol array with
sequence offsets. In each round every sequence applies its lowest-ranked pair at all its places at
once; a sequence without a mergeable pair leaves with its count of surviving symbols.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The pre-token pattern and byte alphabet of the byte-level vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Counts of pre-tokens kept by a worker at most; beyond it the store starts anew (results don't change).
STORE = 400_000
#: Characters whose pre-tokens are held at once.
CHUNK = 1_000_000
NONE = np.iinfo(np.int64).max


def byte_alphabet() -> dict[str, int]:
    """Character -> byte: printable bytes stand for themselves, others take code points from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Merges:
    """A vocabulary's merges as sorted pair keys with their ranks and results."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab = spec["model"]["vocab"]
        merges = [m.split(" ", 1) if isinstance(m, str) else m for m in spec["model"]["merges"]]
        self.width = max(vocab.values()) + 1
        self.specials = [t["content"] for t in spec["added_tokens"]]
        self.of_byte = np.zeros(256, np.int64)
        for c, b in byte_alphabet().items():
            self.of_byte[b] = vocab[c]
        left, right, new = (np.array(x, np.int64) for x in zip(*((vocab[a], vocab[b], vocab[a + b]) for a, b in merges), strict=True))
        key = left * self.width + right
        order = np.argsort(key, kind="stable")
        self.key, self.rank, self.new = key[order], order.astype(np.int64), new[order]
        # a table over the first 2^20 hashes answers most misses without a search
        self.may = np.zeros(1 << 20, bool)
        self.may[self._slot(self.key)] = True

    @staticmethod
    def _slot(key: np.ndarray) -> np.ndarray:
        return ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(44)).astype(np.int64)

    def find(self, key: np.ndarray) -> np.ndarray:
        """Index of each pair among the merges, or -1."""
        out = np.full(len(key), -1, np.int64)
        at = np.flatnonzero(self.may[self._slot(key)])
        i = np.minimum(np.searchsorted(self.key, key[at]), len(self.key) - 1)
        hit = self.key[i] == key[at]
        out[at[hit]] = i[hit]
        return out

    def counts(self, words: list[bytes]) -> np.ndarray:
        """Symbols that survive in each of the non-empty byte strings."""
        size = np.fromiter(map(len, words), np.int64, len(words))
        symbol = self.of_byte[np.frombuffer(b"".join(words), np.uint8)]
        live, done = np.arange(len(words)), size.copy()
        while len(live):
            start = np.cumsum(size) - size
            last = start + size - 1
            key = np.zeros(len(symbol), np.int64)
            key[:-1] = symbol[:-1] * self.width + symbol[1:]
            key[last] = -1
            inner = np.flatnonzero(key >= 0)
            found = np.full(len(symbol), -1, np.int64)
            found[inner] = self.find(key[inner])
            rank = np.where(found >= 0, self.rank[found], NONE)
            least = np.minimum.reduceat(rank, start)
            chosen = (rank == np.repeat(least, size)) & (found >= 0)
            # neighbours chosen together are one pair overlapping itself: every second place, from the left
            place = np.flatnonzero(chosen)
            first = np.ones(len(place), bool)
            first[1:] = place[1:] != place[:-1] + 1
            run = np.maximum.accumulate(np.where(first, np.arange(len(place)), 0))
            place = place[(np.arange(len(place)) - run) % 2 == 0]
            symbol[place] = self.new[found[place]]
            keep = np.ones(len(symbol), bool)
            keep[place + 1] = False
            gone = np.add.reduceat((~keep).astype(np.int64), start)
            size = size - gone
            done[live] = size
            going = (least != NONE) & (size > 1)
            keep &= np.repeat(going, size + gone)
            symbol, size, live = symbol[keep], size[going], live[going]
        return done


@lru_cache(maxsize=2)
def counter(path: str):
    """A function from a list of texts to their token counts."""
    import regex

    merges = Merges(path)
    split = regex.compile(PATTERN)
    special = regex.compile("|".join(map(regex.escape, merges.specials))) if merges.specials else None
    store: dict[str, int] = {}

    def pieces(text: str) -> Iterator[tuple[int, list[str]]]:
        """(special tokens, pre-tokens) of the text, a bounded number at a time."""
        for part in special.split(text) if special else [text]:
            if len(part) <= CHUNK:
                yield 1, split.findall(part)
                continue
            held: list[str] = []
            size, first = 0, 1
            for m in split.finditer(part):
                held.append(m[0])
                size += len(m[0])
                if size >= CHUNK:
                    yield first, held
                    held, size, first = [], 0, 0
            yield first, held

    def count(texts: list[str]) -> list[int]:
        out = [0] * len(texts)
        held: list[tuple[int, list[str]]] = []
        size = 0

        def flush() -> None:
            nonlocal size
            new = list(set().union(*(t for _, t in held)).difference(store)) if held else []
            if len(store) + len(new) > STORE:
                store.clear()
                new = list(set().union(*(t for _, t in held)))
            if new:
                store.update(zip(new, merges.counts([w.encode("utf-8") for w in new]).tolist(), strict=True))
            for i, tokens in held:
                out[i] += sum(map(store.__getitem__, tokens))
            held.clear()
            size = 0

        for i, text in enumerate(texts):
            n = 0
            for first, tokens in pieces(text):
                n += first
                held.append((i, tokens))
                size += len(text)
                if size >= CHUNK:
                    flush()
            out[i] += n - 1
        flush()
        return out

    return count


def token_counts(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 1024) -> DataFrame:
    """(id, n_bytes, n_tokens, over_limit) for each row of docs.

    A null text counts as empty: 0 bytes, 0 tokens. Repeated ids and null ids keep a row each; other
    columns don't pass. Memory holds the pre-tokens of CHUNK characters and STORE kept counts.
    `path` is the vocabulary file, which every executor must have at that place.
    """
    rows = docs.select(F.col(id_col).alias(id_col), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    kind = dict(rows.dtypes)[id_col]

    def run(batches):
        import pyarrow as pa

        count = counter(path)
        for b in batches:
            texts = b.column(1).to_pylist()
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(count(texts), pa.int64())], [id_col, "n_bytes", "n_tokens"])

    rows = rows.withColumn("n_bytes", F.octet_length("_text").cast("long"))
    out = rows.mapInArrow(run, f"`{id_col}` {kind}, n_bytes long, n_tokens long")
    return out.withColumn("over_limit", F.col("n_tokens") > limit)
