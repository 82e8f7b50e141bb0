"""Token ids on disk: frequency-ranked ids in a byte-aligned variable-length code.

Ids are replaced by their rank of frequency over the whole corpus, so that most fit one byte. A
block holds the 2-bit byte counts of its ranks (four to a control byte) apart from their bytes, in
little-endian order; numpy decodes it by a table lookup on the control bytes.

Format of a table: Parquet files, one for each range of ids, one row for each block: `part`, `block`
(their order), `inside` (ids of the part before the block), `doc_ids`, `sizes` (ids of each document
with its end id), `n_tokens`, `control`, `data`. Beside it, `ranks` lists the vocabulary ids by rank.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from functools import lru_cache
from struct import pack

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import new_path
from .token_count import byte_alphabet

#: Fixed value: the vocabulary's split of lower-case text into pieces.
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+"
#: Words for which lower case and split are plain: printable Latin letters and signs, composed already.
PLAIN = r"[!-~\u00a1-\u012f\u0131-\u017f]+"

#: Encoded words kept by a worker, besides those of one text; beyond it the store starts anew (results don't change).
STORE = 400_000
#: Characters split at once.
CHUNK = 1_000_000
#: Ids of a block, unless one document has more.
BLOCK = 1 << 18

_BYTES = 1 + (np.arange(256)[:, None] >> np.array([0, 2, 4, 6])) % 4
#: Control byte -> which of the 16 bytes of its four values are stored.
_STORED = (np.arange(4) < _BYTES[:, :, None]).reshape(256, 16)


def encode_block(values: np.ndarray) -> tuple[bytes, bytes]:
    """(control, data) of unsigned 32-bit values."""
    v = np.zeros(-len(values) % 4 + len(values), "<u4")
    v[: len(values)] = values
    code = (v > 0xFF).astype(np.uint8) + (v > 0xFFFF) + (v > 0xFFFFFF)
    four = code.reshape(-1, 4)
    control = (four[:, 0] | four[:, 1] << 2 | four[:, 2] << 4 | four[:, 3] << 6).astype(np.uint8)
    return control.tobytes(), v.view(np.uint8).reshape(-1, 16)[_STORED[control]].tobytes()


def decode_block(control: bytes, data: bytes, n: int) -> np.ndarray:
    """The n values of a block."""
    at = np.frombuffer(control, np.uint8)
    out = np.zeros((len(at), 16), np.uint8)
    out[_STORED[at]] = np.frombuffer(data, np.uint8)
    return out.reshape(-1).view("<u4")[:n]


class Encoded(dict):
    """Words and their ids as little-endian unsigned 32-bit bytes; a word that is missing is encoded. Plain Latin words are
    lower-cased and split here, and their pieces go to the library's model; all others go through its whole chain."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import regex
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.model, self.split, self.plain = self.library.model, regex.compile(PIECES).findall, regex.compile(PLAIN).fullmatch
        self.pieces: dict[str, bytes] = {}
        self.shown = {b: c for c, b in byte_alphabet().items()}

    def piece(self, x: str) -> bytes:
        y = x if x.isascii() else "".join(map(self.shown.__getitem__, x.encode()))
        ids = [t.id for t in self.model.tokenize(y)]
        out = self.pieces[x] = pack(f"<{len(ids)}I", *ids)
        return out

    def __missing__(self, word: str) -> bytes:
        if word.isascii() and word.isalpha():  # one piece
            x = word.lower()
            out = self.pieces.get(x) or self.piece(x)
        elif self.plain(word) and "<|" not in word:
            known = self.pieces.get
            out = b"".join([known(x) or self.piece(x) for x in self.split(word.lower())])
        else:
            out = np.array(self.library.encode(word, add_special_tokens=False).ids, "<u4").tobytes() if word else b""
        self[word] = out
        return out


@lru_cache(maxsize=2)
def word_encoder(path: str, end_id: int):
    """A function from a text to its ids with the end id, as little-endian unsigned 32-bit bytes.

    The vocabulary drops white space and no token spans it, so each run between spaces or line
    feeds is encoded once and kept; a bounded number of them is.
    """
    store = Encoded(path)
    end = np.array([end_id], "<u4").tobytes()

    def slices(text: str) -> Iterator[str]:
        at = 0
        while len(text) - at > CHUNK:
            to = text.find(" ", at + CHUNK)
            if to < 0:
                break
            yield text[at:to]
            at = to
        yield text[at:] if at else text

    def encode(text: str) -> bytes:
        out = []
        for part in slices(text):
            if len(store) > STORE:
                store.clear()
            if len(store.pieces) > STORE:
                store.pieces.clear()
            out.append(b"".join(map(store.__getitem__, part.replace("\n", " ").split(" "))))
        return b"".join([*out, end])

    return encode


def encode_documents(docs: DataFrame, path: str, end_id: int, vocabulary: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(kind, doc_id, n_tokens, ids): the ids of each text with the end id, as unsigned 16-bit or 32-bit bytes (kind 0), and
    for each task the count of each id it met, by id, as long bytes (kind 1)."""
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))

    def run(batches):
        import pyarrow as pa

        names = ["kind", "doc_id", "n_tokens", "ids"]
        encode = word_encoder(path, end_id)
        total = np.zeros(vocabulary, np.int64)
        for b in batches:
            for k in range(0, b.num_rows, 500):
                part = b.slice(k, 500)
                ids = [np.frombuffer(encode(t.as_py()), "<u4") for t in part.column(1)]
                n = np.array([len(x) for x in ids], np.int64)
                total += np.bincount(np.concatenate(ids), minlength=vocabulary)
                narrow = [(x if (x > 0xFFFF).any() else x.astype("<u2")).tobytes() for x in ids]
                yield pa.RecordBatch.from_arrays([pa.array(np.zeros(len(n), np.int32)), part.column(0), pa.array(n), pa.array(narrow, pa.binary())], names)
        last = [pa.array([1], pa.int32()), pa.array([None], pa.int64()), pa.array([int(total.sum())], pa.int64()), pa.array([total.tobytes()], pa.binary())]
        yield pa.RecordBatch.from_arrays(last, names)

    return rows.mapInArrow(run, "kind int, doc_id long, n_tokens long, ids binary")


def _widen(ids: bytes, n: int) -> np.ndarray:
    """Ids from 16-bit or 32-bit bytes, told apart by their number."""
    return np.frombuffer(ids, "<u2" if len(ids) == 2 * n else "<u4").astype(np.uint32)


def frequency_ranks(counts: DataFrame, vocabulary: int) -> np.ndarray:
    """Vocabulary ids by falling count over all documents, ties by id, from the counts (ids) of the tasks. The driver gets
    one number for each id of the vocabulary."""

    def run(batches):
        import pyarrow as pa

        total = np.zeros(vocabulary, np.int64)
        for b in batches:
            for ids in b.column(0):
                total += np.frombuffer(ids.as_py(), np.int64)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total[at], pa.int64())], ["id", "n"])

    found = counts.select("ids").mapInArrow(run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).toArrow()  # the vocabulary at most
    total = np.zeros(vocabulary, np.int64)
    total[found.column(0).to_numpy()] = found.column(1).to_numpy()
    return np.argsort(-total, kind="stable")


def write_tokens(docs: DataFrame, out: str, path: str, end_id: int, vocabulary: int, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Encode every text and write the token table to `out`, in ascending order of the ids.

    A null text is empty and has the end id only. Null ids come first; rows of equal id are ordered
    by their number of ids and then by these ids. An empty table gives no blocks. Other columns don't
    pass. A very long text is encoded CHUNK characters at a time and is one block.
    """
    spark = docs.sparkSession
    held = new_path(spark, "ids")
    encoded = encode_documents(docs, path, end_id, vocabulary, id_col, text_col)
    encoded.write.partitionBy("kind").parquet(held)
    tables = spark.read.schema("doc_id long, n_tokens long, ids binary, kind int").parquet(held)
    encoded = tables.where("kind = 0").drop("kind")
    of_rank = frequency_ranks(tables.where("kind = 1"), vocabulary)
    ranks = np.empty(vocabulary, np.uint32)
    ranks[of_rank] = np.arange(vocabulary, dtype=np.uint32)
    shared = spark.sparkContext.broadcast(ranks)  # as long as the vocabulary

    def run(batches):
        import pyarrow as pa

        names = ["part", "block", "inside", "doc_ids", "sizes", "n_tokens", "control", "data"]
        held: list[tuple[int | None, np.ndarray]] = []
        part, block, inside, size = -1, 0, 0, 0

        def flush():
            nonlocal block, inside, size
            values = np.concatenate([v for _, v in held])
            control, data = encode_block(shared.value[values])
            cols = [[part], [block], [inside], [[d for d, _ in held]], [[len(v) for _, v in held]], [len(values)], [control], [data]]
            kinds = [pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.int64(), pa.binary(), pa.binary()]
            block, inside, size = block + 1, inside + len(values), 0
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names)

        for b in batches:
            for p, d, n, ids in zip(*(b.column(i) for i in range(4)), strict=True):
                part = p.as_py()
                held.append((d.as_py(), _widen(ids.as_py(), n.as_py())))
                size += len(held[-1][1])
                if size >= BLOCK:
                    yield flush()
        if held:
            yield flush()

    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = encoded.repartitionByRange(n, "doc_id").sortWithinPartitions("doc_id", "n_tokens", "ids")
    ordered = ordered.select(F.spark_partition_id().alias("part"), "doc_id", "n_tokens", "ids")
    schema = "part int, block long, inside long, doc_ids array<long>, sizes array<long>, n_tokens long, control binary, data binary"
    ordered.mapInArrow(run, schema).write.parquet(f"{out}/blocks")
    rank_rows = [(i, int(x)) for i, x in enumerate(of_rank)]
    spark.createDataFrame(rank_rows, "rank long, id long").coalesce(1).write.parquet(f"{out}/ranks")


def read_tokens(spark: SparkSession, out: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids): each document of a token table, `ids` as unsigned 32-bit bytes,
    `start` the number of ids of all documents before it."""
    blocks = spark.read.parquet(f"{out}/blocks")
    of_rank = np.array([r["id"] for r in spark.read.parquet(f"{out}/ranks").orderBy("rank").collect()], "<u4")  # the vocabulary
    shared = spark.sparkContext.broadcast(of_rank)
    w = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = blocks.groupBy("part").agg(F.sum("n_tokens").alias("n")).select("part", F.coalesce(F.sum("n").over(w), F.lit(0)).alias("base"))

    def run(batches):
        import pyarrow as pa

        for b in batches:
            for row in b.to_pylist():
                ids = shared.value[decode_block(row["control"], row["data"], row["n_tokens"])]
                ends = np.cumsum(row["sizes"])
                starts = ends - row["sizes"]
                cols = [
                    pa.array(row["doc_ids"], pa.int64()),
                    pa.array(starts + row["inside"] + row["base"], pa.int64()),
                    pa.array(row["sizes"], pa.int64()),
                    pa.array([ids[i:j].tobytes() for i, j in zip(starts, ends, strict=True)], pa.binary()),
                ]
                yield pa.RecordBatch.from_arrays(cols, ["doc_id", "start", "n_tokens", "ids"])

    rows = blocks.join(base, "part").select("base", "inside", "doc_ids", "sizes", "n_tokens", "control", "data")
    return rows.mapInArrow(run, "doc_id long, start long, n_tokens long, ids binary")


def token_output(docs: DataFrame, path: str, end_id: int, vocabulary: int, out: str | None = None) -> DataFrame:
    """Write the token table and give what is read back: (doc_id, start, n_tokens, ids, ids_crc32)."""
    out = out or new_path(docs.sparkSession, "tokens")
    write_tokens(docs, out, path, end_id, vocabulary)
    return read_tokens(docs.sparkSession, out).withColumn("ids_crc32", F.crc32("ids"))
