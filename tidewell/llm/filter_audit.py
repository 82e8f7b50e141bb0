"""Interaction of filters by direct relational replay.

Each document becomes a mask of the filters it fails. Masks are crossed with the broadcast orders of the filters, the
steps of each order are exploded, the first failing step is found, and conditional sums count what each step removes.
Documents of one part, mask and label are counted together before they are crossed: the replay is linear in counts.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut

CAPITALS, SYMBOLS = bytes(range(0x41, 0x5B)), b"#$%&*|"
#: Bytes of UTF-8 that don't begin a code point.
INNER = bytes(range(0x80, 0xC0))
LETTERS = "ABCDE"


def text_mask(text: bytes) -> int:
    """Bits of the filters A to D that the text fails: few words, repeated words, capitals, symbols."""
    words = text.split()  # of bytes: at 0x20 and 0x09 to 0x0D
    capitals = len(text) - len(text.translate(None, CAPITALS))
    points = len(text.translate(None, INNER))
    return (len(words) < 100) | (100 * len(set(words)) < 80 * len(words)) << 1 | (100 * capitals > 10 * points) << 2 | (len(text.translate(None, SYMBOLS)) < len(text)) << 3


def document_flags(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """(id, part, digest, mask) of each row: the text's SHA-256 and the filters A to D that it fails.

    A null text is empty, a null part is an empty string. Texts are read whole.
    """
    rows = docs.select(
        F.col(f"`{id_col}`").alias("id"), F.coalesce(F.col(f"`{part_col}`").cast("string"), F.lit("")).alias("part"),
        F.coalesce(F.col(f"`{text_col}`"), F.lit("")).cast("binary").alias("text"),
    )

    def run(batches):
        from hashlib import sha256

        import pyarrow as pa

        for b in batches:
            texts = b.column("text").to_pylist()
            digests = pa.array([sha256(t).digest() for t in texts], pa.binary())
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("part"), digests, pa.array(map(text_mask, texts), pa.int32())], ["id", "part", "digest", "mask"])

    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, part string, digest binary, mask int")


def replay(groups: DataFrame, letters: str) -> DataFrame:
    """(part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley) of `groups` (part,
    mask, good, toxic, n): n documents that fail the filters of a mask, the first letter's filter at bit 0.

    Every order of the letters is replayed; there are factorial(len(letters)) of them, 120 for five.
    """
    if not 1 <= len(letters) <= 6:
        raise ValueError("one to six filters")
    spark = groups.sparkSession
    bit = {c: 1 << i for i, c in enumerate(letters)}
    orders = ", ".join(f"('{''.join(o)}', array({', '.join(str(bit[c]) for c in o)}))" for o in permutations(letters))
    orders = spark.sql(f"select * from values {orders} as t(filter_order, bits)")
    fails = lambda b: F.col("mask").bitwiseAND(b) != 0
    runs = groups.crossJoin(F.broadcast(orders)).withColumn("first", F.array_position(F.transform("bits", fails), F.lit(True)))
    steps = runs.select("*", F.posexplode("bits").alias("at", "bit")).withColumn("step", F.col("at") + 1)
    here, early = F.col("first") == F.col("step"), (F.col("first") > 0) & (F.col("first") < F.col("step"))
    count = lambda when, name: F.sum(F.when(when, F.col("n")).otherwise(F.lit(0))).cast("long").alias(name)
    out = steps.groupBy("part", "filter_order", "step", "bit").agg(
        count(~here & ~early, "kept"), count(here, "removed"), count(early & fails(F.col("bit")), "redundant"), count(F.col("mask") == F.col("bit"), "unique_fails"),
        count(here & F.col("good"), "good_lost"), count(here & F.col("toxic"), "toxic_lost"),
    )
    total = F.sum("removed").over(Window.partitionBy("part", "bit"))
    return out.withColumn("shapley", total.cast("long")).drop("bit")


def filter_audit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """replay() of the filters A to D of document_flags() and E, a text that a row of smaller id has too, over each part of docs.

    Rows without id have no smaller id: E passes them, nor do they make others fail. Repeated rows count each; rows
    of one id and text don't fail E by each other. A document is good or toxic if any row of `labels` with its id says
    so; null labels say nothing. Further columns have no effect; an empty table gives no rows.

    Copies share a digest, whose least id is aggregated before the shuffle; rows meet it by (id, digest), so that a
    third of all rows with one text still spreads by id.
    """
    flags = cut(document_flags(docs, id_col, text_col, part_col), "flags")
    first = flags.groupBy("digest").agg(F.min("id").alias("id")).where("id is not null").withColumn("first", F.lit(True))
    said = labels.groupBy(F.col(f"`{id_col}`").alias("id")).agg(F.max(F.col("quality") == 1).alias("good"), F.max(F.col("toxic") == 1).alias("toxic"))
    repeat = F.when(F.col("id").isNotNull() & F.col("first").isNull(), 1 << 4).otherwise(0)
    yes = lambda c: F.coalesce(F.col(c), F.lit(False)).alias(c)
    rows = flags.join(first, ["id", "digest"], "left").join(said, "id", "left")
    rows = rows.select("part", F.col("mask").bitwiseOR(repeat).alias("mask"), yes("good"), yes("toxic"))
    return replay(rows.groupBy("part", "mask", "good", "toxic").agg(F.count("*").alias("n")), LETTERS)
