"""A corpus pipeline of five stages over `documents`; each takes (spark, docs, sf_dir) and returns a DataFrame.

All but the last return the columns of documents. Stages are written as Parquet and read again, so that
each starts from files in the shared folder.

In every stage a null text counts as empty, rows without id or source are rows like others, repeated rows are
judged each by itself (near duplicates: rows of one id alike), texts are read whole however long, further
columns pass whatever their names, and an empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidewell.llm.common import cut, table
from tidewell.llm.decontaminate import clean_documents
from tidewell.llm.entry import tokenizer_path
from tidewell.llm.mixing import mixed_documents
from tidewell.llm.near_dedup import keep_one
from tidewell.llm.quality import quality_filter
from tidewell.llm.token_output import token_output

#: No SQL expresses the trees, the draws or the tokenizer.
ORACLE_SQL = None


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the quality rules; a null or empty text has too few words, one of over a million words too many."""
    return quality_filter(docs)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest id, of each group of near duplicates: five-word shingles, similarity 0.8. Documents
    without words or id are alike to none and stay."""
    return keep_one(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a window of the benchmark; an empty benchmark leaves all."""
    return clean_documents(docs, table(spark, sf_dir, "benchmark"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix of the sources: a document comes as often as it is drawn, at most twice, where only part of it is
    drawn with that part of its text. Documents without words give none."""
    return mixed_documents(docs)


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of the written and reread token table, in ascending order of ids, null first; rows
    of one id by their number of tokens and these."""
    out = token_output(docs, tokenizer_path("word_bpe_49k.json"), end_id=1, vocabulary=49_408)
    return out.select("doc_id", "start", "n_tokens", "ids_crc32")


STAGES = [
    ("quality rules", quality_stage),
    ("near dedup", near_dedup_stage),
    ("decontamination", decontamination_stage),
    ("mixing", mixing_stage),
    ("token output", token_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to documents."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), name.replace(" ", "_"))
    return STAGES[-1][1](spark, docs, sf_dir)
