"""Quality rules: a threshold table compiled into one projection of DataFrame functions.

Every measure is a column expression over the text's words and lines, every rule a bound on a
measure, and the verdict their conjunction: one scan, no shuffle, no user function.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD

#: Fixed value: characters that count as symbols.
SYMBOLS = "#*$%&|<>"
#: Words of a window that is looked for again in its text.
WINDOW = 8
#: Common words of English, German, French and Spanish.
STOP_WORDS = (
    "the of and to in is that it was for on are with as be at this by from "
    "der die das und ist nicht ein eine zu den mit von auf für im "
    "le la les de des et un une est que qui en du pour dans "
    "el los las y es una por con para se no lo al"
).split()


@dataclass(frozen=True)
class Rule:
    """Keep texts whose measure lies within [least, most]; texts of fewer than `words` words pass."""

    measure: str
    least: float | None = None
    most: float | None = None
    words: int = 0


#: Bounds of the method, wide enough for short notes, lists and any of the four languages.
RULES = (
    Rule("n_words", least=20, most=1_000_000),
    Rule("mean_word_chars", least=2.0, most=15.0),
    Rule("symbol_ratio", most=0.1),
    Rule("alpha_word_ratio", least=0.6),
    Rule("stop_word_ratio", least=0.02, words=50),
    Rule("dup_line_ratio", most=0.5),
    Rule("ellipsis_line_ratio", most=0.3),
    Rule("bullet_line_ratio", most=0.9),
    Rule("repeat_word_ratio", most=0.3),
)


def _windows(words: str) -> Column:
    """A hash of every window of the words' hashes."""
    n = F.size(words) - (WINDOW - 1)
    at = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    return F.transform(at, lambda i: F.xxhash64(*[F.get(F.col(words), i + k) for k in range(WINDOW)]))


def _covered(hashes: str, n_words: str) -> Column:
    """Words within windows whose hash occurs twice or more: places in order of hash, those with an
    equal neighbour in order of place, and each window's words up to the next window."""
    pairs = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    again = F.filter(
        F.transform(
            F.arrays_zip(pairs.alias("x"), F.slice(pairs, 2, F.size(hashes)).alias("y"), F.concat(F.array(F.lit(None).cast("struct<h:bigint,i:int>")), pairs).alias("w")),
            lambda z: F.when((z["x"]["h"] == z["y"]["h"]) | (z["x"]["h"] == z["w"]["h"]), z["x"]["i"]),
        ),
        lambda i: i.isNotNull(),
    )
    total = F.aggregate(
        F.array_sort(again),
        F.struct(F.lit(0).alias("n"), F.lit(0).alias("to")),
        lambda s, i: F.struct((s["n"] + i + WINDOW - F.greatest(s["to"], i)).alias("n"), (i + WINDOW).alias("to")),
        lambda s: s["n"],
    )
    return total


def measures(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with a struct column `q` of the measures of each text (null: an empty text). The columns
    of docs, whatever their names, stay as they are."""
    kept = docs.columns
    out = docs.select(F.struct(*[F.col(f"`{c}`") for c in kept]).alias("row"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    out = out.select("row", "text", F.regexp_extract_all("text", F.lit(WORD), F.lit(0)).alias("words"), F.filter(F.split("text", "\n", -1), lambda x: x.rlike(WORD)).alias("lines"))
    out = out.withColumns({
        "hashes": F.transform("words", lambda w: F.xxhash64(w)),
        "n_words": F.size("words").cast("long"),
        "n_lines": F.size("lines").cast("long"),
        "lower": F.transform("words", lambda w: F.lower(w)),
    })
    out = out.withColumn("windows", _windows("hashes"))
    out = out.withColumn("sorted", F.sort_array("windows"))
    out = out.withColumn("distinct", F.size(F.array_distinct("windows")))
    stop = F.array(*map(F.lit, sorted(set(STOP_WORDS))))
    long = lambda c: c.cast("long")
    out = out.select(
        "row", "n_words", "n_lines",
        long(F.length(F.regexp_replace("text", r"[\x20\x09-\x0D]+", ""))).alias("word_chars"),
        long(F.length("text") - F.length(F.translate("text", SYMBOLS, ""))).alias("n_symbols"),
        long(F.size("lines") - F.size(F.array_distinct("lines"))).alias("n_dup_lines"),
        long(F.when(F.col("distinct") < F.size("windows"), _covered("windows", "n_words")).otherwise(0)).alias("n_repeat_words"),
        long(F.size(F.filter("lower", lambda w: F.array_contains(stop, w)))).alias("n_stop_words"),
        long(F.size(F.filter("words", lambda w: w.rlike(r"\p{L}")))).alias("n_alpha_words"),
        long(F.size(F.filter("lines", lambda x: x.rlike(r"(?:\.\.\.|…)\s*$")))).alias("n_ellipsis_lines"),
        long(F.size(F.filter("lines", lambda x: x.rlike(r"^\s*[-*•]\s")))).alias("n_bullet_lines"),
    )
    per = lambda a, b: F.col(a) / F.greatest(F.col(b), F.lit(1))
    ratios = {
        "mean_word_chars": per("word_chars", "n_words"), "symbol_ratio": per("n_symbols", "word_chars"), "alpha_word_ratio": per("n_alpha_words", "n_words"),
        "stop_word_ratio": per("n_stop_words", "n_words"), "dup_line_ratio": per("n_dup_lines", "n_lines"), "ellipsis_line_ratio": per("n_ellipsis_lines", "n_lines"),
        "bullet_line_ratio": per("n_bullet_lines", "n_lines"), "repeat_word_ratio": per("n_repeat_words", "n_words"),
    }
    out = out.withColumns(ratios)
    # what a generator makes is no alias: a filter on it stays above, where else its measures would be worked out anew in
    # each of its terms, with the texts split again in each
    return out.select("row", F.explode(F.array(F.struct(*[c for c in out.columns if c != "row"]))).alias("q"))


def verdict(rules: tuple[Rule, ...] = RULES) -> Column:
    """The conjunction of the rules over the struct column `q`."""
    keep = F.lit(True)
    for r in rules:
        x = F.col(f"q.{r.measure}")
        holds = F.lit(True)
        if r.least is not None:
            holds = holds & (x >= r.least)
        if r.most is not None:
            holds = holds & (x <= r.most)
        keep = keep & (holds | (F.col("q.n_words") < r.words) if r.words else holds)
    return keep


def quality(docs: DataFrame, text_col: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(row, q, base_failed, kept) for each row of docs: `row` holds its columns, `q` its measures.

    base_failed: under 20 words, or over 30 % of the words in repeated windows. kept: the base check
    and every rule hold. A null or empty text has no words and fails. Repeated rows are judged alike,
    each by itself; windows longer than the text don't exist. An empty table gives no rows. Very long texts
    are judged whole: a task holds the words of one text.
    """
    out = measures(docs, text_col)
    failed = (F.col("q.n_words") < 20) | (100 * F.col("q.n_repeat_words") > 30 * F.col("q.n_words"))
    return out.select("row", "q", failed.alias("base_failed"), (~failed & verdict(rules)).alias("kept"))


def quality_filter(docs: DataFrame, text_col: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The rows of docs that are kept, with their columns, whatever their names. Nulls, repeats, empty tables: as in quality()."""
    return quality(docs, text_col, rules).where("kept").select("row.*")
