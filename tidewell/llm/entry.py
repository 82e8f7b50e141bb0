"""Queries opN_<name> of the corpus operators over the whole test tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table
from .decontaminate import decontaminate
from .filter_audit import filter_audit
from .hard_negatives import hard_negatives, scaled
from .line_dedup import line_report
from .mixing import mixed_sizes
from .near_dedup import near_duplicates
from .passage_dedup import passage_report
from .pii import KINDS, personal_data, span_text
from .quality import quality
from .suffix_dedup import remove_repeats
from .token_count import token_counts
from .token_output import token_output
from .url_rules import url_verdicts


def tokenizer_path(name: str) -> str:
    """Place of a public vocabulary file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = personal_data(table(spark, sf_dir, "documents"))
    kinds = F.col("base.kind")
    counts = [(F.size(kinds) - F.size(F.array_remove(kinds, k))).cast("long").alias(f"n_{k}") for k in KINDS]
    return found.select("doc_id", *counts, F.sha2(span_text("base"), 256).alias("base_sha256"), span_text("spans").alias("spans"), F.size("spans").cast("long").alias("n_spans"))


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    return quality(table(spark, sf_dir, "documents")).select("row.doc_id", *[f"q.{c}" for c in names], "base_failed", "kept")


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), keep=["doc_id"])
    ids = F.array_join("items", ",")
    return found.select(
        "row.doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(ids, 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"), "longest", "item_id", "item_word", "doc_word",
    )


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_report(table(spark, sf_dir, "documents"))


def op6_passage_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passage_report(table(spark, sf_dir, "documents"))


def op7_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = token_output(docs, tokenizer_path("word_bpe_49k.json"), end_id=1, vocabulary=49_408)
    return out.select("doc_id", "start", "n_tokens", "ids_crc32")


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = remove_repeats(table(spark, sf_dir, "documents"))
    removed = F.aggregate("removed", F.lit(0).cast("long"), lambda s, x: s + x["end"] - x["start"])
    return found.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("removed").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op9_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), size=4)


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixed_sizes(table(spark, sf_dir, "documents"))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")).alias("label"))
    return hard_negatives(scaled(rows), "id % 50 = 0")


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


#: The rules of op13: host, path, verdict.
URL_RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block")]
RULES_SQL = "select * from (values " + ", ".join(map(str, URL_RULES)) + ") as t(host, path, verdict)"


def op13_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_verdicts(table(spark, sf_dir, "pages"), spark.sql(RULES_SQL))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_pii": op1_pii,
        "op2_token_counts": op2_token_counts,
        "op3_quality_rules": op3_quality_rules,
        "op4_decontamination": op4_decontamination,
        "op5_line_dedup": op5_line_dedup,
        "op6_passage_dedup": op6_passage_dedup,
        "op7_token_output": op7_token_output,
        "op8_suffix_dedup": op8_suffix_dedup,
        "op9_near_dedup": op9_near_dedup,
        "op10_mixing": op10_mixing,
        "op11_hard_negatives": op11_hard_negatives,
        "op12_filter_audit": op12_filter_audit,
        "op13_url_rules": op13_url_rules,
    }


HARD_NEGATIVES_SQL = """with rows as (
 select vec_id as id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label, list_transform(embedding, lambda x: floor(256 * x::double)::bigint) as v
 from embeddings where vec_id is not null and label is not null and embedding is not null
 and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
scored as (select a.id as a, b.id as b, a.label = b.label as same,
 list_sum(list_transform(range(1, len(a.v) + 1), lambda i: a.v[i] * b.v[i]))::bigint as s
 from rows a, rows b where a.id % 50 = 0 and a.id <> b.id),
positives as (select a, b, s, row_number() over (partition by a order by s desc, b) as n from scored where same qualify n <= 5)
select p.a as anchor_id, p.b as positive_id, row_number() over (partition by p.a, p.b order by x.s desc, x.b)::int as rank,
 x.b as negative_id, p.s as positive_score, x.s as negative_score
from positives p join scored x on x.a = p.a and not x.same and 50 * p.s <= 100 * x.s and 100 * x.s <= 95 * p.s qualify rank <= 3"""

FILTER_AUDIT_SQL = r"""with texts as (select doc_id, coalesce(lang, '') as part, coalesce(text, '') as text from documents),
parts as (select *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') as w, min(doc_id) over (partition by text) as least from texts),
said as (select doc_id, bool_or(quality = 1) as good, bool_or(toxic = 1) as toxic from labels group by doc_id),
flags as (select part, coalesce(good, false) as good, coalesce(toxic, false) as toxic, map {
 'A': len(w) < 100, 'B': 100 * len(list_distinct(w)) < 80 * len(w), 'C': 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 10 * length(text),
 'D': regexp_matches(text, '[#$%&*|]'), 'E': coalesce(p.doc_id > least, false)} as fails from parts p left join said using (doc_id)),
alphabet as (select unnest(['A', 'B', 'C', 'D', 'E']) as x),
orders as (select a.x || b.x || c.x || d.x || e.x as o from alphabet a, alphabet b, alphabet c, alphabet d, alphabet e
 where len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
runs as (select part, good, toxic, fails, o, coalesce(list_position(list_transform(string_split(o, ''), lambda x: fails[x]), true), 0) as first from flags, orders),
steps as (select *, unnest([1, 2, 3, 4, 5]) as step from runs),
judged as (select *, o[step] as x, first = step as here, first > 0 and first < step as early, fails[o[step]] as bad from steps),
counts as (select part, o as filter_order, step::int as step, x, count(*) filter (not here and not early) as kept, count(*) filter (here) as removed,
 count(*) filter (early and bad) as redundant, count(*) filter (bad and len(list_filter(map_values(fails), lambda y: y)) = 1) as unique_fails,
 count(*) filter (here and good) as good_lost, count(*) filter (here and toxic) as toxic_lost from judged group by all)
select * exclude (x), (sum(removed) over (partition by part, x))::bigint as shapley from counts"""

URL_RULES_SQL = f"""with rules as ({RULES_SQL}),
urls as (select page_id, row_number() over () as n, translate(regexp_extract(u, '(?s)^.*?://([^/?#]*)([^?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
 regexp_extract(u, '(?s)^.*?://([^/?#]*)([^?#]*)', 2) as path from (select page_id, coalesce(url, '') as u from pages))
select u.page_id, u.host, u.path, r.host || r.path as rule, coalesce(r.verdict, 'allow') as verdict
from urls u left join rules r on (u.host = r.host or ends_with(u.host, '.' || r.host)) and starts_with(u.path, r.path)
qualify row_number() over (partition by u.n order by length(r.host || r.path) desc nulls last, length(r.host) desc) = 1"""


def oracle_sql() -> dict[str, str]:
    return {"op11_hard_negatives": HARD_NEGATIVES_SQL, "op12_filter_audit": FILTER_AUDIT_SQL, "op13_url_rules": URL_RULES_SQL}
