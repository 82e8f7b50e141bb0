"""Personal data: base patterns, and bootstrapped contextual extraction beyond them.

Seed entities (what the base patterns find) induce lexical patterns: the words around them. The graph of
patterns and instances is scored by turns: a pattern is as sure as the share of its instances that are
trusted, if it is specific to the kind; an instance as sure as its patterns together make it. Instances
above a score become seeds themselves, and their contexts new patterns. What sure patterns lead to and the
base patterns don't see is added. All of it is DataFrame functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut

#: Kinds in the order of the results.
KINDS = ("email", "ip", "card", "phone")

#: Base patterns. They match what the plain forms match, leftmost and without overlap, but in linear time
#: and without recursion: a run of the first class is tried at its start or where the last match ended,
#: and repetitions don't give back.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: A character that every match of the kind holds, where there is one.
NEEDS = {"email": "@", "ip": ".", "phone": "+"}

#: What may be an identifier that no base pattern sees: runs of at least six of these characters with an @, or with a
#: letter and a digit, among them; "at" and "dot" written out; and runs of digits with blanks, brackets and other signs
#: between them.
CANDIDATES = {
    "word": r"(?:\G|(?<![A-Za-z0-9_@.+-]))(?=[A-Za-z_.+-]*+[0-9@])(?=[0-9_.+-]*+[A-Za-z@])[A-Za-z0-9_@.+-]{5,}[A-Za-z0-9_@]",
    "spelt": (
        r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++(?:\x20?[\[(]\x20?at\x20?[\])]\x20?|\x20at\x20(?=[A-Za-z0-9-]++\x20dot\x20))"
        r"[A-Za-z0-9-]++(?:(?:\.|\x20?[\[(]\x20?dot\x20?[\])]\x20?|\x20dot\x20)[A-Za-z0-9-]++)++"
    ),
    "number": r"(?:\G|(?<![A-Za-z0-9]))\(?[0-9](?:[().\x20/-]{0,2}+[0-9]++)*+",
}
#: What a candidate must look like to be counted as an unseen identifier of a kind, and the digits it must have. A candidate
#: may be as long as its text: repeated groups don't give back, as Java takes such by recursion and runs out of stack.
SHAPES = {
    "email": (r"^[^@]+@[^@]+$|[\[(\x20]at[\])\x20]", 0, 1000),
    "ip": (r"^[0-9]++(?:\.[0-9]++){3,}+(?::[0-9]++)?$", 4, 24),
    "card": (r"^[0-9](?:[\x20-]?[0-9])++$", 13, 19),
    "phone": (r"^\(?[0-9][0-9().\x20/-]+[0-9]$", 7, 15),
}
_OCTET = r"0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
#: Characters of context looked at on each side of a mention. Words longer than that are cut alike for all mentions.
REACH = 64
#: Pieces of context: words, numbers, other signs.
PIECE = r"\p{L}+|\p{N}+|[^\s\p{L}\p{N}]"


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    n = F.length(digits)
    plain = F.split(digits, "")
    doubled = F.split(F.translate(digits, "0123456789", "0246813579"), "")
    at = F.sequence(F.lit(1), n)
    total = F.aggregate(
        at,
        F.lit(0),
        lambda s, i: s + F.when((n - i) % 2 == 1, F.get(doubled, i - 1)).otherwise(F.get(plain, i - 1)).cast("int"),
    )
    return total % 10 == 0


def _valid(kind: str, match: Column) -> Column:
    if kind == "ip":
        return match.rlike(rf"^{_OCTET}\.{_OCTET}\.{_OCTET}\.{_OCTET}$")
    if kind == "card":
        digits = F.regexp_replace(match, r"[\x20-]+", "")
        return F.when(F.length(digits).between(13, 19), luhn(digits)).otherwise(F.lit(False))
    if kind == "phone":
        return F.length(F.regexp_replace(match, r"[^0-9]+", "")).between(9, 15)
    return F.lit(True)


def _mentions(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(row, id, hits): what all patterns match in each text, each with the length of the text since the last match of
    its pattern and with its contexts. One pass over the texts; no text is kept."""
    kinds = {**PATTERNS, **CANDIDATES}
    rows = docs.select(F.col(f"`{id_col}`").alias("_id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("_text"))
    none = F.array().cast("array<string>")

    def matches(kind: str) -> Column:
        found = F.regexp_extract_all("_text", F.lit(kinds[kind]), F.lit(0))
        if kind == "spelt":
            return F.when(F.col("_text").rlike("[\\[(\\x20]at[\\])\\x20]"), found).otherwise(none)
        return F.when(F.contains("_text", F.lit(NEEDS[kind])), found).otherwise(none) if kind in NEEDS else found

    rows = rows.withColumns({f"m_{k}": matches(k) for k in kinds})
    rows = rows.withColumns({f"p_{k}": F.when(F.size(f"m_{k}") > 0, F.split("_text", kinds[k], -1)) for k in kinds})

    def hits(kind: str) -> Column:
        part = lambda i: F.coalesce(F.get(F.col(f"p_{kind}"), i), F.lit(""))
        match = lambda i: F.coalesce(F.get(F.col(f"m_{kind}"), i), F.lit(""))

        def hit(x: Column, i: Column) -> Column:
            # contexts go on beyond the neighbouring match, so that they are the same whatever patterns match there
            left = F.right(F.concat(part(i - 1), match(i - 1), part(i)), F.lit(REACH))
            right = F.left(F.concat(part(i + 1), match(i + 1), part(i + 2)), F.lit(REACH))
            return F.struct(
                F.lit(kind).alias("kind"), i.alias("i"), F.length(part(i)).cast("long").alias("gap"), x.alias("match"),
                F.when(F.length(x) <= REACH, F.lower(left)).alias("left"), F.when(F.length(x) <= REACH, F.lower(right)).alias("right"),
            )

        return F.transform(f"m_{kind}", hit)

    return rows.select(F.monotonically_increasing_id().alias("row"), "_id", F.concat(*[hits(k) for k in kinds]).alias("hits"))


def _spans(mentions: DataFrame) -> DataFrame:
    """(row, kind, start, end, match, left, right) of each valid match; code points, end exclusive."""
    hit = mentions.select("row", F.explode("hits").alias("h")).select("row", "h.*")
    w = Window.partitionBy("row", "kind").orderBy("i").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    hit = hit.withColumn("end", F.sum(F.col("gap") + F.length("match")).over(w))
    valid = F.lit(True)
    for k in ("ip", "card", "phone"):
        valid = F.when(F.col("kind") == k, _valid(k, F.col("match"))).otherwise(valid)
    return hit.where(valid).select("row", "kind", (F.col("end") - F.length("match")).alias("start"), "end", "match", "left", "right")


def _patterns(left: Column, right: Column) -> Column:
    """The lexical patterns around a mention: two and three pieces to the left, two to the right, and one on each side.
    Every pattern holds a word; there is none beyond the ends of the text."""
    before, after = F.regexp_extract_all(left, F.lit(PIECE), F.lit(0)), F.regexp_extract_all(right, F.lit(PIECE), F.lit(0))
    last = lambda k: F.when(F.size(before) >= k, F.concat(F.lit("l "), F.array_join(F.slice(before, -k, k), " ")))
    first = F.when(F.size(after) >= 2, F.concat(F.lit("r "), F.array_join(F.slice(after, 1, 2), " ")))
    both = F.when((F.size(before) >= 1) & (F.size(after) >= 1), F.concat(F.lit("b "), F.get(before, F.size(before) - 1), F.lit(" _ "), F.get(after, F.lit(0))))
    return F.array_distinct(F.filter(F.array(last(2), last(3), first, both), lambda p: p.isNotNull() & F.substring(p, 3, 1000).rlike(r"\p{L}{2}")))


#: An instance with at least this score counts as a seed of further patterns in the next turn.
PROMOTED = 0.6
#: How much more often a pattern must stand around the trusted of its kind than around all other mentions, and how many of
#: these are taken to have been seen without it beforehand.
LIFT, UNSEEN = 8.0, 20


def _score(edges: DataFrame, mentions: DataFrame, turns: int, least_seeds: int) -> DataFrame:
    """(kind, instance, score) of the instances that are no seeds.

    edges: distinct (kind, pattern, instance, seed); mentions: distinct (pattern, instance), whatever the kind. In each
    turn a pattern is as sure as the trusted share of the instances it stands around, if at least `least_seeds` of
    these are seeds or promoted and if it is specific to the kind; an instance as sure as its sure patterns together
    make it. Instances above PROMOTED are seeds of the next turn, so that what was found leads to new patterns.
    """
    around = mentions.groupBy("pattern").agg(F.count("*").alias("around"))
    every = mentions.agg(F.count_distinct("instance")).first()[0]
    trust = edges.select("kind", "pattern", "instance", "seed", F.col("seed").cast("double").alias("trust"))
    for turn in range(turns):
        strong = F.col("trust") >= PROMOTED
        own = trust.groupBy("kind", "pattern").agg(F.sum("trust").alias("a"), F.count("*").alias("own"), F.count_if(strong).alias("seeds"))
        total = trust.groupBy("kind", "instance").agg(F.max("trust").alias("t")).groupBy("kind").agg(F.sum("t"), F.count("*")).collect()  # a row for each kind
        of_kind = lambda i: F.coalesce(*[F.when(F.col("kind") == r[0], F.lit(float(r[i]))) for r in total], F.lit(1.0))
        stats = own.where(F.col("seeds") >= least_seeds).join(around, "pattern")
        others = (F.col("around") - F.col("own") + 0.5) / (F.greatest(every - of_kind(2), F.lit(0.0)) + UNSEEN)
        sure = stats.where(F.col("a") / F.greatest(of_kind(1), F.lit(1.0)) >= LIFT * others).select("kind", "pattern", (F.col("a") / (F.col("around") + 1)).alias("sure"))
        score = edges.where("not seed").join(sure, ["kind", "pattern"]).groupBy("kind", "instance").agg((1 - F.exp(F.sum(F.log(1 - F.col("sure"))))).alias("score"))
        score = cut(score, "score")
        again = edges.join(score, ["kind", "instance"], "left")
        trust = again.select("kind", "pattern", "instance", "seed", F.when(F.col("seed"), 1.0).otherwise(F.least(F.coalesce("score", F.lit(0.0)), F.lit(0.99))).alias("trust"))
    return score


def personal_data(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", turns: int = 3, least_seeds: int = 3, least_score: float = 0.6
) -> DataFrame:
    """(id, base, spans) for each row of docs: arrays of (kind, start, end), ordered by kind and start.

    `base` has what the base patterns find; `spans` adds the instances with a score of `least_score`
    that patterns of at least `least_seeds` different seeds lead to, where they touch no base span.
    A null text is empty and gives empty arrays. Repeated or null ids keep a row each; equal texts count as one
    witness of their instances. An empty table gives no rows; other columns don't pass. Very long texts are
    searched whole, in linear time. Of candidates that overlap each other, each is judged by itself.
    """
    mentions = cut(_mentions(docs, id_col, text_col), "mentions")
    every = cut(_spans(mentions.where(F.size("hits") > 0)), "spans")
    kinds = list(KINDS)
    is_base = F.col("kind").isin(kinds)
    base = every.where(is_base)

    # each order is the other reversed, ties too; a frame that ends with the window is summed up anew for each of its rows
    earlier = Window.partitionBy("row").orderBy("start", "end", is_base).rowsBetween(Window.unboundedPreceding, -1)
    later = Window.partitionBy("row").orderBy(F.desc("start"), F.desc("end"), is_base.desc()).rowsBetween(Window.unboundedPreceding, -1)
    before = F.max(F.when(is_base, F.col("end"))).over(earlier)
    after = F.min(F.when(is_base, F.col("start"))).over(later)
    free = every.withColumns({"before": before, "after": after}).where(~is_base)
    free = free.where((F.coalesce("before", F.lit(0)) <= F.col("start")) & (F.coalesce("after", F.col("end")) >= F.col("end")))
    digits = F.length(F.regexp_replace("match", "[^0-9]+", ""))
    shaped = [F.when(F.col("match").rlike(p) & digits.between(lo, hi), F.lit(k)) for k, (p, lo, hi) in SHAPES.items()]
    free = free.select("row", F.filter(F.array(*shaped), lambda k: k.isNotNull()).alias("kinds"), "start", "end", "match", "left", "right")

    both = base.select(F.array("kind").alias("kinds"), "match", "left", "right", F.lit(True).alias("seed")).unionByName(free.select("kinds", "match", "left", "right", F.lit(False).alias("seed")))
    seen = both.where("left is not null").select("kinds", F.explode(_patterns(F.col("left"), F.col("right"))).alias("pattern"), F.lower("match").alias("instance"), "seed")
    seen = cut(seen.groupBy("kinds", "pattern", "instance").agg(F.max("seed").alias("seed")), "seen")
    edges = seen.select(F.explode("kinds").alias("kind"), "pattern", "instance", "seed").groupBy("kind", "pattern", "instance").agg(F.max("seed").alias("seed"))
    edges, pairs = cut(edges, "edges"), cut(seen.select("pattern", "instance").distinct(), "pairs")
    sure = _score(edges, pairs, turns, least_seeds).where(F.col("score") >= least_score).select(F.col("kind").alias("_kind"), F.col("instance").alias("found"))
    added = free.select("row", F.explode("kinds").alias("kind"), "start", "end", "match")
    added = added.join(sure, (F.col("kind") == F.col("_kind")) & (F.lower("match") == F.col("found")), "left_semi")
    added = added.select("row", "kind", "start", "end").distinct()  # here: array_distinct compares all pairs of structs

    order = F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind")).alias("k")
    span = F.struct(order, "kind", "start", "end")
    spans = base.select("row", span.alias("s"), F.lit(True).alias("b")).union(added.select("row", span.alias("s"), F.lit(False).alias("b")))
    grouped = spans.groupBy("row").agg(
        F.array_sort(F.collect_list(F.when(F.col("b"), F.col("s")))).alias("base"), F.array_sort(F.collect_list("s")).alias("spans")
    )
    kind = "array<struct<k:bigint,kind:string,start:bigint,end:bigint>>"
    out = mentions.select("row", F.col("_id").alias(id_col)).join(grouped, "row", "left").drop("row")
    return out.select(f"`{id_col}`", *[F.transform(F.coalesce(c, F.array().cast(kind)), lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"))).alias(c) for c in ("base", "spans")])


def span_text(spans: str | Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    text = F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string")))
    return F.array_join(text, ",")
