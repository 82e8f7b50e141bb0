"""Corpus operators on small tables: nulls, empty and long texts, ties, repeated rows, empty tables, clashing columns,
and brute-force versions of what SQL can't express."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict
from functools import partial

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidewell.llm import common, entry, fuzzy, line_dedup, mixing, passage_dedup, prefix_join, quality, suffix_dedup, token_count, token_output
from tidewell.llm.common import add_offsets, connected_components, pack_set, unpack_set
from tidewell.llm.decontaminate import clean_documents, decontaminate
from tidewell.llm.hashing import shingle_sets, shingles
from tidewell.llm.near_dedup import keep_one, near_duplicates
from tidewell.llm.pii import personal_data, span_text

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = "the a of rain sun hill tree river stone cloud wind grass road light night morning salt iron".split()


def prose(seed: int, n: int) -> str:
    rng = np.random.default_rng(seed)
    return " ".join(f"{WORDS[rng.integers(len(WORDS))]}{rng.integers(40) if i % 3 else ''}" for i in range(n))


A, B = prose(1, 120), prose(2, 150)
NEAR = A.replace(A.split()[60], "other", 1)
TEXTS = [
    (0, A), (1, None), (2, ""), (3, A), (4, NEAR), (5, B), (6, "x"), (7, "two words"), (8, B + "\n" + A), (9, "z" * 30_000),
    (10, "1" * 25_000), (11, " \n\t \n"), (12, "ü€𝒳 " * 40), (13, "line\n\nline\nline of text"), (None, A), (14, "the the the " * 300), (15, B), (15, "q w e r t"),
]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en", f"s{(i or 0) % 3}" if i != 7 else None, len(t or "")) for i, t in TEXTS]
    return spark.createDataFrame(rows, COLUMNS).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], COLUMNS)


@pytest.fixture(scope="module")
def benchmark_table(spark):
    rows = [(1, " ".join(A.split()[20:45])), (2, "two words"), (3, None), (None, "x"), (4, ""), (10, " ".join(A.split()[30:70]).upper())]
    return spark.createDataFrame(rows, "item_id long, text string")


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


# --- 1


PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def valid(kind, match):
    digits = re.sub("[^0-9]", "", match)
    if kind == "ip":
        return all(int(x) <= 255 for x in match.split("."))
    if kind == "card":
        total = sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(digits)))
        return 13 <= len(digits) <= 19 and total % 10 == 0
    return kind == "email" or 9 <= len(digits) <= 15


def base_spans(text):
    return ",".join(f"{k}:{m.start()}:{m.end()}" for k in PLAIN for m in re.finditer(PLAIN[k], text or "") if valid(k, m[0]))


PII = [
    "a@b.c_d@e.f x@y@z.w", "𝒳 me@site.example.org, 1.2.3.4.5.6.7.8 and 0001.02.3.255", "4111 1111 1111 1111 1 2 +1 (743) 555-3824.", "+1((((((((((", "1.2.3.256",
    "5500-0000-0000-0004", "9" * 9000, "a." * 9000 + "@" + "b." * 9000 + "c", "+44 20 7946 0958", None, "", "1-1-1-1-1-1-1-1-1-1-1-1-1-1",
]


def test_base_spans_equal_the_plain_patterns(spark):
    df = spark.createDataFrame(list(enumerate(PII)), "doc_id long, text string")
    got = {r["doc_id"]: r["s"] for r in personal_data(df).select("doc_id", span_text("base").alias("s")).collect()}
    assert got == {i: base_spans(t) for i, t in enumerate(PII)}


def test_patterns_find_unseen_identifiers_and_nothing_in_clean_text(spark):
    seen = [(i, f"please write to user{i}@mail.example.com about it {prose(i, 30)}") for i in range(20)]
    df = spark.createDataFrame([*seen, (100, "please write to someone7@localhost about it"), (101, prose(9, 200)), (102, None)], "doc_id long, text string")
    got = {r["doc_id"]: r["s"] for r in personal_data(df).select("doc_id", span_text("spans").alias("s")).collect()}
    assert got[100] == "email:16:34" and got[101] == "" and got[102] == "" and len(got) == 23


def spans_of(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    return {r["doc_id"]: r["s"] for r in personal_data(df).select("doc_id", span_text("spans").alias("s")).collect()}


def test_what_was_found_leads_to_further_patterns(spark):
    seen = [f"please write to user{i}@mail.example.com about it {prose(i, 30)}" for i in range(20)]
    hop = [f"please write to w{i}@intra about it {prose(50 + i, 10)}" for i in range(5)] + [f"{prose(60 + i, 10)} the mailbox of w{i}@intra is full" for i in range(5)]
    texts = [*seen, *hop, f"{prose(70, 12)} the mailbox of zed9@core is full", f"{prose(71, 12)} nobody knows x7@y there"]
    got = spans_of(spark, texts)
    assert all(got[i].startswith("email:") for i in range(31)) and got[30] == f"email:{texts[30].index('zed9')}:{texts[30].index(' is full')}" and got[31] == ""


def test_numbers_with_blanks_and_patterns_to_the_right(spark):
    seen = [f"{prose(i, 20)} call +1 (555) 555-{1000 + i} after noon {prose(100 + i, 20)}" for i in range(12)]
    texts = [*seen, f"{prose(200, 9)} call 030 1234567 after noon", f"{prose(201, 9)} ring (555) 123-4567 after noon {prose(9, 9)}", f"{prose(202, 9)} in 2019 2020 2021 rain {prose(9, 9)}"]
    got = spans_of(spark, texts)
    assert got[12] == f"phone:{texts[12].index('030')}:{texts[12].index(' after')}" and got[13] == f"phone:{texts[13].index('(555)')}:{texts[13].index(' after')}" and got[14] == ""


def test_endless_runs_of_numbers_beside_sure_patterns(spark):
    seen = [f"{prose(i, 20)} call +1 (555) 555-{1000 + i} after noon {prose(100 + i, 20)}" for i in range(12)]
    runs = ["7 " * 50_000 + "7", "8" * 50_000, "9-" * 50_000 + "9", "1.2.3.4" + ".999" * 50_000]
    texts = [*seen, f"{prose(200, 9)} call 030 1234567 after noon", *[f"{prose(300 + i, 9)} call {r} after noon" for i, r in enumerate(runs)]]
    got, first = spans_of(spark, texts), texts[16].index("1.2.3.4")
    assert got[12] == f"phone:{texts[12].index('030')}:{texts[12].index(' after')}"
    assert [got[13 + i] for i in range(4)] == ["", "", "", f"ip:{first}:{first + 7}"]


def test_many_spans_of_one_text_and_equal_ends(spark):
    seen = [f"please write to user{i}@mail.example.com about it {prose(i, 30)}" for i in range(20)]
    many = "please write to w1@intra about it or a@b.co and 1.2.3.4 " * 3_000
    got = spans_of(spark, [*seen, *["please write to w1@intra about it"] * 3, many])[23].split(",")
    at = range(0, len(many), 56)
    assert got == [f"email:{s}:{e}" for i in at for s, e in ((i + 16, i + 24), (i + 37, i + 43))] + [f"ip:{i + 48}:{i + 55}" for i in at]


def test_personal_data_of_odd_tables(spark, none):
    rows = [(None, "mail me@site.example.org", 1), (1, "mail me@site.example.org", 1), (1, "mail me@site.example.org", 1), (2, None, 1)]
    got = personal_data(spark.createDataFrame(rows, "doc_id long, text string, row long"))
    assert got.columns == ["doc_id", "base", "spans"] and Counter((r[0], len(r[1])) for r in got.collect()) == {(None, 1): 1, (1, 1): 2, (2, 0): 1}
    assert personal_data(none).count() == 0


# --- 2, 7


TRICKY = ["", "a" * 3000, "<|endoftext|>x<|endoftext|>", "  \n\n x ", "日本語 ¡ñ ΑΣ. İ ﬁ", "don't WE'LL 12345", "a\x1cb é́ \xa0", "\x00"]


def test_token_counts_equal_the_library():
    from tokenizers import Tokenizer

    path = entry.tokenizer_path("byte_bpe_50k.json")
    texts = [*TRICKY, A, B]
    library = Tokenizer.from_file(path)
    assert token_count.counter(path)(texts) == [len(library.encode(t, add_special_tokens=False).ids) for t in texts]


def test_token_counts_of_all_rows(spark, docs, none):
    path = entry.tokenizer_path("byte_bpe_50k.json")
    out = token_count.token_counts(docs, path)
    assert out.count() == docs.count() and out.where("doc_id in (1, 2) and n_tokens = 0 and n_bytes = 0 and not over_limit").count() == 2
    assert token_count.token_counts(none, path).count() == 0


@settings(max_examples=50, deadline=None)
@given(st.lists(st.integers(0, 2**32 - 1), max_size=70))
def test_blocks_round_trip(values):
    v = np.array(values, np.uint32)
    control, data = token_output.encode_block(v)
    assert token_output.decode_block(control, data, len(v)).tolist() == values


def test_word_ids_equal_the_library():
    from tokenizers import Tokenizer

    path = entry.tokenizer_path("word_bpe_49k.json")
    library, encode = Tokenizer.from_file(path), token_output.word_encoder(path, 1)
    for t in [*TRICKY, A]:
        assert np.frombuffer(encode(t), "<u4").tolist() == [*library.encode(t, add_special_tokens=False).ids, 1]


def test_token_table_is_read_back_whole(spark, docs, none):
    from tokenizers import Tokenizer

    path = entry.tokenizer_path("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    got = sorted(token_output.token_output(docs, path, 1, 49_408).drop("ids").collect(), key=lambda r: r["start"])
    ids = lambda t: [*library.encode(t or "", add_special_tokens=False).ids, 1]
    rows = Counter((d, zlib.crc32(np.array(ids(t), "<u4").tobytes())) for d, t in TEXTS)
    assert Counter((r["doc_id"], r["ids_crc32"]) for r in got) == rows
    assert [r["start"] for r in got] == np.concatenate([[0], np.cumsum([r["n_tokens"] for r in got])[:-1]]).tolist()
    keys = [-1 if r["doc_id"] is None else r["doc_id"] for r in got]
    assert keys == sorted(keys)
    assert token_output.token_output(none, path, 1, 49_408).count() == 0


# --- 3


def measured(text):
    w, c = words_of(text), defaultdict(list)
    for j in range(len(w) - 7):
        c[tuple(w[j : j + 8])].append(j)
    cover = {k for v in c.values() if len(v) > 1 for j in v for k in range(j, j + 8)}
    lines = [x for x in (text or "").split("\n") if words_of(x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(cover)


def test_quality_measures(spark, docs, none):
    q = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    got = Counter(tuple(r) for r in quality.quality(docs).select("row.doc_id", *[f"q.{c}" for c in q], "base_failed").collect())
    want = Counter()
    for d, t in TEXTS:
        m = measured(t)
        want[(d, *m, m[0] < 20 or 100 * m[4] > 30 * m[0])] += 1
    assert got == want
    kept = quality.quality_filter(docs.withColumn("q", F.lit(1)).withColumn("words", F.lit(2)))
    assert {r["doc_id"] for r in kept.collect()} >= {0, 3, 4, 5, 8} and kept.columns[-2:] == ["q", "words"]
    assert quality.quality_filter(none).count() == 0


# --- 4


def test_decontamination(spark, docs, none, benchmark_table):
    fold = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(t))
    windows, sizes = defaultdict(set), set()
    for r in benchmark_table.where("item_id is not null").collect():
        w = fold(r["text"])
        k = min(10, len(w))
        for j in range(len(w) - k + 1 if k else 0):
            windows[tuple(w[j : j + k])].add(str(r["item_id"]))
            sizes.add(k)
    want = Counter()
    for d, t in TEXTS:
        w, hit, items = fold(t), set(), set()
        for k in sizes:
            for j in range(len(w) - k + 1):
                if x := windows.get(tuple(w[j : j + k])):
                    hit |= set(range(j, j + k))
                    items |= x
        want[d, len(w), len(hit), tuple(sorted(items, key=str))] += 1
    got = decontaminate(docs, benchmark_table, keep=["doc_id"]).select("row.doc_id", "n_words", "n_hit", "items").collect()
    assert Counter((r[0], r[1], r[2], tuple(r[3])) for r in got) == want
    left = clean_documents(docs.withColumn("hits", F.lit(0)), benchmark_table)
    assert left.columns[-1] == "hits" and left.count() == sum(n for (_, _, h, _), n in want.items() if h == 0)
    assert clean_documents(none, benchmark_table).count() == 0 and clean_documents(docs, benchmark_table.limit(0)).count() == len(TEXTS)


def test_decontamination_in_several_passes(docs, benchmark_table, monkeypatch):
    from tidewell.llm import decontaminate as module

    one = decontaminate(docs, benchmark_table, keep=["doc_id"]).select("row.doc_id", "n_hit", "items", "longest").collect()
    monkeypatch.setattr(module, "BENCHMARK_BYTES", 1)
    many = decontaminate(docs, benchmark_table, keep=["doc_id"]).select("row.doc_id", "n_hit", "items", "longest").collect()
    assert sorted(map(str, one)) == sorted(map(str, many)) and any(r["longest"] == 40 for r in many)


# --- 5, 6


def similar(units, shingles):
    """Component of each unit by all pairs."""
    ids = list(dict.fromkeys(units))
    up = {u: u for u in ids}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    sets = {u: shingles(u) for u in ids}
    for i, a in enumerate(ids):
        for b in ids[:i]:
            n = len(sets[a] & sets[b])
            if 100 * n >= 80 * (len(sets[a]) + len(sets[b]) - n):
                up[find(a)] = find(b)
    return {u: find(u) for u in ids}


def many_lines(n):
    lines = [prose(100 + i, 12) for i in range(n)]
    near = [x.replace("a", "b", 1) if i % 4 == 0 else x for i, x in enumerate(lines)]
    return ["\n".join(lines[i : i + 5]) for i in range(0, n, 5)] + ["\n".join(near[i : i + 7]) for i in range(0, n, 7)] + ["tiny\n\n \ntiny", None, ""]


def test_lines(spark, none):
    texts = many_lines(60)
    df = spark.createDataFrame([(i, t, i) for i, t in enumerate(texts)], "doc_id long, text string, gone long")
    lines = [(d, p, x) for d, t in enumerate(texts) for p, x in enumerate((t or "").split("\n")) if words_of(x)]
    root = similar([x for _, _, x in lines], lambda x: {x[i : i + 8] for i in range(len(x) - 7)} or {x})
    seen, want = set(), defaultdict(list)
    for d, p, x in lines:
        if root[x] in seen:
            want[d].append(p)
        seen.add(root[x])
    got = {r["doc_id"]: r["removed"] for r in line_dedup.line_report(df).collect()}
    assert {d: r for d, r in got.items() if r} == want
    cleaned = {r["doc_id"]: r["text"] for r in line_dedup.dedup_lines(df).collect()}
    for d, t in enumerate(texts):
        assert cleaned[d] == (t if t is None else "\n".join(x for p, x in enumerate(t.split("\n")) if p not in want[d]))
    assert line_dedup.line_report(none).count() == 0


def test_hot_lines_of_many_small_classes(spark):
    # 600 lines of one template, at about 0.66 of each other; two of each class are at 0.87
    rng = np.random.default_rng(11)
    letters = lambda n: "".join(chr(97 + c) for c in rng.integers(0, 26, n))
    head, tail = letters(70), letters(60)
    lines = [head + middle + tail[:30] + letters(3) + tail[30:] for middle in [letters(12) for _ in range(300)] for _ in range(2)]
    order = rng.permutation(len(lines))
    df = spark.createDataFrame([(int(i), lines[int(i)]) for i in order], "doc_id long, text string")
    got = {r["doc_id"]: r["n_removed"] for r in line_dedup.line_report(df).collect()}
    assert got == {i: i % 2 for i in range(len(lines))}


@pytest.mark.parametrize("small, block", [(12, 256), (2, 5)])
def test_exact_join_of_sets(spark, monkeypatch, small, block):
    for name, value in (("SMALL", small), ("BLOCK", block), ("PIVOTS", 1)):
        monkeypatch.setattr(prefix_join, name, value)
    rng = np.random.default_rng(4)
    bases = [rng.choice(np.arange(60), 40, False) for _ in range(3)] + [rng.integers(100, 1 << 38, 30) for _ in range(3)]
    rows = {}
    for i in range(240):
        base = bases[i % 6]
        rows[i] = frozenset(int(x) for x in base[rng.random(len(base)) > 0.06]) | frozenset(int(x) for x in rng.integers(1, 1 << 39, i % 5))
    packed = [(i, bytearray(pack_set(np.sort(np.array(list(s), np.uint64))))) for i, s in rows.items()]
    sets = spark.createDataFrame(packed, "id long, set binary").repartition(3)
    want = {(a, b) for a in rows for b in rows if a < b and 100 * len(rows[a] & rows[b]) >= 80 * len(rows[a] | rows[b])}
    known = spark.createDataFrame([(0, 0), (6, 0)] if (0, 6) in want else [], "id long, component long")
    content = sets.withColumnRenamed("set", "text")
    verify = lambda pairs: fuzzy.verify(pairs, content, 80, unpack_set)
    pairs = prefix_join.similar_pairs(sets, content, 80, known, verify, unpack_set)
    got = {(r["id"], r["component"]) for r in connected_components(verify(pairs).union(known.select("id", "component"))).collect()}
    links = spark.createDataFrame(sorted(want), "a long, b long")
    assert want and got == {(r["id"], r["component"]) for r in connected_components(links).collect()}


def test_units_that_agree_in_one_key_of_a_large_group(spark, monkeypatch):
    rng = np.random.default_rng(6)
    units, texts = [], []
    for i in range(60):
        if i % 2 == 0:
            base = rng.integers(0, 1 << 60, 20, np.uint64)
        own = np.sort(np.append(base[1:], rng.integers(0, 1 << 60, 1, np.uint64)))  # 19 of 21 with the other of the class
        units.append((i, 20, [7, 100 + i, 1000 + i]))
        texts.append((i, bytearray(pack_set(own))))
    content = spark.createDataFrame(texts, fuzzy.CONTENT)
    for block in (256, 5):
        monkeypatch.setattr(prefix_join, "BLOCK", block)
        got = fuzzy.cluster(spark.createDataFrame(units, "id long, n int, keys array<long>").repartition(3), lambda ids: content.join(ids, "id", "left_semi"), 80, unpack_set)
        assert {(r["id"], r["component"]) for r in got.collect()} == {(i, i - i % 2) for i in range(60)}


def test_huge_groups_are_joined_by_rare_shingles(spark, monkeypatch):
    monkeypatch.setattr(fuzzy, "LARGE", 20)
    test_units_that_agree_in_one_key_of_a_large_group(spark, monkeypatch)


@pytest.mark.parametrize("parts", [1, 5])
def test_candidates_of_small_and_large_groups(spark, parts):
    rng = np.random.default_rng(8)
    keys = {i: sorted({int(k) for k in rng.integers(0, 40, 2)} | {1000 + i // 3} | ({99} if i % 2 else set())) for i in range(300)}
    rows = spark.createDataFrame([(i, 1, k) for i, k in keys.items()], "id long, n int, keys array<long>").repartition(parts)
    groups = defaultdict(list)
    for i, k in keys.items():
        for x in k:
            groups[x].append(i)
    want = Counter()
    for k, own in groups.items():
        if len(own) > fuzzy.SMALL:
            want.update((k, i, None) for i in own)
        else:
            want.update((k, a, b) for a in own for b in own if a < b)
    assert Counter(tuple(r) for r in fuzzy.candidates(rows, 80).collect()) == want


def test_passages(spark, docs, none):
    passage = prose(77, 60)
    texts = [prose(200 + i, 80) + " " + (passage + " " if i % 3 == 0 else "") + prose(300 + i, 40) for i in range(30)] + [None, "", "short one"]
    df = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, gone long").repartition(3)
    got = {r["doc_id"]: r for r in passage_dedup.passage_report(df).collect()}
    assert len(got) == len(texts) and all((got[d]["removed_words"] >= 25) == (d % 3 == 0 and d > 0) for d in range(30))
    for d in range(3, 30, 3):  # what goes is the passage's
        assert all(80 <= x["start"] and x["end"] <= 140 for x in got[d]["removed"])
    assert all(got[d]["removed_words"] == 0 for d in range(30) if d % 3) and got[32]["n_paragraphs"] == 0
    assert passage_dedup.passage_report(docs).count() == len(TEXTS) and passage_dedup.passage_report(none).count() == 0


def test_edited_paragraphs(spark):
    rng = np.random.default_rng(12)
    lines, want = [], []
    for k in range(40):
        base = prose(400 + k, int(rng.integers(60, 100))).split()
        edited = base.copy()
        edited[len(base) // 2] = "99"
        lines += [" ".join(base), " ".join(edited)]
        want += [0, len(base)]
    df = spark.createDataFrame([(i, f"intro{i}\n{x}") for i, x in enumerate(lines)], "doc_id long, text string")
    got = {r["doc_id"]: r["removed_words"] for r in passage_dedup.passage_report(df).collect()}
    assert sum(got[i] == n for i, n in enumerate(want)) >= 78  # all but chance misses


def test_a_hot_passage_goes_everywhere_but_once(spark):
    passage = prose(5, 70)
    df = spark.createDataFrame([(i, prose(5000 + i, 30) + "\n" + passage) for i in range(200)], "doc_id long, text string").repartition(5)
    got = {r["doc_id"]: r["removed_words"] for r in passage_dedup.passage_report(df).collect()}
    assert got.pop(0) == 0 and all(70 <= n <= 73 for n in got.values())  # a word before it may be the same by chance


# --- 8


@settings(max_examples=200, deadline=None)
@given(st.one_of(st.binary(max_size=60), st.text("ab", max_size=80).map(str.encode)))
def test_suffix_array(text):
    assert suffix_dedup.suffix_array(text) == sorted(range(len(text)), key=lambda i: text[i:])


def test_repeated_bytes_go(spark, docs, none):
    long = "".join(chr(97 + i * i % 23) for i in range(260))
    texts = [(d, t) for d, t in TEXTS if d is not None and d != 15] + [(20, long), (21, "ab" + long[40:200] + "ü" + long[:99]), (22, long + long)]
    df = spark.createDataFrame(texts, "doc_id long, text string").repartition(3)
    seen, want = set(), {}
    for d, t in sorted(texts):
        x = (t or "").encode()
        gone = bytearray(len(x))
        for i in range(len(x) - 99):
            if x[i : i + 100] in seen:
                gone[i : i + 100] = b"\1" * 100
            seen.add(x[i : i + 100])
        want[d] = hashlib.sha256(bytes(c for c, g in zip(x, gone, strict=True) if not g)).hexdigest()
    got = {r["doc_id"]: hashlib.sha256(bytes(r["kept"])).hexdigest() for r in suffix_dedup.remove_repeats(df).collect()}
    assert got == want
    twice = suffix_dedup.remove_repeats(df.union(df).withColumn("gone", F.lit(1))).groupBy("doc_id").agg(F.collect_list("kept").alias("k")).collect()
    first = {d: t for d, t in texts}
    for r in twice:  # of equal rows the first stays as it was, the others go if they have a whole string
        n = len((first[r["doc_id"]] or "").encode())
        assert sorted(hashlib.sha256(bytes(k)).hexdigest() for k in r["k"]) == sorted([want[r["doc_id"]], hashlib.sha256(b"").hexdigest() if n >= 100 else want[r["doc_id"]]])
    assert suffix_dedup.remove_repeats(docs).count() == len(TEXTS) and suffix_dedup.remove_repeats(none).count() == 0


@pytest.mark.parametrize("shard", [1 << 16, 300])
def test_a_frequent_line_with_many_neighbours(spark, monkeypatch, shard):
    monkeypatch.setattr(suffix_dedup, "SHARD", shard)
    rng = np.random.default_rng(2)
    letters = lambda n: "".join(chr(97 + c) for c in rng.integers(0, 26, n))
    line, near = letters(90), [letters(20) for _ in range(4)]
    texts = [(i, letters(60) + near[i % 4][: i % 21] + line + near[i % 3][: i % 17] + letters(60)) for i in range(150)]
    seen, want = set(), {}
    for d, t in texts:
        x, gone = t.encode(), bytearray(len(t))
        for i in range(len(x) - 99):
            if x[i : i + 100] in seen:
                gone[i : i + 100] = b"\1" * 100
            seen.add(x[i : i + 100])
        want[d] = bytes(c for c, g in zip(x, gone, strict=True) if not g)
    got = {r["doc_id"]: bytes(r["kept"]) for r in suffix_dedup.remove_repeats(spark.createDataFrame(texts, "doc_id long, text string").repartition(3)).collect()}
    assert got == want and sum(len(w) < len(t) for (_, t), w in zip(texts, want.values(), strict=True)) > 20


# --- 9


def test_near_duplicates(spark, docs, none):
    sets = {}
    for i, (d, t) in enumerate(TEXTS):
        w = words_of(lower(t))
        sets[i] = (d, frozenset(tuple(w[j : j + 4]) for j in range(max(1, len(w) - 3))) if w else frozenset())
    up = {d: d for d, _ in sets.values() if d is not None}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for d, s in sets.values():
        for e, u in sets.values():
            if None not in (d, e) and s and u and 100 * len(s & u) >= 80 * len(s | u):
                a, b = sorted((find(d), find(e)))
                up[b] = a
    want = Counter((d, len(s), None if d is None else find(d), d is None or find(d) == d) for d, s in sets.values())
    got = near_duplicates(docs, size=4)
    assert Counter(tuple(r) for r in got.select("doc_id", "n_shingles", "component_id", "kept").collect()) == want
    assert {r["doc_id"] for r in keep_one(docs).collect()} == {r["doc_id"] for r in near_duplicates(docs).where("kept").collect()}
    assert near_duplicates(none).count() == 0


def test_large_group_of_near_copies(spark):
    base = prose(5, 200).split()
    rows = [(i, " ".join(base[: i % 190] + [f"new{i}"] + base[i % 190 + 1 :])) for i in range(300)] + [(1000 + i, prose(1000 + i, 60)) for i in range(50)]
    got = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), size=4).collect()
    assert {r["component_id"] for r in got if r["doc_id"] < 300} == {0} and all(r["kept"] for r in got if r["doc_id"] >= 1000)


def test_components(spark):
    rng = np.random.default_rng(3)
    links = [(int(a), int(b)) for a, b in rng.integers(0, 400, (300, 2))] + [(500, 500 + i) for i in range(1, 60)] + [(700 + i, 701 + i) for i in range(40)] + [(9, 9)]
    up = {x: x for link in links for x in link}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in links:
        a, b = sorted((find(a), find(b)))
        up[b] = a
    got = {r["id"]: r["component"] for r in connected_components(spark.createDataFrame(links, "a long, b long")).collect()}
    linked = {x for a, b in links if a != b for x in (a, b)}
    assert got == {x: find(x) for x in linked}


# --- 10


def test_mixing(spark, docs, none):
    rows = [(i, prose(i, 50 + 13 * (i % 20)), "en", None if i % 7 == 0 else f"s{i % 5}", 0) for i in range(400)] + [(900, None, "en", "empty", 0)]
    df = spark.createDataFrame(rows, COLUMNS).repartition(4)
    got = mixing.mixed_sizes(df).collect()
    assert sorted(map(str, got)) == sorted(map(str, mixing.mixed_sizes(df).collect()))
    source = {r[0]: r[3] for r in rows}
    size, taken, target = Counter(), Counter(), {}
    for r in got:
        assert 0 <= r["taken"] <= 2 * r["size"]
        size[source[r["doc_id"]]] += r["size"]
        taken[source[r["doc_id"]]] += r["taken"]
        target[source[r["doc_id"]]] = r["target"]
    order = sorted((s for s in size if s is not None)) + [None]
    weight, cap, want, full = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}, {s: 2.0 * size[s] for s in order}, {}, set()
    while True:
        rest = 1.5 * sum(size.values()) - sum(cap[s] for s in full)
        want = {s: cap[s] if s in full else rest * weight[s] / sum(weight[u] for u in order if u not in full) for s in order}
        over = {s for s in order if s not in full and want[s] > cap[s]}
        if not over:
            break
        full |= over
    for s in order:
        assert target[s] == pytest.approx(want[s]) and taken[s] == pytest.approx(want[s], rel=0.03)
    assert mixing.mixed_sizes(docs).count() == len(TEXTS) and mixing.mixed_sizes(none).count() == 0
    texts = mixing.mixed_documents(df.withColumn("row", F.lit(1)))
    assert texts.columns[-1] == "row"
    words = Counter()
    for r in texts.collect():
        words[r["doc_id"]] += len(words_of(r["text"]))
    assert sum(words.values()) == pytest.approx(1.5 * sum(size.values()), rel=0.03)
    assert all(words[d] <= 2 * len(words_of(t)) for d, t, *_ in rows)


def test_mixed_texts_go_to_python_once(spark, monkeypatch):
    # long texts of which many blocks are left out, so that each has many stretches
    rows = [(i, prose(i, 3000), "en", "rst"[i % 3], i) for i in range(24)]
    df = spark.createDataFrame(rows, COLUMNS).repartition(2)
    monkeypatch.setattr(mixing, "CHARS", 1 << 10)
    mixed = mixing.mixed_documents(df)
    got = mixed.collect()
    text = {r[0]: r[1] for r in rows}
    assert len(got) > 3 * len(rows) and all(r["text"] in text[r["doc_id"]] and r["n_chars"] == len(r["text"]) for r in got)
    taken = Counter()
    for r in got:
        taken[r["doc_id"]] += len(words_of(r["text"]))
    assert taken == {r["doc_id"]: r["taken"] for r in mixing.mixed_sizes(df).collect() if r["taken"]}
    plan = mixed._jdf.queryExecution().executedPlan().executedPlan()
    while plan.nodeName() != "MapInArrow":
        plan = plan.children().head() if plan.children().nonEmpty() else plan.plan()
    assert plan.metrics().apply("pythonDataSent").value() < 1.5 * sum(len(x.encode()) for x in text.values())


def test_mixing_of_small_sources(spark):
    # among a large source, which leaves the others of weight 1 and 2 their bound of two passes or less
    sizes = [*range(1, 16), 33, 40, 64, 65, 70, 100, 127, 128, 129, 200]
    rows = [(k, " ".join(f"w{i}" for i in range(n)), f"s{k:02}") for k, n in enumerate(sizes)] + [(99, "w " * 300, "t")]
    got = {r["doc_id"]: r for r in mixing.mixed_sizes(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    for k, n in enumerate(sizes):
        assert abs(got[k]["taken"] - got[k]["target"]) <= max(1, 0.06 * got[k]["target"]), (n, got[k])
    # targets far below the size
    size = np.repeat([1, 2, 15, 40, 70, 200, 100_000], 6)
    target = np.minimum(np.tile([1.0, 3, 10, 31, 140, 2000], 7), 2.0 * size)
    df = spark.createDataFrame(list(zip(size.tolist(), target.tolist(), strict=True)), "source_size long, target double")
    for name, column in mixing.cuts().items():
        df = df.withColumn(name, column)
    for r in df.collect():
        assert abs(r["slots"] * r["source_size"] / r["blocks"] - r["target"]) <= max(0.5, r["target"] / 32) and r["length"] <= mixing.BLOCK


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 3000), st.integers(0, 2**40))
def test_permutations(n, key):
    got = mixing.permute(np.arange(n), np.full(n, n), np.full(n, key))
    assert sorted(got.tolist()) == list(range(n))


@pytest.mark.parametrize("shard, ranges", [(4096, 4096), (16, 8)])
def test_draws_meet_their_totals(spark, monkeypatch, shard, ranges):
    monkeypatch.setattr(mixing, "SHARD", shard)
    monkeypatch.setattr(mixing, "RANGE", ranges)
    mix = mixing.Mix.__new__(mixing.Mix)
    mix.spark, mix.seed = spark, 3
    mix.sources = spark.createDataFrame([(0, 3000, 5000), (1, 7, 7), (2, 0, 0), (3, 900, 1234)], "source_no long, blocks long, slots long")
    got = mix.slots().collect()
    assert Counter(r["source_no"] for r in got) == {0: 5000, 1: 7, 3: 1234}
    passes = Counter((r["source_no"], r["turn"], r["block"]) for r in got)
    assert set(passes.values()) == {1} and Counter((s, t) for s, t, _ in passes) == {(0, 0): 3000, (0, 1): 2000, (1, 0): 7, (3, 0): 900, (3, 1): 334}
    assert len({r["shard"] for r in got}) > (300 if shard == 16 else 0)


def test_offsets(spark):
    rows = [(g, i, (7 * i) % 5) for g in ("a", "b", None) for i in range(50)]
    df = spark.createDataFrame(rows, "g string, i long, n long").repartition(4)
    for r in add_offsets(df, ["i"], "n", ["g"]).collect():
        assert r["start"] == sum((7 * k) % 5 for k in range(r["i"]))


# --- the pipeline


def test_pipeline(spark, docs, tmp_path, benchmark_table):
    import corpus_pipeline

    docs.write.parquet(f"{tmp_path}/documents.parquet")
    benchmark_table.write.parquet(f"{tmp_path}/benchmark.parquet")
    now = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        stage(spark, now, str(tmp_path)).write.parquet(f"{tmp_path}/{i}")
        now = spark.read.parquet(f"{tmp_path}/{i}")
        assert now.columns == docs.columns
    assert corpus_pipeline.run(spark, str(tmp_path)).columns == ["doc_id", "start", "n_tokens", "ids_crc32"]


def test_wrapped_paragraphs(spark):
    """Paragraphs of short lines that are wrapped at different columns, one of them edited, are found as blocks; the lines of a
    block that is the first of its kind stay."""
    def wrap(words, n):
        return "\n".join(" ".join(words[i : i + n]) for i in range(0, len(words), n))

    body = prose(900, 120).split()
    edited = [*body[:60], "99", *body[61:]]
    texts = ["one two\n\n" + wrap(body, 7) + "\n \nlast words", wrap(edited, 9), wrap(prose(901, 90).split(), 8), "x y\n" + "\n".join([prose(902, 40)] * 3)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: [(x["start"], x["end"]) for x in r["removed"]] for r in passage_dedup.passage_report(df).collect()}
    assert got == {0: [], 1: [(0, 120)], 2: [], 3: [(42, 122)]}


def test_growing_tables_stay_off_the_driver(spark, monkeypatch):
    """Tables of cut() whose files are small, though their rows need not be, are met by shuffles: none is broadcast."""
    plans, plan = [], lambda df: df._jdf.queryExecution().executedPlan().toString()
    written = common.cut
    monkeypatch.setattr(common, "cut", lambda df, name="cut": (plans.append(plan(df)), written(df, name))[1])
    pairs = written(spark.range(200).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b")))
    content = written(spark.range(201).select("id", F.encode(F.lit("one line of text"), "utf-8").alias("text")))
    members = connected_components(fuzzy.verify(pairs, content, 80, line_dedup.line_set))
    assert {tuple(r) for r in members.collect()} == {(i, 0) for i in range(201)}
    wanted = fuzzy.wanted(content.select(F.col("text").cast("string")), content.select("id"), line_dedup._content)
    marked = written(spark.createDataFrame([(0, 0, 0, 5, 0, 7, [1], True), (0, 0, -1, 1, 0, None, None, None)], fuzzy.MARKED))
    gone = fuzzy.removals(marked, written(spark.createDataFrame([(7, 7)], "id long, component long")))
    found = fuzzy.by_row(marked, gone)
    assert len(plans) > 2 and not [p for p in [*plans, plan(wanted)] if "Broadcast" in p]
    assert "SortMergeJoin [unit" in plan(gone) and "SortMergeJoin [row" in plan(found)


class Straight:
    """Stands for a table whose batches go through what mapInArrow() is given."""

    def __init__(self, *batches):
        self.batches = batches

    def mapInArrow(self, run, schema):
        return list(run(iter(self.batches)))


def test_passages_of_many_texts_are_hashed_together(monkeypatch):
    """Short texts share the calls that hash them, and get the units that each gets by itself."""
    wrapped = "\n".join(" ".join(prose(950, 90).split()[i : i + 9]) for i in range(0, 90, 9))
    texts = ["", " \n ", A, "\n\n" + A + "\n \n", "tail of eight words that has no end", wrapped, wrapped + "\n\n" + prose(951, 20), "x", "", B + "\n" + A.upper(), "ü€𝒳 " * 40, "the the " * 30, "\n"] * 20
    row = pa.array(range(len(texts)))
    batch = pa.RecordBatch.from_arrays([row, pa.array([None, *range(1, len(texts))], pa.int64()), pa.array(texts)], ["row", "doc_id", "text"])
    calls, split = [], passage_dedup.split
    monkeypatch.setattr(passage_dedup, "split", lambda *t: (calls.append(len(t)), split(*t))[1])
    everything = lambda numbers: np.ones(len(numbers), bool)
    found = lambda: (pa.Table.from_batches(passage_dedup._units(Straight(batch))), list(passage_dedup._content([batch.select(["text"])], everything)))
    together, content = found()
    assert len(calls) < len(texts) / 10 and sum(calls) == 2 * len(texts)
    monkeypatch.setattr(passage_dedup, "CHUNK", 0)
    alone, content_alone = found()
    by_place = [(c, "ascending") for c in ("row", "pos", "size")]
    assert together.sort_by(by_place).equals(alone.sort_by(by_place)) and content[0].num_rows > 5
    of = lambda batch: dict(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True))
    assert of(content[0]) == of(content_alone[0])


def test_pairs_are_confirmed_many_at_once(spark, monkeypatch):
    """Sets of short texts are made together, those of long ones one at a time, with what pairs one by one give."""
    lines = [prose(960 + i, 5 + i % 40) for i in range(60)]
    texts = [x.encode() for line in lines for x in (line, line.replace("a", "b", 1), line.upper())] + [b"", b" ", b"two words", b"a b c " * 300]
    pairs = [(i, j) for i in range(len(texts)) for j in (i + 1, i + 2, i * 7 % len(texts)) if i < j < len(texts)]
    batch = pa.RecordBatch.from_arrays([*(pa.array([p[k] for p in pairs]) for k in (0, 1)), *(pa.array([texts[p[k]] for p in pairs], pa.binary()) for k in (0, 1))], ["a", "b", "x", "y"])

    class Joined(Straight):
        select = lambda self, *_: self

    monkeypatch.setattr(fuzzy, "meet", lambda left, *_: left)
    for chunk, one, many in ((1 << 17, partial(shingles, size=5), partial(shingle_sets, size=5)), (200, partial(shingles, size=5), partial(shingle_sets, size=5)), (1 << 17, line_dedup.line_set, line_dedup.line_sets)):
        monkeypatch.setattr(fuzzy, "CHUNK", chunk)
        calls, long = [], []
        got = fuzzy.verify(Joined(batch), spark.createDataFrame([], fuzzy.CONTENT), 80, lambda t: (long.append(t), one(t))[1], lambda t: (calls.append(t), many(t))[1])
        want = []
        for a, b in pairs:
            x, y = (set(one(texts[k]).tolist()) for k in (a, b))
            if 100 * len(x & y) >= 80 * len(x | y):
                want.append((a, b))
        assert [tuple(r.values()) for g in got for r in g.to_pylist()] == want and 0 < len(want) < len(pairs)
        assert set(long) == {t for t in texts if len(t) > chunk} and (chunk == 200 or len(calls) == 1)
