"""The registered queries of the corpus operators over the smallest tables, against brute-force versions of their contracts."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest

import __spark_entry__
from tidewell.llm import entry

FOLDER = "/root/testdata/sf0.001"
SPACE_WORD = r"[^\x20\x09-\x0D]+"


@pytest.fixture(scope="module")
def documents():
    return duckdb.sql(f"select doc_id, text, source from '{FOLDER}/documents.parquet' order by doc_id").fetchall()


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def sha(x):
    return hashlib.sha256(x if isinstance(x, bytes) else x.encode()).hexdigest()


def rows_of(spark, name):
    return [r.asDict() for r in __spark_entry__.queries()[name](spark, FOLDER).collect()]


def test_op1(spark, documents):
    from tests.llm.test_operators import base_spans

    got = {r["doc_id"]: r for r in rows_of(spark, "op1_pii")}
    assert len(got) == len(documents)
    for d, t, _ in documents:
        base = base_spans(t)
        assert got[d]["base_sha256"] == sha(base)
        assert all(got[d][f"n_{k}"] == len(re.findall(f"{k}:", base)) for k in ("email", "ip", "card", "phone"))
        assert set(base.split(",")) <= set(got[d]["spans"].split(",")) | {""}


def test_op2_and_op7(spark, documents):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(entry.tokenizer_path("byte_bpe_50k.json"))
    got = {r["doc_id"]: (r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in rows_of(spark, "op2_token_counts")}
    for d, t, _ in documents:
        n = len(library.encode(t or "", add_special_tokens=False).ids)
        assert got[d] == (len((t or "").encode()), n, n > 1024)
    library = Tokenizer.from_file(entry.tokenizer_path("word_bpe_49k.json"))
    got = {r["doc_id"]: (r["start"], r["n_tokens"], r["ids_crc32"]) for r in rows_of(spark, "op7_token_output")}
    start = 0
    for d, t, _ in documents:
        ids = np.array([*library.encode(t or "", add_special_tokens=False).ids, 1], "<u4")
        assert got[d] == (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)


def test_op3(spark, documents):
    from tests.llm.test_operators import measured

    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    got = {r["doc_id"]: r for r in rows_of(spark, "op3_quality_rules")}
    for d, t, _ in documents:
        m = measured(t)
        failed = m[0] < 20 or 100 * m[4] > 30 * m[0]
        assert tuple(got[d][c] for c in names) == m and got[d]["base_failed"] == failed and not (failed and got[d]["kept"])
    assert sum(r["kept"] for r in got.values()) > 0.7 * len(got)


def test_op4(spark, documents):
    fold = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(t))
    windows, sizes = defaultdict(set), set()
    for i, t in duckdb.sql(f"select item_id, text from '{FOLDER}/benchmark.parquet'").fetchall():
        w = fold(t)
        k = min(10, len(w))
        for j in range(len(w) - k + 1 if k else 0):
            windows[tuple(w[j : j + k])].add(str(i))
            sizes.add(k)
    got = {r["doc_id"]: r for r in rows_of(spark, "op4_decontamination")}
    hits = 0
    for d, t, _ in documents:
        w, hit, items = fold(t), set(), set()
        for k in sizes:
            for j in range(len(w) - k + 1):
                if x := windows.get(tuple(w[j : j + k])):
                    hit |= set(range(j, j + k))
                    items |= x
        want = (len(w), len(hit), len(items), sha(",".join(sorted(items))), bool(hit))
        assert tuple(got[d][c] for c in ("n_words", "n_hit", "n_items", "items_sha256", "contaminated")) == want
        hits += bool(hit)
    assert hits


def components(sets):
    """The root of each unit whose sets of shingles are similar, by all units that share a shingle."""
    up = {u: u for u in sets}

    def find(x):
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    holders = defaultdict(list)
    for u, s in sets.items():
        for x in s:
            holders[x].append(u)
    common = Counter()
    for own in holders.values():
        for i, a in enumerate(own):
            for b in own[:i]:
                common[a, b] += 1
    for (a, b), n in common.items():
        if 100 * n >= 80 * (len(sets[a]) + len(sets[b]) - n):
            up[find(a)] = find(b)
    return {u: find(u) for u in sets}


def test_op5(spark, documents):
    lines = [(d, p, x) for d, t, _ in documents for p, x in enumerate((t or "").split("\n")) if x.strip("\x20\t\n\x0b\x0c\r")]
    root = components({x: frozenset(x[i : i + 8] for i in range(len(x) - 7)) or frozenset([x]) for _, _, x in lines})
    seen, want = set(), defaultdict(list)
    for d, p, x in lines:
        if root[x] in seen:
            want[d].append(p)
        seen.add(root[x])
    got = {r["doc_id"]: r for r in rows_of(spark, "op5_line_dedup")}
    assert {d: r["removed"] for d, r in got.items() if r["removed"]} == want and len(got) == len(documents)
    total = Counter(d for d, _, _ in lines)
    assert all(got[d]["n_lines"] == total[d] and got[d]["n_removed"] == len(want[d]) for d, _, _ in documents)


def paragraphs_of(text):
    """(start, words, by bands) of a text: its lines of 8 words and more, blocks of lines under 20 words, and its windows."""
    from tidewell.llm import passage_dedup

    w, at, found, block = re.findall(SPACE_WORD, lower(text)), 0, [], []
    for x in [*(text or "").split("\n"), ""]:
        n = len(re.findall(SPACE_WORD, x))
        if n >= 8:
            found.append((at, n, True))
        if 0 < n < 20:
            block.append((at, n))
        else:
            if len(block) > 1 and at - block[0][0] >= 8:
                found.append((block[0][0], at - block[0][0], True))
            block = []
        at += n
    found += [(int(i), 20, False) for i in passage_dedup.places(passage_dedup.split(text or "")[1])]
    return [(i, tuple(w[i : i + n]), keyed) for i, n, keyed in found]


def test_op6(spark, documents):
    """All paragraphs that are equal or, by brute force over all pairs, similar to earlier ones; and no other words."""
    units = [(d, i, -len(u), u, keyed) for d, t, _ in documents for i, u, keyed in paragraphs_of(t)]
    root = components({u: frozenset(u[i : i + 5] for i in range(len(u) - 4)) for *_, u, keyed in units if keyed})
    first, keeper = {}, {}
    for place in sorted(units, key=lambda x: x[:3]):
        u = place[3]
        if u not in first:
            first[u] = place
            if u in root:
                keeper.setdefault(root[u], place)
    want = defaultdict(set)
    for d, i, back, u, _ in units:
        goes = (d, i) != first[u][:2]
        if not goes and u in root:
            e, j, b = keeper[root[u]][:3]
            goes = not (d == e and i < j - b and i - back > j)
        if goes:
            want[d] |= set(range(i, i - back))
    got = {r["doc_id"]: set().union(*(range(s["start"], s["end"]) for s in r["removed"])) for r in rows_of(spark, "op6_passage_dedup")}
    assert len(got) == len(documents)
    missed, all_ = sum(len(want[d] - got[d]) for d in got), sum(map(len, want.values()))
    assert missed <= 0.01 * all_ and all_ > 1000
    assert not [d for d in got if got[d] - want[d]]


def test_op8(spark, documents):
    seen, want = set(), {}
    for d, t, _ in documents:
        x = (t or "").encode()
        gone = bytearray(len(x))
        for i in range(len(x) - 99):
            s = x[i : i + 100]
            if s in seen:
                gone[i : i + 100] = b"\1" * 100
            seen.add(s)
        kept = bytes(c for c, g in zip(x, gone, strict=True) if not g)
        want[d] = (len(x), sum(gone), len(re.findall(rb"\x01+", bytes(gone))), sha(kept))
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in rows_of(spark, "op8_suffix_dedup")}
    assert got == want


def test_op9(spark, documents):
    sets = {}
    for d, t, _ in documents:
        w = re.findall(SPACE_WORD, lower(t))
        sets[d] = frozenset(tuple(w[i : i + 4]) for i in range(max(1, len(w) - 3))) if w else frozenset()
    root = components(sets)
    least = {}
    for d, r in root.items():
        least[r] = min(d, least.get(r, d))
    want = {d: (len(s), least[root[d]], least[root[d]] == d) for d, s in sets.items()}
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in rows_of(spark, "op9_near_dedup")}
    assert got == want and any(not k for _, _, k in want.values())


def test_op10(spark, documents):
    got = {r["doc_id"]: r for r in rows_of(spark, "op10_mixing")}
    size = {d: len(re.findall(SPACE_WORD, t or "")) for d, t, _ in documents}
    source, taken, target = Counter(), Counter(), {}
    for d, _, s in documents:
        r = got[d]
        assert r["size"] == size[d] and 0 <= r["taken"] <= 2 * r["size"]
        source[s] += size[d]
        taken[s] += r["taken"]
        target[s] = r["target"]
    assert all(got[d]["source_size"] == source[s] for d, _, s in documents)
    assert sum(target.values()) == pytest.approx(1.5 * sum(size.values())) and all(target[s] <= 2 * source[s] for s in source)
    assert all(taken[s] == pytest.approx(target[s], rel=0.03) for s in source)


def test_pipeline_rows(spark, documents):
    """Every stage keeps what it should: the token table has the mix of what quality, near duplicates and the benchmark leave."""
    import corpus_pipeline

    now = spark.read.parquet(f"{FOLDER}/documents.parquet")
    ids = [r[0] for r in now.select("doc_id").collect()]
    kept = {r["doc_id"] for r in rows_of(spark, "op3_quality_rules") if r["kept"]}
    stage = dict(corpus_pipeline.STAGES)
    good = stage["quality rules"](spark, now, FOLDER)
    assert sorted(r[0] for r in good.select("doc_id").collect()) == sorted(d for d in ids if d in kept) and good.columns == now.columns
    texts = {d: t for d, t, _ in documents}
    sets = {}
    for d in sorted(kept):
        w = re.findall(SPACE_WORD, lower(texts[d]))
        sets[d] = frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4)))
    root = components(sets)
    first = {}
    for d in sorted(sets):
        first.setdefault(root[d], d)
    alone = stage["near dedup"](spark, good, FOLDER)
    assert sorted(r[0] for r in alone.select("doc_id").collect()) == sorted(first.values())
    clean = stage["decontamination"](spark, alone, FOLDER)
    dirty = {r["doc_id"] for r in rows_of(spark, "op4_decontamination") if r["contaminated"]}
    left = sorted(d for d in first.values() if d not in dirty)
    assert sorted(r[0] for r in clean.select("doc_id").collect()) == left
    mix = [r.asDict() for r in stage["mixing"](spark, clean, FOLDER).collect()]
    words = Counter()
    for r in mix:
        assert r["text"] in texts[r["doc_id"]] and r["n_chars"] == len(r["text"])
        words[r["doc_id"]] += len(re.findall(SPACE_WORD, r["text"]))
    size = {d: len(re.findall(SPACE_WORD, texts[d])) for d in left}
    assert set(words) <= set(left) and all(words[d] <= 2 * size[d] for d in words)
    assert sum(words.values()) == pytest.approx(1.5 * sum(size.values()), rel=0.03)
    assert Counter(r["doc_id"] for r in rows_of(spark, "pipeline")) == Counter(r["doc_id"] for r in mix)
