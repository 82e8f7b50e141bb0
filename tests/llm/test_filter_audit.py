"""The filter audit against a sequential replay."""

import re
from itertools import permutations

from tidewell.llm.filter_audit import filter_audit

COLUMNS = "doc_id long, text string, lang string, source string, good boolean, mask int, first long"


def words(n, seed=0, distinct=True):
    return " ".join(f"w{seed}x{i if distinct else i % 5}" for i in range(n))


def brute(docs, labels):
    said = {}
    for d, q, t in labels:
        a, b = said.get(d, (False, False))
        said[d] = (a or q == 1, b or t == 1)
    rows = []
    for d, t, lang in docs:
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails = {"A": len(w) < 100, "B": 100 * len(set(w)) < 80 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 10 * len(t), "D": bool(re.search("[#$%&*|]", t))}
        fails["E"] = d is not None and any(e is not None and e < d and (u or "") == t for e, u, _ in docs)
        rows.append((lang or "", fails, *(said.get(d, (False, False)) if d is not None else (False, False))))
    out = {}
    for part in {r[0] for r in rows}:
        own = [r for r in rows if r[0] == part]
        for o in map("".join, permutations("ABCDE")):
            for k in range(5):
                early = [any(r[1][c] for c in o[:k]) for r in own]
                here = [r[1][o[k]] and not e for r, e in zip(own, early, strict=True)]
                out[part, o, k + 1] = [
                    sum(not h and not e for h, e in zip(here, early, strict=True)), sum(here), sum(r[1][o[k]] and e for r, e in zip(own, early, strict=True)),
                    sum(r[1][o[k]] and sum(r[1].values()) == 1 for r in own), sum(h and r[2] for h, r in zip(here, own, strict=True)), sum(h and r[3] for h, r in zip(here, own, strict=True)),
                ]
    total = {}
    for (part, o, k), v in out.items():
        total[part, o[k - 1]] = total.get((part, o[k - 1]), 0) + v[1]
    return {(p, o, k): (*v, total[p, o[k - 1]]) for (p, o, k), v in out.items()}


DOCS = [
    (0, words(120), "en"), (1, words(120), "en"), (2, words(120), "de"), (3, words(120, 1) + " #", "en"), (4, None, "en"), (5, "", None), (6, "", "de"), (7, words(50), "fr"),
    (8, words(150, 2, False), "en"), (9, words(120, 3).upper(), "en"), (10, "x" * 40_000, ""), (None, words(120), "en"), (None, words(130, 9), "en"), (11, words(130, 9), "en"),
    (11, words(130, 9), "en"), (12, "É" * 9 + "A", "fr"), (13, "É" * 8 + "AB", "fr"), (14, "a\x1cb\u00a0c " * 100, "fr"),
]
LABELS = [(0, 1, 0), (1, 0, 1), (1, 1, None), (2, None, None), (8, 1, 1), (9, 1, 0), (99, 1, 1), (None, 1, 1), (4, 0, 1)]


def run(spark, docs, labels):
    docs = spark.createDataFrame([(*d, "s", True, 7, 1) for d in docs], COLUMNS).repartition(3)
    got = filter_audit(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()
    names = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    out = {(r["part"], r["filter_order"], r["step"]): tuple(r[c] for c in names) for r in got}
    assert len(out) == len(got)
    return out


def test_replay(spark):
    assert run(spark, DOCS, LABELS) == brute(DOCS, LABELS)
    assert len(run(spark, DOCS, [])) == 600 * 4


def test_empty(spark):
    assert run(spark, [], LABELS) == {}
