"""Hard negatives against brute force: clusters over many cells, ties, equal vectors, odd rows, empty tables."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewell.llm.hard_negatives import Index, Tree, hard_negatives, scaled

COLUMNS = "vec_id long, label int, embedding array<float>, id string, cell int"


def brute(rows, anchor, positives=5, negatives=3):
    """Of (id, label, integer vector), by Python's integers."""
    out = []
    dot = lambda a, b: sum(int(x) * int(y) for x, y in zip(a, b, strict=False))
    for a, la, va in rows:
        if not anchor(a):
            continue
        scores = sorted(((dot(va, v), i, la == lb) for i, lb, v in rows if i != a), key=lambda r: (-r[0], r[1]))
        for ps, p, _ in [r for r in scores if r[2]][:positives]:
            hard = [r for r in scores if not r[2] and 50 * ps <= 100 * r[0] <= 95 * ps][:negatives]
            out += [(a, p, n + 1, i, ps, s) for n, (s, i, _) in enumerate(hard)]
    return sorted(out)


def table(spark, rows):
    return spark.createDataFrame([(i, lab, v, "x", 3) for i, lab, v in rows], COLUMNS)


def integers(rows):
    usable = [(i, lab, [math.floor(256.0 * float(np.float32(x))) for x in v]) for i, lab, v in rows]
    return usable


def run(df, condition="id % 50 = 0"):
    return sorted(tuple(r) for r in hard_negatives(scaled(df), condition).collect())


@pytest.mark.parametrize("centres", [1, 12])
def test_many_cells(spark, centres):
    rng = np.random.default_rng(centres)
    centre = rng.normal(size=(centres, 6)) * 3
    rows = [(int(i), int(rng.integers(4)), [float(x) for x in centre[i % centres] + rng.normal(size=6) * 0.4]) for i in range(9000)]
    # by arrays: the first rows of each score with ties by id
    ids, labels = np.arange(9000), np.array([r[1] for r in rows])
    x = np.floor(256 * np.array([r[2] for r in rows], np.float32).astype(np.float64)).astype(np.int64)
    want = []
    for a in range(0, 9000, 300):
        s = x @ x[a]
        order = np.lexsort((ids, -s))
        order = order[order != a]
        for p in order[labels[order] == labels[a]][:5]:
            hard = [i for i in order[labels[order] != labels[a]] if 50 * s[p] <= 100 * s[i] <= 95 * s[p]][:3]
            want += [(a, int(p), n + 1, int(i), int(s[p]), int(s[i])) for n, i in enumerate(hard)]
    assert run(table(spark, rows), "id % 300 = 0") == sorted(want) and want


def test_cells_are_passed_over(spark):
    """Anchors of separate clusters on a sphere meet few of the cells."""
    rng = np.random.default_rng(3)
    centre = rng.normal(size=(16, 8))
    centre *= 10 / np.sqrt((centre**2).sum(axis=1))[:, None]
    rows = [(int(i), int(i % 3), [float(x) for x in centre[i % 16] + rng.normal(size=8) * 0.1]) for i in range(20_000)]
    index = Index(scaled(table(spark, rows)).cache())
    anchors = index.routed.where("id % 500 = 0").select(F.col("id").alias("anchor"), "label", "v", "cell", F.array(F.lit(2**62)).alias("top"), F.array(F.lit(-(2**62))).alias("floor"))
    floor = F.array(F.aggregate("v", F.lit(0).cast("long"), lambda s, c: s + c * c) * 99 / 100)
    near = anchors.withColumn("floor0", F.col("floor")).withColumn("floor", F.transform(floor, lambda c: c.cast("long")))
    met = index._packs(near, True).agg(F.sum("n")).first()[0] + (index._packs(near, False).agg(F.sum("n")).first()[0] or 0)
    assert index.tree.depth >= 3 and met < 0.5 * 40 * 2**index.tree.depth


def test_ties_and_odd_rows(spark):
    same = [1.0, 0.5, -0.25]
    rows = [(i, i % 3, same) for i in range(0, 60)] + [(100 + i, i % 2, [0.7, 0.35, -0.1 * (i % 4)]) for i in range(30)]
    odd = [
        (None, 1, same), (1001, None, same), (1002, 1, None), (1003, 1, [1.0, None, 2.0]), (1004, 1, [1.0, float("nan"), 2.0]), (1005, 1, [float("inf"), 1.0, 2.0]),
        (1050, 1, []), (1100, 2, [0.9]), (1150, 2, [3e18, 0.0, 0.0]), (5, 0, [2.0, 2.0, 2.0]),
    ]
    # the second row of id 5 has the smaller label, and so it stands
    kept = [r for r in rows if r[0] != 5] + [(1050, 1, []), (1100, 2, [0.9]), (5, 0, [2.0, 2.0, 2.0])]
    assert run(table(spark, rows + odd + rows[:7])) == brute(integers(kept), lambda i: i % 50 == 0)


def test_large_numbers(spark):
    """Scores beyond the integers of a double are exact."""
    rng = np.random.default_rng(5)
    rows = [(i, i % 2, [float(x) for x in np.float32(rng.normal(size=4) * 3e5 + 4e5)]) for i in range(150)]
    want = brute(integers(rows), lambda i: i % 50 == 0)
    assert run(table(spark, rows)) == want and max(r[4] for r in want) > 2**53


def test_empty_and_lonely(spark):
    assert run(table(spark, [])) == []
    assert run(table(spark, [(1, 1, [1.0]), (2, 2, [1.0])])) == []
    assert run(table(spark, [(50, 1, [1.0]), (2, 2, [0.9])])) == []  # no positive
    assert run(table(spark, [(50, 1, [1.0]), (2, 1, [-1.0]), (3, 2, [-1.0])])) == []  # a negative score has no window
    assert run(table(spark, [(50, 1, [1.0, 0.0]), (2, 1, [0.0, 1.0]), (3, 2, [0.0, 5.0]), (4, 2, [1.0, 0.0])])) == [(50, 2, 1, 3, 0, 0)]


def test_tree_bounds():
    rng = np.random.default_rng(7)
    x = rng.integers(-300, 300, (1000, 5))
    x[:400] = x[0]
    most = int((x * x).sum(axis=1).max())
    tree, radius = Tree.grow(x[:500], most, 4)
    leaf, way = tree.route(x, radius)
    low, high = np.full((16, 4), np.inf), np.full((16, 4), -np.inf)
    np.minimum.at(low, leaf, way)
    np.maximum.at(high, leaf, way)
    q = x[::50]
    least, furthest = tree.bounds(q, low, high)
    d = np.sqrt((q * q).sum(axis=1)[:, None] + most - 2.0 * (q @ x.T))
    assert (least[:, leaf] <= d + tree.slack).all() and (furthest[:, leaf] >= d - tree.slack).all()
