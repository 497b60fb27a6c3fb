import math

import numpy as np
import pytest

from foliant.llm import topk
from foliant.llm.negatives import mine_negatives
from foliant.llm.topk import top_k
from foliant.llm.vectors import HIGH, LOW, NONE, first_columns, products

SCHEMA = "vec_id long, embedding array<float>, label int"
DOUBLES = "vec_id long, embedding array<double>, label int"


def sound(rows):
    kept = [r for r in rows if r[1] is not None and all(c is not None and math.isfinite(c) for c in r[1])]
    sizes = [len(r[1]) for r in kept]
    dim = min(set(sizes), key=lambda d: (-sizes.count(d), d)) if sizes else 0
    return [(i, [math.floor(256 * c) for c in v], lab) for i, v, lab in kept if len(v) == dim]


def dot(a, b):
    return min(max(sum(x * y for x, y in zip(a, b, strict=True)), LOW), HIGH)


def order(score, ident):
    return (-score, ident is None, ident or 0)


def brute_top(rows, k=5, every=50):
    rows, out = sound(rows), []
    for a, (i, v, _) in enumerate(rows):
        if i is not None and i % every == 0:
            near = sorted(((dot(v, w), j) for b, (j, w, _) in enumerate(rows) if b != a), key=lambda x: order(*x))
            out += [(i, n + 1, j, s) for n, (s, j) in enumerate(near[:k])]
    return sorted(out, key=repr)


def brute_negatives(rows, positives=5, negatives=3, every=50):
    rows, out = [r for r in sound([r for r in rows if r[2] is not None])], []
    for a, (i, v, lab) in enumerate(rows):
        if i is None or i % every:
            continue
        scored = sorted(((dot(v, w), j, m) for b, (j, w, m) in enumerate(rows) if b != a), key=lambda x: order(*x[:2]))
        for p, j, _ in [x for x in scored if x[2] == lab][:positives]:
            hard = [x for x in scored if x[2] != lab and 50 * p <= 100 * x[0] <= 95 * p][:negatives]
            out += [(i, j, n + 1, g, p, s) for n, (s, g, _) in enumerate(hard)]
    return sorted(out, key=repr)


def got(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def many(n, dim=6, seed=1, labels=3):
    rng = np.random.default_rng(seed)
    x = rng.standard_normal((4, dim))[rng.integers(0, 4, n)] + 0.5 * rng.standard_normal((n, dim))
    x *= rng.choice([0.1, 1, 4], n)[:, None]
    x[n // 3 : 2 * n // 3] = x[n // 3]  # a vector that a third of the rows share
    return [(int(i), [float(np.float32(c)) for c in v], int(lab)) for i, v, lab in zip(range(n), x, rng.integers(0, labels, n), strict=True)]


ODD = [
    (None, [1.0] * 6, 1), (50, [1.0] * 6, 1), (50, [1.0] * 6, 2), (50, [0.5] * 6, 1), (100, None, 1), (150, [None] + [1.0] * 5, 1), (200, [float("nan")] + [1.0] * 5, 1),
    (250, [float("inf")] * 6, 1), (300, [0.0] * 6, 1), (350, [1.0] * 5, 1), (400, [], 1), (450, [1.0] * 6, None), (-50, [-1.0] * 6, 2), (0, [1.5] * 6, 0),
]


@pytest.mark.parametrize("rows", [many(2500), ODD, [], ODD[:2], [(0, [1.0], 1)], [(0, [], 1), (1, [], 1)], [(7, [1.0], 1)]], ids=["many", "odd", "empty", "two", "one", "no-components", "no-query"])
def test_both_against_brute_force(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 as id", "2 as rid", "3 as score", "4 as v", "5 as cluster", "6 as part")
    assert got(top_k(df)) == brute_top(rows)
    assert got(mine_negatives(df)) == brute_negatives(rows)


def test_several_query_blocks_and_repartition(spark, monkeypatch):
    rows = many(1500, seed=4)
    df = spark.createDataFrame(rows, SCHEMA)
    monkeypatch.setattr(topk, "BLOCK_QUERIES", 40)
    assert got(top_k(df.repartition(7), k=3, every=5)) == brute_top(rows, 3, 5)


def test_walk_over_several_rounds(spark, monkeypatch):
    """Lists of many blocks; anchors stop in different rounds."""
    from foliant.llm import negatives

    monkeypatch.setattr(negatives, "LIST_ROWS", 100)
    monkeypatch.setattr(negatives, "ANCHOR_ROWS", 8)
    rows = many(1600, seed=6)
    walked = []
    kept = negatives.settle
    monkeypatch.setattr(negatives, "settle", lambda df, label: (walked.append((label, out.count())) if "going" in label else None, out)[1] if (out := kept(df, label)) is not None else out)
    assert got(mine_negatives(spark.createDataFrame(rows, SCHEMA), every=20)) == brute_negatives(rows, every=20)
    going = [n for label, n in walked if label == "negatives-positives-going"]
    assert len(going) > 2 and going[-1] < going[0]  # some were certain before the end


def test_values_beyond_doubles(spark):
    rows = [(i, [v, 1.0], 1 + (i > 2)) for i, v in enumerate([1e300, 3e15, -1e300, 2.0**46 + 0.25, 1e300, -7.5])]
    df = spark.createDataFrame(rows, DOUBLES)
    assert got(top_k(df, every=2)) == brute_top(rows, every=2)
    assert got(mine_negatives(df, every=2)) == brute_negatives(rows, every=2)


def test_products_and_first_columns():
    rng = np.random.default_rng(0)
    a, b = rng.integers(-(1 << 40), 1 << 40, (3, 5)).astype(float), rng.integers(-(1 << 40), 1 << 40, (4, 5)).astype(float)
    assert products(a, b).tolist() == [[dot([int(c) for c in x], [int(c) for c in y]) for y in b] for x in a]
    s = np.array([[3, 5, 5, 1, 5], [NONE, 2, NONE, 2, 2]])
    assert [sorted(r) for r in first_columns(s, 2).tolist()] == [[1, 2], [1, 3]]
