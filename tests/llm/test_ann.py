import numpy as np
import pytest

from foliant.llm import ann
from foliant.llm.ann import _assign, _best, _eta, search, train

SCHEMA = "vec_id long, embedding array<float>, label int"


def exact(ids, x, k=20, every=20):
    out = {}
    for i in np.flatnonzero(ids % every == 0):
        s = (x * x[i]).sum(axis=1)
        rows = [j for j in np.lexsort((ids, -s)) if ids[j] != ids[i]][:k]
        out[int(ids[i])] = [(int(ids[j]), float(s[j])) for j in rows]
    return out


@pytest.mark.parametrize("lists", [None, 12])
def test_recall_scores_and_order(spark, monkeypatch, lists):
    if lists:
        monkeypatch.setattr(ann, "LIST_ROWS", 150)
        monkeypatch.setattr(ann, "GROUP_ROWS", 100)
        monkeypatch.setattr(ann, "GROUP_QUERIES", 20)
        monkeypatch.setattr(ann, "LEAST_PROBES", 8)
    rng = np.random.default_rng(2)
    x = (rng.standard_normal((10, 24))[rng.integers(0, 10, 2000)] + 0.7 * rng.standard_normal((2000, 24))).astype(np.float32)
    x[300:900] = x[300]  # a very common vector
    df = spark.createDataFrame([(i, v.tolist(), 0) for i, v in enumerate(x)], SCHEMA).selectExpr("*", "1 as id", "2 as list", "3 as rank")
    rows = search(df).collect()
    want = exact(np.arange(2000), x.astype(float))
    got = {}
    for r in sorted(rows, key=lambda r: (r.query_id, r.rank)):
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert abs(r.score - float(x[r.vec_id].astype(float) @ x[r.query_id].astype(float))) < 1e-9
    assert set(got) == set(want) and all(len(v) == 20 for v in got.values())
    assert all(v == sorted(v, key=lambda p: (-p[1], p[0])) for v in got.values())
    assert np.mean([len({a for a, _ in got[q]} & {a for a, _ in want[q]}) / 20 for q in want]) >= 0.9
    assert sorted(r.rank for r in rows) == sorted(list(range(1, 21)) * 100)


def test_rows_in_far_lists_are_found(spark, monkeypatch):
    monkeypatch.setattr(ann, "LIST_ROWS", 20)
    monkeypatch.setattr(ann, "LEAST_PROBES", 4)
    rng = np.random.default_rng(4)
    x = rng.standard_normal((2000, 24)).astype(np.float32)  # no clusters
    x[::50] *= 3  # rows of large norm in any list
    want = exact(np.arange(2000), x.astype(float), every=40)
    got = {}
    for r in search(spark.createDataFrame([(i, v.tolist(), 0) for i, v in enumerate(x)], SCHEMA), every=40).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.vec_id)
    assert {q: [i for i, _ in v] for q, v in want.items()} == got


def test_rows_that_take_no_part(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0], 0), (1, [1.0, 1.0], 0), (2, [2.0, 0.0], 0), (20, [0.0, 1.0], 0), (40, None, 0), (41, [0.0, 0.0], 0), (42, [nan, 1.0], 0), (43, [inf, 1.0], 0), (44, [None, 1.0], 0), (None, [1.0, 1.0], 0), (45, [1.0], 0)]
    got = sorted((r.query_id, r.rank, r.vec_id, r.score) for r in search(spark.createDataFrame(rows, SCHEMA)).collect())
    assert got == [(0, 1, 2, 2.0), (0, 2, 1, 1.0), (0, 3, 20, 0.0), (20, 1, 1, 1.0), (20, 2, 0, 0.0), (20, 3, 2, 0.0)]
    assert search(spark.createDataFrame([], SCHEMA)).collect() == []
    assert search(spark.createDataFrame([(20, [1.0], 0)], SCHEMA)).collect() == []


def test_anisotropic_loss_is_lower_than_plain_quantisation():
    x = np.random.default_rng(0).standard_normal((1500, 64))
    q, eta = train(x, 1), _eta(64)

    def loss(codes):
        r = x - np.concatenate([q.books[s][codes[:, s]] for s in range(32)], axis=1)
        along = (r * x).sum(1) ** 2 / (x * x).sum(1)
        return ((r * r).sum(1) + (eta - 1) * along).sum()

    plain = np.stack([((x.reshape(-1, 32, 2)[:, s, None] - q.books[s]) ** 2).sum(2).argmin(1) for s in range(32)], axis=1)
    assert loss(_assign(x, q.books, eta, 2)) < loss(plain)
    t = q.tables(x[:3])
    codes = q.encode(x)
    direct = x[:3] @ np.concatenate([q.books[s][codes[:, s]] for s in range(32)], axis=1).T
    pair = codes[:, 0::2].astype(int) * 16 + codes[:, 1::2]
    assert np.allclose(sum(t[:, s][:, pair[:, s]] for s in range(16)), direct, atol=1e-4)


def test_best_takes_earlier_columns_of_equals():
    s = np.array([[1, 3, 3, 2, 3.0], [0, 0, 0, 0, 0]])
    assert [sorted(r) for r in _best(s, 2).tolist()] == [[1, 2], [0, 1]]


def test_ties_repeated_ids_and_clashing_names(spark):
    rows = [(20 * i, [1.0, 0.0], 0) for i in range(3)] + [(i, [2.0, float(i % 2)], 0) for i in range(1, 9)] + [(0, [1.0, 0.0], 0), (3, [2.0, 1.0], 0), (7, [-1.0, 0.0], 0)]
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 as id", "2 as v", "3 as code", "4 as query_id")
    got = {}
    for r in search(df, k=6).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    # equal scores by the smaller id; a query of a repeated id is asked once and never finds its own id
    want = [(i, 2.0) for i in (1, 2, 3, 3, 4, 5)]
    assert got == {q: want for q in (0, 20, 40)}


def test_repeated_ids_with_different_vectors(spark):
    """The smallest vector of an id asks, in any order and partitioning of the rows."""
    rng = np.random.default_rng(9)
    rows = [(i % 60, rng.standard_normal(8).astype(np.float32).tolist(), 0) for i in range(240)]
    runs = [sorted(tuple(r) for r in search(spark.createDataFrame(order, SCHEMA).repartition(n)).collect()) for order, n in ((rows, 1), (rows[::-1], 5))]
    assert runs[0] == runs[1]
    for q in (0, 20, 40):
        v = np.array(min(r[1] for r in rows if r[0] == q))
        want = sorted((-float(np.float64(v) @ np.array(r[1], np.float64)), r[0]) for r in rows if r[0] != q)[:20]
        assert [(round(-s, 9), i) for s, i in want] == [(round(r[3], 9), r[2]) for r in runs[0] if r[0] == q]


@pytest.mark.parametrize("kind", ["near copies", "far centre", "huge", "tiny"])
def test_rows_that_codes_do_not_tell_apart(spark, kind):
    rng = np.random.default_rng(6)
    x = rng.standard_normal((1500, 16))
    if kind == "near copies":  # more than are reranked at first, all of one code
        x[200:1200] = x[200] + 1e-4 * rng.standard_normal((1000, 16))
    x = (x + {"far centre": 300.0}.get(kind, 0.0)) * {"huge": 1e25, "tiny": 1e-25}.get(kind, 1.0)
    x = x.astype(np.float32)
    got = {}
    for r in search(spark.createDataFrame([(i, v.tolist(), 0) for i, v in enumerate(x)], SCHEMA)).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.vec_id)
    assert got == {q: [i for i, _ in v] for q, v in exact(np.arange(1500), x.astype(float)).items()}
