import numpy as np

from foliant.operators import ranking as R


def _rows(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>")


def test_late_interaction_in_blocks(spark, monkeypatch):
    """Also a null vector, one of another length and a group with nothing else; a zero vector gives NaN and ends nothing."""
    from foliant.operators import cosines

    rng = np.random.default_rng(1)
    x = rng.standard_normal((300, 5))
    rows = [(i, i % 4, v.tolist()) for i, v in enumerate(x)] + [(301, 0, None), (302, 9, None), (303, 1, [1.0, 2.0]), (304, 8, [0.0] * 5)]
    e = _rows(spark, rows)
    queries = e.where("vec_id % 20 = 0").selectExpr("vec_id as query_id", "embedding as query_vec")
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    want = {g: round(float((unit[g::4] @ unit[::20].T).max(axis=0).mean()), 9) for g in range(4)}
    for block, cells in ((1000, 1 << 21), (4, 64)):
        monkeypatch.setattr(R, "QUERY_BLOCK", block)
        monkeypatch.setattr(cosines, "CELLS", cells)
        df = R.late_interaction(e, queries, "label")
        got = {r.label: r.score for r in df.collect()}
        assert {g: round(got[g], 9) for g in range(4)} == want
        assert got[9] is None and np.isnan(got[8])
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_nearest_of_other_labels_in_products(spark, monkeypatch):
    from foliant.operators import cosines
    from foliant.plans import registry, retrieval  # noqa: F401  registration comes first

    rng = np.random.default_rng(3)
    x = rng.standard_normal((900, 7))
    x[300:500] = x[100]  # equal scores, more than are kept
    rows = [(i, i % 3, v.tolist()) for i, v in enumerate(x)] + [(1000, 1, None), (1001, 2, [0.0] * 7), (1002, None, x[100].tolist())]
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    want = {}
    for q in range(0, 900, 50):
        s = np.round(unit @ unit[q], 12)
        best = sorted((i for i in range(900) if i % 3 != q % 3), key=lambda i: (-s[i], i))
        want[q] = ([1001] if q % 3 != 2 else []) + best  # NaN is the largest
    for block, cells in ((1000, 1 << 21), (4, 64)):
        monkeypatch.setattr(retrieval, "QUERY_BLOCK", block)
        monkeypatch.setattr(cosines, "CELLS", cells)
        df = retrieval.nearest_of_other_labels(_rows(spark, rows))
        got = {}
        for r in df.orderBy("query_id", "rank").collect():
            got.setdefault(r.query_id, []).append(r.vec_id)
        assert {q: v[:3] for q, v in want.items()} == {q: got[q] for q in want}
        assert got[1000] == [0, 2, 3]  # a null vector asks: no scores, smaller ids first
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_any_module_of_plans_may_be_imported_first():
    import subprocess
    import sys

    for name in ("corpus", "results", "retrieval", "streams"):
        subprocess.run([sys.executable, "-c", f"import foliant.plans.{name} as m; from foliant.plans.registry import QUERIES; assert 'evidence_ranking' in QUERIES"], check=True)
