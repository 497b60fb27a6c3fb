import random

from pyspark.sql import functions as F

from foliant.operators import quantiles as Q


def test_positions_against_a_sort(spark):
    rng = random.Random(3)
    data = [(g, rng.choice([rng.gauss(0, 1), rng.gauss(0, 1e-9), 0.0, 1e300, -5e-324, float("inf")])) for g in ("a", "b", None) for _ in range(700)]
    data += [("one", 2.5), ("same", 1.0), ("same", 1.0), ("none", None), ("nan", float("nan")), ("a", None)]
    df = spark.createDataFrame(data, "g string, v double").selectExpr("*", "1 as n", "2 as lo", "3 as need").repartition(5)
    at = {"first": F.lit(0), "mid": F.floor(F.col("n") / 2), "last": F.col("n") - 1, "beyond": F.col("n")}
    got = {r.g: (r.n, r.first, r.mid, r.last, r.beyond) for r in Q.select_positions(df.where("v is null or abs(v) < double('inf')"), ["g"], "v", at).collect()}
    want = {}
    for g in {"a", "b", None, "one", "same"}:
        v = sorted(x for k, x in data if k == g and x is not None and x == x and abs(x) < float("inf"))
        want[g] = (len(v), v[0], v[len(v) // 2], v[-1], None)
    assert got == want


def test_nearest_rank_large_whole_numbers_and_plan(spark):
    values = [2**62 + i for i in range(101)]
    df = spark.createDataFrame([(v,) for v in values], "v long")
    r = Q.select_positions(df, [], "v", {f"p{p}": Q.nearest_rank(p / 100) for p in (0, 50, 95, 99, 100)}).first()
    assert (r.n, r.p0, r.p50, r.p95, r.p99, r.p100) == (101, *[values[round(100 * p / 100)] for p in (0, 50, 95, 99, 100)])
    for n in range(1, 12):  # halves go to even
        got = Q.select_positions(df.limit(n), [], "v", {"p": Q.nearest_rank(0.5)}).first().p
        assert got == sorted(x.v for x in df.limit(n).collect())[round((n - 1) * 0.5)]
    assert Q.select_positions(df.limit(0), [], "v", {"p": Q.nearest_rank(0.5)}).collect() == []
    plan = Q.select_positions(df, [], "v", {"p": Q.nearest_rank(0.5)})._jdf.queryExecution().toString()
    assert "percentile" not in plan and "collect_list" not in plan


def test_interpolated(spark):
    df = spark.createDataFrame([("x", float(i * i)) for i in range(10)], "g string, v double")
    r = Q.percentile_cont(df, ["g"], "v", {"p95": 0.95, "p50": 0.5}).first()
    assert abs(r.p95 - (64 + 0.55 * 17)) < 1e-9 and r.p50 == 20.5
