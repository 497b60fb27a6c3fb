import datetime
import random

from pyspark.sql.types import ArrayType, IntegerType, LongType, MapType, StringType, StructType

from foliant.operators import history as H
from foliant.operators import schemas as S


def t(s):
    return datetime.datetime(2024, 1, 1) + datetime.timedelta(seconds=s)


def test_state_and_spans_against_brute_force(spark):
    """Slices shorter than the gaps, several entries at one time, keys without a log, nulls."""
    rng = random.Random(4)
    log = [(rng.choice(["a", "a", "a", "b", None]), rng.choice([None, *[t(rng.randrange(4000)) for _ in range(9)]]), f"v{i}", i) for i in range(300)]
    probes = [(i, rng.choice(["a", "a", "b", "c", None]), rng.choice([None, *[t(rng.randrange(-100, 5000)) for _ in range(9)]])) for i in range(300)]
    entries = spark.createDataFrame(log, "doc string, at timestamp, grant string, n int").repartition(3)
    asked = spark.createDataFrame(probes, "id int, doc string, at timestamp").selectExpr("*", "1 as n", "2 as slice_x")
    got = {r.id: r.grant for r in H.state_at(asked, entries, ["doc"], "at", "grant", "n", 60).collect()}
    want = {}
    for i, doc, at in probes:
        seen = [(a, n, g) for d, a, g, n in log if a is not None and at is not None and d == doc and d is not None and a <= at]
        want[i] = max(seen)[2] if seen else None
    assert got == want
    got = sorted((r.doc or "", r.grant, r.valid_from, r.valid_to or t(10**6)) for r in H.spans(entries, ["doc"], "at", "grant", "n", 60).collect())
    want = []
    for doc in {r[0] for r in log}:
        own = sorted((a, n, g) for d, a, g, n in log if d == doc and a is not None)
        want += [(doc or "", g, a, b[0] if b else t(10**6)) for (a, _, g), b in zip(own, [*own[1:], None]) if not b or b[0] > a]
    assert got == sorted(want)
    assert H.state_at(asked.limit(0), entries, ["doc"], "at", "grant", "n").collect() == []
    assert {r.grant for r in H.state_at(asked, entries.limit(0), ["doc"], "at", "grant", "n").collect()} == {None}


def test_type_differences(spark, tmp_path):
    inner = StructType().add("x", LongType()).add("y", StringType())
    want = StructType().add("id", LongType(), False).add("meta", StructType().add("latest", StringType()).add("opt", StringType(), True, {"required": False}).add("deep", ArrayType(inner))).add("tags", MapType(StringType(), LongType()))
    have = StructType().add("id", LongType()).add("meta", StructType().add("deep", ArrayType(StructType().add("x", IntegerType()).add("z", StringType())))).add("tags", MapType(StringType(), StringType())).add("more", StringType())
    got = [(r.table, r.path, r.code, r.severity, r.expected, r.actual) for r in S.readiness(spark, {"docs": (have, want), "same": (want, want)}).collect()]
    assert got == [
        ("docs", "id", "nullable_field", "warning", "not null", "null"),
        ("docs", "meta.latest", "missing_required_field", "error", "string", None),
        ("docs", "meta.deep[].x", "type_mismatch", "error", "bigint", "int"),
        ("docs", "meta.deep[].y", "missing_required_field", "error", "string", None),
        ("docs", "meta.deep[].z", "extra_field", "info", None, "string"),
        ("docs", "tags{value}", "type_mismatch", "error", "bigint", "string"),
        ("docs", "more", "extra_field", "info", None, "string"),
    ]
    (tmp_path / "docs.json").write_text(have.json())
    assert S.exported_schemas(spark, str(tmp_path)) == {"docs": have}
    assert S.readiness(spark, {"kind": (StructType().add("a", inner), StructType().add("a", LongType()))}).first().code == "type_mismatch"
