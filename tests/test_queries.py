"""Every registered query of the engine against its SQL."""

import os

import oracle
import pytest

from foliant.plans.registry import ORACLE_SQL, QUERIES, flagship

DATA = "/root/testdata/sf0.01"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="tables are absent")


@pytest.fixture(scope="module")
def con():
    return oracle.connect(DATA)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    df = QUERIES[name](spark, DATA)
    if name in ORACLE_SQL:
        assert oracle.compare(df, con, ORACLE_SQL[name]) == ""
    else:
        assert df.columns and df.count() > 0  # their rows are held against plain Python elsewhere


def test_blocking_of_long_and_missing_texts(spark, tmp_path):
    texts = [x * n + w for x in ("x", "é😀") for n in (0, 1000, 99_998, 199_995, 200_000, 1_500_000) for w in ("", "moron", " idiot", "moroon")]
    texts += ["moron" + "x" * 300_000, "x" * 150_000 + "moron" + "x" * 150_000, "", None]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert oracle.compare(QUERIES["sensitive_blocking"](spark, str(tmp_path)), oracle.connect(tmp_path), ORACLE_SQL["sensitive_blocking"]) == ""

def test_flagship(spark):
    assert flagship(spark, DATA).count() == 10


def test_plans_prune_and_push_down(spark):
    plan = QUERIES["pricing_summary"](spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(l_shipdate)" in plan and "l_comment" not in plan and "l_partkey" not in plan


def test_whole_tables_are_folded(spark):
    every = spark.read.parquet(f"{DATA}/lineitem.parquet").select("l_orderkey").distinct().count()
    assert QUERIES["acl_decision_fold_whole"](spark, DATA).count() == every
    assert QUERIES["answer_overlap"](spark, DATA).count() > 0
