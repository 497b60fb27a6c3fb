import random

from foliant.operators import ranking as R
from foliant.operators import search as S
from foliant.plans.registry import QUERIES


def rows(df):
    return sorted(((r.doc_id is None, r.doc_id or 0), r.token, r.weight) for r in df.collect())


def by_postings(docs, most=64):
    return rows(R.sparse_weights(S.postings(docs).selectExpr("doc_id", "term as token", "cast(tf as double) as weight"), most=most))


def test_rows_by_themselves_as_by_postings(spark):
    rng = random.Random(4)
    texts = [" ".join(rng.choices([f"w{i}" for i in range(rng.randrange(1, 200))], k=rng.randrange(1, 300))) for _ in range(60)]
    texts += [None, "", " .;", "one", "A a b", "a a b c", "x x y y", "é É 中文 a1-B2 B2"]
    schema = "doc_id long, text string"
    once = spark.createDataFrame(list(enumerate(texts)), schema)
    repeated = spark.createDataFrame([(i // 2 if i % 3 else i, t) for i, t in enumerate(texts)] + [(None, "a b b"), (None, "c b"), (70, None), (70, "a")], schema)
    single_null = spark.createDataFrame([(None, "a b b"), (1, "c b")], schema)
    for docs in (once, repeated, single_null, once.limit(0)):
        for most in (64, 3):
            assert rows(R.sparse_encoding(docs, most=most)) == by_postings(docs, most)
    assert any(r[0] == (True, 0) for r in rows(R.sparse_encoding(repeated)))


def test_no_task_holds_more_than_a_row(spark, tmp_path):
    spark.createDataFrame([(i, f"a b{i} a") for i in range(50)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    df = QUERIES["sparse_encoding"](spark, str(tmp_path))
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert df.count() == 50 and not any(x in plan for x in ("Window", "Aggregate", "Join"))


def test_weights_beside_a_half_round_as_the_half(spark):
    """0.1 + 0.9 * (n - middle) / (top - middle) can be a half but for the last bit; its SQL rounds it up."""
    words = {"a": 1, "b": 1, "c": 1, "d": 42, "e": 49}
    text = " ".join(w for w, n in words.items() for _ in range(n))
    got = {r.token: r.weight for r in R.sparse_encoding(spark.createDataFrame([(1, text)], "doc_id long, text string")).collect()}
    assert got["d"] == 0.8688
