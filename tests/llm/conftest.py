import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture()
def frame(spark):
    """Documents from texts (or (id, text, lang, source) tuples), with extra columns whose names operators use inside."""

    def make(rows, extra=True):
        full = [(i, r, "en", "s", 0) if r is None or isinstance(r, str) else (*r, 0) for i, r in enumerate(rows)]
        df = spark.createDataFrame(full, SCHEMA)
        if extra:
            for name in ("id", "size", "shard", "range", "bin", "key", "terms", "n", "label", "score", "token"):
                df = df.selectExpr("*", f"'x' as `{name}`")
        return df

    return make


@pytest.fixture()
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
