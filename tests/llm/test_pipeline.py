import random
import re

import corpus_pipeline
import pytest

from foliant.llm.common import drop_ids, may_hold

from test_decontamination import brute as contaminated
from test_jaccard import brute as near
from test_toxicity import corpus


@pytest.fixture()
def folder(spark, tmp_path):
    """A small table folder: clean, toxic, copied, near-copied and contaminated documents, two sources."""
    rng = random.Random(5)
    docs, labels = corpus(spark, n=300)
    items = [(i, " ".join(f"b{rng.randrange(500)}q" for _ in range(14))) for i in range(6)]
    docs = [(i, t, "en", f"src{i % 3}", len(t)) for i, t, *_ in docs]
    base = [d for d in docs if not dict((i, t) for i, _, t in labels)[d[0]]]
    for k in range(60):
        d = rng.choice(base)
        w = d[1].split()
        if k % 2 and len(w) > 60:
            w[rng.randrange(len(w))] = "other"
        docs.append((1000 + k, " ".join(w), "en", "src0", 0))
    for k in range(12):
        docs.append((2000 + k, f"lead {k} words here " + rng.choice(items)[1] + f" tail {k} end", "en", "src1", 0))
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    return str(tmp_path), {d[0]: d for d in docs}, labels, items


def test_stages_one_by_one(spark, folder):
    path, by, labels, items = folder
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["toxicity", "near_copies", "decontamination", "mixing", "sharding"]
    docs = spark.read.parquet(f"{path}/documents.parquet")
    kept = stages["toxicity"](spark, docs, path)
    assert kept.columns == docs.columns
    left = {r.doc_id for r in kept.collect()}
    toxic = {i for i, _, t in labels if t}
    assert len(toxic - left) >= 0.95 * len(toxic) and len(left) >= 0.97 * (len(by) - len(toxic))
    one = stages["near_copies"](spark, docs, path)
    assert one.columns == docs.columns
    assert {r.doc_id for r in one.collect()} == {d for d, n, c, _ in near([(i, d[1]) for i, d in by.items()], 5, 80, 100) if d == c or not n}
    clean = stages["decontamination"](spark, docs, path)
    assert clean.columns == docs.columns
    assert {r.doc_id for r in clean.collect()} == {r[0] for r in contaminated([(i, d[1]) for i, d in by.items()], items) if not r[5]}
    mixed = stages["mixing"](spark, docs, path)
    assert mixed.columns == docs.columns
    words = {i: len(re.findall(r"[^\x20\x09-\x0D]+", d[1])) for i, d in by.items()}
    taken = sum(words[r.doc_id] for r in mixed.select("doc_id").collect())
    assert abs(taken - 1.5 * sum(words.values())) <= max(words.values()) * 3


def test_run(spark, folder):
    path, by, *_ = folder
    rows = corpus_pipeline.run(spark, path).collect()
    assert {r.shard for r in rows} == set(range(8)) and {r.doc_id for r in rows} <= set(by)
    sizes = [sum(r.size for r in rows if r.shard == s) for s in range(8)]
    assert max(sizes) - min(sizes) <= 2 * max(r.size for r in rows)


def test_dropping_ids(spark, frame):
    df = frame([(i, str(i), "en", "s") for i in range(500)] + [(None, "n", "en", "s"), (7, "again", "en", "s")])
    gone = spark.createDataFrame([(i,) for i in range(0, 500, 7)] + [(None,)], "g long")
    assert {r.doc_id for r in drop_ids(df, gone, "doc_id").collect()} == {None, *(i for i in range(500) if i % 7)}
    assert drop_ids(df, gone.limit(0), "doc_id").count() == 502
    held = df.where(may_hold(gone.where("g is not null"), "g")(df["doc_id"]))
    assert {i for i in range(0, 500, 7)} <= {r.doc_id for r in held.collect()}


def test_the_corpus_is_written(spark, folder, tmp_path):
    path, by, *_ = folder
    placed = corpus_pipeline.write_corpus(spark, path, f"{tmp_path}/corpus")
    rows = spark.read.parquet(f"{tmp_path}/corpus").collect()
    assert sorted((r.doc_id, r.shard, r.slot) for r in rows) == sorted((r.doc_id, r.shard, r.slot) for r in placed.collect())
    assert all(r.text == by[r.doc_id][1] for r in rows) and len({r.doc_id for r in rows}) < len(rows)


def test_rows_that_share_an_id_are_told_apart(spark, folder):
    """A clean row with a contaminated row's id stays; of copies under one id or none, one stays; columns may clash."""
    path, _, _, items = folder
    words = lambda k: " ".join(f"w{k}x{j}" for j in range(40))
    dirty = "lead " + items[0][1] + " tail"
    rows = [(1, dirty), (1, words(1)), (2, words(2)), (2, words(2)), (2, words(3)), (None, words(4)), (None, words(4)), (None, dirty), (3, words(2)), (4, ""), (4, None), (5, words(5)), (None, None)]
    df = spark.createDataFrame([(i, t, "en", "s", 0, "x") for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long, _key string")
    bench = spark.read.parquet(f"{path}/benchmark.parquet")
    from foliant.llm.decontamination import drop_contaminated
    from foliant.llm.jaccard import drop_near_copies

    key = lambda r: (r[0] is not None, r[0] or 0, r[1] or "")
    clean = drop_contaminated(df, bench)
    assert clean.columns == df.columns
    assert sorted([(r.doc_id, r.text) for r in clean.collect()], key=key) == sorted([r for r in rows if r[1] != dirty], key=key)
    kept = drop_near_copies(df)
    assert kept.columns == df.columns
    got = sorted([(r.doc_id, r.text) for r in kept.collect()], key=key)
    assert len([r for r in got if r[1] == words(2)]) == 1 and (3, words(2)) in got and len([r for r in got if r[1] == words(4)]) == 1
    assert [r for r in got if not r[1]] == sorted([r for r in rows if not r[1]], key=key) and {t for _, t in got} == {t for _, t in rows}
