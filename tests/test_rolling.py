import random

from foliant.operators import rolling as R
from foliant.operators.chunking import link_parents
from foliant.operators.versions import rollup


def test_strings_against_find():
    rng = random.Random(1)
    word = lambda n: "".join(rng.choice("abé😀") for _ in range(n))
    for _ in range(150):
        strings = [word(rng.choice([0, 1, 2, 4, 7, 8, 33])) for _ in range(8)]
        text = "".join(rng.choice([word(5), rng.choice(strings)]) for _ in range(rng.randrange(8)))
        assert R.Strings(strings).held(text) == [i for i, s in enumerate(strings) if s and s in text]
        wholes, probes = [word(rng.randrange(20)) for _ in range(4)], [word(rng.randrange(4)) for _ in range(6)]
        assert R.first_holders(probes, wholes) == [next((i for i, w in enumerate(wholes) if p in w), -1) for p in probes]
    assert R.first_holders(["a"], []) == [-1] and R.Strings([]).held("a") == [] and R.Strings(["a"]).held("") == []


def test_literal_matches(spark, monkeypatch):
    docs = spark.createDataFrame([(1, "the whole item text is here"), (2, None), (3, ""), (4, "whole item")], "doc_id int, text string")
    items = spark.createDataFrame([(1, "whole item"), (2, "whole item text is here and more"), (3, None), (4, ""), (5, "whole item"), (6, "here")], "item_id int, text string")
    want = [(1, 1), (1, 4), (5, 1), (5, 4), (6, 1)]
    get = lambda: sorted(tuple(r) for r in R.literal_matches(docs, items, "doc_id", "text", "item_id", "text").collect())
    assert get() == want
    monkeypatch.setattr(R, "MOST_STRINGS", 2)
    assert get() == want


def test_parents_by_hand(spark):
    rows = [(1, "coarse", 1, "c1", "alpha  beta gamma"), (1, "coarse", 0, "c0", "alpha beta"), (1, "fine", 0, "f0", "beta\ngamma"), (1, "fine", 1, "f1", "alpha beta"), (1, "fine", 2, "f2", "delta"), (1, "fine", 3, "f3", None), (2, "fine", 0, "g0", "alpha"), (2, "other", 0, "o", "x"), (3, "coarse", 0, "h", "x")]
    got = {(r.doc_id, r.fine_id): r.parent_chunk_id for r in link_parents(spark.createDataFrame(rows, "doc_id int, granularity string, seq int, chunk_id string, content string")).collect()}
    assert got == {(1, "f0"): "c1", (1, "f1"): "c0", (1, "f2"): None, (1, "f3"): None, (2, "g0"): None}


def test_rollup_against_plain_python(spark):
    rng = random.Random(3)
    rows = [(rng.choice(["a", "b", None]), rng.choice([None, *range(60)]), f"text {i} " * 200, rng.randrange(5), [rng.choice("xyz")]) for i in range(400)]
    got = {r.source: r for r in rollup(spark.createDataFrame(rows, "source string, seq int, content string, doc_version int, tokens array<string>").repartition(4)).collect()}
    for name in ("a", "b", None):
        own = [r for r in rows if r[0] == name]
        order = sorted(own, key=lambda r: (r[1] is not None, r[1] or 0, r[2]))
        assert got[name].summaries == [r[2][:500] for r in order[:3]] and got[name].chunk_ids == sorted({r[1] for r in own if r[1] is not None})[:32]
        assert got[name].chunks == len(own) and got[name].doc_version == max(r[3] for r in own) and got[name].tokens == sorted({t for r in own for t in r[4]})
