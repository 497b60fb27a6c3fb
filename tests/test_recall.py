import itertools
import random

from foliant.operators import recall as R


def brute_frequency(tokens, terms, slop):
    at = [[p - i for p, t in enumerate(tokens) if t == term] for i, term in enumerate(terms)]
    if not terms or not all(at):
        return 0.0
    by_end = {}
    for low in {a for x in at for a in x}:
        ends = [min((a for a in x if a >= low), default=None) for x in at]
        if None not in ends:
            by_end[max(ends)] = max(low, by_end.get(max(ends), low))
    return sum(1 / (1 + e - m) for e, m in by_end.items() if e - m <= slop)


def test_sloppy_frequency_against_every_window():
    rng = random.Random(4)
    for _ in range(500):
        tokens = [rng.choice("abcx") for _ in range(rng.randrange(30))]
        terms = [rng.choice("abc") for _ in range(rng.randrange(4))]
        slop = rng.randrange(6)
        assert abs(R.sloppy_frequency(tokens, terms, slop) - brute_frequency(tokens, terms, slop)) < 1e-12
    assert R.sloppy_frequency("a b c".split(), ["a", "b"], 0) == 1 and R.sloppy_frequency("a x b".split(), ["a", "b"], 0) == 0
    assert R.sloppy_frequency("a x b".split(), ["a", "b"], 1) == 0.5 and R.sloppy_frequency("b a".split(), ["a", "b"], 1) == 0 and R.sloppy_frequency("b a".split(), ["a", "b"], 2) == 1 / 3
    long = ["a", "b"] * 200_000  # one long text in one pass
    assert R.sloppy_frequency(long, ["a", "b"], 0) == 200_000


def test_query_grams():
    assert R.query_grams("Abc d") == ["ab", "bc", "abc"]
    assert len(R.query_grams("a" * 20)) == 7 and R.query_grams("é!") == []


def test_clauses(spark):
    rows = [(1, "red fox", "the red quick fox"), (2, "fox", "red"), (3, None, "fox red"), (4, "", None), (5, "blue", "aaaa"), (6, None, None)]
    docs = spark.createDataFrame(rows, "doc_id int, title string, body string").selectExpr("*", "1 as score", "2 as len", "3 as tf")
    ids = lambda *clauses, **k: sorted(r.doc_id for r in R.recall(docs, list(clauses), **k).collect())
    assert ids(R.Terms("title", "red fox")) == [1, 2] and ids(R.Terms("title", "red fox", least=60)) == [1, 2] and ids(R.Terms("title", "red fox", least=100)) == [1]
    assert ids(R.Phrase("body", "red fox")) == [] and ids(R.Phrase("body", "red fox", slop=1)) == [1] and ids(R.Phrase("body", "red fox", slop=2)) == [1, 3]
    assert ids(R.Exact("title", "fox")) == [2] and ids(R.Exact("title", "fox"), R.Grams("body", "aa")) == [2, 5]
    assert ids(R.Terms("title", "")) == [] and R.recall(docs.limit(0), [R.Terms("title", "red")]).collect() == []
    sums = {r.doc_id: r.score for r in R.recall(docs, [R.Exact("title", "fox", 2.0), R.Exact("body", "red", 5.0)]).collect()}
    best = {r.doc_id: r.score for r in R.recall(docs, [R.Exact("title", "fox", 2.0), R.Exact("body", "red", 5.0)], best=True).collect()}
    assert sums == {2: 7.0} and best == {2: 5.0}


def test_least_share_of_terms_by_hand(spark):
    """60 % of five terms are three; the better field counts, and confidence ends at 1."""
    terms = "aa bb cc dd ee".split()
    pairs = [(i, " ".join(c), "zz") for i, c in enumerate(itertools.combinations(terms, 2))] + [(100 + i, " ".join(c), "zz") for i, c in enumerate(itertools.combinations(terms, 3))] + [(200, "aa", "aa bb cc dd ee " * 3)]
    got = R.qa_recall(spark.createDataFrame(pairs, "id int, question string, answer string"), " ".join(terms), k=50).collect()
    assert sorted(r.id for r in got) == [*range(100, 110), 200]
    assert all(r.confidence == round(min(r.score / 10, 1), 4) and r.rrf_score == round(r.confidence * 0.015, 6) for r in got)
    assert [(-r.score, r.id) for r in got] == sorted((-r.score, r.id) for r in got)
