import hashlib
import random
import re

import pytest

from pyspark.sql import functions as F

from foliant.llm import decontamination
from foliant.llm.decontamination import contamination, drop_contaminated, phrase_matches, proximity_matches

LOWER = {c: c + 32 for c in range(65, 91)}


def words(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", t.translate(LOWER)) if t else []


def brute(docs, items):
    out = []
    for d, text in docs:
        w, hit, found = words(text), set(), set()
        for item, t in items:
            v = words(t)
            for i in range(max(1, len(v) - 9) if v else 0):
                win = v[i : i + 10]
                for j in range(len(w) - len(win) + 1):
                    if w[j : j + len(win)] == win:
                        hit |= set(range(j, j + len(win)))
                        found.add(str(item))
        sha = hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
        out.append((d, len(w), len(hit), len(found), sha, bool(hit)))
    return sorted(out)


def near(docs, items, slack, misses, full=False):
    """Every anchor term present, every other within the slack of its place; one row a distinct span in a document row."""
    out = []
    for d, text in docs:
        w, found = words(text), set()
        at = {}
        for p, x in enumerate(w):
            at.setdefault(x, []).append(p)
        for item, t in items:
            v = words(t)
            for i in range(max(1, len(v) - 9) if v else 0):
                win = v[i : i + 10]
                for a, x in enumerate(win) if len(win) > misses else ():
                    for p in at.get(x, []):
                        got = [p]
                        for b, y in enumerate(win):
                            if b != a:
                                got += [q for q in at.get(y, []) if abs(q - (p - a + b)) <= slack][:1]
                        if len(got) >= len(win) - misses:
                            found.add((d, str(item), min(got), max(got) - min(got) + 1, len(got), len(win)) if full else (d, str(item), min(got), max(got) - min(got) + 1))
        out += found
    return out


def case(seed=2):
    rng = random.Random(seed)
    vocab = ["the", "of", "é", "Zwei", "b2"] + [f"w{i}" for i in range(40)]
    items = [(i, " ".join(rng.choices(vocab, k=rng.choice([3, 9, 10, 11, 25])))) for i in range(25)] + [(90, ""), (91, None), (92, "of the"), (93, "of the"), (9, "the!")]
    docs = []
    for i in range(120):
        text = " ".join(rng.choices(vocab[3:], k=rng.randint(0, 80)))
        if i % 3 == 0:
            text += "; " + (rng.choice(items)[1] or "").upper()
        docs.append((i, text))
    docs += [(500, None), (501, ""), (502, "the " * 3000), (503, items[3][1]), (503, items[3][1])]
    return docs, items


def test_against_brute_force(spark, frame):
    docs, items = case()
    items = [(i, t or "") for i, t in items]
    bench = spark.createDataFrame([(i, t or None) for i, t in items], "item_id long, text string")
    df = frame([(d, t, "en", "s") for d, t in docs])
    rows = contamination(df, bench).drop("items").collect()
    want = brute(docs, items)
    assert sorted(map(tuple, rows)) == want
    clean = {r[0] for r in want if not r[5]}
    assert {r.doc_id for r in drop_contaminated(df, bench).collect()} == clean
    spans = phrase_matches(df, bench)
    assert sorted(map(tuple, spans.collect())) == sorted(near(docs, items, 0, 0))


def test_blocks_of_items_give_the_same(spark, frame, monkeypatch):
    docs, items = case(4)
    docs = list(dict(docs).items())
    items = [(i, t or "") for i, t in items]
    bench = spark.createDataFrame(items, "item_id long, text string")
    monkeypatch.setattr(decontamination, "BLOCK_WORDS", 60)
    rows = contamination(frame([(d, t, "en", "s") for d, t in docs]), bench).drop("items").collect()
    assert sorted(map(tuple, rows)) == brute(docs, items)


def test_blocks_answer_row_by_row(spark, frame, monkeypatch):
    docs, items = case(6)
    docs += [(3, docs[4][1]), (3, docs[4][1]), (None, docs[0][1]), (None, docs[1][1])]  # repeated rows, one id with two texts, null ids
    items = [(i, t or "") for i, t in items]
    bench = spark.createDataFrame(items, "item_id long, text string")
    df = frame([(d, t, "en", "s") for d, t in docs])
    one = sorted(map(repr, contamination(df, bench).drop("items").collect()))
    monkeypatch.setattr(decontamination, "BLOCK_WORDS", 60)
    assert sorted(map(repr, contamination(df, bench).drop("items").collect())) == one and len(one) == len(docs)


def test_empty_tables(spark, frame, empty):
    bench = spark.createDataFrame([(1, "a b c")], "item_id long, text string")
    assert contamination(empty, bench).collect() == []
    rows = contamination(frame(["a b c", None]), bench.where(F.lit(False))).collect()
    assert [(r.n_words, r.n_hit, r.contaminated) for r in rows] == [(3, 0, False), (0, 0, False)]
    assert phrase_matches(frame(["a b c", None]), bench.where(F.lit(False))).collect() == []
    assert proximity_matches(empty, bench).collect() == []
    wordless = spark.createDataFrame([(1, "!?"), (2, None)], "item_id long, text string")
    assert phrase_matches(frame(["a b c"]), wordless).collect() == [] and [r.n_hit for r in contamination(frame(["a b c"]), wordless).collect()] == [0]


@pytest.mark.parametrize(("slack", "misses"), [(1, 0), (0, 1), (2, 1)])
def test_proximity_against_brute_force(spark, frame, slack, misses):
    rng = random.Random(slack * 10 + misses)
    vocab = [f"w{i}" for i in range(400)]
    items = [(i, " ".join(rng.sample(vocab, k=rng.choice([2, 9, 10, 14])))) for i in range(12)] + [(50, "one")]
    docs = [(1, None), (2, ""), (2, "one one"), (None, items[0][1])]
    for i in range(60):
        w = items[rng.randrange(12)][1].split()
        for _ in range(rng.choice([0, 1, 1, 2])):  # words changed, put in or left out
            p = rng.randrange(len(w))
            w[p : p + rng.choice([0, 1])] = rng.choice([["new"], [], [rng.choice(vocab)]])
        docs.append((i + 10, " ".join([*rng.sample(vocab, k=5), *w, *rng.sample(vocab, k=5)])))
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {tuple(r) for r in proximity_matches(frame([(d, t, "en", "s") for d, t in docs]), bench, slack, misses).collect()}
    want = set(near(docs, items, slack, misses, full=True))
    # the operator looks from the rarest terms alone: it gives some of the spans, and no document and item less
    assert got <= want and {x[:2] for x in got} == {x[:2] for x in want}
    exact = {x[:2] for x in near(docs, items, 0, 0)}
    assert {x[:2] for x in got} >= {x for x in exact if misses == 0 or x[1] != "50"} and len({x[:2] for x in got}) > len(exact) - 5
