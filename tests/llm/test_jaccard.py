import random
import re

import pytest

from foliant.llm import jaccard
from foliant.llm.graph import components
from foliant.llm.jaccard import drop_near_copies, jaccard_components

LOWER = {c: c + 32 for c in range(65, 91)}


def sets_of(text, n):
    w = re.findall(r"[^\x20\x09-\x0D]+", text.translate(LOWER)) if text else []
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())


def brute(docs, n, num, den):
    s = [sets_of(t, n) for _, t in docs]
    up = list(range(len(docs)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    links = [0] * len(docs)
    for i in range(len(docs)):
        for j in range(i):
            if s[i] and s[j] and den * len(s[i] & s[j]) >= num * len(s[i] | s[j]):
                links[i] += 1
                links[j] += 1
                up[max(root(i), root(j))] = min(root(i), root(j))
    low = {}
    for i, (d, _) in enumerate(docs):
        low[root(i)] = min(low.get(root(i), d), d)
    return sorted((d, len(s[i]), low[root(i)], links[i]) for i, (d, _) in enumerate(docs))


def corpus(seed, base=30, copies=220):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(60)] + ["É", "é", "The", "the"]
    texts = [" ".join(rng.choices(vocab, k=rng.choice([1, 2, 3, 30, 60, 120]))) for _ in range(base)]
    for _ in range(copies):
        w = rng.choice(texts).split()
        for _ in range(rng.choice([0, 1, 1, 2, 4])):
            w[rng.randrange(len(w))] = rng.choice(vocab)
        texts.append(" ".join(w))
    hot = rng.choices(vocab, k=200)  # one group of near copies, chained and partly apart
    for _ in range(150):
        w = list(hot)
        for _ in range(rng.choice([1, 2, 3, 4, 5, 9])):
            w[rng.randrange(len(w))] = rng.choice(vocab) + rng.choice(["", "x", "y"])
        texts.append(" ".join(w))
    texts += ["", None, "one two", "ONE  two", "one two three"] + ["exactly the same text here"] * 40
    ids = rng.sample(range(10_000), len(texts))
    return list(zip(ids, texts, strict=True))


@pytest.mark.parametrize(("seed", "n", "num", "den"), [(1, 3, 90, 100), (2, 5, 80, 100)])
def test_components_against_brute_force(frame, monkeypatch, seed, n, num, den):
    monkeypatch.setattr(jaccard, "REST_BLOCK", 8)
    monkeypatch.setattr(jaccard, "ALL_BLOCK", 16)
    monkeypatch.setattr(jaccard, "COUNT_BLOCK", 12)
    monkeypatch.setattr(jaccard, "COLUMNS", 64)
    monkeypatch.setattr(jaccard, "MEMBERS_A_LEADER", 10)
    docs = corpus(seed)
    rows = jaccard_components(frame([(i, t, "en", "s") for i, t in docs]), n, num, den, count_links=True).collect()
    want = brute(docs, n, num, den)
    assert sorted(map(tuple, rows)) == want
    if seed == 2:
        kept = {r.doc_id for r in drop_near_copies(frame([(i, t, "en", "s") for i, t in docs]), n, num, den).collect()}
        assert kept == {d for d, m, c, _ in want if d == c or not m}


def test_repeated_rows_null_ids_and_empty(frame, empty):
    assert jaccard_components(empty).collect() == []
    docs = [(7, "a b c d", "en", "s")] * 3 + [(None, "a b c d", "en", "s"), (None, "z", "en", "s"), (9, None, "en", "s")]
    rows = jaccard_components(frame(docs), count_links=True).collect()
    assert sorted(map(tuple, rows), key=str) == sorted([(7, 2, 7, 3)] * 3 + [(None, 2, 7, 3), (None, 1, None, 0), (9, 0, 9, 0)], key=str)


def test_very_long_texts(frame):
    rng = random.Random(3)
    w = [f"w{rng.randrange(5000)}" for _ in range(30_000)]
    far = list(w)
    far[::10] = ["x"] * 3000
    near = list(w)
    near[50] = "x"
    rows = jaccard_components(frame([(1, " ".join(w), "en", "s"), (2, " ".join(near), "en", "s"), (3, " ".join(far), "en", "s"), (4, "w1", "en", "s")]), count_links=True).collect()
    assert sorted((r.doc_id, r.component_id, r.n_links) for r in rows) == [(1, 1, 1), (2, 1, 1), (3, 3, 0), (4, 4, 0)]


def test_components_of_a_chain_and_a_hub(spark):
    edges = [(i, i + 1) for i in range(100, 140)] + [(5, i) for i in range(200, 300)] + [(1, 1)]
    got = dict(map(tuple, components(spark.createDataFrame(edges, "a long, b long")).collect()))
    assert got == {**{i: 100 for i in range(100, 141)}, **{i: 5 for i in [5, *range(200, 300)]}}
