import itertools
import random
import re

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from foliant.llm.mixing import bounded_subset, fit_budget, mix_documents, mix_sources


def words(t):
    return len(re.findall(r"[^\x20\x09-\x0D]+", t)) if t else 0


def targets(sizes):
    names = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + [None] * (None in sizes)
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    out, live, left = {}, set(names), 1.5 * sum(sizes.values())
    out = dict.fromkeys(names, 0.0)
    while live and left > 1e-9:
        total = sum(weight[s] for s in live)
        share = {s: left * weight[s] / total for s in live}
        left = 0.0
        for s in sorted(live, key=str):
            out[s] += share[s]
            if out[s] > 2 * sizes[s]:
                left += out[s] - 2 * sizes[s]
                out[s] = 2.0 * sizes[s]
                live.discard(s)
    return out


def test_against_plain_arithmetic(frame):
    rng = random.Random(3)
    docs = [(i, " ".join(["w"] * rng.choice([0, 1, 2, 3, 5, 40, 41, 300])), "en", rng.choice(["a", "a", "a", "b", "é", "z", None])) for i in range(1500)]
    docs += [(9000 + i, "q " * 7, "en", "a") for i in range(2000)] + [(8000, None, "en", "b"), (8001, "a b\x0bc", "en", "b")]
    rows = mix_sources(frame(docs)).collect()
    sizes = {}
    for d in docs:
        sizes[d[3]] = sizes.get(d[3], 0) + words(d[1])
    want = targets(sizes)
    by_id = {d[0]: d for d in docs}
    assert len(rows) == len(docs)
    for r in rows:
        d = by_id[r.doc_id]
        assert r.size == words(d[1]) and r.source_size == sizes[d[3]] and abs(r.target - want[d[3]]) < 1e-6 * max(1, want[d[3]])
        assert r.taken in (0, r.size, 2 * r.size)
    for s in sizes:
        taken = sum(r.taken for r in rows if r.source == s)
        assert abs(taken - want[s]) <= 1  # lengths of one word make every sum reachable
    again = mix_sources(frame(docs[::-1]).repartition(5)).collect()
    assert sorted((r.doc_id, r.taken) for r in rows) == sorted((r.doc_id, r.taken) for r in again)
    full = mix_documents(frame(docs))
    assert full.columns == frame(docs).columns
    assert sorted(r.doc_id for r in full.select("doc_id").collect()) == sorted(r.doc_id for r in rows for _ in range(r.repeats))


def test_empty_and_wordless(frame, empty):
    assert mix_sources(empty).collect() == []
    rows = mix_sources(frame([None, "", " \t"])).collect()
    assert [(r.size, r.target, r.taken) for r in rows] == [(0, 0.0, 0)] * 3


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 9), st.integers(1, 3)), max_size=4, unique_by=lambda x: x[0]), st.integers(0, 40))
def test_subset_sum_is_best(items, budget):
    items.sort()
    lengths, counts = np.array([x for x, _ in items], np.int64), np.array([c for _, c in items], np.int64)
    take = bounded_subset(lengths, counts, budget)
    assert (take <= counts).all()
    sums = {sum(a * b for a, b in zip(k, lengths, strict=True)) for k in itertools.product(*[range(c + 1) for c in counts])} if items else {0}
    assert (take * lengths).sum() == max(s for s in sums if s <= budget)


def test_large_budget_is_met_exactly():
    rng = np.random.default_rng(5)
    lengths = np.unique(rng.integers(1, 20_000, 4000))
    counts = rng.integers(1, 50, len(lengths))
    goal = int((lengths * counts).sum() * 0.37)
    take = fit_budget(lengths, counts, goal)
    assert (take <= counts).all() and (take >= 0).all() and (take * lengths).sum() == goal


def test_repeated_and_null_ids_meet_the_target(spark, frame):
    """Rows are drawn one by one: no source is off by more than the words of its lengths can't make up."""
    docs = [(None, "a b", "en", "n")] * 1000 + [(5, "a b", "en", "five")] * 1000 + [(7, f"word{i % 2} c", "en", "seven") for i in range(1000)] + [(i, "one", "en", "z") for i in range(50)]
    sizes = {"n": 2000, "five": 2000, "seven": 2000, "z": 50}
    want = targets(sizes)
    runs = []
    for df in (frame(docs), frame(docs[::-1]).repartition(7)):
        rows = mix_sources(df).collect()
        assert len(rows) == len(docs)
        for s in sizes:
            assert abs(sum(r.taken for r in rows if r.source == s) - want[s]) <= 1.5
        runs.append(sorted((r.source, r.doc_id is None, r.doc_id or 0, r.taken) for r in rows))
    assert runs[0] == runs[1]
    mixed = mix_documents(frame(docs))
    assert mixed.columns == frame(docs).columns
    held = {}
    for r in mixed.select("source", "text").collect():
        held[r.source] = held.get(r.source, 0) + words(r.text)
    assert all(abs(held.get(s, 0) - want[s]) <= 1.5 for s in sizes)


def test_very_long_text(frame):
    docs = [(0, "w " * 300_000, "en", "a"), (1, "w " * 1000, "en", "a"), (2, None, None, None)] + [(i, "w", "en", "b") for i in range(3, 400)]
    rows = {r.doc_id: r for r in mix_sources(frame(docs)).collect()}
    assert rows[0].size == 300_000 and rows[2].size == 0 and all(r.taken <= 2 * r.size for r in rows.values())
    assert abs(sum(r.taken for r in rows.values() if r.source == "b") - rows[3].target) <= 1
