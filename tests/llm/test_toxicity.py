import random
import zlib

import numpy as np
import pytest

from foliant.llm import gbt
from foliant.llm.toxicity import NAMES, SEED, _Codes, drop_toxic, features, fit_model, score_toxicity


def held(i):
    return zlib.crc32(str(i).encode()) % 3 == 1


def corpus(spark, seed=1, n=900):
    rng = random.Random(seed)
    docs, labels = [], []
    for i in range(n):
        w = [f"{rng.choice('bcdf')}{rng.choice('aeiou')}{rng.randrange(60)}x".translate(str.maketrans("0123456789", "qwrtzpsdfg")) for _ in range(rng.randint(20, 200))]
        toxic = rng.random() < 0.3
        if toxic:
            for _ in range(max(3, len(w) // 15)):
                w.insert(rng.randrange(len(w)), rng.choice(["idiot", "scum", "Moron", "vrexling", "vrextum", "1diot"]))
        docs.append((i, " ".join(w), "en", "s"))
        labels.append((i, 1, int(toxic)))
    return docs, labels


@pytest.fixture()
def case(spark, frame):
    docs, labels = corpus(spark)
    return docs, labels, frame(docs), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_held_out_accuracy_and_columns(spark, frame, empty, case):
    docs, labels, df, lab = case
    model = fit_model(df, lab)
    rows = {r.doc_id: r for r in score_toxicity(df, model).collect()}
    assert all(rows[i].held_out == held(i) and rows[i].predicted == int(rows[i].score >= 0.7) and 0 <= rows[i].score <= 1 for i in rows)
    right = [rows[i].predicted == t for i, _, t in labels if held(i)]
    assert np.mean(right) > 0.95
    assert any("vrex"[:4] == s[:4] for s in model.stems)  # learned from the labels
    odd = frame([(1, None, "en", "s"), (1, "", "en", "s"), (None, "you idiot scum", "en", "s"), (3, "a" * 300_000, "en", "s")])
    assert score_toxicity(odd, model).count() == 4 and score_toxicity(empty, model).collect() == []
    kept = {r.doc_id for r in drop_toxic(df, lab).collect()}
    assert kept == {i for i in rows if rows[i].predicted == 0} and drop_toxic(df, lab).columns == df.columns


def test_held_out_labels_are_not_used(spark, frame, case):
    docs, labels, df, lab = case
    flipped = spark.createDataFrame([(i, q, 1 - t if held(i) else t) for i, q, t in labels], "doc_id long, quality int, toxic int")
    a, b = (sorted((r.doc_id, round(r.score, 9)) for r in score_toxicity(df, fit_model(df, x)).collect()) for x in (lab, flipped))
    assert a == b


def test_without_labels(spark, frame, case):
    _, _, df, lab = case
    rows = score_toxicity(df, fit_model(df, lab.limit(0))).collect()
    assert {r.score for r in rows} == {0.0}


def test_features():
    codes = _Codes(frozenset(SEED), frozenset())
    f = dict(zip(NAMES, features("You are an IDIOT! really, a m0ron?", codes), strict=True))
    assert f["lex_log"] == pytest.approx(np.log(3)) and f["obfuscated"] == 1 and f["near_you"] == 2 and f["shout_ratio"] > 0 and f["exclaim"] > 0
    assert not features(None, codes).any() and not features(" ", codes).any()


def test_trees_and_calibration():
    rng = np.random.default_rng(0)
    x = rng.random((2000, 3))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.3)).astype(float)
    m = gbt.fit(x[:1500], y[:1500], np.ones(1500))
    assert ((m.margin(x[1500:]) > 0) == y[1500:]).mean() > 0.95
    s = rng.random(400)
    t = (rng.random(400) < s).astype(float)
    xs, ps = gbt.isotonic(s, t, np.ones(400))
    assert (np.diff(ps) >= 0).all()
    fit = np.interp(s, xs, ps)
    best = min(((fit_try - t) ** 2).sum() for fit_try in (s, fit))
    assert ((fit - t) ** 2).sum() == best and abs(fit.mean() - t.mean()) < 1e-9
