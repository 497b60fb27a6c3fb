import random
import re
import zlib

import numpy as np
import pytest

from foliant.llm import language
from foliant.llm.language import fit_model, identify

BITS = {"aa": ["the", "ing", "ed", "th"], "bb": ["sch", "ung", "ü", "ein"], "cc": ["eau", "é", "ment", "oi"], "dd": ["ción", "ñ", "os", "que"]}


def corpus(n=400, seed=1):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        lang = rng.choice(list(BITS))
        text = " ".join("".join(rng.choices(BITS[lang], k=rng.randint(1, 3))) for _ in range(rng.randint(3, 60)))
        out.append((i, text.capitalize() + ".", lang, "s"))
    return out


def held(i):
    return zlib.crc32(str(i).encode()) % 5 == 0


def test_held_out_accuracy_and_odd_rows(frame, empty):
    docs = corpus() + [(9000, None, None, "s"), (9001, "123 !?", "aa", "s"), (9002, "", "aa", "s"), (9003, "the " * 30_000, None, "s"), (9004, "漢字", "aa", "s")]
    model = fit_model(frame(docs))
    rows = identify(frame(docs + docs[:1]), model).collect()
    assert len(rows) == len(docs) + 1
    by = {r.doc_id: r for r in rows}
    assert all(by[d[0]].held_out == held(d[0]) for d in docs)
    test = [d for d in docs[:400] if held(d[0])]
    assert np.mean([by[d[0]].lang_pred == d[2] for d in test]) > 0.95
    assert [by[i].lang_pred for i in (9000, 9001, 9002)] == ["und"] * 3 and by[9003].lang_pred == "aa" and by[9004].lang_pred in BITS
    assert all(0 <= r.score <= 1 for r in rows)
    assert identify(empty, model).collect() == []
    assert {r.lang_pred for r in identify(frame(docs[:5]), fit_model(empty)).collect()} == {"und"}


def test_held_out_labels_are_not_used(frame):
    docs = corpus()
    wrong = [(i, t, "zz" if held(i) else x, s) for i, t, x, s in docs]
    a, b = (sorted((r.doc_id, r.lang_pred, round(r.score, 6)) for r in identify(frame(docs), fit_model(frame(x))).collect()) for x in (docs, wrong))
    assert a == b


def test_kernel_is_the_blended_spectrum(frame):
    docs = corpus(60)
    model = fit_model(frame(docs))

    def grams(text):  # by the definition
        s = " " + re.sub(r"[^a-zéüñó]+", " ", text.lower()).strip() + " "
        return {s[i : i + n] for n in (1, 2, 3) for i in range(len(s) - n + 1)} - {" ", "  "} | {" "}

    for d in docs[:20]:
        assert len(set(language.grams(d[1]).tolist())) == len(grams(d[1]))
    texts = [d[1] for d in docs[:6]]
    p = model.presence(texts).astype(int)
    for i in range(6):
        for j in range(6):
            assert (p[i] & p[j]).sum() == len(grams(texts[i]) & grams(texts[j]))


def test_ridge_is_the_system_over_all_sample_rows(frame):
    docs = corpus(150)
    df = frame(docs)
    m = fit_model(df)
    sample = language.training_sample(df, "doc_id", "text", "lang").collect()
    assert len(sample) == sum(not held(d[0]) for d in docs)
    k = m.kernel([r.text for r in sample]).astype(float)
    y = np.array([[1.0 if r.lang == x else -1.0 for x in m.languages] for r in sample])
    w = np.array([1 / sum(r.lang == x.lang for r in sample) for x in sample])
    left = k.T @ (k * w[:, None]) + language.RIDGE * (m.landmarks @ m.landmarks.T) + 1e-8 * np.eye(len(m.landmarks))
    assert np.allclose(np.linalg.solve(left, k.T @ (y * w[:, None])), m.weights, atol=1e-3)


SCRIPTS = {"ja": (0x3041, 80), "ko": (0xAC00, 400), "zh": (0x4E00, 400), "th": (0xE01, 50), "hi": (0x905, 50), "el": (0x3B1, 24), "ru": (0x430, 32), "am": (0x1200, 300)}


def test_scripts_and_many_languages(frame, monkeypatch):
    monkeypatch.setattr(language, "ROWS_A_LANGUAGE", 20)
    rng = random.Random(5)
    lang = {k: [chr(lo + i) for i in range(n)] for k, (lo, n) in SCRIPTS.items()}
    lang |= {f"l{i}": [a + b for a in rng.sample("abcdefghijklmnop", 5) for b in rng.sample("qrstuvwxyz", 4)] for i in range(60)}
    docs, i = [], 0
    for k, units in lang.items():
        for _ in range(8 if k == "ja" else 60):  # one of them rare
            docs.append((i, " ".join("".join(rng.choices(units, k=4)) for _ in range(25)), k, "s"))
            i += 1
    m = fit_model(frame(docs, extra=False))
    assert m.languages == sorted(lang) and len(m.landmarks) >= 2 * len(lang)
    rows = {r.doc_id: r for r in identify(frame(docs), m).collect()}
    test = [d for d in docs if held(d[0])]
    right = [rows[d[0]].lang_pred == d[2] for d in test]
    assert np.mean(right) > 0.95 and all(ok for ok, d in zip(right, test, strict=True) if d[2] in SCRIPTS)


def test_null_languages_and_very_long_texts(frame, monkeypatch):
    monkeypatch.setattr(language, "BATCH_GRAMS", 500)
    docs = corpus(80) + [(7000 + i, "the ing ed " * 20_000, None, "s") for i in range(2)] + [(None, "the", "bb", "s")]
    rows = identify(frame(docs), fit_model(frame(docs))).collect()
    assert len(rows) == 83 and {r.lang_pred for r in rows if (r.doc_id or 0) >= 7000} == {"aa"}
    assert [r.held_out for r in rows if r.doc_id is None] == [False]


def test_landmarks_are_sparse_and_bounded(frame, monkeypatch):
    """Many languages: the model holds lists, not a matrix, and its kernel is that of the matrix; fewer landmarks where room ends."""
    rng = random.Random(6)
    units = lambda: ["".join(rng.sample("abcdefghijklmnopqrstuvwxyz", 3)) for _ in range(40)]
    docs = []
    for k in range(120):
        own = units()
        docs += [(10 * k + j, " ".join("".join(rng.choices(own, k=3)) for _ in range(30)), f"l{k:03}", "s") for j in range(10)]
    monkeypatch.setattr(language, "MARKS_AT_ONCE", 50)
    m = fit_model(frame(docs, extra=False))
    assert len(m.languages) == 120 and m.marks.nbytes + m.starts.nbytes < m.landmarks.nbytes / 10
    p = m.presence([d[1] for d in docs[:30]])
    assert np.allclose(m.kernel([d[1] for d in docs[:30]]), p @ m.landmarks.T / np.sqrt(p.sum(axis=1, keepdims=True)), atol=1e-5)
    assert np.allclose(m.between(), m.landmarks @ m.landmarks.T, atol=1e-5)
    monkeypatch.setattr(language, "MOST_SQUARE", 8 * 250**2)
    assert len(fit_model(frame(docs, extra=False)).scale) <= 250
    monkeypatch.setattr(language, "MOST_SQUARE", 8 * 100**2)
    with pytest.raises(ValueError, match="120 languages"):
        fit_model(frame(docs, extra=False))
