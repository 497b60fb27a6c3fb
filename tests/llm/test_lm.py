import random

import numpy as np
import pyarrow as pa
import xxhash

from foliant.llm import lm
from foliant.llm.lm import CLASSES, PAD, SLOTS, WINDOW, Network, Slots, Vocabulary, fit, padded, score, slots_of, words_of


def net(seed=1):
    rng = np.random.default_rng(seed)
    n = Network.fresh(rng.integers(1, 50, SLOTS).astype(float))
    return n.filled(n.flat() + rng.standard_normal(n.flat().size) * 0.05)


def dense(n, tokens, i):
    """Log-probability of one token by the definition, in double precision."""
    h = n.bias.astype(float).copy()
    for j, off in enumerate([-2, -1, 1, 2]):
        h += n.context[j, tokens[i + off]]
    h = np.tanh(h)
    word, of = divmod(int(tokens[i]), CLASSES)
    z = h @ n.classes + n.class_bias
    y = h @ n.words[of] + n.word_bias[of]
    return z[of] - np.log(np.exp(z).sum()) + y[word] - np.log(np.exp(y).sum())


def test_log_probs_by_definition_and_sum_to_one():
    n = net()
    tokens, at = padded([np.array([5, 70, 4095, 5, 9], np.int32), np.array([3], np.int32)])
    assert tokens.tolist().count(PAD) == 3 * WINDOW
    assert np.allclose(n.log_probs(tokens, at), [dense(n, tokens, i) for i in at], atol=1e-4)
    total = 0.0
    for w in range(SLOTS):
        tokens[at[2]] = w
        total += np.exp(n.log_probs(tokens, at[2:3])[0])
    assert abs(total - 1) < 1e-3


def test_steps_lower_the_loss():
    rng = np.random.default_rng(0)
    n = Network.fresh(np.ones(SLOTS))
    tokens, at = padded([np.tile(np.array([10, 200, 3000, 77], np.int32), 200)])
    before = n.log_probs(tokens, at).mean()
    for _ in range(20):
        rng.shuffle(at)
        n.step(tokens, at, 0.5)
    assert n.log_probs(tokens, at).mean() > before + 2


def test_whole_table(frame, empty, monkeypatch):
    rng = random.Random(0)
    order = [f"w{i}" for i in range(12)]
    text = lambda n: " ".join(order[i % 12] for i in range(rng.randrange(12), n + 12))
    docs = [(i, text(60), "en", "s") for i in range(200)] + [(900, None, "en", "s"), (901, " \t", "en", "s"), (902, "zzz", "en", "s")]
    df = frame(docs + docs[:1])
    vocab, n = fit(df)
    slots = vocab.slots
    rows = {r.doc_id: r for r in score(df, vocab, n).collect()}
    assert len(rows) == 203 and score(df, vocab, n).count() == 204
    assert (rows[900].n_tokens, rows[900].pseudo_log_likelihood, rows[900].mean_log_prob) == (0, 0.0, None) and rows[901].n_tokens == 0
    for d in docs[:5]:
        w = words_of(d[1])
        tokens, at = padded([slots_of(slots.codes(w))])
        want = sum(dense(n, tokens, i) for i in at)
        assert rows[d[0]].n_tokens == len(w) and abs(rows[d[0]].pseudo_log_likelihood - want) < 1e-2
    shuffled = frame([(i, " ".join(rng.sample(d[1].split(), len(d[1].split()))), "en", "s") for i, d in enumerate(docs[:50])])
    mixed = [r.mean_log_prob for r in score(shuffled, vocab, n).collect()]
    assert np.mean([rows[d[0]].mean_log_prob for d in docs[:50]]) > np.mean(mixed) + 0.2
    assert score(empty, *fit(empty)).collect() == []


def test_rare_words_share_slots():
    s = Slots({b"a": 0})
    a, rare, again = slots_of(s.codes([b"a", b"rare", b"rare"])).tolist()
    assert a == 0 and SLOTS - lm.RARE <= rare < SLOTS and rare == again


def test_codes_are_slots_or_hashes():
    s = Slots({b"a": 0})
    words = [b"a", *(b"w%d" % (i % 7) for i in range(40))]
    assert s.codes(words).tolist() == [0, *(xxhash.xxh64_intdigest(w, 42) for w in words[1:])] and len(s) == 1


def test_softmax_of_extreme_values():
    z = np.array([[1000.0, 0, -1000], [-500, -501, -502], [1, 2, 3]], np.float32)
    want = np.exp(z.astype(float) - z.max(axis=1, keepdims=True))
    want /= want.sum(axis=1, keepdims=True)
    assert np.allclose(lm._softmax(z.copy()), want, atol=1e-6)
    got = lm._log_softmax(z.copy(), np.arange(3), np.array([0, 2, 1]))
    assert np.allclose(got, [0, -2.407606, -1.407606], atol=1e-4)


def test_rare_words_have_their_own_probability(frame, monkeypatch):
    monkeypatch.setattr(lm, "RARE", 4)
    monkeypatch.setattr(lm, "SLOTS", 8)
    monkeypatch.setattr(lm, "CLASSES", 2)
    monkeypatch.setattr(lm, "PER_CLASS", 4)
    monkeypatch.setattr(lm, "PAD", 8)
    held = {f"w{i}": 40 - i for i in range(30)}
    df = frame([" ".join(w for w, n in held.items() for _ in range(n))] + ["once"])
    vocab = lm.vocabulary(df, "text")
    slots, counts = vocab.slots, vocab.counts
    rare = [w for w in [*held, "once"] if slots_of(slots.codes([w.encode()]))[0] >= 4]
    assert len(rare) == 27 and vocab.words == sum(held.values()) + 1
    n = {r.h & (2**64 - 1): r.n for r in vocab.rare.collect()}
    assert n == {xxhash.xxh64_intdigest(w.encode(), 42): held[w] for w in rare if held.get(w, 1) > 1}
    total = {s: sum(held.get(w, 1) for w in rare if slots_of(slots.codes([w.encode()]))[0] == s) for s in range(4, 8)}
    assert np.allclose(np.exp(slots.log_once(np.arange(4, 8))), [1 / (total[s] + 1) for s in range(4, 8)])
    assert counts[4:].tolist() == [total.get(i, 0) for i in range(4, 8)]


def test_crowded_slots_do_not_lend_their_probability(spark, frame):
    s = Slots({b"a": 0})
    slot = slots_of(s.codes([b"seen"]))[0]
    other = next(w for w in (f"q{i}" for i in range(9999)) if slots_of(s.codes([w.encode()]))[0] == slot)
    s.totals = np.full(lm.RARE, 1000.0)
    signed = int(np.uint64(xxhash.xxh64_intdigest(b"seen", 42)).view(np.int64))
    vocab = Vocabulary(s, np.zeros(SLOTS), 1, spark.createDataFrame([(signed, 50)], "h long, n long"))
    df = frame([(1, "a seen a", "en", "s"), (1, f"a {other} a", "en", "s"), (2, "a seen a seen", "en", "s"), (None, None, "en", "s")])
    rows = sorted((r.doc_id or 0, r.pseudo_log_likelihood) for r in score(df, vocab, net()).collect())
    tokens, at = padded([np.array([0, slot, 0, slot], np.int32)])
    want = sum(dense(net(), tokens, i) for i in at) + 2 * np.log(50 / 1001)
    assert rows[0] == (0, 0.0) and abs(rows[2][1] - rows[1][1] - np.log(50)) < 1e-4 and abs(rows[3][1] - want) < 1e-2


def test_partitions_make_no_difference(frame, monkeypatch):
    monkeypatch.setattr(lm, "SHARD_WORDS", 300)
    rng = random.Random(3)
    df = frame([(i, " ".join(rng.choices(["a", "b", "c", "dd", "e"], k=20)), "en", "s") for i in range(60)])
    one, other = (fit(x)[1].flat() for x in (df.repartition(1), df.repartition(7)))
    assert np.array_equal(one, other) and not np.array_equal(one, Network.fresh(np.zeros(SLOTS)).flat())


def test_very_long_texts(frame, monkeypatch):
    monkeypatch.setattr(lm, "SCORED_TOKENS", 1000)
    df = frame(["a b c " * 20_000, "a b", None, "c"])
    rows = score(df, *fit(df)).collect()
    assert sorted(r.n_tokens for r in rows) == [0, 1, 2, 60_000] and all(r.pseudo_log_likelihood <= 0 for r in rows)


def test_a_step_is_the_gradient():
    n, m = net(), net()
    tokens, at = padded([np.array([5, 70, 4095, 5, 9, 69], np.int32)])
    n.step(tokens, at, 0.01)
    loss = lambda x: sum(dense(x, tokens, i) for i in at)
    for part, place, share in (("word_bias", (5, 1), 8), ("words", (5, 3, 1), 8), ("context", (1, 5, 2), 16)):
        up = net()
        getattr(up, part)[place] += 1e-2
        down = net()
        getattr(down, part)[place] -= 1e-2
        assert np.isclose((getattr(n, part) - getattr(m, part))[place], 0.01 / share * (loss(up) - loss(down)) / 2e-2, rtol=0.02, atol=1e-6)


def test_every_document_trains(frame, monkeypatch):
    seen = []
    monkeypatch.setattr(lm, "_averaged", lambda rows, train, parts: seen.append((rows.count(), parts)))
    monkeypatch.setattr(lm, "SHARD_WORDS", 30)  # as on a large corpus
    fit(frame(["a b c"] * 100))
    assert seen == [(100, 10)]


def test_words_of_a_batch_are_those_of_each_text():
    texts = ["", None, " \t\n\x0b\x0c\r", "A a  B\x00b\x1cc\n", " É é x", " end ", "ÀB ab Ab"]
    for column in (pa.array(texts), pa.array(["x", *texts, "y"]).slice(1, len(texts)), pa.array([], pa.string())):
        words, sizes = lm.split_words(column)
        each = [words_of(t) for t in column.to_pylist()]
        assert words.to_pylist() == [w for x in each for w in x] and sizes.tolist() == [len(x) for x in each]
        s = Slots({b"b": 1, b"a": 0, b"end": 7})
        assert [c.tolist() for c in s.split(column)] == [s.codes(x).tolist() for x in each]


def test_a_step_is_few_products_of_many_classes(monkeypatch):
    calls, matmul = [], np.matmul
    monkeypatch.setattr(np, "matmul", lambda *a, **k: calls.append(1) or matmul(*a, **k))
    rng = np.random.default_rng(2)
    for ids in (rng.integers(0, SLOTS, 512), np.full(512, 70), np.array([64, 64, 128, 5])):
        n, m = net(), net()
        tokens, at = padded([ids.astype(np.int32)])
        del calls[:]
        n.step(tokens, at, 0.01)
        assert len(calls) < 20  # one a class and direction before: over 100
        for c in set(ids % CLASSES):
            own = at[tokens[at] % CLASSES == c]
            h = np.tanh(m.bias + sum(m.context[j, tokens[own + off]] for j, off in enumerate([-2, -1, 1, 2])).astype(float))
            z = np.exp(h @ m.words[c] + m.word_bias[c])
            z /= z.sum(axis=1, keepdims=True)
            z[np.arange(len(own)), tokens[own] // CLASSES] -= 1
            assert np.allclose(n.words[c], m.words[c] - 0.01 / max(len(own), 8) * (h.T @ z), atol=1e-6)
        untouched = sorted(set(range(CLASSES)) - set((ids % CLASSES).tolist()))
        assert np.array_equal(n.word_layer[untouched], m.word_layer[untouched])


def test_counts_of_words_over_several_batches(frame, monkeypatch):
    monkeypatch.setattr(lm, "COUNTED_WORDS", 5)
    df = frame([f"A b{i} b{i} c{i % 7}" for i in range(60)] + [None, ""]).repartition(2)
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 4)
    try:
        v = lm.vocabulary(df, "text")
    finally:
        df.sparkSession.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert v.words == 240 and {w: int(v.counts[i]) for w, i in v.slots.items()} == {b"a": 60, **{b"b%d" % i: 2 for i in range(60)}, **{b"c%d" % i: 9 if i < 4 else 8 for i in range(7)}}


def test_texts_become_slots_once(frame, monkeypatch):
    """Training and scoring share the coded texts: two bytes a token, whatever the words are."""
    df = frame(["a b c a", None, " ", "long" * 50 + " b"])
    vocab = lm.vocabulary(df, "text")
    rows = {r.id: r for r in lm.coded(df, vocab).collect()}
    assert [(len(rows[i].slots), rows[i].n_tokens, rows[i].h) for i in sorted(rows)] == [(8, 4, []), (0, 0, []), (0, 0, []), (4, 2, [])]
    calls, coded = [], lm.coded
    monkeypatch.setattr(lm, "coded", lambda *a: calls.append(1) or coded(*a))
    found = {tuple(r) for r in lm.fit_and_score(df).collect()}
    assert len(calls) == 1 and found == {tuple(r) for r in score(df, *fit(df)).collect()}


def test_known_counts_are_those_of_the_join(frame, monkeypatch):
    monkeypatch.setattr(lm, "RARE", SLOTS - 2)
    df = frame([" ".join(f"w{j}" for j in range(40) if i % (j + 1) == 0) for i in range(60)])
    scores = []
    for known in (0, 5, 1000):
        monkeypatch.setattr(lm, "KNOWN", known)
        vocab = lm.vocabulary(df, "text")
        assert len(vocab.known[0]) == min(known, vocab.rare.count())
        scores.append([r.pseudo_log_likelihood for r in score(df, vocab, net()).orderBy("doc_id").collect()])
    assert np.allclose(scores[0], scores[1]) and np.allclose(scores[0], scores[2])


def test_steps_laid_out_together_are_the_same_steps(monkeypatch):
    rng = np.random.default_rng(5)
    tokens, at = padded([rng.integers(0, 300, 700).astype(np.int32)])
    rng.shuffle(at)
    one, other = net(), net()
    one.train(tokens, at, 0.5, 64)
    for lo in range(0, len(at), 64):
        other.step(tokens, at[lo : lo + 64], 0.5)
    assert np.array_equal(one.flat(), other.flat())
