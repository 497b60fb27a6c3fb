import hashlib
import random
import re
import time

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from foliant.llm.pii import KINDS, LABELERS, base_spans, find_pii, fit_classifier, fit_labelers, loose_spans, luhn, pattern_number, pattern_of

RULES = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def plain(text):
    out = []
    for k, (kind, rule) in enumerate(RULES.items()):
        for m in re.finditer(rule, text or ""):
            digits = re.sub(r"[^0-9]", "", m[0])
            ok = {"email": True, "ip": kind == "ip" and all(int(x) <= 255 for x in m[0].split(".")), "card": 12 <= len(digits) <= 19 and luhn(digits), "phone": 9 <= len(digits) <= 15}[kind]
            if ok:
                out.append((m.start(), k, m.end()))
    return sorted(out)


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from(["a", "b.", "@", "x@y.z", "@@", ".", "1", "25", "256", "1.2.3.4", "+1", "(743)", " ", "-", "555-3824", "4111 1111 1111 1111", "4111111111111111", "_", "%", "é", "\n", "00", "Z"]), max_size=14))
def test_base_spans_are_the_patterns(parts):
    text = "".join(parts)
    assert base_spans(text) == plain(text)


def test_long_runs_take_linear_time():
    for text in ("a" * 200_000, "1" * 200_000, "@" * 200_000, "+" * 100_000 + "1 " * 100_000, "1." * 100_000, "a@" * 100_000):
        base_spans(text)
        loose_spans(text, [])
    assert base_spans("1" * 5000 + ".1.1.1") == []


def test_table(frame, empty):
    docs = [(1, "mail jo@x.org or call +1 (743) 555-3824; 8.8.8.8 card 4111 1111 1111 1111", "en", "s"), (2, None, "en", "s"), (3, "é jo.doe [at] mail [dot] com", "en", "s"), (4, "call (743) 555-3824 now", "en", "s"), (5, "clean text, 12 of 3.4", "en", "s")]
    rows = {r.doc_id: r for r in find_pii(frame(docs + docs[:1])).collect()}
    assert find_pii(frame(docs + docs[:1])).count() == 6 and find_pii(empty).collect() == []
    for d in docs:
        base = plain(d[1])
        names = [f"{KINDS[k]}:{b}:{e}" for b, k, e in base]
        r = rows[d[0]]
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(s[1] == k for s in base) for k in range(4)]
        assert r.base_sha256 == hashlib.sha256(",".join(names).encode()).hexdigest()
        assert set(names) <= set(r.spans.split(",")) | ({""} if not names else set())
    assert rows[3].spans == "email:2:28" and rows[5].spans == "" and rows[2].spans == ""


def test_reliabilities_are_recovered():
    rng = np.random.default_rng(3)
    truth = rng.random(20_000) < 0.4
    rates = [0.95, 0.9, 0.8, 0.7, 0.6]
    v = np.stack([np.where(rng.random(len(truth)) < r, truth, ~truth) * 2 - 1 for r in rates], axis=1)
    patterns, counts = np.unique(np.concatenate([np.zeros((len(v), 1), int), v], axis=1), axis=0, return_counts=True)
    chance, right = fit_labelers(patterns, counts.astype(float), 200)
    assert np.abs(right[0] - rates).max() < 0.05
    assert all(pattern_of(pattern_number(k, tuple(p))) == [k, *p] for k in range(4) for p in ([0] * LABELERS, [1, -1, 0, 1, -1]))
    assert (chance >= 0).all() and (chance <= 1).all()


def test_reliabilities_differ_by_kind():
    good = np.array([[0, 1, 1, 1, 1, 1], [0, -1, -1, -1, -1, -1]])
    odd = np.array([[2, 1, -1, 1, 1, 1], [2, -1, 1, -1, -1, -1]])  # here the second labeler is always wrong
    _, right = fit_labelers(np.concatenate([good, odd]), np.full(4, 500.0))
    assert right[0, 1] > 0.95 and right[2, 1] < 0.1


def luhn_number(rng):
    d = "4" + "".join(rng.choices("0123456789", k=14))
    return next(d + c for c in "0123456789" if luhn(d + c))


def test_added_spans_against_planted_ones(frame):
    rng = random.Random(8)
    docs, want, decoys = [], {}, set()
    for i in range(600):
        kind = i % 6
        name, number = "".join(rng.choices("abcdefgh", k=6)), luhn_number(rng)
        if kind == 0:
            head, span, tail = "Please contact me by mail ", f"{name} [at] {name[::-1]} [dot] com", " soon"
        elif kind == 1:
            head, span, tail = "my visa card ", ".".join(number[j : j + 4] for j in range(0, 16, 4)), " expires"
        elif kind == 2:
            head, span, tail = "call me on phone ", f"({rng.randint(200, 999)}) {rng.randint(200, 999)} {rng.randint(1000, 9999)}", " tonight"
        elif kind == 3:
            head, span, tail = f"see version {name} page ", "{}.{}.{}.{}".format(*(str(rng.randint(1000, 9999)) for _ in range(4))), "x part"  # a bad number, in bad company
        elif kind == 4:
            head, span, tail = "write to ", f"{name}@{name}.org", " please"
        else:
            head, span, tail = f"we met {name} (at) noon, figure ", "12", " shows it"
        docs.append((i, head + span + tail, "en", "s"))
        if kind in (0, 1, 2):
            want[i] = f"{KINDS[(0, 2, 3)[kind]]}:{len(head)}:{len(head) + len(span)}"
        elif kind == 3:
            decoys.add(i)
    rows = {r.doc_id: r for r in find_pii(frame(docs)).collect()}
    found = [i for i, s in want.items() if rows[i].spans == s and rows[i].spans_added == 1 == rows[i].n_spans]
    assert len(found) >= 0.95 * len(want)
    assert sum(rows[i].spans_added for i in decoys) <= 0.05 * len(decoys)
    assert all(rows[i].n_email == 1 and rows[i].n_spans == 1 for i in range(4, 600, 6))


def test_the_classifier_fits_its_targets():
    rows, chance = [[1, 2], [1, 3], [1, 2, 4], [1]] * 50, np.array([0.95, 0.1, 0.9, 0.5] * 50)
    w = fit_classifier(rows, chance, rounds=3000)
    p = 1 / (1 + np.exp(-np.array([w[r].sum() for r in rows])))
    assert np.abs(p - chance).max() < 0.05


def test_loose_spans_against_every_pair_and_in_one_walk():
    rng = random.Random(8)
    pieces = ["+49 170 1234567 ", "030 1234 5678 ", "4111 1111 1111 1111 ", "4111.1111.1111.1111 ", "a@b.co ", "a [at] b.co ", "10.2.3.4 ", "x ", "7"]
    for _ in range(300):
        text = "".join(rng.choice(pieces) for _ in range(12))
        base = base_spans(text)
        free = loose_spans(text, [])
        want, end = [], -1
        for b, k, e in sorted(set(loose_spans(text, base)) | set(free), key=lambda s: (s[0], -s[2], s[1])):
            if b >= end and not any(tb < e and b < te for tb, _, te in base):
                want.append((b, k, e))
                end = e
        assert loose_spans(text, base) == want
    text = "+49 170 1234567, 030 1234 5678; " * 100_000
    began = time.process_time()
    base = base_spans(text)
    assert len(base) == 100_000 and len(loose_spans(text, base)) == 100_000
    assert time.process_time() - began < 20  # 200,000 spans in one text; a pairwise look takes hours
