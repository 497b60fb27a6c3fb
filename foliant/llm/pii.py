"""Personal data by weak supervision.

Base patterns give spans of four kinds that always stay.  Looser patterns give further candidates of the same kinds.
On every candidate (base ones too) labelers vote: the strict pattern, number checks, a gazetteer of domain endings,
calling codes and card issuers, context words before the span, and what touches its edges.  Votes are counted by pattern
over all documents; expectation-maximisation on these counts estimates each labeler's reliability, kind by kind, and the
chance that a candidate is personal data.  A logistic span classifier is fitted to those chances.  It doesn't see the
votes but the span and its surroundings: length, digits, separators, shape, neighbouring characters and words.  A looser
candidate becomes a span where the classifier is confident (``ACCEPT``) and it overlaps no base span.

Texts are read once; what is shuffled is one row per vote pattern and task, and the driver sees vote patterns (their
number is fixed by the labelers) and at most about ``SAMPLE`` candidates of each kind and pattern type for the classifier.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import settle, spread, trimmed, unit_hash

KINDS = ("email", "ip", "card", "phone")
ACCEPT = 0.9
CONTEXT = 40
#: Candidates of each kind, strict and loose apart, that the span classifier is fitted on, drawn by a hash; hashed features.
SAMPLE, FEATURES = 10_000, 1 << 13

_LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]+")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_ANY_DIGIT = re.compile(r"[0-9]")

# looser forms, each with a bounded number of steps from any start
_LOOSE_EMAIL = re.compile(r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64} ?(?:\[at\]|\(at\)|\{at\}) ?[A-Za-z0-9-]{1,63}(?: ?(?:\.|\[dot\]|\(dot\)|\{dot\}) ?[A-Za-z0-9-]{1,63}){1,8}", re.IGNORECASE)
_LOOSE_PHONE = re.compile(r"(?<![0-9+.-])(?:00[1-9][0-9]{0,2}[ -])?\(?[0-9]{2,4}\)?[ -][0-9]{3,4}[ -][0-9]{3,5}(?![0-9]|[.-][0-9])")
_LOOSE_CARD = re.compile(r"(?<![0-9.])[0-9]{4}(?:[./_][0-9]{4}){3}(?![0-9.])")

_WORDS = {
    "email": ("mail", "e-mail", "contact", "write to", "reach", "correo", "courriel"),
    "ip": ("ip", "host", "server", "address", "client", "login"),
    "card": ("card", "visa", "mastercard", "amex", "credit", "karte", "tarjeta", "carte"),
    "phone": ("phone", "call", "tel", "mobile", "cell", "fax", "whatsapp", "telefon", "anruf", "móvil", "appel"),
}
_AGAINST = ("version", "page", "isbn", "issn", "figure", "section", "chapter", "build", "id ", "no.", "price", "total", "doi")
#: Generic domain endings, and country codes in wide use.
_ENDINGS = frozenset("com org net edu gov mil int info biz name pro io co app dev eu uk us ca mx br ar cl pe de at ch fr be nl lu it es pt ie dk se no fi is pl cz sk hu ro bg gr tr ru ua rs hr si ee lv lt il za eg ma ng ke in pk bd lk cn hk tw jp kr sg my th vn ph id au nz".split())
#: Calling codes of one and two digits; all others have three digits and begin with one of the zones below.
_CALLING = frozenset("1 7 20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98".split())
_ZONES = frozenset("2 3 4 5 6 8 9".split())
#: Card issuers: lowest and highest first digits, and lengths.
_ISSUERS = (("4", "4", (13, 16, 19)), ("51", "55", (16,)), ("2221", "2720", (16,)), ("34", "34", (15,)), ("37", "37", (15,)), ("300", "305", (14,)), ("36", "36", (14,)), ("38", "39", (14, 16)), ("3528", "3589", (16,)), ("6011", "6011", (16, 19)), ("644", "659", (16, 19)), ("50", "50", (12, 13, 14, 15, 16, 17, 18, 19)), ("56", "58", (12, 13, 14, 15, 16, 17, 18, 19)), ("62", "62", (16, 17, 18, 19)))

#: Labelers, in the order of a vote pattern: strict pattern, checks, gazetteer, context, edges.
LABELERS = 5


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def _small(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) <= 3 and int(part or "0") <= 255


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches of local part, @, domain: at every @ the local run is read backwards, so no run is read twice."""
    low, at = 0, text.find("@")
    while at >= 0:
        begin = low + len(text[low:at].rstrip(_LOCAL))
        m = _DOMAIN.match(text, at + 1) if begin < at else None
        if m:
            yield begin, m.end()
        low = m.end() if m else at + 1
        at = text.find("@", low)


def base_spans(text: str | None) -> list[tuple[int, int, int]]:
    """(start, kind number, end) in code points, by start and then kind; null counts as empty."""
    if not text:
        return []
    out = [(b, 0, e) for b, e in _emails(text)]
    if _ANY_DIGIT.search(text):
        if text.count(".") >= 3:
            out += [(m.start(), 1, m.end()) for m in _IP.finditer(text) if all(map(_small, m[0].split(".")))]
        for m in _CARD.finditer(text):
            if m.end() - m.start() >= 12 and 12 <= len(d := _digits(m[0])) <= 19 and luhn(d):
                out.append((m.start(), 2, m.end()))
        if "+" in text:
            out += [(m.start(), 3, m.end()) for m in _PHONE.finditer(text) if 9 <= len(_digits(m[0])) <= 15]
    return sorted(out)


def loose_spans(text: str | None, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Further candidates that overlap no base span and not each other (the leftmost, then longest, stays)."""
    if not text:
        return []
    found = []
    if "at" in text.lower() and ("[" in text or "(" in text or "{" in text):
        found += [(m.start(), 0, m.end()) for m in _LOOSE_EMAIL.finditer(text)]
    if _ANY_DIGIT.search(text):
        found += [(m.start(), 2, m.end()) for m in _LOOSE_CARD.finditer(text)]
        found += [(m.start(), 3, m.end()) for m in _LOOSE_PHONE.finditer(text) if 9 <= len(_digits(m[0])) <= 15]
    out, end = [], -1
    taken, at, covered = sorted((b, e) for b, _, e in base), 0, -1  # covered: how far the base spans that begin before a candidate reach
    for b, k, e in sorted(found, key=lambda s: (s[0], -s[2], s[1])):
        while at < len(taken) and taken[at][0] <= b:
            covered = max(covered, taken[at][1])
            at += 1
        if b >= end and covered <= b and (at == len(taken) or taken[at][0] >= e):
            out.append((b, k, e))
            end = e
    return out


def _listed(kind: str, s: str, digits: str) -> int:
    """The gazetteer's vote."""
    if kind == "email":
        return 1 if re.split(r"[^A-Za-z]+", s)[-1].lower() in _ENDINGS else -1
    if kind == "card":
        return 1 if any(lo <= digits[: len(lo)] <= hi and len(digits) in n for lo, hi, n in _ISSUERS) else -1
    if kind == "phone":
        if not s.startswith(("+", "00")):
            return 1 if len(digits) in (10, 11) else 0
        code = digits.lstrip("0")
        return 1 if code[:1] in _CALLING or code[:2] in _CALLING or (code[:1] in _ZONES and len(code) > 9) else -1
    first = int(s.split(".")[0].lstrip("0")[:3] or 0)
    return -1 if first in (0, 127) or first >= 224 else 0 if s.startswith(("10.", "192.168.", "169.254.")) else 1


def votes(text: str, span: tuple[int, int, int], strict: bool) -> tuple[int, ...]:
    """One vote in {-1, 0, 1} from each labeler."""
    b, k, e = span
    kind, s, digits = KINDS[k], text[b:e], _digits(text[b:e])
    check = {"email": 0, "ip": 1 if not s.startswith("0.") else -1, "card": 1 if luhn(digits) else -1, "phone": 1 if len(set(digits)) > 2 else -1}[kind]
    before = text[max(0, b - CONTEXT) : b].lower()
    context = 1 if any(w in before for w in _WORDS[kind]) else -1 if any(w in before for w in _AGAINST) else 0
    left, right = text[b - 1 : b], text[e : e + 1]
    edges = -1 if left.isalnum() or right.isalnum() else 1
    return (1 if strict else 0, check, _listed(kind, s, digits), context, edges)


def span_features(text: str, span: tuple[int, int, int]) -> list[int]:
    """Hashed features of a candidate: the span itself, the characters at its edges, the words around it."""
    b, k, e = span
    s = text[b:e]
    digits = sum("0" <= c <= "9" for c in s)
    shape = re.sub(r"(.)\1+", r"\1", re.sub(r"[A-Za-z]", "a", re.sub(r"[0-9]", "9", s)))[:24]
    side = lambda c: "." if not c else "d" if c.isdigit() else "a" if c.isalpha() else "_" if c.isspace() else c
    before = re.findall(r"\w+", text[max(0, b - CONTEXT) : b].lower())[-2:]
    after = re.findall(r"\w+", text[e : e + CONTEXT].lower())[:1]
    named = [f"n{min(e - b, 40)}", f"d{min(digits, 24)}", f"c{''.join(sorted({c for c in s if not c.isalnum()}))}", f"s{shape}", f"f{s[:1] if digits else ''}", f"l{side(text[b - 1 : b])}", f"r{side(text[e : e + 1])}", *(f"b{w}" for w in before), *(f"a{w}" for w in after)]
    return [zlib.crc32(f"{k}".encode()) % FEATURES, *(zlib.crc32(f"{k}:{x}".encode("utf-8", "surrogatepass")) % FEATURES for x in named)]


def fit_labelers(patterns: np.ndarray, counts: np.ndarray, rounds: int = 50) -> tuple[np.ndarray, np.ndarray]:
    """Expectation-maximisation, kind by kind, for labelers that err independently given the truth.

    ``patterns`` has kind and votes; returns the chance of each pattern to be personal data, and by kind each labeler's
    reliability (how often a vote that isn't an abstention is right; without votes, what is held beforehand).
    """
    chance, right = np.zeros(len(patterns)), np.full((len(KINDS), LABELERS), 0.8)
    for k in np.unique(patterns[:, 0]):
        own = patterns[:, 0] == k
        v, n = patterns[own, 1:], counts[own]
        p = np.clip(0.5 + 0.2 * v.sum(axis=1) / LABELERS, 0.05, 0.95)
        for _ in range(rounds):
            prior = np.clip((n * p).sum() / n.sum(), 0.02, 0.98)
            log = np.full(len(v), np.log(prior / (1 - prior)))
            for j in range(LABELERS):
                yes, no = v[:, j] > 0, v[:, j] < 0
                good = (n * (p * yes + (1 - p) * no)).sum() + 8.0  # a labeler is held to be better than chance beforehand
                right[k, j] = good / ((n * (yes | no)).sum() + 10.0)
                r = np.clip(right[k, j], 0.05, 0.99)
                log += np.where(yes, np.log(r / (1 - r)), np.where(no, -np.log(r / (1 - r)), 0))
            p = 1 / (1 + np.exp(-log))
        chance[own] = p
    return chance, right


def fit_classifier(rows: list[list[int]], chance: np.ndarray, ridge: float = 0.02, rounds: int = 200) -> np.ndarray:
    """Logistic regression of the estimated chances on hashed features, by steps that never raise the loss."""
    w = np.zeros(FEATURES)
    if not rows:
        return w
    size = np.array([len(x) for x in rows])
    row, at = np.repeat(np.arange(len(rows)), size), np.concatenate([np.asarray(x, np.int64) for x in rows])
    curve = np.bincount(at, 0.25 * size[row], FEATURES) + ridge
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.bincount(row, w[at], len(rows))))
        w += (np.bincount(at, (chance - p)[row], FEATURES) - ridge * w) / curve
    return w


def pattern_number(kind: int, vote: tuple[int, ...]) -> int:
    n = kind
    for x in vote:
        n = n * 3 + x + 1
    return n


def pattern_of(n: int) -> list[int]:
    out = []
    for _ in range(LABELERS):
        n, x = divmod(n, 3)
        out.append(x - 1)
    return [n, *out[::-1]]


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document row: (id, n_email, n_ip, n_card, n_phone, base_sha256, spans, spans_added, n_spans).

    The counts and the digest are of base spans; ``spans`` lists base and added ones as ``kind:start:end``, and
    ``n_spans`` counts both.  A null text is empty, very long texts are read whole.  Of candidates that overlap the leftmost
    stays, of those the longest.  Rows that repeat are answered row by row, an empty table gives no rows, other columns are
    ignored.
    """
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            base, loose, seen = [], [], []
            for t in batch.column(1):
                text = t.as_py()
                b = base_spans(text)
                x = loose_spans(text, b)
                base.append([v for s in b for v in s])
                loose.append([v for s in x for v in s])
                seen.append([{"p": pattern_number(s[1], votes(text, s, strict)), "strict": strict, "f": span_features(text, s)} for own, strict in ((b, True), (x, False)) for s in own])
            spans = (pa.array(x, pa.list_(pa.int32())) for x in (base, loose))
            yield pa.RecordBatch.from_arrays([batch.column(0), *spans, pa.array(seen, pa.list_(pa.struct([("p", pa.int32()), ("strict", pa.bool_()), ("f", pa.list_(pa.int32()))])))], names=["id", "base", "loose", "seen"])

    rows = spread(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")))
    found = settle(rows.mapInArrow(trimmed(run), f"id {kind}, base array<int>, loose array<int>, seen array<struct<p:int,strict:boolean,f:array<int>>>"), "pii-candidates")
    each = found.select("id", F.posexplode("seen").alias("nth", "c")).select("id", "nth", "c.*")
    counted = each.groupBy("p", "strict").count().collect()  # at most 2 * 4 * 3^LABELERS rows
    weights = np.zeros(FEATURES)
    if counted:
        numbers = np.array(sorted({r["p"] for r in counted}))
        of = {int(n): i for i, n in enumerate(numbers)}
        counts, per_kind = np.zeros(len(numbers)), {}
        for r in counted:
            counts[of[r["p"]]] += r["count"]
            own = (int(r["p"]) // 3**LABELERS, r["strict"])
            per_kind[own] = per_kind.get(own, 0) + r["count"]
        chance, _ = fit_labelers(np.array([pattern_of(int(n)) for n in numbers]), counts)
        share = F.coalesce(*[F.when((F.col("kind") == k) & (F.col("strict") == s), F.lit(min(1.0, SAMPLE / n))) for (k, s), n in sorted(per_kind.items())])
        drawn = each.withColumn("kind", F.floor(F.col("p") / 3**LABELERS)).where(unit_hash(71, F.col("id").cast("string"), F.col("nth")) < share)
        sample = drawn.select("p", "f").orderBy("p", "f").collect()  # at most about 2 * 4 * SAMPLE rows
        weights = fit_classifier([r["f"] for r in sample], np.array([chance[of[r["p"]]] for r in sample]))

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name = lambda s: f"{KINDS[s[1]]}:{s[0]}:{s[2]}"
        sure = np.log(ACCEPT / (1 - ACCEPT))
        for batch in batches:
            n, sha, spans, more, every = [[], [], [], []], [], [], [], []
            for flat, loose, seen in zip(*(batch.column(c).to_pylist() for c in (1, 2, 3)), strict=True):
                b = [tuple(flat[i : i + 3]) for i in range(0, len(flat), 3)]
                other = [tuple(loose[i : i + 3]) for i in range(0, len(loose), 3)]
                x = [s for s, c in zip(other, seen[len(b) :], strict=True) if weights[c["f"]].sum() >= sure]
                for k in range(4):
                    n[k].append(sum(s[1] == k for s in b))
                sha.append(hashlib.sha256(",".join(map(name, b)).encode()).hexdigest())
                spans.append(",".join(map(name, sorted(b + x))))
                more.append(len(x))
                every.append(len(b) + len(x))
            cols = [batch.column(0), *(pa.array(c, pa.int64()) for c in n), pa.array(sha, pa.string()), pa.array(spans, pa.string()), pa.array(more, pa.int64()), pa.array(every, pa.int64())]
            yield pa.RecordBatch.from_arrays(cols, names=["id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans", "spans_added", "n_spans"])

    counts_schema = ", ".join(f"n_{k} long" for k in KINDS)
    return found.select("id", "base", "loose", "seen").mapInArrow(trimmed(finish), f"id {kind}, {counts_schema}, base_sha256 string, spans string, spans_added long, n_spans long").withColumnRenamed("id", id_col)
