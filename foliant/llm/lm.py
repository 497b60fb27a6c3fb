"""Masked pseudo-likelihood scoring by a small bidirectional window network.

Every token is predicted from the ``WINDOW`` tokens on either side, itself masked: position tables of the context
tokens are summed into one hidden layer, and a two-level softmax (class, then word in class) gives the token's
conditional probability.  A document's score is the sum of these log-probabilities over all of its tokens.

The vocabulary comes from word counts over all documents.  The most frequent words have slots of their own in the
network; the others share hashed slots, and a slot's probability is split among its words by their counts, so every
word has a probability of its own.  Tasks hold a fixed number of these counts; the others stay a distributed table, and
a document's words meet them in a join.  Texts are turned into slots once, for training and scoring.  Training is data-parallel: documents are dealt to shards by a hash of id and text, their number
set by the number of words, so neither cores nor input partitions change the weights; each shard runs stochastic gradient
steps over all of its documents in hash order, and the weights are averaged over shards by token count, in a tree, for
``ROUNDS`` rounds.  Driver and tasks hold one model of fixed size, however large the corpus is.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import settle, spread, trimmed

CLASSES, PER_CLASS = 64, 64
SLOTS = CLASSES * PER_CLASS
#: Slots for words beyond the vocabulary, by hash; a power of two.
RARE = 256
WINDOW, HIDDEN = 2, 32
#: Rounds of averaging; tokens of a step and its rate, the best of a grid by held-out likelihood (README).
ROUNDS, STEP_TOKENS, RATE = 1, 512, 0.5
#: Tokens scored side by side, and steps laid out at once: what a processor's cache holds.
CHUNK, PLANNED = 1 << 12, 64
BLOCKS, FAN_IN = 16, 64
#: Words of one training shard; beyond MOST_SHARDS shards they grow instead.
SHARD_WORDS, MOST_SHARDS = 2_000_000, 16_384
#: Words counted in a task before they are passed on.
COUNTED_WORDS = 500_000
#: Shared-slot words, the most frequent ones, whose counts tasks hold; the others meet theirs in a join.
KNOWN = 1 << 18
#: Tokens scored at once, so that one batch of very long texts needs no more memory than a short one.
SCORED_TOKENS = 1 << 18
PAD = SLOTS

_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def words_of(text: str | None) -> list[bytes]:
    """Words between the six ASCII blanks, A-Z lower-cased."""
    return text.encode("utf-8", "surrogatepass").translate(_LOWER).split() if text else []


def flat_words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The words of all texts one after another, as ``words_of`` takes them, and their number by text."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(texts.fill_null("")))
    flat, ends = lists.flatten(), lists.offsets.to_numpy() - lists.offsets[0].as_py()
    held = pc.not_equal(pc.binary_length(flat), 0)
    before = np.concatenate([[0], np.cumsum(held.to_numpy(zero_copy_only=False))])
    return flat.filter(held).cast(pa.binary()), np.diff(before[ends])


def split_words(texts: pa.Array) -> tuple[pa.DictionaryArray, np.ndarray]:
    """``flat_words``, each different word held once."""
    words, sizes = flat_words(texts)
    return words.dictionary_encode(), sizes


class Slots(dict):
    """Word -> code: the slot of a vocabulary word, and of any other its XXH64 with seed 42, as Spark's.

    Words beyond the vocabulary share the last RARE slots by that hash; ``totals`` holds the occurrences in each of those.
    """

    totals = np.zeros(RARE)

    def __missing__(self, word: bytes) -> int:
        h = xxhash.xxh64_intdigest(word, 42)
        return h if h >= SLOTS else h + SLOTS

    def codes(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))

    def codes_of(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Codes of all words one after another, and their number by text; a word beyond the vocabulary is hashed once, however often it occurs."""
        words, sizes = flat_words(texts)
        known = pc.index_in(words, value_set=pa.array(list(self), pa.binary()))
        codes = np.append(np.fromiter(self.values(), np.uint64, len(self)), np.uint64(0))[known.fill_null(len(self)).to_numpy()]
        if known.null_count:
            others = words.filter(known.is_null()).dictionary_encode()
            hashes = np.fromiter((xxhash.xxh64_intdigest(w, 42) for w in others.dictionary.to_numpy(zero_copy_only=False).tolist()), np.uint64, len(others.dictionary))
            hashes[hashes < SLOTS] += np.uint64(SLOTS)
            codes[known.is_null().to_numpy(zero_copy_only=False)] = hashes[others.indices.to_numpy()]
        return codes, sizes

    def split(self, texts: pa.Array) -> list[np.ndarray]:
        """Codes of each text's words."""
        codes, sizes = self.codes_of(texts)
        return np.split(codes, np.cumsum(sizes)[:-1]) if len(sizes) else []

    def log_once(self, slot: np.ndarray) -> np.ndarray:
        """Log of the share in a shared slot of a word seen once or never; a slot has 1 more for words never seen."""
        return -np.log(self.totals[slot - (SLOTS - RARE)] + 1)


def slots_of(codes: np.ndarray) -> np.ndarray:
    return np.where(codes < SLOTS, codes, SLOTS - RARE + (codes & np.uint64(RARE - 1))).astype(np.int32)


@dataclass
class Vocabulary:
    """Slots, occurrences by slot, occurrences of all words, and the shared-slot words that occur more than once.

    ``rare`` has (h, n): the word's XXH64 with seed 42, as Spark's, and its occurrences; ``known`` the KNOWN most frequent
    of them, as h in order and the logarithm of n.
    """

    slots: Slots
    counts: np.ndarray
    words: int
    rare: DataFrame | None = None
    known: tuple[np.ndarray, np.ndarray] = (np.empty(0, np.uint64), np.empty(0))


@dataclass
class Network:
    """Weights as float32: context tables by position, hidden bias, class layer and word layer, each with its bias at the end of its inputs."""

    context: np.ndarray  # 2 * WINDOW, SLOTS + 1, HIDDEN
    bias: np.ndarray
    class_layer: np.ndarray  # HIDDEN + 1, CLASSES
    word_layer: np.ndarray  # CLASSES, PER_CLASS, HIDDEN + 1

    @property
    def classes(self) -> np.ndarray:
        return self.class_layer[:HIDDEN]

    @property
    def class_bias(self) -> np.ndarray:
        return self.class_layer[HIDDEN]

    @property
    def words(self) -> np.ndarray:
        return self.word_layer[:, :, :HIDDEN].transpose(0, 2, 1)

    @property
    def word_bias(self) -> np.ndarray:
        return self.word_layer[:, :, HIDDEN]

    @classmethod
    def fresh(cls, counts: np.ndarray, seed: int = 7) -> Network:
        """Small random weights; output biases start from the unigram counts."""
        rng = np.random.default_rng(seed)
        small = lambda *s: (rng.standard_normal(s) * 0.1).astype(np.float32)
        c = (counts + 1.0).reshape(PER_CLASS, CLASSES).T  # slot = word * CLASSES + class
        context, classes, words = small(2 * WINDOW, SLOTS + 1, HIDDEN), small(HIDDEN, CLASSES), small(CLASSES, HIDDEN, PER_CLASS)
        word_bias = np.log(c / c.sum(1, keepdims=True)).astype(np.float32)
        class_bias = np.log(c.sum(1) / c.sum()).astype(np.float32)
        return cls(context, np.zeros(HIDDEN, np.float32), np.concatenate([classes, class_bias[None]]), np.ascontiguousarray(np.concatenate([words.transpose(0, 2, 1), word_bias[:, :, None]], axis=2)))

    def arrays(self) -> list[np.ndarray]:
        return [self.context, self.bias, self.class_layer, self.word_layer]

    def flat(self) -> np.ndarray:
        return np.concatenate([a.ravel() for a in self.arrays()])

    def filled(self, flat: np.ndarray) -> Network:
        out, at = [], 0
        for a in self.arrays():
            out.append(flat[at : at + a.size].reshape(a.shape).astype(np.float32))
            at += a.size
        return Network(*out)

    def hidden(self, around: np.ndarray) -> np.ndarray:
        """Hidden values of each place; ``around`` has a row of context rows a position."""
        h, *more = self.context.reshape(-1, HIDDEN).take(around, axis=0)
        for x in more:
            h += x
        h += self.bias
        # tanh(x) = 1 - 2 / (exp(2 x) + 1)
        h += h
        with np.errstate(over="ignore"):
            np.exp(h, out=h)
        h += 1
        np.divide(-2, h, out=h)
        h += 1
        return h

    def log_probs(self, tokens: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Conditional log-probability of each token at ``at``, from both sides."""
        order = np.argsort((tokens[at] % CLASSES).astype(np.uint8), kind="stable")
        out, room, wide = np.empty(len(at)), np.empty((CHUNK, PER_CLASS), np.float32), np.ones((CHUNK, HIDDEN + 1), np.float32)
        for lo in range(0, len(at), CHUNK):
            own = order[lo : lo + CHUNK]
            here = at[own]
            word, of = np.divmod(tokens[here], CLASSES)
            h, z, rows = wide[: len(own)], room[: len(own)], np.arange(len(own))
            h[:, :HIDDEN] = self.hidden(tokens[here + _OFFSETS] + _TABLES)
            first = _starts(of)
            spans = list(zip(of[first].tolist(), first.tolist(), [*first[1:].tolist(), len(of)], strict=True))
            found = _log_softmax(h @ self.class_layer, rows, of)
            for c, a, b in spans:
                np.matmul(h[a:b], self.word_layer[c].T, out=z[a:b])
            out[own] = found + _log_softmax(z, rows, word)
        return out

    def step(self, tokens: np.ndarray, at: np.ndarray, rate: float) -> None:
        """One gradient step on the mean negative log-probability of the tokens at ``at``."""
        self.train(tokens, at, rate, len(at))

    def train(self, tokens: np.ndarray, at: np.ndarray, rate: float, size: int) -> None:
        """Gradient steps over the tokens at ``at``, ``size`` of them at a time."""
        whole = len(at) // size * size if size else 0
        for lo in range(0, whole, size * PLANNED):
            for plan in _plans(tokens, at[lo : min(whole, lo + size * PLANNED)].reshape(-1, size)):
                self._step(plan, np.float32(rate))
        for plan in _plans(tokens, at[None, whole:]) if whole < len(at) else []:
            self._step(plan, np.float32(rate))

    def _step(self, plan: _Plan, rate: np.float32) -> None:
        n, place, most = np.float32(len(plan.place)), plan.place, plan.most
        h = self.hidden(plan.around)
        wide, ones = np.ones((len(h), HIDDEN + 1), np.float32), np.ones(len(h), np.float32)
        wide[:, :HIDDEN] = h
        p = _softmax(wide @ self.class_layer)
        p.reshape(-1)[plan.of] -= 1
        back, change = p @ self.classes.T, wide.T @ p
        x, z, of_words, total = (np.zeros((most, k), np.float32) for k in (HIDDEN + 1, PER_CLASS, HIDDEN, 1))
        x[place] = wide
        # by block: a class's weights, its tokens, their values a row a word, their results, and the sums of exponentials
        layers = self.word_layer.take(plan.ranked, axis=0)
        split = []
        for lo, hi, at, m in plan.blocks:
            r, k = slice(at, at + m * (hi - lo)), hi - lo
            split.append((layers[lo:hi], x[r].reshape(k, m, -1), z[r].reshape(k, -1, m), of_words[r].reshape(k, m, -1), total[r].reshape(k, 1, m)))
        for shifted in (False, True):
            for layer, near, own, _, _ in split:
                np.matmul(layer, near.transpose(0, 2, 1), out=own)
                if shifted:
                    own -= own.max(axis=1, keepdims=True)
            with np.errstate(over="ignore"):
                np.exp(z, out=z)
                for _, _, own, _, sums in split:
                    np.matmul(_ONES, own, out=sums)
            if _fit(total):
                break
        # differences of probabilities times each token's sum, by which its row of x and of the results is divided
        z.reshape(-1)[plan.word] -= total.take(place)
        np.divide(1, total, out=total)
        x *= total * (rate * plan.share)[:, None]
        for layer, near, own, out, _ in split:
            out[:] = (layer[:, :, :HIDDEN].transpose(0, 2, 1) @ own).transpose(0, 2, 1)
            layer -= own @ near
        self.word_layer[plan.ranked] = layers
        of_words *= total
        back += of_words.take(place, axis=0)
        change *= rate / n
        self.class_layer -= change
        h *= h
        np.subtract(1, h, out=h)
        back *= h
        self.bias -= rate / n * (ones @ back)
        back *= rate / np.float32(16)  # a context slot is hit by few of a step's tokens
        if not -0.1 < back.min() <= back.max() < 0.1:
            np.clip(back, -0.1, 0.1, out=back)
        self._take_from_contexts(plan.around.reshape(-1), back)

    def _take_from_contexts(self, row: np.ndarray, back: np.ndarray) -> None:
        """Each token's ``back`` off its context rows: one occurrence of a row as a whole, the others two values at a time, as complex numbers."""
        rows, nth = self.context.reshape(-1, HIDDEN), np.arange(len(row))
        _LAST[row] = nth
        one = _LAST.take(row) == nth
        own, rest = np.flatnonzero(one), np.flatnonzero(~one)
        to = row.take(own)
        near = rows.take(to, axis=0)
        near -= back.take(own % len(back), axis=0)
        rows[to] = near
        pairs = np.add.outer(row.take(rest) * (HIDDEN // 2), _PAIRS).reshape(-1)
        np.subtract.at(rows.reshape(-1).view(np.complex64), pairs, back.view(np.complex64).take(rest % len(back), axis=0).reshape(-1))


def _starts(x: np.ndarray) -> np.ndarray:
    """Where runs of equal values start."""
    change = np.empty(len(x), bool)
    change[:1] = True
    np.not_equal(x[1:], x[:-1], out=change[1:])
    return np.flatnonzero(change)


#: Offsets of context tokens, and the first row of each one's table.
_OFFSETS = np.array([*range(-WINDOW, 0), *range(1, WINDOW + 1)])[:, None]
_TABLES = (np.arange(2 * WINDOW) * (SLOTS + 1))[:, None]
_PAIRS = np.arange(HIDDEN // 2)
#: Classes by their number of tokens in a step, cut where blocks of equal height are filled to half at least, but for the smallest.
_CUTS = [0, *(1 << k for k in range(CLASSES.bit_length()))]
_ONES = np.ones((1, PER_CLASS), np.float32)
#: Room for one place of each context row.
_LAST = np.empty(2 * WINDOW * (SLOTS + 1), np.int64)


@dataclass
class _Plan:
    """Where the numbers of one step go; its tokens are in order of class."""

    around: np.ndarray  # rows of the context tables, a row a position
    of: np.ndarray  # the tokens' classes, in a flat table of tokens and classes
    ranked: np.ndarray  # classes from the most frequent on
    blocks: list[tuple[int, int, int, int]]  # classes (from, to) of equal room, their first place, places of each
    most: int  # places of all blocks
    place: np.ndarray  # of each token
    word: np.ndarray  # the tokens' words in class, in a flat table of blocks, classes, words and places
    share: np.ndarray  # 1 / tokens of the class, at least 8, by place


def _plans(tokens: np.ndarray, at: np.ndarray) -> Iterator[_Plan]:
    """A plan for each row of ``at``; many rows are laid out at once."""
    steps, n = at.shape
    each = np.arange(steps)[:, None]
    at = np.take_along_axis(at, np.argsort((tokens[at] % CLASSES).astype(np.uint8), axis=1, kind="stable"), axis=1)
    word, of = np.divmod(tokens[at].astype(np.int64), CLASSES)
    around = tokens[at[:, None] + _OFFSETS] + _TABLES

    sizes = np.bincount((of + each * CLASSES).ravel(), minlength=steps * CLASSES).reshape(steps, CLASSES)
    ranked = np.argsort(-sizes, axis=1, kind="stable")
    held, cuts = np.take_along_axis(sizes, ranked, axis=1), np.array(_CUTS)
    block = np.repeat(np.arange(len(cuts) - 1), np.diff(cuts))
    room = held[:, cuts[block]]
    first = np.cumsum(room, axis=1) - room
    share = (1 / np.maximum(held, 8)).astype(np.float32)
    nth = np.arange(n) - np.take_along_axis(np.cumsum(sizes, axis=1) - sizes, of, axis=1)
    rank = np.empty_like(ranked)
    np.put_along_axis(rank, ranked, np.arange(CLASSES)[None], axis=1)
    rank = np.take_along_axis(rank, of, axis=1)
    first_of, room_of = np.take_along_axis(first, rank, axis=1), np.take_along_axis(room, rank, axis=1)
    place, word, of = first_of + nth, first_of * PER_CLASS + word * room_of + nth, np.arange(n) * CLASSES + of
    for k in range(steps):
        blocks = [(lo, hi, int(first[k, lo]), int(room[k, lo])) for lo, hi in zip(_CUTS[:-1], _CUTS[1:], strict=True) if room[k, lo]]
        yield _Plan(around[k], of[k], ranked[k], blocks, int(room[k].sum()), place[k], word[k], np.repeat(share[k], room[k]))


def _fit(total: np.ndarray) -> bool:
    """Whether sums of exponentials are far from float32's limits."""
    return not total.size or bool(total.min() > 1e-20 and total.max() < 1e20)


def _exps(z: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """exp of ``z`` and its sums by row; where float32 can't hold them well, each row's largest value is taken off ``z`` before."""
    ones = np.ones(z.shape[1], np.float32)
    with np.errstate(over="ignore"):
        e = np.exp(z)
        total = e @ ones
    if not _fit(total):
        z -= z.max(axis=1, keepdims=True)
        np.exp(z, out=e)
        total = e @ ones
    return e, total


def _softmax(z: np.ndarray) -> np.ndarray:
    """Rows of ``z`` as probabilities; ``z`` may be shifted."""
    e, total = _exps(z)
    e *= (1 / total)[:, None]
    return e


def _log_softmax(z: np.ndarray, rows: np.ndarray, of: np.ndarray) -> np.ndarray:
    """Logarithm of one probability in each row; ``z`` may be shifted."""
    _, total = _exps(z)
    return z[rows, of].astype(np.float64) - np.log(total)


def padded(docs: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Documents' tokens in one array with padding between them, and where the tokens are."""
    return laid_out(np.concatenate([np.empty(0, np.int32), *docs]), np.array([len(d) for d in docs], np.int64))


def laid_out(ids: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``padded`` for documents that stand one after another, each of so many tokens; those without tokens take no room."""
    sizes = sizes[sizes > 0]
    at = np.arange(len(ids)) + np.repeat(np.arange(1, len(sizes) + 1) * WINDOW, sizes)
    tokens = np.full(len(ids) + (len(sizes) + 1) * WINDOW, PAD, np.int32)
    tokens[at] = ids
    return tokens, at


def vocabulary(docs: DataFrame, text_col: str) -> Vocabulary:
    """Slots by frequency over all documents, and the counts of all words."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = [pa.table({"word": pa.array([], pa.binary()), "n": pa.array([], pa.int64())})], 0

        def merged() -> pa.Table:
            return pa.concat_tables(held).group_by("word").aggregate([("n", "sum")]).select(["word", "n_sum"]).rename_columns(["word", "n"])

        for batch in batches:
            words, _ = split_words(batch.column(0))
            held.append(pa.table({"word": words.dictionary, "n": np.bincount(words.indices.to_numpy(), minlength=len(words.dictionary))}))
            rows += len(words.dictionary)
            if rows > 2 * COUNTED_WORDS:
                held = [merged()]
                rows = held[0].num_rows
            if rows > COUNTED_WORDS and len(held) == 1:
                yield from held[0].combine_chunks().to_batches()
                held, rows = [held[0].slice(0, 0)], 0
        yield from merged().combine_chunks().to_batches()

    counted = settle(spread(docs.select(text_col)).mapInArrow(trimmed(count), "word binary, n long").groupBy("word").agg(F.sum("n").alias("n")), "word-counts")
    total = counted.agg(F.sum("n")).first()[0] or 0
    best = counted.orderBy(F.desc("n"), "word").limit(SLOTS - RARE).collect()
    out = Vocabulary(Slots({bytes(r["word"]): i for i, r in enumerate(best)}), np.zeros(SLOTS), int(total))
    out.counts[: len(best)] = [r["n"] for r in best]
    if len(best) == SLOTS - RARE:
        n, word = best[-1]["n"], F.lit(bytearray(best[-1]["word"]))
        rare = counted.where((F.col("n") < n) | ((F.col("n") == n) & (F.col("word") > word)))
        out.slots.totals = np.zeros(RARE)
        for r in rare.groupBy(F.expr(f"cast(xxhash64(word) & {RARE - 1} as int)").alias("slot")).agg(F.sum("n").alias("n")).collect():
            out.slots.totals[r["slot"]] = r["n"]
        out.rare = rare.where("n > 1").select(F.xxhash64("word").alias("h"), "n")
        most = out.rare.orderBy(F.desc("n"), "h").limit(KNOWN).toArrow()
        h = most.column("h").to_numpy().view(np.uint64)
        order = np.argsort(h)
        out.known = h[order], np.log(most.column("n").to_numpy()[order])
        out.counts[SLOTS - RARE :] = out.slots.totals
    return out


def _averaged(rows: DataFrame, train, parts: int) -> tuple[np.ndarray, float] | None:
    """Mean of the shards' weights by token count, FAN_IN at a time."""

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("part")  # sums in one order, so that reruns agree
        mean = sum(np.frombuffer(x, np.float32).astype(np.float64) * (n / pdf["n"].sum()) for x, n in zip(pdf["mean"], pdf["n"], strict=True))
        return pd.DataFrame({"block": pdf["block"].iloc[:1], "part": pdf["slice"].iloc[:1], "n": [pdf["n"].sum()], "mean": [mean.astype(np.float32).tobytes()]})

    schema = "block int, part int, n double, mean binary"
    sums = settle(rows.mapInArrow(train, schema), "weights")
    while parts > 1:
        parts = -(-parts // FAN_IN)
        sums = sums.withColumn("slice", F.col("part") % parts).groupBy("block", "slice").applyInPandas(add, schema)
    found = sorted(sums.collect(), key=lambda r: r["block"])
    return np.concatenate([np.frombuffer(r["mean"], np.float32) for r in found]) if found else None


def coded(docs: DataFrame, vocab: Vocabulary, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every row with its text as slots of two bytes, and two hashes of id and text, by which rows are dealt to shards and ordered.

    ``more`` is the sum of the logarithms of its known shared-slot words' occurrences; ``h`` and ``times`` have the other ones.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast((Slots(vocab.slots), *vocab.known))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slots, known, log = shared.value
        for batch in batches:
            codes, sizes = slots.codes_of(batch.column(4))
            ends = np.append(0, np.cumsum(2 * sizes)).astype(np.int32)
            held = pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(ends), pa.py_buffer(slots_of(codes).astype("<u2"))])
            # texts' different words: a word's number among those of all texts, then one sort of both numbers
            rare = codes >= SLOTS
            words = pa.array(codes[rare]).dictionary_encode()
            each, times = np.unique(np.repeat(np.arange(len(sizes)), sizes)[rare] * len(words.dictionary) + words.indices.to_numpy(), return_counts=True)
            text, number = np.divmod(each, max(1, len(words.dictionary)))
            words = words.dictionary.to_numpy()
            at = np.minimum(np.searchsorted(known, words), max(0, len(known) - 1))
            found = known[at] == words if len(known) else np.zeros(len(words), bool)
            worth = np.where(found, log[at], 0) if len(known) else np.zeros(len(words))
            more = np.bincount(text, times * worth[number], len(sizes)).astype(float)
            left = ~found[number]
            lists = np.append(0, np.cumsum(np.bincount(text[left], minlength=len(sizes)))).astype(np.int32)
            h, times = (pa.ListArray.from_arrays(pa.array(lists), pa.array(x)) for x in (words[number[left]].view(np.int64), times[left]))
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(sizes, pa.int64()), held, pa.array(more), h, times], names=["key", "id", "mark", "turn", "n_tokens", "slots", "more", "h", "times"])

    text = F.col(text_col)
    rows = spread(docs.select(F.col(id_col).alias("id"), F.xxhash64(F.col(id_col).cast("string"), text).alias("mark"), F.xxhash64(text, F.lit(1)).alias("turn"), text.alias("text")))
    rows = rows.select(F.monotonically_increasing_id().alias("key"), "id", "mark", "turn", "text")
    return rows.mapInArrow(trimmed(run), f"key long, id {kind}, mark long, turn long, n_tokens long, slots binary, more double, h array<long>, times array<long>")


def _shards(rows: DataFrame, words: int) -> tuple[DataFrame, int]:
    """(shard, slots) in training order: shards by a hash of id and text, rows in hash order, whatever the partitions were."""
    n = max(1, min(MOST_SHARDS, -(-words // SHARD_WORDS)))
    rows = rows.where("n_tokens > 0").select(F.pmod("mark", F.lit(n)).cast("int").alias("shard"), "turn", "slots")
    return rows.repartitionById(n, F.col("shard")).sortWithinPartitions("shard", "turn").select("shard", "slots"), n


def _slots_in(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The slots of all rows one after another, and their number by row."""
    _, ends, held = column.buffers()
    ends = np.frombuffer(ends, np.int32)[column.offset : column.offset + len(column) + 1] // 2 if len(column) else np.zeros(1, np.int32)
    ids = np.frombuffer(held, "<u2")[ends[0] : ends[-1]] if held else np.empty(0)
    return ids.astype(np.int32), np.diff(ends).astype(np.int64)


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[Vocabulary, Network]:
    """Vocabulary and trained network.

    Rows of equal id and text train in one shard; the order of rows with equal texts makes no difference.
    """
    vocab = vocabulary(docs, text_col)
    return vocab, _trained(coded(docs, vocab, id_col, text_col), vocab)


def _trained(rows: DataFrame, vocab: Vocabulary) -> Network:
    """The network after training on ``coded`` rows."""
    net, spark = Network.fresh(vocab.counts), rows.sparkSession
    rows, shards = _shards(rows, vocab.words)
    for nth in range(ROUNDS if vocab.words else 0):
        shared = spark.sparkContext.broadcast(net)

        def train(batches: Iterator[pa.RecordBatch], shared=shared, rate=RATE / (1 + nth)) -> Iterator[pa.RecordBatch]:
            shard, own, seen = None, None, 0

            def weights() -> pa.RecordBatch:
                blocks = np.array_split(own.flat(), BLOCKS)
                return pa.RecordBatch.from_arrays([pa.array(range(BLOCKS), pa.int32()), pa.array([shard] * BLOCKS, pa.int32()), pa.array([float(seen)] * BLOCKS), pa.array([b.tobytes() for b in blocks], pa.binary())], names=["block", "part", "n", "mean"])

            for batch in batches:
                of = batch.column(0).to_numpy()
                cut = np.flatnonzero(np.r_[True, of[1:] != of[:-1], True]) if len(of) else [0]
                for lo, hi in zip(cut, cut[1:], strict=False):
                    if of[lo] != shard:
                        if seen:
                            yield weights()
                        shard, own, seen = int(of[lo]), shared.value.filled(shared.value.flat()), 0
                        rng = np.random.default_rng(shard)
                    tokens, at = laid_out(*_slots_in(batch.column(1).slice(lo, hi - lo)))
                    rng.shuffle(at)
                    own.train(tokens, at, rate, STEP_TOKENS)
                    seen += len(at)
            if seen:
                yield weights()

        mean = _averaged(rows, trimmed(train), shards)
        net = net if mean is None else net.filled(mean)
    return net


def _sums(ids: np.ndarray, sizes: np.ndarray, slots: Slots, net: Network) -> np.ndarray:
    """By document, the sum of its log-probabilities, shared-slot words counted as seen once."""
    log = net.log_probs(*laid_out(ids, sizes))
    rare = ids >= SLOTS - RARE
    log[rare] += slots.log_once(ids[rare])
    return np.bincount(np.repeat(np.arange(len(sizes)), sizes), log, len(sizes)).astype(float)


def score(docs: DataFrame, vocab: Vocabulary, net: Network, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens, pseudo_log_likelihood, mean_log_prob) for every row.

    A null text or one without words has no tokens, a sum of 0 and a null mean.  Rows that repeat are scored row by row;
    an empty table gives no rows; other columns are ignored.  Very long texts are scored whole, documents being taken
    ``SCORED_TOKENS`` tokens at a time.  A shared-slot word adds the logarithm of its occurrences, found in a join.
    """
    return _scored(settle(coded(docs, vocab, id_col, text_col), "slots-of-texts"), vocab, net, id_col)


def fit_and_score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``score`` of the documents by the network that ``fit`` trains on them; texts are turned into slots once for both."""
    vocab = vocabulary(docs, text_col)
    rows = settle(coded(docs, vocab, id_col, text_col), "slots-of-texts")
    return _scored(rows, vocab, _trained(rows, vocab), id_col)


def _scored(rows: DataFrame, vocab: Vocabulary, net: Network, id_col: str) -> DataFrame:
    """``score`` of settled ``coded`` rows."""
    kind = rows.schema["id"].dataType.simpleString()
    shared = rows.sparkSession.sparkContext.broadcast((vocab.slots, net))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slots, net = shared.value
        for batch in batches:
            ids, sizes = _slots_in(batch.column(4))
            ends, sums, lo = np.cumsum(sizes), [np.empty(0)], 0
            while lo < len(sizes):
                start = ends[lo] - sizes[lo]
                hi = min(len(sizes), int(np.searchsorted(ends, start + SCORED_TOKENS)) + 1)
                sums.append(_sums(ids[start : ends[hi - 1]], sizes[lo:hi], slots, net))
                lo = hi
            total = np.concatenate(sums) + batch.column(3).to_numpy()
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(total)], names=["key", "id", "n_tokens", "total"])

    found = rows.select("key", "id", "n_tokens", "more", "slots").mapInArrow(trimmed(run), f"key long, id {kind}, n_tokens long, total double")
    if vocab.rare is not None:
        each = rows.select("key", F.explode(F.arrays_zip("h", "times")).alias("w")).select("key", "w.h", "w.times")
        more = each.join(vocab.rare, "h").groupBy("key").agg(F.sum(F.col("times") * F.log("n")).alias("more"))
        found = found.join(more, "key", "left").withColumn("total", F.col("total") + F.coalesce("more", F.lit(0.0)))
    return found.select(F.col("id").alias(id_col), "n_tokens", F.col("total").alias("pseudo_log_likelihood"), F.when(F.col("n_tokens") > 0, F.col("total") / F.col("n_tokens")).alias("mean_log_prob"))
