"""Many words in one pass over texts: an automaton with failure links, as flat arrays.

The automaton follows all words at once.  Its failure links are resolved while it is built, so a step is one look-up in a table
of states by symbols (the characters that occur in words, and one for all others).  In tasks the texts of a batch are laid end to
end and cut into lanes of equal length, which step side by side; a lane begins as many characters early as the longest word has,
less one, so that its state is right where it starts to count.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

#: Largest table that is sent to the executors, in bytes.
MOST_TABLE = 256 << 20
#: Characters that a lane counts at most, and lanes that make it count fewer.
LANE, LANES = 1024, 4096


@dataclass
class Automaton:
    symbols: np.ndarray  # code point -> symbol, 0 for characters of no word
    step: np.ndarray  # state, symbol -> state
    first: np.ndarray  # state -> its part of ``words``: those that end in it
    words: np.ndarray
    longest: int

    def symbols_of(self, text: str) -> np.ndarray:
        codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        return self.symbols[np.minimum(codes, len(self.symbols) - 1)]

    def hits(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text, word, end) of every occurrence, overlapping ones too; ``end`` is the position after its last character."""
        none = np.zeros(0, np.int64)
        sizes = np.array([len(t) for t in texts], np.int64)
        if not len(self.words) or not sizes.sum():
            return none, none, none
        zero = np.zeros(1, self.symbols.dtype)  # between texts, so that no word runs across
        line = np.concatenate([x for t in texts for x in (self.symbols_of(t), zero)])
        starts = np.cumsum(sizes + 1) - sizes - 1
        early = self.longest - 1
        lane = min(LANE, max(8 * self.longest, len(line) // LANES))
        lanes = -(-len(line) // lane)
        laid = np.zeros(early + lanes * lane, self.symbols.dtype)
        laid[early : early + len(line)] = line
        at = np.arange(lanes) * lane
        state = np.zeros(lanes, np.int32)
        ends = np.diff(self.first) > 0
        where, what = [], []
        for i in range(early + lane):
            state = self.step[state, laid[at + i]]
            if i >= early and (hit := np.flatnonzero(ends[state])).size:
                where.append(at[hit] + i - early)
                what.append(state[hit])
        if not where:
            return none, none, none
        place, state = np.concatenate(where), np.concatenate(what)
        count = self.first[state + 1] - self.first[state]
        inner = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        word, place = self.words[np.repeat(self.first[state], count) + inner], np.repeat(place, count)
        text = np.searchsorted(starts, place, side="right") - 1
        return text, word.astype(np.int64), place - starts[text] + 1

    def counts(self, texts: list[str], most: int) -> list[dict[int, int]]:
        """For each text the words that occur and how often, up to ``most``."""
        text, word, _ = self.hits(texts)
        out: list[dict[int, int]] = [{} for _ in texts]
        pairs, n = np.unique(np.stack([text, word]), axis=1, return_counts=True) if len(text) else (np.zeros((2, 0), int), ())
        for t, w, c in zip(*pairs.tolist(), n, strict=True):
            out[t][w] = min(int(c), most)
        return out


def build(words: list[str]) -> Automaton:
    """The automaton of ``words``; empty words never occur, words that repeat are counted each.

    Raises ValueError where the table would exceed ``MOST_TABLE``: some 10,000 words of ordinary length take 20 MB.
    """
    letters = sorted({ord(c) for w in words for c in w})
    symbols = np.zeros((letters[-1] + 2) if letters else 1, np.uint16 if len(letters) < 1 << 16 else np.uint32)
    symbols[letters] = np.arange(1, len(letters) + 1)
    width, most = len(letters) + 1, 1 + sum(map(len, words))
    children: list[dict[int, int]] = [{}]
    own: list[list[int]] = [[]]
    for number, word in enumerate(words):
        state = 0
        for c in word:
            s = int(symbols[ord(c)])
            if s not in children[state]:
                children[state][s] = len(children)
                children.append({})
                own.append([])
            state = children[state][s]
        if word:
            own[state].append(number)
    if len(children) * width * 4 > MOST_TABLE:
        raise ValueError(f"{len(words)} words of {most} characters need a table of {len(children) * width * 4 >> 20} MB; at most {MOST_TABLE >> 20} MB are sent to executors")
    step = np.zeros((len(children), width), np.int32)
    fail = np.zeros(len(children), np.int64)
    level = [0]
    while level:  # by length, so that a state's failure link is complete before its own row is
        below = []
        for state in level:
            if state:
                step[state] = step[fail[state]]
                own[state] = own[state] + own[fail[state]]
            for s, child in children[state].items():
                fail[child] = step[state, s] if state else 0
                below.append(child)
            for s, child in children[state].items():
                step[state, s] = child
        level = below
    first = np.concatenate([[0], np.cumsum([len(x) for x in own])])
    return Automaton(symbols, step, first, np.array([w for x in own for w in x], np.int32), max(map(len, words), default=1) or 1)
