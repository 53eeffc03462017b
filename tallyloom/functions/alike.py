"""Likeness of texts by their words and letters, one text against many at once."""

from __future__ import annotations

import sys
from collections import Counter

import numpy as np
from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # executors need no copy of the package

#: Columns that letters are counted in; letters that share one are counted as one, which only lets more pairs through.
LETTERS = 64
#: Letters of a text that is compared with many at once: as many as an integer has bits.
LONG = 64
#: Leaders that are compared one by one.
FEW = 4


def common(p: str, q: str) -> int:
    """Length of the longest common subsequence: a row of the table as the bits of an integer."""
    if len(p) > len(q):
        p, q = q, p
    places: dict[str, int] = {}
    for i, c in enumerate(p):
        places[c] = places.get(c, 0) | 1 << i
    whole = row = (1 << len(p)) - 1
    for c in q:
        if hit := row & places.get(c, 0):
            row = (row + hit | row - hit) & whole
    return len(p) - row.bit_count()


class Words:
    """A text as its set of words, with what comparisons need."""

    __slots__ = ("_bag", "letters", "size", "words")

    def __init__(self, text: str | None):
        self.words = frozenset((text or "").split())
        self.letters, self._bag = " ".join(self.words), None
        self.size = len(self.letters)

    @property
    def bag(self) -> Counter:
        """Numbers of letters, counted when first asked for."""
        if self._bag is None:
            self._bag = Counter(self.letters)
        return self._bag

    def codes(self) -> np.ndarray | None:
        """The sorted words' letters; None if they are more than LONG or outside the first 65,536 (0 stands for none)."""
        line = " ".join(sorted(self.words))
        if not line or len(line) > LONG or max(line) > "\uffff" or min(line) == "\0":
            return None
        return np.frombuffer(line.encode("utf-16-le", "surrogatepass"), np.uint16)

    def counts(self) -> np.ndarray:
        out = np.zeros(LETTERS, np.int16)
        for c, n in self.bag.items():
            out[ord(c) % LETTERS] += n
        return out


def ratio(x: Words, y: Words, least: float = 0.0) -> float:
    """Similarity 0 to 100 of two word sets: 100 if one holds the other, else the best of three ratios 200 LCS / (size + size):
    of the shared words with either text, and of both texts, written with their shared words first.

    Below `least` any value below it may come back. A text begins with the shared words, so
    their subsequence is all of them, and what both begin with needs no comparing.
    """
    if not x.words or not y.words:
        return 0.0
    both = x.words & y.words
    if both and (len(both) == len(x.words) or len(both) == len(y.words)):
        return 100.0
    base = sum(map(len, both)) + max(0, len(both) - 1)
    best = max(200 * base / (base + x.size), 200 * base / (base + y.size)) if both else 0.0
    total = x.size + y.size
    most = 200 * sum((x.bag & y.bag).values()) / total
    if most < least or most <= best:
        return best
    mine, theirs = (" ".join(sorted(z.words - both)) for z in (x, y))
    shared = base + 1 if both else 0  # the shared words and the blank after them
    return max(best, 200 * (shared + common(mine, theirs)) / total)


class Leaders:
    """Texts in order, asked for the first that is alike to another by `least`.

    Letters rule some out. Of the rest, texts that share no word with the asked one are compared all at
    once: their subsequences with it are counted as bits, one letter of every text at a time. Those
    that share a word, or are longer than LONG, are compared one by one. So are the first FEW, as most groups
    have no more: the arrays are made when another comes.
    """

    def __init__(self, least: float):
        self.least, self.held, self.by_word = least, [], {}
        self.bags = None

    def add(self, own, text: Words) -> None:
        self.held.append((own, text))
        if self.bags is not None:
            self._set(len(self.held) - 1, text)
        elif len(self.held) > FEW:
            self.bags, self.sizes = np.zeros((16, LETTERS), np.int16), np.zeros(16, np.int32)
            self.codes, self.plain = np.zeros((16, LONG), np.uint16), np.zeros(16, bool)
            self.table = np.zeros(1 << 16, np.uint64)
            for n, (_, held) in enumerate(self.held):
                self._set(n, held)

    def _set(self, n: int, text: Words) -> None:
        if n == len(self.bags):
            self.bags, self.sizes, self.codes, self.plain = (np.concatenate([x, np.zeros_like(x)]) for x in (self.bags, self.sizes, self.codes, self.plain))
        self.bags[n], self.sizes[n] = text.counts(), text.size
        if (line := text.codes()) is not None:
            self.codes[n, : len(line)], self.plain[n] = line, True
        for w in text.words:
            self.by_word.setdefault(w, []).append(n)

    def first(self, text: Words):
        """The own of the first alike, or None."""
        n = len(self.held)
        if not n or not text.words:
            return None
        if self.bags is None:
            return next((own for own, other in self.held if ratio(text, other, self.least) >= self.least), None)
        shared = np.minimum(self.bags[:n], text.counts()).sum(axis=1)
        able = 200 * shared >= self.least * (self.sizes[:n] + text.size)
        alone, line = np.zeros(n, bool), text.codes()
        if line is None:
            alone[:] = able
        else:
            alone = able & ~self.plain[:n]
        for w in text.words:
            if at := self.by_word.get(w):
                alone[at] = True
        found = n
        if line is not None and len(at := np.flatnonzero(able & ~alone)):
            total = self.sizes[at] + text.size
            good = 200 * self._common(line, self.codes[at, : int(self.sizes[at].max())]) / total >= self.least
            if good.any():
                found = int(at[good.argmax()])
        for k in np.flatnonzero(alone[:found]):
            own, other = self.held[k]
            if ratio(text, other, self.least) >= self.least:
                return own
        return self.held[found][0] if found < n else None

    def _common(self, line: np.ndarray, others: np.ndarray) -> np.ndarray:
        """Lengths of the longest common subsequences of a line and rows of others, as in common()."""
        for i, c in enumerate(line.tolist()):
            self.table[c] |= np.uint64(1 << i)
        whole = np.uint64((1 << len(line)) - 1)
        row = np.full(len(others), whole, np.uint64)
        for column in others.T:
            hit = row & self.table[column]
            row = ((row + hit) | (row - hit)) & whole
        self.table[line] = 0
        return len(line) - np.bitwise_count(row).astype(np.int64)
