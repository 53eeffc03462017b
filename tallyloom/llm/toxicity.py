"""Toxicity by a bidirectional GRU with attention pooling over word and character inputs.

Trained in numpy, in one executor task, from a bounded sample of labelled rows (SAMPLE of each
label, the least by a hash of the id), by multiple-instance learning: a document is as toxic as
its most toxic window. First rounds take a window of each toxic document at random, later ones
the most toxic; every window of a text may be taken. The task holds word numbers, not texts, and
reads them batch by batch. Every document is scored over all its overlapping windows.

Null and empty texts are one empty window, with a score like any other. Scores depend on the
text alone, so repeated rows score alike. Without labelled rows of both kinds the scores are
all 0. Empty tables give none; further columns pass through unless named as a result column,
and their names may hold any character.
"""

from __future__ import annotations

from collections.abc import Iterable
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, by_value, learned_in_task, quoted
from .gru import HIDDEN, Net, hashed, tokens_of, windows

by_value(__name__)

#: Labelled documents of each label that are learned from.
SAMPLE = 1500
SIZE, STEP = 40, 32
#: Rounds over random and over the most toxic windows; step size and windows of a step.
WARM, ROUNDS, RATE, BATCH = 20, 5, 0.1, 256
#: Share of the words whose own row takes part in a step, and of the tokens that are left out.
KEEP, LEFT_OUT = 0.3, 0.1
#: Windows scored at once, words whose vectors are made at once, and words a worker remembers before it starts anew.
BLOCK, PART, CACHE = 1024, 20_000, 300_000


def training_rows(df: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, limit: int = SAMPLE) -> DataFrame:
    """(id, text, label) of at most `limit` documents of each label, the least by a hash of the id."""
    ids = labels.select(quoted(id_col).alias("id"), quoted(label_col).cast("int").alias("label"))
    ids = ids.filter("id is not null and label in (0, 1)").groupBy("id").agg(F.max("label").alias("label"))
    least = lambda k: ids.filter(F.col("label") == k).orderBy(F.xxhash64("id"), "id").limit(limit)
    chosen = least(0).union(least(1))  # at most 2 * limit rows
    texts = df.select(quoted(id_col).alias("id"), F.coalesce(quoted(text_col), F.lit("")).alias("text"))
    return texts.join(F.broadcast(chosen), "id").groupBy("id").agg(F.max("text").alias("text"), F.max("label").alias("label"))


def learned(rows: DataFrame, seed: int = 1) -> dict | None:
    """Parameters learned from the (id, text, label) rows of training_rows in one task, from where they come to the driver."""

    return learned_in_task(rows, "id", ["text", "label"], lambda pairs: train(pairs, seed))


def _spans(starts: np.ndarray, ends: np.ndarray, chosen: np.ndarray) -> np.ndarray:
    """Places of the chosen words' n-grams, word by word."""
    sizes = ends[chosen] - starts[chosen]
    heads = np.cumsum(sizes) - sizes
    return np.arange(sizes.sum()) + np.repeat(starts[chosen] - heads, sizes)


def train(rows: Iterable, seed: int = 1) -> dict | None:
    """Parameters learned from (text, label) rows; None unless both labels are there."""
    rnd, net = np.random.default_rng(seed), Net(seed)
    index: dict[str, int] = {}
    bags, labels = [], []
    for text, y in rows:
        bags.append(windows(np.array([index.setdefault(w, len(index) + 1) for w in tokens_of(text)], dtype=np.int32), SIZE, STEP))
        labels.append(y)
    if len(set(labels)) < 2:
        return None
    labels, sizes = np.array(labels, dtype=np.float32), np.array([len(b) for b in bags])
    own, grams, starts = word_parts([*index] or ["?"])
    ends = np.append(starts[1:], len(grams))
    every, bag, heads = np.concatenate(bags), np.repeat(np.arange(len(bags)), sizes), np.cumsum(sizes) - sizes
    del bags, index
    scorer = Scorer(net.p)

    def fit(chosen, rate):
        rnd.shuffle(chosen)
        for at in range(0, len(chosen), BATCH):
            rows_at = chosen[at : at + BATCH]
            ids = every[rows_at]
            used, where = np.unique(ids[ids > 0], return_inverse=True)
            if not len(used):
                continue
            local = np.zeros_like(ids)
            local[ids > 0] = where + 1
            local[rnd.random(local.shape) < LEFT_OUT] = 0
            part = np.append(0, np.cumsum(ends[used - 1] - starts[used - 1])[:-1])
            y = labels[bag[rows_at]]
            share = y.mean()
            weight = np.where(y > 0, 0.5 / max(share, 0.05), 0.5 / max(1 - share, 0.05)).astype(np.float32)
            keep = (rnd.random(len(used)) < KEEP).astype(np.float32)
            _, grad, sparse = net.gradients(own[used - 1], grams[_spans(starts, ends, used - 1)], part, local, y, weight, keep)
            net.step(grad, sparse, rate)

    clean = np.flatnonzero(labels[bag] == 0)
    for _ in range(WARM):  # a window of each toxic document, short texts' are the surest
        some = (heads + rnd.random(len(heads)) * sizes).astype(np.int64)[labels > 0]
        fit(np.concatenate([some, rnd.choice(clean, len(some))]), RATE)
    logits = np.empty(len(every), np.float32)
    for n in range(ROUNDS + 1):
        logits[:] = scorer.logits(scorer.table(own, grams, starts), every)
        if n == ROUNDS:
            break
        order = np.lexsort((-logits, bag))
        rank = np.empty(len(order), dtype=np.int64)
        rank[order] = np.arange(len(order)) - heads[bag[order]]
        # The most toxic window of each document, more of the clean ones', and a few others.
        hard = np.flatnonzero(np.where(labels[bag] > 0, rank < 1, rank < 3))
        fit(np.concatenate([hard, rnd.choice(clean, len(labels) // 2)]), RATE * (1 - n / (ROUNDS + 2)))
    # The threshold that parts the training documents best becomes 0.5.
    most = np.maximum.reduceat(logits, heads)
    order = np.argsort(most)
    wrong = (labels == 0).sum() + np.concatenate([[0], np.cumsum(np.where(labels[order] > 0, 1, -1))])
    cuts = np.concatenate([[most[order[0]] - 1], (most[order[1:]] + most[order[:-1]]) / 2, [most[order[-1]] + 1]])
    best = np.flatnonzero(wrong == wrong.min())
    net.p["c"] -= np.float32(0.3 * cuts[best[0]] + 0.7 * cuts[best[-1]])  # nearer the toxic: long texts have more windows
    return {k: v.astype(np.float32) for k, v in net.p.items()}


def word_parts(words: list) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """hashed() of many words, PART at a time."""
    parts = [hashed(words[at : at + PART]) for at in range(0, len(words), PART)]
    before = np.cumsum([0, *[len(g) for _, g, _ in parts[:-1]]])
    return np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts]), np.concatenate([p[2] + b for p, b in zip(parts, before, strict=True)])


class Numbers(dict):
    """Numbers words from 1 on, in the order they come."""

    def __missing__(self, word: str) -> int:
        self[word] = n = len(self) + 1
        return n


class Scorer:
    """Scores texts by their windows; remembers the projected vectors of words."""

    def __init__(self, params: dict):
        self.net = Net.__new__(Net)
        self.net.p = params
        self.words, self.rows = Numbers(), np.zeros((1 << 15, 6 * HIDDEN), np.float32)
        self.rows[0] = params["b"]

    def table(self, own, grams, starts) -> np.ndarray:
        """Projected vectors of all words, the empty place's first."""
        out, ends = np.empty((len(own) + 1, 6 * HIDDEN), np.float32), np.append(starts[1:], len(grams))
        out[0] = self.net.p["b"]
        for at in range(0, len(own), PART):
            part = slice(at, at + PART)
            first, last = starts[at], ends[part][-1]
            out[at + 1 : at + 1 + PART] = self.net.projected(own[part], grams[first:last], starts[part] - first)
        return out

    def logits(self, table: np.ndarray, ids: np.ndarray) -> np.ndarray:
        out = np.empty(len(ids), np.float32)
        for at in range(0, len(ids), BLOCK):
            part = np.ascontiguousarray(ids[at : at + BLOCK].T)
            out[at : at + BLOCK] = self.net.forward(table[part], part > 0)
        return out

    def scores(self, texts: list) -> np.ndarray:
        """Score of each text: the sigmoid of its largest window's logit."""
        if len(self.words) > CACHE:
            self.words = Numbers()
        known, before = self.words, len(self.words)
        cut = []
        for text in texts:
            ids = list(map(known.__getitem__, tokens_of(text)))
            cut.append(windows(np.array(ids, dtype=np.int32), SIZE, STEP))
        new = list(islice(known, before, None))
        if len(known) >= len(self.rows):
            self.rows = np.concatenate([self.rows, np.zeros((len(known) + len(self.rows), self.rows.shape[1]), np.float32)])
        for at in range(0, len(new), PART):
            part = self.net.projected(*hashed(new[at : at + PART]))
            self.rows[before + at + 1 : before + at + 1 + len(part)] = part
        heads = np.concatenate([[0], np.cumsum([len(c) for c in cut])[:-1]])
        most = np.maximum.reduceat(self.logits(self.rows, np.concatenate(cut)), heads)
        return 1 / (1 + np.exp(-np.clip(most.astype(np.float64), -60, 60)))


def score(df: DataFrame, params: dict | None, text_col: str = "text") -> DataFrame:
    """df with `score` (double) and `predicted` (1 from score 0.5 on)."""
    keep = [c for c in df.columns if c not in ("score", "predicted")]
    if params is None:
        return df.select(*map(quoted, keep), F.lit(0.0).alias("score"), F.lit(0).alias("predicted"))
    shared = df.sparkSession.sparkContext.broadcast(params)  # of fixed size: the network's parameters

    def work(batches):
        scorer = Scorer(shared.value)
        for batch in batches:
            for part in range(0, batch.num_rows, 512):
                rows = batch.slice(part, 512)
                s = scorer.scores(rows.column(rows.num_columns - 1).to_pylist())
                yield rows, [pa.array(s), pa.array((s >= 0.5).astype(np.int32))]

    return arrow_map(df, keep, [quoted(text_col)], [("score", "double"), ("predicted", "int")], work)
