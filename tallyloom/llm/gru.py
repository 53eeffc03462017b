"""A bidirectional gated recurrent network with attention pooling, in numpy.

Tokens come as vectors of a hashed word and its hashed character n-grams: the word's row plus
the mean of its n-grams' first DIM values, and the most of each of their other PEAKS values, so
that one telling n-gram of a long word shows. The network reads windows of tokens in both
directions; attention weighs its states; one logit comes out. All rows are learned.
"""

from __future__ import annotations

import zlib

import numpy as np

from .common import by_value

by_value(__name__)

WORDS, GRAM_BITS, DIM, PEAKS, HIDDEN, ATTEND = 1 << 16, 17, 8, 4, 8, 8
SIZES = (3, 4, 5, 6)
MARKS = ".,;:!?\"'()[]"


#: Bytes from which on a token is cut into pieces; characters of a piece, and those it shares with the next.
LONG, PIECE, LAP = 120, 30, max(SIZES) - 1


def tokens_of(text: str | None) -> list[str]:
    """Lower-case runs without white space, the long ones in pieces; the marks at their ends are stripped with their features."""
    words = (text or "").lower().split()
    if max(map(len, words), default=0) <= LONG // 4:
        return words
    return [p for w in words for p in pieces(w)]


def pieces(word: str) -> list[str]:
    """The word, or overlapping pieces that hold every n-gram of one over LONG bytes.

    A piece has a space where it was cut: no word has one, so its features are no word's end.
    """
    bare = word.strip(MARKS) or word
    if len(bare) <= LONG // 4 or len(bare.encode()) <= LONG:
        return [word]
    return [" " * (at > 0) + bare[at : at + PIECE] + " " * (at + PIECE < len(bare)) for at in range(0, len(bare) - LAP, PIECE - LAP)]


def hashed(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word buckets, and the n-gram buckets of all words with each word's first position among them."""
    bare = [w.strip(MARKS) or w for w in words]
    own = np.array([zlib.crc32(b" " if " " in w else w.encode()) % WORDS for w in bare], dtype=np.int64)  # pieces are one word: no other text has theirs
    coded = [b"\x02" + w.encode() + b"\x03" for w in bare]
    data = np.frombuffer(b"".join(coded), dtype=np.uint8).astype(np.uint32)
    sizes = np.array([len(c) for c in coded])
    word = np.repeat(np.arange(len(words), dtype=np.int32), sizes)
    grams, owner = [], []
    for n in SIZES:
        count = len(data) - n + 1
        if count <= 0:
            continue
        h = np.full(count, n, dtype=np.uint32)
        for k in range(n):
            h = h * np.uint32(16777619) ^ data[k : k + count]
        inside = word[:count] == word[n - 1 :]
        grams.append((h[inside] * np.uint32(2654435761) >> np.uint32(32 - GRAM_BITS)).astype(np.int32))
        owner.append(word[:count][inside])
    grams, owner = np.concatenate(grams), np.concatenate(owner)
    order = np.argsort(owner, kind="stable")
    starts = np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=len(words)))[:-1]])
    return own, grams[order], starts


def windows(ids: np.ndarray, size: int, step: int) -> np.ndarray:
    """All windows of `size` at every `step`, the last padded by 0; at least one."""
    n = max(1, -(-(len(ids) - (size - step)) // step))
    padded = np.zeros((n - 1) * step + size, dtype=np.int32)
    padded[: len(ids)] = ids
    return padded[np.arange(n)[:, None] * step + np.arange(size)]


def add_rows(to: np.ndarray, at: np.ndarray, rows: np.ndarray) -> None:
    """to[at] += rows, with repeated places summed."""
    order = np.argsort(at, kind="stable")
    places, heads = np.unique(at[order], return_index=True)
    to[places] += np.add.reduceat(rows[order], heads)


def _sigmoid(x):
    return 0.5 * np.tanh(0.5 * x) + 0.5


class Net:
    """Parameters as float32 arrays; forward, gradients and Adagrad steps."""

    def __init__(self, seed: int = 1, dtype=np.float32):
        r = np.random.default_rng(seed)
        draw = lambda *shape, s: (r.standard_normal(shape) * s).astype(dtype)
        h = HIDDEN
        wide = DIM + PEAKS
        self.p = {
            "word": draw(WORDS, DIM, s=0.1), "gram": draw(1 << GRAM_BITS, wide, s=0.1),
            "w": draw(wide, 6 * h, s=0.4), "b": np.zeros(6 * h, dtype), "uf": draw(h, 3 * h, s=0.3), "ub": draw(h, 3 * h, s=0.3),
            "a": draw(2 * h, ATTEND, s=0.4), "v": draw(ATTEND, s=0.4), "o": draw(2 * h, s=0.4), "c": np.zeros(1, dtype),
        }
        self.sums = {k: np.full(x.shape, 1e-6, dtype) for k, x in self.p.items()}

    def vectors(self, own, grams, starts, keep=None):
        """Token vectors; keep, where given, is 0 for words whose own row is left out (in training)."""
        counts = np.maximum(1, np.diff([*starts, len(grams)]))[:, None].astype(self.p["w"].dtype)
        rows, word = self.p["gram"][grams], self.p["word"][own]
        mean = np.add.reduceat(rows[:, :DIM], starts) / counts
        return np.concatenate([(word if keep is None else word * keep[:, None]) + mean, np.maximum.reduceat(rows[:, DIM:], starts)], axis=1)

    def projected(self, own, grams, starts):
        return self.vectors(own, grams, starts) @ self.p["w"] + self.p["b"]

    @staticmethod
    def _run(xp, u, keep):
        """States (T, B, H) of one direction over projected inputs (T, B, 3H)."""
        h, n = u.shape[0], xp.shape[1]
        state, out, cache = np.zeros((n, h), xp.dtype), np.empty((*xp.shape[:2], h), xp.dtype), []
        for t in range(len(xp)):
            g = state @ u
            zr = _sigmoid(xp[t, :, : 2 * h] + g[:, : 2 * h])
            z, r = zr[:, :h], zr[:, h:]
            m = np.tanh(xp[t, :, 2 * h :] + r * g[:, 2 * h :])
            new = m + z * (state - m)
            if keep:
                cache.append((state, z, r, m, g[:, 2 * h :]))
            out[t] = state = new
        return out, cache

    @staticmethod
    def _back(dout, u, cache):
        h = u.shape[0]
        dxp, du, dstate = np.zeros((*dout.shape[:2], 3 * h), dout.dtype), np.zeros_like(u), np.zeros_like(dout[0])
        for t in range(len(dout) - 1, -1, -1):
            state, z, r, m, gn = cache[t]
            d = dout[t] + dstate
            dm = d * (1 - z) * (1 - m * m)
            dz = d * (state - m) * z * (1 - z)
            dr = dm * gn * r * (1 - r)
            dxp[t] = np.concatenate([dz, dr, dm], axis=1)
            dg = np.concatenate([dz, dr, dm * r], axis=1)
            du += state.T @ dg
            dstate = d * z + dg @ u.T
        return dxp, du

    def forward(self, xp, mask, keep=False):
        """Logits of windows: xp (T, B, 6H) projected inputs, mask (T, B) 1 where a token is."""
        h = HIDDEN
        f, cf = self._run(xp[:, :, : 3 * h], self.p["uf"], keep)
        b, cb = self._run(xp[::-1, :, 3 * h :], self.p["ub"], keep)
        s = np.concatenate([f, b[::-1]], axis=2)
        q = np.tanh(s @ self.p["a"])
        e = np.where(mask > 0, q @ self.p["v"], np.float32(-1e9))
        e = np.exp(e - e.max(axis=0))
        alpha = e / e.sum(axis=0)
        pooled = np.einsum("tb,tbk->bk", alpha, s)
        logit = pooled @ self.p["o"] + self.p["c"][0]
        return (logit, (cf, cb, s, q, alpha, pooled)) if keep else logit

    def gradients(self, own, grams, starts, ids, target, weight, keep=None):
        """Loss and gradients over windows `ids` (B, T) into words 1.. (0 pads); keep as in vectors."""
        wide = DIM + PEAKS
        vec = np.concatenate([np.zeros((1, wide), self.p["w"].dtype), self.vectors(own, grams, starts, keep)])
        x, mask = vec[ids.T], (ids.T > 0).astype(vec.dtype)
        logit, (cf, cb, s, q, alpha, pooled) = self.forward(x @ self.p["w"] + self.p["b"], mask, True)
        y = _sigmoid(logit)
        total = weight.sum()
        loss = (weight * (np.logaddexp(0, logit) - target * logit)).sum() / total
        d = weight * (y - target) / total
        grad = {"o": pooled.T @ d, "c": np.array([d.sum()], d.dtype)}
        dpool = d[:, None] * self.p["o"]
        dalpha = np.einsum("bk,tbk->tb", dpool, s)
        ds = alpha[:, :, None] * dpool
        de = alpha * (dalpha - (alpha * dalpha).sum(axis=0))
        grad["v"] = np.einsum("tb,tbk->k", de, q)
        dq = de[:, :, None] * self.p["v"] * (1 - q * q)
        grad["a"] = s.reshape(-1, s.shape[2]).T @ dq.reshape(-1, dq.shape[2])
        ds = ds + dq @ self.p["a"].T
        dxf, grad["uf"] = self._back(ds[:, :, :HIDDEN], self.p["uf"], cf)
        dxb, grad["ub"] = self._back(ds[::-1, :, HIDDEN:], self.p["ub"], cb)
        dxp = np.concatenate([dxf, dxb[::-1]], axis=2)
        flat = dxp.reshape(-1, dxp.shape[2])
        grad["w"], grad["b"] = x.reshape(-1, wide).T @ flat, flat.sum(axis=0)
        dvec = np.zeros((len(vec), wide), vec.dtype)
        add_rows(dvec, ids.T.reshape(-1), flat @ self.p["w"].T)
        dvec, counts = dvec[1:], np.diff([*starts, len(grams)])
        of = np.repeat(np.arange(len(counts)), counts)
        dgram = dvec[of]
        dgram[:, :DIM] /= np.maximum(1, counts)[of, None].astype(vec.dtype)
        dgram[:, DIM:] *= self.p["gram"][grams, DIM:] == vec[1:][of, DIM:]
        dword = dvec[:, :DIM] if keep is None else dvec[:, :DIM] * keep[:, None]
        rows = {"word": (own, dword), "gram": (grams, dgram)}
        return loss, grad, rows

    def step(self, grad, rows, rate):
        for k, g in grad.items():
            self.sums[k] += g * g
            self.p[k] -= rate * g / np.sqrt(self.sums[k])
        for k, (at, g) in rows.items():
            order = np.argsort(at, kind="stable")
            touched, heads = np.unique(at[order], return_index=True)
            total = np.add.reduceat(g[order], heads)
            self.sums[k][touched] += total * total
            self.p[k][touched] -= rate * total / np.sqrt(self.sums[k][touched])

