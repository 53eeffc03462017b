"""Main text of web pages by a recurrent block labeller.

A page is cut into leaf blocks: runs of text between block tags, each with the path of its
open tags (with class, id and role; the PATH innermost as they are, and the words of all outer ones
as a set of OUTER hash buckets), its words and its shape. A bidirectional LSTM in numpy reads the
blocks' vectors in page order (hashed tag path, hashed words, shape) and labels each block as main
text or not, with the whole document as context.

The network is trained in one executor task on a bounded sample of the pages (SAMPLE, the least
by a hash of the html; all their blocks, in windows of WINDOW). Its teacher are the blocks whose
open tags say what they are: inside `article` or `main`, or inside navigation, footers, asides,
forms, headers outside an article, and class names of adverts, notices and comments. Inside an
article a class speaks only if all of its words tell (`comments`, not `related-work`); otherwise
the teacher is silent about that part, and the network decides. What the teacher reads is no
input as such: one of three readings hides all telling names, so the labels must also be learned from
words, shape and neighbours, and one leaves only SHORT tags of a path, so that outer ones are learned. The
network alone labels blocks.

Null and empty pages have no blocks and an empty text; so have pages whose blocks are all
other. Without taught blocks of both kinds all blocks are main text. Tags are read as HTML reads them:
a quote holds a value together only after `=`, and the first other `>` ends the tag. Markup may be broken: tags
left open end with their parent; from a tag on that never ends, quotes don't hold tags together,
and an unclosed script or style takes the rest. Time is linear in the page, and memory for a page
is that of its blocks. Repeated rows get equal texts, empty tables give none; columns pass
through unless named as a result column, and their names may hold any character.
"""

from __future__ import annotations

import html as entities
import re
import zlib
from collections import Counter
from collections.abc import Iterable
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, by_value, learned_in_task, quoted
from .gru import add_rows

by_value(__name__)

SAMPLE, BUCKETS, DIM, HIDDEN, EPOCHS, RATE = 400, 4096, 12, 12, 8, 0.08
#: Values of a block's shape, open tags of its path, blocks of a training window, pages of a training step.
SHAPE, PATH, WINDOW, BATCH = 6, 8, 256, 32
#: Buckets of the words of tags outside a path, and tags of a path that the shortened reading leaves.
OUTER, SHORT = 256, 2
#: Pages' characters that are parsed at once, blocks that are read at once, and steps whose inputs are made at once.
CHARS, CELLS, STEPS = 4_000_000, 32_768, 512
# HTML's elements that show no text, whose text is raw, that end their like, that
# never stay open, and that are set inside a line.
SILENT = {"script", "style", "noscript", "template", "title", "svg", "iframe", "select", "textarea", "button"}
RAW = {"script", "style"}
SILENT_END = {tag: re.compile(rf"</{tag}(?:[\s/][^>]*)?>", re.I) for tag in SILENT}
SIBLINGS = {"li", "dt", "dd", "tr", "td", "th"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
INLINE = set("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split())
# Tags, and words of classes, ids and roles, that say what a block is.
OTHER_TAGS, MAIN_TAGS = {"nav", "footer", "aside", "form", "menu"}, {"article", "main"}
OTHER_WORDS = set("ad ads advert advertisement advertising banner sponsor sponsored promo cookie cookies consent notice notices menu navbar navigation sidebar footer masthead comment comments replies disqus related share social breadcrumb breadcrumbs newsletter subscribe popup modal login search widget pagination".split())
UNSAID = {"has", "with", "no", "without"}
#: What a tag says inside an article whose class tells in part: nothing, nor do the tags in it that aren't other.
SILENCED = -1
MARKUP = r"<!--(?:-?>|.*?(?:--!?>|\Z))|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)"
#: An attribute: a name (which may begin with =) and, after =, a value in quotes or up to a blank or >. A quote that never closes takes the rest.
NAME = r"(?:=[^ \t\n\f\r/>=]*+|[^ \t\n\f\r/>=]++)"
VALUE = r"""(?:"[^"]*+(?:"|\Z)|'[^']*+(?:'|\Z)|[^ \t\n\f\r>"'][^ \t\n\f\r>]*+)"""
#: A tag, ending in > unless it never ends; and one that any > ends.
TAG = re.compile(MARKUP + rf"((?:[ \t\n\f\r/]++|{NAME}(?:[ \t\n\f\r]*+=[ \t\n\f\r]*+{VALUE}?+)?+)*+)(>?)", re.S)
LOOSE = re.compile(MARKUP + r"([^>]*)(>?)", re.S)
ATTRIBUTE = re.compile(rf"({NAME})(?:[ \t\n\f\r]*+=[ \t\n\f\r]*+({VALUE})?+)?+", re.S)
MARKS = re.compile("class|id|role", re.I)
SPLIT = re.compile(r"[^a-zA-Z]+")


class Block(NamedTuple):
    """A run of text: the names of its innermost open tags, its text, its share of linked characters, what its tags say it is, and the outer tags' words."""

    path: tuple[str, ...]
    text: str
    linked: float
    said: int | None
    outer: tuple[str, ...] = ()


def marks_of(attributes: str) -> tuple[str, bool]:
    """The class, id and role of a tag, in its order, and whether the tag closes itself."""
    found: dict[str, str] = {}
    end, slash = 0, attributes.endswith("/")
    for m in ATTRIBUTE.finditer(attributes) if slash or MARKS.search(attributes) else ():
        name, value, end = m[1].lower(), m[2] or "", m.end()
        if name in ("class", "id", "role"):
            found.setdefault(name, entities.unescape(value[1:].removesuffix(value[0]) if value[:1] in ("'", '"') else value))
    return " ".join(found.values()), slash and end < len(attributes)


def outer_words(name: str) -> list[str]:
    """Buckets of the words of a tag's name; a telling name's are marked."""
    telling = "!" if name[-1] == "!" else ""
    return [f"^{telling}{zlib.crc32(w.encode()) % OUTER}" for w in SPLIT.split(name.lower()) if w]


def said_by(tag: str, marks: str, outer: int | None) -> int | None:
    """What an open tag says of its blocks: 0 other, 1 main, None or SILENCED nothing; outer is its parent's word."""
    if outer == 0 or tag in ("html", "body"):
        return outer
    if tag in OTHER_TAGS or (tag == "header" and outer is None):
        return 0
    for mark in marks.lower().split():
        words = [w for w in SPLIT.split(mark) if w]
        if not UNSAID.intersection(words) and OTHER_WORDS.intersection(words):
            return 0 if outer is None or OTHER_WORDS.issuperset(words) else SILENCED
    if outer == SILENCED:
        return outer
    return 1 if tag in MAIN_TAGS or "main" in marks.lower().split() else outer


def leaf_blocks(page: str | None) -> list[Block]:
    """The blocks with text, in page order; a path has a name for each open tag, a telling one's ends in `!`."""
    page, blocks, names, run, at, links, pattern = page or "", [], [], [], 0, 0, TAG
    stack: list[tuple[str, int | None]] = []
    open_now: dict[str, int] = {}
    endless: set[str] = set()
    linked = False
    known: dict[tuple, tuple] = {}
    read: dict[str, tuple[str, bool]] = {}
    outside: Counter[str] = Counter()
    beyond: tuple[str, ...] | None = ()

    def flush():
        nonlocal links, beyond
        text = " ".join(entities.unescape("".join(run)).split())
        run.clear()
        if text:
            path = tuple(names[-PATH:])
            said = stack[-1][1] if stack else None
            if beyond is None:
                beyond = tuple(sorted(outside))
            blocks.append(Block(known.setdefault(path, path), text, min(1.0, links / len(text)), None if said == SILENCED else said, beyond))
        links = 0

    def moved(name: str, out: bool):
        """A tag has left the PATH innermost, or comes back."""
        nonlocal beyond
        for w in outer_words(name):
            outside[w] += 1 if out else -1
            if not outside[w]:
                del outside[w]
        beyond = None

    def shut():
        open_now[stack.pop()[0]] -= 1
        names.pop()
        if len(names) >= PATH:
            moved(names[-PATH], False)

    while m := pattern.search(page, at):
        if m[2] is not None and not m[4] and pattern is TAG:  # the tag, or a quote in it, never ends
            pattern = LOOSE
            continue
        run.append(page[at : m.start()])
        links += linked * (m.start() - at)
        at = m.end()
        if m[2] is None:  # a comment or declaration
            continue
        tag, closes = m[2].lower(), bool(m[1])
        if tag in SILENT:
            if not closes and tag not in endless:
                if end := SILENT_END[tag].search(page, at):
                    at = end.end()
                elif tag in RAW:
                    at = len(page)
                else:
                    endless.add(tag)
            continue
        if tag in INLINE:
            if tag == "a":
                linked = not closes
            if tag == "br":
                run.append(" ")
            continue
        flush()
        if tag in VOID:
            continue
        if closes:
            if open_now.get(tag):
                while stack[-1][0] != tag:
                    shut()
                shut()
            continue
        if stack and (stack[-1][0] == "p" or (tag == stack[-1][0] and tag in SIBLINGS)):
            shut()
        if m[3] not in read:
            read[m[3]] = marks_of(m[3])
        marks, closed = read[m[3]]
        if not closed:
            outer = stack[-1][1] if stack else None
            said = said_by(tag, marks, outer)
            stack.append((tag, said))
            open_now[tag] = open_now.get(tag, 0) + 1
            names.append(f"{tag} {marks}".strip() + "!" * (said != outer or tag in OTHER_TAGS | MAIN_TAGS))
            if len(names) > PATH:
                moved(names[-PATH - 1], True)
    run.append(page[at:])
    flush()
    return blocks


def hidden(blocks: list[Block]) -> list[Block]:
    """The blocks with each telling name of their paths made a plain div."""
    return [b._replace(path=tuple("div" if name[-1] == "!" else name for name in b.path), outer=tuple(w for w in b.outer if w[1] != "!")) for b in blocks]


def shortened(blocks: list[Block]) -> list[Block]:
    """The blocks with SHORT tags in their paths, and the words of the others among the outer ones."""
    return [b._replace(path=b.path[-SHORT:], outer=tuple(sorted({*b.outer, *(w for name in b.path[:-SHORT] for w in outer_words(name))}))) for b in blocks]


def block_features(blocks: list[Block], first: int = 0, total: int | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash buckets of path and words (one bag a block) with each block's first, and shape values.

    first and total: the place of the blocks in their page.
    """
    ids, heads, shape = [], [], np.zeros((len(blocks), SHAPE), np.float32)
    known: dict[str, int] = {}
    for i, (path, text, linked, _, outer) in enumerate(blocks):
        heads.append(len(ids))
        bag = [
            w for k,
            name in enumerate(path) for w in (f"<{name}", f"<{len(path) - k}{name.split(' ')[0].rstrip('!')}", *(f"<.{x.lower()}" for x in SPLIT.split(name)))
        ]
        words = text.split()
        for w in dict.fromkeys([*bag, *outer, *words, "<>"]):
            if w not in known:
                known[w] = zlib.crc32(w.encode()) % BUCKETS
            ids.append(known[w])
        shape[i] = (np.log1p(len(words)) / 5, np.log1p(len(text)) / 8, text[-1] in ".!?", (first + i) / (total or len(blocks)), len(path) / 10, linked)
    return np.array(ids, dtype=np.int64), np.array(heads, dtype=np.int64), shape


def _sigmoid(x):
    return 0.5 * np.tanh(0.5 * x) + 0.5


class BiLstm:
    """Embeds bags, reads them in both directions and gives a logit for each block."""

    def __init__(self, seed: int = 1):
        r = np.random.default_rng(seed)
        draw = lambda *s, k=0.3: (r.standard_normal(s) * k).astype(np.float32)
        h, d = HIDDEN, DIM + SHAPE
        bias = np.zeros(4 * h, np.float32)
        bias[h : 2 * h] = 1
        self.p = {
            "e": draw(BUCKETS, DIM), "wf": draw(d, 4 * h), "uf": draw(h, 4 * h), "bf": bias.copy(), "wb": draw(d, 4 * h),
            "ub": draw(h, 4 * h), "bb": bias.copy(), "o": draw(2 * h + d), "c": np.zeros(1, np.float32)
        }
        self.sums = {k: np.full(v.shape, 1e-6, np.float32) for k, v in self.p.items()}

    def inputs(self, ids, heads, shape):
        counts = np.diff([*heads, len(ids)])[:, None].astype(np.float32)
        return np.concatenate([np.add.reduceat(self.p["e"][ids], heads) / np.sqrt(counts), shape], axis=1)

    @staticmethod
    def _run(x, w, u, b, mask, keep=False):
        """States of one direction over (T, B, D); a masked step keeps the state."""
        h, n = u.shape[0], x.shape[1]
        s, c, out, cache = np.zeros((n, h), np.float32), np.zeros((n, h), np.float32), np.empty((len(x), n, h), np.float32), []
        xw = x @ w + b
        for t in range(len(x)):
            g = xw[t] + s @ u
            i, f, o, a = _sigmoid(g[:, :h]), _sigmoid(g[:, h : 2 * h]), _sigmoid(g[:, 2 * h : 3 * h]), np.tanh(g[:, 3 * h :])
            m = mask[t][:, None]
            nc = f * c + i * a
            tc = np.tanh(nc)
            if keep:
                cache.append((s, c, i, f, o, a, tc, m))
            s, c = m * (o * tc) + (1 - m) * s, m * nc + (1 - m) * c
            out[t] = s
        return out, cache

    @staticmethod
    def _back(dout, x, w, u, cache):
        h = u.shape[0]
        dg_all = np.empty((*dout.shape[:2], 4 * h), np.float32)
        ds, dc, du = np.zeros_like(dout[0]), np.zeros_like(dout[0]), np.zeros_like(u)
        for t in range(len(dout) - 1, -1, -1):
            s, c, i, f, o, a, tc, m = cache[t]
            d = dout[t] + ds
            do, dnc = m * d * tc, m * (d * o * (1 - tc * tc) + dc)
            dg = np.concatenate([dnc * a * i * (1 - i), dnc * c * f * (1 - f), do * o * (1 - o), dnc * i * (1 - a * a)], axis=1)
            dg_all[t] = dg
            du += s.T @ dg
            ds, dc = dg @ u.T + (1 - m) * d, dnc * f + (1 - m) * dc
        flat = dg_all.reshape(-1, 4 * h)
        return dg_all @ w.T, x.reshape(-1, x.shape[2]).T @ flat, du, flat.sum(axis=0)

    def logits(self, x, mask, keep=False):
        p = self.p
        f, cf = self._run(x, p["wf"], p["uf"], p["bf"], mask, keep)
        b, cb = self._run(x[::-1], p["wb"], p["ub"], p["bb"], mask[::-1], keep)
        s = np.concatenate([f, b[::-1], x], axis=2)
        z = s @ p["o"] + p["c"][0]
        return (z, s, cf, cb) if keep else z

    def scan(self, x, mask) -> np.ndarray:
        """Logits (T, B) like logits(), holding the states of STEPS steps at most."""
        p, h, n = self.p, HIDDEN, len(x)
        z = x @ p["o"][2 * h :] + p["c"][0]
        for w, u, b, o, order in ((p["wf"], p["uf"], p["bf"], p["o"][:h], range(n)), (p["wb"], p["ub"], p["bb"], p["o"][h : 2 * h], range(n - 1, -1, -1))):
            s, c = np.zeros((x.shape[1], h), np.float32), np.zeros((x.shape[1], h), np.float32)
            for at in range(0, n, STEPS):
                some = order[at : at + STEPS]
                xw = x[some.start : some.stop if some.stop >= 0 else None : some.step] @ w + b
                for k, t in enumerate(some):
                    g = xw[k] + s @ u
                    i, f, q, a = _sigmoid(g[:, :h]), _sigmoid(g[:, h : 2 * h]), _sigmoid(g[:, 2 * h : 3 * h]), np.tanh(g[:, 3 * h :])
                    m = mask[t][:, None]
                    nc = f * c + i * a
                    s, c = m * (q * np.tanh(nc)) + (1 - m) * s, m * nc + (1 - m) * c
                    z[t] += s @ o
        return z

    def fit(self, pages: list, rate: float) -> float:
        """One Adagrad step on pages of (ids, heads, shape, labels); label -1 isn't taught."""
        p, n = self.p, max(len(g[1]) for g in pages)
        x, mask, y = np.zeros((n, len(pages), DIM + SHAPE), np.float32), np.zeros((n, len(pages)), np.float32), np.full((n, len(pages)), -1.0, np.float32)
        for k, (ids, heads, shape, labels) in enumerate(pages):
            x[: len(heads), k], mask[: len(heads), k], y[: len(heads), k] = self.inputs(ids, heads, shape), 1, labels
        z, s, cf, cb = self.logits(x, mask, True)
        known = (y >= 0).astype(np.float32)
        d = known * (_sigmoid(z) - y) / max(1, known.sum())
        loss = (known * (np.logaddexp(0, z) - y * z)).sum() / max(1, known.sum())
        ds = d[:, :, None] * p["o"]
        h, g = HIDDEN, {"o": np.einsum("tb,tbk->k", d, s), "c": np.array([d.sum()], np.float32)}
        dxf, g["wf"], g["uf"], g["bf"] = self._back(ds[:, :, :h], x, p["wf"], p["uf"], cf)
        dxb, g["wb"], g["ub"], g["bb"] = self._back(ds[::-1, :, h : 2 * h], x[::-1], p["wb"], p["ub"], cb)
        dx = dxf + dxb[::-1] + ds[:, :, 2 * h :]
        g["e"] = np.zeros_like(p["e"])
        for k, (ids, heads, _, _) in enumerate(pages):
            counts = np.diff([*heads, len(ids)])
            add_rows(g["e"], ids, np.repeat(dx[: len(heads), k, :DIM] / np.sqrt(counts)[:, None], counts, axis=0))
        for k, v in g.items():
            self.sums[k] += v * v
            p[k] -= rate * v / np.sqrt(self.sums[k])
        return float(loss)


def train(pages: Iterable, seed: int = 1) -> dict | None:
    """Parameters learned from (html,) rows by the teacher's labels; None unless it names blocks of both kinds.

    Each page is read as it is, with all telling names hidden and with shortened paths.
    """
    net, rnd, read, kinds = BiLstm(seed), np.random.default_rng(seed), [], set()
    for (page,) in pages:
        blocks = leaf_blocks(page)
        for at in range(0, len(blocks), WINDOW):
            part = blocks[at : at + WINDOW]
            labels = np.array([-1 if b.said is None else b.said for b in part], np.float32)
            kinds.update(labels.tolist())
            read += [(*block_features(x, at, len(blocks)), labels) for x in (part, hidden(part), shortened(part))]
    if not {0.0, 1.0} <= kinds:
        return None
    for epoch in range(EPOCHS):
        order = rnd.permutation(len(read))
        for at in range(0, len(order), BATCH):
            net.fit([read[i] for i in order[at : at + BATCH]], RATE / (1 + epoch / 3))
    return net.p


def judged(net: BiLstm, pages: list[list[Block]]) -> list[np.ndarray]:
    """Whether each block is main text, for each page's blocks; pages of like length are read together."""
    out = [np.zeros(len(b), bool) for b in pages]
    order = sorted((i for i in range(len(pages)) if pages[i]), key=lambda i: -len(pages[i]))
    while order:
        n = len(pages[order[0]])
        part, order = order[: max(1, CELLS // n)], order[max(1, CELLS // n) :]
        x, mask = np.zeros((n, len(part), DIM + SHAPE), np.float32), np.zeros((n, len(part)), np.float32)
        for k, i in enumerate(part):
            own = pages[i]
            for at in range(0, len(own), STEPS):
                some = own[at : at + STEPS]
                x[at : at + len(some), k], mask[at : at + len(some), k] = net.inputs(*block_features(some, at, len(own))), 1
        z = net.scan(x, mask)
        for k, i in enumerate(part):
            out[i] = z[: len(pages[i]), k] > 0
    return out


def main_texts(net: BiLstm | None, pages: list[str]) -> list[str]:
    """The main blocks' texts of each page, joined by a line feed."""
    blocks = [leaf_blocks(p) for p in pages]
    kept = judged(net, blocks) if net else [np.ones(len(b), bool) for b in blocks]
    return ["\n".join(b.text for b, main in zip(own, y, strict=True) if main) for own, y in zip(blocks, kept, strict=True)]


def sample_pages(pages: DataFrame, limit: int) -> DataFrame:
    """The distinct pages (h) of the `limit` least hashes; only hashes are ordered, so tasks send no pages that aren't used."""
    hashed = pages.withColumn("k", F.xxhash64("h"))
    last = hashed.select("k").distinct().orderBy("k").limit(limit).agg(F.max("k").alias("k")).first().k
    return hashed.filter(F.col("k") <= last).groupBy("k").agg(F.min("h").alias("h")) if last is not None else hashed.limit(0)


def extract(df: DataFrame, html_col: str = "html", sample: int = SAMPLE) -> DataFrame:
    """df without the html, with `text` (main blocks joined by a line feed) and `n_chars`."""
    source = F.coalesce(quoted(html_col), F.lit(""))
    params = learned_in_task(sample_pages(df.select(source.alias("h")), sample), "k", ["h"], train)
    shared = df.sparkSession.sparkContext.broadcast(params)  # of fixed size: the network's parameters

    def work(batches):
        net = None
        if shared.value:
            net = BiLstm.__new__(BiLstm)
            net.p = shared.value
        for batch in batches:
            pages, first, held = [], 0, 0
            for at, page in enumerate(batch.column(batch.num_columns - 1)):
                if held > CHARS or len(pages) == 256:
                    texts = main_texts(net, pages)
                    yield batch.slice(first, at - first), [pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())]
                    pages, first, held = [], at, 0
                pages.append(page.as_py())
                held += len(pages[-1])
            texts = main_texts(net, pages)
            yield batch.slice(first), [pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())]

    keep = [c for c in df.columns if c not in (html_col, "text", "n_chars")]
    return arrow_map(df, keep, [source], [("text", "string"), ("n_chars", "bigint")], work)
