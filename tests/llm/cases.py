"""Small documents with the awkward cases, shared by the operators' tests."""

import random

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def documents(n=60, seed=5):
    """Rows of `documents`: prose, copies, near copies, empty, null, blank, long and odd texts."""
    rnd = random.Random(seed)
    stems = ["the", "of", "and", "to", "in", "lamp", "river", "stone", "walk", "green", "seven", "éclair", "straße", "naïve", "open"]
    texts = [" ".join(rnd.choice(stems) + rnd.choice(["", "", ".", ",", "s"]) for _ in range(rnd.randint(1, 160))) for _ in range(n)]
    texts += [None, "", " ", "\n\n\t", "one", "one two three", "tab\tand\x0bvt\x0cff\r\nend", " nb em 漢字 😀 é"]
    texts += [texts[0]] * 5 + [texts[1] + " extra"] * 2 + ["same line\n" * 30, "rep eat " * 200]
    texts += [" ".join(rnd.choice(stems) for _ in range(9000)), "x" * 30000]
    langs, sources = ["en", "de", "fr", "es", None, "xx"], ["s0", "s1", "s2", None]
    return [(i, t, langs[i % 6], sources[min(i % 7, 3)], None if t is None else len(t)) for i, t in enumerate(texts)]
