import math
import random
import re
from collections import Counter, defaultdict

from tallyloom.llm import quality

from .cases import DOCS, documents

SETS = [re.compile(f"[{b}]") for b in quality.CLASSES.values()]


def counts(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    seen, spans = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4)), set()
    for i in range(len(words) - 4):
        if seen[tuple(words[i : i + 5])] > 1:
            spans |= set(range(i, i + 5))
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    base = len(words) < 10 or 100 * len(spans) > 20 * len(words)
    return words, (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(spans), base)


def distance(b, r):
    if not sum(b) or not sum(r):
        return 0
    p, q = [x / sum(b) for x in b], [x / sum(r) for x in r]
    term = lambda x, y: x * math.log2(2 * x / (x + y)) if x else 0
    return math.sqrt(max(0, sum(term(x, y) + term(y, x) for x, y in zip(p, q)) / 2))


def brute(rows):
    found = {}
    for i, text, lang, *_ in rows:
        text = text or ""
        words, base = counts(text)
        key = lang if lang in quality.COMMON_WORDS else "other"
        c = [len(s.findall(text)) for s in SETS]
        c += [len(text) - base[1]]
        c += [len(text) - sum(c)]
        w = [words.count(x) for x in quality.COMMON_WORDS.get(key, [])]
        found[i] = key, base, c, w + [len(words) - sum(w)]
    sums = defaultdict(list)
    for key, base, c, w in found.values():
        if not base[5] and base[0] >= quality.REFERENCE_WORDS:
            sums[key].append(([x * quality.PARTS // sum(c) for x in c], [x * quality.PARTS // sum(w) for x in w]))
    refs = {k: [[sum(x) for x in zip(*part)] for part in zip(*v)] for k, v in sums.items()}
    out = {}
    for i, (key, base, c, w) in found.items():
        rc, rw = refs.get(key, ([], []))
        odd = base[0] >= quality.CLASS_WORDS and distance(c, rc) > quality.CLASS_LIMIT
        odd |= base[0] >= quality.HIST_WORDS and distance(w, rw) > quality.WORD_LIMIT + quality.WORD_SLACK / math.sqrt(base[0])
        out[i] = (*base, not base[5] and not odd)
    return out


def test_equals_brute_force(spark):
    rows = documents(120)
    rows += [(1000, " ".join(["a|b ##x"] * 3 + [f"w{i}$$ |" for i in range(90)]), "en", "s", 1)]
    out = quality.quality_rules(spark.createDataFrame(rows, DOCS)).collect()
    got = {r.doc_id: tuple(r[c] for c in quality.FEATURES) + (r.kept,) for r in out}
    assert got == brute(rows)
    assert not got[1000][-1] and sum(v[-1] for v in got.values()) > 60


def test_empty_clashing_and_no_reference(spark):
    assert quality.quality_rules(spark.createDataFrame([], DOCS)).count() == 0
    rows = [(1, " ".join(f"w{i}" for i in range(30)), None, "x")]
    row = quality.quality_rules(spark.createDataFrame(rows, "doc_id long, text string, lang string, kept string")).first()
    assert row.kept is True and row.class_distance is None


def test_odd_column_names(spark):
    rows = [(1, " ".join(f"w{i}" for i in range(30)), None, 2.0)]
    out = quality.quality_rules(spark.createDataFrame(rows, "`a.b` long, text string, lang string, n_words double"))
    row = out.first()
    assert "a.b" in out.columns and row["a.b"] == 1 and row.n_words == 30


def test_counts_of_odd_characters_equal_brute_force(spark):
    r = random.Random(5)
    pools = ["aZ9 .", "az\n\t\x0b ", "ßé漢😀a ", "^]\\[-`~|& ", "\x00\x01\x7f\x80a "]
    rows = [(i, "".join(r.choices(pools[i % 5] + pools[i % 4], k=r.randint(0, 90))), r.choice(["de", "fr", "es", "en", "xx"]), "s", 1) for i in range(150)]
    rows += [(600 + i, " ".join(r.choices([*quality.COMMON_WORDS[k], "fü", "nichts", "in.", "漢"], k=120)), k, "s", 1) for i, k in enumerate(quality.COMMON_WORDS)]
    out = quality.quality_rules(spark.createDataFrame(rows, DOCS)).collect()
    assert {x.doc_id: tuple(x[c] for c in quality.FEATURES) + (x.kept,) for x in out} == brute(rows)


def test_plain_characters_have_no_class():
    assert not any(s.match(chr(c)) for s in [*SETS, re.compile(f"[{quality.SYMBOLS}]")] for c in range(256) if re.match(f"[{quality.PLAIN}]", chr(c)))


def test_work_is_done_once_a_text_or_word(spark):
    """Totals are no part of the distance's terms, word lists are made outside of the words, and characters aren't counted as arrays of matches."""
    found = quality.features(spark.createDataFrame([], DOCS))
    plan = quality.judged(found, quality.references(found))._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp_extract_all" not in plan and "array_contains" not in plan
    assert plan.count("aggregate(") <= 20 and not re.search(r"transform\([^\n]*lambdafunction\([^\n]*aggregate\([^\n]* AS c#", plan) and plan.count("array_join(") == 2
