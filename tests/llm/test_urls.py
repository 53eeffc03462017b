import random
import re
import time
from collections import Counter
from itertools import combinations

import pytest

from tallyloom.llm import urls

RULES = [("org/", "allow"), ("example.org/es/", "block"), ("example.org/en/1", "block"), ("com/fr/", "allow"), ("com/de/", "block")]


def brute(url):
    rest = (url or "").split("://", 1)[1] if "://" in (url or "") else ""
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in re.match(r"[^/?#]*", rest)[0])
    path = re.match(r"[^?#]*", rest[len(host) :])[0]
    best = ("", None)
    for rule, verdict in RULES:
        own, start = rule.split("/", 1)
        if (host == own or host.endswith("." + own)) and path.startswith("/" + start) and len(rule) > len(best[0]):
            best = rule, verdict
    return host, path, best[0] or None, best[1]


def table(spark, found):
    return spark.createDataFrame(list(enumerate(found)), "page_id long, url string")


def test_hosts_paths_and_listed_rules(spark):
    found = [None, "", "no scheme", "http://", "https://Example.ORG/es/5?x=1", "https://a.example.org/en/12#t", "http://org", "http://x.org/?q"]
    found += [f"https://{h}.{d}/{p}/{i}.html?u=a://b" for h in ("www.a", "b", "notexample") for d in ("example.org", "e.com", "z.net") for p in ("en", "es", "fr", "de") for i in (1, 20)]
    found += ["http://borg/x", "http://A.B.com/de/?q", "http://a.com?x/de/", "x://y://z/p"]
    out = urls.url_filter(table(spark, found), RULES).collect()
    assert len(out) == len(found)
    for r in out:
        host, path, rule, verdict = brute(r.url)
        assert (r.host, r.path, r.rule) == (host, path, rule), r.url
        assert r.verdict == verdict if verdict else r.verdict in ("allow", "block")
        assert host or r.verdict == urls.DEFAULT


def test_mined_rules_equal_brute_force(spark):
    rows = [(["a", "b"], "block")] * 6 + [(["a"], "allow")] * 5 + [(["b", "c"], "block")] * 4 + [(["c"], "allow")] * 4
    labelled = spark.createDataFrame(rows, "tokens array<string>, verdict string")
    got = {(tuple(r.antecedent), r.verdict) for r in urls.mined_rules(labelled, 0.1, 0.9).collect()}
    want = set()
    for antecedent in (("a",), ("b",), ("c",), ("a", "b"), ("b", "c")):
        has = [v for t, v in rows if set(antecedent) <= set(t)]
        for v in ("allow", "block"):
            if has.count(v) >= 0.1 * len(rows) and has.count(v) >= 0.9 * len(has):
                want.add((antecedent, v))
    assert got == want
    kept = {(tuple(r.antecedent), r.verdict) for r in urls.pruned(urls.mined_rules(labelled, 0.1, 0.9)).collect()}
    assert kept == {(("b",), "block")}
    sets = spark.createDataFrame([("1", ["b", "x"], 1), ("2", ["a"], 1), ("3", ["b"], 9)], "key string, tokens array<string>, seen long")
    out = urls.matched(sets, urls.pruned(urls.mined_rules(labelled, 0.1, 0.9))).collect()
    assert {(r.key, r.seen, r.mined) for r in out} == {("1", 1, "block"), ("3", 9, "block")}


def test_method_decides_and_empty(spark):
    found = [f"http://s{i}.bad.com/de/{i}" for i in range(30)] + [f"http://s{i}.x.com/fr/{i}" for i in range(30)] + ["http://q.net/de/1", "http://q.net/fr/1"]
    out = {r.url: r.verdict for r in urls.url_filter(table(spark, found), RULES).collect()}
    assert (out["http://q.net/de/1"], out["http://q.net/fr/1"]) == ("block", "allow")
    assert urls.url_filter(table(spark, []), RULES).count() == 0


def url_tokens(host, path):
    if not host:
        return frozenset()
    labels = [f"l{min(i, 3)}={x}" for i, x in enumerate(host.split(".")[::-1])]
    parts = [f"p{min(i, 3)}={re.sub('[0-9]+', '#', x)}" for i, x in enumerate([x for x in path.split("/") if x])]
    return frozenset([f"h={host}", *labels, *parts])


def verdicts(found, support, confidence):
    """Every token combination of the labelled urls is tried as a rule."""
    parsed = [brute(u) for u in found]
    labelled = [(url_tokens(h, p), v) for h, p, rule, v in parsed if rule]
    seen = Counter(c for t, _ in labelled for n in range(1, len(t) + 1) for c in combinations(sorted(t), n))
    hits = Counter((c, v) for t, v in labelled for n in range(1, len(t) + 1) for c in combinations(sorted(t), n))
    least = support * len(labelled)
    rules = {(c, v): (n / seen[c], n / len(labelled)) for (c, v), n in hits.items() if n >= least and n / seen[c] >= confidence}
    kept = {k: x for k, x in rules.items() if not any(set(c) < set(k[0]) and v == k[1] and y[0] >= x[0] for (c, v), y in rules.items())}
    out = []
    for host, path, rule, verdict in parsed:
        mine = url_tokens(host, path)
        fits = [(x, len(c), v) for (c, v), x in kept.items() if set(c) <= mine] if not rule else []
        top = max((f[:2] for f in fits), default=None)
        out.append({verdict} if rule else {f[2] for f in fits if f[:2] == top} or {urls.DEFAULT})
    return out


@pytest.mark.parametrize("hot", [200, 3])
def test_whole_verdicts_equal_brute_force(spark, monkeypatch, hot):
    monkeypatch.setattr(urls, "HOT", hot)
    rnd = random.Random(6)
    hosts, ways = ["a.org", "b.example.org", "c.com", "shop.d.com", "e.net", "news.f.net"], ["es", "en", "fr", "de", "es/shop", "de/shop", "blog"]
    found = [f"http://{rnd.choice(hosts)}/{rnd.choice(ways)}/{rnd.choice([1, 25, 'x'])}" for _ in range(220)] + ["http://e.net/de/shop/1"] * 90 + [None, "x", "http://"]
    rnd.shuffle(found)
    rows = spark.createDataFrame([(i, u, "old", {"k": 1}) for i, u in enumerate(found)], "`page.id` long, url string, verdict string, m map<string,int>")
    out = urls.url_filter(rows, RULES, support=0.02, confidence=0.8).collect()
    want = verdicts(found, 0.02, 0.8)
    assert sorted(r["page.id"] for r in out) == list(range(len(found)))
    assert all(r.verdict in want[r["page.id"]] for r in out)
    assert sum(len(w) == 1 for w in want) > 250 and {"allow", "block"} == {r.verdict for r in out if r.rule is None}


def test_very_long_urls_and_repeats(spark):
    long = "http://e.net/" + "/".join(f"p{i}" for i in range(3000))
    out = urls.url_filter(table(spark, [long, long, "http://a.org/" + "x" * 100_000]), RULES).collect()
    assert len(out) == 3 and {r.verdict for r in out} == {"allow"}


@pytest.mark.parametrize("seed", range(3))
def test_minimal_rules_equal_pruned_ones_of_every_combination(spark, tmp_path, seed):
    """Over few rows, where any combination is frequent: the same rules, each class of tokens named by its first."""
    rnd = random.Random(seed)
    rows = [(sorted({rnd.choice("abcdefgh") for _ in range(rnd.randint(1, 6))} | {"always"}), rnd.choice(["allow", "block", "block"])) for _ in range(40)]
    rows += [(r[0] + ["x", "y"], r[1]) for r in rows[:9]] + [(["solo", "solo2", "solo3"], "allow"), ([], "block")]
    labelled = spark.createDataFrame(rows, "tokens array<string>, verdict string")
    having = {t: frozenset(i for i, (own, _) in enumerate(rows) if t in own) for own, _ in rows for t in own}
    cls = {t: min(u for u in having if having[u] == mine) for t, mine in having.items()}
    for support, confidence in ((0.001, 0.6), (0.1, 0.5)):
        found, classes = urls.minimal_rules(labelled, support, confidence, f"{tmp_path}/{support}")
        got = {(tuple(r.antecedent), r.verdict): (r.confidence, r.support) for r in found.collect()}
        plain = {(tuple(r.antecedent), r.verdict): (r.confidence, r.support) for r in urls.pruned(urls.mined_rules(labelled, support, confidence)).collect()}
        assert got == {k: v for k, v in plain.items() if all(cls[t] == t for t in k[0])}
        assert {(tuple(sorted(cls[t] for t in a)), v) for a, v in plain} == {(tuple(sorted(a)), v) for a, v in got}
        assert all(cls[r.token] == r.cls for r in classes.collect())


def test_long_labelled_urls_end_soon(spark):
    """A labelled url of 3,000 parts, alone, in one row of a hundred, and under both verdicts."""
    long = lambda host, way: f"http://{host}/{way}/" + "/".join(f"p{i}" for i in range(3000))
    short = [f"http://s{i % 7}.{'bad.com/de' if i % 2 else 'x.org/fr'}/{i}" for i in range(600)]
    found = [long("a.org", "x")] + [long("b.org", "y")] * 6 + [long("c.com", "de")] * 6 + short + ["http://q.net/p0/p1/p2/p7", "http://q.net/de/1", long("d.net", "z"), None]
    began = time.time()
    out = {(r.url or ""): r.verdict for r in urls.url_filter(table(spark, found), RULES).collect()}
    assert time.time() - began < 60 and len(out) == len(set(found))
    assert (out[long("a.org", "x")], out[long("c.com", "de")], out["http://q.net/de/1"], out[""]) == ("allow", "block", "block", "allow")
    eleven = "http://a.org/" + "/".join(f"k{i}" for i in range(11))
    assert [r.verdict for r in urls.url_filter(table(spark, [eleven, "http://q.net/" + "/".join(f"k{i}" for i in range(3))]), RULES).collect()] == ["allow", "allow"]
