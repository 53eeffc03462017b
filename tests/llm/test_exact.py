import hashlib
import random
import re
from collections import defaultdict

import pytest

from tallyloom.llm import exact

from .cases import DOCS, documents


def brute(rows):
    """Every row's (id, keep_id, group_size, sha256), and the number of kept rows: one for each text."""
    groups = defaultdict(list)
    for i, text, *_ in rows:
        groups[re.sub(r"[\x20\x09-\x0D]", "", text or "")].append((-len(text or ""), i is None, i or 0, i))
    out = []
    for text, held in groups.items():
        keep = min(held)[3]
        out += [(i, keep, len(held), hashlib.sha256(text.encode()).hexdigest()) for *_, i in held]
    return sorted(out, key=str), len(groups)


def check(spark, rows, **how):
    out = exact.exact_duplicates(spark.createDataFrame(rows, DOCS), **how).collect()
    want, n = brute(rows)
    assert sorted([(r.id, r.keep_id, r.group_size, r.text_sha256) for r in out], key=str) == want
    kept = [r for r in out if r.kept]
    assert len(kept) == n == len({r.text_sha256 for r in kept}) and all(r.id == r.keep_id for r in kept)
    return out


def odd_rows():
    rows = documents()
    rows += [(7_000 + i, f"a  b{' ' * (i % 3)} c", "en", "s", 0) for i in range(40)] + [(None, "a b c", "en", "s", 0)] * 2
    rows += [(1, "twice", "en", "s", 0)] * 3 + [(None, "no id", None, None, None)] * 2
    return rows + [(8_000, "nb sp", "en", "s", 0), (8_001, "nbsp", "en", "s", 0), (8_002, "\x1cx", "en", "s", 0), (8_003, "x", "en", "s", 0), (8_004, "X", "en", "s", 0)]


def test_equals_brute_force(spark):
    check(spark, odd_rows())


@pytest.mark.parametrize("bits", [8, 0])
def test_collisions_are_told_apart_by_bytes(spark, bits):
    check(spark, odd_rows(), bits=bits)


def test_hot_groups(spark, monkeypatch):
    monkeypatch.setattr(exact, "HOT", 4)
    rnd = random.Random(3)
    rows = [(i, rnd.choice(["hot  text", "hottext", "ho ttext", f"own {i}", f"pair {i // 2}"]), "en", "s", 0) for i in range(900)]
    check(spark, rows)
    check(spark, rows, bits=8)


def test_carry_and_clashing_names(spark):
    df = spark.createDataFrame([(1, "a b", 5, "k", b"x"), (2, "ab", 6, "l", b"y")], "`doc.id` long, text string, row long, key string, cls binary")
    out = exact.exact_duplicates(df, "doc.id", carry=["row", "key", "cls", "doc.id"]).collect()
    assert {(r.id, r.keep_id, r.kept, r.carried.row, r.carried.key, r.carried["doc.id"]) for r in out} == {(1, 1, True, 5, "k", 1), (2, 1, False, 6, "l", 2)}
    first = exact.exact_duplicates(df.selectExpr("3 - `doc.id` as doc_id", "text"), longest=False).collect()
    assert {(r.id, r.keep_id) for r in first} == {(1, 1), (2, 1)}


def test_empty_and_long(spark):
    assert exact.exact_duplicates(spark.createDataFrame([], DOCS)).count() == 0
    long = "word é " * 300_000
    check(spark, [(5, long, "en", "s", 0), (4, long.replace(" ", "\n"), "en", "s", 0), (3, long + "x", "en", "s", 0), (2, None, None, None, None), (9, " \t", None, None, None)])
