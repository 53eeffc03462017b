import random
from datetime import date, timedelta
from decimal import Decimal
from functools import partial

import pytest

from tallyloom.functions import alike
from tallyloom.operators import linkage, quality, rounds

SCHEMA = "doc_id string, idx long, date date, description string, amount_brl decimal(18,2), category string, currency string"


def rows(n, seed):
    r = random.Random(seed)
    words = ["UBER", "PADARIA", "LOJA", "CASA", "X"]
    return [(f"d{r.randint(0, 2)}", i, date(2024, 1, 1) + timedelta(r.randint(0, 6)), " ".join(r.sample(words, 2)), Decimal(r.randint(100, 106)) / 100, r.choice(["A", "B"]), "BRL") for i in range(n)]


def test_near_classes_equal_all_pairs(spark):
    a, b = rows(60, 1), rows(50, 2)
    got = linkage.near_classes(spark.createDataFrame(a, SCHEMA), spark.createDataFrame(b, SCHEMA)).collect()
    near = [(x, y) for x in a for y in b if x[0] == y[0] and abs((x[2] - y[2]).days) <= 1 and abs(x[4] - y[4]) <= Decimal("0.01")]
    assert sum(r.l.n * r.r.n for r in got) == len(near)
    assert {(r.doc_id, r.l.date, r.l.cents, r.r.date, r.r.cents) for r in got} == {(x[0], x[2], int(x[4] * 100), y[2], int(y[4] * 100)) for x, y in near} and len(got) < len(near)


def test_rows_without_date_or_amount_are_their_own_leaders(spark):
    found = [("d", 1, None, "A", Decimal("1.00"), "A", "BRL"), ("d", 2, None, "A", Decimal("1.00"), "A", "BRL"), ("d", 3, date(2024, 1, 1), "A", None, "A", "BRL")]
    assert {r.idx: r.leader for r in linkage.leader_clusters(spark.createDataFrame(found, SCHEMA), "idx").collect()} == {1: 1, 2: 2, 3: 3}


def test_fuzzy_merge_keeps_the_surest_of_each_cluster(spark):
    r = random.Random(9)
    found = [(*x, r.choice([0.5, 0.7, 0.9])) for x in rows(200, 8)]
    got = {x.idx for x in linkage.fuzzy_merge(spark.createDataFrame(found, SCHEMA + ", confidence double"), "idx").collect()}
    clusters: list = []
    for x in found:
        for c in clusters:
            y = c[0]
            if (x[0], x[2], x[4]) == (y[0], y[2], y[4]) and linkage.token_set_ratio(x[3], y[3]) >= 90:
                c.append(x)
                break
        else:
            clusters.append([x])
    assert got == {max(c, key=lambda x: x[-1])[1] for c in clusters} and len(got) < 190


def fitted(golden, found, within):
    used, out = set(), set()
    for g in sorted(golden, key=lambda x: x[1]):
        for f in sorted(found, key=lambda x: x[1]):
            if f[1] not in used and (g[0], g[2]) == (f[0], f[2]) and abs(g[4] - f[4]) <= within:
                used.add(f[1])
                out.add((g[0], g[1], f[1]))
                break
    return out


def test_first_fit_equals_the_sequential_rule(spark):
    golden, found = rows(120, 11), [(x[0], x[1] + 500, *x[2:]) for x in rows(140, 12)]
    df = lambda x: spark.createDataFrame(x, SCHEMA)
    assert {tuple(r) for r in linkage.first_fit(df(golden), df(found), "idx").collect()} == fitted(golden, found, Decimal("0.05"))
    assert linkage.first_fit(df(golden).limit(0), df(found), "idx").count() == 0


def test_similarity_floor_never_hides_a_match():
    r = random.Random(4)
    for _ in range(400):
        a, b = (" ".join("".join(r.choice("abc") for _ in range(r.randint(1, 5))) for _ in range(r.randint(0, 4))) for _ in range(2))
        assert (linkage.token_set_ratio(a, b, 70) >= 70) == (linkage.token_set_ratio(a, b) >= 70)


def test_the_first_alike_of_many_is_that_of_one_by_one():
    r = random.Random(21)
    word = lambda: "".join(r.choice("abcdeé😀") for _ in range(r.randint(1, 9)))
    for least in (50.0, 70.0, 90.0):
        texts = [" ".join(word() for _ in range(r.randint(0, 4))) for _ in range(250)] + ["x" * 64, "x" * 65, "x" * 63 + "y", "y" * 70, "", "\0 a"]
        r.shuffle(texts)
        leaders, held = alike.Leaders(least), []
        for i, text in enumerate(texts):
            want = next((k for k, other in held if alike.ratio(alike.Words(text), alike.Words(other)) >= least), None)
            assert leaders.first(alike.Words(text)) == want
            if want is None or i % 3 == 0:
                leaders.add(i, alike.Words(text))
                held.append((i, text))


def test_leader_clusters_equal_the_sequential_rule(spark):
    found = rows(150, 3)
    got = {r.idx: r.leader for r in linkage.leader_clusters(spark.createDataFrame(found, SCHEMA), "idx").collect()}
    leaders, want = [], {}
    for x in sorted(found, key=lambda r: r[1]):
        for y in leaders:
            if x[0] == y[0] and abs((x[2] - y[2]).days) <= 1 and abs(x[4] - y[4]) <= Decimal("0.01") and linkage.token_set_ratio(x[3], y[3]) >= 70:
                want[x[1]] = y[1]
                break
        else:
            leaders.append(x)
            want[x[1]] = x[1]
    assert got == want


@pytest.mark.parametrize("head,dealt", [(3, 4), (40, 7)])
def test_leader_rounds_equal_the_stream(spark, monkeypatch, head, dealt):
    """One date and amount with many descriptions, among others; heads and shares of any size."""
    monkeypatch.setattr(rounds, "leader_rounds", partial(rounds.leader_rounds, head=head, dealt=dealt))
    r = random.Random(head)
    word = lambda: "".join(r.choice("abcde") for _ in range(r.randint(2, 6)))
    same = [("d0", i, date(2024, 1, 1), f"{word()} {word()}", Decimal("5.00"), "A", "BRL") for i in range(60)]
    found = [*same, *[(d, i + 100, *rest) for d, i, *rest in rows(60, 6)], ("d0", 900, None, "A", Decimal("5.00"), "A", "BRL"), ("d0", 901, date(2024, 1, 1), None, Decimal("5.00"), "A", "BRL")]
    df = spark.createDataFrame(found, SCHEMA)
    want = {x.idx: x.leader for x in linkage.leader_clusters(df, "idx").collect()}
    got = {x.idx: x.leader for x in linkage.leader_clusters(df, "idx", held=5).collect()}
    assert got == want and 2 < len({want[i] for i in range(60)}) < 60


def test_greedy_rounds_push_out_later_rows(spark):
    """Chains: every row wants the same few, so rounds push later ones out again and again."""
    r = random.Random(13)
    make = lambda n, at, seed: [("d", at + i, date(2024, 1, 1 + i % 3), "UBER SUL" if i % 2 else "UBER", Decimal(r.randint(1000, 1100)) / 100, "A", "BRL") for i in range(n)]
    a, b = make(40, 0, 1), make(30, 500, 2)
    a += [("d", 300, date(2024, 1, 1), None, Decimal("0.00"), "A", "BRL"), ("d", 301, date(2024, 1, 2), "", Decimal("0.00"), "A", "BRL"), ("e", 302, None, "X", Decimal("1.00"), "A", "BRL"), ("d", 303, date(2024, 1, 1), "X", None, "A", "BRL")]
    b += [("d", 700, date(2024, 1, 3), "", Decimal("0.00"), "A", "BRL"), ("d", 701, date(2024, 1, 1), "NEG", Decimal("-7.00"), "A", "BRL")]
    found = [{tuple(x) for x in linkage.greedy_match(spark.createDataFrame(a, SCHEMA), spark.createDataFrame(b, SCHEMA), "idx", held=n).collect()} for n in (1000, 0)]
    assert found[0] == found[1] and len(found[0]) > 25


def test_token_set_ratio():
    assert linkage.token_set_ratio("a b", "b a c") == 100
    assert linkage.token_set_ratio("", "a") == 0
    assert 0 < linkage.token_set_ratio("padaria sul", "padaria sol") < 100


def test_a_table_agrees_with_itself(spark):
    df = spark.createDataFrame(rows(80, 4), SCHEMA)
    assert all((r.precision, r.recall, r.f1) == (1, 1, 1) for r in quality.prf(df, df).collect())
    assert all(r.accuracy == 1 for r in quality.cells(df, df, "idx").collect())
    assert linkage.union_antidup(df, df).count() == 80


def test_resolve_ties_take_the_first(spark):
    groups = spark.createDataFrame([("d", 1, i, 0.9, 0.9, e) for i, e in enumerate(["azure", "textract", "textract"])], "doc_id string, leader long, idx long, confidence double, pipeline_confidence double, extractor string")
    row = linkage.resolved(groups).first()
    assert (row.idx, row.conflicts) == (1, 2)


def greedy_by_force(a, b, least):
    """The reference's rule: equal rows first, then each row of a in order takes the best row of b left."""
    key = lambda x: (x[0], x[2], frozenset(x[3].lower().split()), x[4])
    first, second = {}, {}
    for rows_of, into in ((a, first), (b, second)):
        for x in sorted(rows_of, key=lambda r: r[1]):
            into[key(x)] = x[1]
    out = {(first[k], second[k], 1.0) for k in first if k in second}
    left = {k: i for k, i in second.items() if k not in first}
    for k in [k for k in first if k not in second]:
        best, most = None, 0
        for other in left:
            if other[0] == k[0]:
                amount = 1 - float(abs(k[3] - other[3])) / float(max(abs(k[3]), abs(other[3])))
                score = round(0.3 * max(0, 1 - abs((k[1] - other[1]).days) / 7) + 0.4 * max(0, amount) + 0.3 * len(k[2] & other[2]) / len(k[2] | other[2]), 9)
                if score >= least and score > most:
                    best, most = other, score
        if best:
            out.add((first[k], left.pop(best), most))
    return out


def test_greedy_match_equals_brute_force(spark):
    r = random.Random(7)
    a = [(d, i, day, " ".join(sorted(words.split())), amount * r.choice([1, 1, 1, 30, -1]), c, m) for d, i, day, words, amount, c, m in rows(120, 5)]
    off = lambda i: (timedelta(i % 3 == 0), Decimal("0.01") * (i % 5 == 0))  # noqa: E731  a day later, a cent off
    b = [(d, i + 1000, day + off(i)[0], words, amount + off(i)[1], c, m) for d, i, day, words, amount, c, m in a if i % 7] + [(d, i + 2000, day, " ".join(sorted(words.split())), amount, c, m) for d, i, day, words, amount, c, m in rows(30, 6)]
    for least in (0.8, 0.7, 0.55, 0.95):
        for held in (20_000, 0) if least in (0.8, 0.55) else (20_000,):
            found = linkage.greedy_match(spark.createDataFrame(a, SCHEMA), spark.createDataFrame(b, SCHEMA), "idx", least, held).collect()
            assert {(x.a_id, x.b_id, x.score) for x in found} == greedy_by_force(a, b, least), (least, held)
            assert len(found) == len({x.a_id for x in found}) == len({x.b_id for x in found})


def test_greedy_match_grades_date_and_amount(spark):
    one = [("d", 1, date(2024, 1, 1), "PADARIA SUL", Decimal("10.00"), "A", "BRL"), ("d", 2, date(2024, 1, 1), "UBER", Decimal("50.00"), "A", "BRL")]
    two = [("d", 1, date(2024, 1, 2), "PADARIA SUL", Decimal("10.00"), "A", "BRL"), ("d", 2, date(2024, 1, 1), "UBER", Decimal("50.01"), "A", "BRL")]
    found = linkage.greedy_match(spark.createDataFrame(one, SCHEMA), spark.createDataFrame(two, SCHEMA), "idx").collect()
    assert {(r.a_id, r.b_id, round(r.score, 3)) for r in found} == {(1, 1, 0.957), (2, 2, 1.0)}
