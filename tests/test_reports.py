import random
from datetime import date, timedelta
from decimal import Decimal as D

import pytest
from pyspark.sql import functions as F

from tallyloom.operators import quality, reports

from .test_linkage import fitted, greedy_by_force

SCHEMA = "doc_id string, idx long, date date, description string, amount_brl decimal(18,2), category string"


def rows(n, seed, docs=3):
    r = random.Random(seed)
    words = ["UBER TRIP", "PADARIA SOL", "LOJA", "CASA BELA", "X"]
    return [(f"d{r.randrange(docs)}", i, date(2024, 1, 1) + timedelta(r.randint(0, 5)), r.choice(words), D(r.randint(100, 130)) / 100, r.choice(["A", "B", ""])) for i in range(n)]


def test_semantic_report_counts(spark):
    a, b = rows(50, 1), rows(45, 2)
    df = lambda x: spark.createDataFrame(x, SCHEMA)
    out = {r.doc_id: r for r in reports.semantic_report(df(a), df(b), least=0.8).collect()}
    doc_of = {x[1]: x[0] for x in a}
    pairs = [doc_of[p[0]] for p in greedy_by_force(a, b, 0.8)]
    for doc, r in out.items():
        mine, other = [x for x in a if x[0] == doc], [x for x in b if x[0] == doc]
        tp = pairs.count(doc)
        norm = lambda rows: {(x[2], x[3].lower(), x[4]) for x in rows}
        assert (r.tp, r.fp, r.fn) == (tp, len(norm(mine)) - tp, len(norm(other)) - tp)
        assert r.count_match == (len(mine) == len(other)) and abs(r.difference - float(abs(sum(x[4] for x in mine) - sum(x[4] for x in other)))) < 1e-9
    same = reports.semantic_report(df(a), df(a)).collect()
    assert all(r.valid and (r.precision, r.recall, r.f1, r.cell_accuracy) == (1, 1, 1, 1) for r in same)


def test_empty_sides(spark):
    df = lambda x: spark.createDataFrame(x, SCHEMA)
    row = [("d", 1, date(2024, 1, 1), "A", D("1.00"), "")]
    (r,) = reports.semantic_report(df(row), df([])).collect()
    assert (r.tp, r.fp, r.fn, r.precision, r.recall, r.f1) == (0, 1, 0, 0.0, 1.0, 0.0)
    (r,) = reports.semantic_report(df(row), df([("d", 1, date(2023, 1, 1), "B", D("9.00"), "")]), f1_empty=1.0).collect()
    assert r.f1 == 1.0 and not r.valid
    assert reports.semantic_report(df([]), df([])).count() == 0


def test_error_analysis_by_force(spark):
    golden, found = rows(60, 3), [(x[0], x[1] + 100, *x[2:]) for x in rows(55, 4)]
    df = lambda x: spark.createDataFrame(x, SCHEMA)
    made = reports.error_analysis(df(golden), df(found), fields=["description", "category"])
    pairs = fitted(golden, found, D("0.05"))
    g, f = {x[1]: x for x in golden}, {x[1]: x for x in found}
    right = {c: sum(g[p[1]][k].strip().lower() == f[p[2]][k].strip().lower() for p in pairs) for c, k in (("description", 3), ("category", 5))}
    assert {r.field: (r.total, r.correct) for r in made["report"].collect()} == {c: (len(pairs), n) for c, n in right.items()}
    assert made["mismatches"].count() == 2 * len(pairs) - sum(right.values())
    assert {r.idx for r in made["missing"].collect()} == set(g) - {p[1] for p in pairs} and {r.idx for r in made["extra"].collect()} == set(f) - {p[2] for p in pairs}
    better = reports.before_after(df(golden), df(found), df([(*x[:5], "A") for x in found]), fields=["category"]).first()
    assert better.before == round(right["category"] / len(pairs), 6) and better.after == round(sum(g[p[1]][5] == "A" for p in pairs) / len(pairs), 6)


def test_comparators():
    assert set(quality.COMPARATORS) < set(quality.FIELDS) and set(quality.CRITICAL) < set(quality.FIELDS)


def test_cells_compare_by_field(spark):
    schema = "doc_id string, idx long, date date, description string, amount_brl decimal(18,2), category string, currency string, merchant_city string, fx_rate decimal(12,6), card_last4 string"
    day = date(2024, 1, 1)
    found = [("d", 1, day, "supermercado loja alfa", D("1.00"), "a", "BRL", "SAO PAULO", D("5"), None)]
    gold = [("d", 1, day, "supermercado loja alfa sao paulo", D("1.00"), "A", "USD", "SAO PAULO SP", D("5.005"), None), ("d", 2, day, "x", D("2.00"), "A", None, None, None, None)]
    out = {r.field: r for r in quality.cells(spark.createDataFrame(found, schema), spark.createDataFrame(gold, schema), "idx").collect()}
    assert {f for f, r in out.items() if r.correct} == {"date", "amount_brl", "description", "category", "merchant_city", "fx_rate", "card_last4"}
    assert out["currency"].examples == ["Expected: USD, Got: BRL", "Missing: -"] and out["date"].total == 2 and out["date"].missing == 1
    report = quality.health(quality.cells(spark.createDataFrame(found, schema), spark.createDataFrame(gold, schema), "idx")).first()
    assert report.grade == "D" and report.critical == 0.5 and report.advice.startswith("Poor performance. Major issues with: currency (0.0%)")


def test_batch_by_keys_and_suite(spark):
    a = rows(20, 5, 1)
    found = spark.createDataFrame([("My_Stmt", *x[1:]) for x in a], SCHEMA).unionByName(spark.createDataFrame([("none", *a[0][1:])], SCHEMA))
    golden = spark.createDataFrame([("my_stmt.pdf", *x[1:]) for x in a], SCHEMA)
    out = reports.validate_batch(found, golden).collect()
    assert [(r.doc_id, r.valid) for r in out] == [("My_Stmt", True)]
    suite = quality.suite(quality.expectations(found.withColumn("confidence", F.lit(0.5)).select("doc_id", "date", "description", "amount_brl", "category", "confidence"), categories=["A", "B"]))
    assert {r.doc_id: (r.success, r.evaluated, r.failures) for r in suite.collect()} == {"My_Stmt": (True, 14, ""), "none": (True, 14, "")}
    both = {r.doc_id: (r.ok, r.golden_ok) for r in reports.combined(suite, reports.validate_batch(found, golden)).collect()}
    assert both == {"My_Stmt": (True, True), "none": (True, None)}
    odd = found.select("doc_id", "description", "date", "amount_brl", "category").withColumn("confidence", F.lit(2.0))
    assert {r.failures for r in quality.suite(quality.expectations(odd, categories=["Z"])).filter("doc_id = 'My_Stmt'").collect()} == {"columns,category_in_set,confidence_between"}
    assert not quality.gate(odd).filter("ok").count()


def test_before_after_of_columns_equals_that_of_tables(spark, monkeypatch):
    golden, found = rows(60, 3), [(x[0], x[1] + 100, *x[2:]) for x in rows(55, 4)]
    df = lambda x: spark.createDataFrame(x, SCHEMA)
    new = {"category": F.when(F.col("idx") % 2 == 0, "A").otherwise(F.col("category"))}
    want = {tuple(r) for r in reports.before_after(df(golden), df(found), df(found).withColumns(new), fields=["category", "description"]).collect()}
    calls, fit = [], reports.linkage.first_fit
    monkeypatch.setattr(reports.linkage, "first_fit", lambda *a: calls.append(a) or fit(*a))
    got = reports.before_after(df(golden), df(found), new, fields=["category", "description"])
    assert {tuple(r) for r in got.collect()} == want and len(want) == 2 and len(calls) == 1
    assert reports.before_after(df([]), df(found), new).count() == 0
    with pytest.raises(ValueError):
        reports.before_after(df(golden), df(found), {"date": F.current_date()})


def test_first_fit_streams_only_blocks_with_a_choice(spark, monkeypatch):
    day, streamed, run = date(2024, 1, 1), [], reports.linkage._in_blocks
    monkeypatch.setattr(reports.linkage, "_in_blocks", lambda d, *a: streamed.append(d.count()) or run(d, *a))
    side = lambda x: spark.createDataFrame([("d", i, day, "A", D(a), "") for i, a in x], SCHEMA)
    golden, found = side([(1, "1.00"), (2, "5.00"), (3, "9.00"), (4, "20.00")]), side([(11, "1.05"), (12, "5.00"), (13, "5.04"), (14, "30.00")])
    assert {tuple(r) for r in reports.linkage.first_fit(golden, found, "idx").collect()} == {("d", 1, 11), ("d", 2, 12)} and streamed == [3]
