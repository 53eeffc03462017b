"""Functions that no query reaches."""

from datetime import date
from decimal import Decimal as D

from tallyloom import api
from tallyloom.operators import models, reports
from tallyloom.sources import statements

ROWS = "doc_id string, idx long, date date, description string, amount_brl decimal(18,2), category string, currency string, merchant_city string, fx_rate decimal(12,6), card_last4 string"


def made(n):
    return [("d", i, date(2024, 1, 1 + (n - i) % 5), f"{'UBER' if i % 2 else 'PADARIA'} {i}", D(10 + i), "A" if i % 2 else "B", "BRL", "RIO", None, "0001") for i in range(n)]


def test_rows_by_date(spark):
    rows = [*made(8), ("d", 20, None, "x", D(1), "A", "BRL", None, None, None), ("c", 1, date(2025, 1, 1), "x", D(1), "A", "BRL", None, None, None)]
    got = [(r.doc_id, r.date, r.idx) for r in reports.by_date(spark.createDataFrame(rows, ROWS)).collect()]
    assert got == sorted(((x[0], x[2], x[1]) for x in rows), key=lambda x: (x[0], x[1] is not None, x[1] or date.min, x[2]))


def test_text_files_are_whole(spark, tmp_path):
    for name, text in (("a.txt", "one\ntwo\n"), ("b.txt", "")):
        (tmp_path / name).write_text(text)
    assert {(r.doc_id, r.text) for r in statements.read_text(spark, str(tmp_path)).collect()} == {("a.txt", "one\ntwo\n")}


def test_health_check_of_equal_and_spoilt_rows(spark):
    gold = spark.createDataFrame(made(20), ROWS)
    same = api.health_check(gold, gold).first()
    assert (same.overall, same.precision, same.recall, same.f1) == (1, 1, 1, 1)
    spoilt = api.health_check(gold.selectExpr(*["doc_id", "idx", "date", "concat('Z', idx) description", "amount_brl", "category", "currency", "merchant_city", "fx_rate", "card_last4"]), gold).first()
    assert spoilt.overall < 1 and spoilt.description_accuracy == 0 and spoilt.amount_brl_accuracy == 1


def test_second_category_model(spark):
    rows = spark.createDataFrame(made(60), ROWS)
    model = models.train_second(rows, trees=3)
    assert model.stages[-2].getNumTrees == 3 and models.predict_categories(model, rows).filter("predicted = category").count() == 60


def test_benchmark_of_methods(spark):
    history = spark.createDataFrame([("a", 10.0, 0.5), ("a", 30.0, 0.7), ("b", 5.0, None)], "method string, time_ms double, confidence double")
    assert {tuple(r) for r in api.benchmark(history).collect()} == {("a", 2, 20.0, 10.0, 30.0, 0.6), ("b", 1, 5.0, 5.0, 5.0, None)}
