from datetime import date
from decimal import Decimal as D

from pyspark.sql import functions as F

from tallyloom import api
from tallyloom.operators import models

LINES = "doc_id string, line_no int, line string"


def test_parse_validate_mint(spark):
    text = ["03/10 PADARIA SOL 12,00", "04/10 UBER TRIP 1.234,56", "nada", "05/10/2024 Loja R$ 5,00"]
    lines = spark.createDataFrame([("d", i, x) for i, x in enumerate(text)], LINES)
    out = api.parse_statements(lines).orderBy("idx").collect()
    assert [(r.idx, r.amount_brl, r.conflicts) for r in out] == [(0, D("12.00"), 1), (1, D("1234.56"), 1), (3, D("5.00"), 1)]
    golden = spark.createDataFrame([("d", 0, date(2024, 10, 3), "PADARIA SOL", D("12.00"), ""), ("d", 1, date(2024, 10, 4), "UBER TRIP", D("1234.56"), "")], "doc_id string, idx long, date date, description string, amount_brl decimal(18,2), category string")
    found = spark.createDataFrame(out).select("doc_id", "idx", "date", "description", F.col("amount_brl").cast("decimal(18,2)").alias("amount_brl"), "category")
    row = api.validate(found, golden).first()
    assert (row.tp, row.fp, row.fn, row.passed) == (2, 1, 0, False)
    scores = spark.createDataFrame([("d", 0.9)], "doc_id string, confidence double")
    assert api.mint_golden(found, scores).count() == 0 and api.mint_golden(found, scores, approved=scores).count() == 3
    assert [r.idx for r in api.search(found, "uber Trip").collect()] == [1] and api.list_golden(golden).first().rows == 2


def test_robust_retries_and_batch(spark):
    lines = spark.createDataFrame([("a", 0, "03/10 PADARIA SOL 12,00"), ("b", 0, "03/10 VALOR da PADARIA R$ 12,00"), ("c", 0, "nada")], LINES)
    assert {(r.doc_id, r.method, r.confidence) for r in api.robust(lines).collect()} == {("a", "pipeline", 0.95), ("b", "fallback", 0.3)}
    assert {(r.doc_id, r.extractor) for r in api.with_retries(lines).collect()} == {("a", "pipeline"), ("b", "lines")}
    row = api.batch(lines).first()
    assert (row.documents, row.successful, row.rows) == (3, 2, 2)
    failed = api.extraction_runs(api.run_all(lines, ["pipeline", "missing"])).collect()
    assert {(r.doc_id, r.extractor, r.success) for r in failed} == {("a", "pipeline", True), ("a", "missing", False), ("b", "missing", False), ("c", "missing", False)}


def test_printed_rows_are_read_back(spark):
    """Rows as a statement prints them, every tenth with a foreign amount before its own."""
    made = [("d", i, date(2024, 1 + i % 12, 1 + i % 28), f"SHOP {chr(65 + i % 26)} TOWN", D(1234 + 37 * i) / 100) for i in range(150)]
    money = lambda x: f"{x:,.2f}".translate(str.maketrans(",.", ".,"))
    lines = [(d, i, f"{day:%d/%m} {text} {money(x / 5) + ' ' if i % 10 == 0 else ''}{money(x)}") for d, i, day, text, x in made]
    found = {tuple(r) for r in api.pipeline(spark.createDataFrame(lines, "doc_id string, line_no long, line string")).select("doc_id", "idx", "date", "description", "amount_brl").collect()}
    assert found == set(made)


def test_models(spark, tmp_path):
    rows = [(i, f"{w} {i % 7}", w, "RIO" if i % 2 else "SP") for i, w in enumerate(["UBER", "PADARIA", "CASA"] * 40)]
    df = spark.createDataFrame(rows, "idx long, description string, category string, merchant_city string")
    small = {"trees": 5, "words": 50, "depth": 4}
    model = models.saved(models.train_categories(df, **small), f"{tmp_path}/m")
    assert models.predict_categories(model, df).filter("predicted = category").count() == 120
    assert {t for t, _ in models.importances(model, 3)} <= {"uber", "padaria", "casa", *(f"{w} {k}" for w in ("uber", "padaria", "casa") for k in range(7))}
    assert models.held_out_accuracy(df, "idx", **small) > 0.9 and len(models.cross_validated(df, "idx", 2, **small)) == 2
    both = models.predict_outputs(models.train_outputs(df, ["category", "merchant_city"], **small), df)
    assert {"predicted_category", "predicted_merchant_city"} <= set(both.columns)
    empty = df.withColumns({"category": F.when(F.col("idx") % 2 == 0, F.col("category")).otherwise(""), "confidence": F.lit(0.5), "currency": F.lit("USD"), "fx_rate": F.lit(0).cast("decimal(12,6)"), "amount_brl": F.lit(60).cast("decimal(18,2)"), "amount_orig": F.lit(10).cast("decimal(18,2)"), "amount_usd": F.lit(0).cast("decimal(18,2)")})
    out = models.enriched(empty, model).collect()
    assert all(r.category == r.description.split()[0] and r.fx_rate == 6 and r.amount_usd == 10 for r in out) and {r.confidence > 0.5 for r in out if r.idx % 2} == {True}
    learned = models.train_all(df, f"{tmp_path}/all", **small).first()
    assert (learned.rows, learned.cities) == (120, 2)


def test_rates_and_scores(spark):
    rows = [(60.0 + i, 10.0 if i % 2 else None, "USD", 5.0 + i / 10, float(i), i > 5) for i in range(12)]
    df = spark.createDataFrame(rows, "amount_brl double, amount_orig double, currency string, fx_rate double, x double, hit boolean")
    model = models.train_rates(df, ["x"], rounds=5)
    out = models.predict_rates(model, df).collect()
    assert all((r.sure, r.predicted_rate) == (0.95, r.amount_brl / 10) for r in out if r.amount_orig and r.amount_brl <= 65) and all(4.5 <= r.predicted_rate <= 6.5 and r.sure == 0.7 for r in out if not r.amount_orig)
    assert {r.sure for r in models.predict_rates(None, df).collect()} == {0.95, 0.5}
    scored = models.platt(df, ["x"]).orderBy("x").collect()
    assert scored[0].score < 0.5 < scored[-1].score and models.platt(df.filter("hit"), ["x"]).first().score == 0.8
    assert [r.calibrated for r in models.calibrate(df.limit(3).withColumn("confidence", F.col("x"))).collect()] == [0.0, 1.0, 2.0]
    clipped = models.calibrate(df.withColumn("confidence", F.col("x") / 12)).collect()
    assert all(0 <= r.calibrated <= 1 for r in clipped)
