import random
from datetime import date
from decimal import Decimal as D

from pyspark.ml import PipelineModel
from pyspark.sql import functions as F

from tallyloom import queries
from tallyloom.operators import models


def test_category_model_has_the_reference_size(spark, monkeypatch):
    """The registered model has the operator's 100 trees and takes up to 1,000 terms."""
    fitted, train = [], models.train_categories
    monkeypatch.setattr(models, "train_categories", lambda *a, **k: fitted.append(train(*a, **k)) or fitted[0])
    queries.QUERIES["category_model"](spark, "/root/testdata/sf0.001")
    assert fitted[0].stages[-2].getNumTrees == 100 and fitted[0].stages[3].getVocabSize() == 1000


def test_split_takes_its_share_of_every_class(spark):
    rows = [(i, "A" if i < 900 else "B" if i < 990 else f"C{i}") for i in range(991)]
    train, test = models.split(spark.createDataFrame(rows, "idx long, category string"), "idx", label="category")
    n = {r.category: r["count"] for r in test.groupBy("category").count().collect()}
    assert n == {"A": 180, "B": 18} and train.count() + test.count() == 991


def test_rate_model_is_learned_and_used(spark, tmp_path):
    r = random.Random(5)
    rows = []
    for i in range(400):
        currency = r.choice(["USD", "EUR", "BRL"])
        rate = {"USD": 5.0, "EUR": 6.0, "BRL": 0.0}[currency] + (i % 4) / 10
        rows.append((i, currency, date(2024, 1 + i % 12, 1), f"SHOP {i % 9}", D(str(round(60 + i / 7, 2))), None, rate if currency != "BRL" else None, None, "X" if i % 2 else "Y", "RIO"))
    schema = "idx long, currency string, date date, description string, amount_brl decimal(18,2), amount_orig decimal(18,2), fx_rate double, amount_usd double, category string, merchant_city string"
    df = spark.createDataFrame(rows, schema)
    model, errors = models.learn_rates(df)
    assert model.model.stages[-1].getNumTrees == 100 and set(model.means) == {"USD", "EUR"}
    assert errors["rows"] > 150 and errors["mae"] < 0.3 and errors["r2"] > 0.3
    exact = models.rate_errors(spark.createDataFrame([(1.0, 2.0), (3.0, 3.0)], "fx_rate double, prediction double"))
    assert exact == {"mae": 0.5, "r2": 0.5} and models.learn_rates(df.filter("currency = 'BRL'")) == (None, {})
    gaps = df.withColumn("fx_rate", F.lit(None).cast("double"))
    got = {x.idx: x for x in models.enriched(gaps, rates=model).collect()}
    assert len(got) == 400 and all(got[i].fx_rate is None for i, c, *_ in rows if c == "BRL")
    assert all(4.5 <= got[i].fx_rate <= 5.5 for i, c, *_ in rows if c == "USD") and all(got[i].fx_rate > 5.5 for i, c, *_ in rows if c == "EUR")
    learned = models.train_all(df, f"{tmp_path}/all", rate_rounds=3, trees=3, words=20, depth=2).first()
    assert learned.rate_rows == errors["rows"] and PipelineModel.load(f"{tmp_path}/all/rates").stages[-1].getNumTrees == 3
