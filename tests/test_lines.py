import pytest
from pyspark.sql import functions as F

from tallyloom import queries
from tallyloom.operators import enrich, parse

DIR = "/root/testdata/sf0.001"


@pytest.mark.parametrize(("name", "kind"), [("parse_fallback", "o_orderkey % 2 = 1"), ("payment_lines", "o_orderkey % 4 = 0"), ("installment_lines", "o_orderkey % 4 = 1")])
def test_every_row_reaches_the_operator(spark, monkeypatch, name, kind):
    """The operator gets a line of every order and itself rejects those that aren't its kind."""
    orders = spark.read.parquet(f"{DIR}/orders.parquet")
    assert sorted(r.line_no for r in queries.QUERIES[name](spark, DIR).collect()) == sorted(r.o_orderkey for r in orders.filter(kind).collect())
    every = {c: F.lit(0) for c in ("code", "amount_brl", "seq", "tot")}
    monkeypatch.setattr(parse, "fallback", lambda line: F.struct(F.lit(0).alias("amount_brl"), line.alias("description")))
    monkeypatch.setattr(enrich, "payments", lambda lines: lines.withColumns(every))
    monkeypatch.setattr(enrich, "installment_lines", lambda lines: lines.withColumns(every))
    assert queries.QUERIES[name](spark, DIR).count() == orders.count()
