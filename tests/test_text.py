from datetime import date
from decimal import Decimal

from pyspark.sql import functions as F

from tallyloom.functions import rules
from tallyloom.functions import text as t


def values(spark, column, found):
    df = spark.createDataFrame([(x,) for x in found], "x string")
    return [r[0] for r in df.select(column).collect()]


def test_amounts(spark):
    found = ["1.234,56", "156,78", "R$ 1.234,56", "-156,78", "", "1.234.567", "12 345,00", None]
    want = [Decimal(x) if x is not None else None for x in ("1234.56", "156.78", "1234.56", "-156.78", "0", "0", "12345", None)]
    assert values(spark, t.amount(F.col("x")), found) == want
    assert values(spark, t.amount(F.col("x"), "C"), ["1.234,56", "abc", None]) == [Decimal("1234.56"), None, None]
    assert values(spark, t.amount(F.col("x"), "B"), ["1,234.56", "1.234,56"]) == [Decimal("1234.56")] * 2


def test_dates(spark):
    found = ["15/03", "15/03/2023", "1/1", "31/02", "x", None]
    assert values(spark, t.date(F.col("x"), 2024), found) == [date(2024, 3, 15), date(2023, 3, 15), date(2024, 1, 1), None, None, None]
    assert values(spark, t.iso_date(F.col("x")), ["2024-03-15", "15/03/2024", "2024-02-31"]) == [date(2024, 3, 15), None, None]


def test_cleaning(spark):
    assert values(spark, t.clean_line(F.col("x")), [">@  A__B   C "]) == ["A B C"]
    assert values(spark, t.comparable(F.col("x")), ["Praça da SÉ, no.1", ""]) == ["praça sé 1", ""]
    assert values(spark, t.city(F.col("x")), ["loja SAO PAULO BR", "pix FINAL", "a RIO 2"]) == ["SAO PAULO", None, "RIO"]
    assert values(spark, t.jaccard(F.col("x"), F.lit("a b")), ["a b", "a", "c", ""]) == [1.0, 0.5, 0.0, 0.0]


def test_rules(spark):
    assert values(spark, rules.category(F.col("x")), ["uber trip", "SUPERMERCADO Z", "netflix", "???", None]) == ["TRANSPORTE", "ALIMENTACAO", "ENTRETENIMENTO", "OUTROS", "OUTROS"]
    assert values(spark, rules.row_class(F.col("x")), ["TOTAL 3", "03/10 A 1,00", "zzz"]) == ["summary", "transaction", "noise"]
    assert values(spark, rules.kind(F.col("x"), F.lit(-1)), ["07/10 PAGAMENTO EFETUADO 1234 - 500,00", "05/10 STORE 10,00 55,00", "05/10 STORE 10,00"]) == ["PAGAMENTO", "FX", "COMPRA"]
