"""Work that is done once: patterns of an expression, inputs of an operator, equal rows of a model."""

import random
from datetime import date, datetime
from decimal import Decimal as D

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from tallyloom import api, extractors
from tallyloom.functions import alike
from tallyloom.operators import layout, models, parse, reports, tables
from tallyloom.plans import adapters

SF = "/root/testdata/sf0.001"
ROW = "doc_id string, idx long, date date, description string, amount_brl decimal(18,2), category string, confidence double"


def _plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


@pytest.fixture
def counted(spark):
    """Rows whose description counts how often it is made."""
    calls = spark.sparkContext.accumulator(0)

    def make(x):
        calls.add(1)
        return x

    rows = [("d", i, date(2024, 1, 1 + i % 9), f"LOJA {i}", D(i), "X", 0.9) for i in range(20)]
    return spark.createDataFrame(rows, ROW).withColumn("description", F.udf(make)("description")), calls


def test_points_join_equal_rows_and_lose_none(spark):
    rows = spark.createDataFrame([("A", 0.0, 2.0)] * 1000 + [("B", 1.0, 0.5)] * 2 + [("C", 1.0, 3.0)], "features string, label double, weight double")
    got = models._points(rows, points=10, parts=3)
    sums = {r.features: (r.w, r.n) for r in got.groupBy("features").agg(F.sum("weight").alias("w"), F.count("*").alias("n")).collect()}
    assert sums == {"A": (2000.0, 10), "B": (1.0, 2), "C": (3.0, 1)} and got.rdd.getNumPartitions() == 3
    assert models._points(rows, points=2000).count() == 1003


def test_cascade_counts_an_amount_of_stream_as_its_sql(spark, tmp_path):
    orders = [(5, 110, 70.0, datetime(2024, 3, 1)), (7, 110, 70.0, datetime(2024, 3, 2)), (9, 110, 80.0, datetime(2024, 3, 2))]
    spark.createDataFrame(orders, "o_orderkey long, o_custkey long, o_totalprice double, o_orderdate timestamp").write.parquet(f"{tmp_path}/orders.parquet")
    spark.createDataFrame([(110, "AUTO", "Customer#110")], "c_custkey long, c_mktsegment string, c_name string").write.parquet(f"{tmp_path}/customer.parquet")
    db = duckdb.connect()
    for name in ("orders", "customer"):
        db.execute(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet/*.parquet'")
    want = db.execute(__spark_entry__.oracle_sql()["table_cascade"]).fetchall()
    assert [tuple(r) for r in __spark_entry__.queries()["table_cascade"](spark, str(tmp_path)).collect()] == want == [("2024-03/1", "stream", 2, 150.0)]


def test_table_cells_sort_pages_without_a_join(spark):
    words = adapters.words(spark, SF)
    plan = _plan(tables.table_cells(words))
    assert "Join" not in plan and plan.count("Relation") == 1


def test_cells_come_from_one_reading(spark):
    assert _plan(adapters.cells(spark, SF)).count("Relation") == 1


@pytest.mark.parametrize("read", [parse.fallback, parse.last_amount, layout.text_line])
def test_a_line_is_searched_once_for_each_pattern(spark, read):
    lines = spark.createDataFrame([("01/02/2024 LOJA R$ 1,00",)], "line string")
    plan = _plan(lines.select(read(F.concat("line", F.lit(" "))).alias("r")))
    assert plan.count(r"\d{3})*,\d{2}") <= 2 and plan.count("concat(") == 1


def test_cell_rows_take_the_date_and_the_last_other_number(spark):
    """All rows of up to four cells out of dates, amounts and texts, against the rule as stated."""
    kinds, r, made, want = ["01/02", "9,00", "7", "LOJA X", "ab", ""], random.Random(3), [], {}
    for k in range(300):
        row = [r.choice(kinds) for _ in range(r.randint(1, 4))]
        made += [("d", 1, k, c, x) for c, x in enumerate(row)]
        cells = [x for x in row if x]
        at = next((i for i, x in enumerate(cells) if "/" in x), None)
        others = [x for i, x in enumerate(cells) if i != at]
        able = [x for x in others if any(c.isdigit() for c in x)]
        text = [x for x in others if not any(c.isdigit() for c in x) and len(x) > 3]
        if able:
            want[k] = (date(2024, 2, 1) if at is not None else date(2024, 1, 1), text[0] if text else layout.UNKNOWN)
    got = layout.cell_rows(spark.createDataFrame(made, "doc_id string, table_idx int, row_idx int, col_idx int, content string"))
    assert {x.row_idx: (x.date, x.description) for x in got.collect()} == want


def test_reports_read_their_rows_once(spark, counted):
    found, calls = counted
    gold = spark.createDataFrame(found.collect(), ROW)
    before = calls.value
    assert {x.tp for x in reports.semantic_report(found, gold).collect()} == {20}
    assert calls.value - before == 20
    made = reports.error_analysis(gold, found, fields=["description"])
    assert [made[n].count() for n in ("report", "mismatches", "missing", "extra")] == [1, 0, 0, 0] and calls.value - before == 40
    reports.before_after(gold, found, gold, fields=["description"]).collect()
    assert calls.value - before == 60


def test_extractors_read_their_lines_once(spark, counted):
    class Plain:
        def line(self, line_no, line):
            if line_no == 3:
                raise ValueError("three")
            return date(2024, 1, 1), line, "1.00", 0.5

    found, calls = counted
    lines = found.select("doc_id", F.col("idx").alias("line_no"), F.col("description").alias("line"))
    assert extractors.settled(extractors.extracted(lines, Plain)).count() == 1 and calls.value == 20
    both = lines.withColumn("line", F.concat(F.lit("01/02 "), "line", F.lit(" 5,00")))
    assert api.parse_statements(both).count() > 0 and calls.value <= 20 + 60  # each extractor once, one filters the lines besides


def test_few_leaders_need_no_arrays():
    r, texts = random.Random(1), [" ".join(x) for x in zip("ABCDEFGHIJ" * 4, "KLMNOPQRST" * 4, strict=True)]
    texts += ["LOJA UM", "LOJA UMA", "LOJB UN", "PADARIA"]
    for n in range(1, 9):
        held = r.sample(texts, n)
        leaders = alike.Leaders(70.0)
        for k, x in enumerate(held):
            leaders.add(k, alike.Words(x))
        assert (leaders.bags is None) == (n <= alike.FEW)
        for x in texts:
            want = next((k for k, y in enumerate(held) if alike.ratio(alike.Words(x), alike.Words(y), 70.0) >= 70), None)
            assert leaders.first(alike.Words(x)) == want
