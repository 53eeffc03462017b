from datetime import date
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tallyloom.operators import enrich, layout, parse
from tallyloom.sources import statements as s
from tallyloom.streaming import ingest

HEAD = "card_last4;post_date;desc_raw;amount_brl;installment_seq;installment_tot;fx_rate;iof_brl;category;merchant_city;ledger_hash;prev_bill_amount;interest_amount;amount_orig;currency_orig;amount_usd"


def test_golden_round_trip(spark, tmp_path):
    (tmp_path / "golden_2024-10.csv").write_text(f"{HEAD}\n0001;2024-10-03;PADARIA 02/05;31.90;2;5;0.00;0.00;ALIMENTAÇÃO;CIDADE A;aa;0;0;0;;0\n1;;x;1;;;;;;;;;;;;\n")
    rows = s.read_golden(spark, str(tmp_path / "golden_2024-10.csv"))
    row = rows.first()
    assert (rows.count(), row.doc, row.card_last4, row.date, row.amount_brl) == (1, "2024-10", "0001", date(2024, 10, 3), Decimal("31.90"))
    s.write_golden(rows, str(tmp_path / "out"))
    again = spark.read.csv(str(tmp_path / "out"), sep=";", header=True)
    assert again.columns == HEAD.split(";") and again.first().desc_raw == "PADARIA 02/05"


def test_draft_and_delimited(spark, tmp_path):
    rows = spark.createDataFrame([(date(2024, 1, 2), "X", Decimal("1.50"), "A", "domestic", 0.5)], "date date, description string, amount_brl decimal(18,2), category string, transaction_type string, confidence double")
    s.write_draft(rows, str(tmp_path / "d"))
    row = s.read_delimited(spark, str(tmp_path / "d")).first()
    assert (row.date, row.amount_brl, row.confidence) == ("02/01/2024", "1,50", "0.500")


def test_blocks(spark, tmp_path):
    (tmp_path / "b.json").write_text('{"id":"t","block_type":"TABLE","child_ids":["c"]}\n{"id":"c","block_type":"CELL","row_index":1,"column_index":2,"child_ids":["w2","w1"]}\n{"id":"w1","block_type":"WORD","text":"b"}\n{"id":"w2","block_type":"WORD","text":"a"}\n')
    assert [tuple(r) for r in s.read_blocks(spark, str(tmp_path / "b.json")).collect()] == [("t", 1, 2, "a b")]


def test_parse_shapes(spark):
    found = ["03/10 PADARIA EXEMPLO 1.234,56", "05/10 STORE 10,00 55,00", "15/10/2024 Compra exemplo R$ -89,50", "Página 1", "31/02 X 1,00", None]
    out = parse.parse_lines(spark.createDataFrame([("d", i, x) for i, x in enumerate(found)], "doc_id string, line_no int, line string")).collect()
    assert {(r.line_no, r.shape, str(r.amount_brl)) for r in out} == {(0, "national", "1234.56"), (1, "fx", "55.00"), (2, "fallback", "-89.50"), (4, "national", "1.00")}


def test_stream_drops_repeats(spark, tmp_path):
    rows = [("d", i, "03/10 PADARIA EXEMPLO 1,00") for i in range(3)] + [("d", 9, "04/10 LOJA 2,00")]
    spark.createDataFrame(rows, "doc_id string, line_no int, line string").withColumn("arrived", F.lit("2024-01-01 00:00:00").cast("timestamp")).write.parquet(f"{tmp_path}/in")
    q = ingest.parsed_stream(ingest.line_stream(spark, f"{tmp_path}/in")).writeStream.format("memory").queryName("seen").start()
    try:
        q.processAllAvailable()
        assert spark.table("seen").count() == 2
    finally:
        q.stop()


def test_golden_of_any_naming(spark, tmp_path):
    (tmp_path / "golden_A_1.csv").write_text("Data;Descricao;Valor;Categoria\n03/10/2024;X;1.234,56;\n31/02/2024;Y;1,00;A\n2024-10-05;Z;7.50;B\n")
    out = [(r.key, str(r.date), r.description, str(r.amount_brl), r.category) for r in s.read_any_golden(spark, str(tmp_path)).orderBy("date").collect()]
    assert out == [("A_1.pdf", "2024-10-03", "X", "1234.56", None), ("A_1.pdf", "2024-10-05", "Z", "7.50", "B")]
    (tmp_path / "bad").mkdir()
    (tmp_path / "bad" / "b.csv").write_text("data;x\n1;2\n")
    with pytest.raises(ValueError, match="description"):
        s.read_any_golden(spark, str(tmp_path / "bad"))


def test_training_dialect_and_features(spark, tmp_path):
    (tmp_path / "golden_x.csv").write_text(f"{HEAD}\n;2024-10-03;A;31.90;0;;;;;;;;;;;\n")
    row = s.read_training(spark, str(tmp_path / "golden_x.csv")).first()
    assert (row.installment_seq, row.installment_tot, row.currency_orig, row.category, row.fx_rate) == (1, 1, "BRL", "", 0)
    s.write_features(enrich.text_features(s.read_training(spark, str(tmp_path / "golden_x.csv"))).select("description", "magnitude", "is_negative"), str(tmp_path / "f"))
    assert spark.read.csv(str(tmp_path / "f"), header=True).first().magnitude == "31.9"


def test_reports_union(spark, tmp_path):
    (tmp_path / "one" / "csv").mkdir(parents=True)
    assert s.read_reports(spark, str(tmp_path)).count() == 0
    (tmp_path / "one" / "csv" / "s1_error_report.csv").write_text("field,accuracy\ndate,1.0\n")
    (tmp_path / "two" / "csv").mkdir(parents=True)
    (tmp_path / "two" / "csv" / "s2_enriched.csv").write_text("date;category\n2024-01-01;A\n")
    out = sorted((r.extractor, r.pdf, r.is_enriched, r.field, r.category) for r in s.read_reports(spark, str(tmp_path)).collect())
    assert out == [("one", "s1", False, "date", None), ("two", "s2", True, None, "A")]


def test_exports(spark, tmp_path):
    rows = spark.createDataFrame([("d", date(2024, 1, 2), "X", Decimal("-1.50"), "A", Decimal("5.5"))], "doc_id string, date date, description string, amount_brl decimal(18,2), category string, fx_rate decimal(12,6)")
    s.write_export(rows, str(tmp_path / "e"))
    row = spark.read.csv(str(tmp_path / "e"), sep=";", header=True).first()
    assert (row.date, row.amount_brl, row.fx_rate, row.installment_seq, len(row)) == ("02/01/2024", "-1,50", "5,5000", "0", 16)
    s.write_export(rows.limit(0), str(tmp_path / "n"))
    empty = spark.read.csv(str(tmp_path / "n"), sep=";", header=True).collect()
    assert len(empty) == 1 and empty[0].date == "01/01/2024" and empty[0].amount_brl == "0,00"
    runs = spark.createDataFrame([("d", "azure", True, None, 0.7), ("e", None, False, "broken", 0.0)], "doc_id string, extractor string, success boolean, error string, confidence double")
    s.write_results(rows, runs, str(tmp_path / "r"))
    out = {r.doc_id: tuple(r)[:6] for r in spark.read.csv(str(tmp_path / "r"), sep=";", header=True).collect()}
    assert out == {"d": ("2024-01-02", "X", "-1.50", "A", "0.7", "azure"), "e": ("ERROR", "broken", "0.00", "ERROR", "0.0", "Unknown")}
    s.write_golden_draft(rows, str(tmp_path / "g"))
    s.write_golden_copy(rows, str(tmp_path / "c"))
    assert [(tmp_path / d).exists() for d in "gc"] == [True, True]
    assert s.read_any_golden(spark, str(tmp_path / "g")).first().amount_brl == Decimal("-1.50")
    assert spark.read.csv(str(tmp_path / "c"), header=True).first().date == "2024-01-02"
    s.write_tables({"a": rows.select("description"), "b": rows.select("category")}, str(tmp_path / "t"))
    assert spark.read.csv(str(tmp_path / "t" / "b"), header=True).first().category == "A"
    s.write_json(rows, str(tmp_path / "j"))
    assert spark.read.json(str(tmp_path / "j")).first().amount_brl == -1.5
    s.write_report(rows.select(F.col("description").alias("line")), str(tmp_path / "x"))
    assert spark.read.text(str(tmp_path / "x")).first().value == "X"
    more = s.appended(rows.withColumn("key", F.lit("k1")), "k1", rows.withColumn("description", F.lit("new")))
    assert [(r.key, r.description) for r in more.collect()] == [("k1", "new")]


def test_page_texts(spark):
    pages = spark.createDataFrame([("d", 2, "b"), ("d", 1, "a"), ("d", 3, ""), ("e", 1, None)], "doc_id string, page int, text string")
    assert [tuple(r) for r in s.page_texts(pages).collect()] == [("d", "a\nb")]


def test_run_rates_stream(spark, tmp_path):
    runs = spark.createDataFrame([("2024-01-01 00:00:00", "a", True), ("2024-01-01 00:04:00", "a", False)], "t string, method string, success boolean").select(F.col("t").cast("timestamp").alias("ts"), "method", "success")
    runs.write.parquet(f"{tmp_path}/runs")
    q = ingest.run_rates(spark.readStream.schema(runs.schema).parquet(f"{tmp_path}/runs")).writeStream.format("memory").outputMode("complete").queryName("rates").start()
    try:
        q.processAllAvailable()
        assert [(r.runs, r.success_rate) for r in spark.table("rates").collect()] == [(2, 0.5)]
    finally:
        q.stop()


def test_layout_json(spark, tmp_path):
    cell = lambda r, c, x: f'{{"row_index":{r},"column_index":{c},"content":"{x}","confidence":0.5}}'
    line = '{"content":"04/10 LOJA B 9,00","confidence":0.8}'
    (tmp_path / "l.json").write_text(f'{{"doc_id":"d","tables":[{{"cells":[{cell(0, 0, "Data")},{cell(1, 0, "03/10")},{cell(1, 1, "LOJA GRANDE")},{cell(1, 2, "7,00")}]}}],"pages":[{{"lines":[{line},{{"content":"03/10 LOJA GRANDE 7,00"}}]}}]}}\n')
    cells, lines = s.read_layout(spark, str(tmp_path / "l.json"))
    out = sorted((r.strategy, r.description, str(r.amount_brl), r.confidence) for r in layout.layout_rows(cells, lines).collect())
    assert out == [("paragraph", "LOJA B", "9.00", 0.72), ("table", "LOJA GRANDE", "7.00", 0.85)]
    fields = layout.layout_rows(cells, lines).filter("strategy = 'table'").drop("strategy").withColumn("confidence", F.lit(1.0))
    assert [r.strategy for r in layout.layout_rows(cells, lines, fields).collect()] == ["fields"]


def test_documents_json(spark, tmp_path):
    text = "03/10MERCADO LIVRE 5,00"
    segment = lambda a, b: f'{{"segments":[{{"start":{a},"end":{b}}}]}}'
    page = f'{{"tables":[{{"rows":[{{"cells":[{segment(0, 5)},{segment(5, 18)},{segment(18, "null")}]}}]}}],"form_fields":[{{"name":"a"}}]}}'
    (tmp_path / "d.json").write_text(f'{{"doc_id":"d","text":"{text}","entities":[{{"type":"date","value":"04/10","confidence":0.9}}],"pages":[{page}]}}\n')
    docs = s.read_documents(spark, str(tmp_path / "d.json"))
    row = layout.purchase_rows(layout.document_tables(docs)).first()
    assert (str(row.date), row.description, str(row.amount_brl)) == ("2024-10-03", "MERCADO LIVRE", "5.00")
    assert str(layout.entity_rows(layout.entities_of(docs)).first().date) == "2024-10-04" and layout.form_fields(docs).first().name == "a"
