import random
from datetime import date
from decimal import Decimal as D

from tallyloom.operators import enrich, layout, parse

LINES = "doc_id string, line_no int, line string"
CELLS = "doc_id string, table_idx int, row_idx int, col_idx int, content string"


def lines(spark, *texts):
    return spark.createDataFrame([("d", i, x) for i, x in enumerate(texts)], LINES)


def test_cascade_skips_headers_and_takes_the_last_amount(spark):
    found = lines(spark, "05/10 DATA CENTER 10,00", "VALOR", "05/10 LOJA 10,00", "a 5,00 b 06/10 7,00", None, " ", "99,00")
    out = {r.line_no: (r.shape, r.description, r.amount_brl, r.date) for r in parse.parse_lines(found).collect()}
    assert out == {
        2: ("national", "LOJA", D("10.00"), date(2024, 10, 5)), 3: ("fallback", "a 5,00 b", D("7.00"), date(2024, 10, 6)), 6: ("fallback", "Unknown transaction", D("99.00"), date(2024, 1, 1)),
    }


def test_bundles_consume_their_lines(spark):
    text = ["01/10 A 1,00", "02/10 B 2,00", "X. Y", "CASA. RIO", "03/10 C 3,00", "CASA. RIO", "04/10 D 4,00", "PARIS 4,00 EUR 24,00", "Dólar de Conversão R$ 6,00", "05/10 E 5,00"]
    out = [(r.line_no, r.kind, r.city, r.amount_brl) for r in layout.bundles(lines(spark, *text)).orderBy("line_no").collect()]
    assert out == [(1, "domestic", "Y", D("2.00")), (4, "domestic", "RIO", D("3.00")), (6, "international", "PARIS", D("24.00"))]


def greedy(spans):
    free, out = -1, []
    for s, e in sorted(spans):
        if s > free:
            out.append(s)
            free = e
    return out


def test_non_overlapping_equals_a_scan(spark):
    r = random.Random(3)
    spans = [(f"d{d}", s, s + r.randint(0, 4)) for d in range(6) for s in range(60) if r.random() < 0.6]
    got = layout.non_overlapping(spark.createDataFrame(spans, "doc_id string, start int, end int")).collect()
    want = sorted((f"d{d}", s) for d in range(6) for s in greedy([x[1:] for x in spans if x[0] == f"d{d}"]))
    assert sorted((x.doc_id, x.start) for x in got) == want
    chained = layout.non_overlapping(spark.createDataFrame(spans, "doc_id string, start int, end int"), island=2).collect()
    assert sorted((x.doc_id, x.start) for x in chained) == want


def test_a_long_island_is_chained(spark):
    """One island over a whole document: each span overlaps the next."""
    r = random.Random(5)
    spans = [("d", s, s + r.randint(1, 6)) for s in range(3000)]
    got = layout.non_overlapping(spark.createDataFrame(spans, "doc_id string, start int, end int")).collect()
    assert sorted(x.start for x in got) == greedy([x[1:] for x in spans])


def test_fx_chunks_consume_and_count_once(spark):
    buy, rate, tax = "05/10 STORE 10,00 55,00", "Dólar de Conversão R$ 5,5000", "Repasse de IOF em R$ 3,51"
    out = [(r.line_no, r.fx_rate, r.iof_brl) for r in parse.fx_chunks(lines(spark, buy, rate, buy, tax, rate, "06/10 OTHER 1,00 5,00", buy, rate)).orderBy("line_no").collect()]
    assert out == [(0, D("5.5000"), D("0.00")), (5, D("5.5000"), D("0.00"))]


def test_cell_rows_of_both_parsers(spark):
    row = lambda n, *texts: [("d", 0, n, i, x) for i, x in enumerate(texts)]
    cells = spark.createDataFrame([*row(1, "a", "b 1"), *row(2, "03/10", "LOJA GRANDE DA PRACA", "5,00", "7,00"), *row(3, "LOJA", "12,00"), *row(4, "04/10", "x"), *row(5, "04/10", "05/11", None)], CELLS)
    a = {r.row_idx: (r.date, r.description, r.amount_brl, r.confidence) for r in layout.cell_rows(cells, "A", header=1).collect()}
    assert a == {2: (date(2024, 10, 3), "LOJA GRANDE DA PRACA", D("7.00"), 1.0), 3: (date(2024, 1, 1), "LOJA", D("12.00"), 0.8), 5: (date(2024, 10, 4), "Unknown transaction", D("511.00"), 1.0)}
    b = {r.row_idx: (r.description, r.confidence) for r in layout.cell_rows(cells, "B", header=0).collect()}
    assert b[3] == ("Unknown transaction", 0.94) and b[2][0] == "LOJA GRANDE DA PRACA" and 1 in b


def test_layout_and_block_strategies(spark):
    schema = "doc_id string, date date, description string, amount_brl decimal(18,2), category string, confidence double"
    row = lambda doc, n: (doc, date(2024, 1, n), f"T{n}", D(n), "X", 0.9)
    tables = spark.createDataFrame([row("many", n) for n in range(1, 6)] + [row("few", n) for n in range(1, 5)], schema)
    said = [(d, i, f"{n:02}/01 T{n} {n},00") for d in ("many", "few", "none") for i, n in enumerate([1, 9, 9])]
    text = layout.text_rows(spark.createDataFrame(said, LINES))
    count = lambda df: sorted((r.doc_id, r.strategy, r["count"]) for r in df.groupBy("doc_id", "strategy").count().collect())
    assert count(layout.with_paragraphs(tables, text)) == [("few", "paragraph", 1), ("few", "table", 4), ("many", "table", 5), ("none", "paragraph", 2)]
    assert count(layout.tables_else_lines(tables, text)) == [("few", "table", 4), ("many", "table", 5), ("none", "line", 3)]


def test_purchase_rows(spark):
    rows = [
        (["03/10", "MERCADO LIVRE", "1.234,56"], True), (["03/10", "Saldo MERCADO", "1,00"], False), (["03/10 MERCADO LIVRE 5,00"], False), (["31/02", "MERCADO LIVRE", "1,00"], False),
        (["03/10", "minusculas aqui", "1,00"], False), (["03/10", "123 456", "1,00"], False), (["03/10", "MERCADO", "0,00"], False), (["03/10/2023", "CASA.RIO DE", "200.000,00", "2,00"], True), ([], False),
    ]
    df = spark.createDataFrame([(i, r) for i, (r, _) in enumerate(rows)], "id int, cells array<string>")
    out = {r.id: r for r in layout.purchase_rows(df).collect()}
    assert set(out) == {i for i, (_, ok) in enumerate(rows) if ok}
    assert (out[7].category, out[7].merchant_city, out[7].amount_brl, out[7].date) == ("CASA", "RIO DE", D("2.00"), date(2023, 10, 3))


def test_empty_tables(spark):
    none = spark.createDataFrame([], LINES)
    for f in (parse.parse_lines, parse.fx_chunks, layout.bundles, layout.text_rows, enrich.template_lines):
        assert f(none).count() == 0
    assert layout.cell_rows(spark.createDataFrame([], CELLS)).count() == 0


def test_cities_rules(spark):
    rows = spark.createDataFrame([("uber trip SAO PAULO BR",), ("Padaria Sol RIO DE JANEIRO",), ("loja osasco sp",), ("POSTO XRIOX 1",), (None,), ("CARTAO FINAL",)], "description string")
    known = spark.createDataFrame([("RIO",), ("RIO DE JANEIRO",)], "city string")
    out = {r.description: (r.found_city, r.found_merchant) for r in enrich.cities(rows, known).collect()}
    assert out["uber trip SAO PAULO BR"][0] == "ONLINE" and out["Padaria Sol RIO DE JANEIRO"] == ("RIO DE JANEIRO", "Padaria Sol")
    assert out["loja osasco sp"][0] == "LOJA OSASCO" and out["POSTO XRIOX 1"] == ("RIO", "Posto X") and out[None] == (None, None) and out["CARTAO FINAL"][0] is None
