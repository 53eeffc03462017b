import random

from tallyloom.operators import tables

SCHEMA = "doc_id string, page int, text string, x0 double, x1 double, top double, bottom double"


def printed(rows, page=1, doc="d", y=10.0, seed=1):
    """Word boxes of rows of cells: a left-aligned, a ragged and a right-aligned column; tops are off by a little."""
    r, out = random.Random(seed), []
    for cells in rows:
        for k, cell in enumerate(cells):
            if cell is None:
                continue
            x = {0: 10.0, 1: 60.0, 2: 260.0 - 5 * len(cell)}[k]
            for word in cell.split():
                out.append((doc, page, word, x, x + 5 * len(word) - 1, y + r.choice([0.0, 0.5, 1.0]), y + 8))
                x += 5 * len(word) + 2
        y += 12
    r.shuffle(out)
    return out


def test_cells_of_made_pages(spark):
    r = random.Random(2)
    pages = {}
    for p in range(1, 6):
        pages[p] = [(f"{r.randint(10, 28)}/10", " ".join("w" * r.randint(1, 6) for _ in range(r.randint(1, 4))), f"{r.randint(1, 99999)},00") for _ in range(r.randint(2, 12))]
    pages[3].insert(1, ("01/10", None, "5,00"))  # a gap in a column
    words = [w for p, rows in pages.items() for w in printed([("TITLE OF ALL THE PAGE HERE AND", None, None), *rows] if p == 2 else rows, p, seed=p)]
    got = {(c.table_idx, c.row_idx, c.col_idx): c.content for c in tables.table_cells(spark.createDataFrame(words, SCHEMA)).collect()}
    for p, rows in pages.items():
        if p == 2:  # its heading is a row of seven words, which bridges the columns
            continue
        assert {k: v for k, v in got.items() if k[0] == p} == {(p, i + 1, k): c for i, cells in enumerate(rows) for k, c in enumerate(cells) if c is not None}


def test_short_rows_do_not_bridge_columns(spark):
    rows = [("01/10", "a b", "1,00"), ("02/10", "c", "2,00")]
    total = ("d", 1, "T" * 40, 10.0, 210.0, 60.0, 68.0)  # one word across the columns
    got = {(c.row_idx, c.col_idx): c.content for c in tables.table_cells(spark.createDataFrame([*printed(rows), total], SCHEMA)).collect()}
    assert got == {(1, 0): "01/10", (1, 1): "a b", (1, 2): "1,00", (2, 0): "02/10", (2, 1): "c", (2, 2): "2,00", (3, 0): "T" * 40}
    assert tables.table_cells(spark.createDataFrame([("d", 1, " ", 1.0, 2.0, 3.0, 4.0)], SCHEMA)).count() == 0
