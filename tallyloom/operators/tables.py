"""Tables found in word boxes: rows by their tops, columns by the edges that words of all rows share.

words: (doc_id, page, text, x0, x1, top, bottom). Laid on each other, the words of a page's rows
cover some stretches of its width; a column is a run of words that touch or overlap there, and the
gaps that no row crosses, at least `gap` wide, part columns. Left-aligned and right-aligned cells,
and cells of several words, come out alike. Rows of fewer than `cells` words (headings, totals) don't
take part in finding columns unless the page has no others; their words go to the column they
begin in. A page is the unit of every window, so documents of any length are spread by page.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def placed_rows(words: DataFrame, tolerance: float = 3.0) -> DataFrame:
    """words with row_idx (from 1): a row ends where the next top is further down than the tolerance."""
    w = W.partitionBy("doc_id", "page").orderBy("top", "x0", "x1", "text")
    begins = (F.col("top") - F.lag("top").over(w) > tolerance).cast("int")
    out = words.filter(F.trim("text") != "").withColumn("\0begins", F.coalesce(begins, F.lit(1)))
    return out.withColumn("row_idx", F.sum("\0begins").over(w.rowsBetween(W.unboundedPreceding, 0)).cast("int")).drop("\0begins")


def column_edges(rows: DataFrame, gap: float = 4.0, cells: int = 3) -> DataFrame:
    """(doc_id, page, col_idx, low, high) of the columns of placed_rows' pages, from the left, col_idx from 0."""
    page = ["doc_id", "page"]
    return _in_columns(rows, gap, cells).filter("full").groupBy(*page, "col_idx").agg(F.min("x0").alias("low"), F.max("x1").alias("high"))


def _in_columns(rows: DataFrame, gap: float, cells: int) -> DataFrame:
    """placed_rows with `full`, whether a word's row takes part in finding columns, and col_idx, the last column that begins at or before the word.

    Both come from two sorted runs over a page: by rows, where a row of `cells` words holds a stretch of as many
    places round each of its words, and by left edges, where a column is begun by a word past all full words before it.
    """
    page = W.partitionBy("doc_id", "page")
    down, right = page.orderBy("top", "x0", "x1", "text"), page.orderBy("x0", "x1")
    same = lambda k: F.lag("row_idx", k).over(down) == F.col("row_idx") if k > 0 else F.lead("row_idx", -k).over(down) == F.col("row_idx") if k < 0 else F.lit(True)
    long = reduce(or_, [F.coalesce(same(k) & same(k + 1 - cells), F.lit(False)) for k in range(cells)])
    rows = rows.withColumn("\0long", long)
    rows = rows.withColumn("full", F.col("`\0long`") | ~F.max("\0long").over(page))
    reach = F.max(F.when(F.col("full"), F.col("x1"))).over(right.rowsBetween(W.unboundedPreceding, -1))
    begins = F.coalesce((F.col("full") & (F.col("x0") >= reach + gap)).cast("int"), F.lit(0))
    return rows.withColumn("\0begins", begins).withColumn("col_idx", F.sum("\0begins").over(page.orderBy("x0").rangeBetween(W.unboundedPreceding, 0)).cast("int")).drop("\0begins", "\0long")


def table_cells(words: DataFrame, tolerance: float = 3.0, gap: float = 4.0, cells: int = 3) -> DataFrame:
    """(doc_id, table_idx, row_idx, col_idx, content): a page's cells, its words in order; for infer_columns and column_rows."""
    placed = _in_columns(placed_rows(words, tolerance), gap, cells)
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("x0", "x1", F.trim("text").alias("t")))), lambda w: w["t"]), " ")
    return placed.groupBy("doc_id", F.col("page").alias("table_idx"), "row_idx", "col_idx").agg(text.alias("content"))
