"""Extractors of lines in Python as table functions: one that raises costs its document, not the run.

An extractor is a class with `line(line_no, line)`, which gives a row (date, description,
amount_brl, confidence) or None, and if it likes `end()`, which gives the rows that it has held
back; a new one is made for every document. The table function asks Spark for the lines of a
document together and in order, passes them on one by one and puts rows out as they come,
so a task holds what the extractor holds. When it raises, an error row ends the document.
"""

from __future__ import annotations

import sys
from decimal import Decimal

from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult, OrderingColumn, PartitioningColumn

from .store import Tables

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # executors need no copy of the package

SCHEMA = T.StructType([
    T.StructField("doc_id", T.StringType()), T.StructField("idx", T.LongType()), T.StructField("date", T.DateType()), T.StructField("description", T.StringType()),
    T.StructField("amount_brl", T.DecimalType(18, 2)), T.StructField("confidence", T.DoubleType()), T.StructField("error", T.StringType()),
])


def table_function(make):
    """The table function of an extractor's class: TABLE(lines: doc_id, line_no, line) to rows of SCHEMA.

    Its analysis checks the columns and asks for partitions by document, ordered by line_no.
    """
    schema = SCHEMA  # goes along with the class

    class Extract:
        @staticmethod
        def analyze(lines: AnalyzeArgument) -> AnalyzeResult:
            if not lines.isTable or {"doc_id", "line_no", "line"} - {f.name for f in lines.dataType.fields}:
                raise ValueError("an extractor reads a table with doc_id, line_no and line")
            return AnalyzeResult(schema=schema, partitionBy=[PartitioningColumn("doc_id")], orderBy=[OrderingColumn("line_no")])

        def __init__(self):
            self.own = self.doc = None
            self.failed = False

        def _given(self, idx, work):
            """Rows of one call; an error row if it raises."""
            try:
                for day, text, amount, sure in work():
                    yield self.doc, idx, day, text, None if amount is None else Decimal(amount), sure, None
            except Exception as e:  # any fault of an extractor is its document's
                self.failed = True
                yield self.doc, idx, None, None, None, 0.0, f"{type(e).__name__}: {e}"[:500]

        def eval(self, row: T.Row):
            if self.failed:
                return
            if self.own is None:
                self.own, self.doc = make(), str(row.doc_id)
            yield from self._given(row.line_no, lambda: [x for x in [self.own.line(row.line_no, row.line)] if x is not None])

        def terminate(self):
            if self.own is not None and not self.failed and hasattr(self.own, "end"):
                yield from self._given(None, self.own.end)

    return F.udtf(Extract)


def extracted(lines: DataFrame, make) -> DataFrame:
    """Rows and error rows (SCHEMA) of an extractor over lines (doc_id, line_no, line)."""
    return table_function(make)(lines.select(F.col("doc_id").cast("string").alias("doc_id"), "line_no", "line").asTable())


def settled(rows: DataFrame) -> DataFrame:
    """Extracted rows without those of documents that failed later on; error rows stay."""
    rows = Tables(rows.sparkSession).keep(rows)  # the extractor runs once
    failed = rows.filter("error is not null").select("doc_id").distinct()
    return rows.filter("error is null").join(failed, "doc_id", "left_anti").unionByName(rows.filter("error is not null"))
