from datetime import date
from decimal import Decimal as D

import pytest

from tallyloom import api, extractors

LINES = "doc_id string, line_no long, line string"


class Words:
    """A row of every line; raises on `bad`, and at the end of a document whose last line is `late`."""

    def line(self, line_no, line):
        self.last = line
        if line == "bad":
            raise KeyError(line)
        return (date(2024, 1, 1), line, str(line_no), 0.5) if line else None

    def end(self):
        if self.last == "late":
            raise ValueError("late")
        return [(None, "end of " + self.last, "0", 0.1)]


def test_a_fault_costs_one_document(spark):
    rows = [("a", 2, "two"), ("a", 1, "one"), ("a", 3, ""), ("b", 1, "x"), ("b", 2, "bad"), ("b", 3, "y"), ("c", 1, "late"), ("d", 5, None)]
    found = extractors.extracted(spark.createDataFrame(rows, LINES).repartition(3), Words)
    got = {}
    for r in found.collect():
        got.setdefault(r.doc_id, []).append((r.idx, r.description, r.amount_brl, r.error))
    assert got["a"] == [(1, "one", D(1), None), (2, "two", D(2), None), (None, "end of ", D(0), None)]  # in the lines' order
    assert got["b"] == [(1, "x", D(1), None), (2, None, None, "KeyError: 'bad'")]
    assert [x[3] for x in got["c"]] == [None, "ValueError: late"] and got["d"][0][3].startswith("TypeError")
    settled = extractors.settled(found).collect()
    assert sorted((r.doc_id, r.error is None) for r in settled) == [("a", True)] * 3 + [("b", False), ("c", False), ("d", False)]
    with pytest.raises(Exception, match="doc_id, line_no and line"):
        extractors.table_function(Words)(spark.createDataFrame([(1,)], "x int").asTable()).collect()


def test_faults_in_run_all_and_race(spark, monkeypatch):
    monkeypatch.setattr(api, "EXTRACTORS", dict(api.EXTRACTORS))
    api.python_extractor("words")(Words)
    api.extractor("broken")(lambda lines: lines.select("no_such_column"))
    lines = spark.createDataFrame([("a", 1, "05/10 UBER 10,00"), ("b", 1, "bad")], LINES)
    every = api.run_all(lines, ["words", "broken", "pipeline"])
    states = {(r.doc_id, r.extractor): (r.success, r.n) for r in api.extraction_runs(every).collect()}
    assert states == {("a", "words"): (True, 1 + 1), ("b", "words"): (False, 0), ("a", "broken"): (False, 0), ("b", "broken"): (False, 0), ("a", "pipeline"): (True, 1)}
    names = ["words", "pipeline", "simple"]
    kept = api.raced(api.run_all(lines, names), names, 0.5)
    assert {r.extractor for r in kept.filter("doc_id = 'a'").collect()} == {"words", "pipeline"}
    assert api.parse_statements(lines, ["pipeline", "simple"], race=0.9).count() == 1
