import glob
import os
from datetime import date
from decimal import Decimal as D

import pytest

from tallyloom.operators import quality
from tallyloom.sources import golden_store


def files(path):
    return {f: (os.stat(f).st_mtime_ns, os.stat(f).st_ino) for f in glob.glob(f"{path}/*/*.parquet")}


def test_one_of_many_documents_is_replaced(spark, tmp_path):
    path, schema = f"{tmp_path}/golden", "key string, description string"
    golden_store.write_golden(spark.createDataFrame([(f"k{i}", f"row {j}") for i in range(20) for j in range(3)], schema), path)
    before = files(path)
    new = spark.createDataFrame([("x", "new"), ("x", "newer")], schema)
    for _ in range(2):  # a retry leaves the same table
        golden_store.replace_document(new, "k7", path)
        after = files(path)
        assert {f: s for f, s in before.items() if "key=k7/" not in f} == {f: s for f, s in after.items() if "key=k7/" not in f}
        got = golden_store.read_golden(spark, path)
        assert sorted(r.description for r in got.filter("key = 'k7'").collect()) == ["new", "newer"] and got.count() == 59
    golden_store.replace_document(new, "another", path)
    assert golden_store.read_golden(spark, path).select("key").distinct().count() == 21


SCHEMA = "doc_id string, date date, description string, amount_brl decimal(18,2), category string, confidence double"


@pytest.mark.parametrize("amount,published", [("10.00", True), ("60000.00", False)])
def test_a_table_appears_only_if_its_rules_hold(spark, tmp_path, amount, published):
    rows = spark.createDataFrame([("d", date(2024, 1, 1 + i), f"SHOP {i}", D(amount), "A", 0.9) for i in range(5)], SCHEMA)
    path, read = f"{tmp_path}/out", spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            read.add(len(b))
            yield b

    columns = ["doc_id", *quality.COLUMNS]
    report = quality.publish_gated(rows.mapInPandas(counted, SCHEMA), path, categories=["A"], columns=columns)
    want = quality.suite(quality.expectations(rows, categories=["A"], columns=columns)).drop("doc_id").collect()
    assert report.drop("doc_id").collect() == want and report.first().success == published
    assert read.value == 5  # the rows were computed once
    assert os.path.isdir(path) == published and not glob.glob(f"{tmp_path}/*unpublished*")
    if published:
        assert spark.read.parquet(path).count() == 5
