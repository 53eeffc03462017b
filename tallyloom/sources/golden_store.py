"""A stored golden table whose documents are replaced one by one, and tables that are published only if their rules hold."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def write_golden(rows: DataFrame, path: str, key: str = "key") -> None:
    """Stores golden rows, a folder for each document; documents that rows don't have stay as they are.

    Spark replaces just the folders it writes to, when all of its tasks are done, so a run that is
    repeated, or fails and is run again, leaves the same table.
    """
    one_file = rows.repartition(key)  # a document's rows go to one file
    one_file.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(key).parquet(path)


def read_golden(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def replace_document(rows: DataFrame, key_value: str, path: str, key: str = "key") -> None:
    """The document's rows are `rows` from here on."""
    write_golden(rows.drop(key).withColumn(key, F.lit(key_value)), path, key)


def _files(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def publish(rows: DataFrame, path: str, rules: dict[str, tuple[Column, Callable[[object], bool]]]) -> dict[str, tuple[object, bool]]:
    """Writes rows once, beside the path, and judges what was written: it appears under path only if all rules hold, else it is deleted.

    rules: an aggregate and the test its value must pass, by name; all are made in one pass over the
    columns they need of the written files, so the rows themselves are computed once. (An
    Observation would save that pass, but a session that has had one can't run MLlib's models in Spark 4.1.2:
    its manager isn't serializable.) Returns each rule's value and whether it holds.
    """
    spark, beside = rows.sparkSession, f"{path.rstrip('/')}.unpublished-{uuid.uuid4().hex}"
    rows.write.parquet(beside)
    written = spark.read.schema(rows.schema).parquet(beside)
    values = written.agg(*[c.alias(n) for n, (c, _) in rules.items()]).first()
    out = {n: (values[n], bool(test(values[n]))) for n, (_, test) in rules.items()}
    (source, fs), (target, _) = _files(spark, beside), _files(spark, path)
    if all(ok for _, ok in out.values()):
        fs.delete(target, True)
        if not fs.rename(source, target):
            raise OSError(f"{beside} can't be renamed to {path}")
    else:
        fs.delete(source, True)
    return out
