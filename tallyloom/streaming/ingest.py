"""Statement lines as a stream: parse, drop repeats within a watermark, window metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as t
from ..operators.parse import parse_lines


def line_stream(spark: SparkSession, path: str, schema: str = "doc_id string, line_no int, line string, arrived timestamp") -> DataFrame:
    return spark.readStream.schema(schema).parquet(path)


def parsed_stream(lines: DataFrame, delay: str = "1 hour") -> DataFrame:
    """Typed rows with their ledger hash, each hash once within the delay."""
    line = lines.withColumn("doc_id", F.struct("doc_id", "arrived"))
    out = parse_lines(line).select("doc_id.doc_id", "doc_id.arrived", "line_no", "date", "description", "amount_brl")
    out = out.withColumn("ledger_hash", t.ledger_hash(F.col("date"), F.col("description"), F.col("amount_brl")))
    return out.withWatermark("arrived", delay).dropDuplicatesWithinWatermark(["ledger_hash"])


def run_rates(runs: DataFrame, width: str = "5 minutes", delay: str = "10 minutes") -> DataFrame:
    """Runs and success rate of each time window, late rows within the delay counted."""
    return runs.withWatermark("ts", delay).groupBy(F.window("ts", width), "method").agg(
        F.count("*").alias("runs"), F.avg(F.col("success").cast("int")).alias("success_rate")
    )
