"""Run metrics, dashboards, choice among runs, golden policy and statement rollups."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import confidence
from .quality import rounded


def run_metrics(runs: DataFrame) -> DataFrame:
    """Overall (method ALL) and by method, in one rollup: count, success, confidence, time, pages, cost."""
    cost = confidence.cost(F.col("method"), F.col("pages"))
    out = runs.withColumn("cost", cost).rollup("method").agg(
        F.count("*").alias("runs"), F.round(F.avg(F.col("success").cast("int")), 6).alias("success_rate"),
        F.round(F.avg(F.when(F.col("success"), F.col("confidence"))), 6).alias("avg_confidence"),
        F.round(F.avg("time_ms"), 4).alias("avg_time_ms"), F.sum("pages").alias("pages"), F.round(F.sum("cost"), 4).alias("cost"),
    )
    return out.withColumn("method", F.coalesce("method", F.lit("ALL")))


def top_errors(runs: DataFrame, k: int = 5) -> DataFrame:
    return runs.filter(~F.col("success")).groupBy("error").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "error").limit(k)


def race(runs: DataFrame, least: float = 0.9) -> DataFrame:
    """Of each document the runs up to the first, by time, that is sure enough; all if none is."""
    w = W.partitionBy("doc_id").orderBy("time_ms", "run_id")
    won = F.max((F.col("confidence") >= least).cast("int")).over(w.rowsBetween(W.unboundedPreceding, -1))
    return runs.withColumn("\0won", F.coalesce(won, F.lit(0))).filter("`\0won` = 0").drop("\0won")


def dashboard(runs: DataFrame, width: str = "5 minutes") -> DataFrame:
    """Volume, success rate, rate a second and exact p50 and p95 of each time window and method."""
    return runs.groupBy(F.window("ts", width).start.alias("start"), "method").agg(
        F.count("*").alias("runs"), F.round(F.count("*") / 300, 6).alias("rate"), F.round(F.avg(F.col("success").cast("int")), 6).alias("success_rate"),
        F.round(F.percentile("time_ms", 0.5), 4).alias("p50"), F.round(F.percentile("time_ms", 0.95), 4).alias("p95"),
    )


def statement_summary(rows: DataFrame) -> DataFrame:
    return rows.groupBy("doc_id").agg(
        F.count("*").alias("n"), F.sum("amount_brl").cast("double").alias("total"), F.count_if(F.col("currency") == "BRL").alias("domestic"),
        F.count_if(F.col("currency") != "BRL").alias("international"), F.min("date").alias("first_date"), F.max("date").alias("last_date"),
        F.array_join(F.sort_array(F.collect_set("category")), ",").alias("categories"),
    )


def ensemble_confidence(rows: DataFrame) -> DataFrame:
    """.5 mean pipeline + .4 mean row + .1 min(.1 sources, .3), boosted by .2 of the filled share, at most 1."""
    by = rows.groupBy("doc_id").agg(
        F.avg("pipeline_confidence").alias("p"), F.avg("confidence").alias("c"), F.count_distinct("extractor").alias("k"),
        F.avg("filled").alias("f")
    )
    base = 0.5 * F.col("p") + 0.4 * F.col("c") + 0.1 * F.least(0.1 * F.col("k"), F.lit(0.3))
    return by.select("doc_id", rounded(base).alias("ensemble"), rounded(F.least(base + 0.2 * F.col("f"), F.lit(1.0))).alias("boosted"))


def totals_check(rows: DataFrame, totals: DataFrame, within: float = 0.05) -> DataFrame:
    """Sums of national, foreign and all rows against a statement's totals, relative.

    A total that isn't stated gives null; a zero one must be met exactly. No currency counts as national.
    """
    home = F.coalesce("currency", F.lit("")).isin("", "BRL")
    sums = rows.groupBy("doc_id").agg(F.sum(F.when(home, F.abs("amount_brl")).otherwise(0)).alias("a"), F.sum(F.when(home, 0).otherwise(F.abs("amount_brl"))).alias("b"))
    near = lambda x, y: F.when(F.col(y) == 0, x == 0).when(F.col(y).isNotNull(), F.abs(x - F.col(y)) <= within * F.abs(F.col(y)))
    a, b = F.col("a"), F.col("b")
    return sums.join(totals, "doc_id").select(
        "doc_id", near(a, "national").alias("national_ok"), near(b, "international").alias("international_ok"),
        near(a + b, "overall").alias("overall_ok")
    )


def template_totals(rows: DataFrame, totals: DataFrame, within: float = 0.05) -> DataFrame:
    """Sums of BRL and of all other rows against a statement's totals, by an absolute difference; no currency counts as foreign."""
    home = F.coalesce("currency", F.lit("")) == "BRL"
    sums = rows.groupBy("doc_id").agg(F.sum(F.when(home, F.abs("amount_brl")).otherwise(0)).alias("a"), F.sum(F.when(home, 0).otherwise(F.abs("amount_brl"))).alias("b"))
    near = lambda x, y: F.abs(F.col(x) - F.col(y)) < within
    return sums.join(totals, "doc_id").select("doc_id", near("a", "national").alias("national_ok"), near("b", "international").alias("international_ok"))


def auto_golden(runs: DataFrame, golden: DataFrame, least: float = 0.95, daily: int = 5, approve: str = ".*", exclude: str = "$^") -> DataFrame:
    """Documents fit to become golden: not golden yet, sure, of 1 to 1000 rows and 0.01 to 500000, names allowed; at most `daily` a day."""
    fit = (F.col("confidence") >= least) & F.col("n").between(1, 1000) & F.col("total").between(0.01, 500000) & F.col("name").rlike(approve) & ~F.col("name").rlike(exclude)
    w = W.partitionBy("day").orderBy(F.desc("confidence"), "name")
    rows = runs.filter(fit).join(golden.select("name").distinct(), "name", "left_anti").withColumn("rank", F.row_number().over(w))
    return rows.filter(F.col("rank") <= daily)
