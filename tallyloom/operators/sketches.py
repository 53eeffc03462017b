"""Run metrics as mergeable sketches: quantiles of times and the commonest errors of any longer window.

Each window and method has a row with a KLL sketch of its times and a top-k sketch of its errors,
of bounded size however many runs it has. Rows are stored once and merged into hours, days or all
methods without reading the runs again; runs.dashboard and runs.top_errors give exact values from
the runs. A quantile's rank is off by at most rank_error(size), 99 times of 100; errors'
counts are exact while a merged window has no more different ones than `tracked`.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Size of a KLL sketch, and errors that a top-k sketch tracks.
SIZE, TRACKED = 800, 1000
SCHEMA = ("start", "method", "runs", "successes", "times", "errors")


def rank_error(size: int = SIZE) -> float:
    """How far a quantile's rank may be off, as a share of the values, with 99 % confidence."""
    return 2.296 / size**0.9021


def sketched(runs: DataFrame, width: str = "5 minutes", size: int = SIZE, tracked: int = TRACKED) -> DataFrame:
    """(start, method, runs, successes, times, errors) of each window and method."""
    return runs.groupBy(F.window("ts", width).start.alias("start"), "method").agg(
        F.count("*").alias("runs"), F.count_if("success").alias("successes"), F.kll_sketch_agg_double(F.col("time_ms").cast("double"), F.lit(size)).alias("times"),
        F.expr(f"approx_top_k_accumulate(error, {tracked}) FILTER (WHERE error IS NOT NULL)").alias("errors"),
    )


def merged(sketches: DataFrame, width: str = "1 hour", keys: Sequence[str] = ("method",), tracked: int = TRACKED) -> DataFrame:
    """The same columns for longer windows; without `keys` over all methods."""
    out = sketches.groupBy(F.window("start", width).start.alias("start"), *keys).agg(
        F.sum("runs").alias("runs"), F.sum("successes").alias("successes"), F.kll_merge_agg_double("times").alias("times"),
        F.expr(f"approx_top_k_combine(errors, {tracked})").alias("errors"),
    )
    return out.select(*[F.col(c) if c in out.columns else F.lit("ALL").alias(c) for c in SCHEMA])


def quantile(times: Column, share: float) -> Column:
    """The value with this share of the times below it."""
    return F.kll_sketch_get_quantile_double(times, F.lit(float(share)))


def estimated(sketches: DataFrame, shares: Sequence[float] = (0.5, 0.95), k: int = 5) -> DataFrame:
    """start, method, runs, success_rate, p50, p95 (a column for each share) and the k commonest errors with their numbers."""
    top = F.transform(F.expr(f"approx_top_k_estimate(errors, {k})"), lambda x: F.struct(x["item"].alias("error"), x["count"].alias("n")))
    return sketches.select(
        "start", "method", "runs", F.round(F.col("successes") / F.col("runs"), 6).alias("success_rate"),
        *[quantile(F.col("times"), s).alias(f"p{round(100 * s)}") for s in shares], F.array_sort(top, lambda x, y: F.when(x["n"] != y["n"], (y["n"] - x["n"]).cast("int")).when(x["error"] < y["error"], -1).when(x["error"] > y["error"], 1).otherwise(0)).alias("top_errors"),
    )


def within_error(estimates: DataFrame, runs: DataFrame, width: str = "1 hour", share: float = 0.5, error: float | None = None) -> DataFrame:
    """(start, method, share_below, near): the exact share of times up to the estimate, and whether it is near enough."""
    name, error = f"p{round(100 * share)}", 3 * rank_error() if error is None else error
    held = runs.withColumn("start", F.window("ts", width).start).join(estimates.select("start", "method", F.col(name).alias("q")), ["start", "method"])
    out = held.groupBy("start", "method").agg(F.avg((F.col("time_ms") < F.col("q")).cast("int")).alias("below"), F.avg((F.col("time_ms") <= F.col("q")).cast("int")).alias("upto"))
    return out.select("start", "method", F.col("upto").alias("share_below"), ((F.col("below") <= share + error) & (F.col("upto") >= share - error)).alias("near"))
