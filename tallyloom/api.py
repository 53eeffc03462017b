"""The engine's commands as functions on DataFrames: parse, validate, mint, extract with fallbacks, batch and search."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import extractors
from .operators import layout, linkage, parse, quality, reports, runs
from .store import Tables

#: Extractors by name: lines (doc_id, line_no, line) to rows (doc_id, idx, date, description, amount_brl, category, confidence).
EXTRACTORS: dict[str, Callable[[DataFrame], DataFrame]] = {}
COLUMNS = ["doc_id", "idx", "date", "description", "amount_brl", "category", "confidence"]


def extractor(name: str):
    """Registers an extractor under a name."""

    def register(f: Callable[[DataFrame], DataFrame]):
        EXTRACTORS[name] = f
        return f

    return register


def python_extractor(name: str):
    """Registers a class of extractors.table_function under a name: one that raises costs its document."""

    def register(make):
        EXTRACTORS[name] = lambda lines: extractors.settled(extractors.extracted(lines, make)).withColumn("category", layout.rules.category(F.col("description")))
        return make

    return register


def _row(found: DataFrame, sure) -> DataFrame:
    d = F.col("description")
    return found.select(
        "doc_id", F.col("line_no").cast("long").alias("idx"), "date", "description", "amount_brl",
        layout.rules.category(d).alias("category"), F.round(sure, 6).alias("confidence")
    )


@extractor("pipeline")
def pipeline(lines: DataFrame) -> DataFrame:
    """The line cascade; rows of the fallback are .7 as sure."""
    return _row(parse.parse_lines(lines), layout.confidence.row(F.col("amount_brl"), F.col("description"), F.lit(0), F.lit(True)) * F.col("share"))


@extractor("simple")
def simple(lines: DataFrame) -> DataFrame:
    """First date and first amount of each line."""
    found = lines.withColumn("\0r", parse.once(parse.fallback(F.col("line")))).filter("`\0r` is not null")
    return _row(found.select("doc_id", "line_no", "`\0r`.date", "`\0r`.description", "`\0r`.amount_brl"), F.lit(0.5))


@extractor("lines")
def ocr_lines(lines: DataFrame) -> DataFrame:
    """First amount of each line, with a default date."""
    found = layout.text_rows(lines)
    return found.select("doc_id", F.col("line_no").cast("long").alias("idx"), "date", "description", "amount_brl", "category", "confidence")


def _failed(lines: DataFrame, name: str, error: str) -> DataFrame:
    """An error row of an extractor for each document."""
    none = {"idx": "long", "date": "date", "description": "string", "amount_brl": "decimal(18,2)", "category": "string"}
    return lines.select("doc_id").distinct().select(
        "doc_id", *[F.lit(None).cast(k).alias(c) for c, k in none.items()], F.lit(0.0).alias("confidence"), F.lit(name).alias("extractor"), F.lit(error).alias("error")
    )


def run_all(lines: DataFrame, names: Sequence[str] | None = None) -> DataFrame:
    """Every extractor's rows with its name. One that isn't registered, or raises before it reads anything,
    gives an error row for each document; a Python one gives error rows for the documents on which it raises."""
    parts = []
    for n in names or EXTRACTORS:
        if n not in EXTRACTORS:
            parts.append(_failed(lines, n, f"unknown extractor {n}"))
            continue
        try:
            found = EXTRACTORS[n](lines)
        except Exception as e:  # any fault of an extractor is its own
            parts.append(_failed(lines, n, f"{type(e).__name__}: {e}"[:500]))
            continue
        error = F.col("error") if "error" in found.columns else F.lit(None).cast("string")
        parts.append(found.select(*COLUMNS, F.lit(n).alias("extractor"), error.alias("error")))
    return reports.concatenated(parts)


def extraction_runs(rows: DataFrame) -> DataFrame:
    """(doc_id, extractor, success, confidence, n) of each run: it succeeds without an error and with a row."""
    good = F.col("error").isNull()
    return rows.groupBy("doc_id", "extractor").agg(
        F.bool_and(good).alias("success"),
        F.round(F.coalesce(F.avg(F.when(good, F.col("confidence"))), F.lit(0.0)), 6).alias("confidence"),
        F.count_if(good).alias("n")
    )


def raced(rows: DataFrame, names: Sequence[str], enough: float = 0.9) -> DataFrame:
    """Of run_all's rows those of each document's extractors up to the first, in the order of names, that is sure enough on average; of all if none is."""
    place = F.array_position(F.array(*map(F.lit, names)), F.col("extractor"))
    sure = rows.groupBy("doc_id", "extractor").agg(F.avg(F.when(F.col("error").isNull(), F.col("confidence"))).alias("c"))
    last = sure.groupBy("doc_id").agg(F.coalesce(F.min(F.when(F.col("c") >= enough, place)), F.lit(len(names))).alias("\0last"))
    return rows.join(last, "doc_id").filter(place <= F.col("`\0last`")).select(rows.columns)


def parse_statements(lines: DataFrame, names: Sequence[str] = ("pipeline", "simple"), threshold: float = 0.9, race: float | None = None) -> DataFrame:
    """Ensemble of extractors: groups of like rows, the best of each, and whether its merged score reaches the threshold.

    race: extractors after the first that is so sure on a document don't count there.
    """
    every = run_all(lines, names)
    every = (every if race is None else raced(every, names, race)).filter("error is null")
    # Rows are numbered in a document by extractor, then place.
    by_place = W.partitionBy("doc_id").orderBy(F.array_position(F.array(*map(F.lit, names)), F.col("extractor")), "idx", "description", "amount_brl")
    every = Tables(lines.sparkSession).keep(every.withColumn("order", F.row_number().over(by_place).cast("long")))  # each extractor runs once
    grouped = linkage.leader_clusters(every.select("doc_id", "order", "idx", "date", "description", "amount_brl", "category", "confidence", "extractor"), "order")
    average = every.groupBy("doc_id", "extractor").agg(F.avg("confidence").alias("pipeline_confidence"))
    best = linkage.resolved(grouped.join(average, ["doc_id", "extractor"]).withColumns({"place": F.col("idx"), "idx": F.col("order")}))
    return best.select(
        "doc_id", F.col("place").alias("idx"), "date", "description", "amount_brl", "category",
        "extractor", "conflicts", "score", (F.col("score") >= threshold).alias("accepted")
    )


def validate(found: DataFrame, golden: DataFrame, threshold: float = 0.85, **how) -> DataFrame:
    """semantic_report with `passed`: F1 at or above the threshold."""
    return reports.semantic_report(found, golden, **how).withColumn("passed", F.col("f1") >= threshold)


def mint_golden(rows: DataFrame, scores: DataFrame, threshold: float = 0.95, approved: DataFrame | None = None) -> DataFrame:
    """Rows of the documents that may become golden: sure enough by scores (doc_id, confidence), or approved by hand (doc_id)."""
    fit = scores.filter(F.col("confidence") >= threshold).select("doc_id")
    fit = fit if approved is None else fit.union(approved.select("doc_id")).distinct()
    return rows.join(fit, "doc_id", "left_semi")


def robust(lines: DataFrame, method: str = "pipeline", least: float = 0.1) -> DataFrame:
    """Rows of `method`; of documents where it gives none or is under `least` sure, those of the plain reader at .3, if it has any and by the rule of linkage.chosen."""
    tables = Tables(lines.sparkSession)
    first = tables.keep(EXTRACTORS[method](lines))
    state = lambda docs, d: docs.join(d.groupBy("doc_id").agg(F.count("*").alias("n"), F.avg("confidence").alias("c")), "doc_id", "left").select(
        "doc_id", (F.coalesce("n", F.lit(0)) > 0).alias("success"), F.coalesce("c", F.lit(0.0)).alias("confidence"),
        F.coalesce("n", F.lit(0)).alias("n")
    )
    weak = tables.keep(state(lines.select("doc_id").distinct(), first).filter((~F.col("success")) | (F.col("confidence") < least)))
    docs = weak.select("doc_id")
    second = tables.keep(simple(lines.join(docs, "doc_id", "left_semi")).withColumn("confidence", F.lit(0.3)))  # only where it may be taken
    choice = linkage.chosen(weak, state(docs, second))
    switched = choice.filter("choice = 'fallback'").select("doc_id")
    keep = first.join(switched, "doc_id", "left_anti").withColumn("method", F.lit(method))
    return keep.unionByName(second.join(switched, "doc_id", "left_semi").withColumn("method", F.lit("fallback")))


def with_retries(lines: DataFrame, methods: Sequence[str] = ("pipeline", "simple", "lines"), least: float = 0.5) -> DataFrame:
    """Rows of the first method that gives any and is surer than `least` on average, else those of the last; by document."""
    every = run_all(lines, methods).filter("error is null")
    scored = every.groupBy("doc_id", "extractor").agg(F.avg("confidence").alias("c"))
    place = F.array_position(F.array(*map(F.lit, methods)), F.col("extractor"))
    pick = scored.groupBy("doc_id").agg(F.coalesce(F.min(F.when(F.col("c") > least, place)), F.max(place)).alias("place"))
    chosen = pick.select("doc_id", F.get(F.array(*map(F.lit, methods)), (F.col("place") - 1).cast("int")).alias("extractor"))
    return every.join(chosen, ["doc_id", "extractor"]).drop("error")


def search(rows: DataFrame, words: str, limit: int = 20) -> DataFrame:
    """The first rows, by date, whose description holds all words, whatever their case."""
    d = F.lower("description")
    hit = F.lit(True)
    for w in words.lower().split():
        hit = hit & d.contains(w)
    return rows.filter(hit).orderBy("date", "doc_id", "idx").limit(limit)


def batch(lines: DataFrame, method: str = "pipeline") -> DataFrame:
    """One row over all documents: how many gave rows, how many rows, and the mean confidence."""
    state = lines.select("doc_id").distinct().join(robust(lines, method).groupBy("doc_id").agg(F.count("*").alias("n"), F.avg("confidence").alias("c")), "doc_id", "left")
    return state.agg(
        F.count("*").alias("documents"), F.count("n").alias("successful"), F.coalesce(F.sum("n"), F.lit(0)).alias("rows"),
        F.round(F.avg("c"), 6).alias("confidence")
    )


def health_check(found: DataFrame, golden: DataFrame, **how) -> DataFrame:
    """health_report of each document."""
    return reports.health_report(found, golden, **how)


def list_golden(golden: DataFrame) -> DataFrame:
    """golden_summary in order of the documents."""
    return reports.golden_summary(golden).orderBy("doc_id")


def metrics(history: DataFrame) -> DataFrame:
    """Run metrics, overall and by method."""
    return runs.run_metrics(history)


def benchmark(history: DataFrame) -> DataFrame:
    """Mean, least and most time, mean confidence and rows of each method's runs."""
    return history.groupBy("method").agg(
        F.count("*").alias("runs"), F.round(F.avg("time_ms"), 4).alias("mean_ms"), F.min("time_ms").alias("least_ms"),
        F.max("time_ms").alias("most_ms"), F.round(F.avg("confidence"), 6).alias("confidence")
    )


def gate(rows: DataFrame, **rules) -> DataFrame:
    """Whether each document's rows hold all rules."""
    return quality.gate(rows, **rules)
