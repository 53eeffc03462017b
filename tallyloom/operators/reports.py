"""Reports: semantic comparison, health, error analysis, summaries and set operations on extractions."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import confidence
from ..store import Tables
from . import linkage, quality


def semantic_report(
    found: DataFrame, golden: DataFrame, order: str = "idx", least: float = 0.7, tolerance: float = 0.01, days: int = 1,
    f1_empty: float = 0.0
) -> DataFrame:
    """Per document: matches, precision, recall, F1, cell accuracy, count and total checks.

    Rows are matched one to one (greedy_match) and counted without repeats; counts and totals
    are of all rows. Empty sides count as agreement; f1_empty is the F1 where precision and
    recall are 0. Valid: cells right to .95, equal counts, totals within .05.
    """
    tables = Tables(found.sparkSession)
    # Both sides and the pairs are read several times.
    slim = lambda d: tables.keep(d.select("doc_id", order, "date", "description", "amount_brl", "category"))
    found, golden = slim(found), slim(golden)
    pairs = tables.keep(linkage.greedy_match(found, golden, order, least))
    key = lambda d: d.dropna(subset=["doc_id", "date", "amount_brl"]).select(
        "doc_id", "date", linkage.cents(F.col("amount_brl")).alias("c"),
        F.coalesce(linkage.t.comparable(F.col("description")), F.lit("")).alias("w")
    ).distinct()
    count = lambda d, n: key(d).groupBy("doc_id").agg(F.count("*").alias(n))
    all_of = lambda d, n: d.groupBy("doc_id").agg(F.count("*").alias(f"{n}_rows"), F.sum("amount_brl").alias(f"{n}_total"))
    side = lambda d, n: d.select("doc_id", F.col(order).cast("long").alias(f"{n}_id"), F.struct("date", "description", "amount_brl", "category").alias(n))
    matched = pairs.join(side(found, "a"), ["doc_id", "a_id"]).join(side(golden, "b"), ["doc_id", "b_id"])
    fields = quality.field_compare(matched.select(F.struct("doc_id", "a_id").alias("pair_id"), F.col("a").alias("l"), F.col("b").alias("r")), days, tolerance, least)
    right = fields.groupBy(F.col("pair_id.doc_id").alias("doc_id")).agg(F.avg(F.col("matches").cast("int")).alias("cell_accuracy"))
    out = all_of(found, "a").join(all_of(golden, "b"), "doc_id", "full_outer").join(count(found, "a"), "doc_id", "left").join(count(golden, "b"), "doc_id", "left")
    out = out.join(pairs.groupBy("doc_id").agg(F.count("*").alias("tp")), "doc_id", "left").join(right, "doc_id", "left").fillna(0, ["a", "b", "tp", "a_rows", "b_rows", "a_total", "b_total"])
    p, r = F.coalesce(F.try_divide("tp", "a"), F.lit(1.0)), F.coalesce(F.try_divide("tp", "b"), F.lit(1.0))
    off = F.abs(F.col("a_total") - F.col("b_total"))
    out = out.select(
        "doc_id", "tp", (F.col("a") - F.col("tp")).alias("fp"), (F.col("b") - F.col("tp")).alias("fn"), F.round(p, 6).alias("precision"), F.round(r, 6).alias("recall"),
        F.round(F.when(p + r == 0, f1_empty).otherwise(F.try_divide(2 * p * r, p + r)), 6).alias("f1"), F.round(F.coalesce("cell_accuracy", F.lit(1.0)), 6).alias("cell_accuracy"),
        (F.col("a_rows") == F.col("b_rows")).alias("count_match"), (off <= tolerance).alias("total_match"), off.cast("double").alias("difference"),
    )
    return out.withColumn("valid", (F.col("cell_accuracy") >= 0.95) & F.col("count_match") & (F.col("difference") <= 0.05))


def mismatches(pairs: DataFrame) -> DataFrame:
    """Text of each cell that differs, of pairs (pair_id, l, r)."""
    wrong = quality.field_compare(pairs).filter(~F.col("matches")).select("pair_id", "field")
    value = lambda s: F.coalesce(
        *[F.when(F.col("field") == n, F.col(f"{s}.{c}").cast("string")) for n, c in (("date", "date"), ("description", "description"), ("amount", "amount_brl"), ("category", "category"))],
        F.lit("")
    )
    return wrong.join(pairs, "pair_id").select("pair_id", "field", F.concat("field", F.lit(": '"), value("l"), F.lit("' vs '"), value("r"), F.lit("'")).alias("mismatch"))


def golden_keys(names: DataFrame, golden: DataFrame) -> DataFrame:
    """(name, key): the golden key of each name: as it is, in lower case, with dashes for underscores or the reverse, in that order; a missing .pdf is added."""
    full = F.when(F.endswith("name", F.lit(".pdf")), F.col("name")).otherwise(F.concat("name", F.lit(".pdf")))
    tries = F.array(full, F.lower(full), F.replace(full, F.lit("_"), F.lit("-")), F.replace(full, F.lit("-"), F.lit("_")))
    some = names.select("name").distinct().select("name", F.posexplode(tries).alias("place", "key"))
    return some.join(golden.select("key").distinct(), "key", "left_semi").groupBy("name").agg(F.min_by("key", "place").alias("key"))


def validate_batch(found: DataFrame, golden: DataFrame, **how) -> DataFrame:
    """semantic_report of the documents (named in doc_id) that have golden rows under one of their keys."""
    keys = golden_keys(found.select(F.col("doc_id").alias("name")), golden.select(F.col("doc_id").alias("key")))
    known = found.join(keys.select(F.col("name").alias("doc_id"), "key"), "doc_id")
    mine = golden.select(F.col("doc_id").alias("key"), *[c for c in golden.columns if c != "doc_id"]).join(keys, "key").select(F.col("name").alias("doc_id"), *[c for c in golden.columns if c != "doc_id"])
    return semantic_report(known.drop("key"), mine, **how)


def combined(suite: DataFrame, golden: DataFrame) -> DataFrame:
    """Rules and golden comparison of each document; documents without golden rows pass by their rules."""
    return suite.select("doc_id", F.col("success").alias("rules_ok"), "success_percent").join(
        golden.select("doc_id", F.col("valid").alias("golden_ok"), "f1"), "doc_id", "left"
    ).withColumn("ok", F.col("rules_ok") & F.coalesce("golden_ok", F.lit(True)))


def validation_summary(reports: DataFrame) -> DataFrame:
    """One row over the reports: documents, valid ones, pass rate, mean cell accuracy and F1."""
    mean = lambda c: quality.rounded(F.avg(c))
    return reports.agg(
        F.count("*").alias("documents"), F.count_if("valid").alias("valid"), mean(F.col("valid").cast("int")).alias("pass_rate"),
        mean("cell_accuracy").alias("cell_accuracy"), mean("f1").alias("f1")
    )


def health_report(found: DataFrame, golden: DataFrame, order: str = "idx") -> DataFrame:
    """Per document: grade, advice, overall and critical accuracy, precision, recall and F1 of (date, amount) sets, and each field's accuracy."""
    by_field = quality.cells(found, golden, order, examples=0)
    wide = by_field.groupBy("doc_id").pivot("field", list(quality.FIELDS)).agg(F.first("accuracy"))
    fields = wide.select("doc_id", *[F.col(f).alias(f"{f}_accuracy") for f in quality.FIELDS])
    rates = quality.prf(found, golden, multiset=False).select("doc_id", "precision", "recall", "f1")
    return quality.health(by_field).join(rates, "doc_id", "left").join(fields, "doc_id", "left")


def health_insights(reports: DataFrame, name: str = "extractor") -> DataFrame:
    """One row over extractors' reports: how many are healthy (B or better), productive (.70) and poor (under .50), the best and the worst."""
    top = lambda f: f(name, F.struct("overall", F.col(name)))
    return reports.agg(
        F.count("*").alias("extractors"), F.count_if(F.col("grade").isin("A+", "A", "B+", "B")).alias("healthy"), F.count_if(F.col("overall") >= 0.7).alias("productive"), F.count_if(F.col("overall") < 0.5).alias("poor"),
        top(F.max_by).alias("best"), top(F.min_by).alias("worst"),
    )


def shared_columns(a: DataFrame, b: DataFrame) -> list[str]:
    """Columns of both frames, in a's order."""
    return [c for c in a.columns if c in set(b.columns)]


def field_accuracy(golden: DataFrame, found: DataFrame, order: str = "idx", fields: Sequence[str] | None = None, within: float = 0.05) -> tuple[DataFrame, DataFrame]:
    """(accuracy by field, mismatched cells) of first_fit's pairs: trimmed lower-case text must be equal, missing is empty."""
    fields = list(fields or [c for c in shared_columns(golden, found) if c not in (order, "doc_id")])
    tables, columns = Tables(found.sparkSession), list(dict.fromkeys(["doc_id", order, "date", "amount_brl", *fields]))
    golden, found = tables.keep(golden.select(columns)), tables.keep(found.select(columns))  # read by the matches and by the fields
    return _field_accuracy(golden, found, tables.keep(linkage.first_fit(golden, found, order, within)), order, fields)


def _field_accuracy(golden: DataFrame, found: DataFrame, pairs: DataFrame, order: str, fields: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """field_accuracy of known pairs (doc_id, g, f)."""
    text = lambda c: F.lower(F.trim(F.coalesce(F.col(c).cast("string"), F.lit(""))))
    side = lambda d, n: d.select("doc_id", F.col(order).cast("long").alias(n), F.struct(*[text(f).alias(f) for f in fields]).alias(f"{n}_row"))
    both = pairs.join(side(golden, "g"), ["doc_id", "g"]).join(side(found, "f"), ["doc_id", "f"])
    long = both.select(
        "doc_id", "g",
        F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f"g_row.{f}").alias("golden"), F.col(f"f_row.{f}").alias("extracted")) for f in fields])).alias("c")
    ).select("doc_id", "g", "c.*")
    hit = F.col("golden") == F.col("extracted")
    return long.groupBy("field").agg(
        F.count("*").alias("total"), F.count_if(hit).alias("correct"), F.round(F.avg(hit.cast("int")), 6).alias("accuracy")
    ), long.filter(~hit)


def error_analysis(golden: DataFrame, found: DataFrame, order: str = "idx", fields: Sequence[str] | None = None, within: float = 0.05) -> dict[str, DataFrame]:
    """The four tables of an error analysis: report, mismatches, missing and extra rows. Missing and extra are of first_fit's own tolerance."""
    tables = Tables(found.sparkSession)
    golden, found = tables.keep(golden), tables.keep(found)
    fields = list(fields or [c for c in shared_columns(golden, found) if c not in (order, "doc_id")])
    pairs = tables.keep(linkage.first_fit(golden, found, order))
    near = pairs if within == 0.05 else tables.keep(linkage.first_fit(golden, found, order, within))
    report, wrong = _field_accuracy(golden, found, near, order, fields)
    lost = lambda d, n: d.join(pairs.select("doc_id", F.col(n).alias(order)), ["doc_id", order], "left_anti")
    return {"report": report, "mismatches": wrong, "missing": lost(golden, "g"), "extra": lost(found, "f")}


def before_after(golden: DataFrame, before: DataFrame, after: DataFrame | dict[str, Column], order: str = "idx", fields: Sequence[str] | None = None) -> DataFrame:
    """Accuracy by field before and after an enrichment, and the gain.

    after: the enriched rows, or the columns that the enrichment sets in before's rows. With columns,
    which can't be those that rows are matched by, rows are made, matched and joined once.
    """
    if isinstance(after, dict):
        return _gain(golden, before, after, order, list(fields or [c for c in shared_columns(golden, before) if c not in (order, "doc_id")]))
    one = lambda d, n: field_accuracy(golden, d, order, fields)[0].select("field", F.col("accuracy").alias(n))
    return one(before, "before").join(one(after, "after"), "field", "full_outer").withColumn(
        "gain", F.round(F.coalesce("after", F.lit(0.0)) - F.coalesce("before", F.lit(0.0)), 6)
    )


def _gain(golden: DataFrame, before: DataFrame, after: dict[str, Column], order: str, fields: Sequence[str]) -> DataFrame:
    """before_after of columns that an enrichment sets."""
    if clash := {"doc_id", order, "date", "amount_brl"} & set(after):
        raise ValueError(f"rows are matched by {sorted(clash)}")
    tables, columns = Tables(before.sparkSession), list(dict.fromkeys(["doc_id", order, "date", "amount_brl", *fields]))
    new = {f: after[f].alias(f"\0{f}") for f in fields if f in after}
    golden, found = tables.keep(golden.select(columns)), tables.keep(before.select(*columns, *new.values()))
    text = lambda c: F.lower(F.trim(F.coalesce(F.col(c).cast("string"), F.lit(""))))
    key = lambda n: F.col(order).cast("long").alias(n)
    labels = golden.select("doc_id", key("g"), *[text(f"`{f}`").alias(f"g_{f}") for f in fields])
    cells = found.select("doc_id", key("f"), *[text(f"`{f}`").alias(f"f_{f}") for f in fields], *[text(f"`\0{f}`").alias(f"n_{f}") for f in new])
    both = linkage.first_fit(golden, found, order).join(labels, ["doc_id", "g"]).join(cells, ["doc_id", "f"])
    right = lambda n, f: F.round(F.avg((F.col(f"`g_{f}`") == F.col(f"`{n}_{f}`")).cast("int")), 6)
    sums = both.agg(F.count("*").alias("n"), *[F.struct(F.lit(f).alias("field"), right("f", f).alias("before"), right("n" if f in new else "f", f).alias("after")).alias(f"r{i}") for i, f in enumerate(fields)])
    rows = sums.filter("n > 0").select(F.explode(F.array(*[f"r{i}" for i in range(len(fields))])).alias("r")).select("r.*")
    return rows.withColumn("gain", F.round(F.col("after") - F.col("before"), 6))


def prediction_accuracy(rows: DataFrame, pairs: dict[str, tuple[str, str]]) -> DataFrame:
    """One row: for each name the share of rows whose two columns are equal, of those that have a label."""
    right = lambda a, b: F.avg(F.when(F.coalesce(F.col(a), F.lit("")) != "", F.col(a).eqNullSafe(F.col(b)).cast("int")))
    return rows.agg(F.count("*").alias("rows"), *[F.round(F.coalesce(right(a, b), F.lit(0.0)), 6).alias(n) for n, (a, b) in pairs.items()])


def merge_driver(groups: DataFrame) -> DataFrame:
    """Per document of grouped rows (doc_id, leader, extractor): merged rows, conflicts, pipelines and the strategy's name.

    One pipeline is passed on as it is: all its rows, no conflicts.
    """
    by = groups.groupBy("doc_id").agg(F.count("*").alias("\0rows"), F.count_distinct("leader").alias("\0groups"), F.count_distinct("extractor").alias("pipelines"))
    one = F.col("pipelines") == 1
    label = F.when(one, "single_pipeline").otherwise(F.concat(F.lit("ensemble_merge_"), F.col("pipelines").cast("string"), F.lit("_pipelines")))
    return by.select(
        "doc_id", "pipelines", F.when(one, F.col("\0rows")).otherwise(F.col("\0groups")).alias("rows"),
        F.when(one, 0).otherwise(F.col("\0rows") - F.col("\0groups")).alias("conflicts"), label.alias("strategy")
    )


def extractor_confidence(extractor: Column, average: Column, rows: Column, lines: Column, tables: Column, blocks: Column) -> Column:
    """Confidence of an extraction by its extractor: rows' average and what its layout promises.

    google: average is its entities', null without any.
    """
    share = lambda n, full: F.least(n / full, F.lit(1.0))
    some = lambda score: F.when(rows > 0, score).otherwise(0.0)
    out = F.when(extractor == "pdfplumber", F.least(0.7 * F.when(rows > 0, average).otherwise(0.0) + 0.3 * share(rows, F.greatest(lines, F.lit(1))), F.lit(1.0)))
    out = out.when(extractor == "camelot", some(0.8 * average + 0.2 * share(tables, F.lit(5.0))))
    out = out.when(extractor == "textract", some(0.6 * average + 0.2 * share(tables, F.lit(3.0)) + 0.2 * share(blocks, F.lit(100.0))))
    out = out.when(extractor == "azure", some(0.8 * average + 0.2 * share(tables, F.lit(2.0))))
    return out.when(extractor == "google", F.when(average.isNull(), 0.6).otherwise(F.least(average + F.when(tables > 0, 0.1).otherwise(0.0), F.lit(1.0))))


def golden_summary(golden: DataFrame) -> DataFrame:
    """Per document: rows, total, first and last date, number and sorted names of categories."""
    named = F.sort_array(F.collect_set(F.when(F.col("category") != "", F.col("category"))))
    return golden.groupBy("doc_id").agg(
        F.count("*").alias("rows"), F.sum("amount_brl").cast("double").alias("total"), F.min("date").alias("first_date"),
        F.max("date").alias("last_date"), F.size(named).cast("long").alias("n_categories"),
        F.array_join(named, ",").alias("categories")
    )


def batch_summary(runs: DataFrame) -> DataFrame:
    """One row over a batch's runs: files, successes, failures, rows, cost, time and the methods used."""
    cost = confidence.cost(F.col("method"), F.col("pages"))
    return runs.agg(
        F.count("*").alias("files"), F.count_if("success").alias("successful"), F.count_if(~F.col("success")).alias("failed"), F.coalesce(F.sum("rows"), F.lit(0)).alias("rows"),
        F.round(F.sum(cost), 4).alias("cost"), F.round(F.sum("time_ms"), 4).alias("time_ms"), F.array_join(F.sort_array(F.collect_set(F.coalesce("method", F.lit("unknown")))), ",").alias("methods"),
    )


def reliability(score: Column, sure: Column) -> Column:
    """Word for a quality score and a confidence."""
    out = F.when(score >= 0.2, "Poor").otherwise("Failed")
    for least, name in ((0.4, "Fair"), (0.6, "Good"), (0.8, "Excellent")):
        out = F.when((score >= least) & (sure >= least), name).otherwise(out)
    return out


def tagged_union(named: dict[str, DataFrame]) -> DataFrame:
    """All extractors' rows with the extractor's name; columns that one lacks are null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [d.withColumn("extractor", F.lit(n)) for n, d in named.items()])


def concatenated(frames: Sequence[DataFrame]) -> DataFrame:
    """All frames' rows; columns that one lacks are null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def by_date(rows: DataFrame) -> DataFrame:
    """rows in the order of their date, then of their place; nulls first."""
    return rows.orderBy("doc_id", "date", "idx")


def ranked(scores: DataFrame, group: str, key: str, score: str) -> DataFrame:
    """scores with `rank` in their group, the best first and keys in order among equals."""
    return scores.withColumn("rank", F.row_number().over(W.partitionBy(group).orderBy(F.desc(score), key)))


def distinct_files(files: DataFrame, column: str = "path") -> DataFrame:
    """Each path once, in order."""
    return files.select(column).distinct().orderBy(column)
