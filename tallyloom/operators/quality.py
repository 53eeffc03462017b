"""Validation, diff, grading, expectations and scores, each one pass per table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import confidence
from ..functions import text as t
from ..sources.golden_store import publish
from .linkage import aligned, cents

#: The fields whose cells are compared; the critical ones count twice and decide the grade.
CRITICAL = ("date", "amount_brl", "description", "category")
FIELDS = (*CRITICAL, "currency", "merchant_city", "fx_rate", "card_last4")


def _alike(a: Column, b: Column, least: int) -> Column:
    """Equal without case and outer blanks, or one inside the other where both are longer than `least`."""
    x, y = F.trim(F.upper(a)), F.trim(F.upper(b))
    return (x == y) | ((F.length(x) > least) & (F.length(y) > least) & (x.contains(y) | y.contains(x)))


#: How a field's cells are compared, by name; others must be equal.
COMPARATORS = {
    "date": lambda a, b: a == b,
    "amount_brl": lambda a, b: F.abs(a - b) < 0.01,
    "fx_rate": lambda a, b: F.abs(a - b) < 0.01,
    "description": lambda a, b: _alike(a, b, 10),
    "category": lambda a, b: F.upper(a) == F.upper(b),
    "merchant_city": lambda a, b: _alike(a, b, 5),
}


def same(field: str, a: Column, b: Column) -> Column:
    """Whether two cells of a field agree; two missing ones do, a missing and another don't."""
    compare = COMPARATORS.get(field, lambda x, y: x == y)
    return F.when(a.isNull() | b.isNull(), a.isNull() & b.isNull()).otherwise(compare(a, b))


def rounded(x: Column) -> Column:
    """Six places, halves up whatever the order of the sums that x was made of."""
    return F.floor(x * 1_000_000 + F.lit(0.500001)) / 1_000_000


def f1(p: Column, r: Column) -> Column:
    return F.coalesce(F.try_divide(2 * p * r, p + r), F.lit(0.0))


def rates(tp: Column, found: Column, golden: Column) -> list[Column]:
    """precision, recall and f1: both sides empty 1, one empty 0."""
    p = F.when((found == 0) & (golden == 0), 1.0).otherwise(F.coalesce(F.try_divide(tp, found), F.lit(0.0)))
    r = F.when((found == 0) & (golden == 0), 1.0).otherwise(F.coalesce(F.try_divide(tp, golden), F.lit(0.0)))
    return [F.round(x, 6).alias(n) for x, n in ((p, "precision"), (r, "recall"), (f1(p, r), "f1"))]


def prf(found: DataFrame, golden: DataFrame, multiset: bool = True) -> DataFrame:
    """Per document precision, recall and F1 on (date, amount), as multisets or sets."""
    key = ["doc_id", "date", "cents"]
    count = lambda d, n: d.withColumn("cents", cents(F.col("amount_brl"))).groupBy(*key).agg(F.count("*").alias(n))
    both = count(found, "a").join(count(golden, "b"), key, "full_outer").fillna(0, ["a", "b"])
    if not multiset:
        both = both.withColumns({c: F.least(F.col(c), F.lit(1)) for c in ("a", "b")})
    sums = both.groupBy("doc_id").agg(F.sum(F.least("a", "b")).alias("tp"), F.sum("a").alias("found"), F.sum("b").alias("golden"))
    return sums.select("doc_id", "tp", "found", "golden", *rates(F.col("tp"), F.col("found"), F.col("golden")))


def cells(found: DataFrame, golden: DataFrame, order: str, fields: Sequence[str] | None = None, examples: int = 5) -> DataFrame:
    """Per document and field: golden cells, correct, incorrect, missing and extra ones, their rates and the first examples of errors.

    Fields are those of FIELDS that both tables have, unless named.
    """
    fields = fields or [f for f in FIELDS if f in found.columns and f in golden.columns]
    pairs = aligned(found, golden, order)
    text = lambda c: F.coalesce(c.cast("string"), F.lit("-"))
    got = lambda f: (F.col(f"f.{f}"), F.col(f"g.{f}"))
    items = [F.struct(F.lit(f).alias("field"), same(f, *got(f)).alias("same"), text(got(f)[0]).alias("got"), text(got(f)[1]).alias("want")) for f in fields]
    rows = pairs.select(
        "doc_id", F.col("f").isNotNull().alias("has_f"), F.col("g").isNotNull().alias("has_g"),
        F.coalesce(f"g.{order}", f"f.{order}").alias("at"), F.explode(F.array(*items)).alias("c")
    )
    both = F.col("has_f") & F.col("has_g")
    out = rows.groupBy("doc_id", "c.field").agg(
        F.count_if("has_g").alias("total"), F.count_if(both & F.col("c.same")).alias("correct"), F.count_if(both & ~F.col("c.same")).alias("incorrect"),
        F.count_if(~F.col("has_f")).alias("missing"), F.count_if(~F.col("has_g")).alias("extra"),
    )
    ratio = lambda *d: F.round(F.coalesce(F.try_divide(F.col("correct"), sum(map(F.col, d[1:]), F.col(d[0]))), F.lit(0.0)), 6)
    out = out.withColumns({"accuracy": ratio("total"), "precision": ratio("correct", "incorrect", "extra"), "recall": ratio("correct", "missing")})
    out = out.withColumn("f1", F.round(f1(F.col("precision"), F.col("recall")), 6))
    if not examples:
        return out
    wrong = rows.filter(F.col("has_g") & ~(both & F.col("c.same"))).select(
        "doc_id", "c.field", "at",
        F.when(both, F.concat(F.lit("Expected: "), "c.want", F.lit(", Got: "), "c.got")).otherwise(F.concat(F.lit("Missing: "), "c.want")).alias("error")
    )
    return out.join(first_of(wrong, ["doc_id", "field"], ["at", "error"], "error", examples, "examples"), ["doc_id", "field"], "left")


def first_of(rows: DataFrame, key: Sequence[str], order: Sequence[str], value: str, k: int, name: str) -> DataFrame:
    """The first k values of each key, as an array."""
    ranked = rows.withColumn("\0n", F.row_number().over(W.partitionBy(*key).orderBy(*order))).filter(F.col("`\0n`") <= k)
    return ranked.groupBy(*key).agg(F.transform(F.array_sort(F.collect_list(F.struct("\0n", value))), lambda x: x[value]).alias(name))


def health(accuracies: DataFrame, critical: Sequence[str] = CRITICAL) -> DataFrame:
    """Per document the overall accuracy (critical fields count twice), the critical one, the grade and advice."""
    is_critical = F.col("field").isin(*critical)
    w = F.when(is_critical, 2.0).otherwise(1.0)
    out = accuracies.groupBy("doc_id").agg(
        rounded(F.sum(w * F.col("accuracy")) / F.sum(w)).alias("overall"), rounded(F.coalesce(F.avg(F.when(is_critical, F.col("accuracy"))), F.lit(0.0))).alias("critical"),
        F.slice(F.array_sort(F.collect_list(F.struct("accuracy", "field"))), 1, 3).alias("\0worst"),
    )
    out = out.withColumn("grade", confidence.grade(rounded(0.4 * F.col("overall") + 0.6 * F.col("critical"))))
    return out.withColumn("advice", advice(F.col("grade"), F.col("`\0worst`"))).drop("\0worst")


def advice(grade: Column, worst: Column) -> Column:
    """What a grade means for the use of an extractor; the poor ones name their worst fields."""
    issues = F.array_join(F.transform(worst, lambda x: F.concat(x["field"], F.lit(" ("), F.format_number(100 * x["accuracy"], 1), F.lit("%)"))), ", ")
    poor = F.concat(F.lit("Poor performance. Major issues with: "), issues, F.lit(". Consider alternative methods."))
    said = F.when(grade.isin("A+", "A"), "Excellent performance. Use as primary extractor.").when(
        grade.isin("B+", "B"), "Good performance. Suitable for production with light review."
    )
    return said.when(grade.isin("C+", "C"), "Fair performance. Use with careful review or as secondary method.").otherwise(poor)


def amounts_match(a: Column, b: Column, within: float = 0.01) -> Column:
    """Whether two amounts written as text differ by `within` at most; a missing one matches nothing."""
    return F.coalesce(F.abs(t.amount(a) - t.amount(b)) <= F.lit(str(within)).cast("decimal(38,6)"), F.lit(False))


def dates_match(a: Column, b: Column, days: int = 1, year: int = 2024) -> Column:
    """Whether two dates written as D/M, D/M/YYYY or ISO are real and `days` apart at most."""
    day = lambda x: F.coalesce(t.iso_date(x), t.date(x, year))
    return F.coalesce(F.abs(F.datediff(day(a), day(b))) <= days, F.lit(False))


def descriptions_similar(a: Column, b: Column, least: float = 0.7) -> Column:
    """Whether two descriptions share `least` of their words."""
    return F.coalesce(t.jaccard(t.comparable(a), t.comparable(b)) >= least, F.lit(False))


def field_compare(pairs: DataFrame, days: int = 1, within: float = 0.01, least: float = 0.7) -> DataFrame:
    """Pairs (pair_id, l, r) in long form: which of date, description, amount and category agree."""
    text = lambda s: t.comparable(F.col(f"{s}.description"))
    likeness = F.round(t.jaccard(text("l"), text("r")), 6)
    item = lambda n, ok, s: F.struct(F.lit(n).alias("field"), ok.alias("matches"), s.cast("double").alias("similarity"))
    day = F.abs(F.datediff("l.date", "r.date")) <= days
    money = F.abs(cents(F.col("l.amount_brl")) - cents(F.col("r.amount_brl"))) <= round(within * 100)
    kind = F.coalesce(F.lower("l.category") == F.lower("r.category"), F.lit(True)) | (F.coalesce("l.category", F.lit("")) == "") | (F.coalesce("r.category", F.lit("")) == "")
    items = F.array(
        item("date", day, day.cast("int")), item("description", likeness >= least, likeness),
        item("amount", money, money.cast("int")), item("category", kind, kind.cast("int"))
    )
    return pairs.select("pair_id", F.explode(items).alias("i")).select("pair_id", "i.*")


#: The columns a statement's rows should have, in order.
COLUMNS = ("date", "description", "amount_brl", "category", "confidence")


def rules_of(rows: DataFrame, mostly: float = 0.95, categories: Sequence[str] = (), columns: Sequence[str] = COLUMNS) -> dict[str, tuple[Column, float]]:
    """The 14 rules of a statement's rows by name: the aggregate of its pass ratio, and the least that passes.

    Formats are judged of the raw text (date_text, amount_text) where rows have it, else of the text that dates and amounts are
    exported as; ratios are of the rows with a value.
    """
    share = lambda c: F.coalesce(F.avg(c.cast("int")), F.lit(1.0))
    filled = lambda c: F.avg(F.col(c).isNotNull().cast("int"))
    flag = lambda c: F.coalesce(c, F.lit(False)).cast("int").cast("double")
    kinds = dict(rows.dtypes)
    raw = lambda c, typed: F.col(c) if c in rows.columns else F.col(typed).cast("string")
    money = F.replace(raw("amount_text", "amount_brl"), F.lit("."), F.lit(","))
    known = F.coalesce("category", F.lit("")) == ""
    return {
        "row_count": (flag(F.count("*").between(1, 200)), 1.0),
        "columns": (F.lit(float([c for c in rows.columns if c in columns] == list(columns))), 1.0),
        "date_not_null": (filled("date"), 1.0),
        "date_format": (share(raw("date_text", "date").rlike(r"^\d{4}-\d{2}-\d{2}$")), mostly),
        "date_type": (F.lit(float(kinds["date"] == "date")), 1.0),
        "description_not_null": (filled("description"), 1.0),
        "description_length": (share(F.length("description").between(1, 200)), mostly),
        "description_not_blank": (share(~F.col("description").rlike(r"^\s*$")), 1.0),
        "amount_not_null": (filled("amount_brl"), 1.0),
        "amount_type": (F.lit(float(kinds["amount_brl"].startswith("decimal"))), 1.0),
        "amount_format": (share(money.rlike(r"^-?\d+[,.]?\d*$")), mostly),
        "category_in_set": (share(known | F.col("category").isin(*categories)), 0.8),
        "confidence_between": (share(F.col("confidence").between(0, 1)), mostly),
        "total_between": (flag(F.sum("amount_brl").between(-50000, 50000)), 1.0),
    }


def expectations(rows: DataFrame, **how) -> DataFrame:
    """The 14 rules (rules_of) of a statement's rows: rule, pass ratio and success, by document in one pass."""
    rules = rules_of(rows, **how)
    wide = rows.groupBy("doc_id").agg(*[F.round(c, 6).alias(n) for n, (c, _) in rules.items()])
    items = F.array(*[
        F.struct(F.lit(i).alias("place"), F.lit(n).alias("rule"), F.col(n).alias("ratio"), (F.col(n) >= least).alias("success")) for i,
        (n, (_, least)) in enumerate(rules.items())
    ])
    return wide.select("doc_id", F.explode(items).alias("i")).select("doc_id", "i.*")


def suite(results: DataFrame, most: int = 5) -> DataFrame:
    """Per document: success, share of rules that hold, numbers of rules, and the first failures in the rules' order."""
    failed = F.array_sort(F.collect_list(F.when(~F.col("success"), F.struct("place", "rule"))))
    return results.groupBy("doc_id").agg(
        F.bool_and("success").alias("success"), F.round(100 * F.avg(F.col("success").cast("int")), 6).alias("success_percent"), F.count("*").alias("evaluated"), F.count_if("success").alias("successful"),
        F.count_if(~F.col("success")).alias("failed"), F.array_join(F.transform(F.slice(failed, 1, most), lambda x: x["rule"]), ",").alias("failures"),
    )


def publish_gated(rows: DataFrame, path: str, **rules) -> DataFrame:
    """suite() of all rows as one statement, written once: the table appears under path only if every rule holds."""
    found = rules_of(rows, **rules)
    least = {n: x for n, (_, x) in found.items()}
    seen = publish(rows, path, {n: (F.round(c, 6), lambda v, x=x: v is not None and v >= x) for n, (c, x) in found.items()})
    results = [(path, i, n, float(seen[n][0] or 0.0), seen[n][1]) for i, n in enumerate(least)]
    return suite(rows.sparkSession.createDataFrame(results, "doc_id string, place int, rule string, ratio double, success boolean"))


def gate(rows: DataFrame, **rules) -> DataFrame:
    """(doc_id, ok): whether all rules hold; a document that can't be judged doesn't."""
    return suite(expectations(rows, **rules)).select("doc_id", F.coalesce("success", F.lit(False)).alias("ok"))


def quality_score(rows: DataFrame, runs: DataFrame) -> DataFrame:
    """.4 confidence + .3 completeness + .2 consistency + .1 speed of each document."""
    filled = ((F.col("amount_brl") != 0).cast("int") + (F.trim("description") != "").cast("int") + F.col("date").isNotNull().cast("int")) / 3
    years = F.avg(F.year("date").between(2020, 2030).cast("int"))
    money = F.avg(F.when(F.col("amount_brl") != 0, ((F.col("amount_brl") > 0) & (F.col("amount_brl") < 1_000_000)).cast("int")))
    consistent = F.when(F.count("*") < 2, 1.0).otherwise((years + F.coalesce(money, F.lit(1.0))) / 2)
    by = rows.groupBy("doc_id").agg(F.avg("confidence").alias("confidence"), F.avg(filled).alias("completeness"), consistent.alias("consistency"))
    quick = F.when(F.col("seconds") < 10, 1.0).otherwise(0.5)
    score = 0.4 * F.col("confidence") + 0.3 * F.col("completeness") + 0.2 * F.col("consistency") + 0.1 * quick
    return by.join(runs.select("doc_id", "seconds"), "doc_id").select("doc_id", F.round(score, 6).alias("quality"), confidence.speed(F.col("seconds")).alias("speed"))


def completeness(rows: DataFrame, fields: Sequence[str]) -> DataFrame:
    """Share of rows with a value, by field, in one pass."""
    wide = rows.agg(*[F.round(F.avg((F.coalesce(F.trim(F.col(f).cast("string")), F.lit("")) != "").cast("int")), 6).alias(f) for f in fields])
    return wide.unpivot([], list(fields), "field", "filled")


def confusion(rows: DataFrame, label: str, predicted: str) -> DataFrame:
    """Per class: rows, predicted rows, hits and rates, of two columns."""
    both = rows.groupBy(F.col(label).alias("l"), F.col(predicted).alias("p")).agg(F.count("*").alias("n"))
    zero = F.lit(0).cast("long")
    side = lambda c, rows, guesses, hits: F.struct(F.col(c).alias("class"), rows.alias("rows"), guesses.alias("guesses"), hits.alias("hits"))
    hit = F.when(F.col("l") == F.col("p"), F.col("n")).otherwise(zero)
    sides = both.select(F.explode(F.array(side("l", F.col("n"), zero, hit), side("p", zero, F.col("n"), zero))).alias("s")).select("s.*")
    out = sides.groupBy("class").agg(F.sum("rows").alias("support"), F.sum("guesses").alias("guesses"), F.sum("hits").alias("hits"))
    return out.select("class", "support", "guesses", "hits", *rates(F.col("hits"), F.col("guesses"), F.col("support")))
