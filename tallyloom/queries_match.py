"""Queries of matching, validation, reports, sources and models, with DuckDB twins where SQL can express them."""

from __future__ import annotations

import sys

from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import api, extractors
from .functions import confidence, rules, text
from .operators import enrich, linkage, models, parse, quality, reports, runs, sketches
from .plans import adapters as a
from .registry import SQL_FULL, query
from .sources import statements


def _null_safe(x: str, y: str, same: str) -> str:
    return f"CASE WHEN {x} IS NULL OR {y} IS NULL THEN {x} IS NULL AND {y} IS NULL ELSE {same} END"


def _like(x: str, y: str, least: int) -> str:
    u, v = f"upper(trim({x}))", f"upper(trim({y}))"
    return f"{u} = {v} OR (length({u}) > {least} AND length({v}) > {least} AND (contains({u}, {v}) OR contains({v}, {u})))"


_SAME = {
    "date": "fdate = gdate", "amount_brl": "abs(famount_brl - gamount_brl) < 0.01", "description": _like("fdescription", "gdescription", 10), "category": "upper(fcategory) = upper(gcategory)",
    "currency": "fcurrency = gcurrency", "merchant_city": _like("fmerchant_city", "gmerchant_city", 5), "fx_rate": "abs(ffx_rate - gfx_rate) < 0.01", "card_last4": "fcard_last4 = gcard_last4",
}
_COLUMNS = ", ".join(f"f.{c} f{c}, g.{c} g{c}" for c in _SAME)
_CELLS = " UNION ALL ".join(f"SELECT doc_id, '{c}' field, hf, hg, {_null_safe(f'f{c}', f'g{c}', s)} ok FROM pairs" for c, s in _SAME.items())
CELLS = f"""{SQL_FULL}, f AS (SELECT *, row_number() OVER (PARTITION BY doc_id, date, amount_brl ORDER BY idx) k FROM wide), g AS (SELECT *, row_number() OVER (PARTITION BY doc_id, date, amount_brl ORDER BY idx) k FROM labelled),
pairs AS (SELECT coalesce(f.doc_id, g.doc_id) doc_id, f.idx IS NOT NULL hf, g.idx IS NOT NULL hg, {_COLUMNS} FROM f FULL OUTER JOIN g ON f.doc_id = g.doc_id AND f.date = g.date AND f.amount_brl = g.amount_brl AND f.k = g.k), cell AS ({_CELLS}),
counts AS (SELECT doc_id, field, count(*) FILTER (WHERE hg) total, count(*) FILTER (WHERE hf AND hg AND ok) correct, count(*) FILTER (WHERE hf AND hg AND NOT ok) incorrect, count(*) FILTER (WHERE NOT hf) missing, count(*) FILTER (WHERE NOT hg) extra FROM cell GROUP BY 1, 2),
rated AS (SELECT *, round(CASE WHEN total = 0 THEN 0 ELSE correct / total::DOUBLE END, 6) accuracy, round(CASE WHEN correct + incorrect + extra = 0 THEN 0 ELSE correct / (correct + incorrect + extra)::DOUBLE END, 6) p, round(CASE WHEN correct + missing = 0 THEN 0 ELSE correct / (correct + missing)::DOUBLE END, 6) r FROM counts),
graded AS (SELECT doc_id, floor((sum(accuracy * w) / sum(w)) * 1e6 + 0.500001) / 1e6 overall, floor((avg(accuracy) FILTER (WHERE w = 2)) * 1e6 + 0.500001) / 1e6 critical FROM (SELECT *, CASE WHEN field IN ('date', 'amount_brl', 'description', 'category') THEN 2 ELSE 1 END w FROM rated) GROUP BY 1),
grades AS (SELECT *, CASE WHEN s >= 0.9 THEN 'A+' WHEN s >= 0.85 THEN 'A' WHEN s >= 0.8 THEN 'B+' WHEN s >= 0.7 THEN 'B' WHEN s >= 0.6 THEN 'C+' WHEN s >= 0.5 THEN 'C' WHEN s >= 0.4 THEN 'D' ELSE 'F' END grade FROM (SELECT *, floor((0.4 * overall + 0.6 * critical) * 1e6 + 0.500001) / 1e6 s FROM graded))"""


def _both(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    found = a.full_rows(spark, sf_dir)
    return found, a.labelled(found)


@query(f"""{CELLS} SELECT doc_id, field, total, correct, incorrect, missing, extra, accuracy, p AS precision, r recall,
 round(CASE WHEN p + r = 0 THEN 0 ELSE 2 * p * r / (p + r) END, 6) f1
 FROM rated""")
def cell_accuracy(spark, sf_dir):
    """All eight fields with their comparators."""
    return quality.cells(*_both(spark, sf_dir), "idx", examples=0)


@query(f"""{CELLS} SELECT doc_id, overall, critical, grade,
 CASE WHEN grade LIKE 'A%' THEN 'Excellent' WHEN grade LIKE 'B%' THEN 'Good' WHEN grade LIKE 'C%' THEN 'Fair' ELSE 'Poor' END advice
 FROM grades""")
def health_grade(spark, sf_dir):
    found = quality.health(quality.cells(*_both(spark, sf_dir), "idx", examples=0))
    return found.withColumn("advice", F.split_part("advice", F.lit(" "), F.lit(1)))


@query(f"""{CELLS} SELECT doc_id, field, rank FROM (SELECT doc_id, field, row_number() OVER (PARTITION BY doc_id
 ORDER BY accuracy, field)::INT AS rank FROM rated) WHERE rank <= 2""")
def worst_fields(spark, sf_dir):
    return enrich.worst(quality.cells(*_both(spark, sf_dir), "idx", examples=0), 2).select("doc_id", "field", "rank")


@query(f"""{CELLS}, fk AS (SELECT DISTINCT doc_id, date, amount_brl
 FROM wide), gk AS (SELECT DISTINCT doc_id, date, amount_brl
 FROM labelled), sets AS (SELECT coalesce(fk.doc_id, gk.doc_id) doc_id, count(fk.date) f, count(gk.date) g,
 count(*) FILTER (WHERE fk.date IS NOT NULL AND gk.date IS NOT NULL) tp
 FROM fk FULL OUTER JOIN gk ON fk.doc_id = gk.doc_id AND fk.date = gk.date AND fk.amount_brl = gk.amount_brl
 GROUP BY 1)
 SELECT doc_id, grade, overall, critical, round(CASE WHEN f = 0 THEN 0 ELSE tp / f::DOUBLE END, 6) AS precision,
 round(CASE WHEN g = 0 THEN 0 ELSE tp / g::DOUBLE END, 6) recall, {", ".join(f"(SELECT accuracy FROM rated x WHERE x.doc_id = grades.doc_id AND field = '{c}') {c}_accuracy" for c in _SAME)} FROM grades
 JOIN sets USING (doc_id)""")
def health_report(spark, sf_dir):
    found = reports.health_report(*_both(spark, sf_dir))
    return found.select("doc_id", "grade", "overall", "critical", "precision", "recall", *[f"{c}_accuracy" for c in quality.FIELDS])


@query(f"""{CELLS}, named AS (SELECT split_part(doc_id, '/', 2) extractor, round(avg(overall), 6) overall, min(grade) grade
 FROM grades GROUP BY 1)
 SELECT count(*) extractors, count(*) FILTER (WHERE grade IN ('A+', 'A', 'B+', 'B')) healthy, count(*) FILTER (WHERE overall >= 0.7) productive,
 count(*) FILTER (WHERE overall < 0.5) poor, (SELECT extractor
 FROM named ORDER BY overall DESC, extractor DESC LIMIT 1) best, (SELECT extractor FROM named
 ORDER BY overall, extractor LIMIT 1) worst FROM named""")
def health_insights(spark, sf_dir):
    """A group of customers stands for an extractor."""
    graded = quality.health(quality.cells(*_both(spark, sf_dir), "idx", examples=0))
    named = graded.groupBy(F.split_part("doc_id", F.lit("/"), F.lit(2)).alias("extractor")).agg(F.round(F.avg("overall"), 6).alias("overall"), F.min("grade").alias("grade"))
    return reports.health_insights(named)


_TEXT = {c: f"lower(trim(coalesce({{}}.{c}::VARCHAR, '')))" for c in ("description", "category", "merchant_city", "card_last4")}
_FIELDS = " UNION ALL ".join(
    f"SELECT '{c}' field, {s.format('f')} = {s.format('g')} ok FROM matched JOIN wide f ON f.idx = matched.f JOIN labels1 g ON g.idx = matched.g" for c,
    s in _TEXT.items()
)
#: Golden rows of one date and about one amount are rare: where a date and nickel bucket hold one row of each side, first fit is a join.
FIT = f"""{SQL_FULL}, near AS (SELECT g.doc_id, g.idx g, f.idx f FROM labels1 g JOIN wide f ON f.doc_id = g.doc_id AND f.date = g.date AND abs(f.amount_brl - g.amount_brl) <= 0.05), matched AS (SELECT * FROM near WHERE g IN (SELECT g FROM near GROUP BY 1 HAVING count(*) = 1) AND f IN (SELECT f FROM near GROUP BY 1 HAVING count(*) = 1))"""


@query(f"""{FIT}, t AS ({_FIELDS}) SELECT field, count(*) total, count(*) FILTER (WHERE ok) correct, round(avg(ok::INT), 6) accuracy
 FROM t GROUP BY 1""")
def field_accuracy(spark, sf_dir):
    """Only documents without two rows of one date about one amount, where first fit has no choice (see the tests for the others)."""
    found, gold = _both(spark, sf_dir)
    gold = gold.dropDuplicates(["doc_id", "idx"])
    pairs = linkage.near_classes(gold, found, 0, 0.05)
    single = lambda side: pairs.groupBy("doc_id", f"{side}.date", f"{side}.cents").agg(F.sum(F.col("l.n") * F.col("r.n")).alias("n")).filter("n = 1").select("doc_id", "date", "cents")
    keep = lambda d, side: d.withColumn("cents", linkage.cents(F.col("amount_brl"))).join(single(side), ["doc_id", "date", "cents"], "left_semi").drop("cents")
    return reports.field_accuracy(keep(gold, "l"), keep(found, "r"), fields=list(_TEXT))[0]


@query()
def error_analysis(spark, sf_dir):
    """Rows of each of the four tables; checked by brute force in the tests."""
    found, gold = _both(spark, sf_dir)
    made = reports.error_analysis(gold.dropDuplicates(["doc_id", "idx"]), found, fields=list(_TEXT))
    return reports.concatenated([d.agg(F.count("*").alias("n")).select(F.lit(n).alias("table"), "n") for n, d in made.items()])


@query()
def before_after(spark, sf_dir):
    """Accuracy before and after the rules name categories anew; checked by brute force in the tests."""
    found, gold = _both(spark, sf_dir)
    poor = found.withColumn("category", F.when(F.col("idx") % 4 == 0, "OUTROS").otherwise(F.col("category")))
    return reports.before_after(
        gold.dropDuplicates(["doc_id", "idx"]), poor, {"category": rules.category(F.col("description"))},
        fields=["category", "merchant_city"]
    )


@query("""SELECT idx, round(coalesce(rate, 0)::DOUBLE, 4) rate
 FROM (SELECT r.idx, arg_min(5 + (s.idx % 10) / 10.0::DOUBLE, s.idx) rate FROM rows r LEFT
 JOIN second s ON s.doc_id = r.doc_id AND abs(s.amount_brl - r.amount_brl) <= 0.01 AND r.currency <> 'BRL'
 GROUP BY 1)""")
def fx_match(spark, sf_dir):
    found = a.rows(spark, sf_dir)
    fx = a.second(found).select("doc_id", "idx", "amount_brl", (F.lit(5) + (F.col("idx") % 10) / 10).alias("fx_rate"))
    return linkage.fx_match(found, fx, "idx").select("idx", F.round(F.coalesce("fx_rate", F.lit(0)).cast("double"), 4).alias("rate"))


@query("""SELECT idx FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, date, amount_brl, substr(c, 1, 8)
 ORDER BY conf DESC, o) n FROM (SELECT idx, doc_id, date, amount_brl, description c, confidence conf, idx o
 FROM rows UNION ALL SELECT idx, doc_id, date, amount_brl, description, confidence + 0.25, idx + 10000000000
 FROM rows WHERE idx % 3 = 0)) WHERE n = 1 AND idx NOT IN (SELECT idx FROM twins)""".replace("SELECT idx FROM (SELECT *", ", twins AS (SELECT a.idx FROM rows a JOIN rows b ON a.doc_id = b.doc_id AND a.date = b.date AND a.amount_brl = b.amount_brl AND a.idx <> b.idx) SELECT idx FROM (SELECT *", 1))
def fuzzy_merge(spark, sf_dir):
    """Rows and surer ones whose words are the same in another order; rows with a twin of another text are left to the tests."""
    found = a.rows(spark, sf_dir)
    parts = F.split("description", " ")
    turned = found.filter("idx % 3 = 0").withColumns({"description": F.array_join(F.reverse(parts), " "), "confidence": F.col("confidence") + 0.25})
    both = found.withColumn("order", F.col("idx")).unionByName(turned.withColumn("order", F.col("idx") + 10_000_000_000))
    twin = found.groupBy("doc_id", "date", "amount_brl").agg(F.count("*").alias("n")).filter("n > 1")
    out = linkage.fuzzy_merge(both.select("doc_id", "order", "idx", "date", "description", "amount_brl", "confidence"), "order")
    return out.join(twin, ["doc_id", "date", "amount_brl"], "left_anti").select("idx")


_G = "SELECT doc_id, lower(trim(CASE WHEN idx % 5 = 0 THEN 'LOJA ' || description WHEN idx % 5 = 1 THEN substr(description, 3, 9) WHEN idx % 5 = 2 THEN 'ZZ' || idx ELSE description END)) t FROM rows WHERE idx % 2 = 0 OR idx % 3 = 0"


@query(f""", g AS ({_G}), f AS (SELECT doc_id, lower(trim(description)) t FROM rows
 WHERE idx % 3 <> 0), hit AS (SELECT doc_id, t, EXISTS (SELECT 1 FROM f
 WHERE f.doc_id = g.doc_id AND f.t = g.t) e, EXISTS (SELECT 1 FROM f
 WHERE f.doc_id = g.doc_id AND (contains(f.t, g.t) OR contains(g.t, f.t))) p FROM g),
 n AS (SELECT doc_id, count(*) golden, count(*) FILTER (WHERE e) exact, count(*) FILTER (WHERE p AND NOT e) partial
 FROM hit GROUP BY 1), m AS (SELECT doc_id, count(*) found FROM f
 GROUP BY 1), z AS (SELECT coalesce(n.doc_id, m.doc_id) doc_id, coalesce(golden, 0) golden, coalesce(found, 0) found, coalesce(exact, 0) exact,
 coalesce(partial, 0) partial
 FROM n FULL OUTER JOIN m ON n.doc_id = m.doc_id)
 SELECT doc_id, golden, found, exact, partial,
 round(CASE WHEN golden = 0 THEN 0 ELSE 100.0 * (exact + partial) / golden END::DOUBLE, 6) coverage,
 round(CASE WHEN found = 0 THEN 0 ELSE 100.0 * exact / found END::DOUBLE, 6) AS precision,
 round(CASE WHEN golden = 0 THEN 0 ELSE 100.0 * exact / golden END::DOUBLE, 6) recall,
 round(CASE WHEN exact = 0 THEN 0 ELSE 200.0 * exact / (golden + found) END::DOUBLE, 6) f1
 FROM z""")
def description_matches(spark, sf_dir):
    k, d, found = F.col("idx"), F.col("description"), a.rows(spark, sf_dir)
    text = F.when(k % 5 == 0, F.concat(F.lit("LOJA "), d)).when(k % 5 == 1, F.substring(d, 3, 9)).when(k % 5 == 2, F.concat(F.lit("ZZ"), k.cast("string"))).otherwise(F.concat(F.lit(" "), d))
    return linkage.description_matches(found.filter("idx % 2 = 0 or idx % 3 = 0").withColumn("description", text), found.filter("idx % 3 <> 0"))


_X, _Y = "list_distinct(string_split(lower(replace(a, '#', ' ')), ' '))", "list_distinct(string_split(lower(replace(b, '#', ' ')), ' '))"


@query(f"""SELECT idx pair_id, field, CASE field WHEN 'date' THEN d <= 1 WHEN 'amount' THEN idx % 5 <> 0 WHEN 'category' THEN idx % 7 <> 0 OR idx % 3 = 0 ELSE s >= 0.7 END matches, CASE field WHEN 'date' THEN (d <= 1)::INT::DOUBLE WHEN 'amount' THEN (idx % 5 <> 0)::INT::DOUBLE WHEN 'category' THEN (idx % 7 <> 0 OR idx % 3 = 0)::INT::DOUBLE ELSE s END similarity

 FROM (SELECT *, idx % 4 d, round(len(list_intersect({_X}, {_Y})) / len(list_distinct({_X} || {_Y}))::DOUBLE, 6) s
 FROM (SELECT idx, description a, CASE WHEN idx % 2 = 0 THEN description || ' EXTRA WORDS' ELSE description END b
 FROM rows)), unnest(['date', 'amount', 'category', 'description']) u(field)""")
def field_compare(spark, sf_dir):
    """Days, cents, categories and words that differ by the row's number, in and out of the tolerances."""
    k, found = F.col("idx"), a.rows(spark, sf_dir)
    cent = F.when(k % 5 == 0, F.lit("0.02")).otherwise(F.lit("0.01")).cast("decimal(18,2)")
    kind = F.when(k % 3 == 0, "").when(k % 7 == 0, "ANOTHER").otherwise(F.lower("category"))
    other = F.struct(
        F.date_add("date", (k % 4).cast("int")).alias("date"),
        F.when(k % 2 == 0, F.concat("description", F.lit(" EXTRA WORDS"))).otherwise(F.col("description")).alias("description"),
        (F.col("amount_brl") + cent).cast("decimal(18,2)").alias("amount_brl"), kind.alias("category")
    )
    return quality.field_compare(found.select(k.alias("pair_id"), F.struct("date", "description", "amount_brl", "category").alias("l"), other.alias("r")))


def _other(found: DataFrame) -> DataFrame:
    """Another extraction that is alike by whole rows only: some lost, some with another category, and some that are nowhere else."""
    k = F.col("idx")
    kept = found.filter(k % 7 != 0).withColumn("category", F.when(k % 4 == 0, "X").otherwise(F.col("category")))
    far = found.filter(k % 9 == 0).select(
        *[c for c in found.columns if c not in ("idx", "date", "amount_brl", "description")], (k + 1_000_000_000).alias("idx"), F.date_add("date", 100).alias("date"),
        (F.col("amount_brl") * 3).cast("decimal(18,2)").alias("amount_brl"), F.concat(F.lit("ZZZ "), k.cast("string")).alias("description"),
    )
    return kept.unionByName(far)


#: The report of rows against _other, from the rows themselves.
REPORT = """, other AS (SELECT doc_id, idx, date, amount_brl, description, CASE WHEN idx % 4 = 0 THEN 'X' ELSE category END category FROM rows WHERE idx % 7 <> 0
 UNION ALL SELECT doc_id, idx + 1000000000, date + 100, CAST(amount_brl * 3 AS DECIMAL(18,2)), 'ZZZ ' || idx, category FROM rows WHERE idx % 9 = 0),
 ka AS (SELECT doc_id, date, description, amount_brl, max(idx) i FROM rows GROUP BY ALL), kb AS (SELECT doc_id, date, description, amount_brl, max(idx) i FROM other GROUP BY ALL),
 hits AS (SELECT ka.doc_id, count(*) tp, count(*) FILTER (WHERE x.category <> 'X' AND y.category = 'X') wrong FROM ka JOIN kb USING (doc_id, date, description, amount_brl)
 JOIN rows x ON x.idx = ka.i JOIN other y ON y.idx = kb.i GROUP BY 1),
 one AS (SELECT doc_id, count(*) n, sum(amount_brl) s FROM rows GROUP BY 1), two AS (SELECT doc_id, count(*) n, sum(amount_brl) s FROM other GROUP BY 1),
 na AS (SELECT doc_id, count(*) a FROM ka GROUP BY 1), nb AS (SELECT doc_id, count(*) b FROM kb GROUP BY 1),
 joined AS (SELECT doc_id, coalesce(tp, 0) tp, coalesce(wrong, 0) wrong, coalesce(a, 0) a, coalesce(b, 0) b, coalesce(one.n, 0) rows1, coalesce(two.n, 0) rows2, abs(coalesce(one.s, 0) - coalesce(two.s, 0)) off
 FROM one LEFT JOIN two USING (doc_id) LEFT JOIN hits USING (doc_id) LEFT JOIN na USING (doc_id) LEFT JOIN nb USING (doc_id)),
 rated AS (SELECT doc_id, tp, a - tp fp, b - tp fn, CASE WHEN a = 0 THEN 1 ELSE tp / a::DOUBLE END p, CASE WHEN b = 0 THEN 1 ELSE tp / b::DOUBLE END r,
 round(CASE WHEN tp = 0 THEN 1 ELSE (4 * tp - wrong) / (4 * tp)::DOUBLE END, 6) cell_accuracy, rows1 = rows2 count_match, off <= 0.01 total_match, off::DOUBLE difference FROM joined),
 report AS (SELECT doc_id, tp, fp, fn, round(p, 6) AS precision, round(r, 6) recall, round(CASE WHEN p + r = 0 THEN 0 ELSE 2 * p * r / (p + r) END, 6) f1, cell_accuracy, count_match, total_match, difference,
 cell_accuracy >= 0.95 AND count_match AND difference <= 0.05 AS valid FROM rated)"""


@query(f"{REPORT} SELECT * FROM report")
def semantic_report(spark, sf_dir):
    """Matches of whole rows (the tests have near ones)."""
    found = a.rows(spark, sf_dir)
    return reports.semantic_report(found, _other(found), "idx")


@query(f"""{REPORT} SELECT count(*) documents, count(*) FILTER (WHERE valid) AS valid, round(avg(valid::INT), 6) pass_rate,
 floor(avg(cell_accuracy) * 1e6 + 0.500001) / 1e6 cell_accuracy, floor(avg(f1) * 1e6 + 0.500001) / 1e6 f1 FROM report""")
def validation_summary(spark, sf_dir):
    found = a.rows(spark, sf_dir)
    return reports.validation_summary(reports.semantic_report(found, _other(found), "idx"))


@query("""SELECT name, key FROM (SELECT n.name, g.key, row_number() OVER (PARTITION BY n.name ORDER BY n.place) r
 FROM (SELECT name, unnest([f, lower(f), replace(f, '_', '-'), replace(f, '-', '_')]) t, unnest([0, 1, 2, 3]) place
 FROM (SELECT name, CASE WHEN ends_with(name, '.pdf') THEN name ELSE name || '.pdf' END f

 FROM (SELECT ['Stmt_', 'stmt-', 'stmt_'][idx % 3 + 1] || idx || CASE WHEN idx % 2 = 0 THEN '.pdf' ELSE '' END AS name
 FROM rows))) n JOIN (SELECT ['stmt_', 'stmt_', 'stmt-', 'other'][idx % 4 + 1] || idx || '.pdf' AS key
 FROM rows) g ON g.key = n.t) WHERE r = 1""")
def golden_keys(spark, sf_dir):
    k, found = F.col("idx"), a.rows(spark, sf_dir)
    pick = lambda words, n: F.element_at(F.array(*map(F.lit, words)), (k % n + 1).cast("int"))
    names = found.select(F.concat(pick(("Stmt_", "stmt-", "stmt_"), 3), k.cast("string"), F.when(k % 2 == 0, ".pdf").otherwise("")).alias("name"))
    return reports.golden_keys(names, found.select(F.concat(pick(("stmt_", "stmt_", "stmt-", "other"), 4), k.cast("string"), F.lit(".pdf")).alias("key")))


@query("""SELECT doc_id, count(*) AS rows, round(sum(amount_brl)::DOUBLE, 2) total, min(date) first_date, max(date) last_date,
 count(DISTINCT category) n_categories, array_to_string(list_sort(list(DISTINCT category)), ',') categories
 FROM golden GROUP BY 1""")
def golden_summary(spark, sf_dir):
    return api.list_golden(a.golden(a.rows(spark, sf_dir))).withColumn("total", F.round("total", 2))


@query("""SELECT count(*) files, count(*) FILTER (WHERE success) successful, count(*) FILTER (WHERE NOT success) failed, sum(run_id % 9)::BIGINT AS rows,
 round(sum(pages * CASE m WHEN 'textract' THEN 0.0015 WHEN 'google' THEN 0.001 ELSE 0 END)::DOUBLE, 4) AS cost, round(sum(time_ms), 4) time_ms,
 'camelot,google,textract' methods
 FROM (SELECT *, ['textract', 'google', 'camelot'][run_id % 3 + 1] m FROM runs)""")
def batch_summary(spark, sf_dir):
    k = F.col("run_id")
    names = F.element_at(F.array(*map(F.lit, ("textract", "google", "camelot"))), (k % 3 + 1).cast("int"))
    return reports.batch_summary(a.runs(spark, sf_dir).withColumns({"method": names, "rows": k % 9}))


@query("""SELECT doc_id, pipelines, CASE WHEN pipelines = 1 THEN n ELSE g END AS rows, CASE WHEN pipelines = 1 THEN 0 ELSE n - g END::BIGINT conflicts,
 CASE WHEN pipelines = 1 THEN 'single_pipeline' ELSE 'ensemble_merge_' || pipelines || '_pipelines' END strategy

 FROM (SELECT doc_id || '/' || (idx % 2) doc_id, count(*) n, count(DISTINCT idx // 3) g, count(DISTINCT CASE WHEN idx % 2 = 0 THEN 'one' ELSE extractor END) pipelines
 FROM rows GROUP BY 1)""")
def merge_driver(spark, sf_dir):
    k, found = F.col("idx"), a.rows(spark, sf_dir)
    groups = found.select(
        F.concat_ws("/", "doc_id", (k % 2).cast("string")).alias("doc_id"), F.floor(k / 3).alias("leader"),
        F.when(k % 2 == 0, "one").otherwise(F.col("extractor")).alias("extractor")
    )
    return reports.merge_driver(groups)


@query("""SELECT idx, round(CASE idx % 5 WHEN 0 THEN least(0.7 * CASE WHEN n > 0 THEN c ELSE 0 END + 0.3 * least(n / greatest(l, 1)::DOUBLE, 1), 1) WHEN 1 THEN CASE WHEN n > 0 THEN 0.8 * c + 0.2 * least(t / 5.0, 1) ELSE 0 END WHEN 2 THEN CASE WHEN n > 0 THEN 0.6 * c + 0.2 * least(t / 3.0, 1) + 0.2 * least(b / 100.0, 1) ELSE 0 END
 WHEN 3 THEN CASE WHEN n > 0 THEN 0.8 * c + 0.2 * least(t / 2.0, 1) ELSE 0 END ELSE CASE WHEN n = 0 THEN 0.6 ELSE least(c + CASE WHEN t > 0 THEN 0.1 ELSE 0 END, 1) END END::DOUBLE, 6) sure
 FROM (SELECT idx, confidence c, idx % 7 n, idx % 11 l, idx % 6 t, idx % 150 b FROM rows)""")
def extractor_confidence(spark, sf_dir):
    k = F.col("idx")
    name = F.element_at(F.array(*map(F.lit, ("pdfplumber", "camelot", "textract", "azure", "google"))), (k % 5 + 1).cast("int"))
    average = F.when((k % 5 != 4) | (k % 7 != 0), F.col("confidence"))
    return a.rows(spark, sf_dir).select("idx", F.round(reports.extractor_confidence(name, average, k % 7, k % 11, k % 6, k % 150), 6).alias("sure"))


@query("""SELECT idx, CASE WHEN q >= 0.8 AND c >= 0.8 THEN 'Excellent' WHEN q >= 0.6 AND c >= 0.6 THEN 'Good' WHEN q >= 0.4 AND c >= 0.4 THEN 'Fair' WHEN q >= 0.2 THEN 'Poor' ELSE 'Failed' END reliability
 FROM (SELECT idx, (idx % 21) / 20.0::DOUBLE q, (idx % 17) / 16.0::DOUBLE c FROM rows)""")
def reliability(spark, sf_dir):
    k = F.col("idx")
    return a.rows(spark, sf_dir).select("idx", reports.reliability(k % 21 / 20, k % 17 / 16).alias("reliability"))


#: Rows of which each rule fails on some documents.
MESSY = """, messy AS (SELECT doc_id, idx, CASE WHEN idx % 211 <> 0 THEN date END date, CASE WHEN idx % 31 = 0 THEN '  ' WHEN idx % 37 = 0 THEN repeat('x', 201) WHEN idx % 223 <> 0 THEN description END description, CASE WHEN idx % 227 <> 0 THEN amount_brl / CASE WHEN doc_id LIKE '%/1%' THEN 1 ELSE 100 END END amount, CASE WHEN idx % 3 = 0 THEN 'X' WHEN idx % 5 = 0 THEN '' ELSE category END category, confidence + CASE WHEN idx % 29 = 0 THEN 1 ELSE 0 END confidence FROM rows),
 judged AS (SELECT doc_id, [count(*) BETWEEN 1 AND 200, true, count(date) = count(*), coalesce(round(avg((idx % 41 <> 0)::INT) FILTER (WHERE idx % 211 <> 0), 6), 1) >= 0.95, true, count(description) = count(*), coalesce(avg((length(description) BETWEEN 1 AND 200)::INT), 1) >= 0.95, coalesce(avg((trim(description) <> '')::INT), 1) >= 1, count(amount) = count(*), true, coalesce(round(avg((idx % 43 <> 0)::INT) FILTER (WHERE idx % 227 <> 0), 6), 1) >= 0.95, round(avg((category <> 'X')::INT), 6) >= 0.8, round(avg((confidence <= 1)::INT), 6) >= 0.95, coalesce(sum(CAST(amount AS DECIMAL(18,2))) BETWEEN -50000 AND 50000, false)] ok FROM messy GROUP BY 1)"""
RULES = [
    "row_count", "columns", "date_not_null", "date_format", "date_type", "description_not_null", "description_length",
    "description_not_blank", "amount_not_null", "amount_type", "amount_format", "category_in_set", "confidence_between",
    "total_between"
]


def _messy(spark, sf_dir) -> DataFrame:
    k, found = F.col("idx"), a.rows(spark, sf_dir)
    small = F.when(F.col("doc_id").contains("/1"), F.col("amount_brl")).otherwise((F.col("amount_brl") / 100).cast("decimal(18,2)"))
    return found.select(
        "doc_id", "idx", F.when(k % 211 != 0, F.col("date")).alias("date"), F.when(k % 31 == 0, "  ").when(k % 37 == 0, F.lit("x" * 201)).when(k % 223 != 0, F.col("description")).alias("description"),
        F.when(k % 227 != 0, small).cast("decimal(18,2)").alias("amount_brl"), F.when(k % 3 == 0, "X").when(k % 5 == 0, "").otherwise(F.col("category")).alias("category"), (F.col("confidence") + F.when(k % 29 == 0, 1).otherwise(0)).alias("confidence"),
        F.when(k % 211 != 0, F.date_format("date", "yyyy-MM-dd")).alias("iso"), F.when(k % 227 != 0, small).cast("decimal(18,2)").cast("string").alias("plain"),
    ).select(
        "doc_id", "idx", "date", "description", "amount_brl", "category", "confidence", F.when(k % 41 == 0, F.date_format("date", "dd/MM/yyyy")).otherwise(F.col("iso")).alias("date_text"),
        F.when(k % 43 == 0, F.concat(F.lit("R$ "), "plain")).otherwise(F.col("plain")).alias("amount_text"),
    )


KNOWN = [n for n, _ in rules.CATEGORIES] + [rules.CATCH_ALL]


@query(f"""{MESSY} SELECT doc_id, len(list_filter(ok, lambda x: x)) = 14 success, round(100.0 * len(list_filter(ok, lambda x: x)) / 14, 6) success_percent,
 14::BIGINT evaluated, len(list_filter(ok, lambda x: x))::BIGINT successful, len(list_filter(ok, lambda x: NOT x))::BIGINT failed,
 array_to_string(list_slice(list_filter({RULES}, lambda r, i: NOT ok[i]), 1, 5), ',') failures FROM judged""")
def expectations(spark, sf_dir):
    """All 14 rules, each of which fails somewhere or by type everywhere it could."""
    return quality.suite(quality.expectations(_messy(spark, sf_dir), categories=KNOWN))


@query(f"{MESSY} SELECT doc_id, len(list_filter(ok, lambda x: x)) = 14 ok FROM judged")
def expectation_gate(spark, sf_dir):
    return api.gate(_messy(spark, sf_dir), categories=KNOWN)


@query(f"""{REPORT}, suites AS (SELECT doc_id, count(*) BETWEEN 1 AND 200 AND sum(amount_brl) BETWEEN -50000 AND 50000 ok FROM rows GROUP BY 1)
 SELECT suites.doc_id, suites.ok rules_ok, CASE WHEN suites.doc_id NOT LIKE '1992%' THEN report.valid END golden_ok, suites.ok AND (suites.doc_id LIKE '1992%' OR report.valid) ok FROM suites JOIN report USING (doc_id)""")
def suite_and_golden(spark, sf_dir):
    """Rules and golden comparison together; documents of the first year have no golden rows."""
    found = a.rows(spark, sf_dir)
    suite = quality.suite(quality.expectations(found, categories=KNOWN))
    golden = reports.semantic_report(found, _other(found), "idx").filter("doc_id not like '1992%'")
    return reports.combined(suite, golden).select("doc_id", "rules_ok", "golden_ok", "ok")


@query("""SELECT doc_id, round(0.4 * avg(c) + 0.3 * avg(((a <> 0)::INT + (trim(d) <> '')::INT + (date IS NOT NULL)::INT) / 3.0) + 0.2 * CASE WHEN count(*) < 2 THEN 1 ELSE (avg((coalesce(year(date), 0) BETWEEN 2020 AND 2030)::INT) FILTER (WHERE date IS NOT NULL) + coalesce(avg((a > 0 AND a < 1000000)::INT) FILTER (WHERE a <> 0), 1)) / 2 END + 0.1 * CASE WHEN any_value(s) < 10 THEN 1 ELSE 0.5 END, 6) quality,
 CASE WHEN any_value(s) < 1 THEN 'A+' WHEN any_value(s) < 3 THEN 'A' WHEN any_value(s) < 10 THEN 'B' WHEN any_value(s) < 30 THEN 'C' ELSE 'D' END speed

 FROM (SELECT doc_id, confidence c, CASE idx % 5 WHEN 0 THEN 0 WHEN 1 THEN -amount_brl ELSE amount_brl END a, CASE WHEN idx % 3 = 0 THEN ' ' ELSE description END d, date + INTERVAL (idx % 40) YEAR AS date, (ascii(substr(doc_id, 7, 1)) - 47) * (ascii(substr(doc_id, 4, 1)) - 47) / 2.0 s
 FROM rows) GROUP BY 1""")
def quality_score(spark, sf_dir):
    """Zero and negative amounts, blank texts, years in and out of range, and every speed."""
    k, found = F.col("idx"), a.rows(spark, sf_dir)
    amount = F.when(k % 5 == 0, 0).when(k % 5 == 1, -F.col("amount_brl")).otherwise(F.col("amount_brl")).cast("decimal(18,2)")
    rows = found.withColumns({
        "amount_brl": amount, "description": F.when(k % 3 == 0, " ").otherwise(F.col("description")),
        "date": F.add_months("date", (k % 40 * 12).cast("int"))
    })
    place = lambda n: F.ascii(F.substring("doc_id", n, 1)) - 47
    return quality.quality_score(rows, found.select("doc_id").distinct().withColumn("seconds", place(7) * place(4) / 2))


@query("""SELECT doc_id, CASE WHEN d % 3 = 0 THEN true WHEN d % 3 = 1 THEN a = 0 END national_ok,
 CASE WHEN d % 4 = 0 THEN abs(b - o) <= 0.05 * o WHEN d % 4 = 1 THEN b = 0 ELSE true END international_ok,
 CASE WHEN d % 2 = 0 THEN abs(a + b - round((a + b) * 1.04, 2)) <= 0.05 * round((a + b) * 1.04, 2) ELSE abs(a + b - round((a + b) * 1.06, 2)) <= 0.05 * round((a + b) * 1.06, 2) END overall_ok

 FROM (SELECT doc_id, any_value(ascii(right(doc_id, 1))) d, sum(CASE WHEN currency = 'BRL' THEN amount_brl ELSE 0 END) a, sum(CASE WHEN currency <> 'BRL' THEN amount_brl ELSE 0 END) b, round(sum(CASE WHEN currency <> 'BRL' THEN amount_brl ELSE 0 END) * 1.2, 2) o
 FROM rows GROUP BY 1)""")
def totals_check(spark, sf_dir):
    """Totals that are met, missed, zero or not stated, by the document's name."""
    found = a.rows(spark, sf_dir)
    home = lambda yes: F.sum(F.when((F.col("currency") == "BRL") == F.lit(yes), F.col("amount_brl")).otherwise(0))
    sums = found.groupBy("doc_id").agg(home(True).alias("a"), home(False).alias("b")).withColumn("d", F.ascii(F.right("doc_id", F.lit(1))))
    money = lambda c: F.translate(F.format_number(c, 2), ",.", ".,")
    say = lambda name, c: F.concat(F.lit(f"Total {name} R$ "), c)
    d, a_, b_ = F.col("d"), F.col("a"), F.col("b")
    national = F.when(d % 3 == 0, say("nacional", money(a_))).when(d % 3 == 1, say("NACIONAL", F.lit("0,00"))).otherwise("")
    abroad = say("internacional", F.when(d % 4 == 0, money(F.round(b_ * 1.2, 2))).when(d % 4 == 1, "0,00").otherwise(money(b_)))
    whole = say("geral", money(F.round((a_ + b_) * F.when(d % 2 == 0, F.lit("1.04").cast("decimal(3,2)")).otherwise(F.lit("1.06").cast("decimal(3,2)")), 2)))
    return runs.totals_check(found, parse.totals(sums.select("doc_id", F.concat_ws("\n", national, abroad, whole).alias("text"))))


@query("""SELECT doc_id, d % 2 = 0 OR a = 0 national_ok, true international_ok
 FROM (SELECT doc_id, any_value(ascii(right(doc_id, 1))) d, sum(CASE WHEN idx % 6 <> 0 AND currency = 'BRL' THEN amount_brl ELSE 0 END) a
 FROM rows GROUP BY 1)""")
def template_totals(spark, sf_dir):
    """Absolute differences; rows without a currency count as foreign; every second document misses its national total by half."""
    found = a.rows(spark, sf_dir).withColumn("currency", F.when(F.col("idx") % 6 != 0, F.col("currency")))
    home = F.coalesce(F.col("currency") == "BRL", F.lit(False))
    sums = found.groupBy("doc_id").agg(
        F.sum(F.when(home, F.col("amount_brl")).otherwise(0)).alias("a"),
        F.sum(F.when(~home, F.col("amount_brl")).otherwise(0)).alias("b")
    )
    totals = sums.select(
        "doc_id",
        F.when(F.ascii(F.right("doc_id", F.lit(1))) % 2 == 0, F.col("a") + F.lit("0.04").cast("decimal(18,2)")).otherwise(F.round(F.col("a") / 2, 2)).cast("decimal(18,2)").alias("national"),
        (F.col("b") - F.lit("0.04").cast("decimal(18,2)")).cast("decimal(18,2)").alias("international")
    )
    return runs.template_totals(found, totals)


@query("""SELECT doc_id, floor((e) * 1e6 + 0.500001) / 1e6 ensemble, floor((least(e + 0.2 * f / 16, 1)) * 1e6 + 0.500001) / 1e6 boosted
 FROM (SELECT doc_id, 0.5 * avg(pipeline_confidence) + 0.4 * avg(confidence) + 0.1 * least(0.1 * count(DISTINCT extractor), 0.3) e, avg(3 + 2 + (idx % 3 <> 2)::INT + (currency <> 'BRL')::INT + 1) f
 FROM rows GROUP BY 1)""")
def ensemble_confidence(spark, sf_dir):
    """Boosted by the filled fields that the rows have."""
    found = a.full_rows(spark, sf_dir)
    return runs.ensemble_confidence(found.withColumn("filled", enrich.filled_fields(found) / 16))


@query(f"""{SQL_FULL} SELECT count(*) AS rows, round(avg((w.category = l.category)::INT), 6) category, round(coalesce(avg((w.merchant_city IS NOT DISTINCT
 FROM l.merchant_city)::INT) FILTER (WHERE l.merchant_city IS NOT NULL), 0), 6) city FROM wide w
 JOIN labels1 l ON w.idx = l.idx""")
def prediction_accuracy(spark, sf_dir):
    found, gold = _both(spark, sf_dir)
    pairs = found.select("idx", F.col("category").alias("pc"), F.col("merchant_city").alias("pm")).join(gold.dropDuplicates(["idx"]).select("idx", "category", "merchant_city"), "idx")
    return reports.prediction_accuracy(pairs, {"category": ("category", "pc"), "city": ("merchant_city", "pm")})


@query("""SELECT doc_id, idx, extractor, coalesce(note, '') note
 FROM (SELECT doc_id, idx, 'a' extractor, 'n' || (idx % 3) note FROM rows
 UNION ALL SELECT doc_id, idx, 'b', NULL FROM second)""")
def tagged_union(spark, sf_dir):
    found = a.rows(spark, sf_dir).select("doc_id", "idx", "date", "amount_brl")
    out = reports.tagged_union({"a": found.withColumn("note", F.concat(F.lit("n"), (F.col("idx") % 3).cast("string"))), "b": a.second(found)})
    return out.select("doc_id", "idx", "extractor", F.coalesce("note", F.lit("")).alias("note"))


@query("""SELECT doc_id, extractor, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, extractor)::INT AS rank
 FROM (SELECT doc_id, extractor, round(avg(confidence), 6) score FROM rows GROUP BY 1, 2)""")
def ranked_extractors(spark, sf_dir):
    scores = a.rows(spark, sf_dir).groupBy("doc_id", "extractor").agg(F.round(F.avg("confidence"), 6).alias("score"))
    return reports.ranked(scores, "doc_id", "extractor", "score").select("doc_id", "extractor", "rank")


@query("SELECT DISTINCT 'in/' || strftime(date, '%Y-%m') || '.pdf' path FROM rows")
def distinct_files(spark, sf_dir):
    return reports.distinct_files(a.rows(spark, sf_dir).select(F.concat(F.lit("in/"), F.date_format("date", "yyyy-MM"), F.lit(".pdf")).alias("path")))


@query("""SELECT strftime(date, '%d/%m/%Y') date, description, replace(amount_brl::VARCHAR, '.', ',') amount_brl, card_last4, '0' installment_seq,
 '0' installment_tot, replace(coalesce(round(fx_rate, 4), 0)::DECIMAL(18,4)::VARCHAR, '.', ',') fx_rate, '0,00' iof_brl, category,
 coalesce(merchant_city, '') merchant_city, '' ledger_hash, '0,00' prev_bill_amount, '0,00' interest_amount, '0,00' amount_orig,
 currency currency_orig, '0,00' amount_usd
 FROM wide""".replace("SELECT strftime", f"{SQL_FULL} SELECT strftime", 1))
def golden_export(spark, sf_dir):
    return statements.exported(a.full_rows(spark, sf_dir))


@query("""SELECT doc_id, count(*) n, count(*) FILTER (WHERE date = 'ERROR') errors, min(source) source, min(category) category
 FROM (SELECT idx doc_id, CASE WHEN idx % 4 = 0 THEN 'ERROR' ELSE '' END date, CASE WHEN idx % 4 = 0 THEN 'ERROR' ELSE category END category, extractor source
 FROM rows) GROUP BY 1""")
def result_rows(spark, sf_dir):
    """A run of every row's own document; every fourth failed."""
    found = a.rows(spark, sf_dir).withColumn("doc_id", F.col("idx"))
    history = found.select("doc_id", "extractor", (F.col("idx") % 4 != 0).alias("success"), F.lit("E1").alias("error"), F.lit(0.5).alias("confidence"))
    out = statements.result_rows(found, history)
    return out.groupBy("doc_id").agg(
        F.count("*").alias("n"), F.count_if(F.col("date") == "ERROR").alias("errors"), F.min("source").alias("source"),
        F.min("category").alias("category")
    )


@query("""SELECT doc_id, CASE WHEN k = 0 THEN 'pipeline' WHEN k = 1 THEN 'fallback' END AS method, round(amount_brl::DOUBLE, 2) amount
 FROM (SELECT idx doc_id, idx % 3 k, amount_brl FROM rows) WHERE k < 2""")
def robust_parse(spark, sf_dir):
    """A document of each row: one the cascade reads, one only the plain reader does (a header's word drops it from the cascade), one neither does."""
    k, day, money = F.col("idx"), F.date_format("date", "dd/MM"), F.translate(F.format_number("amount_brl", 2), ",.", ".,")
    line = F.when(k % 3 == 0, F.concat_ws(" ", day, "description", money)).when(k % 3 == 1, F.concat_ws(" ", day, F.lit("VALOR R$"), "description", money)).otherwise("nada")
    out = api.robust(a.rows(spark, sf_dir).select(k.alias("doc_id"), F.lit(1).alias("line_no"), line.alias("line")))
    return out.select("doc_id", "method", F.col("amount_brl").cast("double").alias("amount"))


@query()
def ensemble_parse(spark, sf_dir):
    """The whole ensemble over a line of each row; the tests check it on small documents."""
    return api.parse_statements(a.lines(a.rows(spark, sf_dir))).select("doc_id", "idx", "extractor", "conflicts", "accepted", F.round("score", 6).alias("score"))


@query("""SELECT idx, CASE WHEN idx % 4 = 0 AND currency <> 'BRL' THEN least(greatest(CASE WHEN idx % 8 = 0 THEN 6.0 ELSE CASE currency WHEN 'USD' THEN 5.2 ELSE 5.8 END END, CASE currency WHEN 'USD' THEN 4.5 ELSE 5.0 END), CASE currency WHEN 'USD' THEN 6.5 ELSE 7.0 END) ELSE 3.0 END::DOUBLE rate, CASE WHEN idx % 25 = 2 THEN 'X' ELSE upper(n_name) END city
 FROM rows JOIN nation ON n_nationkey = idx % 25""")
def enriched_rows(spark, sf_dir):
    """Rates of foreign rows without one, and cities where empty (the model part is in the tests)."""
    k = F.col("idx")
    nations = a.table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("k"), F.col("n_name").alias("c"))
    found = a.rows(spark, sf_dir).withColumn("k", k % 25).join(nations, "k")
    rows = found.withColumns(
        {
            "description": F.concat(F.lit("loja "), F.lower("c")), "merchant_city": F.when(k % 25 == 2, "X").otherwise(" "), "fx_rate": F.when(k % 4 != 0, 3).otherwise(0).cast("decimal(12,6)"),
            "amount_orig": F.when(k % 8 == 0, F.col("amount_brl") / 6).cast("decimal(38,10)"), "amount_usd": F.lit(0).cast("decimal(18,2)"),
        }
    )
    out = models.enriched(rows, cities=nations.select(F.upper("c").alias("city")))
    return out.select("idx", F.round(F.col("fx_rate").cast("double"), 4).alias("rate"), F.col("merchant_city").alias("city"))


@query("""SELECT idx, array_to_string(list_transform(generate_series(1, least(5, idx % 8)::INT), lambda i: 'r' || (idx % 50) || '.' || i), ',') results
 FROM (SELECT idx, idx AS k FROM rows)""")
def merchant_lookup(spark, sf_dir):
    """Up to five of the results that a table has for a key."""
    found = a.rows(spark, sf_dir).select("idx", F.concat_ws("/", (F.col("idx") % 50).cast("string"), (F.col("idx") % 8).cast("string")).alias("name"))
    keys = found.select("name").distinct().withColumn("n", F.split_part("name", F.lit("/"), F.lit(2)).cast("int")).filter("n > 0")
    known = keys.select("name", F.explode(F.sequence(F.lit(1), "n")).alias("rank")).withColumn(
        "result", F.concat(F.lit("r"), F.split_part("name", F.lit("/"), F.lit(1)), F.lit("."), F.col("rank").cast("string"))
    )
    return enrich.looked_up(found, known, "name").select("idx", F.coalesce(F.array_join("results", ","), F.lit("")).alias("results"))


@query("""SELECT idx, 0.5::DOUBLE AS simple, CASE WHEN idx % 3 = 0 THEN 0.7 ELSE confidence END::DOUBLE AS pipeline, 0.8::DOUBLE AS docai, 0.0::DOUBLE AS error
 FROM rows""")
def result_envelopes(spark, sf_dir):
    x = F.when(F.col("idx") % 3 != 0, F.col("confidence"))
    return a.rows(spark, sf_dir).select("idx", *[confidence.envelope(n, x).alias(n) for n in ("simple", "pipeline", "docai", "error")])


_LOW = "CASE currency WHEN 'USD' THEN 4.5 WHEN 'EUR' THEN 5.0 ELSE 1.0 END"
_HIGH = "CASE currency WHEN 'USD' THEN 6.5 WHEN 'EUR' THEN 7.0 ELSE 20.0 END"


@query(f"""SELECT idx, round(CASE WHEN implied BETWEEN {_LOW} AND {_HIGH} THEN implied ELSE CASE currency WHEN 'EUR' THEN 5.8 ELSE 5.2 END END::DOUBLE, 6) rate,
 CASE WHEN implied BETWEEN {_LOW} AND {_HIGH} THEN 0.95 ELSE 0.5 END::DOUBLE sure
 FROM (SELECT idx, currency, CASE WHEN idx % 5 > 0 THEN 1.5 * (idx % 5) END::DOUBLE implied FROM rows)""")
def rate_predictions(spark, sf_dir):
    """Rates by the amounts where plausible, else the usual ones; the trained model's are in the tests."""
    k = F.col("idx")
    orig = F.when(k % 5 > 0, F.lit(10.0))
    rows = a.rows(spark, sf_dir).withColumns({"amount_orig": orig, "amount_brl": F.coalesce(orig * 1.5 * (k % 5), F.lit(7.0))})
    out = models.predict_rates(None, rows)
    return out.select("idx", F.round("predicted_rate", 6).alias("rate"), "sure")


@query()
def rate_model(spark, sf_dir):
    """Boosted trees on the features of foreign rows; mean absolute error by currency on held-out rows."""
    found = a.rows(spark, sf_dir).filter("currency <> 'BRL'").withColumn("fx_rate", (5 + (F.col("idx") % 10) / 10))
    found = enrich.rate_features(found.withColumn("amount_orig", F.round(F.col("amount_brl") / F.col("fx_rate"), 2)))
    train, test = models.split(found, "idx")
    model = models.train_rates(train, ["implied_rate", "log_brl", "log_orig", "is_usd", "is_eur", "month", "quarter", "text_length"])
    error = F.abs(F.col("prediction") - F.col("fx_rate"))
    return model.transform(test).groupBy("currency").agg(F.count("*").alias("n"), F.round(F.avg(error), 3).alias("error"))


@query()
def platt_scores(spark, sf_dir):
    found = a.rows(spark, sf_dir).select("idx", "confidence", (F.col("idx") % 50 > F.col("idx") % 37).alias("hit"))
    return models.platt(found, ["confidence"]).select("idx", F.round("score", 4).alias("score"))


@query(""", h AS (SELECT *, time_bucket(INTERVAL '1 hour', ts) AS start FROM runs), e AS (SELECT start, method, error, count(*) n FROM h WHERE error IS NOT NULL GROUP BY ALL),
t AS (SELECT start, method, string_agg(error || ':' || n, ',' ORDER BY n DESC, error) top FROM e GROUP BY ALL)
SELECT h.start, h.method, count(*) runs, round(avg(success::INT), 6) success_rate, true AS near, coalesce(any_value(top), '') top FROM h LEFT JOIN t ON h.start = t.start AND h.method = t.method GROUP BY 1, 2""")
def sketch_dashboard(spark, sf_dir):
    """Sketches of five minutes merged into hours: numbers, errors, and whether the median's rank is within the sketch's bound."""
    history = a.runs(spark, sf_dir)
    found = sketches.estimated(sketches.merged(sketches.sketched(history)))
    near = sketches.within_error(found, history)
    top = F.array_join(F.transform("top_errors", lambda x: F.concat_ws(":", x["error"], x["n"].cast("string"))), ",")
    return found.join(near, ["start", "method"]).select(F.col("start").cast("timestamp_ntz").alias("start"), "method", "runs", "success_rate", "near", F.coalesce(top, F.lit("")).alias("top"))


cloudpickle.register_pickle_by_value(sys.modules[__name__])  # executors need no copy of the package


class _Plain:
    """Day, text and amount of a line; a line without them raises."""

    def line(self, line_no, line):
        from datetime import date

        day, *words, money = line.split()
        if "/" not in day:
            raise ValueError(f"line {line_no}")
        return date(2024, int(day[3:5]), int(day[:2])), " ".join(words), money.replace(".", "").replace(",", "."), 0.8


@query("""SELECT doc_id, 'plain' extractor, NOT bool_or(idx % 97 = 5) success, CASE WHEN bool_or(idx % 97 = 5) THEN 0 ELSE count(*) END n,
 CASE WHEN bool_or(idx % 97 = 5) THEN 0 ELSE round(sum(amount_brl)::DOUBLE, 2) END total, 'ValueError: line ' || min(idx) FILTER (WHERE idx % 97 = 5) error FROM rows GROUP BY 1""")
def extractor_errors(spark, sf_dir):
    """A Python extractor over every line; the documents with a line that it can't read have an error row alone."""
    found, (day, money) = a.rows(spark, sf_dir), (F.date_format("date", "dd/MM"), text.money(F.col("amount_brl")))
    line = F.when(F.col("idx") % 97 == 5, "nada nada").otherwise(F.concat_ws(" ", day, "description", money))
    out = extractors.settled(extractors.extracted(found.select("doc_id", F.col("idx").alias("line_no"), line.alias("line")), _Plain))
    good = F.col("error").isNull()
    return out.groupBy("doc_id").agg(
        F.lit("plain").alias("extractor"), F.bool_and(good).alias("success"), F.count_if(good).alias("n"),
        F.round(F.coalesce(F.sum("amount_brl"), F.lit(0)).cast("double"), 2).alias("total"), F.max("error").alias("error")
    )
