"""Queries of the library's own operators, with their DuckDB twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import api
from .functions import confidence, rules
from .functions import text as t
from .operators import enrich, linkage, models, parse, quality, runs
from .plans import adapters as a
from .registry import ORACLES, QUERIES, SQL_ROWS, num, query

MONEY, NATIONAL, FOREIGN = parse.MONEY, parse.NATIONAL, parse.FOREIGN


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines parsed back into rows; count and total of each description."""
    found = parse.parse_lines(a.lines(a.rows(spark, sf_dir)))
    return found.groupBy("description").agg(F.count("*").alias("n"), F.sum("amount_brl").cast("double").alias("total"))


TEXTS = ["1.234,56", "156,78", "R$ 1.234,56", "-156,78", "", "1234.56", "1,234.56", "1.234.567", "abc", "12 345,00"]


def _texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    fixed = F.array(*map(F.lit, TEXTS))
    return a.table(spark, sf_dir, "orders").select(
        k.alias("idx"),
        F.concat(F.element_at(fixed, (k % 10 + 1).cast("int")), F.when(k % 3 == 0, (k % 97).cast("string")).otherwise("")).alias("text")
    )


SQL_TEXTS = f"WITH texts AS (SELECT o_orderkey idx, {TEXTS}[o_orderkey % 10 + 1] || CASE WHEN o_orderkey % 3 = 0 THEN (o_orderkey % 97)::VARCHAR ELSE '' END AS text FROM orders), bare AS (SELECT idx, replace(text, ' ', '') b FROM texts)"


@query(f"""{SQL_TEXTS} SELECT idx, round(coalesce(TRY_CAST(regexp_replace(CASE WHEN contains(b, ',') AND contains(b, '.') THEN replace(replace(b, '.', ''), ',', '.') WHEN contains(b, ',') THEN replace(b, ',', '.') ELSE b END, '[^0-9.\\-]', '', 'g') AS DECIMAL(38,6)), 0)::DOUBLE, 4) amount
 FROM bare""", rows=False)
def norm_amount(spark, sf_dir):
    return _texts(spark, sf_dir).select("idx", F.round(t.amount(F.col("text")).cast("double"), 4).alias("amount"))


@query(f"""{SQL_TEXTS} SELECT idx, round({num('b')}::DOUBLE, 4) c, round(coalesce({num('b')}, 0)::DOUBLE, 4) g,
 round(TRY_CAST(replace(regexp_replace(b, '[^0-9,\\-]', '', 'g'), ',', '.') AS DECIMAL(38,6))::DOUBLE, 4) d,
 round(CASE WHEN regexp_matches(b, '[0-9]') THEN TRY_CAST(replace(b, ',', '.') AS DECIMAL(38,6)) ELSE 0 END::DOUBLE, 4) f,
 round((CASE WHEN contains(b, ',') AND (NOT contains(b, '.') OR length(b) - instr(reverse(b), ',') > length(b) - instr(reverse(b), '.')) THEN {num('b')} ELSE TRY_CAST(replace(b, ',', '') AS DECIMAL(38,6)) END)::DOUBLE, 4) b
 FROM bare""", rows=False)
def norm_amount_variants(spark, sf_dir):
    return _texts(spark, sf_dir).select("idx", *[F.round(t.amount(F.col("text"), v).cast("double"), 4).alias(v.lower()) for v in "CGDFB"])


@query("""SELECT idx, TRY_CAST('2024-' || lpad((idx % 14)::VARCHAR, 2, '0') || '-' || lpad((idx % 33)::VARCHAR, 2, '0') AS DATE) short,
 TRY_CAST(year(date)::VARCHAR || '-' || strftime(date, '%m-%d') AS DATE) long,
 TRY_CAST(CASE WHEN idx % 2 = 0 THEN strftime(date, '%Y-%m-%d') END AS DATE) iso
 FROM rows""")
def norm_date(spark, sf_dir):
    k = F.col("idx")
    short = F.concat_ws("/", (k % 33).cast("string"), (k % 14).cast("string"))
    found = a.rows(spark, sf_dir)
    iso = F.when(k % 2 == 0, F.date_format("date", "yyyy-MM-dd")).otherwise(F.date_format("date", "dd/MM/yyyy"))
    return found.select("idx", t.date(short).alias("short"), t.date(F.date_format("date", "dd/MM/yyyy")).alias("long"), t.iso_date(iso).alias("iso"))


@query("""SELECT idx, trim(regexp_replace(replace(ltrim('>@ ' || description || '__x   y ', '>@§$Z)_•*®«» '), '_', ' '), '\\s{2,}', ' ', 'g')) line,
 trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(description || ' ** 12345678901234567', '\\s+', ' ', 'g'), '\\*+', '', 'g'), '\\d{16,}', '', 'g'), '[A-Z]{10,}', '', 'g')) description,
 trim(replace(replace(replace(replace(upper('cartao ' || description), 'FINAL', ''), 'CARTAO', ''), 'CART.', ''), '*', '')) model
 FROM rows""")
def clean_text(spark, sf_dir):
    d = F.col("description")
    return a.rows(spark, sf_dir).select(
        "idx", t.clean_line(F.concat(F.lit(">@ "), d, F.lit("__x   y "))).alias("line"), t.clean_description(F.concat(d, F.lit(" ** 12345678901234567"))).alias("description"), t.model_text(F.concat(F.lit("cartao "), d)).alias("model")
    )


@query("""SELECT idx, array_to_string(list_filter(string_split_regex(regexp_replace(lower(description || ', da Praça & São-João'), '[^\\p{L}\\p{N}_\\s]', ' ', 'g'), '\\s+'), lambda x: x <> '' AND x NOT IN ('de','da','do','em','na','no','a','o','e','para','com')), ' ') text
 FROM rows""")
def desc_norm(spark, sf_dir):
    return a.rows(spark, sf_dir).select("idx", t.comparable(F.concat("description", F.lit(", da Praça & São-João"))).alias("text"))


@query("""SELECT idx, TRY_CAST(regexp_extract(x, '(\\d{1,2})/(\\d{1,2})', 1) AS INT) seq,
 TRY_CAST(regexp_extract(x, '(\\d{1,2})/(\\d{1,2})', 2) AS INT) tot, nullif(regexp_extract(x, 'final (\\d{4})', 1), '') card

 FROM (SELECT idx, description || CASE WHEN idx % 2 = 0 THEN ' 0' || (idx % 9) || '/10' ELSE ' final ' || lpad((idx % 10000)::VARCHAR, 4, '0') END x
 FROM rows)""")
def installments(spark, sf_dir):
    k = F.col("idx")
    x = F.concat(
        "description",
        F.when(k % 2 == 0, F.concat(F.lit(" 0"), (k % 9).cast("string"), F.lit("/10"))).otherwise(F.concat(F.lit(" final "), F.lpad((k % 10000).cast("string"), 4, "0")))
    )
    seq, tot = t.installment(x)
    return a.rows(spark, sf_dir).select("idx", seq.alias("seq"), tot.alias("tot"), t.card_last4(x).alias("card"))


@query("""SELECT idx, round(TRY_CAST(replace(regexp_extract('Dólar de Conversão R$ 5,' || lpad((idx % 9999)::VARCHAR, 4, '0'), '^D[óo]lar de Convers[ãa]o.*?(\\d+,\\d{4})', 1), ',', '.') AS DECIMAL(18,4))::DOUBLE, 4) rate, 'SPRINGFIELD' city, CASE WHEN idx % 2 = 0 THEN 'USD' ELSE 'EUR' END currency, 10.0::DOUBLE amount
 FROM rows""")
def fx_lines(spark, sf_dir):
    k = F.col("idx")
    rate = F.concat(F.lit("Dólar de Conversão R$ 5,"), F.lpad((k % 9999).cast("string"), 4, "0"))
    line = F.concat(F.lit("SPRINGFIELD 10,00 "), F.when(k % 2 == 0, "USD").otherwise("EUR"), F.lit(" "), (k % 1000).cast("string"), F.lit(",50"))
    x = t.fx_line(line)
    return a.rows(spark, sf_dir).select(
        "idx", F.round(t.fx_rate(rate).cast("double"), 4).alias("rate"), x["city"].alias("city"), x["currency"].alias("currency"),
        F.round(x["amount"].cast("double"), 2).alias("amount")
    )



@query("""SELECT idx, substr(md5(strftime(date, '%Y-%m-%d') || '_' || description || '_' || amount_brl::VARCHAR), 1, 8) hash,
 substr(md5(strftime(date, '%Y-%m-%d') || '_' || description || '_' || amount_brl::VARCHAR || '_' || currency), 1, 8) hash4
 FROM rows""")
def ledger_hash(spark, sf_dir):
    d, x, m = F.col("date"), F.col("description"), F.col("amount_brl")
    return a.rows(spark, sf_dir).select("idx", t.ledger_hash(d, x, m).alias("hash"), t.ledger_hash(d, x, m, F.col("currency")).alias("hash4"))


@query("SELECT idx, category FROM rows")
def category_rules(spark, sf_dir):
    return a.rows(spark, sf_dir).select("idx", "category")



@query(f"""SELECT class, count(*) n
 FROM (SELECT CASE WHEN regexp_matches(lower(l), '{"|".join(rules.SUMMARY)}') THEN 'summary' WHEN regexp_matches(l, '^\\d{{2}}/\\d{{2}}') THEN 'transaction' ELSE 'noise' END class
 FROM (SELECT unnest(string_split(text, chr(10))) l FROM documents)) GROUP BY class""", rows=False)
def row_class(spark, sf_dir):
    lines = parse.lines_of(a.table(spark, sf_dir, "documents"))
    return lines.groupBy(rules.row_class(F.col("line")).alias("class")).agg(F.count("*").alias("n"))



@query("""SELECT idx, round(least(0.5 + 0.2 + CASE WHEN length(description) > 5 THEN 0.2 ELSE 0 END + least((idx % 8) * 0.02, 0.1) + CASE WHEN idx % 2 = 0 THEN 0.05 ELSE 0 END, 1.0)::DOUBLE, 6) row_c,
 round((0.25 + 0.35 + 0.2 * confidence + 0.1 * pipeline_confidence)::DOUBLE, 6) txn_c,
 round(least(0.6 * least((idx % 20) / greatest(idx % 10, 1)::DOUBLE, 1.0) + 0.4 * CASE WHEN idx % 20 > 0 THEN 0.5 ELSE 0 END, 1.0)::DOUBLE, 6) ext_c,
 round(least(0.4 * least((idx % 20) / greatest(idx % 10, 1)::DOUBLE, 1.0) + 0.3 * CASE WHEN idx % 20 > 0 THEN 0.5 ELSE 0 END + 0.3 * confidence, 1.0)::DOUBLE, 6) ext_ocr,
 round((confidence * CASE extractor WHEN 'camelot' THEN 0.9 WHEN 'pdfplumber' THEN 0.85 ELSE 1 END)::DOUBLE, 6) calibrated
 FROM rows""")
def row_confidence(spark, sf_dir):
    k = F.col("idx")
    return a.rows(spark, sf_dir).select(
        "idx", F.round(confidence.row(F.col("amount_brl"), F.col("description"), k % 8, k % 2 == 0), 6).alias("row_c"),
        F.round(confidence.transaction(F.lit(True), F.lit(True), F.col("confidence"), F.lit(False), F.col("pipeline_confidence")), 6).alias("txn_c"),
        F.round(confidence.extraction(k % 20, k % 10, (k % 20) / 2), 6).alias("ext_c"), F.round(confidence.extraction(k % 20, k % 10, (k % 20) / 2, F.col("confidence")), 6).alias("ext_ocr"),
        F.round(confidence.calibrated(F.col("confidence"), F.col("extractor")), 6).alias("calibrated"),
    )


@query("""SELECT idx, round((a*a*a + b*b*b) / (a*a + b*b), 6) weighted, least(a, b) low, greatest(a, b) high, round((a + b) / 2, 6) mean,
 CASE WHEN a >= 0.9 THEN 'accept' WHEN a >= 0.7 THEN 'review' WHEN a < 0.5 THEN 'reject' END band
 FROM (SELECT idx, round(confidence, 2) a, round(pipeline_confidence, 2) b FROM rows)""")
def confidence_merge(spark, sf_dir):
    x, y = F.round("confidence", 2), F.round("pipeline_confidence", 2)
    both = F.array(x, y)
    m = lambda how: F.round(confidence.merged(both, how), 6)
    return a.rows(spark, sf_dir).select(
        "idx", m("weighted").alias("weighted"), m("min").alias("low"), m("max").alias("high"), m("average").alias("mean"),
        rules.band(x).alias("band")
    )


@query("""SELECT idx, round((abs(amount_brl) * CASE WHEN currency IN ('', 'BRL') THEN 0.0038 ELSE 0.0638 END)::DOUBLE, 2) iof,
 CASE WHEN idx % 3 = 0 THEN 'BRL' WHEN abs(amount_brl) / (amount_brl / 5) BETWEEN 4.5 AND 6.5 AND idx % 3 = 1 THEN 'USD' ELSE 'BRL' END currency
 FROM rows""")
def iof_and_currency(spark, sf_dir):
    k, m = F.col("idx"), F.col("amount_brl")
    orig = F.when(k % 3 == 1, m / 5).when(k % 3 == 2, m * 3)
    return a.rows(spark, sf_dir).select("idx", F.round(rules.iof(m, F.col("currency")).cast("double"), 2).alias("iof"), rules.currency(m, orig).alias("currency"))





@query(""", headed AS (SELECT doc_id, line_no, CASE line_no % 10 WHEN 0 THEN 'domestic' WHEN 5 THEN 'international' END head
 FROM lines)
 SELECT section, count(*) n FROM (SELECT last_value(head IGNORE NULLS) OVER (PARTITION BY doc_id
 ORDER BY line_no) section FROM headed) GROUP BY section""")
def section_ffill(spark, sf_dir):
    k = F.col("line_no")
    x = F.when(k % 10 == 0, "Lançamentos: compras e saques").when(k % 10 == 5, "LANÇAMENTOS INTERNACIONAIS").otherwise(F.col("line"))
    found = parse.sections(a.lines(a.rows(spark, sf_dir)).withColumn("line", x))
    return found.groupBy("section").agg(F.count("*").alias("n"))


@query("""SELECT doc_id, line_no, round(amount_brl::DOUBLE, 2) amount, description FROM rows
 JOIN (SELECT line_no, doc_id d FROM lines) ON line_no = idx AND d = doc_id WHERE line_no % 2 = 1""")
def parse_fallback(spark, sf_dir):
    """Every row is a line; the even ones lack an amount, a date, a day that exists or a description, and the operator rejects them."""
    k, day, money = F.col("idx"), F.date_format("date", "dd/MM/yyyy"), F.concat(F.lit("R$ "), t.money(F.col("amount_brl")))
    bad = F.when(k % 8 == 0, F.concat_ws(" ", day, "description")).when(k % 8 == 2, F.concat_ws(" ", "description", money))
    bad = bad.when(k % 8 == 4, F.concat_ws(" ", F.lit("31/02/2024"), "description", money)).otherwise(F.concat_ws(" ", day, money))
    line = F.when(k % 2 == 1, F.concat(day, F.lit(" "), "description", F.lit("  "), money)).otherwise(bad)
    found = a.rows(spark, sf_dir).select("doc_id", k.alias("line_no"), line.alias("line"))
    out = found.withColumn("r", parse.once(parse.fallback(F.col("line")))).filter("r is not null")
    return out.select("doc_id", "line_no", F.col("r.amount_brl").cast("double").alias("amount"), "r.description")



@query("""SELECT l_orderkey doc_id, CAST(round_even(l_linenumber * 2 / 3.0, 0) AS BIGINT) bucket, count(*) n, min((l_linenumber * 2)::DOUBLE) top
 FROM lineitem GROUP BY 1, 2""", rows=False)
def cluster_words(spark, sf_dir):
    found = parse.word_rows(a.words(spark, sf_dir))
    return found.select("doc_id", "bucket", F.size(F.split("line", " ")).cast("long").alias("n"), "top")



@query("""SELECT doc_id, min(idx % 4) rank, count(*) FILTER (WHERE k = m) n
 FROM (SELECT *, idx % 4 k, min(idx % 4) OVER (PARTITION BY doc_id) m FROM rows) GROUP BY doc_id""")
def strategy_cascade(spark, sf_dir):
    found = parse.first_strategy(a.rows(spark, sf_dir).withColumn("strategy_rank", F.col("idx") % 4))
    return found.groupBy("doc_id").agg(F.min("strategy_rank").alias("rank"), F.count("*").alias("n"))


@query("""SELECT idx doc_id, i::INT idx, CASE WHEN i = 0 THEN date END dates, CASE WHEN i < 1 + idx % 3 THEN 'd' || i END words
 FROM rows, unnest(generate_series(0, (idx % 3)::INT)) u(i)""")
def entity_zip(spark, sf_dir):
    words = F.transform(F.sequence(F.lit(0), (F.col("idx") % 3).cast("int")), lambda i: F.concat(F.lit("d"), i.cast("string")))
    found = a.rows(spark, sf_dir).select(F.col("idx").alias("doc_id"), F.array("date").alias("dates"), words.alias("words"))
    return parse.zipped(found, "dates", "words")


@query("""SELECT a.doc_id, count(*) pairs FROM rows a
 JOIN second b ON a.doc_id = b.doc_id AND abs(datediff('day', a.date, b.date)) <= 1 AND abs(a.amount_brl - b.amount_brl) <= 0.01
 GROUP BY 1""")
def ensemble_pairs(spark, sf_dir):
    found = a.rows(spark, sf_dir)
    return linkage.near_classes(found, a.second(found)).groupBy("doc_id").agg(F.sum(F.col("l.n") * F.col("r.n")).alias("pairs"))


@query()
def ensemble_clusters(spark, sf_dir):
    found = a.rows(spark, sf_dir)
    both = found.withColumn("order", F.col("idx")).union(a.second(found).withColumn("order", F.col("idx") + 10_000_000_000))
    return linkage.leader_clusters(both.select("doc_id", "order", "date", "description", "amount_brl"), "order")


@query("""SELECT idx FROM (SELECT idx, row_number() OVER (PARTITION BY doc_id, date, amount_brl, description
 ORDER BY confidence DESC, idx) n FROM (SELECT * FROM rows UNION ALL SELECT * FROM second)) WHERE n = 1""")
def strict_dedup(spark, sf_dir):
    found = a.rows(spark, sf_dir)
    return linkage.strict_dedup(found.union(a.second(found)), "idx").select("idx")


@query("""SELECT doc_id, count(*) n FROM (SELECT doc_id FROM rows UNION ALL SELECT b.doc_id FROM second b
 WHERE NOT EXISTS (SELECT 1 FROM rows a
 WHERE a.doc_id = b.doc_id AND a.date = b.date AND a.description = b.description AND a.amount_brl = b.amount_brl))
 GROUP BY 1""")
def union_antidup(spark, sf_dir):
    found = a.rows(spark, sf_dir)
    return linkage.union_antidup(found, a.second(found)).groupBy("doc_id").agg(F.count("*").alias("n"))


ALIGNED = """, f AS (SELECT *, row_number() OVER (PARTITION BY doc_id, date, amount_brl ORDER BY idx) k FROM rows), g AS (SELECT *, row_number() OVER (PARTITION BY doc_id, date, amount_brl ORDER BY idx) k FROM golden),
 al AS (SELECT coalesce(f.doc_id, g.doc_id) doc_id, f.idx fi, g.idx gi, f.category fc, g.category gc FROM f FULL OUTER JOIN g ON f.doc_id = g.doc_id AND f.date = g.date AND f.amount_brl = g.amount_brl AND f.k = g.k)"""


@query(f"""{ALIGNED} SELECT doc_id, count(*) n, count(*) FILTER (WHERE fi IS NULL) missing, count(*) FILTER (WHERE gi IS NULL) extra
 FROM al GROUP BY 1""")
def align_golden(spark, sf_dir):
    found = a.rows(spark, sf_dir)
    out = linkage.aligned(found, a.golden(found), "idx")
    return out.groupBy("doc_id").agg(F.count("*").alias("n"), F.count_if(F.col("f").isNull()).alias("missing"), F.count_if(F.col("g").isNull()).alias("extra"))



RATES = "round(CASE WHEN f = 0 THEN 0 ELSE tp / f::DOUBLE END, 6) AS precision, round(CASE WHEN g = 0 THEN 0 ELSE tp / g::DOUBLE END, 6) recall, round(CASE WHEN tp = 0 THEN 0 ELSE 2.0 * (tp / f::DOUBLE) * (tp / g::DOUBLE) / (tp / f::DOUBLE + tp / g::DOUBLE) END, 6) f1"
COUNTS = "x AS (SELECT doc_id, date, amount_brl, count(*) a FROM rows GROUP BY ALL), y AS (SELECT doc_id, date, amount_brl, count(*) b FROM golden GROUP BY ALL), z AS (SELECT doc_id, coalesce(a, 0) a, coalesce(b, 0) b FROM x FULL OUTER JOIN y USING (doc_id, date, amount_brl))"


@query(f""", {COUNTS}, s AS (SELECT doc_id, sum(least(a, b))::BIGINT tp, sum(a)::BIGINT f, sum(b)::BIGINT g FROM z
 GROUP BY 1) SELECT doc_id, tp, f found, g golden, {RATES} FROM s""")
def prf_multiset(spark, sf_dir):
    found = a.rows(spark, sf_dir)
    return quality.prf(found, a.golden(found))


@query(f""", {COUNTS}, s AS (SELECT doc_id, sum(least(a, b, 1))::BIGINT tp, sum(least(a, 1))::BIGINT f, sum(least(b, 1))::BIGINT g
 FROM z GROUP BY 1) SELECT doc_id, tp, f found, g golden, {RATES} FROM s""")
def prf_set(spark, sf_dir):
    found = a.rows(spark, sf_dir)
    return quality.prf(found, a.golden(found), multiset=False)



@query("""SELECT 'missing' kind, doc_id, count(*) n FROM golden g WHERE NOT EXISTS (SELECT 1 FROM rows r
 WHERE r.doc_id = g.doc_id AND r.date = g.date AND r.amount_brl = g.amount_brl) GROUP BY ALL
 UNION ALL SELECT 'extra', doc_id, count(*) FROM rows r WHERE NOT EXISTS (SELECT 1 FROM golden g
 WHERE r.doc_id = g.doc_id AND r.date = g.date AND r.amount_brl = g.amount_brl) GROUP BY ALL""")
def missing_extra(spark, sf_dir):
    found = a.rows(spark, sf_dir)
    return linkage.missing_extra(found, a.golden(found))



@query()
def semantic_match(spark, sf_dir):
    found = a.rows(spark, sf_dir)
    return linkage.greedy_match(found, a.second(found), "idx")



@query("""SELECT idx, round(len(list_intersect(a, b)) / len(list_distinct(a || b))::DOUBLE, 6) jaccard
 FROM (SELECT idx, list_distinct(string_split(lower(description), ' ')) a, ['household', 'uber', 'netflix'] b
 FROM (SELECT idx, replace(description, '#', ' ') description FROM rows))""")
def jaccard(spark, sf_dir):
    return a.rows(spark, sf_dir).select("idx", F.round(t.jaccard(t.comparable(F.col("description")), F.lit("household uber netflix")), 6).alias("jaccard"))


@query("""SELECT doc_id, count(*) n, round(sum(amount_brl)::DOUBLE, 2) total, count(*) FILTER (WHERE currency = 'BRL') domestic,
 count(*) FILTER (WHERE currency <> 'BRL') international, min(date) first_date, max(date) last_date,
 array_to_string(list_sort(list(DISTINCT category)), ',') categories
 FROM rows GROUP BY 1""")
def statement_summary(spark, sf_dir):
    return runs.statement_summary(a.rows(spark, sf_dir)).withColumn("total", F.round("total", 2))


@query("""SELECT coalesce(method, 'ALL') AS method, count(*) runs, round(avg(success::INT), 6) success_rate,
 round(avg(confidence) FILTER (WHERE success), 6) avg_confidence, round(avg(time_ms), 4) avg_time_ms, sum(pages)::BIGINT pages, 0.0::DOUBLE AS cost
 FROM runs GROUP BY ROLLUP (method)""")
def run_metrics(spark, sf_dir):
    return runs.run_metrics(a.runs(spark, sf_dir))


@query("SELECT error, count(*) n FROM runs WHERE NOT success GROUP BY 1 ORDER BY n DESC, error LIMIT 5")
def top_errors(spark, sf_dir):
    return runs.top_errors(a.runs(spark, sf_dir))


@query("""SELECT run_id FROM (SELECT run_id, coalesce(max((confidence >= 0.9)::INT) OVER (PARTITION BY doc_id
 ORDER BY time_ms, run_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) won FROM runs) WHERE won = 0""")
def race_select(spark, sf_dir):
    return runs.race(a.runs(spark, sf_dir)).select("run_id")


@query("""SELECT time_bucket(INTERVAL '5 minutes', ts) AS start, method, count(*) runs, round(count(*) / 300.0::DOUBLE, 6) AS rate,
 round(avg(success::INT), 6) success_rate, round(quantile_cont(time_ms, 0.5), 4) p50, round(quantile_cont(time_ms, 0.95), 4) p95
 FROM runs GROUP BY ALL""")
def dashboard(spark, sf_dir):
    return runs.dashboard(a.runs(spark, sf_dir)).withColumn("start", F.col("start").cast("timestamp_ntz"))


@query("SELECT category, count(*) n FROM rows GROUP BY 1")
def category_hist(spark, sf_dir):
    return a.rows(spark, sf_dir).groupBy("category").agg(F.count("*").alias("n"))


@query("""SELECT field, round(filled, 6) filled FROM (SELECT 'category' field, avg((category <> '')::INT) filled
 FROM rows UNION ALL SELECT 'description', avg((trim(description) <> '')::INT) FROM rows
 UNION ALL SELECT 'currency', avg((idx % 4 < 2)::INT) FROM rows)""")
def field_completeness(spark, sf_dir):
    found = a.rows(spark, sf_dir).withColumn("currency", F.when(F.col("currency") != "BRL", F.col("currency")))
    return quality.completeness(found, ["category", "description", "currency"])



@query("""SELECT idx FROM (SELECT idx, row_number() OVER (PARTITION BY doc_id, idx // 3
 ORDER BY round((c*c*c + p*p*p) / (c*c + p*p) * CASE extractor WHEN 'textract' THEN 1.0 WHEN 'azure' THEN 0.95 WHEN 'pdfplumber' THEN 0.9 ELSE 0.85 END, 9) DESC, idx) n
 FROM (SELECT *, confidence c, pipeline_confidence p FROM rows)) WHERE n = 1""")
def resolve_groups(spark, sf_dir):
    return linkage.resolved(a.rows(spark, sf_dir).withColumn("leader", F.floor(F.col("idx") / 3))).select("idx")



@query("""SELECT class, sum(s)::BIGINT support, sum(p)::BIGINT guesses, sum(h)::BIGINT hits
 FROM (SELECT category class, 1 s, 0 p, 0 h FROM rows
 UNION ALL SELECT CASE WHEN idx % 17 = 0 THEN 'OUTROS' ELSE category END, 0, 1, (idx % 17 <> 0 OR category = 'OUTROS')::INT
 FROM rows) GROUP BY 1""")
def confusion(spark, sf_dir):
    found = a.rows(spark, sf_dir).withColumn("predicted", F.when(F.col("idx") % 17 == 0, "OUTROS").otherwise(F.col("category")))
    return quality.confusion(found, "category", "predicted").select("class", "support", "guesses", "hits")


@query("""SELECT name, rank FROM (SELECT name, row_number() OVER (PARTITION BY day
 ORDER BY confidence DESC, name) AS rank
 FROM (SELECT 'stmt' || run_id AS name, CAST(ts AS DATE) AS day, confidence, run_id FROM runs)
 WHERE confidence >= 0.95 AND run_id % 1000 + 1 <= 1000 AND run_id % 500 <> 0 AND run_id % 3 <> 0)
 WHERE rank <= 5""")
def auto_golden(spark, sf_dir):
    k = F.col("run_id")
    found = a.runs(spark, sf_dir).select(
        F.concat(F.lit("stmt"), k.cast("string")).alias("name"), F.to_date("ts").alias("day"), "confidence",
        (k % 1000 + 1).alias("n"), (k % 500).alias("total"), k
    )
    return runs.auto_golden(found, found.filter("run_id % 3 = 0")).select("name", F.col("rank").cast("long").alias("rank"))



@query("""SELECT idx doc_id, CASE WHEN NOT ps AND ss THEN 'fallback' WHEN ps AND ss AND sc > pc + 0.1::DOUBLE THEN 'fallback' WHEN pn = 0 AND sn > 0 THEN 'fallback' ELSE 'primary' END choice
 FROM (SELECT idx, idx % 3 <> 0 ps, idx % 2 = 0 ss, idx % 5 / 8.0::DOUBLE pc, idx % 7 / 8.0::DOUBLE sc, idx % 4 pn, idx % 9 sn FROM rows)""")
def fallback_merge(spark, sf_dir):
    """Documents for each of the rules: a primary that failed, is less sure, or is empty, and none of them."""
    k = F.col("idx")
    found = a.rows(spark, sf_dir)
    side = lambda ok, sure, n: found.select(k.alias("doc_id"), ok.alias("success"), (sure / 8).alias("confidence"), n.alias("n"))
    return linkage.chosen(side(k % 3 != 0, k % 5, k % 4), side(k % 2 == 0, k % 7, k % 9))



@query()
def category_model(spark, sf_dir):
    found = a.rows(spark, sf_dir).select("idx", "description", "category")
    model = models.train_categories(found)
    texts = found.groupBy("description", "category").agg(F.count("*").alias("n"))  # a text is predicted once
    return models.predict_categories(model, texts).groupBy("category", "predicted").agg(F.sum("n").alias("n"))


@query()
def calibrated_scores(spark, sf_dir):
    found = a.rows(spark, sf_dir).select("idx", "confidence", (F.col("idx") % 50 > F.col("idx") % 37).alias("hit"))
    return models.calibrate(found).select("idx", F.round("calibrated", 6).alias("calibrated"))


RATE = "CASE currency WHEN 'USD' THEN 5.2 WHEN 'EUR' THEN 5.8 ELSE 5.2 END"


@query(f"""SELECT idx, round(CASE WHEN idx % 2 = 0 THEN least(greatest({RATE}, CASE currency WHEN 'USD' THEN 4.5 WHEN 'EUR' THEN 5 ELSE 1 END), CASE currency WHEN 'USD' THEN 6.5 WHEN 'EUR' THEN 7 ELSE 20 END) ELSE 6 END::DOUBLE, 3) rate
 FROM rows""")
def fx_fallback(spark, sf_dir):
    m = F.col("amount_brl")
    orig = F.when(F.col("idx") % 2 == 1, m / 6)
    return a.rows(spark, sf_dir).select("idx", F.round(enrich.rate(m, orig, F.col("currency")), 3).alias("rate"))


@query("""SELECT idx, round(ln(1 + abs(amount_brl)::DOUBLE), 6) log_brl, (currency = 'USD')::INT is_usd, year(date)::INT AS year,
 quarter(date)::INT AS quarter, length(description)::INT text_length, 0::INT has_paypal
 FROM rows""")
def fx_features(spark, sf_dir):
    found = enrich.rate_features(a.rows(spark, sf_dir).withColumn("amount_orig", F.col("amount_brl") / 5))
    return found.select("idx", F.round("log_brl", 6).alias("log_brl"), "is_usd", "year", "quarter", "text_length", "has_paypal")


@query("""SELECT idx, length(description)::INT description_length, regexp_matches(description, '[0-9]') has_numbers,
 contains(lower(description), 'cart') has_card, regexp_matches(lower(description), 'parc|x|/') has_installment, amount_brl < 0 is_negative
 FROM rows""")
def ml_features(spark, sf_dir):
    return enrich.text_features(a.rows(spark, sf_dir)).select("idx", "description_length", "has_numbers", "has_card", "has_installment", "is_negative")



def _mixed_lines(found: DataFrame) -> DataFrame:
    """A line of every row: a payment, an installment, a purchase, or a purchase with a second amount."""
    k, day, money = F.col("idx"), F.date_format("date", "dd/MM"), t.money(F.col("amount_brl"))
    payment = F.concat(day, F.lit(" Pagamento efetuado "), F.lpad((k % 10000).cast("string"), 4, "0"), F.lit(" -"), money)
    installment = F.concat(day, F.lit(" "), "description", F.lit(" 0"), (k % 9 + 1).cast("string"), F.lit("/10 "), money)
    bought = F.when(k % 4 == 2, F.concat_ws(" ", day, "description", money)).otherwise(F.concat_ws(" ", day, "description", F.lit("10,00"), money))
    return found.select("doc_id", k.alias("line_no"), F.when(k % 4 == 0, payment).when(k % 4 == 1, installment).otherwise(bought).alias("line"))


@query("""SELECT doc_id, idx line_no, lpad((idx % 10000)::VARCHAR, 4, '0') code, -round(amount_brl::DOUBLE, 2) amount
 FROM rows WHERE idx % 4 = 0""")
def payment_lines(spark, sf_dir):
    found = enrich.payments(_mixed_lines(a.rows(spark, sf_dir)))
    return found.select("doc_id", "line_no", "code", F.col("amount_brl").cast("double").alias("amount"))


@query("""SELECT doc_id, idx line_no, (idx % 9 + 1)::INT seq, 10::INT tot, round(amount_brl::DOUBLE, 2) amount FROM rows
 WHERE idx % 4 = 1""")
def installment_lines(spark, sf_dir):
    found = enrich.installment_lines(_mixed_lines(a.rows(spark, sf_dir)))
    return found.select("doc_id", "line_no", "seq", "tot", F.col("amount_brl").cast("double").alias("amount"))


@query("SELECT doc_id, NOT coalesce(bool_or(length(text) > 100), false) scanned FROM documents GROUP BY 1", rows=False)
def scanned_probe(spark, sf_dir):
    return enrich.scanned(a.table(spark, sf_dir, "documents"))


@query("""SELECT name FROM (SELECT name, row_number() OVER (PARTITION BY day ORDER BY name) n
 FROM (SELECT 's' || run_id AS name, CAST(ts AS DATE) AS day FROM runs WHERE run_id % 3 <> 0)) WHERE n <= 5""")
def golden_candidates(spark, sf_dir):
    found = a.runs(spark, sf_dir).select(F.concat(F.lit("s"), F.col("run_id").cast("string")).alias("name"), F.to_date("ts").alias("day"), "run_id")
    return enrich.candidates(found, found.filter("run_id % 3 = 0"), 5).select("name")



@query(""", x AS (SELECT doc_id, idx, row_number() OVER (PARTITION BY doc_id ORDER BY idx) place FROM rows), y AS (SELECT doc_id, idx, row_number() OVER (PARTITION BY doc_id ORDER BY idx) place FROM second)
SELECT coalesce(x.doc_id, y.doc_id) doc_id, coalesce(x.place, y.place) place, x.idx a_idx, y.idx b_idx FROM x FULL JOIN y ON x.doc_id = y.doc_id AND x.place = y.place""")
def positional_zip(spark, sf_dir):
    found = a.rows(spark, sf_dir)
    return enrich.zipped_pairs(found, a.second(found), "idx").select("doc_id", F.col("place").cast("long").alias("place"), F.col("a.idx").alias("a_idx"), F.col("b.idx").alias("b_idx"))


@query("""SELECT 'category' AS column, count(*) FILTER (WHERE idx % 7 <> 0) predicted, round(avg((idx % 7 <> 0)::INT), 6) AS rate, round(avg(confidence) FILTER (WHERE idx % 7 <> 0), 6) confidence FROM rows
 UNION ALL SELECT 'currency', count(*) FILTER (WHERE currency <> 'BRL'), round(avg((currency <> 'BRL')::INT), 6), round(avg(confidence) FILTER (WHERE currency <> 'BRL'), 6)
 FROM rows""")
def prediction_coverage(spark, sf_dir):
    found = a.rows(spark, sf_dir).withColumn("currency", F.when(F.col("currency") != "BRL", F.col("currency")))
    found = found.withColumn("category", F.when(F.col("idx") % 7 == 0, F.when(F.col("idx") % 2 == 0, " ")).otherwise(F.col("category")))
    return enrich.coverage(found, ["category", "currency"], "confidence")


@query("SELECT currency, round(avg(5 + (idx % 10) / 10.0::DOUBLE), 6) rate FROM rows GROUP BY 1")
def currency_rates(spark, sf_dir):
    return enrich.mean_rates(a.rows(spark, sf_dir).withColumn("fx_rate", 5 + (F.col("idx") % 10) / 10))


@query("""SELECT method, count(*) runs, round(avg(time_ms), 4) mean_ms, min(time_ms) least_ms, max(time_ms) most_ms, round(avg(confidence), 6) confidence
 FROM runs GROUP BY 1""")
def run_benchmark(spark, sf_dir):
    return api.benchmark(a.runs(spark, sf_dir))


from . import queries_match, queries_parse  # noqa: E402, F401  they register their queries


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
