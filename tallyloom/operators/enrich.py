"""Enrichment: rates, taxes, cities and merchants, missing fields, templates, scans and candidates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import rules
from ..functions import text as t
from ..functions.text import MONEY
from . import contain

# Plausible rates by currency, rates used without any other, words of online shops, and patterns of cities and merchants.
RATES = {"USD": (4.5, 6.5), "EUR": (5.0, 7.0), "GBP": (6.0, 8.0)}
USUAL = {"USD": 5.2, "EUR": 5.8, "GBP": 6.5}
ONLINE = ["PAYPAL", "AMAZON", "NETFLIX", "SPOTIFY", "UBER", "IFOOD", "INTERNET", "ONLINE", "WEB"]
STATES = "SP|RJ|MG|RS|PR|SC|BA|PE|CE|GO|AM|PA|MT|MS|ES|PB|RN|AL|SE|AC|RO|RR|AP|TO|DF"
CITIES = "SAO PAULO|RIO DE JANEIRO|BELO HORIZONTE|SALVADOR|BRASILIA|FORTALEZA|MANAUS|CURITIBA|RECIFE|PORTO ALEGRE"
CITY_PATTERNS = [
    rf"(?i)\b([A-Z][a-z]+(?: [A-Z][a-z]+)*)\s+(?:{STATES})\b", r"(?i)\b([A-Z][a-z]+(?: [A-Z][a-z]+)*)\s+BR\b", r"(?i)\b([A-Z][A-Z\s]+)\s+BR\b",
    rf"(?i)\b({CITIES})\b", r"(?i)\s+([A-Z]{2,}(?:\s+[A-Z]{2,})*)\s*$",
]
CARD_WORDS = ["CARTAO", "FINAL", "CARD"]
MERCHANT_PATTERNS = [r"^([A-Z][A-Za-z\s&\.]+?)(?:\s+\d|\s+[A-Z]{2,}\s|$)", r"^([A-Z][A-Za-z\s&\.]{3,20})"]
TEMPLATE_INSTALLMENT = rf"(.+?)\s+(\d{{1,2}})/(\d{{1,2}})\s+({MONEY})"
TEMPLATE_CITY, TEMPLATE_ONLINE = r"(.+?)\s+([A-Z\s]+)(?:\s+BR)?$", r"(?iu)(.+?)\s+(?:INTERNET|ONLINE|WEB)\s*([A-Z\s]*)"
TEMPLATE_SECTIONS = {"nacional": "LANÇAMENTOS NACIONAIS", "internacional": "LANÇAMENTOS INTERNACIONAIS", "pagamentos": "PAGAMENTOS EFETUADOS"}
PAYMENT = rules.PAYMENT_PARTS


def bounds(currency: Column) -> tuple[Column, Column]:
    """Least and most plausible rate: 1 and 20 for other currencies."""
    low, high = F.lit(1.0), F.lit(20.0)
    for k, (a, b) in RATES.items():
        low, high = F.when(currency == k, a).otherwise(low), F.when(currency == k, b).otherwise(high)
    return low, high


def rate(brl: Column, orig: Column, currency: Column, mean: Column | None = None) -> Column:
    """The rate the amounts imply if plausible, else the mean given, else the usual one; kept within the bounds."""
    low, high = bounds(currency)
    implied = F.try_divide(F.abs(brl), F.abs(orig)).cast("double")
    usual = F.lit(5.2)
    for k, v in USUAL.items():
        usual = F.when(currency == k, v).otherwise(usual)
    guess = F.coalesce(F.when(implied.between(low, high), implied), mean, usual) if mean is not None else F.coalesce(F.when(implied.between(low, high), implied), usual)
    return F.least(F.greatest(guess, low), high)


def rate_features(rows: DataFrame) -> DataFrame:
    """Numeric features of foreign rows: implied rate, currency flags, date parts, logs, length and word flags."""
    brl, orig = F.abs(F.col("amount_brl")).cast("double"), F.abs(F.col("amount_orig")).cast("double")
    has = lambda p: F.upper(F.coalesce("description", F.lit(""))).rlike(p).cast("int")
    return rows.withColumns(
        {
            "implied_rate": F.coalesce(F.try_divide(brl, orig), F.lit(0.0)), "log_brl": F.log1p(brl), "log_orig": F.log1p(orig),
            **{f"is_{c.lower()}": F.coalesce((F.col("currency") == c).cast("int"), F.lit(0)) for c in RATES},
            "year": F.year("date"), "month": F.month("date"), "day": F.dayofmonth("date"), "quarter": F.quarter("date"),
            "text_length": F.length("description"), "has_paypal": has("PAYPAL"), "has_amazon": has("AMAZON"), "has_online": has("ONLINE|INTERNET"),
        }
    )


def text_features(rows: DataFrame) -> DataFrame:
    """Features of descriptions for the classifiers."""
    d, m = F.col("description"), F.col("amount_brl")
    low = F.lower(d)
    return rows.withColumns(
        {
            "description_length": F.length(d), "has_numbers": d.rlike("[0-9]"), "has_card": low.contains("cart"),
            "has_installment": low.rlike("parc|x|/"), "magnitude": F.abs(m).cast("double"), "is_negative": m < 0,
        }
    )


def known_cities(golden: DataFrame) -> DataFrame:
    """Distinct upper-case cities of labelled rows."""
    return golden.select(F.upper(F.trim("merchant_city")).alias("city")).filter("city <> ''").distinct()


def known_merchants(golden: DataFrame) -> DataFrame:
    """Distinct upper-case beginnings of descriptions before their city, of more than 3 characters."""
    d, c = F.upper("description"), F.upper(F.trim("merchant_city"))
    at = F.when(c != "", F.instr(d, c))
    return golden.select(F.trim(F.substr(d, F.lit(1), at - 1)).alias("merchant")).filter("length(merchant) > 3").distinct()


def city_by_pattern(text: Column) -> Column:
    """Upper-case city by the first pattern that names one of over 2 letters without a card word."""
    out = []
    for pattern in CITY_PATTERNS:
        city = F.upper(F.trim(F.regexp_extract(text, pattern, 1)))
        out.append(F.when((F.length(city) > 2) & ~city.rlike("|".join(CARD_WORDS)), city))
    return F.coalesce(*out)


def merchant_by_pattern(text: Column) -> Column:
    """Merchant at the start of a description, in title case, if longer than 3."""
    out = []
    for pattern in MERCHANT_PATTERNS:
        name = F.regexp_replace(F.trim(F.regexp_extract(text, pattern, 1)), r"\s+", " ")
        out.append(F.when(F.length(name) > 3, F.initcap(name)))
    return F.coalesce(*out)


def cities(rows: DataFrame, known: DataFrame, merchants: DataFrame | None = None) -> DataFrame:
    """rows with `found_city` and `found_merchant`.

    City: ONLINE for online shops, else the longest known city in the description, else the
    patterns'. Merchant: the text before the city if longer than 3, else the longest known
    merchant in the description, else the patterns'. Descriptions are looked up once each and
    joined back by their text, so reruns agree.
    """
    distinct = rows.select(F.trim(F.coalesce("description", F.lit(""))).alias("description")).distinct()
    d = F.col("description")
    online = F.upper(d).rlike("|".join(ONLINE))
    found = distinct.join(contain.longest_known(distinct, F.upper("description"), known, "city").withColumnRenamed("found", "\0city"), "description", "left")
    if merchants is not None:
        found = found.join(contain.longest_known(distinct, F.upper("description"), merchants, "merchant").withColumnRenamed("found", "\0known"), "description", "left")
    else:
        found = found.withColumn("\0known", F.lit(None).cast("string"))
    found = found.withColumn("found_city", F.when(online, "ONLINE").otherwise(F.coalesce("\0city", city_by_pattern(d))))
    at = F.instr(F.upper(d), F.col("found_city"))
    before = F.trim(F.substr(d, F.lit(1), at - 1))
    named = F.when((F.col("found_city") != "ONLINE") & (at > 1) & (F.length(before) > 3), F.initcap(before))
    found = found.withColumn("found_merchant", F.coalesce(named, "\0known", merchant_by_pattern(d)))
    keyed = rows.withColumn("\0key", F.trim(F.coalesce("description", F.lit(""))))
    joined = keyed.join(found.select(d.alias("\0key"), "found_city", "found_merchant"), "\0key", "left")
    return joined.select(*[c for c in rows.columns if c not in ("found_city", "found_merchant")], "found_city", "found_merchant")


def filled(rows: DataFrame) -> DataFrame:
    """Missing fields by their defaults: hash of date, description, amount and card; currency inferred
    from the amounts; dollars by the rate (any row with one); 1 of 1 installments; zero interest and bill.

    Null and empty text is missing; so is a dollar amount or a rate of zero.
    """
    none = lambda c: F.col(c).isNull() | (F.trim(F.col(c).cast("string")) == "")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0).cast("decimal(18,2)"))
    usd = F.round(F.try_divide(F.col("amount_brl"), F.nullif(F.col("fx_rate"), F.lit(0).cast("decimal(12,6)"))), 2).cast("decimal(18,2)")
    return rows.withColumns(
        {
            "ledger_hash": F.when(
                none("ledger_hash"), t.ledger_hash(F.col("date"), F.col("description"), F.col("amount_brl"), F.col("card_last4"))
            ).otherwise(F.col("ledger_hash")),
            "currency": F.when(none("currency"), rules.currency(F.col("amount_brl"), F.col("amount_orig"))).otherwise(F.col("currency")),
            "amount_usd": F.when(zero("amount_usd") == 0, usd).otherwise(F.col("amount_usd")),
            "installment_seq": F.coalesce("installment_seq", F.lit(1)), "installment_tot": F.coalesce("installment_tot", F.lit(1)),
            "interest_amount": zero("interest_amount"), "prev_bill_amount": zero("prev_bill_amount"),
        }
    )


#: Fields that count as filled when not null, and when not empty; three core fields always count.
COUNTED_SET = ["installment_seq", "installment_tot", "fx_rate", "iof_brl", "prev_bill_amount", "interest_amount", "amount_orig", "amount_usd"]
COUNTED_TEXT = ["card_last4", "category", "merchant_city", "ledger_hash", "currency"]
MODEL_TEXT, MODEL_NUMBERS = ["category", "merchant_city", "card_last4", "currency"], ["fx_rate", "amount_usd", "installment_seq", "installment_tot"]


def filled_fields(rows: DataFrame) -> Column:
    """Filled fields of a row, of 16; columns that rows lack count as missing."""
    has = [F.col(c).isNotNull() for c in COUNTED_SET if c in rows.columns] + [F.coalesce(F.trim(F.col(c)), F.lit("")) != "" for c in COUNTED_TEXT if c in rows.columns]
    return sum((c.cast("int") for c in has), F.lit(3))


def model_fields(rows: DataFrame) -> Column:
    """Filled fields of a row as the models' benchmark counts them, of 11: numbers count above 0."""
    has = [F.coalesce(F.trim(F.col(c)), F.lit("")) != "" for c in MODEL_TEXT] + [F.coalesce(F.col(c) > 0, F.lit(False)) for c in MODEL_NUMBERS]
    return sum((c.cast("int") for c in has), F.lit(3))


def template_lines(lines: DataFrame, year: int = 2024) -> DataFrame:
    """Rows of lines by the section they are in: national, international (USD, ONLINE) or payments.

    lines: (doc_id, line_no, line); a heading opens its section; lines before any heading give none.
    """
    head = F.lit(None).cast("string")
    for name, phrase in reversed(TEMPLATE_SECTIONS.items()):
        head = F.when(F.col("line").rlike(f"(?iu){phrase}"), name).otherwise(head)
    w = W.partitionBy("doc_id").orderBy("line_no").rowsBetween(W.unboundedPreceding, 0)
    placed = lines.withColumn("section", F.last(head, ignorenulls=True).over(w))
    get = lambda p, k: F.nullif(F.regexp_extract("line", p, k), F.lit(""))
    national = rf"^(\d{{2}}/\d{{2}})\s+(.+?)\s+({MONEY})$"
    paid = F.col("section") == "pagamentos"
    abroad = F.col("section") == "internacional"
    fits = F.when(paid, F.col("line").rlike(PAYMENT)).otherwise(F.col("line").rlike(national))
    rows = placed.filter(F.col("section").isNotNull() & fits)
    described = F.when(paid, "PAGAMENTO").otherwise(get(national, 2))
    rows = rows.select(
        "doc_id", "line_no", "section", t.date(F.substring("line", 1, 5), year).alias("date"), described.alias("description"),
        t.amount(F.when(paid, get(PAYMENT, 3)).otherwise(get(national, 3))).cast("decimal(18,2)").alias("amount_brl"),
        F.when(paid, get(PAYMENT, 2)).alias("payment_code")
    )
    d = F.col("description")
    part = lambda p, k: F.regexp_extract(d, p, k)
    seq = lambda k: F.when(~paid & ~abroad, part(TEMPLATE_INSTALLMENT, k).try_cast("int"))
    home = F.nullif(F.trim(part(TEMPLATE_CITY, 2)), F.lit(""))
    shop = F.when(d.rlike(TEMPLATE_ONLINE), F.coalesce(F.nullif(F.trim(part(TEMPLATE_ONLINE, 2)), F.lit("")), F.lit("ONLINE")))
    merchant = F.when(abroad, part(TEMPLATE_ONLINE, 1)).when(~paid, part(TEMPLATE_CITY, 1))
    return rows.select(
        "*", F.when(abroad, "USD").otherwise("BRL").alias("currency"), seq(2).alias("installment_seq"), seq(3).alias("installment_tot"),
        F.nullif(F.trim(merchant), F.lit("")).alias("merchant"), F.when(abroad, shop).when(~paid, home).alias("merchant_city"),
    )


def with_template(rows: DataFrame, template: DataFrame, on: list[str]) -> DataFrame:
    """rows with what their template row (section, installments, city) says: category FX abroad and
    PAGAMENTO for payments, the section's currency where none is, installments and city where the template has them."""
    said = template.select(*on, F.struct("section", "installment_seq", "installment_tot", "merchant_city").alias("\0t"))
    s = F.col("`\0t`.section")
    none = F.coalesce(F.trim("currency"), F.lit("")) == ""
    own = lambda c: F.coalesce(F.col(f"`\0t`.{c}"), F.col(c))
    return rows.join(said, on, "left").withColumns(
        {
            "category": F.when(s == "internacional", "FX").when(s == "pagamentos", "PAGAMENTO").otherwise(F.col("category")),
            "currency": F.when(none & (s == "internacional"), "USD").when(none & s.isNotNull(), "BRL").otherwise(F.col("currency")),
            **{c: own(c) for c in ("installment_seq", "installment_tot", "merchant_city")},
        }
    ).drop("\0t")


def with_fx(rows: DataFrame, fx: DataFrame, on: list[str]) -> DataFrame:
    """rows with the rate, tax and original amount of their fx row; its currency is USD where none is, dollars follow the rate."""
    said = fx.select(*on, F.struct("fx_rate", "iof_brl", "amount_orig").alias("\0f"))
    has, rate = F.col("`\0f`").isNotNull(), F.col("`\0f`.fx_rate")
    usd = F.round(F.try_divide(F.col("amount_brl"), rate), 2).cast("decimal(18,2)")
    pick = lambda c, default: F.when(has, F.coalesce(F.col(f"`\0f`.{c}"), default)).otherwise(F.col(c))
    zero = F.lit(0).cast("decimal(18,2)")
    return rows.join(said, on, "left").withColumns(
        {
            "amount_usd": F.when(has & (F.coalesce("amount_usd", zero) == 0) & (rate > 0), usd).otherwise(F.col("amount_usd")),
            "currency": F.when(has & (F.coalesce(F.trim("currency"), F.lit("")) == ""), "USD").otherwise(F.col("currency")),
            "fx_rate": pick("fx_rate", F.lit(None)), "iof_brl": pick("iof_brl", zero), "amount_orig": pick("amount_orig", F.lit(None)),
        }
    ).drop("\0f")


def payments(lines: DataFrame, year: int = 2024) -> DataFrame:
    """Payment lines: date, code and amount (negative)."""
    get = lambda k: F.regexp_extract("line", PAYMENT, k)
    found = lines.filter(F.col("line").rlike(PAYMENT))
    return found.select("doc_id", "line_no", t.date(get(1), year).alias("date"), get(2).alias("code"), t.amount(get(3)).cast("decimal(18,2)").alias("amount_brl"))


def installment_lines(lines: DataFrame) -> DataFrame:
    """Lines with an installment before their amount: description, number, of how many, amount."""
    pattern = rf"^(.+?)\s+(\d{{1,2}})/(\d{{1,2}})\s+({MONEY})"
    get = lambda k: F.regexp_extract("line", pattern, k)
    found = lines.filter(F.col("line").rlike(pattern))
    return found.select(
        "doc_id", "line_no", get(1).alias("description"), get(2).cast("int").alias("seq"), get(3).cast("int").alias("tot"),
        t.amount(get(4)).cast("decimal(18,2)").alias("amount_brl")
    )


def scanned(pages: DataFrame, least: int = 100) -> DataFrame:
    """Per document whether it is a scan: no page has more than `least` characters."""
    return pages.groupBy("doc_id").agg((~F.coalesce(F.bool_or(F.length("text") > least), F.lit(False))).alias("scanned"))


def candidates(incoming: DataFrame, golden: DataFrame, limit: int) -> DataFrame:
    """Names not golden yet, the first `limit` of each day in order."""
    fresh = incoming.join(golden.select("name").distinct(), "name", "left_anti")
    return fresh.withColumn("\0n", F.row_number().over(W.partitionBy("day").orderBy("name"))).filter(F.col("`\0n`") <= limit).drop("\0n")


def looked_up(rows: DataFrame, known: DataFrame, key: str, most: int = 5) -> DataFrame:
    """rows with `results`: up to `most` entries that a lookup table (key, rank, result) has of the key, best rank first.

    Stands for searches on the web: each distinct key is looked up once.
    """
    ranked = known.join(rows.select(key).distinct(), key, "left_semi").withColumn("\0n", F.row_number().over(W.partitionBy(key).orderBy("rank", "result")))
    found = ranked.filter(F.col("`\0n`") <= most).groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("\0n", "result"))), lambda x: x["result"]).alias("results"))
    return rows.join(found, key, "left")


def worst(accuracies: DataFrame, k: int = 3) -> DataFrame:
    """The k fields of least accuracy of each document."""
    w = W.partitionBy("doc_id").orderBy("accuracy", "field")
    return accuracies.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def zipped_pairs(a: DataFrame, b: DataFrame, order: str, strict: bool = False) -> DataFrame:
    """Rows of equal place in their documents' order side by side, as structs a and b; strict: a place without both is an error."""
    place = lambda d, n: d.select("doc_id", F.row_number().over(W.partitionBy("doc_id").orderBy(order)).alias("place"), F.struct(*d.columns).alias(n))
    out = place(a, "a").join(place(b, "b"), ["doc_id", "place"], "full_outer")
    if not strict:
        return out
    odd = F.concat(F.lit("rows of unequal number in document "), F.col("doc_id").cast("string"))
    return out.withColumn("a", F.when(F.col("a").isNull() | F.col("b").isNull(), F.raise_error(odd)).otherwise(F.col("a")))


def coverage(rows: DataFrame, columns: Sequence[str], confidence: str | None = None) -> DataFrame:
    """Per column: rows with a prediction, their share and, with a confidence column, their mean confidence, in one pass."""
    has = lambda c: F.coalesce(F.trim(F.col(c).cast("string")), F.lit("")) != ""
    sure = lambda c: F.avg(F.when(has(c), F.col(confidence))) if confidence else F.lit(None).cast("double")
    wide = rows.agg(F.array(*[F.struct(F.lit(c).alias("column"), F.count_if(has(c)).alias("predicted"), F.count("*").alias("n"), sure(c).alias("confidence")) for c in columns]).alias("x"))
    out = wide.select(F.explode("x").alias("x")).select("x.*")
    return out.select("column", "predicted", F.round(F.try_divide("predicted", "n"), 6).alias("rate"), *([F.round("confidence", 6).alias("confidence")] if confidence else []))


def mean_rates(rows: DataFrame) -> DataFrame:
    """Mean rate of each currency, of the rows that have one."""
    return rows.groupBy("currency").agg(F.round(F.avg("fx_rate"), 6).alias("rate"))
