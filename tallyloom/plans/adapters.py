"""The driver's tables as statement tables: rows, lines, cells, words, runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import rules
from ..functions import text as t


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statement rows from orders and customers; a document is a month of a hundred customers."""
    o = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    k = F.col("o_orderkey")
    description = F.concat_ws(" ", "c_mktsegment", F.when(k % 5 == 0, "UBER").when(k % 5 == 1, "PADARIA").when(k % 5 == 2, "NETFLIX"), "c_name")
    return o.select(
        F.concat_ws(
            "/", F.date_format("o_orderdate", "yyyy-MM"), F.floor(F.col("o_custkey") / 100).cast("string")
        ).alias("doc_id"), k.alias("idx"), F.to_date("o_orderdate").alias("date"), description.alias("description"),
        F.col("o_totalprice").cast("decimal(18,2)").alias("amount_brl"), rules.category(description).alias("category"),
        F.when(k % 4 == 0, "USD").when(k % 4 == 1, "EUR").otherwise("BRL").alias("currency"),
        (F.lit(0.5) + (k % 50) / 100).alias("confidence"), (F.lit(0.6) + (k % 3) / 10).alias("pipeline_confidence"),
        F.element_at(F.array(*map(F.lit, ("textract", "azure", "pdfplumber", "camelot"))), (k % 4 + 1).cast("int")).alias("extractor"),
    )


def second(found: DataFrame) -> DataFrame:
    """Another extraction of the same rows: some lost, some a day later, some a cent off."""
    k = F.col("idx")
    out = found.filter(k % 7 != 0)
    out = out.withColumn("date", F.when(k % 13 == 0, F.date_add("date", 1)).otherwise(F.col("date")))
    return out.withColumn(
        "amount_brl",
        (F.col("amount_brl") + F.when(k % 11 == 0, F.lit("0.01").cast("decimal(18,2)")).otherwise(F.lit("0.00").cast("decimal(18,2)"))).cast("decimal(18,2)")
    )


def golden(found: DataFrame) -> DataFrame:
    """Labelled rows: some not extracted, some twice, some with another category."""
    k = F.col("idx")
    out = found.filter(k % 6 != 0).withColumn("category", F.when(k % 17 == 0, "OUTROS").otherwise(F.col("category")))
    return out.unionAll(out.filter(k % 97 == 0))


def lines(found: DataFrame) -> DataFrame:
    """Rows as statement text, with a second amount on every ninth."""
    day, money = F.date_format("date", "dd/MM"), t.money(F.col("amount_brl"))
    text = F.when(F.col("idx") % 9 == 0, F.concat_ws(" ", day, "description", F.lit("10,00"), money)).otherwise(F.concat_ws(" ", day, "description", money))
    return found.select("doc_id", F.col("idx").alias("line_no"), text.alias("line"))


def full_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """rows with city, rate and card, each missing on some."""
    k, found = F.col("idx"), rows(spark, sf_dir)
    rate = F.when(F.col("currency") != "BRL", (5 + (k % 10) / 10).cast("decimal(12,6)"))
    return found.withColumns({
        "merchant_city": F.when(k % 3 == 0, "SAO PAULO").when(k % 3 == 1, "RIO"), "fx_rate": rate,
        "card_last4": F.lpad((k % 10000).cast("string"), 4, "0")
    })


def labelled(full: DataFrame) -> DataFrame:
    """Labels of full_rows: golden's gaps and repeats, and cells that differ a little or wholly."""
    k, d, rate = F.col("idx"), F.col("description"), F.col("fx_rate")
    out = golden(full)
    return out.withColumns(
        {
            "description": F.when(k % 19 == 0, F.substring("description", 1, F.length("description") - 3)).when(k % 23 == 0, F.concat(F.lit("X"), F.substr(d, F.lit(2)))).otherwise(d),
            "category": F.when(k % 29 == 0, F.lower("category")).otherwise(F.col("category")),
            "merchant_city": F.when(k % 31 == 0, "SAO PAULO SP").otherwise(F.col("merchant_city")),
            "fx_rate": F.when(k % 37 == 0, rate + F.lit("0.005").cast("decimal(12,6)")).when(k % 41 == 0, rate + F.lit("0.02").cast("decimal(12,6)")).otherwise(rate).cast("decimal(12,6)"),
            "card_last4": F.when(k % 43 != 0, F.col("card_last4")),
        }
    )


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Table cells of line items: a header row 1, then date, text and amount; every line item is a row."""
    li = table(spark, sf_dir, "lineitem")
    w = W.partitionBy("l_suppkey", "l_orderkey").orderBy(
        "l_linenumber", "l_partkey", "l_extendedprice", "l_shipdate", "l_returnflag", "l_quantity", "l_discount", "l_tax"
    )
    li = li.withColumn("at", F.row_number().over(w))
    content = F.array(
        F.date_format("l_shipdate", "dd/MM"),
        F.concat(F.lit("ITEM "), F.translate(F.col("l_partkey").cast("string"), "0123456789", "abcdefghij"), F.lit(" "), "l_returnflag"),
        t.money(F.col("l_extendedprice").cast("decimal(18,2)"))
    )
    head = F.array(*map(F.lit, ("DATA", "HISTÓRICO", "VALOR R$ 1")))
    row = lambda at, texts: F.struct(at.alias("row_idx"), texts.alias("texts"))
    body = row(F.col("at") + 1, content)
    # A table's first item brings the header along: no second reading, and a table's rows stay where the window has put them.
    both = F.when(F.col("at") == 1, F.array(row(F.lit(1), head), body)).otherwise(F.array(body))
    key = [F.col("l_suppkey").alias("doc_id"), F.col("l_orderkey").alias("table_idx")]
    rows = li.select(*key, F.explode(both).alias("r"))
    return rows.select("doc_id", "table_idx", "r.row_idx", F.posexplode("r.texts").alias("col_idx", "content"))


def words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Word boxes of line items: a page is an order."""
    n, k = F.col("l_linenumber"), F.col("l_partkey")
    li = table(spark, sf_dir, "lineitem")
    top, x0 = (n * 2).cast("double"), (k % 500).cast("double")
    return li.select(
        F.col("l_orderkey").alias("doc_id"), F.lit(1).alias("page"), F.concat(F.lit("w"), n.cast("string")).alias("text"),
        (x0 + n / 10).alias("x0"), (x0 + 5).alias("x1"), top.alias("top"), (top + 2).alias("bottom")
    )


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Extraction runs from events."""
    e = table(spark, sf_dir, "events")
    k = F.col("event_id")
    return e.select(
        k.alias("run_id"), "ts", F.col("user_id").alias("doc_id"), F.col("event_type").alias("method"), (k % 10 != 0).alias("success"), ((k % 100) / 100).alias("confidence"),
        F.round("value", 4).alias("time_ms"), (k % 7 + 1).alias("pages"), F.when(k % 10 == 0, F.concat(F.lit("E"), (k % 30).cast("string"))).alias("error"),
    )
