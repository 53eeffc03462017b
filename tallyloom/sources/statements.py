"""Readers and writers of statement text, golden tables, drafts and OCR results."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as t

GOLDEN = (
    "card_last4 string, post_date date, desc_raw string, amount_brl decimal(18,2), installment_seq int, installment_tot int, fx_rate decimal(12,6), iof_brl decimal(18,2), category string, "
    "merchant_city string, ledger_hash string, prev_bill_amount decimal(18,2), interest_amount decimal(18,2), amount_orig decimal(18,2), currency_orig string, amount_usd decimal(18,2)"
)
#: Other names of golden columns.
ALIASES = {
    "data": "date", "post_date": "date", "desc_raw": "description", "descricao": "description", "valor": "amount_brl",
    "amount": "amount_brl", "categoria": "category", "tipo": "transaction_type"
}
BLOCKS = "id string, block_type string, text string, row_index int, column_index int, child_ids array<string>"


def named(rows: DataFrame, required: Sequence[str] = ("date", "description", "amount_brl")) -> DataFrame:
    """rows with trimmed lower-case names and aliases resolved; raises without the required columns."""
    rows = rows.toDF(*[c.strip().lower() for c in rows.columns])
    rows = rows.withColumnsRenamed({k: v for k, v in ALIASES.items() if v not in rows.columns})
    if lost := [c for c in required if c not in rows.columns]:
        raise ValueError(f"required columns are missing: {', '.join(lost)}")
    return rows


def golden_doc(name: Column) -> Column:
    """Document of a golden file's name: its stem without `golden_`."""
    return F.regexp_extract(name, r"^(?:golden_)?(.*?)\.csv$", 1)


def read_golden(spark: SparkSession, path: str) -> DataFrame:
    """Golden tables by `doc`, the file's stem without `golden_`; rows without a date are left out."""
    rows = spark.read.csv(path, sep=";", header=True, schema=GOLDEN, dateFormat="yyyy-MM-dd", mode="PERMISSIVE")
    return rows.select("*", golden_doc(F.col("_metadata.file_name")).alias("doc")).withColumnsRenamed({"post_date": "date", "desc_raw": "description"}).filter("date is not null")


def read_any_golden(spark: SparkSession, path: str, year: int = 2024) -> DataFrame:
    """(doc, date, description, amount_brl, category) of golden tables of any naming; rows without a date that exists are left out.

    Dates are ISO or D/M[/Y], amounts Brazilian or with a point; an empty category is null.
    """
    rows = spark.read.csv(path, sep=";", header=True)
    rows = named(rows.withColumn("doc", golden_doc(F.col("_metadata.file_name"))))
    day = F.trim("date")
    kind = F.nullif(F.trim(F.coalesce("category", F.lit(""))), F.lit("")) if "category" in rows.columns else F.lit(None).cast("string")
    out = rows.select(
        "doc", F.coalesce(t.iso_date(day), t.date(day, year)).alias("date"), F.trim("description").alias("description"),
        t.amount(F.trim("amount_brl")).cast("decimal(18,2)").alias("amount_brl"), kind.alias("category")
    )
    return out.filter("date is not null").withColumns({"confidence": F.lit(1.0), "key": F.concat("doc", F.lit(".pdf"))})


def read_training(spark: SparkSession, path: str) -> DataFrame:
    """Golden tables as the models read them: installments 0 or none are 1, no currency is BRL, no number is 0."""
    rows = read_golden(spark, path)
    one = lambda c: F.when(F.coalesce(F.col(c), F.lit(0)) == 0, 1).otherwise(F.col(c))
    numbers = ("amount_brl", "amount_orig", "amount_usd", "fx_rate", "iof_brl", "prev_bill_amount")
    zero = {c: F.coalesce(F.col(c), F.lit(0).cast(rows.schema[c].dataType)) for c in numbers}
    text = {c: F.coalesce(c, F.lit("")) for c in ("card_last4", "category", "merchant_city", "ledger_hash")}
    return rows.withColumns(zero | text | {
        "installment_seq": one("installment_seq"), "installment_tot": one("installment_tot"),
        "currency_orig": F.when(F.coalesce("currency_orig", F.lit("")) == "", "BRL").otherwise(F.col("currency_orig"))
    })


def read_reports(spark: SparkSession, path: str) -> DataFrame:
    """All `*_error_report.csv` and `*_enriched.csv` under path/<extractor>/csv, with extractor, pdf and is_enriched; columns that one kind lacks are null."""

    def kind(suffix: str, sep: str, enriched: bool) -> DataFrame:
        read = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", f"*_{suffix}.csv")
        rows = read.csv(path, sep=sep, header=True, enforceSchema=False)
        file = F.col("_metadata.file_path")
        tags = F.regexp_extract(file, r"([^/]+)/csv/[^/]+$", 1).alias("extractor"), F.regexp_extract(file, rf"([^/]+)_{suffix}\.csv$", 1).alias("pdf"), F.lit(enriched).alias("is_enriched")
        return rows.select("*", *tags)

    found = []
    for suffix, sep, enriched in (("error_report", ",", False), ("enriched", ";", True)):
        try:
            found.append(kind(suffix, sep, enriched))
        except AnalysisException as e:
            if "UNABLE_TO_INFER_SCHEMA" not in str(e):  # no files of this kind
                raise
    if not found:
        return spark.createDataFrame([], "extractor string, pdf string, is_enriched boolean")
    return found[0] if len(found) == 1 else found[0].unionByName(found[1], allowMissingColumns=True)


def page_texts(pages: DataFrame) -> DataFrame:
    """(doc_id, text): the texts of a document's pages (doc_id, page, text) by line feeds, empty ones left out.

    For one document of bounded length; lines of long ones are better made from the pages.
    """
    some = pages.filter(F.coalesce("text", F.lit("")) != "").groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("page", "text"))).alias("p"))
    return some.select("doc_id", F.array_join(F.transform("p", lambda x: x["text"]), "\n").alias("text"))


def read_delimited(spark: SparkSession, path: str) -> DataFrame:
    """A CSV whose separator is seen in its first line, with trimmed lower-case names and aliases resolved."""
    head = spark.read.text(path).limit(1).collect()
    sep = max(";,\t|", key=head[0][0].count) if head else ","
    return named(spark.read.csv(path, sep=sep, header=True), ())


#: Schemas of an analysed layout and of an analysed document, as JSON lines.
LAYOUT = (
    "doc_id string, model_id string, tables array<struct<cells: array<struct<row_index: int, column_index: int, content: string, confidence: double>>>>, "
    "pages array<struct<lines: array<struct<content: string, confidence: double>>>>"
)
DOCUMENT = (
    "doc_id string, text string, entities array<struct<type: string, value: string, confidence: double>>, "
    "pages array<struct<tables: array<struct<rows: array<struct<cells: array<struct<segments: array<struct<start: int, `end`: int>>>>>>>>, form_fields: array<struct<name: string, value: string, confidence: double>>>>"
)


def read_layout(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(cells, lines) of analysed layouts: cells (doc_id, table_idx, row_idx, col_idx, content, confidence), lines (doc_id, line_no, line, confidence) through all pages."""
    docs = spark.read.schema(LAYOUT).json(path)
    cells = docs.select("doc_id", F.posexplode("tables").alias("table_idx", "t")).select("doc_id", "table_idx", F.explode("t.cells").alias("c"))
    cells = cells.select(
        "doc_id", "table_idx", F.col("c.row_index").alias("row_idx"), F.col("c.column_index").alias("col_idx"), "c.content",
        F.coalesce("c.confidence", F.lit(0.8)).alias("confidence")
    )
    lines = docs.select("doc_id", F.posexplode("pages").alias("page", "p")).select("doc_id", "page", F.posexplode("p.lines").alias("n", "l"))
    return cells, lines.select(
        "doc_id", (F.col("page").cast("long") * 1_000_000 + F.col("n")).alias("line_no"), F.col("l.content").alias("line"),
        F.coalesce("l.confidence", F.lit(0.7)).alias("confidence")
    )


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """Analysed documents with text, entities, tables anchored in the text and form fields; see layout.entities_of, document_tables and form_fields."""
    return spark.read.schema(DOCUMENT).json(path)


def read_text(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, text): one row a text file; an empty one gives none."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_name").alias("doc_id"), F.col("value").alias("text"))


def read_blocks(spark: SparkSession, path: str) -> DataFrame:
    """OCR blocks as JSON lines to table cells (table_id, row_idx, col_idx, content), words in their order."""
    b = spark.read.schema(BLOCKS).json(path)
    edge = b.select("id", "block_type", "row_index", "column_index", F.posexplode("child_ids").alias("at", "child"))
    kinds = b.select(
        F.col("id").alias("child"), F.col("text").alias("word"), F.col("block_type").alias("kind"), F.col("row_index").alias("r"),
        F.col("column_index").alias("c")
    )
    in_table = edge.filter("block_type = 'TABLE'").join(kinds.filter("kind = 'CELL'"), "child").select(F.col("id").alias("table_id"), F.col("child").alias("cell"), "r", "c")
    words = edge.filter("block_type = 'CELL'").join(kinds.filter("kind = 'WORD'"), "child").select(F.col("id").alias("cell"), "at", "word")
    text = words.groupBy("cell").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "word"))), lambda w: w["word"]), " ").alias("content"))
    return in_table.join(text, "cell", "left").select(
        "table_id", F.col("r").alias("row_idx"), F.col("c").alias("col_idx"), F.coalesce("content", F.lit("")).alias("content")
    )


def write_draft(rows: DataFrame, path: str) -> None:
    """date;description;amount_brl;category;transaction_type;confidence with DD/MM/YYYY and decimal comma."""
    out = rows.select(
        F.date_format("date", "dd/MM/yyyy").alias("date"), "description", F.translate(F.col("amount_brl").cast("decimal(18,2)").cast("string"), ".", ",").alias("amount_brl"),
        "category", "transaction_type", F.format_string("%.3f", F.col("confidence").cast("double")).alias("confidence"),
    )
    out.write.mode("overwrite").csv(path, sep=";", header=True)


def write_golden(rows: DataFrame, path: str, partition: str | None = None) -> None:
    """The golden columns a table has, in their order, ISO dates and decimal points; by `partition` if named."""
    names = [c.split()[0] for c in GOLDEN.replace("decimal(18,2)", "decimal").replace("decimal(12,6)", "decimal").split(", ")]
    out = rows.withColumnsRenamed({"date": "post_date", "description": "desc_raw"})
    out = out.select(*[n if n in out.columns else F.lit(None).cast("string").alias(n) for n in names], *([partition] if partition else []))
    w = out.write.mode("overwrite").option("sep", ";").option("header", True)
    (w.partitionBy(partition) if partition else w).csv(path)


# Columns of the exported golden table.
EXPORT = "date description amount_brl card_last4 installment_seq installment_tot fx_rate iof_brl category merchant_city ledger_hash prev_bill_amount interest_amount amount_orig currency_orig amount_usd".split()


def exported(rows: DataFrame) -> DataFrame:
    """The 16 columns as text: DD/MM/YYYY, decimal commas, 4 places of a rate; missing numbers are 0, missing text is empty."""
    rows = rows.withColumnRenamed("currency", "currency_orig") if "currency_orig" not in rows.columns else rows
    has = lambda c: F.col(c) if c in rows.columns else F.lit(None)
    number = lambda c, places: F.translate(F.coalesce(has(c), F.lit(0)).cast(f"decimal(18,{places})").cast("string"), ".", ",")
    whole = lambda c: F.coalesce(has(c), F.lit(0)).cast("int").cast("string")
    text = lambda c: F.coalesce(has(c).cast("string"), F.lit(""))
    made = {
        "date": F.date_format("date", "dd/MM/yyyy"), "fx_rate": number("fx_rate", 4), "installment_seq": whole("installment_seq"),
        "installment_tot": whole("installment_tot")
    }
    made |= {c: number(c, 2) for c in ("amount_brl", "iof_brl", "prev_bill_amount", "interest_amount", "amount_orig", "amount_usd")}
    return rows.select(*[made.get(c, text(c)).alias(c) for c in EXPORT])


def placeholder(spark: SparkSession, day: str = "2024-01-01") -> DataFrame:
    """The row that stands for an empty table."""
    return exported(spark.createDataFrame([(day,)], "day string").select(F.col("day").cast("date").alias("date")))


def write_export(rows: DataFrame, path: str, day: str = "2024-01-01") -> None:
    """The exported golden table with a header; an empty one has its placeholder row, so it always has one."""
    out = exported(rows)
    out = out if not rows.isEmpty() else placeholder(rows.sparkSession, day)
    out.write.mode("overwrite").csv(path, sep=";", header=True, emptyValue="")


def result_rows(rows: DataFrame, runs: DataFrame) -> DataFrame:
    """(doc_id, date, description, amount_brl, category, confidence, source): rows of the runs that succeeded, and an error row of each that failed.

    runs: (doc_id, extractor, success, error, confidence), one a document. A row's own confidence and extractor win.
    """
    has = lambda c, other: F.coalesce(F.col(f"t.{c}"), other) if c in rows.columns else other
    good = rows.alias("t").join(runs.filter("success").alias("r"), "doc_id").select(
        "doc_id", F.col("t.date").cast("string").alias("date"), "t.description", F.col("t.amount_brl").cast("string").alias("amount_brl"), has("category", F.lit("OUTROS")).alias("category"),
        has("confidence", F.col("r.confidence")).cast("string").alias("confidence"), F.coalesce("r.extractor", F.lit("Unknown")).alias("source"),
    )
    bad = runs.filter("not success").select(
        "doc_id", F.lit("ERROR").alias("date"), F.coalesce("error", F.lit("Unknown error")).alias("description"),
        F.lit("0.00").alias("amount_brl"), F.lit("ERROR").alias("category"), F.lit("0.0").alias("confidence"),
        F.coalesce("extractor", F.lit("Unknown")).alias("source")
    )
    return good.unionByName(bad)


def write_results(rows: DataFrame, runs: DataFrame, path: str) -> None:
    """A six-column table with a header for each document, under its name."""
    result_rows(rows, runs).write.mode("overwrite").partitionBy("doc_id").csv(path, sep=";", header=True)


def write_golden_draft(rows: DataFrame, path: str) -> None:
    """date;description;amount_brl;category with DD/MM/YYYY and decimal comma: a new golden table."""
    rows.select(
        F.date_format("date", "dd/MM/yyyy").alias("date"), "description",
        F.translate(F.col("amount_brl").cast("decimal(18,2)").cast("string"), ".", ",").alias("amount_brl"),
        F.coalesce("category", F.lit("")).alias("category")
    ).write.mode("overwrite").csv(path, sep=";", header=True)


def write_golden_copy(rows: DataFrame, path: str) -> None:
    """date,description,amount_brl,category,transaction_type with ISO dates and points: a golden table for others."""
    kind = F.coalesce("transaction_type", F.lit("")) if "transaction_type" in rows.columns else F.lit("domestic")
    rows.select(
        F.col("date").cast("string").alias("date"), "description", F.col("amount_brl").cast("string").alias("amount_brl"),
        F.coalesce("category", F.lit("")).alias("category"), kind.alias("transaction_type")
    ).write.mode("overwrite").csv(path, header=True)


def appended(golden: DataFrame, key: str, rows: DataFrame) -> DataFrame:
    """Golden rows with those of one document replaced by `rows`."""
    return golden.filter(F.col("key") != key).unionByName(rows.withColumn("key", F.lit(key)), allowMissingColumns=True)


def write_tables(tables: dict[str, DataFrame], path: str) -> None:
    """Each table as CSV with a header under its name."""
    for name, rows in tables.items():
        rows.write.mode("overwrite").csv(f"{path}/{name}", header=True)


def write_features(features: DataFrame, path: str) -> None:
    """Training features with a header, in their columns' order."""
    features.write.mode("overwrite").csv(path, header=True)


def write_json(rows: DataFrame, path: str) -> None:
    rows.select(F.to_json(F.struct(*rows.columns)).alias("value")).write.mode("overwrite").text(path)


def write_report(lines: DataFrame, path: str) -> None:
    """Human-readable text, one file line a row of `line`."""
    lines.select("line").write.mode("overwrite").text(path)
