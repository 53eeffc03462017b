"""Rows from layouts: table cells, text lines, multi-line bundles, text anchors and entities.

Every parser keys its rows by document and place, and takes a default date for rows without one.
Rules that consume lines choose among overlapping candidates: these are cut into islands that
touch no other, so the fold over an island stays small whatever the document's size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import confidence, rules
from ..functions import text as t
from ..functions.text import MONEY
from ..store import Tables

# Words of a statement's headers and footers, and words of lines that are skipped
# unless they hold a date.
HEADERS = ["ITAÚ UNIBANCO", "CARTÃO DE CRÉDITO", "DATA", "HISTÓRICO", "VALOR", "PÁGINA", "ATENDIMENTO", "WWW.ITAU.COM.BR", "CENTRAL DE RELACIONAMENTO"]
SKIPPED = ["LANÇAMENTOS", "PAGAMENTOS", "TOTAL", "LIMITE", "FATURA", "VENCIMENTO", "PRÓXIMA", "SALDO", "ENCARGOS", "PARCELAMENTO"]
# Beginnings of summary lines.
DROPPED = [
    "Total ", "Lançamentos", "Limites", "Encargos", "Próxima fatura", "Demais faturas", "Parcelamento da fatura", "Simulação", "Pontos", "Cashback",
    "Outros lançamentos", "Limite total de crédito", "Fatura anterior", "Saldo financiado", "Produtos e serviços", "Tarifa", "Compras parceladas - próximas faturas",
]
# Words of table rows that are no purchases.
NO_ROW = [
    "total", "fatura", "pagamento", "saldo", "encargos", "lançamentos", "valor", "financiado", "percentual", "vencimento", "emissão", "postagem",
    "fechamento", "limite", "juros", "mora", "iof", "anterior", "documento", "mínimo", "rotativo", "parcelamento",
]
# Patterns of amounts, dates, purchases, categories, foreign lines and their rate.
PLAIN_MONEY, DAY, DAY_YEAR = r"\d{1,3}(?:\.\d{3})*,\d{2}", r"\d{1,2}/\d{1,2}", r"(\d{1,2})/(\d{1,2})(?:/(\d{4}))?"
PURCHASE = r"^(\d{2}/\d{2})\s+(.+?)\s+([\d.,]+)$"
CATEGORY = r"^([A-ZÇÉÂÕ ]+)\.\s+([A-ZÂÁÉÍÓÚÊÔÛ .-]+)$"
ABROAD = r"^([A-ZÂÁÉÍÓÚÊÔÛ .-]+)\s+([\d.,]+)\s+([A-Z]{3})\s+([\d.,]+)$"
ANY_AMOUNT, CENTS, CODES = r"\d+[,.]?\d*", r"[\d.,]+,\d{2}", r"[A-Z0-9*]"
CONVERSION = r"Dólar de Conversão R\$\s*([\d.,]+)"
# The catalogue of line patterns, in the order they are tried.
CATALOGUE = {
    "rate": r"(?iu)^Dólar de Conversão R\$ ([\d.,]+)",
    "international": r"(?iu)^(\d{2}/\d{2})\s+(.+?)\s+(-?[\d.,]+)\s+USD$",
    "domestic": r"^(\d{2}/\d{2})\s+(.+?)\s+(-?[\d.,]+)$",
    "abroad": r"(?iu)^([A-ZÂÁÉÍÓÚÊÔÛ .-]+)\s+(-?[\d.,]+)\s+BRL$",
    "category": r"^([A-ZÇÉÂÊÕ ]+)\.\s+([A-ZÂÁÉÍÓÚÊÔÛ .-]+)$",
}
# Kinds of entities by their family.
ENTITIES = {"date": ["date", "transaction_date"], "amount": ["amount", "money", "currency"], "description": ["description", "merchant", "transaction_description"]}
UNKNOWN = "Unknown transaction"


def is_header(line: Column) -> Column:
    """Whether a line holds a header's or footer's words."""
    return F.upper(line).rlike("|".join(HEADERS).replace(".", r"\."))


def is_skipped(line: Column) -> Column:
    """Whether a line holds a skip word and no date."""
    return F.upper(line).rlike("|".join(SKIPPED)) & ~line.rlike(DAY)


def is_summary(line: Column) -> Column:
    """Whether a line begins like a summary."""
    return line.rlike("(?iu)^(?:" + "|".join(DROPPED) + ")")


def is_purchase(line: Column) -> Column:
    return line.rlike(r"^\d{2}/\d{2}\s+")


def is_category(line: Column) -> Column:
    return line.rlike(CATEGORY)


def line_kind(line: Column) -> Column:
    """Name of the catalogue's first pattern that the line fits, else null."""
    out = F.lit(None).cast("string")
    for name, pattern in reversed(CATALOGUE.items()):
        out = F.when(line.rlike(pattern), name).otherwise(out)
    return out


def looks_like_date(text: Column) -> Column:
    return text.rlike(DAY)


def looks_like_amount(text: Column) -> Column:
    """True for any digit."""
    return text.rlike(ANY_AMOUNT)


def row_date(text: Column, year: int, default: Column) -> Column:
    """The date a text begins with, else the default."""
    return F.coalesce(t.date(text, year), default)


def _money(text: Column) -> Column:
    return t.amount(text).cast("decimal(18,2)")


def _default(day: str) -> Column:
    return F.lit(day).cast("date")


def cell_rows(cells: DataFrame, kind: str = "A", header: int | None = None, year: int = 2024, default: str = "2024-01-01") -> DataFrame:
    """A row for each table row of cells (doc_id, table_idx, row_idx, col_idx, content[, confidence]).

    The first date-like cell is the date; the last other cell with a digit the amount (needed);
    the first without one that is longer than 3 (A) or 5 (B) characters the description. A's
    confidence is .8, and .1 each for a date and a description over 10 characters; B's is .7
    and .3 of the cells' mean, .8 for a column without a cell. Rows `header` are skipped.
    """
    least = {"A": 3, "B": 5}[kind]
    rows = cells if header is None else cells.filter(F.col("row_idx") != header)
    sure = F.col("confidence") if "confidence" in cells.columns else F.lit(0.8)
    text = rows.select("doc_id", "table_idx", "row_idx", "col_idx", F.coalesce(sure, F.lit(0.8)).alias("sure"), F.trim(F.coalesce("content", F.lit(""))).alias("x"))
    cell = F.when(F.col("x") != "", F.struct("col_idx", "x"))
    dated, able = looks_like_date(F.col("x")), looks_like_amount(F.col("x"))  # a date has digits, so it is able too
    by = text.groupBy("doc_id", "table_idx", "row_idx").agg(
        F.min(F.when(dated, cell)).alias("first_day"), F.max(F.when(able, cell)).alias("last"), F.max(F.when(able & ~dated, cell)).alias("last_plain"),
        F.min(F.when(~able & (F.length("x") > least), cell)).alias("first_text"), F.count_if(dated & cell.isNotNull()).alias("days"),
        F.sum("sure").alias("sure"), F.count("*").alias("n"), (F.max("col_idx") + 1).alias("columns"),
    )
    # The date is no amount: where it is the last cell with a digit, the last other one is, which then is no date.
    other = F.col("first_day").isNull() | (F.col("last") != F.col("first_day")) | (F.col("days") > 1)
    found = by.select(
        "doc_id", "table_idx", "row_idx", F.col("first_day.x").alias("day"), F.when(other, F.col("last.x")).otherwise(F.col("last_plain.x")).alias("money"),
        F.col("first_text.x").alias("text"), "sure", "n", "columns"
    ).filter("money is not null")
    found = found.withColumn("description", F.coalesce("text", F.lit(UNKNOWN)))
    day = row_date(F.col("day"), year, _default(default))
    if kind == "A":
        score = F.lit(0.8) + F.when(F.col("day").isNotNull(), 0.1).otherwise(0.0) + F.when(F.length("description") > 10, 0.1).otherwise(0.0)
    else:
        score = 0.7 + 0.3 * (F.col("sure") + 0.8 * F.greatest(F.lit(0), F.col("columns") - F.col("n"))) / F.greatest("columns", "n")
    return found.select(
        "doc_id", "table_idx", "row_idx", day.alias("date"), "description", _money(F.col("money")).alias("amount_brl"), *_kinds(),
        F.round(F.least(score, F.lit(1.0)), 6).alias("confidence")
    )


def _kinds() -> list[Column]:
    """Category and kind by the description."""
    d = F.col("description")
    return [rules.category(d).alias("category"), F.when(rules.is_foreign(d), "international").otherwise("domestic").alias("transaction_type")]


def without(text: Column, day: Column) -> Column:
    """The text without a day that it names; an empty day changes nothing."""
    return F.when(day != "", F.trim(F.replace(text, day, F.lit("")))).otherwise(text)


def described(text: Column) -> Column:
    return t.let(text, lambda x: F.when(x == "", UNKNOWN).otherwise(x))


def text_line(line: Column, year: int = 2024, default: str = "2024-01-01") -> Column:
    """Struct of a line's first amount, first date and the rest; null without an amount."""

    def row(x: Column) -> Column:
        rest = without(F.trim(F.replace(x["line"], x["money"], F.lit(""))), x["day"])
        return F.struct(row_date(x["day"], year, _default(default)).alias("date"), described(rest).alias("description"), _money(x["money"]).alias("amount_brl"))

    parts = t.let(F.trim(line), lambda x: F.struct(x.alias("line"), F.regexp_extract(x, PLAIN_MONEY, 0).alias("money"), F.regexp_extract(x, DAY, 0).alias("day")))
    return t.let(parts, lambda x: F.when(x["money"] != "", row(x)))


def text_rows(lines: DataFrame, year: int = 2024, default: str = "2024-01-01", confidence: Column | float = 0.6) -> DataFrame:
    """Rows of lines (doc_id, line_no, line) with an amount; confidence .6, or .9 of what is given."""
    score = F.lit(confidence) if isinstance(confidence, float) else 0.9 * confidence
    found = lines.select(
        "doc_id", "line_no", F.when(F.spark_partition_id() >= 0, text_line(F.col("line"), year, default)).alias("r"),
        F.round(F.least(score, F.lit(1.0)), 6).alias("confidence")
    )
    return found.filter("r is not null").select("doc_id", "line_no", "r.*", "confidence").withColumn("category", rules.category(F.col("description")))


def with_paragraphs(tables: DataFrame, paragraphs: DataFrame, order: str = "line_no", least: int = 5) -> DataFrame:
    """Rows of tables, and in documents with fewer than `least` of them the paragraphs' rows besides.

    A paragraph's row that equals one before it, or a table's, in date, description and cents is left out.
    """
    on, columns = ["doc_id", "date", "description", "amount_brl"], ["doc_id", "date", "description", "amount_brl", "category", "confidence"]
    many = tables.groupBy("doc_id").agg(F.count("*").alias("n")).filter(F.col("n") >= least).select("doc_id")
    first = paragraphs.withColumn("\0n", F.row_number().over(W.partitionBy(*on).orderBy(order))).filter("`\0n` = 1").drop("\0n")
    fresh = first.join(many, "doc_id", "left_anti").join(tables.select(*on).distinct(), on, "left_anti")
    return tables.select(*columns, F.lit("table").alias("strategy")).unionByName(fresh.select(*columns, F.lit("paragraph").alias("strategy")))


def tables_else_lines(tables: DataFrame, lines: DataFrame) -> DataFrame:
    """Rows of tables; of documents whose tables gave none, the rows of their lines."""
    columns = ["doc_id", "date", "description", "amount_brl", "category", "confidence"]
    rest = lines.join(tables.select("doc_id").distinct(), "doc_id", "left_anti")
    return tables.select(*columns, F.lit("table").alias("strategy")).unionByName(rest.select(*columns, F.lit("line").alias("strategy")))


def table_cascade(lattice: DataFrame, stream: DataFrame, aggressive: DataFrame, order: str = "row_idx") -> DataFrame:
    """Rows of three ways to find tables: all of lattice, those of stream that aren't there yet, and aggressive's where both gave none.

    Rows are the same if equal in document, date, description and cents; stream's own repeats count once.
    """
    on, columns = ["doc_id", "date", "description", "amount_brl"], ["doc_id", "date", "description", "amount_brl", "category", "confidence"]
    first = stream.withColumn("\0n", F.row_number().over(W.partitionBy(*on).orderBy(order))).filter("`\0n` = 1")
    fresh = first.join(lattice.select(*on).distinct(), on, "left_anti")
    some = lattice.select("doc_id").union(stream.select("doc_id")).distinct()
    tag = lambda d, n: d.select(*columns, F.lit(n).alias("method"))
    return tag(lattice, "lattice").unionByName(tag(fresh, "stream")).unionByName(tag(aggressive.join(some, "doc_id", "left_anti"), "aggressive"))


def layout_rows(cells: DataFrame, lines: DataFrame, fields: DataFrame | None = None) -> DataFrame:
    """Rows of an analysed layout: of its tables and, where these are few, its lines; documents that have rows
    from structured fields (a bank statement model's) keep those alone."""
    found = with_paragraphs(
        cell_rows(cells, "B", header=0),
        text_rows(lines, confidence=F.coalesce("confidence", F.lit(0.7)) if "confidence" in lines.columns else F.lit(0.7))
    )
    if fields is None:
        return found
    columns = ["doc_id", "date", "description", "amount_brl", "category", "confidence"]
    return found.join(fields.select("doc_id").distinct(), "doc_id", "left_anti").unionByName(fields.select(*columns, F.lit("fields").alias("strategy")))


def column_rows(cells: DataFrame, columns: DataFrame, method: str = "lattice", year: int = 2024, default: str = "2024-01-01") -> DataFrame:
    """Rows of tables whose columns are known (infer_columns); the amount's cell must hold a digit. Confidence .9 of the rule's."""
    key, place = ["doc_id", "table_idx"], F.col("col_idx")
    known = cells.join(columns, key)
    pick = lambda c: F.max(F.when(place == F.col(c), F.coalesce("content", F.lit("")))).alias(c)
    rows = known.groupBy(*key, "row_idx").agg(pick("date_col"), pick("amount_col"), pick("description_col"), F.max(F.col("date_col").isNotNull()).alias("dated"))
    rows = rows.filter(looks_like_amount(F.col("amount_col")))
    described = F.coalesce(F.trim("description_col"), F.lit(f"Transaction from {method} table"))
    out = rows.select(
        *key, "row_idx",
        F.when(looks_like_date(F.col("date_col")), row_date(F.col("date_col"), year, _default(default))).otherwise(_default(default)).alias("date"),
        described.alias("description"), _money(F.col("amount_col")).alias("amount_brl"), "dated"
    )
    score = confidence.row(F.col("amount_brl"), F.col("description"), F.lit(0), F.col("dated")) * 0.9
    return out.select(*key, "row_idx", "date", "description", "amount_brl", *_kinds(), F.round(score, 6).alias("confidence"))


#: Candidates of an island that are folded in one row; larger islands are chained by doubling.
ISLAND = 1000


def non_overlapping(candidates: DataFrame, key: str = "doc_id", start: str = "start", end: str = "end", island: int = ISLAND) -> DataFrame:
    """Of candidates that take the places start..end of their document, those a scan from the front takes.

    A scan takes a candidate if its start is behind all that was taken. Islands of at most `island`
    candidates that overlap each other are folded one by one, larger ones are chained.
    """
    tables = Tables(candidates.sparkSession)
    rows = tables.keep(candidates.withColumn(start, F.col(start).cast("long")))
    w = W.partitionBy(key).orderBy(start)
    reach = F.max(end).over(w.rowsBetween(W.unboundedPreceding, -1))
    islands = rows.select(key, F.col(start).alias("s"), F.col(end).cast("long").alias("e"), (F.col(start) > F.coalesce(reach, F.lit(-1))).cast("int").alias("new"))
    islands = islands.withColumn("island", F.sum("new").over(W.partitionBy(key).orderBy("s").rowsBetween(W.unboundedPreceding, 0)))
    islands = tables.keep(islands.select(key, "island", "s", "e"))
    large = tables.keep(islands.groupBy(key, "island").count().filter(F.col("count") > island).select(key, "island"))
    spans = islands.join(large, [key, "island"], "left_anti").groupBy(key, "island").agg(F.array_sort(F.collect_list(F.struct("s", "e"))).alias("x"))
    none = F.struct(F.lit(-1).cast("long").alias("free"), F.array().cast("array<bigint>").alias("taken"))
    step = lambda a, x: F.when(x["s"] > a["free"], F.struct(x["e"].alias("free"), F.array_append(a["taken"], x["s"]).alias("taken"))).otherwise(a)
    taken = spans.select(key, F.explode(F.aggregate("x", none, step)["taken"]).alias(start))
    if not large.isEmpty():
        taken = taken.unionByName(_chained(islands.join(large, [key, "island"], "left_semi"), [key, "island"], tables).select(key, F.col("s").alias(start)))
    return rows.join(taken, [key, start], "left_semi")


def _chained(spans: DataFrame, keys: list[str], tables: Tables) -> DataFrame:
    """(keys, s) of the spans (keys, s, e) on the chain from each group's first to its next free one and so on.

    A span's next is the first that starts behind its end. Jumps of 1, 2, 4, ... links are made by
    joining the jumps with themselves, and each takes all that was taken so far as many links
    further, so a chain of n links takes log n rounds, each a join of all spans.
    """
    first = spans.groupBy(*keys, "s").agg(F.min("e").alias("e"))  # of spans with one start the scan takes one
    places = first.select(*keys, F.col("s").alias("at"), F.lit(1).alias("opens")).unionByName(first.select(*keys, F.col("e").alias("at"), F.lit(0).alias("opens")))
    behind = W.partitionBy(*keys).orderBy(F.desc("at"), "opens").rowsBetween(W.unboundedPreceding, 0)
    nexts = places.distinct().withColumn("to", F.last(F.when(F.col("opens") == 1, F.col("at")), ignorenulls=True).over(behind)).filter("opens = 0")
    jumps = tables.keep(first.join(nexts.select(*keys, F.col("at").alias("e"), "to"), [*keys, "e"]).filter("to is not null").select(*keys, "s", "to"))
    taken = new = tables.keep(first.groupBy(*keys).agg(F.min("s").alias("s")))
    while not new.isEmpty():
        new = tables.keep(taken.join(jumps, [*keys, "s"]).select(*keys, F.col("to").alias("s")))
        taken = taken.unionByName(new)
        further = jumps.select(*keys, F.col("s").alias("to"), F.col("to").alias("last"))
        jumps = tables.keep(jumps.join(further, [*keys, "to"]).select(*keys, "s", F.col("last").alias("to")))
    return taken


def bundles(lines: DataFrame, year: int = 2024) -> DataFrame:
    """Purchases of two lines (with a category line) or three (foreign: city and amounts, then the rate).

    lines: (doc_id, line_no, line). A line that is taken belongs to no other purchase.
    """
    w = W.partitionBy("doc_id").orderBy("line_no")
    at = lines.select(
        "doc_id", "line_no", F.row_number().over(w).alias("start"), F.col("line").alias("a"), F.lead("line").over(w).alias("b"),
        F.lead("line", 2).over(w).alias("c")
    )
    get = lambda c, p, k: F.regexp_extract(c, p, k)
    home = is_category(F.col("b"))
    abroad = F.col("c").contains("Dólar de Conversão") & F.col("b").rlike(ABROAD)
    kind = F.when(home, "domestic").when(abroad, "international")
    found = at.filter(F.col("a").rlike(PURCHASE)).withColumn("kind", kind).filter("kind is not null")
    intl = F.col("kind") == "international"
    value = t.amount(F.when(intl, get("b", ABROAD, 4)).otherwise(get("a", PURCHASE, 3)), "C").cast("decimal(18,2)")
    rate = t.amount(F.nullif(get("c", CONVERSION, 1), F.lit("")), "C").cast("decimal(18,4)")
    out = found.select(
        "doc_id", "line_no", "start", (F.col("start") + F.when(intl, 2).otherwise(1)).alias("end"), "kind", t.date(get("a", PURCHASE, 1), year).alias("date"), F.trim(get("a", PURCHASE, 2)).alias("description"),
        value.alias("amount_brl"), F.when(intl, "INTERNACIONAL").otherwise(F.trim(get("b", CATEGORY, 1))).alias("category"), F.trim(F.when(intl, get("b", ABROAD, 1)).otherwise(get("b", CATEGORY, 2))).alias("city"),
        F.when(intl, t.amount(get("b", ABROAD, 2), "C").cast("decimal(18,2)")).alias("amount_orig"), F.when(intl, get("b", ABROAD, 3)).alias("currency"), F.when(intl, rate).alias("fx_rate"),
    )
    return non_overlapping(out.filter("amount_brl is not null")).drop("start", "end")


def anchored_text(text: Column, segments: Column) -> Column:
    """The text's segments [start, end) one after another, trimmed; a null start is 0, a null end the text's."""
    cut = lambda s: F.substr(text, F.coalesce(s["start"], F.lit(0)) + 1, F.coalesce(s["end"], F.length(text)) - F.coalesce(s["start"], F.lit(0)))
    return F.trim(F.array_join(F.transform(segments, cut), ""))


def document_tables(docs: DataFrame) -> DataFrame:
    """Rows of cell texts from documents (doc_id, text, pages): pages of tables of rows of cells of text segments."""
    pages = docs.select("doc_id", "text", F.posexplode("pages").alias("page", "p"))
    tables = pages.select("doc_id", "text", "page", F.posexplode("p.tables").alias("table_idx", "b"))
    rows = tables.select("doc_id", "text", "page", "table_idx", F.posexplode("b.rows").alias("row_idx", "r"))
    return rows.select("doc_id", "page", "table_idx", "row_idx", F.transform("r.cells", lambda c: anchored_text(F.col("text"), c["segments"])).alias("cells"))


def purchase_rows(rows: DataFrame, year: int = 2024) -> DataFrame:
    """Rows of cell texts that are purchases: two cells or more, none of the words NO_ROW, a real date, an amount of
    0.01 to 100000, and a description of 3 characters or more with a capital; cells with a point name category and city."""
    whole = F.lower(F.array_join("cells", " "))
    able = rows.filter((F.size("cells") >= 2) & ~F.exists(F.array(*map(F.lit, NO_ROW)), lambda w: whole.contains(w)))

    def day(x: Column) -> Column:
        part = lambda k: F.nullif(F.regexp_extract(x, DAY_YEAR, k), F.lit(""))
        return F.try_to_date(F.concat_ws("-", F.coalesce(part(3), F.lit(str(year))), F.lpad(part(2), 2, "0"), F.lpad(part(1), 2, "0")), "yyyy-MM-dd")

    def value(x: Column) -> Column:
        got = t.amount(F.nullif(F.regexp_extract(x, CENTS, 0), F.lit("")), "C").cast("decimal(18,2)")
        return F.when(got.between(0.01, 100000), got)

    def named(x: Column) -> Column:
        return (F.length(x) > 5) & ~F.regexp_replace(x, "[ .,]", "").rlike(r"^\d+$") & x.rlike(CODES)

    first = lambda f: F.get(F.filter(F.transform("cells", f), lambda x: x.isNotNull()), F.lit(0))
    bare = lambda x: F.trim(F.regexp_replace(F.regexp_replace(F.regexp_replace(x, DAY + r"(?:/\d{4})?", ""), CENTS, ""), r"\s+", " "))
    words = F.filter(F.transform(F.filter("cells", named), bare), lambda x: F.length(x) > 3)
    dotted = F.try_element_at(F.filter("cells", lambda x: named(x) & x.contains(".")), F.lit(-1))
    part = lambda k, default: F.coalesce(F.trim(F.get(F.split("dotted", r"\."), F.lit(k))), F.lit(default))
    found = able.select(*rows.columns, first(day).alias("date"), first(value).alias("amount_brl"), F.array_join(words, " ").alias("description"), dotted.alias("dotted"))
    kept = found.filter("date is not null and amount_brl is not null").filter((F.length("description") >= 3) & F.col("description").rlike("[A-Z]"))
    return kept.withColumns({"category": part(0, "DIVERSOS"), "merchant_city": part(1, "")}).drop("dotted", "cells")


def entities_of(docs: DataFrame) -> DataFrame:
    """(doc_id, idx, type, value, confidence) of documents' entities, in their order."""
    return docs.select("doc_id", F.posexplode("entities").alias("idx", "e")).select("doc_id", "idx", "e.type", "e.value", "e.confidence")


def form_fields(docs: DataFrame) -> DataFrame:
    """(doc_id, page, idx, name, value, confidence) of the form fields on documents' pages that have a name or a value; no confidence is 0."""
    fields = docs.select("doc_id", F.posexplode("pages").alias("page", "p")).select("doc_id", "page", F.posexplode("p.form_fields").alias("idx", "f"))
    text = lambda c: F.coalesce(f"f.{c}", F.lit(""))
    out = fields.select("doc_id", "page", "idx", text("name").alias("name"), text("value").alias("value"), F.coalesce("f.confidence", F.lit(0.0)).alias("confidence"))
    return out.filter("name <> '' or value <> ''")


def entity_rows(entities: DataFrame, least: float = 0.5, year: int = 2024, default: str = "2024-01-01") -> DataFrame:
    """Rows of entities (doc_id, idx, type, value, confidence): the k-th date, amount and description of a document together.

    Entities below `least`, of other types, or without a value once read don't count; a row needs a date or an amount.
    """
    kind = F.lit(None).cast("string")
    for name, types in ENTITIES.items():
        kind = F.when(F.lower("type").isin(*types), name).otherwise(kind)
    value = F.trim("value")
    read = entities.filter(F.col("confidence") >= least).withColumn("kind", kind).filter("kind is not null")
    read = read.withColumns({
        "date": F.when(F.col("kind") == "date", t.date(value, year, anywhere=True)),
        "amount": F.when(F.col("kind") == "amount", F.nullif(_money(value), F.lit(0).cast("decimal(18,2)"))),
        "words": F.when(F.col("kind") == "description", F.nullif(t.clean_description(value), F.lit("")))
    })
    read = read.filter(F.coalesce(F.col("date").cast("string"), F.col("amount").cast("string"), "words").isNotNull())
    placed = read.withColumn("place", F.row_number().over(W.partitionBy("doc_id", "kind").orderBy("idx")) - 1)
    rows = placed.groupBy("doc_id", "place").agg(F.max("date").alias("day"), F.max("amount").alias("amount"), F.max("words").alias("words"))
    rows = rows.filter("day is not null or amount is not null")
    return rows.select(
        "doc_id", "place", F.coalesce("day", _default(default)).alias("date"),
        F.coalesce("amount", F.lit(0).cast("decimal(18,2)")).alias("amount_brl"),
        F.coalesce("words", F.lit("Transaction")).alias("description"), F.lit("UNKNOWN").alias("category")
    )
