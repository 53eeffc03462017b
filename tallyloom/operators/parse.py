"""Statement lines, table cells, words and entities to typed rows. Every window is per document."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as t
from ..functions.text import MONEY
from . import layout

# Patterns of purchases, of a second line, of taxes and rates.
NATIONAL = rf"^(\d{{2}}/\d{{2}})\s+(.+?)\s+({MONEY})$"
FOREIGN = rf"^(\d{{2}}/\d{{2}})\s+(.+?)\s+({MONEY})\s+({MONEY})$"
SECOND = r"^([A-ZÇÉÂÊÕ ]+)\.\s+([A-ZÂÁÉÍÓÚÊÔÛ .-]+)$"
IOF, RATE = r"(?iu)Repasse de IOF", r"D[óo]lar de Convers[ãa]o.*?([\d.]+,\d{2,4})"
# Dates anywhere in a line, the longer first, and amounts with their sign.
FULL_DAY, SHORT_DAY, REAIS = r"\d{1,2}/\d{1,2}/\d{4}", r"\d{1,2}/\d{1,2}", rf"R\$\s*({MONEY})"
# Section headings.
SECTIONS = {"domestic": "lançamentos: compras e saques", "international": "lançamentos internacionais", "instalments_next": "compras parceladas – próximas faturas"}


def lines_of(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(doc_id, line_no, line) for every line of every document."""
    return docs.select(F.col(id_col).alias("doc_id"), F.posexplode(F.split(F.col(text_col), "\n")).alias("line_no", "line"))


def once(struct: Column) -> Column:
    """The struct, held as a column: the optimizer would otherwise repeat its expression for each field read.

    The partition's number only makes the expression one that mustn't be repeated; its value doesn't count.
    Filters on a column made so aren't pushed below it, those on other columns before it are.
    """
    return F.when(F.spark_partition_id() >= 0, struct)


MARK = "\u0001"


def parts(line: Column, pattern: str, groups: int) -> Column:
    """The groups of a pattern that takes a whole line, as an array, by one run of the pattern; other lines stay one part."""
    return F.split(F.regexp_replace(F.translate(line, MARK, " "), pattern, MARK.join(f"${k}" for k in range(1, groups + 1))), MARK)


def _row(found: Column, groups: int, shape: str, year: int) -> Column:
    """Struct of a purchase's parts (date, description, amounts); null where the pattern didn't fit."""
    money = lambda k: t.amount(F.get(found, F.lit(k)), "C").cast("decimal(18,2)")
    row = F.struct(
        t.date(F.get(found, F.lit(0)), year).alias("date"), F.get(found, F.lit(1)).alias("description"), money(groups - 1).alias("amount_brl"),
        (money(2) if groups == 4 else F.lit(None).cast("decimal(18,2)")).alias("amount_orig"), F.lit(shape).alias("shape"), F.lit(1.0).alias("share"),
    )
    return F.when(F.size(found) == groups, row)


def fallback(line: Column, year: int = 2024) -> Column:
    """Struct of the first date and first amount anywhere in a line of 10 characters or more."""

    def row(x: Column) -> Column:
        rest = F.replace(F.replace(F.replace(x["line"], x["day"], F.lit("")), x["money"], F.lit("")), F.lit("R$"), F.lit(""))
        return F.struct(
            t.date(x["day"], year).alias("date"), F.trim(F.regexp_replace(rest, r"\s+", " ")).alias("description"), t.amount(x["money"]).cast("decimal(18,2)").alias("amount_brl"),
            F.lit(None).cast("decimal(18,2)").alias("amount_orig"), F.lit("fallback").alias("shape"), F.lit(0.7).alias("share"),
        )

    def found(text: Column) -> Column:
        get = lambda p, k: t.let(F.regexp_extract(text, p, k), lambda x: F.when(x != "", x))
        day, money = F.coalesce(get(FULL_DAY, 0), get(SHORT_DAY, 0)), F.coalesce(get(REAIS, 1), get(MONEY, 0))
        parts = F.when(F.length(text) >= 10, F.struct(text.alias("line"), day.alias("day"), money.alias("money")))
        read = t.let(parts, lambda x: F.when(x["day"].isNotNull() & x["money"].isNotNull(), row(x)))
        return t.let(read, lambda r: F.when(r["date"].isNotNull() & (F.length(r["description"]) > 3), r))

    return t.let(line, found)


def last_amount(line: Column, year: int = 2024, default: str = "2024-01-01") -> Column:
    """Struct of the last amount in a line, the first date anywhere (or the default) and the rest; null without an amount."""
    money = lambda text: F.try_element_at(F.regexp_extract_all(text, F.lit(f"({MONEY})"), F.lit(1)), F.lit(-1))

    def row(x: Column) -> Column:
        rest = layout.without(F.trim(F.replace(x["line"], x["money"], F.lit(""))), x["day"])
        return F.struct(
            F.coalesce(t.date(x["day"], year), F.lit(default).cast("date")).alias("date"), layout.described(rest).alias("description"), t.amount(x["money"]).cast("decimal(18,2)").alias("amount_brl"),
            F.lit(None).cast("decimal(18,2)").alias("amount_orig"), F.lit("fallback").alias("shape"), F.lit(0.7).alias("share"),
        )

    parts = t.let(line, lambda x: F.struct(x.alias("line"), money(x).alias("money"), F.regexp_extract(x, SHORT_DAY, 0).alias("day")))
    return t.let(parts, lambda x: F.when(x["money"].isNotNull(), row(x)))


def parse_lines(lines: DataFrame, year: int = 2024, order: Sequence[str] = ("fx", "national", "fallback"), default: str = "2024-01-01") -> DataFrame:
    """Typed rows of lines by the first shape that fits; headers, footers and blank lines give none.

    A line with two amounts also fits the national shape, so foreign comes first unless the order says otherwise.
    """
    line = F.trim("line")
    kept = lines.filter((line != "") & ~layout.is_header(line)).withColumn("\0national", once(parts(line, NATIONAL, 3)))
    # A line of two amounts fits both shapes, so only lines that fit the national one are read for it.
    kept = kept.withColumn("\0fx", once(F.when(F.size("\0national") == 3, parts(line, FOREIGN, 4))))
    shapes = {"fx": _row(F.col("`\0fx`"), 4, "fx", year), "national": _row(F.col("`\0national`"), 3, "national", year), "fallback": last_amount(line, year, default)}
    return kept.withColumn("\0row", once(F.coalesce(*[shapes[s] for s in order]))).filter("`\0row` is not null").select("doc_id", "line_no", "`\0row`.*")


def _per_doc(*more: str):
    return W.partitionBy("doc_id", *more).orderBy("line_no")


def two_line(lines: DataFrame, year: int = 2024) -> DataFrame:
    """National rows with category and city of the next line, where it has them."""
    nxt = F.lead("line").over(_per_doc())
    part = lambda k: F.nullif(F.regexp_extract("next", SECOND, k), F.lit(""))
    out = lines.withColumns({"next": nxt, "\0p": once(parts(F.col("line"), NATIONAL, 3))}).filter("size(`\0p`) = 3").withColumn("\0row", _row(F.col("`\0p`"), 3, "national", year))
    return out.select("doc_id", "line_no", "`\0row`.date", "`\0row`.description", "`\0row`.amount_brl", F.trim(part(1)).alias("category"), F.trim(part(2)).alias("city"))


def sections(lines: DataFrame) -> DataFrame:
    """Each line with the section that the last heading before it opened."""
    head = F.lit(None).cast("string")
    for name, phrase in SECTIONS.items():
        head = F.when(F.lower("line").contains(phrase), name).otherwise(head)
    return lines.withColumn("section", F.last(head, ignorenulls=True).over(_per_doc().rowsBetween(W.unboundedPreceding, 0)))


def fx_chunks(lines: DataFrame) -> DataFrame:
    """Foreign purchases: a two-amount line whose rate (needed) and tax (0 without) are in the two lines after it.

    A line up to the last that a purchase uses belongs to no other; purchases equal in date,
    description, both amounts and rate count once.
    """
    w = _per_doc()
    rate = lambda c: F.when(~F.col(c).rlike(IOF), F.nullif(F.regexp_extract(c, RATE, 1), F.lit("")))
    tax = lambda c: F.when(F.col(c).rlike(IOF), F.nullif(F.regexp_extract(c, MONEY, 0), F.lit("")))
    out = lines.withColumns({"start": F.row_number().over(w), "a": F.lead("line", 1).over(w), "b": F.lead("line", 2).over(w)}).filter(F.col("line").rlike(FOREIGN))
    out = out.withColumns({"ra": rate("a"), "rb": rate("b"), "ta": tax("a"), "tb": tax("b")}).filter("ra is not null or rb is not null")
    out = out.withColumn("end", F.col("start") + F.when(F.col("rb").isNotNull() | F.col("tb").isNotNull(), 2).otherwise(1))
    found = layout.non_overlapping(out).withColumn("\0p", once(parts(F.col("line"), FOREIGN, 4))).withColumn("\0row", _row(F.col("`\0p`"), 4, "fx", 2024))
    found = found.withColumns({
        "fx_rate": t.amount(F.coalesce("rb", "ra"), "C").cast("decimal(18,4)"),
        "iof_brl": F.coalesce(t.amount(F.coalesce("tb", "ta"), "C"), F.lit(0)).cast("decimal(18,2)")
    })
    found = found.select("doc_id", "line_no", "`\0row`.date", "`\0row`.description", "`\0row`.amount_orig", "`\0row`.amount_brl", "fx_rate", "iof_brl")
    same = W.partitionBy("doc_id", "date", "description", "amount_brl", "amount_orig", "fx_rate").orderBy("line_no")
    return found.withColumn("\0n", F.row_number().over(same)).filter("`\0n` = 1").drop("\0n")


def infer_columns(cells: DataFrame) -> DataFrame:
    """Date, amount and description column of each table (doc_id, table_idx, row_idx, col_idx, content).

    The first column with more than half date-like cells, the first with more than half
    amount-like ones, and the longest of the others.
    """
    like = lambda p: F.avg(F.col("content").rlike(p).cast("int"))
    key = ["doc_id", "table_idx"]
    by = cells.groupBy(*key, "col_idx").agg(
        like(r"\d{1,2}/\d{1,2}").alias("dates"), like(r"\d+[,.]?\d*").alias("amounts"),
        F.avg(F.length("content")).alias("length"), F.min("row_idx").alias("first"), F.max("row_idx").alias("last")
    )
    table = by.groupBy(*key).agg(
        F.array_sort(F.collect_list(F.struct("col_idx", "dates", "amounts", "length"))).alias("c"),
        F.bool_or(F.col("first") != F.col("last")).alias("rows")
    )  # a row's columns
    date_col = F.get(F.filter("c", lambda x: x["dates"] > 0.5), F.lit(0))["col_idx"]
    amount_col = F.get(F.filter("c", lambda x: (x["amounts"] > 0.5) & (x["dates"] <= 0.5)), F.lit(0))["col_idx"]
    found = table.filter(F.col("rows") & (F.size("c") >= 3)).withColumns({"date_col": date_col, "amount_col": amount_col})
    rest = F.filter("c", lambda x: ~x["col_idx"].eqNullSafe(F.col("date_col")) & ~x["col_idx"].eqNullSafe(F.col("amount_col")))
    text = F.array_max(F.transform(rest, lambda x: F.struct(x["length"].alias("length"), (-x["col_idx"]).alias("place"))))
    return found.select(*key, "date_col", "amount_col", (-text["place"]).alias("description_col"))


def word_rows(words: DataFrame, tolerance: float = 3.0) -> DataFrame:
    """Words (doc_id, page, text, x0, x1, top, bottom) to lines by rounded top, with their box."""
    by = words.groupBy("doc_id", "page", F.bround(F.col("top") / tolerance, 0).cast("long").alias("bucket"))
    out = by.agg(
        F.array_sort(F.collect_list(F.struct("x0", "text"))).alias("ws"), F.min("x0").alias("x0"), F.max("x1").alias("x1"),
        F.min("top").alias("top"), F.max("bottom").alias("bottom")
    )
    return out.select("doc_id", "page", "bucket", F.array_join(F.transform("ws", lambda w: w["text"]), " ").alias("line"), "x0", "x1", "top", "bottom")


def anchored_rows(words: DataFrame, tolerance: float = 3.0) -> DataFrame:
    """Words to lines by anchor: a word starts a line when it is further than tolerance from the line's first.

    The fold goes over a page's distinct heights and keeps the line's anchor for each, so it
    grows with the lines of a page; words find their line by their height.
    """
    heights = words.groupBy("doc_id", "page").agg(F.array_sort(F.collect_set("top")).alias("tops"))
    none = F.struct(F.lit(None).cast("double").alias("anchor"), F.array().cast("array<double>").alias("starts"))

    def add(a, top):
        new = a["anchor"].isNull() | (F.abs(top - a["anchor"]) > tolerance)
        return F.when(new, F.struct(top.alias("anchor"), F.array_append(a["starts"], top).alias("starts"))).otherwise(a)

    starts = heights.select("doc_id", "page", F.posexplode(F.aggregate("tops", none, add)["starts"]).alias("row", "top"))
    marked = words.select("doc_id", "page", "top", "x0", "text", F.lit(None).cast("int").alias("row")).unionByName(starts.select(
        "doc_id", "page", "top", F.lit(None).cast("double").alias("x0"), F.lit(None).cast("string").alias("text"), "row"
    ))
    by_top = W.partitionBy("doc_id", "page").orderBy("top").rangeBetween(W.unboundedPreceding, 0)
    placed = marked.withColumn("row", F.max("row").over(by_top)).filter("text is not null")
    rows = placed.groupBy("doc_id", "page", "row").agg(F.array_sort(F.collect_list(F.struct("x0", "text"))).alias("ws"))
    return rows.select("doc_id", "page", "row", F.array_join(F.transform("ws", lambda w: w["text"]), " ").alias("line"))


def first_strategy(rows: DataFrame, rank: str = "strategy_rank") -> DataFrame:
    """Of each document the rows of its best strategy (least rank) that gave any."""
    return rows.withColumn("\0least", F.min(rank).over(W.partitionBy("doc_id"))).filter(F.col(rank) == F.col("`\0least`")).drop("\0least")


def zipped(rows: DataFrame, *arrays: str) -> DataFrame:
    """Ragged lists zipped by place, the shorter padded with null."""
    return rows.select("doc_id", F.posexplode(F.arrays_zip(*arrays)).alias("idx", "\0z")).select("doc_id", "idx", "`\0z`.*")


def totals(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """National, international and overall totals a statement names."""
    get = lambda name: t.amount(F.nullif(F.regexp_extract(text_col, rf"(?iu)TOTAL\s+{name}.*?R\$\s*([\d.,]+)", 1), F.lit("")), "C").cast("decimal(18,2)")
    return docs.select("doc_id", get("NACIONAL").alias("national"), get("INTERNACIONAL").alias("international"), get("GERAL").alias("overall"))


def account(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Account, balance, period and due date that a statement names."""
    text = F.col(text_col)
    return docs.select(
        "doc_id", t.account(text).alias("account"), t.balance(text).alias("balance"), t.period(text).alias("\0p")
    ).select("doc_id", "account", "balance", "`\0p`.*")
