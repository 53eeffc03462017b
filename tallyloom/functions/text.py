"""Column functions on statement text: pt-BR amounts, dates, cleaning and extraction.

All are null in, null out unless they say otherwise; none raises on bad text.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Amounts as statements print them, and names of cities in capitals.
MONEY = r"-?\d{1,3}(?:\.\d{3})*,\d{2}"
CITY_NAME = r"([A-Z]{2,}(?:\s+[A-Z]{2,})*)"
#: Characters stripped from the start of a line (fixed values).
LEADING = ">@§$Z)_•*®«» "
#: Words that a description loses before it is compared (fixed values).
STOP_WORDS = "de da do em na no a o e para com".split()
#: Words that are no city (fixed values).
NO_CITY = ["FINAL", "CARD", "CARTAO", "DEBITO", "CREDITO"]
# Patterns of cards, installments, rates, foreign lines, periods, accounts and balances.
CARD, CARD_HEADER = r"final (\d{4})", r"(?iu)CARTÃO.*?FINAL (\d{4})"
INSTALLMENT = r"(\d{1,2})/(\d{1,2})"
FX_RATE = r"^D[óo]lar de Convers[ãa]o.*?(\d+,\d{4})"
FX_LINE = r"^(.+?)\s+([\d.,]+)\s+([A-Z]{3})\s+([\d.,]+)$"
PERIOD = r"(?iu)PERÍODO:\s*(\d{2}/\d{2}/\d{4})\s*A\s*(\d{2}/\d{2}/\d{4})"
DUE = r"(?iu)VENCIMENTO:\s*(\d{2}/\d{2}/\d{4})"
ACCOUNTS = [(r"(?iu)Conta[:\s]+(\d{4,}-?\d?)", 1), (r"(?iu)Account[:\s]+(\d{4,}-?\d?)", 1), (r"(?iu)Ag[êe]ncia[:\s]+(\d{4})[^\d]*Conta[:\s]+(\d{4,}-?\d?)", 2)]
BALANCES = [r"(?iu)Saldo[:\s]+R\$\s*([-]?\d{1,3}(?:\.\d{3})*,\d{2})", r"(?iu)Balance[:\s]+R\$\s*([-]?\d{1,3}(?:\.\d{3})*,\d{2})"]


def let(value: Column, f: Callable[[Column], Column]) -> Column:
    """f of a value that is computed once; written out, it would be computed wherever f names it."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def _decimal(text: Column) -> Column:
    return text.try_cast("decimal(38,6)")


def amount(text: Column, variant: str = "A") -> Column:
    """A number written the Brazilian way, as decimal(38,6).

    A: points are thousands only if a comma is there too; other characters go; bad text is 0.
    B: Brazilian if the last comma is right of the last point; bad text is null.
    C: points always go, a comma is the point; bad text is null.  G: as C, bad text is 0.
    D: only digits, commas and minus count.  F: a comma is the point, points stay; 0 without digits.
    """
    if variant == "D":
        return _decimal(F.replace(F.regexp_replace(text, r"[^0-9,\-]", ""), F.lit(","), F.lit(".")))
    return let(F.regexp_replace(text, r"\s", ""), lambda bare: _amount(bare, variant))


def _amount(bare: Column, variant: str) -> Column:
    """amount of a text without white space."""
    swapped = F.replace(F.replace(bare, F.lit("."), F.lit("")), F.lit(","), F.lit("."))
    comma = F.replace(bare, F.lit(","), F.lit("."))
    if variant == "A":
        both = bare.contains(",") & bare.contains(".")
        plain = F.when(both, swapped).when(bare.contains(","), comma).otherwise(bare)
        return F.when(bare.isNotNull(), F.coalesce(_decimal(F.regexp_replace(plain, r"[^0-9.\-]", "")), F.lit(0)))
    if variant == "B":
        last = lambda c: F.length(bare) - F.locate(c, F.reverse(bare))
        brazil = bare.contains(",") & (~bare.contains(".") | (last(",") > last(".")))
        return _decimal(F.when(brazil, swapped).otherwise(F.replace(bare, F.lit(","), F.lit(""))))
    if variant == "C":
        return _decimal(swapped)
    if variant == "G":
        return F.when(bare.isNotNull(), F.coalesce(_decimal(swapped), F.lit(0)))
    if variant == "F":
        return F.when(bare.rlike("[0-9]"), _decimal(comma)).when(bare.isNotNull(), F.lit(0))
    raise ValueError(f"no variant {variant}")


def date(text: Column, year: int | Column = 2024, anywhere: bool = False) -> Column:
    """D/M or D/M/YYYY as a date; null for days that don't exist. anywhere: not only at the start."""
    pattern = ("" if anywhere else "^") + r"\s*(\d{1,2}/\d{1,2}(?:/\d{4})?)"

    def of(parts: Column) -> Column:
        y = F.coalesce(F.get(parts, F.lit(2)), (F.lit(year) if isinstance(year, int) else year).cast("string"))
        iso = F.concat_ws("-", F.lpad(y, 4, "0"), F.lpad(F.get(parts, F.lit(1)), 2, "0"), F.lpad(F.get(parts, F.lit(0)), 2, "0"))
        return F.when(F.size(parts) > 1, iso.try_cast("date"))

    return let(F.split(F.regexp_extract(text, pattern, 1), "/"), of)


def iso_date(text: Column) -> Column:
    """Strict yyyy-MM-dd as a date, else null."""
    return F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.try_to_date(text, "yyyy-MM-dd"))


def without_icons(text: Column) -> Column:
    """Drops private-use glyphs."""
    return F.regexp_replace(text, r"[\uE000-\uF8FF]", "")


def clean_line(text: Column) -> Column:
    """A raw line without icons, leading symbols, underscores and runs of blanks."""
    return F.trim(F.regexp_replace(F.translate(F.ltrim(without_icons(text), F.lit(LEADING)), "_", " "), r"\s{2,}", " "))


def clean_description(text: Column) -> Column:
    """Blanks collapsed; asterisks, runs of 16 or more digits and of 10 or more capitals removed."""
    out = F.regexp_replace(text, r"\s+", " ")
    for gone in (r"\*+", r"\d{16,}", r"[A-Z]{10,}"):
        out = F.regexp_replace(out, gone, "")
    return F.trim(out)


def comparable(text: Column) -> Column:
    """Lower-case words without punctuation and stop words, for comparing descriptions."""
    words = F.split(F.regexp_replace(F.lower(text), r"(?U)[^\w\s]", " "), r"\s+")
    return F.array_join(F.filter(words, lambda w: (w != "") & ~w.isin(*STOP_WORDS)), " ")


def model_text(text: Column) -> Column:
    """Upper-case text for the models, without card words."""
    out = F.upper(F.regexp_replace(text, r"\s+", " "))
    for gone in ("FINAL", "CARTAO", "CART.", "*"):
        out = F.replace(out, F.lit(gone), F.lit(""))
    return F.trim(out)


def card_last4(text: Column) -> Column:
    return F.nullif(F.regexp_extract(text, CARD, 1), F.lit(""))


def card_of_header(text: Column) -> Column:
    """Last 4 digits of the card a statement's header names."""
    return F.nullif(F.regexp_extract(text, CARD_HEADER, 1), F.lit(""))


def card_of(text: Column, holder: str) -> Column:
    """Last 4 digits of a named holder's card, as in `NAME (final 1234)`; empty without."""
    return F.when(text.isNotNull(), F.regexp_extract(text, rf"{_escaped(holder)} \(final (\d{{4}})\)", 1))


def _escaped(word: str) -> str:
    return "".join(c if c.isalnum() or c == " " else f"\\{c}" for c in word)


def period(text: Column) -> Column:
    """Struct (start, end, due) of the dates a statement names; nulls without."""
    get = lambda p, k: date(F.nullif(F.regexp_extract(text, p, k), F.lit("")))
    return F.struct(get(PERIOD, 1).alias("start"), get(PERIOD, 2).alias("end"), get(DUE, 1).alias("due"))


def account(text: Column) -> Column:
    """Account number by the first pattern that fits."""
    return F.coalesce(*[F.nullif(F.regexp_extract(text, p, k), F.lit("")) for p, k in ACCOUNTS])


def balance(text: Column) -> Column:
    """Balance by the first pattern that fits."""
    return F.coalesce(*[amount(F.nullif(F.regexp_extract(text, p, 1), F.lit("")), "C") for p in BALANCES]).cast("decimal(18,2)")


def date_text(text: Column, year: int = 2024, checked: bool = False) -> Column:
    """D/M or D/M/YYYY at the start as yyyy-MM-dd text; else the text unchanged.

    Days to 31 and months to 12 pass, whether the day exists or not; unchecked, every number does.
    """
    part = lambda k: F.regexp_extract(text, r"^(\d{1,2})/(\d{1,2})(?:/(\d{4}))?", k)
    iso = F.concat_ws("-", F.when(part(3) != "", part(3)).otherwise(F.lit(str(year))), F.lpad(part(2), 2, "0"), F.lpad(part(1), 2, "0"))
    ok = part(1) != ""
    if checked:
        ok = ok & part(1).try_cast("int").between(1, 31) & part(2).try_cast("int").between(1, 12)
    return F.when(ok, iso).otherwise(text)


def installment(text: Column) -> tuple[Column, Column]:
    """(number, of how many) of the first n/m; nulls without."""
    return tuple(F.regexp_extract(text, INSTALLMENT, k).try_cast("int") for k in (1, 2))


def fx_rate(text: Column) -> Column:
    """The rate of a conversion line, decimal(18,4)."""
    found = F.regexp_extract(text, FX_RATE, 1)
    return F.replace(found, F.lit(","), F.lit(".")).try_cast("decimal(18,4)")


def city(text: Column) -> Column:
    """City of a description: capitals before BR, at the end, or before a number; NO_CITY words are passed over."""
    tries = [F.nullif(F.trim(F.regexp_extract(text, p, 1)), F.lit("")) for p in (rf"\b{CITY_NAME}\s+BR\b", rf"\b{CITY_NAME}\s*$", rf"\s+{CITY_NAME}\s+\d")]
    return F.coalesce(*[let(t, lambda x: F.when(~x.isin(*NO_CITY), x)) for t in tries])


def fx_line(text: Column) -> Column:
    """Struct (city, currency, amount) of a line like `CITY 10,00 USD 10,00`; null if it isn't one."""
    get = lambda k: F.regexp_extract(text, FX_LINE, k)
    return F.when(text.rlike(FX_LINE), F.struct(get(1).alias("city"), get(3).alias("currency"), amount(get(2)).alias("amount")))


def ledger_hash(day: Column, description: Column, value: Column, card: Column | None = None) -> Column:
    """First 8 hex digits of the MD5 of date, description and amount (2 places), and the card if given."""
    parts = [F.date_format(day, "yyyy-MM-dd"), description, value.cast("decimal(18,2)").cast("string")]
    parts += [F.coalesce(card, F.lit(""))] if card is not None else []
    return F.substring(F.md5(F.concat_ws("_", *parts).cast("binary")), 1, 8)


def money(value: Column, places: int = 2) -> Column:
    """1.234,56"""
    return F.translate(F.format_number(value, places), ",.", ".,")


def jaccard(a: Column, b: Column) -> Column:
    """Shared share of the words of two comparable texts: both empty 1, one empty 0."""
    words = lambda c: F.array_distinct(F.filter(F.split(c, " "), lambda w: w != ""))
    both = F.struct(words(a).alias("x"), words(b).alias("y"))
    sizes = let(both, lambda w: F.struct(F.size(F.array_union(w["x"], w["y"])).alias("all"), F.size(F.array_intersect(w["x"], w["y"])).alias("shared")))
    return let(sizes, lambda n: F.when(n["all"] == 0, F.lit(1.0)).otherwise(n["shared"] / F.nullif(n["all"], F.lit(0))))
