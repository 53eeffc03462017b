"""Ordered rules as column expressions: categories, kinds, row classes, bands and routing."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import confidence
from .text import MONEY

# Category patterns on upper-case text, in the order they are tried.
CATEGORIES = [
    ("ALIMENTACAO", "RESTAURANTE|PADARIA|MERCADO|SUPERMERCADO|LANCHONETE|FOOD|MCDONALDS|BURGER|PIZZA"),
    ("TRANSPORTE", "UBER|99|TAXI|COMBUSTIVEL|POSTO|GASOLINA|ESTACIONAMENTO|METRO|BUS"),
    ("FARMACIA", "FARMACIA|DROGARIA|REMEDIOS?|MEDICINA"),
    ("VESTUARIO", "LOJA|ROUPA|CALCADO|SAPATO|VESTUARIO|MODA|ZARA|H&M"),
    ("ENTRETENIMENTO", "CINEMA|TEATRO|NETFLIX|SPOTIFY|STEAM|GAME|INGRESSO"),
    ("SUPERMERCADO", "SUPERMERCADO|MERCADO|CARREFOUR|EXTRA|WALMART"),
    ("SAUDE", "HOSPITAL|CLINICA|MEDICO|DENTISTA|LABORATORIO|SAUDE"),
    ("EDUCACAO", "ESCOLA|CURSO|UNIVERSIDADE|FACULDADE|EDUCACAO|LIVRO"),
    ("PAGAMENTO", "PAGAMENTO"),
    ("FX", "PAYPAL|AMAZON|NETFLIX|SPOTIFY|USD|EUR|INTERNACIONAL"),
    ("CASH", "SAQUE|ATM|CAIXA|CASH"),
    ("ENERGIA", r"ENERGIA|ELETRICA|CONTA\s+LUZ"),
    ("TELEFONE", "TELEFONE|CELULAR|CLARO|VIVO|TIM|OPERADORA"),
    ("SEGURO", "SEGURO|INSURANCE"),
    ("BANCO", "BANCO|TARIFA|TAXA|JUROS|FINANCIAMENTO"),
    ("HOTEL", "HOTEL|POUSADA|HOSPEDAGEM|BOOKING"),
    ("DECORACAO", "CASA|DECORACAO|MOVEIS|IKEA|MAGAZINE"),
    ("BELEZA", "SALAO|BELEZA|CABELEIREIRO|ESTETICA"),
    ("PETS", "PET|VETERINARIO|ANIMAL|RACAO"),
]
CATCH_ALL = "OUTROS"
# Words and patterns of payments and credits (a payment has its date, code and amount), of foreign purchases, and of summary rows.
CREDIT = r"PAGAMENTO\s+EFETUADO|ESTORNO|CASHBACK|DEVOLUÇÃO|REEMBOLSO|CREDITO|CREDENCIAMENTO|VOUCHER|BONUS|DESCONTO|CANCELAMENTO|REVERSAO|ANULACAO"
PAYMENT = r"^\d{1,3}/\d{1,2}\s+PAGAMENTO.*?\d{4}\s*[-\t ]+-\s*[\d.,]+\s*$"
PAYMENT_PARTS = r"(?iu)^(\d{2}/\d{2})\s+PAGAMENTO.*?(\d{4})\s*[-\t ]+(-\s*[\d.,]+)\s*$"
FOREIGN = ["USD", "EUR", "GBP", "PAYPAL", "AMAZON", "NETFLIX", "SPOTIFY", "INTERNACIONAL", "FOREIGN"]
SUMMARY = ["total", "saldo", "encargos", "iof", "juros", "lançamentos atuais"]
FX_ROW = rf"^\d{{2}}/\d{{2}}\s+.+?\s+{MONEY}\s+{MONEY}$"


def first_match(text: Column, rules: Sequence[tuple[str, str]], default: str) -> Column:
    """Name of the first rule whose pattern is in the text."""
    out = F.lit(default)
    for name, pattern in reversed(rules):
        out = F.when(text.rlike(pattern), F.lit(name)).otherwise(out)
    return out


def category(description: Column) -> Column:
    return first_match(F.upper(F.coalesce(description, F.lit(""))), CATEGORIES, CATCH_ALL)


def is_payment(text: Column) -> Column:
    return text.rlike(f"(?iu){PAYMENT}") | text.rlike(f"(?iu){CREDIT}")


def kind(text: Column, value: Column) -> Column:
    return F.when(is_payment(text), "PAGAMENTO").when(text.rlike(FX_ROW), "FX").when(value < 0, "COMPRA").otherwise("CREDITO")


def is_foreign(text: Column, words: Sequence[str] = FOREIGN) -> Column:
    return F.upper(text).rlike("|".join(words))


def row_class(text: Column) -> Column:
    """summary, transaction or noise."""
    return F.when(F.lower(text).rlike("|".join(SUMMARY)), "summary").when(text.rlike(r"^\d{2}/\d{2}"), "transaction").otherwise("noise")


def routed(name: Column, rules: Sequence[tuple[str, str]], default: str) -> Column:
    """Target of the first rule that the whole name matches."""
    return first_match(name, [(target, f"^(?:{p})$") for target, p in rules], default)


def band(score: Column) -> Column:
    """accept from .90, review from .70, reject below .50; between them no label."""
    return F.when(score >= 0.9, "accept").when(score >= 0.7, "review").when(score < 0.5, "reject")


def currency(brl: Column, orig: Column) -> Column:
    """BRL without an original amount or if it equals it; USD if the ratio is a dollar rate; else BRL."""
    ratio = F.try_divide(F.abs(brl), F.abs(orig))
    return F.when(orig.isNull() | (orig == 0) | (F.abs(brl - orig) < 0.01), "BRL").when(ratio.between(4.5, 6.5), "USD").otherwise("BRL")


def iof(value: Column, money: Column) -> Column:
    """Tax on the amount: 6.38 % of foreign currencies, else 0.38 %."""
    foreign = ~F.coalesce(money, F.lit("")).isin("", "BRL")
    return F.abs(value) * F.when(foreign, F.lit("0.0638").cast("decimal(6,4)")).otherwise(F.lit("0.0038").cast("decimal(6,4)"))


def classified(text: Column, value: Column) -> Column:
    """Struct of category, kind and the rule's confidence."""
    return F.struct(category(text).alias("category"), kind(text, value).alias("type"), confidence.row(value, text, F.lit(0)).alias("confidence"))


def clamped(score: Column) -> Column:
    """A score held between 0 and 1; null is 0."""
    return F.least(F.greatest(F.coalesce(score, F.lit(0.0)), F.lit(0.0)), F.lit(1.0))


def needs_ocr(score: Column) -> Column:
    """Whether a score is so low that the text should be read again by OCR."""
    return score < 0.6


def in_ensemble(score: Column) -> Column:
    """Whether a score is high enough for an extraction to take part in an ensemble."""
    return score >= 0.8


def highlighted(score: Column, least: float = 0.85) -> Column:
    """Whether a row is shown as unsure to who edits it."""
    return F.coalesce(score < least, F.lit(False))


def document_kind(name: Column, form: str) -> Column:
    """form for names that fit the pattern `form`, else invoice or custom (receipts) by a word in them, else ocr; case and folders don't count."""
    file = F.lower(F.regexp_extract(name, r"([^/]*)$", 1))
    return F.when(file.rlike(f"^(?:{form})$"), "form").when(file.contains("fatura"), "invoice").when(file.contains("receipt"), "custom").otherwise("ocr")
