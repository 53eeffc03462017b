"""Confidence algebra."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Calibration factors and merge weights of extractors, cost of a page.
FACTORS = {"camelot": 0.9, "pdfplumber": 0.85}
WEIGHTS = {"textract": 1.0, "azure": 0.95, "pdfplumber": 0.9, "camelot": 0.85, "google": 0.9}
PAGE_COST = {"textract": 0.0015, "azure": 0.0015, "google": 0.001}


def _look_up(name: Column, table: dict[str, float], default: float) -> Column:
    out = F.lit(float(default))
    for k, v in table.items():
        out = F.when(name == k, F.lit(float(v))).otherwise(out)
    return out


def row(value: Column, description: Column, fields: Column, *flags: Column) -> Column:
    """.5, and for an amount, a description, parsed fields and flags; at most 1."""
    score = F.lit(0.5) + F.when(value != 0, 0.2).otherwise(0.0) + F.when(F.length(description) > 5, 0.2).otherwise(0.0) + F.least(fields * 0.02, F.lit(0.1))
    for f in flags:
        score = score + F.when(f, 0.05).otherwise(0.0)
    return F.least(score, F.lit(1.0))


def transaction(has_date: Column, has_amount: Column, quality: Column, matched: Column, ocr: Column) -> Column:
    part = lambda c, w: F.when(c, w).otherwise(0.0)
    return part(has_date, 0.25) + part(has_amount, 0.35) + 0.2 * quality + part(matched, 0.1) + 0.1 * ocr


def extraction(found: Column, expected: Column, matches: Column, ocr: Column | None = None) -> Column:
    recovery = F.least(found / F.greatest(expected, F.lit(1)), F.lit(1.0))
    quality = F.when(found > 0, matches / F.greatest(found, F.lit(1))).otherwise(0.0)
    if ocr is None:
        return F.least(0.6 * recovery + 0.4 * quality, F.lit(1.0))
    return F.least(0.4 * recovery + 0.3 * quality + 0.3 * ocr, F.lit(1.0))


def calibrated(score: Column, extractor: Column) -> Column:
    return F.least(score * _look_up(extractor, FACTORS, 1.0), F.lit(1.0))


def weight(extractor: Column) -> Column:
    return _look_up(extractor, WEIGHTS, 0.8)


def cost(method: Column, pages: Column) -> Column:
    return pages * _look_up(method, PAGE_COST, 0.0)


def merged(scores: Column, how: str = "weighted") -> Column:
    """One score of an array: weighted by the squares, min, max or average; 0 if empty."""
    add = lambda f: F.aggregate(scores, F.lit(0.0), lambda a, x: a + f(x))
    ways = {
        "weighted": lambda: F.try_divide(add(lambda x: x * x * x), add(lambda x: x * x)),
        "min": lambda: F.array_min(scores),
        "max": lambda: F.array_max(scores),
        "average": lambda: F.try_divide(add(lambda x: x), F.size(scores)),
    }
    if how not in ways:
        raise ValueError(f"no way {how}")
    return F.coalesce(ways[how](), F.lit(0.0))


def grade(score: Column) -> Column:
    """A+ from .90, A from .85, B+ from .80, then B, C+, C and D in steps of a tenth, else F."""
    out = F.lit("F")
    for least, name in ((0.4, "D"), (0.5, "C"), (0.6, "C+"), (0.7, "B"), (0.8, "B+"), (0.85, "A"), (0.9, "A+")):
        out = F.when(score >= least, name).otherwise(out)
    return out


def speed(seconds: Column) -> Column:
    return F.when(seconds < 1, "A+").when(seconds < 3, "A").when(seconds < 10, "B").when(seconds < 30, "C").otherwise("D")


#: The confidence of a result by the way it was made, where it has none of its own.
ENVELOPES = {"simple": 0.5, "pipeline": 0.7, "docai": 0.8, "error": 0.0}


def envelope(method: str, own: Column) -> Column:
    """Confidence of a result by its method; a pipeline's own wins."""
    return F.coalesce(own, F.lit(ENVELOPES[method])) if method == "pipeline" else F.lit(ENVELOPES[method])
