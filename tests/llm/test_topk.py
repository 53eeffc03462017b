import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyloom.llm import topk

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows, k):
    held = [(i, [math.floor(64 * float(np.float32(x))) for x in v]) for i, v, _ in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = set()
    for qi, q in held:
        if qi % 20 == 0:
            found = [(-sum(a * b for a, b in zip(q, v)), i) for i, v in held if i != qi and len(v) == len(q)]
            out |= {(qi, n + 1, i, -s) for n, (s, i) in enumerate(sorted(found)[:k])}
    return out


def test_equals_brute_force(spark, monkeypatch):
    rnd = random.Random(1)
    rows = [(i, [rnd.gauss(0, 0.3) for _ in range(16)], 0) for i in range(700)]
    rows += [(1000 + i, rows[0][1], 1) for i in range(60)]
    rows += [(2000, None, 0), (2020, [1.0, None] * 8, 0), (2040, [float("nan")] * 16, 0), (2060, [float("inf")] * 16, 0), (2080, [0.5] * 3, 0), (2081, [0.1] * 3, 0)]
    df = spark.createDataFrame(rows, SCHEMA)
    for sizes in ((8192, 2048), (100, 7)):
        monkeypatch.setattr(topk, "CANDIDATES", sizes[0])
        monkeypatch.setattr(topk, "QUERIES", sizes[1])
        got = topk.top_k(df, F.col("vec_id") % 20 == 0).collect()
        assert set(map(tuple, got)) == brute(rows, 20) and len(got) == len(set(got))
    assert topk.top_k(df.limit(0), F.col("vec_id") % 20 == 0).count() == 0


def by_force(ids, rows, q, k):
    scores = rows.astype(object) @ rows[q].astype(object)
    order = sorted((i for i in range(len(rows)) if ids[i] != ids[q]), key=lambda i: (-scores[i], ids[i]))[:k]
    return [(i, int(scores[i])) for i in order]


def test_bounds_eliminate_and_stay_exact():
    rnd = np.random.default_rng(2)
    for n, dims, centres, spread, share in ((4000, 4, 8, 2, 0.35), (6000, 16, 40, 3, 0.3)):
        rows = np.floor(rnd.normal(0, 60, (centres, dims))[rnd.integers(0, centres, n)] + rnd.normal(0, spread, (n, dims)))
        ids = rnd.permutation(n)
        i, j, s, made = topk.search(ids[:50], rows[:50], ids, rows, topk.choose_pivots(rows[:800], 64), 10)
        for q in range(50):
            assert list(zip(j[i == q], s[i == q])) == by_force(ids, rows, q, 10)
        assert made < share * 50 * n, made / (50 * n)


def test_vectors_without_structure_stay_exact():
    """Bounds rule out nothing here and are given up; what is left is the plain search."""
    rnd = np.random.default_rng(3)
    rows = np.floor(rnd.normal(0, 8, (3000, 64)))
    ids = np.arange(3000)
    i, j, s, made = topk.search(ids[:70], rows[:70], ids, rows, topk.choose_pivots(rows[:500], 32), 20)
    for q in (0, 33, 69):
        assert list(zip(j[i == q], s[i == q])) == by_force(ids, rows, q, 20)
    assert made <= 70 * 3000


def test_large_products_and_ties():
    rnd = np.random.default_rng(4)
    rows = np.concatenate([np.floor(rnd.normal(0, 2.0**27, (300, 5))), np.full((60, 5), 2.0**27)])
    ids = np.arange(360)[::-1].copy()
    i, j, s, _ = topk.search(ids[340:], rows[340:], ids, rows, topk.choose_pivots(rows, 8), 12)
    for q in range(20):
        assert list(zip(j[i == q], s[i == q])) == by_force(ids, rows, 340 + q, 12)
    with pytest.raises(OverflowError):
        topk.search(ids, rows * 2.0**8, ids, rows, rows[:2], 3)


def test_null_ids_repeats_and_clashing_columns(spark):
    rows = [(None, [1.0, 2.0], 1), (20, [1.0, 0.0], 2), (20, [1.0, 0.0], 3), (40, [0.5, 0.5], 4), (41, [1.0, 0.0], 5)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, rank int").withColumn("a.b", F.lit(1)).withColumn("score", F.lit("x"))
    out = topk.top_k(df, F.col("vec_id") % 20 == 0, k=2)
    assert out.columns == ["query_id", "rank", "vec_id", "score"]
    got = sorted(map(tuple, out.collect()))
    assert (40, 1, 20, 2048) in got and (40, 2, 20, 2048) in got and {r[2] for r in got if r[0] == 20} == {40, 41}
