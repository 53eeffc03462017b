import math
from fractions import Fraction

import numpy as np
import pytest

from tallyloom.llm import whitening

VECTORS = "vec_id long, embedding array<float>, label int"


def brute(rows, size):
    """x as Python integers, exact deviations and trace, and numpy's eigenvectors of the exactly centred covariance."""
    kept = [(i, [math.floor(1024 * float(np.float32(c))) + 100_000 for c in v]) for i, v, *_ in rows if v is not None and len(v) == size and all(c is not None and math.isfinite(c) for c in v)]
    n, s = len(kept), [sum(x) for x in zip(*[v for _, v in kept], strict=True)]
    far = [[n * a - b for a, b in zip(v, s, strict=True)] for _, v in kept]
    deviations = [sum(a * a for a in f) for f in far]
    trace = float(Fraction(sum(deviations), n**3))
    y = np.array(far, dtype=float) / n
    e, v = np.linalg.eigh(y.T @ y / n)
    return [i for i, _ in kept], n, deviations, trace, y, e[::-1], v[:, ::-1]


def check(spark, rows, dims, most=8, least=None, **how):
    out = whitening.by_component(whitening.whiten(spark.createDataFrame(rows, VECTORS), most=most, **how)).collect()
    ids, n, deviations, trace, y, e, v = brute(rows, dims)
    k = least or min(most, dims)
    assert len(out) == len(ids) * k and {r.component for r in out} == set(range(1, k + 1)) and {r.n for r in out} == {n}
    assert sorted((r.id, int(r.deviation)) for r in out if r.component == 1) == sorted(zip(ids, deviations, strict=True))
    for c in range(1, k + 1):
        mine = {(r.id, int(r.deviation)): r for r in out if r.component == c}
        want = dict(zip(zip(ids, deviations, strict=True), y @ v[:, c - 1] / math.sqrt(e[c - 1]), strict=True))
        sign = np.sign(sum(mine[i].whitened * w for i, w in want.items()))
        assert max(abs(sign * mine[i].whitened - w) for i, w in want.items()) < 1e-7
        assert all(abs(r.explained - e[c - 1] / trace) < 1e-9 for r in mine.values())
    w = np.array([[r.whitened for r in sorted((x for x in out if x.component == c), key=lambda r: (r.id, r.deviation))] for c in range(1, k + 1)])
    error = np.abs(np.cov(w, bias=True) - np.eye(k)).max()
    assert all(abs(r.identity_error - error) < 1e-9 and r.identity_error < 1e-4 for r in out)
    return out


def rows_of(n, size, seed=1):
    r = np.random.default_rng(seed)
    mix = r.normal(size=(size, size)) * np.linspace(1, 0.2, size)[:, None]
    return [(i, (r.normal(size=size) @ mix / 8 + 0.3).astype(np.float32).tolist(), 0) for i in range(n)]


def test_equals_numpy(spark):
    check(spark, rows_of(400, 64), 64)


def test_awkward_rows_and_few_dimensions(spark):
    rows = rows_of(120, 5) + [(200, None, 1), (201, [], 1), (202, [1.0, None, 0.0, 0.0, 0.0], 1), (203, [float("nan")] * 5, 1), (204, [float("-inf")] * 5, 1), (205, [1.0, 2.0], 1)]
    check(spark, rows, 5)
    check(spark, rows, 5, most=2, size=5)
    check(spark, rows_of(60, 4) + [(500, [5.0, -5.0, 4.0, 4.0], 0)] * 3, 4)


def test_no_variance_and_empty(spark):
    flat = [(i, [1.0, 2.0, 3.0], 0) for i in range(10)]
    assert whitening.whiten(spark.createDataFrame(flat, VECTORS)).count() == 0
    assert whitening.whiten(spark.createDataFrame(flat[:1], VECTORS)).count() == 0
    assert whitening.whiten(spark.createDataFrame([], VECTORS)).count() == 0
    assert whitening.whiten(spark.createDataFrame([(1, None, 0), (2, [], 0)], VECTORS)).count() == 0
    line = [(i, [i / 8, i / 4, 1.0], 0) for i in range(20)]
    check(spark, line, 3, least=1)


def test_large_counts_and_clashing_names(spark):
    y = whitening.centred(np.array([[2**39, 5]]), 2**30, [7, 2**60])
    assert y.tolist() == [[2**69 - 7, 5 * 2**30 - 2**60]]
    assert whitening.deviations(y) == [(2**69 - 7) ** 2 + (5 * 2**30 - 2**60) ** 2]
    df = spark.createDataFrame([(i, [float(i % 7), float(i % 5)], "a", 1) for i in range(40)], "`v.id` long, x array<double>, id string, n int")
    assert whitening.whiten(df, "v.id", "x").count() == 40
    with pytest.raises(Exception, match="2\\^40"):
        whitening.whiten(spark.createDataFrame([(1, [3e30] * 4, 0)], VECTORS)).collect()
