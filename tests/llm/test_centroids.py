import hashlib
import math
import random

import numpy as np
import pytest

from tallyloom.llm import centroids

VECTORS = "vec_id long, embedding array<float>, label int"


def brute(rows, k=8, rounds=10, size=64, scale=1024):
    """(vec_id, cluster, distance, cluster_inertia, inertia, sha256) by comparing everything in Python's integers."""
    kept = [(i, [math.floor(scale * float(np.float32(x))) for x in v]) for i, v, *_ in rows if v is not None and len(v) == size and all(x is not None and math.isfinite(x) for x in v)]
    digest = lambda text: hashlib.sha256(text.encode()).hexdigest()
    first = sorted(kept, key=lambda r: (r[0] is None, digest(f"3:{r[0]}"), r[1]))[:k]
    c = [list(v) for _, v in first]

    def nearest():
        out = []
        for _, v in kept:
            d = [sum((a - b) ** 2 for a, b in zip(v, m, strict=True)) for m in c]
            out.append((d.index(min(d)), min(d)))
        return out

    for _ in range(rounds):
        own = nearest()
        for m in range(len(c)):
            mine = [v for (_, v), (o, _) in zip(kept, own, strict=True) if o == m]
            if mine:
                c[m] = [sum(x) // len(mine) for x in zip(*mine, strict=True)]
    own = nearest()
    by = [sum(d for o, d in own if o == m) for m in range(len(c))]
    return sorted([(i, o, d, by[o], sum(by), digest(",".join(map(str, c[o])))) for (i, _), (o, d) in zip(kept, own, strict=True)], key=str)


def check(spark, rows, **how):
    out = centroids.clusters(spark.createDataFrame(rows, VECTORS), **how).collect()
    assert sorted([tuple(r) for r in out], key=str) == brute(rows, **{k: v for k, v in how.items() if k != "watch"})


def blobs(n, size=64, groups=12, seed=2, near=0.1):
    r = np.random.default_rng(seed)
    middle = r.normal(size=(groups, size))
    return [(i, (middle[i % groups] + near * r.normal(size=size)).astype(np.float32).tolist(), 0) for i in range(n)]


def test_equals_brute_force_and_skips(spark):
    made = []
    check(spark, blobs(600), watch=made.append)
    assert made[0] == 600 * 8 and len(made) == 11
    assert max(made[4:]) < 0.5 * made[0]  # bounds skip most of a later round


def test_ties_copies_and_few_vectors(spark):
    rnd = random.Random(4)
    grid = [(i, [float(rnd.randint(-1, 1)) for _ in range(4)], 0) for i in range(300)]
    check(spark, grid, size=4, scale=1)
    check(spark, grid, size=4, scale=1, k=3, rounds=2)
    check(spark, grid[:5], size=4)
    check(spark, [(i, [1.0, 2.0], 0) for i in range(50)] + [(i, [1.0, 2.5], 0) for i in range(3)], size=2)


def test_awkward_rows(spark):
    rows = blobs(90, 4) + [(100, None, 1), (101, [], 1), (102, [1.0], 1), (103, [1.0, None, 2.0, 3.0], 1), (104, [1.0, float("nan"), 2.0, 3.0], 1)]
    rows += [(105, [float("inf"), 0.0, 0.0, 0.0], 1), (None, [0.5, 0.5, 0.5, 0.5], 1), (None, [0.25] * 4, None), (3, [9.0] * 4, 1), (3, [-9.0] * 4, 1), (3, [9.0] * 4, 1)]
    check(spark, rows, size=4)
    assert centroids.clusters(spark.createDataFrame([], VECTORS)).count() == 0
    assert centroids.clusters(spark.createDataFrame(rows[90:95], VECTORS)).count() == 0
    df = spark.createDataFrame([(1, [1.0, 2.0], 7, 8)], "`v.id` long, `own` array<double>, x int, id int")
    assert [tuple(r)[:3] for r in centroids.clusters(df, "v.id", "own", size=2).collect()] == [(1, 0, 0)]
    with pytest.raises(Exception, match="2\\^27"):
        centroids.clusters(spark.createDataFrame([(1, [3e30] * 4, 0)], VECTORS), size=4).collect()


def test_bounds_hold_after_moves():
    r = np.random.default_rng(8)
    x, c = r.integers(-400, 400, (2000, 16)), r.integers(-400, 400, (9, 16))
    own, upper, lower, _ = centroids.assign(x, None, None, None, c, None)
    for n in range(12):
        new = c + r.integers(-30, 30, c.shape) // (1 + n)
        own, upper, lower, made = centroids.assign(x, own, upper, lower, new, np.sqrt(((new - c) ** 2).sum(axis=1)))
        d, c = centroids.squares(x, new), new
        assert (own == d.argmin(axis=1)).all()
        assert (upper.astype(float) ** 2 >= d[np.arange(len(x)), own] * (1 - 1e-12)).all() and (lower.astype(float) ** 2 <= d * (1 + 1e-12)).all()


def test_large_components_stay_exact():
    x, c = np.array([[2**27 - 1, 1 - 2**27]] * 2), np.array([[1 - 2**27, 2**27 - 1], [2**27 - 1, 2 - 2**27]])
    assert centroids.squares(x, c).tolist() == [[2 * (2**28 - 2) ** 2, 1]] * 2
