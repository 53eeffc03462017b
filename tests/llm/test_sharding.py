import random
import zlib
from collections import defaultdict

import pytest

from tallyloom.llm import sharding

from .cases import DOCS, documents

DIMS = ("size", "n_chars", "text_crc32")


def shards(spark, rows, leaves):
    out = sharding.kd_shards(sharding.text_points(spark.createDataFrame(rows, DOCS)), DIMS, leaves).collect()
    assert len(out) == len(rows)
    by = defaultdict(list)
    for r in out:
        by[r.shard].append(r)
    for k, rs in by.items():
        assert sorted(r.slot for r in rs) == list(range(len(rs)))
        assert 0 <= k < leaves
    return out, by


def test_near_equal_sizes_and_whole_groups(spark):
    rnd = random.Random(1)
    rows = [(i, "ab é " * rnd.randint(0, 60), "en", "s", 0) for i in range(3000)]
    rows += [(10_000 + i, "copy " * 30, "en", "s", 0) for i in range(1500)]
    out, by = shards(spark, rows, 10)
    sizes = [sum(r.size for r in rs) for rs in by.values()]
    assert len(sizes) == 10 and max(sizes) - min(sizes) < 0.05 * sum(sizes) / 10
    texts = {i: t for i, t, *_ in rows}
    for r in out:
        assert r.size == len(texts[r.id].encode()) + 16 and r.text_crc32 == zlib.crc32(texts[r.id].encode())


def test_awkward_rows(spark):
    rows = documents() + [(None, "no id", "en", "s", 0), (1, "twice", "en", "s", 0), (1, "twice", "en", "s", 0)]
    shards(spark, rows, 7)
    out, _ = shards(spark, rows[:3], 40)
    assert len({r.shard for r in out}) == 3
    assert sharding.kd_shards(sharding.text_points(spark.createDataFrame([], DOCS)), DIMS, 4).count() == 0


def test_target_bytes_and_equal_coordinates(spark):
    rows = [(i, "same", "en", "s", 0) for i in range(1000)]
    points = sharding.text_points(spark.createDataFrame(rows, DOCS))
    found = sharding.kd_shards(points, DIMS, target_bytes=2000).groupBy("shard").count().collect()
    assert len(found) == 10 and {r["count"] for r in found} == {100}


def walk(cuts, done, row):
    """The shard that a row comes to, from the root."""
    node = 1
    while node in cuts:
        dim, value, at = cuts[node]
        x = row[dim]
        node = 2 * node + (x > value if at is None else (x, row["id"]) > (value, at))
    return done[node]


@pytest.mark.parametrize(("few", "bins"), [(256, 1 << 13), (0, 64)])
def test_every_cut_is_as_good_as_any(spark, monkeypatch, few, bins):
    """Each cut lies along the widest dimension, and no other value (or value and id) parts the bytes better, but for the tolerance."""
    monkeypatch.setattr(sharding, "FEW", few)
    monkeypatch.setattr(sharding, "BINS", bins)
    monkeypatch.setattr(sharding, "LEAST_BINS", min(bins, 512))
    rnd = random.Random(3)
    rows = [(i, "x " * rnd.choice([1, 5, 5, 5, 40, rnd.randint(0, 300)]), "en", "s", 0) for i in range(900)]
    points = sharding.text_points(spark.createDataFrame(rows, DOCS))
    held = [r.asDict() for r in points.collect()]
    for leaves in (9,):
        _, cuts, shard_of, n = sharding.kd_tree(points, DIMS, leaves)
        cuts, done = {r.node: (DIMS[r.dim], r.cut, r["at"]) for r in cuts.collect()}, {r.node: r.shard for r in shard_of.collect()}
        assert n == leaves and sorted(done.values()) == list(range(leaves))
        span = {d: max(1, max(r[d] for r in held) - min(r[d] for r in held)) for d in DIMS}

        def check(node, rs, k):
            if k == 1:
                return
            dim, value, at = cuts[node]
            wide = {d: (max(r[d] for r in rs) - min(r[d] for r in rs)) / span[d] for d in DIMS}
            assert wide[dim] == max(wide.values())
            total = sum(r["size"] for r in rs)
            goal, leaf = total * (k // 2) / k, total / k
            under = lambda test: sum(r["size"] for r in rs if test(r))
            off = lambda test: abs(under(test) - goal)
            whole = min(off(lambda r, v=v: r[dim] <= v) for v in {r[dim] for r in rs})
            if at is None:
                mine = off(lambda r: r[dim] <= value)
                assert mine <= max(whole, sharding.TOLERANCE * leaf) + 1e-6 and (mine <= sharding.KEEP * leaf + 1e-6 or len({r[dim] for r in rs}) == 1 or mine <= whole + 1e-6)
                below = [r for r in rs if r[dim] <= value]
            else:
                assert whole > sharding.KEEP * leaf
                mine = off(lambda r: (r[dim], r["id"]) <= (value, at))
                parted = min(off(lambda r, i=i: (r[dim], r["id"]) <= (value, i)) for i in {r["id"] for r in rs})
                assert mine <= max(parted, sharding.TOLERANCE * leaf) + 1e-6
                below = [r for r in rs if (r[dim], r["id"]) <= (value, at)]
            above = [r for r in rs if r not in below]
            check(2 * node, below, k // 2)
            check(2 * node + 1, above, k - k // 2)

        check(1, held, leaves)
        out = {r.id: r.shard for r in sharding.kd_shards(points, DIMS, leaves).collect()}
        assert out == {r["id"]: walk(cuts, done, r) for r in held}


def test_clashing_columns(spark):
    df = spark.createDataFrame([(i, "a b " * (i % 7), 3, "x") for i in range(60)], "doc_id long, text string, shard int, slot string").withColumnRenamed("slot", "a.b")
    out = sharding.kd_shards(sharding.text_points(df), DIMS, 4)
    assert out.columns == ["id", "size", "text_crc32", "n_chars", "shard", "slot"] and out.count() == 60 and {r.shard for r in out.collect()} == {0, 1, 2, 3}
