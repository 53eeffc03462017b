import hashlib
import math
import re
from collections import defaultdict

import pytest

from tallyloom.llm import mixing

from .cases import DOCS, documents


def levels(sizes):
    """Targets by the stated rule, round by round."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: mixing.WEIGHTS[i % 3] for i, s in enumerate(names)}
    fixed, demand = {}, mixing.SHARE * sum(sizes.values())
    while True:
        free = [s for s in names if s not in fixed]
        left, total = demand - sum(fixed.values()), sum(weight[s] for s in free)
        over = [s for s in free if left * weight[s] / total > mixing.CAP * sizes[s]]
        if not over:
            return fixed | {s: left * weight[s] / total for s in free}
        fixed |= {s: float(mixing.CAP * sizes[s]) for s in over}


def brute(rows):
    size = {r[0]: len(re.findall(r"[^\x20\x09-\x0D]+", r[1] or "")) for r in rows}
    by = defaultdict(list)
    for r in rows:
        by[r[3]].append(r[0])
    sums = {s: sum(size[i] for i in ids) for s, ids in by.items()}
    target, out = levels(sums), {}
    for s, ids in by.items():
        at = 0
        for i in sorted(ids, key=lambda i: hashlib.md5(str(i).encode()).hexdigest()):
            left = [math.floor(target[s]) - at - k * sums[s] for k in (0, 1)]
            out[i] = size[i], sums[s], target[s], sum(max(0, min(size[i], x)) for x in left)
            at += size[i]
    return out


def test_equals_brute_force(spark):
    rows = documents(200)
    out = mixing.mix(spark.createDataFrame(rows, DOCS)).collect()
    want = brute(rows)
    assert len(out) == len(rows)
    taken, targets = defaultdict(int), {}
    for r in out:
        n, s, t, words = want[r.doc_id]
        assert (r["size"], r.source_size, r.taken) == (n, s, words)
        assert r.target == pytest.approx(t)
        assert r.taken <= 2 * r["size"] and (r.taken > 0) == (r.position is not None)
        assert all(0 <= p <= 1 for p in r.positions) and list(r.positions) == sorted(r.positions)
        taken[r.source] += r.taken
        targets[r.source] = r.target
    assert all(abs(taken[s] - targets[s]) < 1 for s in taken)


def test_demand_follows_the_schedule(spark):
    rows = [(i, "w " * 5, "en", "s", 0) for i in range(4000)]
    out = mixing.mix(spark.createDataFrame(rows, DOCS)).collect()
    places = [p for r in out for p in r.positions]
    (_, m0), (_, m1) = mixing.SCHEDULES[0]
    early = sum(p < 0.5 for p in places) / len(places)
    assert early == pytest.approx((m0 + (m0 + m1) / 2) / 2 * 0.5 / ((m0 + m1) / 2), abs=0.01)


def test_order_and_empty(spark):
    out = mixing.in_order(mixing.mix(spark.createDataFrame(documents(), DOCS)), "doc_id").collect()
    places = [r.position for r in out if r.position is not None]
    assert places == sorted(places)
    assert mixing.mix(spark.createDataFrame([], DOCS)).count() == 0


def test_clashing_and_odd_columns_and_repeated_ids(spark):
    rows = [(i // 2, f"{'w ' * (i % 9)}", ["a", "b"][i % 2], 7.0) for i in range(40)]
    df = spark.createDataFrame(rows, "size long, text string, `so.urce` string, target double")
    out = mixing.mix(df, id_col="size", source_col="so.urce")
    assert len(set(out.columns)) == len(out.columns) and out.count() == 40
    plain = spark.createDataFrame([(r[0], r[1], r[2], 1.0) for r in rows], "doc_id long, text string, source string, taken double")
    again = mixing.mix(plain)
    assert sorted((r.taken, r.target) for r in out.collect()) == sorted((r.taken, r.target) for r in again.collect())
