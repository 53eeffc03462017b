import random
import re

import numpy as np
import pyarrow as pa
import pytest
import xxhash

from tallyloom.llm import graph, simhash

from .cases import DOCS, documents


def slow_fingerprint(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def least_reachable(nodes, links):
    up = {n: n for n in nodes}

    def top(n):
        while up[n] != n:
            up[n] = up[up[n]]
            n = up[n]
        return n

    for a, b in links:
        a, b = top(a), top(b)
        up[max(a, b)] = min(a, b)
    return {n: top(n) for n in nodes}


def test_documents_equal_brute_force(spark):
    rows = documents(120)
    base = rows[3][1] + " " + rows[4][1] + " " + rows[7][1]
    rows += [(500 + i, base + f" tail{i}", "en", "s", 0) for i in range(25)]
    out = simhash.near_duplicates(spark.createDataFrame(rows, DOCS)).collect()
    fps = {i: slow_fingerprint(t) for i, t, *_ in rows}
    assert {r.doc_id: r.fp % 2**64 for r in out} == fps
    near = [(a, b) for a in fps for b in fps if a < b and (fps[a] ^ fps[b]).bit_count() <= 4]
    assert {r.doc_id: r.component_id for r in out} == least_reachable(fps, near)
    assert len(out) == len(rows)


def test_chains_of_fingerprints(spark):
    rnd, fps = random.Random(3), [0, 2**64 - 1]
    for _ in range(60):
        f = rnd.getrandbits(64)
        for _ in range(rnd.randint(1, 12)):
            fps.append(f)
            for _ in range(rnd.randint(0, 6)):
                f ^= 1 << rnd.randrange(64)
    fps = sorted(set(fps))
    signed = [f - 2**64 if f >= 2**63 else f for f in fps]
    df = spark.createDataFrame([(f,) for f in signed], "fp long")
    got = {r.node: r.component for r in graph.components(simhash.fingerprint_links(df)).collect()}
    near = [(a, b) for a in signed for b in signed if a < b and ((a ^ b) % 2**64).bit_count() <= 4]
    want = least_reachable(signed, near)
    assert {f: got.get(f, f) for f in signed} == want


def test_more_buckets_do_not_change_links(spark, monkeypatch):
    rnd = random.Random(4)
    base = [rnd.getrandbits(63) for _ in range(50)]
    df = spark.createDataFrame([(b ^ (1 << i),) for b in base for i in range(3)], "fp long")
    one = {r.node: r.component for r in graph.components(simhash.fingerprint_links(df)).collect()}
    monkeypatch.setattr(simhash, "BUCKET", 4)
    monkeypatch.setattr(simhash, "CHUNK", 7)
    assert {r.node: r.component for r in graph.components(simhash.fingerprint_links(df)).collect()} == one and len(one) == 150


def test_empty(spark):
    assert simhash.near_duplicates(spark.createDataFrame([], DOCS)).count() == 0


def test_long_chain_components(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(300)] + [(5, 5), (400, 399)], "a long, b long")
    got = {r.node: r.component for r in graph.components(links).collect()}
    assert got == {i: 0 for i in range(301)} | {399: 399, 400: 399}


def test_radius_six_keeps_its_links():
    rnd, ball, found = random.Random(9), simhash.masks(3), set()
    one = rnd.getrandbits(64)
    fps = np.array([one, one ^ sum(1 << b for b in rnd.sample(range(64), 6)), rnd.getrandbits(64)], dtype=np.uint64)
    batch = pa.RecordBatch.from_arrays([pa.array(fps.view(np.int64))], names=["fp"])
    with np.errstate(over="ignore"):
        for n in range(simhash.ROUNDS):
            for out in simhash._emit(16, n, 3)([batch]):
                for bucket, blob in zip(*(c.to_pylist() for c in out.columns), strict=True):
                    if len(blob) > 8:
                        found |= {tuple(x) for x in simhash._collisions(bucket, [blob], 16, ball, 6).tolist()}
    assert found == {tuple(sorted(fps[:2].tolist()))}


def test_odd_radii_are_refused():
    with pytest.raises(ValueError, match="radius 5"):
        simhash.fingerprint_links(None, 5)


def test_clashing_and_odd_column_names(spark):
    rows = [(1, "a b c d e f", 0.5), (2, "a b c d e f", 0.25), (3, None, 0.0)]
    out = simhash.near_duplicates(spark.createDataFrame(rows, "`d.id` long, text string, fp double"), "d.id")
    assert sorted((r["d.id"], r.component_id) for r in out.collect()) == [(1, 1), (2, 1), (3, 3)]
    found = simhash.fingerprints(spark.createDataFrame(rows, "`d.id` long, `te.xt` string, fp double"), "te.xt")
    assert found.columns == ["d.id", "fp"] and dict(found.dtypes)["fp"] == "bigint"
