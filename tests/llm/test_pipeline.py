import hashlib
import re
from collections import Counter, defaultdict

import corpus_pipeline
from tallyloom.llm import toxicity

from .cases import DOCS, documents
from .test_mixing import levels
from .test_quality import brute as judge
from .test_simhash import least_reachable, slow_fingerprint


def test_run_equals_brute_force(spark, tmp_path):
    rows = [r for r in documents(150) if r[0] is not None]
    rows += [(900 + i, rows[10 + i][1] + " scoundrel knave", "en", "s1", 0) for i in range(12)] + [rows[5]]
    labels = [(r[0], 1, int(r[0] >= 900)) for r in rows if r[0] % 2]
    spark.createDataFrame(rows, DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    out = corpus_pipeline.run(spark, f"file://{tmp_path}").collect()

    kept = judge(rows)
    docs = [r for r in rows if kept[r[0]][-1]]
    table = spark.createDataFrame(docs, DOCS)
    known = spark.read.parquet(f"{tmp_path}/labels.parquet").filter(~corpus_pipeline.held_out("doc_id"))
    params = toxicity.learned(toxicity.training_rows(table, known, "doc_id", "text", "toxic"))
    toxic = {r.doc_id for r in toxicity.score(table, params).collect() if r.predicted}
    docs = [r for r in docs if r[0] not in toxic]
    fps = {r[0]: slow_fingerprint(r[1]) for r in docs}
    near = [(a, b) for a in fps for b in fps if a < b and (fps[a] ^ fps[b]).bit_count() <= 4]
    heads = set(least_reachable(fps, near).values())
    docs = list({r[0]: r for r in docs if r[0] in heads}.values())
    by = defaultdict(list)
    for r in docs:
        by[r[3]].append((hashlib.md5(str(r[0]).encode()).hexdigest(), r[0], len(re.findall(r"[^\x20\x09-\x0D]+", r[1]))))
    sums = {s: sum(x[2] for x in v) for s, v in by.items()}
    want, target = Counter(), levels(sums)
    for s, v in by.items():
        at = 0
        for _, i, n in sorted(v):
            want[i] = sum(2 * (int(target[s]) - at - k * sums[s]) >= n for k in (0, 1))
            at += n
    assert Counter(r.doc_id for r in out) == +want and len(want) > 50
    texts = {r[0]: r[1] for r in docs}
    assert all(r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest() for r in out)


def test_stages_keep_columns_and_take_empty_tables(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.createDataFrame([], DOCS)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        found = stage(spark, docs, f"file://{tmp_path}")
        assert found.columns == docs.columns and found.count() == 0


def test_a_repeated_id_costs_no_group_its_document(spark, tmp_path):
    texts = [" ".join(f"{word}{i}" for i in range(80)) for word in ("alpha", "beta", "gamma")]
    rows = [(5, texts[0]), (3, texts[1]), (5, texts[1]), (7, texts[0]), (3, texts[2]), (3, texts[2]), (None, texts[2])]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], DOCS)
    found = corpus_pipeline.dedup_stage(spark, docs, "")
    got = sorted((r.doc_id or 0, texts.index(r.text)) for r in found.collect())
    assert found.columns == docs.columns and got == [(0, 2), (3, 1), (3, 2), (5, 0)]


def test_nulls_in_labels_all_rejected_and_clashing_columns(spark, tmp_path):
    rows = [r for r in documents(60) if r[0] is not None]
    spark.createDataFrame([(None, None, None), (1, None, 1), (2, 1, None)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.createDataFrame([(*r, 1.0, 2) for r in rows], DOCS + ", score double, `a.b` int")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, f"file://{tmp_path}")
        assert docs.columns == corpus_pipeline.COLUMNS and docs.count() > 0
    bad = spark.createDataFrame([(i, "x", "en", "s", 1) for i in range(5)], DOCS)
    kept = corpus_pipeline.quality_stage(spark, bad, f"file://{tmp_path}")
    assert kept.count() == 0
    for _, stage in corpus_pipeline.STAGES[1:]:
        kept = stage(spark, kept, f"file://{tmp_path}")
    assert kept.count() == 0
