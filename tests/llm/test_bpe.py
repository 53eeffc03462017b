import base64
import hashlib
import random

import public_tokenizers as P
import pytest
import tiktoken

from tallyloom.llm import bpe

from .cases import DOCS, documents

PATH = P.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def peer():
    with open(PATH, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def digest(ids, text):
    return len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest()


def test_digest_equals_tiktoken(spark, peer):
    rows = documents()
    out = bpe.bpe_digest(spark.createDataFrame(rows, DOCS), PATH, P.PATTERN).collect()
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in out}
    assert got == {i: digest(peer.encode_ordinary(t or ""), t or "") for i, t, *_ in rows}


def test_odd_white_space_and_special_strings(peer):
    codec, rnd = bpe.codec(PATH, P.PATTERN), random.Random(2)
    odd = "aA  \n\t\x0b　 é漢1٣²​\x85_-'stre!.\U0001f600"
    for _ in range(3000):
        text = "".join(rnd.choice(odd) for _ in range(rnd.randint(0, 30)))
        assert codec.digest(text) == digest(peer.encode_ordinary(text), text)
    assert codec.encode("<|endoftext|>") == peer.encode_ordinary("<|endoftext|>")


def test_round_trip_and_offsets(spark):
    rows = documents()
    encoded = bpe.bpe_encode(spark.createDataFrame(rows, DOCS), PATH, P.PATTERN)
    out = bpe.bpe_decode(encoded, PATH, P.PATTERN).collect()
    for r in out:
        text = r.text or ""
        assert r.decoded.decode() == text
        assert len(r.ids) == len(r.offsets)
        assert not text or (r.offsets[0].start == 0 and r.offsets[-1].end == len(text))
        assert all(a.end in (b.start, b.start + 1) for a, b in zip(r.offsets, r.offsets[1:]))  # +1: a split character


def test_empty_table_and_clashing_columns(spark):
    empty = spark.createDataFrame([], DOCS)
    assert bpe.bpe_digest(empty, PATH, P.PATTERN).count() == 0
    clash = spark.createDataFrame([(1, "a b", "old", "keep")], "doc_id long, text string, n_tokens string, more string")
    row = bpe.bpe_digest(clash, PATH, P.PATTERN).first()
    assert (row.n_tokens, row.more) == (2, "keep")


def test_odd_column_names(spark):
    row = bpe.bpe_digest(spark.createDataFrame([(1, "a b", 2.0)], "`a.b` long, `te.xt` string, r0 double"), PATH, P.PATTERN, "te.xt").first()
    assert (row["a.b"], row["te.xt"], row.r0, row.n_tokens) == (1, "a b", 2.0, 2)
