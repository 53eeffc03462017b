import random

import numpy as np

from tallyloom.llm import gru, toxicity

from .cases import DOCS, documents


def test_gradients_are_those_of_the_loss():
    net, rnd = gru.Net(2, np.float64), np.random.default_rng(0)
    own, grams, starts = gru.hashed(["ab", "cde", "fghij", "é"])
    ids = np.array([[1, 2, 3, 4, 0], [4, 4, 1, 0, 0], [2, 3, 2, 3, 1]])
    args = own, grams, starts, ids, np.array([1.0, 0.0, 1.0]), np.array([1.0, 2.0, 0.5]), np.array([1.0, 0.0, 1.0, 1.0])
    _, grad, rows = net.gradients(*args)
    for k, (at, g) in rows.items():
        grad[k] = np.zeros_like(net.p[k])
        np.add.at(grad[k], at, g)
    for k, g in grad.items():
        places = np.argsort(-np.abs(g.ravel()))[:4]
        for i in places:
            was = net.p[k].ravel()[i]
            net.p[k].ravel()[i] = was + 1e-5
            up = net.gradients(*args)[0]
            net.p[k].ravel()[i] = was - 1e-5
            down = net.gradients(*args)[0]
            net.p[k].ravel()[i] = was
            assert abs((up - down) / 2e-5 - g.ravel()[i]) < 1e-5 * max(1, abs(g.ravel()[i])), k


def test_windows_cover_every_token():
    for n in (0, 1, 31, 39, 40, 41, 72, 73, 500):
        cut = gru.windows(np.arange(1, n + 1), 40, 32)
        assert set(cut.ravel()) - {0} == set(range(1, n + 1)) and cut.shape[1] == 40
        assert n <= 40 or (cut[-1] > 8).any() or len(cut) == 1


def corpus(n, seed):
    rnd = random.Random(seed)
    plain, bad = [f"w{rnd.randrange(10**6):x}" for _ in range(300)], ["scoundrel", "wretchling", "wretchful", "knave"]
    out = []
    for i in range(n):
        words = [rnd.choice(plain) for _ in range(rnd.randint(5, 200))]
        if i % 4 == 0:
            for _ in range(1 + len(words) // 60):
                words[rnd.randrange(len(words))] = rnd.choice(bad) + rnd.choice(["", ".", ","])
        out.append((i, " ".join(words), int(i % 4 == 0)))
    return out


def test_held_out_accuracy_and_whole_texts(spark):
    rows = corpus(500, 1)
    df = spark.createDataFrame([r for r in rows], "doc_id long, text string, toxic int")
    known = df.filter("doc_id < 400")
    params = toxicity.learned(toxicity.training_rows(df, known, "doc_id", "text", "toxic"))
    far = [(1000, "w " * 3000 + "knave", 1), (1001, "w " * 3000, 0)]
    more = spark.createDataFrame([r for r in rows if r[0] >= 400] + far, df.schema)
    out = toxicity.score(more, params).collect()
    assert np.mean([r.predicted == r.toxic for r in out]) > 0.95
    assert {r.doc_id: r.predicted for r in out if r.doc_id >= 1000} == {1000: 1, 1001: 0}
    again = toxicity.score(more.repartition(3), params).collect()
    assert {r.doc_id: round(r.score, 5) for r in again} == {r.doc_id: round(r.score, 5) for r in out}


def test_awkward_texts_and_no_labels(spark):
    docs = spark.createDataFrame(documents(), DOCS)
    params = toxicity.train([(t, y) for _, t, y in corpus(40, 2)])
    out = toxicity.score(docs, params).collect()
    assert len(out) == docs.count() and all(0 <= r.score <= 1 for r in out)
    labels = spark.createDataFrame([(1, None), (2, 1)], "doc_id long, toxic int")
    assert toxicity.learned(toxicity.training_rows(docs, labels, "doc_id", "text", "toxic")) is None
    assert {r.score for r in toxicity.score(docs, None).collect()} == {0.0}
    assert toxicity.score(docs.limit(0), params).count() == 0


def test_pieces_hold_every_ngram():
    rnd = random.Random(3)
    assert gru.tokens_of("A.b  " + "x" * 120) == ["a.b", "x" * 120]
    for n in (121, 146, 147, 500, 5000):
        for letters in ("abc.,-", "毒有害的內容.", "é\u200b_x"):
            word = "".join(rnd.choice(letters) for _ in range(n - 1)) + "z"
            cut = gru.tokens_of(word)
            assert len(cut) > 1 and max(len(p.encode()) for p in cut) <= gru.LONG + 2
            whole = gru.hashed([word])[1]
            assert set(whole) <= set(gru.hashed(cut)[1])


def test_long_tokens_are_scored_whole():
    rnd, plain = random.Random(4), [chr(c) for c in range(0x4E00, 0x4E20)]
    run = lambda n: "".join(rnd.choice(plain) for _ in range(n))
    rows = [(run(200) + ("毒藥害人" if i % 2 else "") + run(200), i % 2) for i in range(240)]
    score = toxicity.Scorer(toxicity.train(rows[:200])).scores([text for text, _ in rows[200:]])
    assert np.mean((score >= 0.5) == np.array([y for _, y in rows[200:]])) > 0.9


def test_order_of_words_matters(monkeypatch):
    """"not knave" is clean and "knave not" toxic: only the recurrence can tell."""
    rnd = random.Random(5)
    words = [f"w{i}" for i in range(50)]
    rows = []
    for i in range(900):
        said = ["knave", "not"] if i % 2 else ["not", "knave"]
        head = [rnd.choice(words) for _ in range(rnd.randint(2, 12))]
        rows.append((" ".join([*head, *said, *[rnd.choice(words) for _ in range(rnd.randint(2, 12))]]), i % 2))
    params = toxicity.train(rows[:700])
    right = lambda p: np.mean((toxicity.Scorer(p).scores([t for t, _ in rows[700:]]) >= 0.5) == np.array([y for _, y in rows[700:]]))
    assert right(params) > 0.95
    run = gru.Net._run
    monkeypatch.setattr(gru.Net, "_run", staticmethod(lambda xp, u, keep: (np.concatenate([run(x[None], u, False)[0] for x in xp]), [])))
    assert right(params) < 0.75  # every token read alone


def test_clashing_and_odd_column_names(spark):
    docs = spark.createDataFrame([("knave knave", 1, 2.0, None), (None, 2, 3.0, "x")], "score string, `a.b` int, predicted double, c0 string")
    params = toxicity.train([(t, y) for _, t, y in corpus(60, 3)])
    out = toxicity.score(docs, params, "score")
    assert out.columns == ["a.b", "c0", "score", "predicted"] and dict(out.dtypes)["score"] == "double"
    assert sorted((r["a.b"], r["c0"]) for r in out.collect()) == [(1, None), (2, "x")]
