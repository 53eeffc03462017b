import random
from collections import defaultdict

from tallyloom.llm import chat

SCHEMA = "conv_id long, turn int, role string, text string, extra int"


def brute(rows):
    by = defaultdict(list)
    for c, t, s, x, _ in rows:
        by[c].append((t, s or "unknown", x or ""))
    out = []
    for c, turns in by.items():
        turns.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
        for p in {s for _, s, _ in turns if s != "system"}:
            at = 0
            for t, s, x in turns:
                role = s if s == "system" else "assistant" if s == p else "user"
                head = f"<|im_start|>{role}" + (f" name={s}" if role == "user" else "") + "\n"
                seg = head + x + "<|im_end|>\n"
                out.append((c, p, t, s, role, seg, int(role == "assistant"), at, at + len(seg), at + len(head), at + len(head) + len(x)))
                at += len(seg)
    return sorted(out, key=repr)


def test_equals_brute_force(spark):
    rnd = random.Random(1)
    rows = [(c, t, rnd.choice(["ann", "bo", "cy", "system", None, ""]), rnd.choice(["hi", "", None, "é😀\n"]), 1) for c in range(20) for t in range(rnd.randint(1, 9))]
    rows += [(99, i, "ann" if i % 2 else "bo", f"long {i}", 0) for i in range(1200)] + [(7, 0, "ann", "hi", 1)] * 2
    rows += [(None, None, "ann", "x", 0), (None, 3, "bo", "y", 0), (50, 0, "system", "alone", 0)]
    df = spark.createDataFrame(rows, SCHEMA)
    for block in (256, 3):
        assert sorted(map(tuple, chat.rotated(df, block=block).collect()), key=repr) == brute(rows)


def test_dialogues_and_empty(spark):
    df = spark.createDataFrame([(1, 0, "a", "x", 0), (1, 1, "b", "yy", 0)], SCHEMA)
    for r in chat.dialogues(chat.rotated(df)).collect():
        assert [r.text[a:b] for a, b in r.spans] == [{"a": "x", "b": "yy"}[r.perspective]]
    assert chat.rotated(df.limit(0)).count() == 0


def test_very_long_texts_and_repeated_turns(spark):
    long = "word " * 200_000
    rows = [(1, 0, "user", long), (1, 1, "assistant", "b"), (1, 1, "assistant", "b"), (2, None, None, None)]
    out = chat.rotated(spark.createDataFrame(rows, "conv_id long, turn int, role string, text string")).collect()
    assert any(r.text and long in r.text for r in out if "text" in r.asDict()) or any(long in str(v) for r in out for v in r.asDict().values())
