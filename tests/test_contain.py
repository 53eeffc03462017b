import random

import pytest
from pyspark.sql import functions as F

from tallyloom.operators import contain, enrich


def texts(seed, n, longest):
    r = random.Random(seed)
    return sorted({(f"d{r.randint(0, 3)}", "".join(r.choice("abç ") for _ in range(r.randint(0, longest)))) for _ in range(n)})


@pytest.mark.parametrize("part,share", [(1_000_000, 8_000_000), (20, 60)])
def test_holders_and_held_equal_all_pairs(spark, part, share):
    """Also where a document's texts are cut into many parts and shares; one document has the empty text."""
    whole, known = texts(1, 90, 14), [x for x in texts(2, 50, 4) if x[1] or x[0] == "d1"]
    df = lambda x: spark.createDataFrame(x, "doc_id string, text string")
    pairs = [(w, k) for w in whole for k in known if w[0] == k[0] and k[1] in w[1]]
    got = contain.holders(df(whole), df(known), part=part, share=share).collect()
    assert len(got) == len({w for w, _ in pairs}) and {tuple(r) for r in got} == {w for w, _ in pairs}
    got = contain.held(df(whole), df(known), part=part, share=share).collect()
    assert len(got) == len({k for _, k in pairs}) and {tuple(r) for r in got} == {k for _, k in pairs}
    assert contain.holders(df(whole), df([])).count() == contain.held(df([]), df(known)).count() == 0


@pytest.mark.parametrize("part", [1_000_000, 10])
def test_longest_known_name(spark, part):
    whole = sorted({t for _, t in texts(3, 60, 16)}) + [None]
    names = ["ab", "ba", "aba", "ç", "a b", "bab", "zzz"]
    known = spark.createDataFrame([(x,) for x in names], "name string")
    df = spark.createDataFrame([(x,) for x in whole], "description string")
    got = {r.description: r.found for r in contain.longest_known(df, F.col("description"), known, "name", part).collect()}
    best = {w: min((-len(x), x) for x in names if x in w)[1] for w in whole if w and any(x in w for x in names)}
    assert got == best and len(best) > 20
    assert contain.longest_known(df, F.col("description"), known.limit(0), "name").count() == 0


def test_long_and_common_names(spark):
    """A text of a million letters, and a name that every text has: rows put out stay one a text."""
    known = spark.createDataFrame([("LOJA",), ("LOJA DE " + "X" * 50,), ("CENTRO",)], "city string")
    rows = spark.createDataFrame([(1, "loja " * 200_000), (2, "a loja do centro"), (3, None), (4, "nada")], "idx int, description string")
    found = {r.idx: r.found_city for r in enrich.cities(rows, known).collect()}
    assert (found[1], found[2]) == ("LOJA", "CENTRO") and len(found) == 4
