"""Order-dependent choices of groups too large for a task, made by rounds.

Both rules are sequential as stated: a row leads unless an earlier leader is near and alike; a
row takes the best row that no earlier one has taken. Their results are reached in parallel.

Leaders: of each block the first HEAD rows that are undecided are decided one after another in a task;
all later rows, dealt over many tasks, are then compared with the leaders found. What is alike to
one belongs to the first such; the rest goes to the next round. No pairs are stored, and the work is
that of comparing each row with the leaders before it.

Matches: every row of one side asks for the best row of the other that would still take it, and
each of those keeps the earliest that asks; who is turned away, or is pushed out by an earlier
one, asks again. As all rows of the other side prefer earlier askers, the end is the one stable
matching, which is the sequential rule's result. Candidates meet in buckets of shared word, days
and amounts, and are reduced to the best before they are shuffled. Rounds are as many as the longest
chain of rows that push each other out.
"""

from __future__ import annotations

import math
import sys
from collections import namedtuple
from functools import reduce

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.alike import Leaders, Words
from ..store import Tables

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # executors need no copy of the package

#: Rows of a document that one task matches, and of a block whose leaders it finds; larger ones go by rounds.
HELD, BLOCK = 20_000, 5000
#: Rows decided in order in a round, and rows of a task that compares.
HEAD, DEALT = 4096, 2048
#: Width of an amount's bucket, at least, as a factor.
NARROW = 1.02


def nearest(leaders: dict, row, days: int, limit: int, least: float, text: Words):
    """The first of the leaders (by day and cents) that is near and alike to a row; None without."""
    found = []
    for d in range(row.day - days, row.day + days + 1):
        for c in range(row.cents - limit, row.cents + limit + 1):
            if (cell := leaders.get((d, c))) and (hit := cell.first(text)) is not None:
                found.append(hit)
    return min(found, default=None)


def lead(leaders: dict, row, days: int, limit: int, least: float) -> int:
    """A row's leader, itself if there is none; it then leads from here on. Rows without day or cents are near nothing."""
    if row.day is None or row.cents is None:
        return row.own
    text = Words(row.description)
    found = nearest(leaders, row, days, limit, least, text)
    if found is not None:
        return found
    leaders.setdefault((row.day, row.cents), Leaders(least)).add(row.own, text)
    return row.own


#: Arrow's types of result columns.
KINDS = {"long": pa.int64(), "bigint": pa.int64(), "int": pa.int32(), "double": pa.float64(), "string": pa.string(), "array<string>": pa.list_(pa.string())}


def streamed(rows: DataFrame, keys: list[str], order: list, columns: str, start, step) -> DataFrame:
    """Rows of groups (keys) one after another in `order`: step(state, row) gives a row's output tuple or None, with a new state for each group.

    Groups are dealt by their keys and streamed in batches, so a task holds one group's state and a batch.
    """
    fields = [c.split() for c in columns.split(", ")]
    names = [*keys, *[c for c in rows.columns if c not in keys]]

    def run(batches):
        key, state, shape = None, None, namedtuple("Row", names)
        for b in batches:
            out = []
            for row in map(shape._make, zip(*[c.to_pylist() for c in b.columns], strict=True)):
                if row[: len(keys)] != key:
                    key, state = row[: len(keys)], start()
                if (made := step(state, row)) is not None:
                    out.append(made)
            by_column = zip(*out, strict=True) if out else [[]] * len(fields)
            yield pa.RecordBatch.from_arrays([pa.array(x, KINDS[kind]) for x, (_, kind) in zip(by_column, fields, strict=True)], names=[n for n, _ in fields])

    return rows.select(names).repartition(*keys).sortWithinPartitions(*keys, *order).mapInArrow(run, columns)


def leader_rounds(rows: DataFrame, days: int, limit: int, least: float, tables: Tables, head: int = HEAD, dealt: int = DEALT) -> DataFrame:
    """(row, leader) of rows (row, grp, own, day, cents, description): leader is the `own` of the first earlier leader of the group that is near and alike."""
    columns, decided = "row long, grp string, leader long, own long, day int, cents long, description string", []
    slim = tables.keep(rows.select("row", "grp", "own", "day", "cents", "description"))

    def first(leaders, r):
        return r.row, r.grp, lead(leaders, r, days, limit, least), r.own, r.day, r.cents, r.description

    def later(leaders, r):
        if r.leads:
            leaders.setdefault((r.day, r.cents), Leaders(least)).add(r.own, Words(r.description))
            return None
        known = None if r.day is None or r.cents is None else nearest(leaders, r, days, limit, least, Words(r.description))
        return r.row, r.grp, known, r.own, r.day, r.cents, r.description

    while not slim.isEmpty():
        ranked = slim.withColumn("n", F.row_number().over(W.partitionBy("grp").orderBy("own"))).filter(F.col("n") <= head)
        sizes = slim.groupBy("grp").agg(F.ceil(F.count("*") / dealt).cast("int").alias("salts"))
        bounds = tables.keep(ranked.groupBy("grp").agg(F.max("own").alias("bound")).join(sizes, "grp"))
        held = slim.join(bounds, "grp")
        now = tables.keep(streamed(held.filter("own <= bound").select(slim.columns), ["grp"], ["own", "row"], columns, dict, first))
        decided.append(now.select("row", "leader"))
        salt = F.pmod(F.xxhash64("row"), F.col("salts")).cast("int")
        rest = held.filter("own > bound").withColumns({"salt": salt, "leads": F.lit(False)})
        leads = now.filter("leader = own and day is not null and cents is not null").join(bounds, "grp")
        leads = leads.withColumns({"salt": F.explode(F.sequence(F.lit(0), F.col("salts") - 1)), "leads": F.lit(True)})
        both = rest.select(*slim.columns, "salt", "leads").unionByName(leads.select(*slim.columns, "salt", "leads"))
        asked = tables.keep(streamed(both, ["grp", "salt"], [F.desc("leads"), "own"], columns, dict, later))
        decided.append(asked.filter("leader is not null").select("row", "leader"))
        slim = asked.filter("leader is null").select(slim.columns)
    return reduce(DataFrame.unionByName, decided) if decided else slim.select("row", F.col("own").alias("leader"))


def _alike(x: Column, y: Column) -> Column:
    """Shared words of all words of two sets; 1 for two empty ones."""
    shared = F.size(F.array_intersect(x, y))
    every = F.size(x) + F.size(y) - shared
    return F.when(every > 0, shared / every).otherwise(F.lit(1.0))


def matched(asking: DataFrame, asked: DataFrame, least: float, tables: Tables) -> DataFrame:
    """(doc_id, a_id, b_id, score): each row of asking, by `at`, takes the best row of asked left in its document, from `least` on.

    Rows: (doc_id, day, cents, words, at, id); words as text. Scores as in linkage.greedy_match.
    """
    loss = 1 - least + 1e-9
    reach = int(7 * loss / 0.3) if loss < 0.3 else None  # days
    factor = max(NARROW, 1 / (1 - loss / 0.4)) if loss < 0.4 else None  # of amounts
    share = 1 - loss / 0.3  # of the words, at least
    split = F.array_sort(F.array_distinct(F.filter(F.split("words", " "), lambda w: w != "")))

    def keyed(d: DataFrame, wide: bool) -> DataFrame:
        """Rows in their buckets: the words they must share one of (all but as many as may differ), days and amounts, with their neighbours if wide."""
        d = d.withColumn("words", split)
        if share > 0:
            some = F.size("words") - F.ceil(share * F.size("words")) + 1
            by_hash = F.transform(F.array_sort(F.transform("words", lambda w: F.struct(F.xxhash64(w).alias("h"), w.alias("w")))), lambda x: x["h"])
            word = F.explode(F.when(F.size("words") == 0, F.array(F.lit(0).cast("long"))).otherwise(F.slice(by_hash, F.lit(1), some.cast("int"))))
        else:
            word = F.lit(0).cast("long")
        d = d.withColumn("k_word", word)
        near = lambda x: F.explode(F.array(x - 1, x, x + 1)) if wide else x
        d = d.withColumn("k_day", near(F.floor(F.col("day") / (reach + 1))) if reach is not None else F.lit(0))
        if factor is None:
            return d.withColumn("k_sum", F.lit("0"))
        d = d.withColumn("k_sum", near(F.floor(F.log(F.greatest(F.abs("cents"), F.lit(1)).cast("double")) / math.log(factor)).cast("long")))
        return d.withColumn("k_sum", F.concat_ws("/", F.signum(F.col("cents").cast("double")).cast("int").cast("string"), F.col("k_sum").cast("string")))

    keys = ["doc_id", "k_word", "k_day", "k_sum"]
    theirs = tables.keep(keyed(asked, False).select(*keys, F.col("day").alias("b_day"), F.col("cents").alias("b_cents"), F.col("words").alias("b_words"), F.col("at").alias("b_at"), F.col("id").alias("b_id")))
    active = tables.keep(asking.select("doc_id", "day", "cents", "words", "at", "id"))
    held = tables.keep(active.limit(0).select("*", F.lit(0).cast("long").alias("b_at"), F.lit(0).cast("long").alias("b_id"), F.lit(0.0).alias("score")))
    mine = active.columns
    while not active.isEmpty():
        taken = held.select("doc_id", "b_at", F.col("at").alias("by"))
        most = F.greatest(F.abs("cents"), F.abs("b_cents"))
        near = F.when(most > 0, F.greatest(F.lit(0.0), 1 - F.abs(F.col("cents") - F.col("b_cents")) / most)).otherwise(F.lit(1.0))
        dated = F.greatest(F.lit(0.0), 1 - F.abs(F.col("day") - F.col("b_day")) / 7)
        score = F.floor((0.3 * dated + 0.4 * near + 0.3 * _alike(F.col("words"), F.col("b_words"))) * 1e9 + 0.5) / 1e9
        able = F.lit(0.3) * dated + F.lit(0.4) * near + 0.3 >= least - 1e-9  # before words are compared
        pairs = keyed(active, True).join(theirs, keys).filter(able).withColumn("score", score).filter(F.col("score") >= least)
        open_pairs = pairs.join(taken, ["doc_id", "b_at"], "left").filter("by is null or by > at")
        best = open_pairs.groupBy("doc_id", "at").agg(F.max(F.struct("score", (-F.col("b_at")).alias("less"), "b_id")).alias("best"))
        asks = active.join(best, ["doc_id", "at"]).select(*mine, (-F.col("best.less")).alias("b_at"), F.col("best.b_id").alias("b_id"), F.col("best.score").alias("score"))
        every = held.select(*mine, "b_at", "b_id", "score").unionByName(asks)
        every = tables.keep(every.withColumn("n", F.row_number().over(W.partitionBy("doc_id", "b_at").orderBy("at"))))
        held, active = every.filter("n = 1").drop("n"), every.filter("n > 1").select(mine)
    return held.select("doc_id", F.col("id").alias("a_id"), "b_id", "score")
