"""Which texts hold which others, by automata over the known texts.

An automaton of many texts reads a text once, from its first letter to its last, whatever the number of
texts it looks for. Known texts are split into parts of bounded size, one automaton each, and the
texts that are searched are streamed past them through Arrow, so no substrings or places become rows:
what is put out is at most a row for each text and part.

Within groups (documents), texts meet in cells: a part of the known texts with a share of the
searched ones. Ungrouped, each part in turn is broadcast, with its size checked.
"""

from __future__ import annotations

import sys

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .rounds import streamed

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # executors need no copy of the package

#: Characters of the known texts of an automaton, and of the searched texts of a cell.
PART, SHARE = 1_000_000, 8_000_000


def automaton(texts):
    """An automaton of the texts that aren't empty; None without any."""
    import ahocorasick

    made = ahocorasick.Automaton()
    for text in texts:
        if text:
            made.add_word(text, text)
    if not len(made):
        return None
    made.make_automaton()
    return made


def longest(texts, found) -> list[str | None]:
    """For each text the longest known text in it, the first of equals; an empty one is in all."""
    out = []
    for text in texts:
        best = "" if found["empty"] else None
        if text is not None and found["automaton"] is not None:
            for _, known in found["automaton"].iter(text):
                if best is None or (-len(known), known) < (-len(best), best):
                    best = known
        out.append(best if text is not None else None)
    return out


def longest_known(texts: DataFrame, text: Column, known: DataFrame, name: str, part: int = PART) -> DataFrame:
    """texts with `found`: the longest of the known names inside the text, the first of equals; rows without one are left out.

    known's parts have at most about `part` characters each, which come to the driver and are broadcast one after another.
    """
    sizes = known.agg(F.sum(F.length(name)).alias("n"), F.count("*").alias("rows")).first()
    spark, kept = texts.sparkSession, texts.columns
    source = texts.withColumn("\0text", text)
    shape = f"{', '.join(f'`{c}` {k}' for c, k in texts.dtypes)}, found string"

    def search(shared):
        def run(batches):
            held = {"automaton": automaton(shared.value), "empty": "" in shared.value}
            for b in batches:
                found = pa.array(longest(b.column(b.num_columns - 1).to_pylist(), held), pa.string())
                rows = pa.RecordBatch.from_arrays([*b.columns[:-1], found], names=[*kept, "found"])
                yield rows.filter(found.is_valid())

        return source.mapInArrow(run, shape)

    parts = -(-(sizes.n or 0) // part) or bool(sizes.rows)
    if not parts:
        return texts.withColumn("found", F.lit(None).cast("string")).limit(0)
    own = F.pmod(F.xxhash64(name), F.lit(parts))
    found = [search(spark.sparkContext.broadcast([r[0] for r in known.filter(own == k).select(name).collect()])) for k in range(parts)]
    if len(found) == 1:
        return found[0]
    every = found[0]
    for f in found[1:]:
        every = every.unionByName(f)
    return every.groupBy(*kept).agg(F.min(F.struct((-F.length("found")).alias("n"), "found"))["found"].alias("found"))


def _cells(texts: DataFrame, known: DataFrame, group: str, part: int, share: int) -> DataFrame:
    """Rows (group, k, c, kind, text): each known text (kind 0) of part k in every share c, each searched one (kind 1) of share c in every part."""
    size = lambda d, n, most: d.groupBy(group).agg(F.ceil((F.sum(F.length("text")) + F.count("*")) / most).cast("int").alias(n))
    grid = size(known, "parts", part).join(size(texts, "shares", share), group)
    deal = lambda n: F.pmod(F.xxhash64("text"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    first = known.join(grid, group).withColumns({"k": deal("parts"), "kind": F.lit(0)}).withColumn("c", every("shares"))
    second = texts.join(grid, group).withColumns({"c": deal("shares"), "kind": F.lit(1)}).withColumn("k", every("parts"))
    columns = [group, "k", "c", "kind", "text"]
    return first.select(columns).unionByName(second.select(columns))


class _Cell:
    """A cell's known texts, those found so far, and their automaton, made when the first text is searched."""

    def __init__(self):
        self.known, self.found, self.made, self.automaton = [], set(), False, None


def _hits(texts: DataFrame, known: DataFrame, group: str, part: int, share: int) -> DataFrame:
    """(group, text, found): the texts that hold a known text of their group, with those that no earlier text of the cell held.

    texts and known: (group, text), without repeats. An empty known text is in every text.
    """

    def step(cell, row):
        if not row.kind:
            cell.known.append(row.text)
            return None
        if not cell.made:
            cell.automaton, cell.made = automaton(cell.known), True
        new = {k for _, k in cell.automaton.iter(row.text)} if cell.automaton is not None else set()
        if cell.known[:1] == [""]:  # the first of all in order
            new.add("")
        fresh = [k for k in new if k not in cell.found]
        cell.found.update(fresh)
        return (row[0], row.text, fresh) if new else None

    columns = f"{group} {dict(texts.dtypes)[group]}, text string, found array<string>"
    return streamed(_cells(texts.select(group, "text"), known.select(group, "text"), group, part, share), [group, "k", "c"], ["kind", "text"], columns, _Cell, step)


def holders(texts: DataFrame, known: DataFrame, group: str = "doc_id", part: int = PART, share: int = SHARE) -> DataFrame:
    """(group, text): the distinct texts that hold a known text of their group."""
    return _hits(texts, known, group, part, share).select(group, "text").distinct()


def held(texts: DataFrame, known: DataFrame, group: str = "doc_id", part: int = PART, share: int = SHARE) -> DataFrame:
    """(group, text): the distinct known texts that are in a text of their group."""
    return _hits(texts, known, group, part, share).select(group, F.explode("found").alias("text")).distinct()
