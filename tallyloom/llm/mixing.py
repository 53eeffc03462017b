"""Mixing sources to target weights by a time-varying curriculum.

Targets: the sources' weights share the demand; a source stops at its cap and the excess is
shared by weight among the rest (the common level is found in closed form from the sources in
the order of cap by weight). A source's documents follow each other in the order of a hash of
their ids, again and again, until its target is used up. Its weight schedule, integrated,
says how much of the target is due at each time; inverted at a document's place in the stream
it gives the document's training position (0 to 1). Documents are range-sorted by position.

The place in the stream is a running sum made in two levels (hash buckets of a source, then
within one), so a source may hold most rows. Reruns agree: nothing is drawn at random.

Nulls: a null source is a source, the last; a null text has no words. Documents without words
take none and have no position. The order of rows that repeat id and size doesn't matter.
Empty tables give none. An id or source whose column has a result column's name comes out as
`id` or `source`.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import n_words_of, quoted, scratch, stored

#: Weights by the source's rank, repeating; each has a schedule: its factor at times, linear between.
WEIGHTS = (3.0, 1.0, 2.0)
SCHEDULES = (((0.0, 1.5), (1.0, 0.5)), ((0.0, 0.5), (0.5, 0.75), (1.0, 2.0)), ((0.0, 1.0), (1.0, 1.0)))
SHARE, CAP = 1.5, 2
RESULT = ("size", "source_size", "target", "taken", "copies", "positions", "position", "carried")
#: Hex digits of a document's hash that name its bucket.
DIGITS = 3


def targets(sizes: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """sizes (source, source_size) with rank, `target` and its whole words `budget`. One row a source."""
    ranked = sizes.withColumn("rank", F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1)
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("rank") % len(weights) + 1).cast("int"))
    ranked = ranked.withColumns({"weight": weight, "cap": F.col("source_size") * float(cap)})
    by_level = W.orderBy(F.col("cap") / F.col("weight"), "rank")
    capped = F.coalesce(F.sum("cap").over(by_level.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0))
    left = F.sum("weight").over(by_level.rowsBetween(0, W.unboundedFollowing))
    demand = F.sum("source_size").over(W.partitionBy()) * float(share)
    levels = ranked.withColumn("level", (demand - capped) / left)
    fits = F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.col("level"))
    first = F.first(fits, ignorenulls=True).over(by_level.rowsBetween(W.unboundedPreceding, W.unboundedFollowing))
    target = F.least(F.col("cap"), F.coalesce(first, F.lit(float("inf"))) * F.col("weight"))
    return levels.withColumn("target", target).withColumn("budget", F.floor("target").cast("long")).drop("level", "cap")


def inverse(schedule: Sequence[tuple[float, float]], part: Column) -> Column:
    """The time by which `part` (0 to 1) of a schedule's integral is due."""
    pieces = [(a, b, m, n, (m + n) / 2 * (b - a)) for (a, m), (b, n) in zip(schedule, schedule[1:])]
    whole = sum(p[4] for p in pieces)
    out, done = F.lit(schedule[-1][0]), sum(p[4] for p in pieces)
    for a, b, m, n, area in reversed(pieces):
        done -= area
        due, slope = part * whole - done, (n - m) / (b - a)
        # m x + slope x^2 / 2 = due, in the form that also holds for slope 0.
        x = 2 * due / (m + F.sqrt(F.greatest(F.lit(0.0), m * m + 2 * slope * due)))
        out = F.when(part * whole <= done + area, F.lit(a) + x).otherwise(out)
    return F.least(F.lit(schedule[-1][0]), F.greatest(F.lit(schedule[0][0]), out))


def mix(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights=WEIGHTS,
    schedules=SCHEDULES, share=SHARE, cap=CAP, carry: Sequence[str] = ()
) -> DataFrame:
    """One row a document: id, size, source, source_size, target, taken, copies and position(s).

    taken: words the mix takes of the document, repeats counted; the document at the end of
    a budget gives only the words that are left. copies: times at least half of it is due.
    positions: a training position for each time it is taken, in order. carry: further columns
    of df to take along, as a struct `carried`.
    """
    spark, path = df.sparkSession, scratch(df.sparkSession)
    ids = quoted(id_col)
    key = F.md5(F.coalesce(ids.cast("string"), F.lit("")).cast("binary"))
    docs = df.select(
        ids.alias("id"), quoted(source_col).alias("source"), n_words_of(quoted(text_col)).alias("size"), key.alias("key"),
        *([F.struct(*map(quoted, carry)).alias("carried")] if carry else [])
    )
    docs = docs.withColumn("bucket", F.substring("key", 1, DIGITS))
    if not carry:
        docs = stored(docs, f"{path}/sizes")
    also = ["carried"] if carry else []
    sums = docs.groupBy("source", "bucket").agg(F.sum("size").alias("words"))
    to = stored(targets(sums.groupBy("source").agg(F.sum("words").alias("source_size")), weights, share, cap), f"{path}/targets")
    before = W.partitionBy("source").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
    heads = sums.select("source", "bucket", F.coalesce(F.sum("words").over(before), F.lit(0)).alias("head"))
    heads = heads.alias("h").join(to.alias("t"), F.col("h.source").eqNullSafe(F.col("t.source"))).select("h.*", "t.source_size", "t.target", "t.budget", "t.rank")
    heads = stored(heads, f"{path}/heads")
    run = W.partitionBy("source", "bucket").orderBy("key", "id", "size").rowsBetween(W.unboundedPreceding, 0)
    running = docs.withColumn("start", F.sum("size").over(run) - F.col("size"))
    same = F.col("d.source").eqNullSafe(F.col("h.source")) & (F.col("d.bucket") == F.col("h.bucket"))
    joined = running.alias("d").join(heads.alias("h"), same).select(
        "d.id", "d.size", "d.source", *also, (F.col("start") + F.col("head")).alias("start"), "source_size", "target", "budget",
        "rank"
    )
    times = range(-int(-cap // 1))
    starts = [F.col("start") + F.col("source_size") * k for k in times]
    gets = [F.greatest(F.lit(0), F.least(F.col("size"), F.col("budget") - s)) for s in starts]
    halves = [((F.col("size") > 0) & (2 * (F.col("budget") - s) >= F.col("size"))).cast("long") for s in starts]

    def position(s: Column) -> Column:
        part = (s + F.col("size") / 2) / F.col("target")
        out = inverse(schedules[0], part)
        for k in range(1, len(schedules)):
            out = F.when(F.col("rank") % len(schedules) == k, inverse(schedules[k], part)).otherwise(out)
        return out

    places = F.filter(F.array(*[F.when(g > 0, position(s)) for g, s in zip(gets, starts, strict=True)]), lambda x: x.isNotNull())
    out = joined.withColumns({"taken": sum(gets[1:], gets[0]).cast("long"), "copies": sum(halves[1:], halves[0]), "positions": places})
    out = out.withColumn("position", F.get("positions", F.lit(0)))
    name = lambda c, other: other if c in RESULT else c
    return out.select(
        F.col("id").alias(name(id_col, "id")), "size", F.col("source").alias(name(source_col, "source")), "source_size", "target",
        "taken", "copies", "positions", "position", *also
    )


def in_order(mixed: DataFrame, *ties: str) -> DataFrame:
    """Range-sorted by position: the files of a write follow the curriculum."""
    n = int(mixed.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return mixed.repartitionByRange(n, "position", *ties).sortWithinPartitions("position", *ties)
