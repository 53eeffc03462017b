"""Record linkage between extractions: blocked near joins, alignments, merges and set operations.

No pair join is unblocked: near amounts and dates meet in exploded cent and day buckets, so
the plans are equi-joins. Order-dependent rules carry an explicit order column.
"""

from __future__ import annotations

import sys
from bisect import bisect_left, bisect_right
from collections import deque
from math import floor

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import alike, confidence
from ..functions import text as t
from ..store import Tables
from . import contain, rounds


cloudpickle.register_pickle_by_value(sys.modules[__name__])  # executors need no copy of the package


def cents(value: Column) -> Column:
    return F.round(value * 100, 0).cast("long")


def token_set_ratio(a: str, b: str, least: float = 0.0) -> float:
    """Similarity 0 to 100 of two texts' word sets; below `least` any value below it may come back."""
    return alike.ratio(alike.Words(a), alike.Words(b), least)


def near_classes(a: DataFrame, b: DataFrame, days: int = 1, within: float = 0.01) -> DataFrame:
    """Pairs of classes of rows of one document whose dates and amounts are near, with their numbers of rows.

    A class is the rows of one (document, date, cents), so a repeated amount costs one row. b's
    classes are put into all day buckets within `days`; amounts meet in cent buckets as wide as
    the tolerance, so both sides stay linear. Rows belong to pairs by their class.
    """
    limit = round(within * 100)
    wide = max(1, limit) + 1
    kinds = lambda d: d.groupBy("doc_id", "date", cents(F.col("amount_brl")).alias("cents")).agg(F.count("*").alias("n"))
    left = kinds(a).select("doc_id", F.unix_date("date").alias("day"), F.floor(F.col("cents") / wide).alias("bucket"), F.struct("date", "cents", "n").alias("l"))
    right = kinds(b).select(
        "doc_id", F.explode(F.sequence(F.unix_date("date") - days, F.unix_date("date") + days)).alias("day"),
        F.floor(F.col("cents") / wide).alias("mid"), F.struct("date", "cents", "n").alias("r")
    )
    right = right.select("doc_id", "day", F.explode(F.array(F.col("mid") - 1, F.col("mid"), F.col("mid") + 1)).alias("bucket"), "r")
    return left.join(right, ["doc_id", "day", "bucket"]).filter(F.abs(F.col("l.cents") - F.col("r.cents")) <= limit).select("doc_id", "l", "r")


def blocks(rows: DataFrame, days: int = 1, within: int = 1) -> DataFrame:
    """Rows with `block`: runs of near amounts, cut again into runs of near dates. No two rows of different blocks are near."""
    by_cents = W.partitionBy("doc_id").orderBy("\0cents")
    out = rows.withColumn("\0cents", cents(F.col("amount_brl")))
    gap = (F.col("`\0cents`") - F.lag("`\0cents`").over(by_cents) > within).cast("int")
    out = out.withColumn("\0run", F.sum(F.coalesce(gap, F.lit(0))).over(by_cents.rangeBetween(W.unboundedPreceding, 0)))
    by_day = W.partitionBy("doc_id", "\0run").orderBy("date")
    far = (F.datediff("date", F.lag("date").over(by_day)) > days).cast("int")
    out = out.withColumn("\0days", F.sum(F.coalesce(far, F.lit(0))).over(by_day.rangeBetween(W.unboundedPreceding, 0)))
    return out.withColumn("block", F.concat_ws("/", "`\0run`", "`\0days`")).drop("\0cents", "\0run", "\0days")


def _in_blocks(rows: DataFrame, order: list, schema, start, step, finish) -> DataFrame:
    """Rows of blocks (doc_id, block) one after another in `order`: step(state, row) for each, the state new for each block.

    Blocks are dealt by their names and streamed in batches, so a task holds one block's state
    and one batch, and many small blocks cost no more than their rows. finish(batch, results)
    makes a batch's output.
    """

    def run(batches):
        key, state = None, None
        for pdf in batches:
            out = []
            for k, row in zip(zip(pdf["doc_id"], pdf["block"], strict=True), pdf.itertuples(index=False), strict=True):
                if k != key:
                    key, state = k, start()
                out.append(step(state, row))
            yield finish(pdf, out)

    return rows.repartition("doc_id", "block").sortWithinPartitions("doc_id", "block", *order).mapInPandas(run, schema)


def leader_clusters(rows: DataFrame, order: str, days: int = 1, within: float = 0.01, least: float = 70.0, held: int = rounds.BLOCK) -> DataFrame:
    """rows with `leader`: the order value of the first earlier row of their document that is near and alike, else their own.

    Only leaders within the days and cents are compared, in order; blocks keep together whatever
    is near. Rows without a date or amount are near nothing. A block of at most `held` rows is
    streamed by one task; larger ones are decided by rounds.
    """
    tables, limit = Tables(rows.sparkSession), round(within * 100)
    cut = tables.keep(blocks(rows, days, limit).withColumn("\0row", F.monotonically_increasing_id()))
    group = F.concat_ws("\0", F.col("doc_id").cast("string"), F.coalesce("block", F.lit("")))
    slim = cut.select(
        F.col("`\0row`").alias("row"), group.alias("grp"), F.col(order).cast("long").alias("own"), F.unix_date("date").alias("day"), cents(F.col("amount_brl")).alias("cents"), "description"
    )
    large = tables.keep(slim.groupBy("grp").count().filter(F.col("count") > held).select("grp"))

    def step(leaders: dict, row, lead=rounds.lead):  # the function goes along with the job, its module wouldn't
        return row.row, lead(leaders, row, days, limit, least)

    small = slim.join(large, "grp", "left_anti")
    found = rounds.streamed(small, ["grp"], ["own", "row"], "row long, leader long", dict, step)
    if not large.isEmpty():
        found = found.unionByName(rounds.leader_rounds(slim.join(large, "grp", "left_semi"), days, limit, least, tables))
    return cut.join(found.withColumnRenamed("row", "\0row").withColumnRenamed("leader", "\0leader"), "\0row").select(*[c for c in rows.columns if c != "leader"], F.col("`\0leader`").alias("leader"))


def strict_dedup(rows: DataFrame, order: str) -> DataFrame:
    """Of rows equal in document, date, amount and description the most confident, the first on ties."""
    w = W.partitionBy("doc_id", "date", cents(F.col("amount_brl")), "description").orderBy(F.desc("confidence"), order)
    return rows.withColumn("\0n", F.row_number().over(w)).filter("`\0n` = 1").drop("\0n")


def fuzzy_merge(rows: DataFrame, order: str, least: float = 90.0) -> DataFrame:
    """Of rows equal in document, date and cents whose descriptions are alike to the first of their group, the most confident, the first on ties."""
    grouped = leader_clusters(rows, order, days=0, within=0.0, least=least)
    w = W.partitionBy("doc_id", "leader").orderBy(F.desc("confidence"), order)
    return grouped.withColumn("\0n", F.row_number().over(w)).filter("`\0n` = 1").drop("\0n")


def union_antidup(first: DataFrame, second: DataFrame) -> DataFrame:
    """All of first, and what second has besides (by document, date, description and cents)."""
    key = lambda d: d.withColumn("\0cents", cents(F.col("amount_brl")))
    on = ["doc_id", "date", "description", "\0cents"]
    return first.unionByName(key(second).join(key(first).select(*on).distinct(), on, "left_anti").drop("\0cents").select(*first.columns))


def aligned(found: DataFrame, golden: DataFrame, order: str) -> DataFrame:
    """Full outer multiset join: the k-th row of a (document, date, amount) with the k-th golden one, as structs f and g."""
    on = ["doc_id", "date", "\0cents", "\0k"]

    def keyed(d: DataFrame, name: str) -> DataFrame:
        d = d.withColumn("\0cents", cents(F.col("amount_brl")))
        k = F.row_number().over(W.partitionBy("doc_id", "date", "\0cents").orderBy(order))
        return d.withColumn("\0k", k).select(*on, F.struct(*[c for c in d.columns if c != "\0cents"]).alias(name))

    return keyed(found, "f").join(keyed(golden, "g"), on, "full_outer").select("doc_id", "date", "f", "g")


def greedy_match(a: DataFrame, b: DataFrame, order: str, least: float = 0.8, held: int = rounds.HELD) -> DataFrame:
    """One-to-one matches: first the equal rows, then in a's order the best b left at or above `least`.

    Scores are .3 date (1 - days / 7) + .4 amount (1 - relative difference) + .3 shared words,
    rounded to 9 places; the first b wins ties. Rows equal in document, date, cents and words
    count once, at the place of the first and with the id of the last. Equal rows meet in a
    join; of the rest, a document of at most `held` rows is matched by one task, against buckets of
    a day, sorted by amount, cut to what can still reach `least`; larger ones by rounds. No pairs are stored.
    """
    on = ["doc_id", "day", "cents", "words"]

    def side(d: DataFrame, n: str) -> DataFrame:
        d = d.select(
            "doc_id", F.unix_date("date").alias("day"), cents(F.col("amount_brl")).alias("cents"),
            F.coalesce(t.comparable(F.col("description")), F.lit("")).alias("words"), F.col(order).cast("long").alias("id")
        )
        return d.dropna(subset=["doc_id", "day", "cents"]).groupBy(*on).agg(F.min("id").alias(f"{n}_at"), F.max("id").alias(f"{n}_id"))

    both = side(a, "a").join(side(b, "b"), on, "full_outer")
    loss = 1 - least + 1e-9

    def pick(rows: list):
        """Matches of one document's rows (doc_id, day, cents, words, first, at, id)."""
        days: dict = {}
        for _, day, money, words, first, at, own in sorted(rows, key=lambda r: (r[2], r[5])):
            if not first:
                amounts, held = days.setdefault(day, ([], []))
                amounts.append(money)
                held.append((at, own, frozenset(words.split())))
        used = set()
        for doc, day, money, words, first, _, own in sorted(rows, key=lambda r: r[5]):
            if not first:
                continue
            able, mine = [], frozenset(words.split())
            for other, (amounts, held) in days.items():
                dated = max(0.0, 1 - abs(day - other) / 7)
                room = (loss - 0.3 * (1 - dated)) / 0.4  # of the amount's score
                low, high = 0, len(held)
                if room < 0:
                    continue
                if room < 1:  # of one sign and near, or both 0
                    ends = sorted((money * (1 - room), money / (1 - room)))
                    low, high = bisect_left(amounts, ends[0] - 0.5), bisect_right(amounts, ends[1] + 0.5)
                for k in range(low, high):
                    if held[k][1] not in used:
                        most = max(abs(money), abs(amounts[k]))
                        near = max(0.0, 1 - abs(money - amounts[k]) / most) if most else 1.0
                        able.append((0.3 * dated + 0.4 * near, held[k]))
            best = None
            for partial, (at, b_id, theirs) in sorted(able, key=lambda x: -x[0]):
                if partial + 0.3 + 1e-9 < (best[0] if best else least):
                    break
                shared = len(mine & theirs) / len(mine | theirs) if mine or theirs else 1.0
                score = floor(float(partial + 0.3 * shared) * 1e9 + 0.5) / 1e9
                if score >= least and (best is None or (score, -at) > (best[0], -best[1])):
                    best = score, at, b_id
            if best:
                used.add(best[2])
                yield doc, own, best[2], best[0]

    def run(batches):
        doc, rows = None, []
        for pdf in batches:
            out = []
            for r in zip(*[pdf[c].tolist() for c in pdf.columns], strict=True):
                if r[0] != doc:
                    out += pick(rows)
                    doc, rows = r[0], []
                rows.append(r)
            yield pd.DataFrame(out, columns=["doc_id", "a_id", "b_id", "score"])
        yield pd.DataFrame(list(pick(rows)), columns=["doc_id", "a_id", "b_id", "score"])

    schema = f"doc_id {dict(a.dtypes)['doc_id']}, a_id long, b_id long, score double"
    equal = both.filter("a_id is not null and b_id is not null").select("doc_id", "a_id", "b_id", F.lit(1.0).alias("score"))
    rest = both.filter("a_id is null or b_id is null").select(
        "doc_id", "day", "cents", "words", F.col("a_id").isNotNull().alias("first"), F.coalesce("a_at", "b_at").alias("at"),
        F.coalesce("a_id", "b_id").alias("id")
    )
    tables = Tables(a.sparkSession)
    rest = tables.keep(rest)
    large = tables.keep(rest.groupBy("doc_id").count().filter(F.col("count") > held).select("doc_id"))
    small = rest.join(large, "doc_id", "left_anti").select(rest.columns)
    out = equal.union(small.repartition("doc_id").sortWithinPartitions("doc_id").mapInPandas(run, schema))
    if large.isEmpty():
        return out
    big = rest.join(large, "doc_id", "left_semi")
    return out.unionByName(rounds.matched(big.filter("first"), big.filter("not first"), least, tables))


def first_fit(golden: DataFrame, found: DataFrame, order: str, within: float = 0.05) -> DataFrame:
    """One-to-one pairs (doc_id, g, f) of order values: each golden row, in order, takes the first free row of its date and about its amount.

    A block of one row of each side is a pair as it stands; only blocks of more rows are streamed.
    """
    limit = round(within * 100)
    side = lambda d, golden: d.select("doc_id", "date", "amount_brl", F.col(order).cast("long").alias("id"), F.lit(golden).alias("golden"))
    both = blocks(side(golden, True).unionByName(side(found, False)).dropna(subset=["doc_id", "date", "amount_brl"]), 0, limit)
    in_block = W.partitionBy("doc_id", "block")
    n_golden, n = F.count_if("golden").over(in_block), F.count("*").over(in_block)
    both = both.select("doc_id", "block", F.unix_date("date").alias("day"), cents(F.col("amount_brl")).alias("cents"), "id", "golden", n_golden.alias("n_golden"), n.alias("n"))
    both = Tables(golden.sparkSession).keep(both.filter("n_golden > 0 and n_golden < n").withColumn("plain", F.col("n") == 2).drop("n_golden", "n"))
    id_of = lambda golden: F.max(F.when(F.col("golden") == golden, F.col("id")))
    plain = both.filter("plain").groupBy("doc_id", "block").agg(id_of(True).alias("g"), id_of(False).alias("f")).select("doc_id", "g", "f")

    def step(free: dict, row):  # found rows come first
        if not row.golden:
            free.setdefault((row.day, row.cents), deque()).append(row.id)
            return None
        able = [(free[row.day, c][0], c) for c in range(row.cents - limit, row.cents + limit + 1) if free.get((row.day, c))]
        if not able:
            return None
        took, c = min(able)
        free[row.day, c].popleft()
        return row.doc_id, row.id, took

    schema = f"doc_id {dict(golden.dtypes)['doc_id']}, g long, f long"
    made = lambda _, out: pd.DataFrame([x for x in out if x], columns=["doc_id", "g", "f"])
    return plain.unionByName(_in_blocks(both.filter("not plain").drop("plain"), ["golden", "id"], schema, dict, step, made))


def description_matches(golden: DataFrame, found: DataFrame) -> DataFrame:
    """Per document how many golden descriptions are extracted exactly, or in part (either holds the other), with rates in percent.

    Case and blanks at the ends don't count. Precision is exact hits by extracted rows, recall by golden ones.
    """
    text = lambda d: d.select("doc_id", F.lower(F.trim(F.coalesce("description", F.lit("")))).alias("text"))
    on = ["doc_id", "text"]
    g, f = text(golden).groupBy(*on).agg(F.count("*").alias("n")), text(found)
    names = f.distinct()
    exact, rest = g.join(names, on, "left_semi"), g.join(names, on, "left_anti")
    either = contain.held(names, rest).unionByName(contain.holders(rest, names))
    partly = rest.join(either.distinct(), on, "left_semi")
    count = lambda d, name: d.groupBy("doc_id").agg(F.sum("n").alias(name))
    out = count(g, "golden").join(f.groupBy("doc_id").agg(F.count("*").alias("found")), "doc_id", "full_outer").join(count(exact, "exact"), "doc_id", "left").join(count(partly, "partial"), "doc_id", "left")
    out = out.fillna(0, ["golden", "found", "exact", "partial"])
    share = lambda x, y: F.coalesce(F.try_divide(x, F.col(y)), F.lit(0.0))
    p, r = share(F.col("exact"), "found"), share(F.col("exact"), "golden")
    rate = {"coverage": share(F.col("exact") + F.col("partial"), "golden"), "precision": p, "recall": r, "f1": F.coalesce(F.try_divide(2 * p * r, p + r), F.lit(0.0))}
    return out.select("doc_id", "golden", "found", "exact", "partial", *[F.round(100 * c, 6).alias(n) for n, c in rate.items()])


def missing_extra(found: DataFrame, golden: DataFrame, on: tuple[str, ...] = ("doc_id", "date", "amount_brl")) -> DataFrame:
    """(kind, doc_id, n): golden rows that aren't found (missing) and found rows that aren't golden (extra), by document."""
    side = lambda kind, x, y: x.join(y, list(on), "left_anti").groupBy("doc_id").agg(F.count("*").alias("n")).select(F.lit(kind).alias("kind"), "doc_id", "n")
    return side("missing", golden, found).union(side("extra", found, golden))


def fx_match(rows: DataFrame, fx: DataFrame, order: str) -> DataFrame:
    """Foreign rows with the first fx item of the document whose amount is within a cent."""
    items = fx.select("doc_id", F.explode(F.array(*[cents(F.col("amount_brl")) + k for k in (-1, 0, 1)])).alias("\0cents"), F.struct(order, "fx_rate").alias("item"))
    first = items.groupBy("doc_id", "\0cents").agg(F.min_by("item", f"item.{order}").alias("item"))
    foreign = rows.withColumn("\0cents", F.when(F.col("currency") != "BRL", cents(F.col("amount_brl"))))
    return foreign.join(first, ["doc_id", "\0cents"], "left").select(*rows.columns, "item.fx_rate")


def resolved(groups: DataFrame) -> DataFrame:
    """The best row of each group (doc_id, leader): merged confidence times the extractor's weight, the first on ties."""
    merged = confidence.merged(F.array(F.col("confidence"), F.col("pipeline_confidence")))
    scored = groups.withColumn("score", F.round(merged * confidence.weight(F.col("extractor")), 9))
    w = W.partitionBy("doc_id", "leader")
    best = scored.withColumn("\0n", F.row_number().over(w.orderBy(F.desc("score"), "idx"))).withColumn("conflicts", F.count("*").over(w) - 1)
    return best.filter("`\0n` = 1").drop("\0n")


def chosen(primary: DataFrame, second: DataFrame) -> DataFrame:
    """Per document, primary or fallback: fallback if primary failed, is empty, or is .1 less sure."""
    p, s = primary.alias("p"), second.alias("s")
    take = F.when(~F.col("p.success") & F.col("s.success"), "fallback")
    take = take.when(F.col("p.success") & F.col("s.success") & (F.col("s.confidence") > F.col("p.confidence") + 0.1), "fallback")
    take = take.when((F.col("p.n") == 0) & (F.col("s.n") > 0), "fallback").otherwise("primary")
    return p.join(s, "doc_id", "left").select("doc_id", F.coalesce(take, F.lit("primary")).alias("choice"))
