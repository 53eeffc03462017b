"""Sharding by a k-d tree over metadata: distributed weighted medians along the widest dimension.

Law `bytes`: shards of near equal size. Every level finds all its nodes' cuts at once by
histograms of at most BINS bins a level (and LEAST_BINS a node), refined until the cut is exact or within TOLERANCE of
a shard. Histograms, searches, cuts and the tree are tables, but for the searches of levels of FEW
nodes at most: however many shards there are, no more comes to the driver. Small tables are
broadcast by Spark's own check of their size.
A cut keeps rows of equal coordinates together (the query's coordinates depend on the text, so
these are equal texts) unless that is off by more than KEEP of a shard; then ids part them.

Nulls: a null text has size 16 and the coordinates of the empty text; a null coordinate or id
counts as 0. Repeated rows can't be told apart and stay together when ids would part them. An
empty table gives an empty result. Further columns aren't read.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import drop_path, scratch, stored

BINS, LEAST_BINS, TOLERANCE, KEEP = 1 << 13, 512, 0.001, 0.02
#: Nodes of a level whose searches are kept in the plan; those of larger ones are tables.
FEW = 256
#: Rows of a shard that are numbered by one task.
NUMBERED = 50_000


def text_points(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, size, text_crc32 and n_chars of every document."""
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    return df.select(
        F.col(f"`{id_col}`").alias("id"),
        (F.octet_length(text) + 16).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.length(text).cast("long").alias("n_chars"),
    )


def _search(rows: DataFrame, state: DataFrame, bins: int) -> DataFrame:
    """One pass of every open node's search: state with narrower ranges, or with cuts.

    state: node, dim (its dimension's place), low and high (the range searched), under (bytes below
    it), goal and leaf (bytes that should lie under the cut, and of a shard), value (set once the
    cut lies inside one value, whose rows ids part), ids (the node's range of ids), cut and at. Bins
    are summed before the shuffle and run through by node.
    """
    live = state.filter("not done").withColumn("width", F.greatest(F.lit(1), F.expr(f"(high - low + {bins}) div {bins}")))
    own = F.get("\0x", F.col("dim"))
    here = rows.join(live.select("node", "dim", "low", "high", "width", "value"), "node").withColumn("c", F.when(F.col("value").isNull(), own).otherwise(F.col("\0id")))
    here = here.filter(F.col("c").between(F.col("low"), F.col("high")) & (F.col("value").isNull() | (own == F.col("value"))))
    sums = here.groupBy("node", F.expr("(c - low) div width").alias("bin")).agg(F.sum("size").alias("b"))
    run = F.sum("b").over(W.partitionBy("node").orderBy("bin").rowsBetween(W.unboundedPreceding, 0)) + F.col("under")
    sums = sums.join(live.select("node", "low", "high", "width", "under", "goal"), "node").withColumn("run", run)
    reach = F.least(F.col("high"), F.col("low") + (F.col("bin") + 1) * F.col("width") - 1)
    found = sums.groupBy("node").agg(
        F.min(F.struct(F.abs(F.col("run") - F.col("goal")).alias("off"), reach.alias("end"))).alias("best"),
        F.min(F.when(F.col("run") >= F.col("goal"), F.struct("bin", (F.col("run") - F.col("b")).alias("before")))).alias("inner"),
    )
    joined = live.join(found, "node", "left").withColumn(
        "best", F.least(F.struct(F.abs(F.col("under") - F.col("goal")).alias("off"), (F.col("low") - 1).alias("end")), "best")
    )
    off, fine = F.col("best.off"), F.col("width") == 1
    ends = (off <= TOLERANCE * F.col("leaf")) | F.col("inner").isNull() | (fine & (F.col("value").isNotNull() | (off <= KEEP * F.col("leaf"))))
    parted = ~ends & fine  # one value holds the cut: part its rows by id
    low = F.col("low") + F.col("inner.bin") * F.col("width")
    high = F.least(F.col("high"), low + F.col("width") - 1)
    after = joined.withColumns({"ends": ends, "parted": parted, "new_low": low, "new_high": high})
    stays = lambda c, new: F.when(F.col("ends"), F.col(c)).otherwise(new).alias(c)
    inside = F.col("value").isNotNull()
    after = after.select(
        "node", "dim", stays("low", F.when(F.col("parted"), F.col("ids.low")).otherwise(F.col("new_low"))), stays("high", F.when(F.col("parted"), F.col("ids.high")).otherwise(F.col("new_high"))),
        stays("under", F.col("inner.before")), "goal", "leaf", stays("value", F.when(F.col("parted"), F.col("new_low")).otherwise(F.col("value"))), "ids",
        F.when(F.col("ends"), F.when(inside, F.col("value")).otherwise(F.col("best.end"))).alias("cut"), F.when(F.col("ends") & inside, F.col("best.end")).alias("at"), F.col("ends").alias("done"),
    )
    return state.filter("done").unionByName(after)


def _kept(state: DataFrame, path: str, nodes: int) -> tuple[DataFrame, bool]:
    """The state, computed, and whether a search goes on: as rows of a plan for few nodes, else as a table."""
    if nodes <= FEW:
        rows = state.select(F.to_json(F.struct("*")).alias("row"), "done").collect()  # at most FEW
        held = state.sparkSession.range(1).select(F.explode(F.array(*[F.lit(r["row"]) for r in rows]).cast("array<string>")).alias("row"))
        kind = F.from_json("row", state.schema).alias("r")
        return held.select(kind).select("r.*"), any(not r["done"] for r in rows)
    state = stored(state, path)
    return state, not state.filter("not done").isEmpty()


def kd_tree(points: DataFrame, dims: Sequence[str], leaves: int | None = None, target_bytes: int | None = None) -> tuple[DataFrame, DataFrame, DataFrame, int]:
    """(points with `node`, cuts by node, shard by leaf node, shards) for `leaves` shards, or as many as target_bytes needs.

    points: id, size and the dimensions as longs; a node's children are 2n and 2n + 1. All nodes
    of a level are cut together, in tables: the driver only counts the searches that go on.
    """
    spark, path = points.sparkSession, scratch(points.sparkSession)
    x = F.array(*[F.coalesce(F.col(d), F.lit(0)).cast("long") for d in dims])
    rows = stored(points.withColumns({"\0id": F.coalesce("id", F.lit(0)).cast("long"), "\0x": x, "node": F.lit(1).cast("long")}), f"{path}/rows0")
    total = rows.agg(F.sum("size")).first()[0] or 0
    if leaves is None:
        leaves = max(1, -(-total // target_bytes))
    spans = rows.agg(*[(F.max(F.get("\0x", F.lit(i))) - F.min(F.get("\0x", F.lit(i)))) for i in range(len(dims))]).first()
    spans = [max(1, s or 0) for s in spans]
    nodes = spark.range(1).select(F.lit(1).cast("long").alias("node"), F.lit(0).cast("long").alias("first"), F.lit(leaves).cast("long").alias("k"))
    none = F.lit(None).cast("long")
    ends, cuts = [nodes.filter("k = 1")], nodes.limit(0).select("node", F.lit(0).alias("dim"), none.alias("cut"), none.alias("at"))
    levels = (leaves - 1).bit_length()
    for level in range(levels):
        nodes, bins = nodes.filter("k > 1"), max(LEAST_BINS, BINS >> level)
        at = lambda i: F.get("\0x", F.lit(i))
        ranges = [f.alias(f"{n}{i}") for i in range(len(dims)) for n, f in (("low", F.min(at(i))), ("high", F.max(at(i))))]
        stats = rows.join(nodes.select("node"), "node").groupBy("node").agg(
            F.sum("size").alias("s"), F.struct(F.min("\0id").alias("low"), F.max("\0id").alias("high")).alias("ids"), *ranges
        ).join(nodes, "node")
        widest = F.array_max(F.array(*[F.struct(((F.col(f"high{i}") - F.col(f"low{i}")) / F.lit(spans[i])).alias("w"), F.lit(-i).alias("i")) for i in range(len(dims))]))
        pick = lambda n: F.get(F.array(*[F.col(f"{n}{i}") for i in range(len(dims))]), F.col("dim"))
        state = stats.withColumn("dim", -widest["i"]).select(
            "node", "dim", pick("low").alias("low"), pick("high").alias("high"), F.lit(0).cast("long").alias("under"), (F.col("s") * F.expr("k div 2") / F.col("k")).alias("goal"), (F.col("s") / F.col("k")).alias("leaf"),
            none.alias("value"), "ids", none.alias("cut"), none.alias("at"), F.lit(False).alias("done"),
        )
        going, n = True, 0
        while going:
            state, going = _kept(_search(rows, state, bins), f"{path}/state{level}-{n}", 1 << level)
            n += 1
        made = state.select("node", "dim", "cut", "at")
        cuts = cuts.unionByName(made)
        own = F.get("\0x", F.col("dim"))
        below = F.when(F.col("at").isNull(), own <= F.col("cut")).otherwise((own < F.col("cut")) | ((own == F.col("cut")) & (F.col("\0id") <= F.col("at"))))
        moved = rows.join(made, "node", "left").withColumn(
            "node", F.when(F.col("dim").isNull(), F.col("node")).when(below, 2 * F.col("node")).otherwise(2 * F.col("node") + 1)
        )
        rows = stored(moved.drop("dim", "cut", "at"), f"{path}/rows{level + 1}")
        drop_path(spark, f"{path}/rows{level}")
        half = F.expr("k div 2")
        child = F.array(
            F.struct((2 * F.col("node")).alias("node"), F.col("first"), half.alias("k")),
            F.struct((2 * F.col("node") + 1).alias("node"), (F.col("first") + half).alias("first"), (F.col("k") - half).alias("k"))
        )
        nodes = nodes.select(F.explode(child).alias("c")).select("c.*")
        ends.append(nodes.filter("k = 1"))
    shards = ends[0]
    for e in ends[1:]:
        shards = shards.unionByName(e)
    return rows, cuts, shards.select("node", F.col("first").cast("int").alias("shard")), leaves


def kd_shards(points: DataFrame, dims: Sequence[str], leaves: int | None = None, target_bytes: int | None = None) -> DataFrame:
    """points with `shard` and `slot`, the row's gapless number in its shard from 0."""
    path = scratch(points.sparkSession)
    rows, _, shards, n = kd_tree(points, dims, leaves, target_bytes)
    # A shard is numbered in parts, each with an offset, so that no task orders a whole shard.
    parts = max(8, rows.count() // (NUMBERED * n) + 1)
    placed = rows.join(shards, "node").withColumn("\0part", F.pmod(F.xxhash64("id"), F.lit(parts)))
    placed = stored(placed.select(*points.columns, "shard", "\0part"), f"{path}/placed")
    counts = placed.groupBy("shard", "`\0part`").agg(F.count("*").alias("n"))
    before = W.partitionBy("shard").orderBy("`\0part`").rowsBetween(W.unboundedPreceding, -1)
    offsets = counts.select("shard", "`\0part`", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("\0offset"))
    order = W.partitionBy("shard", "`\0part`").orderBy("id", *dims)
    numbered = placed.withColumn("\0row", F.row_number().over(order)).join(offsets, ["shard", "\0part"])
    return numbered.withColumn("slot", (F.col("`\0offset`") + F.col("`\0row`") - 1).cast("long")).select(*points.columns, "shard", "slot")
