"""Connected components of a link table by large-star and small-star rounds."""

from __future__ import annotations

from itertools import count

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_path, scratch, stored


def _stars(links: DataFrame, large: bool) -> DataFrame:
    """One round: each node links its larger (large) or smaller (small) neighbours to its least neighbour.

    The least neighbour is an aggregate, made in part before the shuffle, and comes back by a
    join, which splits a hot node; no node's neighbours are ever collected.
    """
    if large:
        both = links.union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    else:
        both = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    joined = both.join(least, "a")
    if large:
        out = joined.filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        out = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b")))
    return out.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def components(links: DataFrame) -> DataFrame:
    """(node, component) for every node of links (a, b): component is the least node reachable.

    Links may repeat and point either way; self-links and nulls are dropped (a null link is
    none). Every round is written to the shared folder, so lost executors cost one round.
    """
    spark, path = links.sparkSession, scratch(links.sparkSession)
    links = links.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    links = stored(links, f"{path}/0")
    state = None
    for n in count(1):  # the square of the logarithm of a component's size, at most
        links = stored(_stars(_stars(links, True), False), f"{path}/{n}")
        drop_path(spark, f"{path}/{n - 1}")
        # A round that changes no link has every node at the least one it can reach.
        now = links.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == state or not now[0]:
            break
        state = now
    return links.select(F.col("a").alias("node"), F.col("b").alias("component")).union(
        links.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    )
