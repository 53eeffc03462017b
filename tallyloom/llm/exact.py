"""Exact duplicates: rows grouped by a 128-bit content hash, bytes compared inside the groups.

Texts are equal when identical after their blanks (space, \\x09 to \\x0D) are deleted. One scan
makes a slim table: a row's id, its text's code points, the SHA-256 of its normalised text
(whose first 128 bits are the content hash) and a row number. Groups are aggregates of the slim
table, made in part before the shuffle. A second scan compares bytes: it groups the normalised
texts themselves within their hashes, so map tasks send each text they hold once, however many
copies there are, and a hash with more than one text is a collision. Rows of collided hashes
(usually none) are grouped by their bytes instead. No group is ever collected or sent to one task:
a group of over a HOT-th of the rows (fewer than HOT of them) comes to its rows by a broadcast, the
rest by a join.

Of equal texts the row with the most code points in its original text stays (`longest`), then the
smallest id, then the least hash of the original text. Null texts count as empty, and empty and
blank texts are equal to each other. A null id comes after all others. Of rows that repeat id
and text exactly one stays. An empty table gives an empty result. Further columns are left out
unless carried, whatever their names.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BLANKS, quoted, scratch, stored

#: Bits of the content hash, and the share of the rows (one HOT-th) from which a group is hot.
BITS, HOT = 128, 10_000


def normalised(text: Column) -> Column:
    """A text without its blanks; null gives the empty text."""
    return F.translate(F.coalesce(text, F.lit("")), " " + BLANKS, "")


def content_hash(digest: Column, bits: int = BITS) -> Column:
    """The first bits (a multiple of 8) of a binary digest."""
    return F.substring(digest, 1, bits // 8)


def collided(texts: DataFrame) -> DataFrame:
    """The hashes (key) that more than one text has: texts are grouped by their bytes, in part before the shuffle."""
    counts = texts.groupBy("key", "text").agg(F.count("*").alias("n")).groupBy("key").agg(F.count("*").alias("n"))
    return counts.filter("n > 1").select("key")


def _spread(rows: DataFrame, groups: DataFrame, total: int) -> DataFrame:
    """rows with the columns of their group (key, cls, group_size, ...): hot groups by a broadcast, others by a join.

    Groups of collided hashes have their text as cls, so they aren't broadcast.
    """
    hot = (F.col("group_size") * HOT > total) & (F.col("cls") == "")
    few = groups.filter(hot)  # fewer than HOT
    near = rows.join(F.broadcast(few), ["key", "cls"])
    far = rows.join(F.broadcast(few.select("key", "cls")), ["key", "cls"], "left_anti").join(groups.filter(~hot), ["key", "cls"])
    return near.unionByName(far)


def exact_duplicates(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", longest: bool = True, bits: int = BITS, carry: Sequence[str] = ()
) -> DataFrame:
    """A row for each row of df: id, keep_id (the id of the row that stays), group_size, kept, text_sha256.

    carry: further columns of df to take along, as a struct `carried`. bits: length of the
    content hash; shorter ones have more collisions and give the same result.
    """
    path = scratch(df.sparkSession)
    whole = F.coalesce(quoted(text_col), F.lit(""))
    text = normalised(whole)
    digest = F.unhex(F.sha2(text, 256))
    also = [F.struct(*map(quoted, carry)).alias("carried")] if carry else []
    slim = [
        content_hash(digest, bits).alias("key"), quoted(id_col).alias("id"), (F.length(whole) if longest else F.lit(0)).alias("chars"),
        F.xxhash64(whole).alias("own"), digest.alias("digest"), F.monotonically_increasing_id().alias("row"), *also,
    ]
    rows = stored(df.select(*slim, F.lit("").alias("cls")), f"{path}/rows")
    clashes = stored(collided(df.select(text.alias("text"), content_hash(digest, bits).alias("key"))), f"{path}/collided")
    total = rows.count()
    if not clashes.isEmpty():  # their rows are read once more, with their texts
        again = stored(df.select(*slim, text.alias("cls")).join(clashes, "key", "left_semi"), f"{path}/again")
        rows = rows.join(clashes, "key", "left_anti").unionByName(again)
    first = F.struct((-F.col("chars")).alias("less"), F.col("id").isNull().alias("none"), "id", "own", "row")
    groups = rows.groupBy("key", "cls").agg(F.count("*").alias("group_size"), F.min(first).alias("first"))
    groups = stored(groups.select("key", "cls", "group_size", F.col("first.id").alias("keep_id"), F.col("first.row").alias("keep_row")), f"{path}/groups")
    kept = (F.col("row") == F.col("keep_row")).alias("kept")
    return _spread(rows, groups, total).select("id", "keep_id", "group_size", kept, F.lower(F.hex("digest")).alias("text_sha256"), *(["carried"] if carry else []))
