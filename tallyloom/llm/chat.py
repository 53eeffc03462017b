"""Multi-party perspective rotation of dialogues, in DataFrame functions only.

For every participant the whole dialogue is rendered with that speaker as the assistant, the
others as named users, and a mask that is 1 on the assistant's text. The result has a row for
each turn and perspective: the turn's rendered segment and its place [start, stop) in the
rendered dialogue, which is the segments in order. So a dialogue is never collected into one
row, however long. The rows are turns x participants of the dialogue, as the method asks.

Speakers named in `narrators` (system) are no participants: their turns stay as they are, with
mask 0, in every perspective; a dialogue of narrators only gives no rows. A null or empty
speaker is the participant "unknown"; a null text is empty. Turns are ordered by turn (null
first), then speaker and text; repeated rows are repeated turns. Null dialogue ids are one
dialogue. Empty tables give none; columns besides the four are not read.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

OPEN, BREAK, CLOSE = "<|im_start|>", "\n", "<|im_end|>\n"
#: Turns of a dialogue whose places are summed by one task.
BLOCK = 256


def rotated(
    df: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", speaker_col: str = "role", text_col: str = "text", narrators: Sequence[str] = ("system",), block: int = BLOCK
) -> DataFrame:
    """conv_id, perspective, turn, speaker, chat_role, segment, mask_start, mask_stop, start, stop, mask."""
    speaker = F.coalesce(F.nullif(F.col(f"`{speaker_col}`"), F.lit("")), F.lit("unknown"))
    turns = df.select(
        F.col(f"`{id_col}`").alias("conv_id"),
        F.col(f"`{turn_col}`").alias("turn"),
        speaker.alias("speaker"),
        F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"),
    )
    narrating = F.col("speaker").isin(*narrators)
    people = turns.filter(~narrating).select("conv_id", F.col("speaker").alias("perspective")).distinct()
    same = F.col("t.conv_id").eqNullSafe(F.col("p.conv_id"))
    out = turns.alias("t").join(people.alias("p"), same).select("t.*", "p.perspective")
    role = F.when(narrating, F.col("speaker")).when(F.col("speaker") == F.col("perspective"), F.lit("assistant")).otherwise(F.lit("user"))
    out = out.withColumn("chat_role", role).withColumn("mask", (F.col("chat_role") == "assistant").cast("int") * (~narrating).cast("int"))
    name = F.when(F.col("chat_role") == "user", F.concat(F.lit(" name="), "speaker")).otherwise(F.lit(""))
    out = out.withColumn("head", F.concat(F.lit(OPEN), F.col("chat_role"), name, F.lit(BREAK)))
    out = out.withColumn("segment", F.concat("head", "text", F.lit(CLOSE))).withColumn("length", F.length("segment").cast("long"))
    # Places: running sums in blocks of turns, then of the blocks, so that a long dialogue is split.
    out = out.withColumn("block", F.coalesce(F.floor(F.col("turn") / block), F.lit(-(2**62))).cast("long"))
    sums = out.groupBy("conv_id", "perspective", "block").agg(F.sum("length").alias("length"))
    before = W.partitionBy("conv_id", "perspective").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    heads = sums.select("conv_id", "perspective", "block", F.coalesce(F.sum("length").over(before), F.lit(0)).alias("offset"))
    run = W.partitionBy("conv_id", "perspective", "block").orderBy(F.col("turn").asc_nulls_first(), "speaker", "text")
    out = out.withColumn("stop", F.sum("length").over(run.rowsBetween(W.unboundedPreceding, 0)))
    here = same & (F.col("t.perspective") == F.col("p.perspective")) & (F.col("t.block") == F.col("p.block"))
    placed = out.alias("t").join(heads.alias("p"), here).select("t.*", "p.offset")
    start = F.col("offset") + F.col("stop") - F.col("length")
    spoken = start + F.length("head")
    return placed.select(
        "conv_id", "perspective", "turn", "speaker", "chat_role", "segment", "mask",
        start.alias("start"), (start + F.col("length")).alias("stop"),
        spoken.alias("mask_start"), (spoken + F.length("text")).alias("mask_stop"),
    )


def dialogues(df: DataFrame) -> DataFrame:
    """Rendered dialogues, one row a perspective, from rotated(); for dialogues that fit one row."""
    parts = F.array_sort(F.collect_list(F.struct("start", "segment", "mask", "mask_start", "mask_stop")))
    rows = df.groupBy("conv_id", "perspective").agg(parts.alias("parts"))
    spans = F.transform(F.filter("parts", lambda p: p["mask"] == 1), lambda p: F.struct(p["mask_start"], p["mask_stop"]))
    return rows.select("conv_id", "perspective", F.array_join(F.transform("parts", lambda p: p["segment"]), "").alias("text"), spans.alias("spans"))
