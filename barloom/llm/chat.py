"""Multi-party perspective rotation of dialogues; DataFrame functions only.

For every participant the whole dialogue is rendered once more, with that speaker as the assistant and
the others as named users.  A rendering is a run of segments, one for each turn, with their bounds in
the rendered text and a mask of what is trained on.  Segments stay rows, so a dialogue with a third
of all turns fills no task: bounds are summed over blocks of turns first, then within a block.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: What a name must not hold, since it ends or splits a header, and how it is written there
_ESCAPES = {"%": "%25", " ": "%20", "\t": "%09", "\n": "%0A", "\x0b": "%0B", "\f": "%0C", "\r": "%0D", "<": "%3C"}
#: Parts in which a dialogue's turns meet its participants
SALTS = 16
_OPEN, _CLOSE, _END = "<|im_start|>", "<|im_end|>", "\n"


def _clean(text: Column) -> Column:
    """The text, with the marks of the template made harmless."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"<\|(im_start|im_end)\|>", "<| $1 |>")


def _name(speaker: Column) -> Column:
    """A speaker as a header writes it: one name for each speaker, without white space or marks of the template."""
    for char, escape in _ESCAPES.items():
        speaker = F.replace(speaker, F.lit(char), F.lit(escape))
    return speaker


def rotate(turns: DataFrame, system: str = "system", block: int = 256) -> DataFrame:
    """Render each dialogue of turns (conv_id, turn, role, text) from every participant's view.

    A participant is a distinct role of the dialogue other than `system`, which stays context in every view.
    One row for each turn and view: conv_id, perspective, turn, speaker, role (assistant, user or system), segment,
    start and end (code points in the view's rendered text), mask_start and mask_end (the trained
    part: the perspective's own words and their closing mark; equal bounds, at the end, for other turns).
    Segments in order of turn (null first), then speaker, then text, joined, are the rendered
    dialogue.  A null text is empty; a null role is the speaker "unknown"; a null conv_id is one
    dialogue; repeated turns are kept, each with bounds of its own.  A dialogue of system turns alone has no view.
    Headers name speakers with white space, "%" and "<" percent-encoded, so that no role breaks a header and no two
    share a name.  Texts of any length are kept whole; an empty table gives no rows.  Other columns are ignored.
    """
    rows = turns.select("conv_id", "turn", F.coalesce("role", F.lit("unknown")).alias("speaker"), _clean(F.col("text")).alias("said"), F.pmod(F.xxhash64("turn", "text"), F.lit(SALTS)).cast("int").alias("salt"))
    views = rows.where(F.col("speaker") != system).select(F.col("conv_id").alias("c"), F.col("speaker").alias("perspective")).distinct()
    views = views.withColumn("s", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    seen = rows.join(views, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("salt") == F.col("s"))).drop("c", "salt", "s")
    role = F.when(F.col("speaker") == system, F.lit("system")).when(F.col("speaker") == F.col("perspective"), F.lit("assistant")).otherwise(F.lit("user"))
    name = F.when(role == "user", F.concat(F.lit(" name="), _name(F.col("speaker")))).otherwise(F.lit(""))
    head = F.concat(F.lit(_OPEN), role, name, F.lit("\n"))
    seen = seen.select("conv_id", "perspective", "turn", "speaker", role.alias("role"), F.char_length(head).alias("head"), F.concat(head, "said", F.lit(_CLOSE + _END)).alias("segment"), F.coalesce(F.floor(F.col("turn") / block), F.lit(-(2**60))).alias("block"))
    size = F.char_length("segment").cast("long")
    blocks = seen.groupBy("conv_id", "perspective", "block").agg(F.sum(size).alias("block_size"))
    before = F.sum("block_size").over(Window.partitionBy("conv_id", "perspective").orderBy("block")) - F.col("block_size")
    starts = blocks.select(F.col("conv_id").alias("c"), F.col("perspective").alias("p"), F.col("block").alias("b"), before.alias("before"))
    placed = seen.join(starts, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("perspective") == F.col("p")) & (F.col("block") == F.col("b")))
    inside = Window.partitionBy("c", "p", "b").orderBy(F.col("turn").asc_nulls_first(), "speaker", "segment").rowsBetween(Window.unboundedPreceding, 0)
    placed = placed.withColumn("end", F.col("before") + F.sum(size).over(inside)).withColumn("start", F.col("end") - size)
    own = F.col("role") == "assistant"
    return placed.select(
        "conv_id", "perspective", "turn", "speaker", "role", "segment", "start", "end",
        F.when(own, F.col("start") + F.col("head")).otherwise(F.col("end")).alias("mask_start"),
        F.when(own, F.col("end") - len(_END)).otherwise(F.col("end")).alias("mask_end"),
    )


def assemble(segments: DataFrame) -> DataFrame:
    """One row for each dialogue and view: conv_id, perspective, text, and masks, the trained spans.

    A view becomes one value here, so use this on dialogues that fit in one; rotate() has no such bound.
    """
    parts = F.sort_array(F.collect_list(F.struct("start", "end", "segment", "mask_start", "mask_end")))
    masks = F.transform(F.filter("parts", lambda x: x.mask_start < x.mask_end), lambda x: F.struct(x.mask_start.alias("start"), x.mask_end.alias("end")))
    return segments.groupBy("conv_id", "perspective").agg(parts.alias("parts")).select("conv_id", "perspective", F.concat_ws("", "parts.segment").alias("text"), masks.alias("masks"))
