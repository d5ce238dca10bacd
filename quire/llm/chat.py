"""Chat formatting by multi-party perspective rotation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


END = "<|end|>"
#: What stands for each character of a speaker's name that has a meaning in a header.
NAME_CODES = (("%", "%25"), ("|", "%7C"), ("<", "%3C"), (">", "%3E"), ("\n", "%0A"), ("\r", "%0D"))


def escape_text(text: Column) -> Column:
    """``<|`` in a text becomes ``<\\|`` (one backslash more where there are some), so that no text holds a marker."""
    return F.regexp_replace(text, r"<(\\*)\|", r"<\\$1|")


def escape_name(name: Column) -> Column:
    for char, code in NAME_CODES:
        name = F.replace(name, F.lit(char), F.lit(code))
    return name


def rotate_perspectives(
    turns: DataFrame,
    conv_col: str = "conv_id",
    turn_col: str = "turn",
    speaker_col: str = "role",
    text_col: str = "text",
    narrators: tuple[str, ...] = ("system",),
) -> DataFrame:
    """Render every dialogue once for each participant, who becomes the assistant.

    One row per (dialogue, perspective, turn), so that a dialogue of any length is spread
    over tasks: conv_id, perspective, turn, role, name, segment, mask_start, mask_end.
    Segments in order of (turn, name, segment), put together, are the rendered dialogue.

    * The perspective's own turns get role ``assistant``; the loss mask covers their text and
      end mark, as code point offsets [mask_start, mask_end) within the segment.
    * Other participants are named users: role ``user``, name the speaker; mask is empty (0, 0).
    * Speakers in ``narrators`` are never a perspective: their turns keep role ``system``.
    * Markers within a text and marker characters within a name are escaped, so a turn can forge neither a
      turn nor a part of the mask; the column name holds the name as it was.
    * A null or empty speaker is the participant ``unknown``; a null text is empty; repeated
      turns are rendered again; a null dialogue id is one dialogue of its own; a dialogue of
      narrators only has no perspective and no row. Other columns are ignored.
    """
    t = turns.select(
        F.col(conv_col).alias("conv_id"),
        F.col(turn_col).alias("turn"),
        F.when(F.coalesce(F.col(speaker_col), F.lit("")) == "", "unknown").otherwise(F.col(speaker_col)).alias("name"),
        escape_text(F.coalesce(F.col(text_col), F.lit(""))).alias("text"),
    )
    who = (
        t.where(~F.col("name").isin(*narrators))
        .select(F.col("conv_id").alias("c"), F.col("name").alias("perspective"))
        .distinct()
    )
    own, narrator = F.col("name") == F.col("perspective"), F.col("name").isin(*narrators)
    role = F.when(own, "assistant").when(narrator, "system").otherwise("user")
    head = F.concat(F.lit("<|"), role, F.when(role == "user", F.concat(F.lit(" name="), escape_name(F.col("name")))).otherwise(""), F.lit("|>\n"))
    return t.join(who, t["conv_id"].eqNullSafe(who["c"])).select(
        "conv_id",
        "perspective",
        "turn",
        role.alias("role"),
        "name",
        F.concat(head, F.col("text"), F.lit(END + "\n")).alias("segment"),
        F.when(own, F.length(head)).otherwise(0).alias("mask_start"),
        F.when(own, F.length(head) + F.length("text") + len(END)).otherwise(0).alias("mask_end"),
    )


def render_dialogues(rotated: DataFrame, part_turns: int | None = None) -> DataFrame:
    """(conv_id, perspective, part, n_turns, rendered, masks): the text of each perspective, and its loss masks.

    ``masks`` are code point spans [start, end) within ``rendered``. With ``part_turns`` a dialogue is cut by
    the numbers of its turns, floor(turn / part_turns), so one of any length is spread over tasks and rows; the parts
    in order, put together, are the dialogue. Without it every dialogue is one part, 0, for dialogues that fit in a row.
    Turns of equal number are in order of name and segment. A null turn number comes first, in part null.
    """
    part = F.lit(0).cast("long") if part_turns is None else F.floor(F.col("turn") / part_turns).cast("long")
    rows = rotated.withColumn("part", part).groupBy("conv_id", "perspective", "part").agg(
        F.sort_array(F.collect_list(F.struct("turn", "name", "segment", "mask_start", "mask_end"))).alias("s")
    )
    span = "array<struct<start:int,end:int>>"
    walk = F.aggregate(
        "s",
        F.struct(F.lit(0).alias("at"), F.array().cast(span).alias("m")),
        lambda a, x: F.struct(
            (a["at"] + F.length(x["segment"])).alias("at"),
            F.when(
                x["mask_end"] > 0,
                F.concat(a["m"], F.array(F.struct((a["at"] + x["mask_start"]).alias("start"), (a["at"] + x["mask_end"]).alias("end")))),
            )
            .otherwise(a["m"])
            .alias("m"),
        ),
    )
    return rows.select(
        "conv_id", "perspective", "part", F.size("s").alias("n_turns"), F.array_join(F.transform("s", lambda x: x["segment"]), "").alias("rendered"), walk["m"].alias("masks")
    )
