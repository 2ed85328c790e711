"""Chat formatting by rotating the perspective.

For every participant of a conversation the dialogue is rendered once with that speaker
as ``assistant`` and the others as named ``user``; the mask marks what the assistant
says. Speakers are the distinct values of ``role``; ``system`` turns are instructions
and no participant's.

Defined cases: a null role is the speaker ``unknown``, a null text is empty, and a null
``conv_id`` is a conversation of its own. Turns are ordered by turn (null first), then
role, then text, so ties and repeated rows are kept in a fixed order. The marker ``<|``
within a text or name is written ``< |``, so no text can end its own turn. A
conversation of system turns alone has no participant and no row; an empty table gives
no row. Other columns are ignored. Turns are numbered in pieces by their number, so those of
one conversation whose turns are all null or equal are sorted together in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Fixed values of the rendered form.
BEGIN, END = "<|im_start|>", "<|im_end|>\n"
SYSTEM, UNKNOWN = "system", "unknown"
PIECE = 1024


def _safe(text: Column) -> Column:
    return F.replace(text, F.lit("<|"), F.lit("< |"))


def rotated_turns(conversations: DataFrame) -> DataFrame:
    """A row for each conversation, perspective and turn, with its rendered segment.

    ``conv_id, perspective, seq, role, segment, start, body_start, end, trained``;
    positions are code points in the rendered dialogue, from 0, end exclusive.

    Positions are running sums. To number and sum a very long conversation without one
    task holding all of it, turns are first gathered by ``PIECE`` turn numbers, whose
    totals (one row for each) are summed up before the turns within a piece.
    """
    turns = conversations.select(
        "conv_id",
        F.col("turn").cast("long").alias("turn"),
        F.coalesce("role", F.lit(UNKNOWN)).alias("role"),
        F.coalesce("text", F.lit("")).alias("text"),
    ).withColumn("piece", F.floor(F.col("turn") / PIECE))
    views = (
        turns.filter(F.col("role") != SYSTEM)
        .select(F.col("conv_id").alias("view_of"), F.col("role").alias("perspective"))
        .distinct()
    )
    role, mine = F.col("role"), F.col("role") == F.col("perspective")
    head = (
        F.when(role == SYSTEM, F.lit(f"{BEGIN}system\n"))
        .when(mine, F.lit(f"{BEGIN}assistant\n"))
        .otherwise(F.concat(F.lit(f"{BEGIN}user name="), _safe(role), F.lit("\n")))
    )
    rows = (
        turns.join(views, F.col("conv_id").eqNullSafe(F.col("view_of")))
        .withColumn("head", head)
        .withColumn("segment", F.concat("head", _safe(F.col("text")), F.lit(END)))
        .withColumn("length", F.length("segment"))
        .withColumn("head_length", F.length("head"))
    )
    totals = rows.groupBy("conv_id", "perspective", "piece").agg(
        F.count("*").alias("piece_turns"), F.sum("length").alias("piece_length")
    )
    before = Window.partitionBy("conv_id", "perspective").orderBy("piece")
    before = before.rowsBetween(Window.unboundedPreceding, -1)
    bases = totals.select(
        F.col("conv_id").alias("b_conv"),
        F.col("perspective").alias("b_view"),
        F.col("piece").alias("b_piece"),
        F.coalesce(F.sum("piece_turns").over(before), F.lit(0)).alias("base_seq"),
        F.coalesce(F.sum("piece_length").over(before), F.lit(0)).alias("base_start"),
    )
    within = Window.partitionBy("conv_id", "perspective", "piece").orderBy(
        "turn", "role", "text"
    )
    placed = (
        rows.withColumn("in_piece", F.row_number().over(within))
        .withColumn("to_end", F.sum("length").over(within.rowsBetween(Window.unboundedPreceding, 0)))
        .join(
            bases,
            F.col("conv_id").eqNullSafe(F.col("b_conv"))
            & (F.col("perspective") == F.col("b_view"))
            & F.col("piece").eqNullSafe(F.col("b_piece")),
        )
        .withColumn("end", F.col("base_start") + F.col("to_end"))
        .withColumn("start", F.col("end") - F.col("length"))
    )
    return placed.select(
        "conv_id",
        "perspective",
        (F.col("base_seq") + F.col("in_piece") - 1).alias("seq"),
        "role",
        "segment",
        "start",
        (F.col("start") + F.col("head_length")).alias("body_start"),
        "end",
        mine.alias("trained"),
    )


def rotated_dialogues(conversations: DataFrame, part_chars: int = 1 << 20) -> DataFrame:
    """The rendered dialogues: ``conv_id, perspective, part, n_turns, text, mask``.

    A dialogue of up to ``part_chars`` characters is one row, part 0; a longer one goes
    on in further parts, each of the turns that start within the next ``part_chars``, so
    no task gathers more than that and one turn. ``mask`` lists the (start, end) of the
    assistant's text with its end marker, in code points of the part.
    """
    parts = rotated_turns(conversations).withColumn(
        "part", F.floor(F.col("start") / part_chars).cast("long")
    )
    item = F.struct("seq", "start", "body_start", "end", "segment", "trained")
    gathered = parts.groupBy("conv_id", "perspective", "part").agg(
        F.sort_array(F.collect_list(item)).alias("turns"), F.min("start").alias("first")
    )
    mask = F.transform(
        F.filter("turns", lambda t: t["trained"]),
        lambda t: F.struct(
            (t["body_start"] - F.col("first")).alias("start"),
            (t["end"] - F.col("first")).alias("end"),
        ),
    )
    return gathered.select(
        "conv_id",
        "perspective",
        "part",
        F.size("turns").cast("long").alias("n_turns"),
        F.array_join(F.transform("turns", lambda t: t["segment"]), "").alias("text"),
        mask.alias("mask"),
    )
