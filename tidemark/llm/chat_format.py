"""Multi-party perspective rotation. Native: no Python runs on the executors.

For every participant of a conversation the dialogue is rendered once with that speaker as the assistant and
the others as named users; the spans of the assistant's words are the loss mask. Speakers that are not
participants (``system``) keep their own role in every rendering.

A rendering is cut into segments of SEGMENT turns, so that neither a group nor a row grows with a conversation;
the segments in order, joined, are the whole rendering. ``<|`` in what a speaker says is escaped as ``<\\|`` (and
``<\\|`` as ``<\\\\|``, and so on), and ``|`` in a speaker's name as ``\\|``, so only the formatter writes marks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tidemark.llm.common import key_filter, marked, stored

#: Turns in one row of a rendering.
SEGMENT = 64
#: Turns with numbers of one block from which the block is ordered in parts, by turn, role and the text's beginning.
HOT_BLOCK, PREFIX = 4096, 32
#: Tasks that a conversation's segments are dealt to, at most, where they meet its speakers.
SALTS = 64
#: A backslash in a string of Spark SQL.
BACKSLASH = "\\\\"


def positions(turns: DataFrame) -> DataFrame:
    """(conv_id, pos, role, text): pos counts a conversation's turns from 0.

    Turns are ordered by (turn, role, text), nulls first. Positions come from two windows: inside blocks of
    SEGMENT turn numbers, and over the blocks' sizes; so no task orders a long conversation's texts. A block of
    many rows (turns that are null or repeat) is cut further by what they are ordered by.
    """
    rows = turns.select("conv_id", "turn", F.coalesce("role", F.lit("unknown")).alias("role"), F.coalesce("text", F.lit("")).alias("text"), F.floor(F.coalesce(F.col("turn"), F.lit(-1)) / SEGMENT).alias("block"))
    crowded = stored(rows.groupBy("conv_id", "block").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > HOT_BLOCK).select("conv_id", "block"))
    part = F.struct(F.lit(None).cast("long").alias("turn"), F.lit(None).cast("string").alias("role"), F.lit(None).cast("string").alias("start"))
    if crowded.isEmpty():
        rows = rows.withColumn("part", part)
    else:
        place = F.struct("conv_id", "block")
        rows = marked(rows, place, key_filter(crowded, place), "hot")
        finer = F.struct(F.col("turn").cast("long").alias("turn"), F.col("role").alias("role"), F.substring("text", 1, PREFIX).alias("start"))
        rows = rows.withColumn("part", F.when(F.col("hot"), finer).otherwise(part)).drop("hot")
    sizes = rows.groupBy("conv_id", "block", "part").agg(F.count(F.lit(1)).alias("n"))
    before = W.partitionBy("conv_id").orderBy("block", "part").rowsBetween(W.unboundedPreceding, -1)
    starts = sizes.select(F.col("conv_id").alias("c"), F.col("block").alias("b"), F.col("part").alias("p"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    inside = W.partitionBy("conv_id", "block", "part").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    placed = rows.withColumn("at", F.row_number().over(inside) - 1)
    same = F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("block") == F.col("b")) & F.col("part").eqNullSafe(F.col("p"))
    return placed.join(starts, same).select("conv_id", (F.col("start") + F.col("at")).cast("long").alias("pos"), "role", "text")


def rotate(turns: DataFrame, non_participants: tuple[str, ...] = ("system",)) -> DataFrame:
    """One row for each conversation, participant and segment.

    Returns conv_id, perspective, segment (from 0), n_turns, rendered, spans (array of start and end, in
    characters of ``rendered``: what the assistant says, its end mark included), n_loss_chars.
    A null role is the speaker ``unknown``, a null text is empty, a null conv_id is a conversation of its own
    kind. Repeated turns are rendered each. Control marks inside texts are escaped. Texts of any length are
    rendered whole. A conversation of non-participants only, or an empty table, gives no row. Further columns are
    not read.
    """
    placed = positions(turns)
    segments = (
        placed.groupBy("conv_id", F.floor(F.col("pos") / SEGMENT).cast("long").alias("segment"))
        .agg(F.sort_array(F.collect_list(F.struct("pos", "role", "text"))).alias("turns"))
        .withColumn("salt", F.expr(f"segment % {SALTS}"))
    )
    role = F.coalesce("role", F.lit("unknown"))
    spoken = turns.select(F.col("conv_id").alias("c"), role.alias("perspective")).groupBy("c", "perspective").agg(F.count(F.lit(1)).alias("n"))
    lengths = spoken.groupBy(F.col("c").alias("d")).agg(F.sum("n").alias("length"))
    speakers = spoken.join(lengths, F.col("c").eqNullSafe(F.col("d"))).where(~F.col("perspective").isin(*non_participants))
    dealt = speakers.select("c", "perspective", F.explode(F.expr(f"sequence(0L, least({SALTS}, ceil(length / {SEGMENT})) - 1)")).alias("s"))
    pairs = segments.join(dealt, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("salt") == F.col("s")))
    fixed = ", ".join("'%s'" % x.replace("'", "''") for x in non_participants) or "''"
    head = f"case when t.role = perspective then '<|assistant|>' when t.role in ({fixed}) then concat('<|', t.role, '|>') else concat('<|user:', replace(t.role, '|', '{BACKSLASH}|'), '|>') end"
    said = f"regexp_replace(t.text, '<({BACKSLASH}{BACKSLASH}*){BACKSLASH}|', '<$1{BACKSLASH}{BACKSLASH}|')"
    parts = pairs.select(
        "conv_id", "perspective", "segment", "turns",
        F.expr(f"transform(turns, t -> struct({head} as head, concat({said}, '<|end|>') as body, t.role = perspective as own))").alias("parts"),
    )
    starts = F.expr("transform(parts, (p, i) -> aggregate(slice(parts, 1, i), 0, (s, q) -> s + char_length(q.head) + char_length(q.body) + 1))")
    spans = F.expr("filter(transform(parts, (p, i) -> struct(if(p.own, starts[i] + char_length(p.head), -1) as start, starts[i] + char_length(p.head) + char_length(p.body) as end)), s -> s.start >= 0)")
    return (
        parts.withColumn("starts", starts).withColumn("spans", spans)
        .select(
            "conv_id", "perspective", "segment", F.size("turns").cast("long").alias("n_turns"),
            F.expr("array_join(transform(parts, p -> concat(p.head, p.body, '\\n')), '')").alias("rendered"),
            "spans", F.expr("aggregate(spans, 0L, (s, x) -> s + x.end - x.start)").alias("n_loss_chars"),
        )
    )
