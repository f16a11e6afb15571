"""Multi-party perspective rotation of conversations.

For every participant of a conversation the whole dialogue is rendered once
with that speaker as the assistant: its turns become assistant turns and carry
loss, all others become user turns that name their speaker.  System turns stay
system turns in every rendering.

The result is a row per rendered turn, with the span it has in the rendered
text, so that no conversation has to fit in one task: spans are running sums
over blocks of turns and then within a block.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

SYSTEM = ("system",)
BLOCK = 64


def rotate_perspectives(conversations: DataFrame, *, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", system: tuple[str, ...] = SYSTEM, block: int = BLOCK) -> DataFrame:
    """Rows conv_id, perspective, turn, seq, chat_role, speaker, segment, in_loss, seg_start, seg_end, loss_start, loss_end.

    segment is `<|role|>text<|end|>\\n`, for users `<|user name=speaker|>…`.
    seq counts from 0 in the order of turn, then role, then text; spans are code
    points in the concatenation of the segments, the end exclusive; loss spans
    cover text and `<|end|>` of the assistant's turns and are null elsewhere.
    A null role is the speaker "unknown", a null text is empty, a null turn
    comes first.  Rows that repeat are turns of their own.  A conversation of
    system turns only has no participant and no rows.  Other columns are left out.
    """
    rows = conversations.select(
        F.col(conv_id).alias("conv_id"), F.col(turn).alias("turn"), F.coalesce(F.col(role).cast("string"), F.lit("unknown")).alias("speaker"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("t")
    ).withColumn("block", F.floor(F.coalesce(F.col("turn"), F.lit(-1)) / block))
    own = ~F.col("speaker").isin(*system)
    who = rows.filter(own).select(F.col("conv_id").alias("c"), F.col("speaker").alias("perspective")).distinct()
    seen = rows.join(who, F.col("conv_id").eqNullSafe(F.col("c"))).drop("c")
    mine = F.col("speaker") == F.col("perspective")
    chat_role = F.when(~own, "system").when(mine, "assistant").otherwise("user")
    head = F.concat(F.lit("<|"), chat_role, F.when(own & ~mine, F.concat(F.lit(" name="), F.col("speaker"))).otherwise(""), F.lit("|>"))
    seen = seen.withColumns({"chat_role": chat_role, "head": F.length(head), "segment": F.concat(head, F.col("t"), F.lit("<|end|>\n"))}).withColumn("len", F.length("segment").cast("long"))
    key = ["conv_id", "perspective"]
    upto = Window.partitionBy(*key).orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = seen.groupBy(*key, "block").agg(F.sum("len").alias("l"), F.count("*").alias("n"))
    blocks = blocks.select(F.col("conv_id").alias("c"), F.col("perspective").alias("p"), F.col("block").alias("b"), F.coalesce(F.sum("l").over(upto), F.lit(0)).alias("l0"), F.coalesce(F.sum("n").over(upto), F.lit(0)).alias("n0"))
    inside = Window.partitionBy(*key, "block").orderBy("turn", "speaker", "t")
    seen = seen.withColumns({"i": F.row_number().over(inside), "l1": F.sum("len").over(inside.rowsBetween(Window.unboundedPreceding, 0))})
    out = seen.join(blocks, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("perspective") == F.col("p")) & (F.col("block") == F.col("b")))
    loss = F.col("chat_role") == "assistant"
    end = F.col("l0") + F.col("l1")
    return out.select(
        "conv_id", "perspective", "turn", (F.col("n0") + F.col("i") - 1).alias("seq"), "chat_role", "speaker", "segment", loss.alias("in_loss"),
        (end - F.col("len")).alias("seg_start"), end.alias("seg_end"),
        F.when(loss, end - F.col("len") + F.col("head")).alias("loss_start"), F.when(loss, end - 1).alias("loss_end"),
    )
