"""Chat formatting with collapse of cumulative snapshots."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Rendering of one turn.
TURN = ("<|", "|>\n", "\n<|end|>\n")


def format_chats(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """Renders every conversation that no longer or equal logged conversation already contains.

    Turns get a rolling hash: the xor of two independent 64-bit hashes of (place in the conversation, role, text)
    over all turns up to this one, so equal hashes mean equal turn prefixes (128 bits). A conversation whose last
    hash occurs as the hash of a shorter prefix of another is a snapshot and goes by an anti-join against the
    distinct prefixes; of equal conversations the smallest id stays. Hashes are aggregated before they are shuffled
    for the joins, so a first turn that every conversation shares is one row.

    Returns conv_id, n_turns, n_same (equal conversations, itself included), n_chars and chat, one row per kept
    conversation. Turns are ordered by turn number, role and text; null turn numbers come first; null roles and texts
    are rendered as empty but a null differs from an empty string; a repeated row is a turn of its own. Rows with a
    null conversation id make one conversation. Empty tables give no rows; other columns are ignored.
    """
    role, text = F.coalesce(F.col("role"), F.lit("")), F.coalesce(F.col("text"), F.lit(""))
    given = turns.select(F.col(conv_col).alias("conv"), F.col(turn_col).alias("turn"), F.col(role_col).alias("role"), F.col(text_col).alias("text"))
    order = Window.partitionBy("conv").orderBy("turn", "role", "text")
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    placed = given.withColumn("place", F.row_number().over(order))
    marks = [F.xxhash64(F.lit(salt), "place", F.col("role").isNull(), "role", F.col("text").isNull(), "text") for salt in ("a", "b")]
    rolled = placed.select(
        "conv",
        "place",
        *(F.bit_xor(m).over(upto).alias(f"h{i}") for i, m in enumerate(marks)),
        F.count("*").over(Window.partitionBy("conv")).alias("n"),
    )
    ends = rolled.where("place = n").select("conv", "n", "h0", "h1")
    inner = rolled.where("place < n").select(F.col("place").alias("n"), "h0", "h1").distinct()
    alone = ends.groupBy("n", "h0", "h1").agg(F.min("conv").alias("conv"), F.count("*").alias("n_same"))
    kept = alone.join(inner, ["n", "h0", "h1"], "left_anti").select(F.col("conv").alias("kept_conv"), "n_same")
    line = F.concat(F.lit(TURN[0]), role, F.lit(TURN[1]), text, F.lit(TURN[2]))
    rendered = (
        given.join(kept, F.col("conv").eqNullSafe(F.col("kept_conv")))
        .groupBy("conv", "n_same")
        .agg(F.array_sort(F.collect_list(F.struct("turn", F.struct("role", "text").alias("raw"), line.alias("line")))).alias("all"))
    )
    chat = F.array_join(F.col("all.line"), "")
    return rendered.select(F.col("conv").alias(conv_col), F.size("all").cast("long").alias("n_turns"), "n_same", chat.alias("chat")).withColumn("n_chars", F.length("chat").cast("long"))
