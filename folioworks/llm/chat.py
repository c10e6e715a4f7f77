"""Collapse logged snapshots of conversations and render those that remain."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def hashed_turns(turns: DataFrame) -> DataFrame:
    """conv_id, turn position, prefix hashes p1 and p2 up to that turn, and the turn's role and text digest.

    A prefix hash is the XOR of hashes of (position, role, digest of the text) over the turns so far, twice with
    different salts: 128 bits that roll from turn to turn and depend on the order.
    """
    rows = turns.where(F.col("conv_id").isNotNull()).select(
        "conv_id",
        "turn",
        F.coalesce("role", F.lit("")).alias("role"),
        F.md5(F.coalesce("text", F.lit(""))).alias("digest"),
    )
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "digest")
    so_far = order.rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("position", F.row_number().over(order).cast("long"))
    for name, salt in (("p1", 1), ("p2", 2)):
        one = F.xxhash64(F.lit(salt), "position", "role", "digest")
        rows = rows.withColumn(name, F.bit_xor(one).over(so_far))
    return rows


def maximal_conversations(turns: DataFrame) -> DataFrame:
    """conv_id, n_turns, n_equal of every conversation that begins no longer one; of equal ones the smallest id.

    Rolling prefix hashes make each turn of a conversation the name of a beginning. Equal conversations merge by
    (length, hash) on the tasks first; the beginnings shorter than their conversation are made distinct the same way,
    so a first turn that all conversations share is one row a task. An anti-join keeps what is no such beginning.
    """
    rows = hashed_turns(turns)
    length = F.count("*").over(Window.partitionBy("conv_id"))
    rows = rows.withColumn("n_turns", length)
    whole = rows.where("position = n_turns").groupBy("n_turns", "p1", "p2")
    whole = whole.agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_equal"))
    begins = rows.where("position < n_turns").select(F.col("position").alias("n_turns"), "p1", "p2").distinct()
    return whole.join(begins, ["n_turns", "p1", "p2"], "left_anti").select("conv_id", "n_turns", "n_equal")


def chat_format(turns: DataFrame) -> DataFrame:
    """Render every conversation that is not the beginning of a longer one.

    A conversation is the rows of a conv_id by (turn, role, md5 of the text); ties and repeated rows are turns of
    their own in that order, NULL turns come first, NULL role and text count and show as empty. Rows without a conv_id
    belong to no conversation. A conversation that begins a longer one is dropped; of equal ones the smallest id
    stays, and ``n_equal`` tells their number. Empty tables give no rows; other columns are not read.

    Returns conv_id, n_turns, n_equal, rendered: ``<|role|>``, newline, text, newline for each turn. A rendered
    conversation is one string, so its own length, not the table's, bounds what a task holds for it.
    """
    kept = maximal_conversations(turns)
    body = turns.where(F.col("conv_id").isNotNull()).select(
        "conv_id",
        F.col("turn").alias("turn"),
        F.coalesce("role", F.lit("")).alias("role"),
        F.coalesce("text", F.lit("")).alias("text"),
    )
    turn = F.struct("turn", "role", F.md5("text").alias("digest"), "text")
    shown = body.join(kept.select("conv_id"), "conv_id", "left_semi").groupBy("conv_id").agg(
        F.sort_array(F.collect_list(turn)).alias("turns")
    )
    line = F.transform("turns", lambda t: F.concat(F.lit("<|"), t["role"], F.lit("|>\n"), t["text"], F.lit("\n")))
    shown = shown.select("conv_id", F.array_join(line, "").alias("rendered"))
    return kept.join(shown, "conv_id").select("conv_id", "n_turns", "n_equal", "rendered")
