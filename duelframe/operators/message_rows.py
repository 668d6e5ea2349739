"""Pair extraction on message rows (P2-P4): no chat is gathered into one row or one task.

Input rows are messages: pair_id, side ('chosen' or 'rejected'), pos (0-based and dense in a
side), role, content.  Every aggregate has a partial step, and every join that meets message
rows is left to the planner, so that AQE can split a conversation of any length over tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def last_answers(rows: DataFrame) -> DataFrame:
    """pair_id, side, last_pos and answer of the last assistant message, the maximum of
    (pos, content); a side without one has no row."""
    last = F.max(F.when(F.col("role") == "assistant", F.struct("pos", "content"))).alias("_last")
    return (rows.groupBy("pair_id", "side").agg(last).where("_last IS NOT NULL")
            .select("pair_id", "side", F.col("_last.pos").alias("last_pos"), F.col("_last.content").alias("answer")))


def _message(side: str, also: Column | None = None) -> Column:
    on = F.col("side") == side
    return F.max(F.when(on if also is None else on & also, F.struct("role", "content")))


def by_position(rows: DataFrame, also: Column | None = None) -> DataFrame:
    """One row per (pair_id, pos) with the messages ``c`` and ``r`` of both sides (null where a side has
    none there); ``also`` limits the rows that count."""
    return rows.groupBy("pair_id", "pos").agg(_message("chosen", also).alias("c"), _message("rejected", also).alias("r"))


def _chars(m: str) -> Column:
    return F.coalesce(F.length(F.col(m)["content"]), F.lit(0)).cast("long")


def message_digest(pos: Column, m: Column) -> Column:
    """A number that stands for a message at its place; the sum over a chat does not depend on the
    order in which rows meet."""
    text = F.concat(pos.cast("string"), F.lit(":"), F.coalesce(m["role"], F.lit("")), F.lit(":"), F.coalesce(m["content"], F.lit("")))
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long")


def split_last_assistant(rows: DataFrame) -> DataFrame:
    """P2/P4 per pair: n_prompt_msgs, prompt_chars (contents joined by one character), chosen_chars and
    rejected_chars of the answers, prompt_same, and prompt_digest.  A side without an assistant
    message is all prompt and has no answer."""
    last = last_answers(rows).select(F.col("pair_id").alias("_pair"), F.col("side").alias("_side"), "last_pos")
    joined = (rows.join(last, (rows["pair_id"] == last["_pair"]) & (rows["side"] == last["_side"]), "left")
              .withColumn("_prompt", F.coalesce(F.col("pos") < F.col("last_pos"), F.lit(True)))
              .withColumn("_answer", F.coalesce(F.col("pos") == F.col("last_pos"), F.lit(False))))
    at = joined.groupBy("pair_id", "pos").agg(
        _message("chosen", F.col("_prompt")).alias("c"), _message("rejected", F.col("_prompt")).alias("r"),
        _message("chosen", F.col("_answer")).alias("ca"), _message("rejected", F.col("_answer")).alias("ra"))
    n = F.count("c")
    return (at.groupBy("pair_id").agg(
        n.alias("n_prompt_msgs"), (F.sum(_chars("c")) + F.greatest(n - 1, F.lit(0))).alias("prompt_chars"),
        F.max(F.length("ca.content")).cast("long").alias("chosen_chars"),
        F.max(F.length("ra.content")).cast("long").alias("rejected_chars"),
        F.bool_and(F.col("c").eqNullSafe(F.col("r"))).alias("prompt_same"),
        F.coalesce(F.sum(F.when(F.col("c").isNotNull(), message_digest(F.col("pos"), F.col("c")))), F.lit(0)).alias("prompt_digest")))


def common_prefix(rows: DataFrame) -> DataFrame:
    """P3 per pair: prefix_len, the first position where the sides differ (if one side is the start of
    the other, its last message counts as an answer), and what lies after it on each side."""
    at = by_position(rows)
    both = F.col("c").isNotNull() & F.col("r").isNotNull()
    ends = at.groupBy(F.col("pair_id").alias("_pair")).agg(
        F.min(F.when(both & ~F.col("c").eqNullSafe(F.col("r")), F.col("pos"))).alias("_differs"),
        F.count("c").alias("_nc"), F.count("r").alias("_nr"),
        F.max(F.when(F.col("c.role") == "assistant", F.col("pos"))).alias("_last"))
    k = F.coalesce("_differs", F.greatest(F.least("_nc", "_nr") - 1, F.lit(0))).cast("long")
    ends = ends.select("_pair", k.alias("prefix_len"), "_nc", "_nr", F.coalesce("_last", F.col("_nc")).alias("_split"))
    rest = F.col("_nc") - F.col("prefix_len")
    return (at.join(ends, at["pair_id"] == ends["_pair"])
            .groupBy("pair_id", "prefix_len", "_nc", "_nr", "_split")
            .agg(F.sum(F.when(F.col("pos") >= F.col("prefix_len"), _chars("c"))).alias("_chars"))
            .select("pair_id", "prefix_len", rest.alias("chosen_rest_msgs"), (F.col("_nr") - F.col("prefix_len")).alias("rejected_rest_msgs"),
                    (F.coalesce("_chars", F.lit(0)) + F.greatest(rest - 1, F.lit(0))).alias("chosen_rest_chars"),
                    (F.col("prefix_len") == F.col("_split")).alias("agrees_with_last_assistant")))
