"""Derived input tables built from the given parquet tables.

Each builder is lazy and deterministic; the definitions are the ones the DuckDB
oracle queries restate in SQL.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from duelframe.functions.chat import message, split_last_assistant
from duelframe.operators.batching import with_row_index
from duelframe.sources.tables import read_table

# Fixed values of the fixtures (FIXTURES.md): conversations are paired inside blocks of
# 64 consecutive conversation ids; the metric log bins 10 steps.
PAIR_BLOCK = 64


def conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "conversations")


def chats_from_turns(turns: DataFrame, key: str = "conv_id", extra_keys: tuple[str, ...] = ()) -> DataFrame:
    """one row per conversation, messages sorted by turn.

    A chat is one training example (bounded by the model context), so gathering its
    messages into one array is the data model, not an unbounded collect.
    """
    grouped = (turns.groupBy(*extra_keys, key)
               .agg(F.sort_array(F.collect_list(F.struct("turn", "role", F.col("text").alias("content"))))
                    .alias("_m")))
    return grouped.select(*extra_keys, key,
                          F.transform("_m", lambda x: message(x.getField("role"), x.getField("content")))
                          .alias("messages"))


def chats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chats_from_turns(conversations(spark, sf_dir))


def pairs_raw(spark: SparkSession, sf_dir: str, block: int = PAIR_BLOCK, cross: bool = False) -> DataFrame:
    """(pair_id, chosen, rejected) chat arrays.

    Prompt = messages before the last assistant turn, chosen answer = that turn, rejected
    answer = the chosen answer of the next conversation inside the same block of ``block``
    conversation ids (wrapping to the block's first).  Rows are clustered by block once;
    the per-conversation aggregate and the block window both reuse that clustering, so
    the plan has a single exchange.  A block holds at most ``block`` conversations.
    """
    turns = conversations(spark, sf_dir).withColumn("block", F.expr(f"conv_id div {int(block)}"))
    ch = chats_from_turns(turns.repartition("block"), extra_keys=("block",))
    prompt, answer, found = split_last_assistant(F.col("messages"), on_missing="null")
    base = ch.select("block", F.col("conv_id").alias("pair_id"), prompt.alias("prompt_msgs"),
                     answer.alias("answer"), found.alias("found")).where("found")
    w = Window.partitionBy("block").orderBy("pair_id")
    other = F.struct("answer", "prompt_msgs") if cross else F.struct("answer")
    nxt = F.lead(other, 1).over(w)
    first = F.first(other).over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    of_other = F.coalesce(nxt, first)
    prompt = F.col("prompt_msgs")
    if cross:
        prompt = F.when(F.col("pair_id") % 3 == 0, prompt).otherwise(of_other.getField("prompt_msgs"))
    return base.select(
        "pair_id",
        F.concat("prompt_msgs", F.array(message("assistant", F.col("answer")))).alias("chosen"),
        F.concat(prompt, F.array(message("assistant", of_other.getField("answer")))).alias("rejected"))


def pair_messages(spark: SparkSession, sf_dir: str, block: int = PAIR_BLOCK, cross: bool = False) -> DataFrame:
    """F2 (F9 with ``cross``) as message rows: pair_id, side, pos, role, content; see ``messages_of``."""
    return messages_of(conversations(spark, sf_dir), block, cross)


def messages_of(turns: DataFrame, block: int = PAIR_BLOCK, cross: bool = False) -> DataFrame:
    """Pairs of conversations as message rows, without gathering a conversation.

    Only the last assistant turn of each conversation is aggregated.  The window over a block sees one
    narrow row per conversation and names the conversation whose rejected side this one gives (the
    one before it, cyclically).  A turn then goes to the sides that hold it in one explode."""
    last = (turns.where(F.col("role") == "assistant").groupBy("conv_id").agg(F.max("turn").alias("last"))
            .withColumn("block", F.expr(f"conv_id div {int(block)}")))
    w = Window.partitionBy("block").orderBy("conv_id")
    here = F.struct("conv_id", "last")
    before = F.coalesce(F.lag(here, 1).over(w), F.last(here).over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    named = last.withColumn("before", before).select(F.col("conv_id").alias("_conv"), "last", "before")
    t = turns.join(named, turns["conv_id"] == named["_conv"]).where("turn <= last")
    is_last = F.col("turn") == F.col("last")
    own = F.struct(F.col("conv_id").alias("pair_id"), F.lit("chosen").alias("side"), F.col("turn").cast("long").alias("pos"))
    before_id, before_last = F.col("before.conv_id"), F.col("before.last")
    keeps = F.lit(True) if not cross else F.col("conv_id") % 3 == 0          # this pair's rejected side has its own prompt
    gives = F.lit(False) if not cross else before_id % 3 != 0                # the pair before takes this prompt
    rejected = F.struct(F.col("conv_id").alias("pair_id"), F.lit("rejected").alias("side"), F.col("turn").cast("long").alias("pos"))
    given = F.struct(before_id.alias("pair_id"), F.lit("rejected").alias("side"),
                     F.when(is_last & ~gives, before_last).otherwise(F.col("turn")).cast("long").alias("pos"))
    sides = F.array(own, F.when(~is_last & keeps, rejected), F.when(is_last | gives, given))
    return (t.select(F.explode(F.filter(sides, lambda x: x.isNotNull())).alias("_s"), "role", F.col("text").alias("content"))
            .select("_s.pair_id", "_s.side", "_s.pos", "role", "content"))


def pair_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ids of F2 without its texts: conversations with an assistant turn."""
    turns = conversations(spark, sf_dir).where(F.col("role") == "assistant")
    return turns.select(F.col("conv_id").alias("pair_id")).distinct()


def pair_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(pair_id, row_idx): dense position in pair_id order; no text moves to number the rows."""
    return with_row_index(pair_ids(spark, sf_dir), ["pair_id"])


def pairs_indexed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F2 with ``row_idx`` = dense position in pair_id order (the dataset's positional index)."""
    return pairs_raw(spark, sf_dir).join(pair_index(spark, sf_dir), on="pair_id")


def pairs_cross(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F2 whose rejected side is the next conversation as a whole (its prompt and answer)
    unless 3 divides the id, which keeps F2's shared prompt: both outcomes of the prompt
    checks occur."""
    return pairs_raw(spark, sf_dir, cross=True)


# Number of ways in which F10 damages a pair, by pair_id modulo this.
DAMAGES = 9


def pairs_broken(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F2 damaged in the way that ``pair_id % 9`` names, so that every kind of
    validation error occurs: 1, 2 a side without messages; 3, 4 a side without its assistant
    turn; 5 both sides without a prompt; 6 another first message; 7 a null content; 8 equal
    answers; 0 whole."""
    k = F.col("pair_id") % DAMAGES
    c, r = F.col("chosen"), F.col("rejected")
    none = F.slice(c, F.lit(1), F.lit(0))

    def without_last(m):
        # only the last turn is an assistant turn that counts: earlier ones become user turns
        return F.transform(F.slice(m, F.lit(1), F.size(m) - 1), lambda x: message("user", x.getField("content")))

    def last(m):
        return F.slice(m, F.size(m), F.lit(1))

    null_first = F.concat(F.array(message("user", F.lit(None).cast("string"))), c)
    other_first = F.concat(F.array(message("user", F.lit("another question"))), r)
    return pairs_raw(spark, sf_dir).select(
        "pair_id",
        F.when(k == 1, none).when(k == 3, without_last(c)).when(k == 5, last(c)).when(k == 7, null_first).otherwise(c).alias("chosen"),
        F.when(k == 2, none).when(k == 4, without_last(r)).when(k == 5, last(r)).when(k == 6, other_first)
         .when(k == 8, c).otherwise(r).alias("rejected"))


def lineitem_logps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """four synthetic summed log-probs per lineitem row (no key)."""
    li = read_table(spark, sf_dir, "lineitem")
    q, d, t = F.col("l_quantity"), F.col("l_discount"), F.col("l_tax")
    return li.select((-q).alias("pc"), (-q * (F.lit(1.0) + d)).alias("pr"),
                     (-q * (F.lit(1.0) + t)).alias("rc"), (-q * (F.lit(1.0) + t / F.lit(2.0))).alias("rr"))


def logits_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """an embedding read as a logit vector, its label as the 0-based target."""
    e = read_table(spark, sf_dir, "embeddings")
    return e.select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("logits"),
                    F.col("label").alias("target"))


def feature_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """even vec_id = chosen features, vec_id + 1 = rejected features of pair vec_id div 2.

    Two rows per key meet in one aggregate; pairs missing a side are dropped.
    """
    e = read_table(spark, sf_dir, "embeddings")
    vec = F.transform("embedding", lambda x: x.cast("double"))
    even = (F.col("vec_id") % 2) == 0
    g = (e.select(F.expr("vec_id div 2").alias("pair_id"), even.alias("even"), vec.alias("v"))
         .groupBy("pair_id")
         .agg(F.first(F.when(F.col("even"), F.col("v")), ignorenulls=True).alias("phi_chosen"),
              F.first(F.when(~F.col("even"), F.col("v")), ignorenulls=True).alias("phi_rejected")))
    return g.where(F.col("phi_chosen").isNotNull() & F.col("phi_rejected").isNotNull())


def metric_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F8: events read as a training log.

    run_id = event_type, step = 1-based position by (ts, event_id) inside the run,
    tag = 'train/value', value = value.  Runs are few and large, so the step index
    comes from the distributed row-index operator, not a window over a whole run.
    """
    ev = read_table(spark, sf_dir, "events").select(
        F.col("event_type").alias("run_id"), "ts", "event_id", "value")
    idx = with_row_index(ev, ["ts", "event_id"], partition_by=["run_id"], name="_i",
                         key=["run_id", "ts", "event_id", "value"])   # narrow: carried, not joined back
    return idx.select("run_id", (F.col("_i") + F.lit(1)).alias("step"), "ts",
                      F.lit("train/value").alias("tag"), "value")
