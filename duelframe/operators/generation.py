"""Generation comparison (G1, G2) as corpus batch jobs.

Greedy continuation under a bigram model is a walk on the word -> most-likely-next-word
map.  The map is one grouped aggregate; the walks are doubled by joins of the map with
itself, with lineage cut at every doubling by a table in the shared checkpoint folder.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from duelframe.operators.scoring import BigramModel
from duelframe.session import materialize


def prompt_grid(prompts: DataFrame, model_ids: Sequence[str]) -> DataFrame:
    """G1: every prompt under every model.  The model list is a driver-side list of ids."""
    spark = prompts.sparkSession
    models = spark.createDataFrame([(m,) for m in model_ids], "model_id string")
    return prompts.crossJoin(F.broadcast(models))


def next_word_table(model: BigramModel, model_ids: Sequence[str] | None = None) -> DataFrame:
    """Top-1 next word per (model, prev): highest count, ties to the smaller word.

    One grouped aggregate over the bigram counts computes every model's argmax as its own
    column (a min over (-count, word)); it stays a partial aggregate, so a very frequent
    context word does not pile into one task the way a ranking window would.
    """
    ids = list(model_ids or model.model_ids)
    best = model.bigrams.groupBy("prev").agg(*[
        F.min(F.when(F.col(f"c_{m}") > 0, F.struct((-F.col(f"c_{m}")).alias("nc"), F.col("w")))).alias(f"b_{m}")
        for m in ids])
    longf = F.inline(F.array(*[F.struct(F.lit(m).alias("model_id"), F.col(f"b_{m}.w").alias("next_word"))
                               for m in ids]))
    return best.select("prev", longf).where(F.col("next_word").isNotNull()).select("model_id", "prev", "next_word")


# A pass over the map that leaves more than this share of its words is the last one, as is the eighth.
WORTHWHILE, PASSES = 0.5, 8


def _walked(on: DataFrame, starts: DataFrame) -> DataFrame:
    """The map (model_id, word, there) without words that no walk comes to: a walk is at a start or at
    a word that follows another one of the map.  Most words of a corpus follow none as its likeliest next
    word, so a pass leaves a fraction; each pass looks only at the words that the last one left."""
    n = on.count()
    for _ in range(PASSES):
        keep = starts.unionByName(on.select("model_id", F.col("there").alias("word"))).distinct()
        on = materialize(on.join(keep, on=["model_id", "word"], how="left_semi"), "greedy-map")
        before, n = n, on.count()
        if n > WORTHWHILE * before:
            break
    return on


def greedy_extend(seeds: DataFrame, next_table: DataFrame, max_new: int) -> DataFrame:
    """Up to ``max_new`` greedy steps from each seed word.

    seeds: (prompt_id, model_id, word).  Output: prompt_id, model_id, step, word with step 0
    the seed; a walk stops early at a word that never precedes another word.

    Greedy continuation is a function of the word, so walks are doubled: with the words of
    steps 0 to L-1 and the map "L steps on", one join gives steps L to 2L-1, and the map
    joined with itself goes 2L steps on.  About log2(max_new) joins instead of max_new.
    """
    walk = materialize(seeds.select("model_id", F.col("word").alias("start")).distinct()
                       .select("model_id", "start", F.lit(0).alias("step"), F.col("start").alias("word")), "greedy-walk")
    on = materialize(next_table.select("model_id", F.col("prev").alias("word"), F.col("next_word").alias("there")), "greedy-map")
    on = _walked(on, walk.select("model_id", F.col("start").alias("word")))
    length, last = 1, int(max_new)
    while length <= last:
        more = (walk.where(F.col("step") + length <= last).join(on, on=["model_id", "word"])
                .select("model_id", "start", (F.col("step") + length).alias("step"), F.col("there").alias("word")))
        walk = materialize(walk.unionByName(more), "greedy-walk")
        length *= 2
        if length <= last:
            further = on.select("model_id", F.col("word").alias("there"), F.col("there").alias("_far"))
            on = materialize(on.join(further, on=["model_id", "there"]).select("model_id", "word", F.col("_far").alias("there")), "greedy-map")
    s = seeds.select("prompt_id", "model_id", F.col("word").alias("start"))
    return s.join(walk, on=["model_id", "start"], how="inner").select("prompt_id", "model_id", "step", "word")


def continuation_text(walk: DataFrame) -> DataFrame:
    """Words after step 0 joined in step order, per (prompt_id, model_id).

    A continuation is at most ``max_new`` words, so gathering it is bounded.
    """
    g = walk.where(F.col("step") > 0).groupBy("prompt_id", "model_id").agg(
        F.sort_array(F.collect_list(F.struct("step", "word"))).alias("_w"))
    return g.select("prompt_id", "model_id", F.array_join(F.col("_w.word"), " ").alias("continuation"))


def continuations(seeds: DataFrame, next_table: DataFrame, max_new: int) -> DataFrame:
    """G2 as text: ``continuation_text`` of ``greedy_extend`` per (prompt_id, model_id).

    A continuation is a function of the model and the prompt's last word (words, if a prompt_id has
    several rows), so each one is walked and joined once and then goes to all its prompts."""
    ends = (seeds.where(F.col("prompt_id").isNotNull()).groupBy("prompt_id", "model_id")
            .agg(F.sort_array(F.collect_list("word")).alias("ends")))
    each = ends.select(F.col("ends").alias("prompt_id"), "model_id").distinct()
    walk = greedy_extend(each.select("prompt_id", "model_id", F.explode("prompt_id").alias("word")), next_table, max_new)
    text = continuation_text(walk).withColumnRenamed("prompt_id", "ends")
    return ends.join(text, on=["ends", "model_id"], how="inner").select("prompt_id", "model_id", "continuation")
