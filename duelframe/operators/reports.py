"""Summaries (A2-A8, D9, G4).  Each returns a DataFrame; nothing is collected."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from duelframe.config import PrefConfig
from duelframe.functions.buckets import bucket_id, bucket_label, parse_edges
from duelframe.functions.metrics import (delta_columns, mean_logp_margin, strictly_greater, summary_aggs,
                                          with_dpo_metrics)
from duelframe.functions.text import char_len, preview


def select_tags(metric_log: DataFrame, substrings: Sequence[str] = ("rewards/", "logps/", "logits/"),
                tag_col: str = "tag") -> DataFrame:
    """Metric rows whose tag contains any of the substrings (rows have no order: a sort
    by the few tags would put each tag in one task)."""
    keep = F.lit(False)
    for sub in substrings:
        keep = keep | F.col(tag_col).contains(sub)
    return metric_log.where(keep)


def summarise(scored: DataFrame) -> DataFrame:
    """A3: row-weighted means over all rows."""
    return scored.agg(*summary_aggs())


def batch_metrics(scored: DataFrame, n_batches: int | None = None) -> DataFrame:
    """A2: per-batch means of loss, margin and accuracy.

    Callers select the first batches before scoring (``batch_id < n``); the filter here
    only guards the output.
    """
    df = scored if n_batches is None else scored.where(F.col("batch_id") < F.lit(int(n_batches)))
    return df.groupBy("batch_id").agg(
        F.count(F.lit(1)).alias("n"), F.avg("loss").alias("loss"),
        F.avg("reward_margin").alias("reward_margin"), F.avg(F.col("correct").cast("double")).alias("accuracy"),
        F.avg("reward_chosen").alias("reward_chosen"), F.avg("reward_rejected").alias("reward_rejected"))


def summarise_batches(batches: DataFrame) -> DataFrame:
    """A4: unweighted mean of batch means (a short last batch counts as much as a full one)."""
    return batches.agg(F.count(F.lit(1)).alias("n_batches"), F.sum("n").alias("n"),
                       F.avg("loss").alias("mean_loss"), F.avg("reward_margin").alias("mean_reward_margin"),
                       F.avg("accuracy").alias("mean_reward_acc"))


def batch_sign_rate(batches: DataFrame) -> DataFrame:
    """A5: share of batches whose mean margin is positive, plus the means of batch means."""
    pos = F.when(F.isnan("reward_margin"), F.lit(0.0)).otherwise((F.col("reward_margin") > 0).cast("double"))
    return batches.agg(F.count(F.lit(1)).alias("n_batches"), F.avg("reward_margin").alias("mean_margin"),
                       F.avg(pos).alias("frac_batches_margin_pos"), F.avg("accuracy").alias("mean_acc"))


def bucket_report(scored: DataFrame, edges: str | Sequence[int] = PrefConfig().bucket_edges,
                  mode: str = "reference", key: str = "length_key") -> DataFrame:
    """Per-bucket count and means plus the overall row, in one pass.

    ``n_scored`` counts the pairs that the means are over (an empty answer has no score).

    ``rollup`` on the bucket id is GROUPING SETS ((bucket), ()), so the overall row and
    the buckets come out of one partial/final aggregation.  Empty buckets are absent;
    rows sort by the bucket's lower edge with the overall row first.
    """
    e = parse_edges(edges)
    b = scored.withColumn("bucket_id", bucket_id(F.col(key), e, mode))
    agg = b.rollup("bucket_id").agg(
        F.grouping("bucket_id").alias("_g"), F.count(F.lit(1)).alias("n"), F.count("loss").alias("n_scored"),
        F.avg("loss").alias("mean_loss"), F.avg("reward_margin").alias("mean_margin"),
        F.avg(F.col("correct").cast("double")).alias("mean_acc"))
    out = agg.select(
        F.when(F.col("_g") == 1, F.lit("overall")).otherwise(bucket_label(F.col("bucket_id"), e)).alias("bucket"),
        F.when(F.col("_g") == 1, F.lit(None).cast("int")).otherwise(F.col("bucket_id")).alias("bucket_id"),
        "n", "n_scored", "mean_loss", "mean_margin", "mean_acc")
    # at most len(edges) rows: sorting them is free
    return out.orderBy(F.col("bucket_id").asc_nulls_first())


def compare_policies(seq_wide: DataFrame, policy_ids: Sequence[str], ref_id: str,
                     cfg: PrefConfig = PrefConfig()) -> DataFrame:
    """The same pairs under several policies against one reference, one row per policy.

    Per-side sums for every model are already columns, so the policies are an unpivot of
    one per-pair table (no re-scan, no union of jobs).
    """
    def pick(col, side):
        return F.max(F.when(F.col("side") == side, F.col(col)))

    models = list(dict.fromkeys([*policy_ids, ref_id]))
    per_pair = seq_wide.groupBy("pair_id").agg(
        *[pick(f"sum_{m}", s).alias(f"{m}__{s}") for m in models for s in ("chosen", "rejected")],
        pick("n_tokens", "chosen").alias("n_chosen"), pick("n_tokens", "rejected").alias("n_rejected"))
    rows = F.inline(F.array(*[F.struct(
        F.lit(p).alias("policy_id"), F.col(f"{p}__chosen").alias("pc"), F.col(f"{p}__rejected").alias("pr"),
        F.col(f"{ref_id}__chosen").alias("rc"), F.col(f"{ref_id}__rejected").alias("rr")) for p in policy_ids]))
    long = per_pair.select("pair_id", "n_chosen", "n_rejected", rows)
    scored = with_dpo_metrics(long, cfg).withColumn(
        "mean_logp_margin", mean_logp_margin("pc", "n_chosen", "pr", "n_rejected"))
    return scored.groupBy("policy_id").agg(
        F.count(F.lit(1)).alias("n"), F.count("loss").alias("n_scored"), F.avg("loss").alias("loss"), F.avg("reward_margin").alias("reward_margin"),
        F.avg(F.col("correct").cast("double")).alias("accuracy"),
        F.avg("mean_logp_margin").alias("mean_logp_margin"),
        F.avg((F.col("mean_logp_margin") > 0).cast("double")).alias("frac_mean_logp_pos"))


def policy_margins_by_pair(seq_wide: DataFrame, policy_ids: Sequence[str], ref_id: str,
                           cfg: PrefConfig = PrefConfig()) -> DataFrame:
    """A8 per pair: reward margin and correctness of every policy side by side.

    One aggregate over the (pair, side) table; policies become columns with explicit names.
    """
    def pick(col, side):
        return F.max(F.when(F.col("side") == side, F.col(col)))

    models = list(dict.fromkeys([*policy_ids, ref_id]))
    per_pair = seq_wide.groupBy("pair_id").agg(
        *[pick(f"sum_{m}", sd).alias(f"{m}__{sd}") for m in models for sd in ("chosen", "rejected")])
    b = F.lit(float(cfg.beta))
    cols = ["pair_id"]
    for p in policy_ids:
        rc = b * (F.col(f"{p}__chosen") - F.col(f"{ref_id}__chosen"))
        rr = b * (F.col(f"{p}__rejected") - F.col(f"{ref_id}__rejected"))
        cols += [(rc - rr).alias(f"margin_{p}"), strictly_greater(rc, rr).alias(f"correct_{p}")]
    return per_pair.select(*cols)


def length_bias_report(pl: DataFrame) -> DataFrame:
    """D9 (+D7): tokens, sums and means per side and model in one row per pair.

    Adds whether ranking the two answers by summed and by mean log-prob disagree, the
    length effect the reference's hand analysis looked for.
    """
    sum_pref = F.col("pc") > F.col("pr")
    mean_pref = F.col("mc_policy") > F.col("mr_policy")
    return pl.select(
        "pair_id", "n_chosen", "n_rejected", "pc", "pr", "rc", "rr", "mc_policy", "mr_policy", "mc_ref", "mr_ref",
        *delta_columns(),
        (F.col("mc_policy") - F.col("mr_policy")).alias("mean_logp_margin_policy"),
        (F.col("mc_ref") - F.col("mr_ref")).alias("mean_logp_margin_ref"),
        (sum_pref != mean_pref).alias("sum_mean_disagree"))


def generation_report(gen: DataFrame, model_ids: Sequence[str], preview_chars: int = 900) -> DataFrame:
    """Side-by-side generations per prompt (length in chars and a preview per model).

    ``gen`` has prompt_id, model_id, answer.  Models are pivoted with explicit values.
    """
    aggs = []
    for m in model_ids:
        pick = F.max(F.when(F.col("model_id") == m, F.col("answer")))
        aggs.append(pick.alias(f"answer_{m}"))
    g = gen.groupBy("prompt_id").agg(*aggs)
    cols = ["prompt_id"]
    for m in model_ids:
        cols += [char_len(f"answer_{m}").alias(f"chars_{m}"), preview(f"answer_{m}", preview_chars).alias(f"preview_{m}")]
    return g.select(*cols)
