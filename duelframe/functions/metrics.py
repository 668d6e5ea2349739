"""Preference metrics (D1-D9) as Column expressions, shared by batch and stream jobs.

Inputs are summed log-probabilities: ``pc`` policy/chosen, ``pr`` policy/rejected,
``rc`` reference/chosen, ``rr`` reference/rejected.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from duelframe.config import PrefConfig


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def log_sigmoid(x: Column) -> Column:
    """Stable log(sigmoid(x)) = min(x, 0) - log1p(exp(-|x|)); finite for |x| in the thousands."""
    return F.least(x, F.lit(0.0)) - F.log1p(F.exp(-F.abs(x)))


def sigmoid(x: Column) -> Column:
    return F.exp(log_sigmoid(x))


def dpo_logits(pc, pr, rc, rr, reference_free: bool = False) -> Column:
    """z = (pc - pr) - (rc - rr); reference terms are 0 when reference-free."""
    policy = _c(pc) - _c(pr)
    if reference_free:
        return policy
    return policy - (_c(rc) - _c(rr))


def dpo_loss(z, beta: float = 0.1, label_smoothing: float = 0.0) -> Column:
    """-(1-eps) log sigma(beta z) - eps log sigma(-beta z)."""
    bz = F.lit(float(beta)) * _c(z)
    loss = -log_sigmoid(bz) * F.lit(1.0 - label_smoothing)
    if label_smoothing:
        loss = loss - log_sigmoid(-bz) * F.lit(float(label_smoothing))
    return loss


def reward(policy_logp, ref_logp, beta: float = 0.1, reference_free: bool = False) -> Column:
    """Beta * (policy - reference); reference term dropped when reference-free."""
    if reference_free:
        return F.lit(float(beta)) * _c(policy_logp)
    return F.lit(float(beta)) * (_c(policy_logp) - _c(ref_logp))


def strictly_greater(a, b) -> Column:
    """Strict a > b where NaN on either side counts as wrong (Spark orders NaN above numbers)."""
    a, b = _c(a), _c(b)
    return F.when(F.isnan(a) | F.isnan(b), F.lit(False)).otherwise(a > b)


def with_dpo_metrics(df: DataFrame, cfg: PrefConfig = PrefConfig(),
                     pc="pc", pr="pr", rc="rc", rr="rr") -> DataFrame:
    """D1-D6 appended as columns z, loss, reward_chosen, reward_rejected, reward_margin, correct."""
    rf = cfg.reference_free
    return (df
            .withColumn("z", dpo_logits(pc, pr, rc, rr, rf))
            .withColumn("loss", dpo_loss(F.col("z"), cfg.beta, cfg.label_smoothing))
            .withColumn("reward_chosen", reward(pc, rc, cfg.beta, rf))
            .withColumn("reward_rejected", reward(pr, rr, cfg.beta, rf))
            .withColumn("reward_margin", F.col("reward_chosen") - F.col("reward_rejected"))
            .withColumn("correct", strictly_greater("reward_chosen", "reward_rejected")))


def delta_columns(pc="pc", pr="pr", rc="rc", rr="rr") -> list[Column]:
    """Unscaled policy-minus-reference deltas and their difference."""
    dc = _c(pc) - _c(rc)
    dr = _c(pr) - _c(rr)
    return [dc.alias("delta_chosen"), dr.alias("delta_rejected"), (dc - dr).alias("delta_margin")]


def mean_logp_margin(sum_chosen, n_chosen, sum_rejected, n_rejected) -> Column:
    """Per-token mean log-prob of chosen minus rejected within one model; NULL when a side is empty."""
    mc = F.when(_c(n_chosen) > 0, _c(sum_chosen) / _c(n_chosen))
    mr = F.when(_c(n_rejected) > 0, _c(sum_rejected) / _c(n_rejected))
    return mc - mr


def summary_aggs(prefix: str = "") -> list[Column]:
    """A3: row-weighted means of every metric (the reference's six-entry dict plus loss)."""
    p = prefix
    return [
        F.count(F.lit(1)).alias(f"{p}n"),
        F.avg("loss").alias(f"{p}loss"),
        F.avg("reward_chosen").alias(f"{p}reward_chosen"),
        F.avg("reward_rejected").alias(f"{p}reward_rejected"),
        F.avg("reward_margin").alias(f"{p}reward_margin"),
        F.avg(F.col("correct").cast("double")).alias(f"{p}accuracy"),
        F.avg("pc").alias(f"{p}logps_chosen"),
        F.avg("pr").alias(f"{p}logps_rejected"),
    ]
